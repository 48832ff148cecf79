from hypothesis import given, settings
from hypothesis import strategies as st

from grovelight.llm import quota_sampling as qs

ROWS = "row_id long, split_name string, label double, plan_id string, h int"


def labelled(spark, counts):
    rows, i = [], 0
    for label, n in counts:
        for _ in range(n):
            rows.append((i, "train", label, "clash", 1))
            i += 1
    rows += [(i + k, s, v, "clash", 1) for k, (s, v) in enumerate([("test", 0.0), ("train", None), ("train", float("nan")), ("train", 99.0), ("train", -1.0), (None, 1.0)])]
    return spark.createDataFrame(rows, ROWS)


def targets(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "plan_id string, label_id int, target_share double, min_rows int, sample_share double, available string")


def quotas(*args):
    return {k: v[0] for k, v in qs.allocate(*args).items()}


def test_unmet_quota_goes_to_siblings_then_cousins():
    want = [(k, 0.25, 0) for k in range(4)]
    assert qs.allocate(want, {0: 2, 1: 100, 2: 100, 3: 100}, 40) == {0: (2, 8, 0), 1: (18, 0, 8), 2: (10, 0, 0), 3: (10, 0, 0)}
    assert quotas(want, {0: 2, 1: 12, 2: 100, 3: 11}, 40) == {0: 2, 1: 12, 2: 15, 3: 11}
    assert sum(quotas(want, {0: 1, 1: 1, 2: 1}, 40).values()) == 3  # all there are
    assert qs.allocate([], {}, 10) == {}


def test_minimums_come_first_and_the_total_stays():
    assert quotas([(0, 0.7, 0), (1, 0.2, 0), (2, 0.05, 60), (3, 0.05, 60)], dict.fromkeys(range(4), 1000), 100) == {0: 0, 1: 0, 2: 60, 3: 60}
    got = quotas([(0, 0.7, 0), (1, 0.2, 0), (2, 0.05, 20), (3, 0.05, 10)], dict.fromkeys(range(4), 1000), 100)
    assert got == {0: 54, 1: 16, 2: 20, 3: 10}
    assert quotas([(0, 0.5, 3), (5, 0.5, 0)], {0: 1, 5: 9}, 6) == {0: 1, 5: 5}


@given(st.lists(st.tuples(st.integers(0, 20), st.integers(0, 9), st.integers(0, 30), st.integers(0, 60)), max_size=14, unique_by=lambda x: x[0]), st.integers(0, 200))
@settings(max_examples=200, deadline=None)
def test_totals(leaves, size):
    room = {x: r for x, _, _, r in leaves}
    got = quotas([(x, w / 20, m) for x, w, m, _ in leaves], room, size)
    least = sum(min(m, room[x]) for x, _, m, _ in leaves)
    assert sum(got.values()) == min(max(size, least), sum(room.values()))
    for x, _, m, r in leaves:
        assert min(m, r) <= got[x] <= r


def test_usable_rows(spark):
    df = labelled(spark, [(0.0, 3), (11.0, 2)])
    assert sorted(r.label_id for r in qs.usable_rows(df).collect()) == [0, 0, 0, 0, 11, 11]


def test_sample_and_report(spark):
    counts = {0: 500, 1: 90, 2: 7, 3: 1}
    rows = qs.usable_rows(labelled(spark, [(float(k), n) for k, n in counts.items()]))
    n = sum(counts.values()) + 1
    t = targets(spark, [("p", k, 0.25, 2, 0.3) for k in range(4)] + [("q", 0, None, None, None), ("q", 9, 0.5, 1, 0.1), (None, 1, 0.1, 1, 0.1), ("q", 0, None, None, None)])
    a = qs.allocation(qs.counted(rows), t).cache()
    got = {(r.plan_id, r.label_id): r for r in a.collect()}
    assert {k for k, r in got.items() if r.short} == {("p", 2), ("p", 3), ("q", 9)}
    assert got["p", 3].quota == 1 and got["p", 2].quota == 7 and got["p", 1].quota <= 90
    assert sum(r.quota for r in got.values() if r.plan_id == "p") == round(0.3 * n)
    s = qs.draw(rows, a).collect()
    assert len(s) == len({(r.plan_id, r.row_id) for r in s}) == sum(r.quota for r in got.values())
    for k in range(4):
        assert sum(r.plan_id == "p" and r.label_id == k for r in s) == got["p", k].quota
    assert {tuple(r) for r in s} == {tuple(r) for r in qs.draw(rows.repartition(7), a).collect()}


def test_draw_is_the_first_of_the_order(spark):
    """Whatever the number of buckets, the rows are those of least place."""
    rows = qs.usable_rows(labelled(spark, [(0.0, 300), (1.0, 5)]))
    a = spark.createDataFrame([("p", 0, 120), ("p", 1, 5), ("q", 0, 1), ("q", 1, 0)], "plan_id string, label_id int, quota long")
    order = {}
    for r in rows.select("label_id", "row_id", qs.permuted(qs.F.col("row_id")).alias("k")).collect():
        order.setdefault(r.label_id, []).append((r.k, r.row_id))
    want = {(p, x, i) for p, x, q in [("p", 0, 120), ("p", 1, 5), ("q", 0, 1)] for _, i in sorted(order[x])[:q]}
    for b in (1, 7, 4096):
        assert {tuple(r) for r in qs.draw(rows, a, b).collect()} == want
    big = spark.createDataFrame([(2**62 + k, 0) for k in range(50)] + [(-(2**62) - k, 0) for k in range(50)], "row_id long, label_id int")
    assert qs.draw(big, a.filter("plan_id = 'q'")).count() == 1


def test_empty(spark):
    rows = qs.usable_rows(labelled(spark, []).limit(0))
    a = qs.allocation(qs.counted(rows), targets(spark, [("p", 0, 0.5, 1, 0.1), ("p", 1, 0.5, 0, 0.1)]))
    assert [(r.label_id, r.quota, r.short) for r in a.orderBy("label_id").collect()] == [(0, 0, True), (1, 0, False)]
    assert qs.draw(rows, a).count() == 0
    assert qs.allocation(qs.counted(rows), targets(spark, [("p", 0, 0.5, 1, 0.1)]).limit(0)).count() == 0
    assert [(r.drawn, r.reached_share) for r in qs.report(rows, a).collect()] == [(0, 0.0), (0, 0.0)]
