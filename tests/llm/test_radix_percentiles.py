import math
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa

from grovelight.llm import radix_percentiles as rp

SCHEMA = "row_id long, source string, part_day date, idx array<int>, val array<double>, feature int, n long"


def test_order_of_keys():
    v = np.array([-math.inf, -1e300, -2.5, -1e-310, -0.0, 0.0, 1e-310, 2.5, 1e300, math.inf])
    k = rp.to_ordered(v)
    assert (np.diff(k) >= 0).all() and k[4] == k[5]
    assert (rp.from_ordered(k) == v).all()


def data(seed=5):
    import datetime as dt

    r = random.Random(seed)
    out = []
    for i in range(600):
        k = r.randrange(5)
        idx = [r.choice([0, 1, 7, 8, None]) for _ in range(k)]
        val = [r.choice([None, float("nan"), -3.5, 0.0, -0.0, r.gauss(0, 100), 57.6, 57.6 + 1e-12, math.inf]) for _ in range(k)]
        out.append((i, r.choice(["a", "a", "a", "b", None]), r.choice([None, dt.date(2025, 3, 1), dt.date(2025, 3, 2)]), idx, val, 99, 99))
    return [*out, *out[:100], *[out[1]] * 50, (None, "a", None, [0], [1.0], 9, 9), (9000, "a", None, None, None, 9, 9), (9001, "c", None, [], [], 9, 9)]


def test_against_brute_force(spark):
    rows = data()
    groups, seen = defaultdict(list), set()
    for i, s, _, idx, val, *_ in rows:
        if i is None or s is None or i in seen:
            continue
        seen.add(i)
        for f, v in zip(idx or [], val or [], strict=True):
            if f is not None and 0 <= f <= 7 and v is not None and v == v:
                groups[s, f].append(v)
    want = {}
    for g, v in groups.items():
        v.sort()
        for p in (1, 50, 90, 99, 100):
            want[*g, p] = (len(v), v[max(1, math.ceil(p * len(v) / 100)) - 1])
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = rp.percentiles(rp.ordered_values(df), (1, 50, 90, 99, 100)).collect()
    assert {(r.source, r.feature, r.pct): (r.n_values, r.value) for r in got} == want


def test_days_add_up_and_digits_bound_the_error(spark):
    v = rp.ordered_values(spark.createDataFrame(data(), SCHEMA)).cache()
    whole = v.groupBy().sum("n").first()[0]
    assert rp.day_histograms(v, 2).groupBy().sum("n").first()[0] == whole
    exact = {(r.source, r.feature, r.pct): r.value for r in rp.percentiles(v).collect()}
    for r in rp.percentiles(v, digits=2).collect():
        e = exact[r.source, r.feature, r.pct]
        assert r.value == e or abs(r.value - e) <= abs(e) * 2**-19


def test_kept_days_combine(spark, tmp_path):
    """Two days computed apart and written, read again and combined: exact ranks, values within the last digit."""
    once = [r for r in data()[:600] if r[2]]
    df = spark.createDataFrame(once, SCHEMA)
    for k, day in enumerate(("2025-03-01", "2025-03-02")):
        rp.day_histograms(rp.ordered_values(df.filter(f"part_day = date '{day}'")), 2).write.parquet(str(tmp_path / str(k)))
    both = rp.combined(*(spark.read.parquet(str(tmp_path / str(k))) for k in range(2)))
    exact = {(r.source, r.feature, r.pct): (r.n_values, r.value) for r in rp.percentiles(rp.ordered_values(df)).collect()}
    got = rp.estimates(both).collect()
    assert len(got) == len(exact) > 10
    for r in got:
        n, e = exact[r.source, r.feature, r.pct]
        assert r.n_values == n and (r.value == e or abs(r.value - e) <= abs(e) * 2**-19)


def test_copies_in_small_pieces(monkeypatch):
    monkeypatch.setattr(rp, "FLUSH", 2)
    t = [(1, "a", 0, [0], [5]), (1, "a", 0, [0], [5]), (2, "a", 0, [0, 1], [5, 7]), (3, "b", 1, [0], [5]), (3, "c", 1, [0], [5]), (9, "a", 0, [0], [5])]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*t[k : k + 2], strict=True), rp.ONCE, strict=True)], schema=rp.ONCE) for k in range(0, 6, 2)]
    got = defaultdict(int)
    for b in rp._distinct_keys(iter(batches)):
        for r in b.to_pylist():
            got[r["source"], r["feature"], r["ordered"]] += r["n"]
    assert got == {("a", 0, 5): 3, ("a", 1, 7): 1, ("b", 0, 5): 1}


def test_limits_and_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert rp.percentiles(rp.ordered_values(df)).count() == 0
    one = spark.createDataFrame([(i, "a", None, [0], [float(i)], 1, 1) for i in range(40)], SCHEMA)
    lim = spark.createDataFrame([(0, 50, 0.0, 10.0), (0, 90, 0.0, 100.0)], "feature int, pct int, lo double, hi double")
    found = rp.outside_limits(rp.percentiles(rp.ordered_values(one)), lim)
    assert [(r.source, r.pct, r.value) for r in found.collect()] == [("a", 50, 19.0)]
    assert rp.outside_limits(rp.percentiles(rp.ordered_values(one.limit(20))), lim).count() == 0
