import pytest

from grovelight.llm import mixing as m

DOCS = "doc_id long, text string, source string, tokens string, size int"
TARGETS = "mix_id string, source string, target_weight double, max_repeats int, budget_share double, total string"


def docs(spark):
    rows = [(i, f"the cat number {i} sat on the mat", "big" if i % 10 else "small", "clash", 1) for i in range(400)]
    rows += [(1000, None, "big", "x", 1), (1001, "", "small", "x", 1), (1002, "no source here at all", None, "x", 1), (1003, "long " * 50000, "long", "x", 1)]
    return spark.createDataFrame(rows, DOCS)


def targets(spark):
    rows = [("a", "big", 0.5, 3, 0.1), ("a", "small", 0.5, 2, 0.1), ("b", "big", 1.0, 1, 0.01), ("b", "none", 0.0, 1, 0.01), ("b", "gone", 0.1, 5, 0.01), ("b", "long", None, None, None)]
    return spark.createDataFrame([(*r, "clash") for r in rows], TARGETS)


def test_token_counts(spark):
    got = {r.doc_id: r.tokens for r in m.with_tokens(docs(spark)).collect()}
    enc = m.tokenizer(m.VOCABULARY)
    for i, t in [(5, "the cat number 5 sat on the mat"), (1003, "long " * 50000)]:
        assert got[i] == len(enc.encode_ordinary(t)) and enc.decode(enc.encode_ordinary(t)) == t
    assert got[1000] == got[1001] == 0


def test_plan_and_copies(spark):
    d, t = docs(spark), targets(spark)
    copies, plan = m.mixed(d, t)
    p = {(r.mix_id, r.source): r for r in plan.collect()}
    size = {s: p[k].size for k in p for s in [k[1]]}
    total = p["a", "big"].total
    for k, r in p.items():
        assert r.wanted == pytest.approx((r.target_weight or 0) * (r.budget_share or 0) * total)
        assert r.short == (size[k[1]] * r.max_repeats < r.wanted)
    assert p["b", "gone"].short and not p["b", "none"].short and p["a", "small"].rate == 2.0 and p["a", "small"].short
    c = copies.collect()
    assert len({(r.mix_id, r.doc_id) for r in c}) == len(c)
    for r in c:
        rate = p[r.mix_id, r.source].rate
        assert int(rate) <= r.copies <= min(int(rate) + 1, p[r.mix_id, r.source].max_repeats)
    n = sum(r.copies for r in c if r.mix_id == "b" and r.source == "big")
    assert abs(n - p["b", "big"].rate * 361) < 4 * (361 * p["b", "big"].rate + 1) ** 0.5
    assert m.emit(copies).count() == sum(r.copies for r in c)
    shares = m.shares(copies, plan).collect()
    for mix in "ab":
        assert sum(r.reached_share for r in shares if r.mix_id == mix) == pytest.approx(1.0)
    assert {tuple(r) for r in m.mixed(d.repartition(5), t)[0].collect()} == {tuple(r) for r in c}


def test_empty(spark):
    copies, plan = m.mixed(docs(spark).limit(0), targets(spark))
    assert copies.count() == 0 and plan.filter("short").count() == 0
    assert m.mixed(docs(spark), targets(spark).limit(0))[0].count() == 0
