import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from grovelight.llm import term_stats as ts

SCHEMA = "row_id long, idx array<int>, val array<double>, term string, docs int"


def rows(n=400, seed=3):
    r = random.Random(seed)
    out = []
    for i in range(n):
        k = r.randrange(6)
        idx = [r.choice([0, 1, 2, 500, 10**6, r.randrange(50)]) for _ in range(k)]
        val = [r.choice([None, float("nan"), 1.0, -2.5, 0.0005, r.randrange(20) / 7]) for _ in range(k)]
        out.append((r.randrange(-5, 2**40) if r.random() < 0.1 else i, idx, val, "x", 1))
    out += out[:50] * 3 + [out[0]] * 200  # sent again; one record very often
    return [*out, (None, [1], [1.0], "x", 1), (7777, None, None, "x", 1), (7778, [], [], "x", 1)]


def brute(data):
    docs, occ = defaultdict(set), Counter()
    for i, idx, val, *_ in data:
        if i is None:
            continue
        terms = [("idx", x) for x in idx or []] + [("val", int(np.sign(v) * np.floor(abs(v) * 1000 + 0.5))) for v in val or [] if v is not None and v == v]
        for t in terms:
            docs[t].add(i)
            occ[t] += 1
    return {t: (len(d), occ[t]) for t, d in docs.items()}, len({d[0] for d in data if d[0] is not None})


def test_against_brute_force(spark):
    data = rows()
    want, n = brute(data)
    got = ts.marked_terms(spark.createDataFrame(data, SCHEMA).repartition(5), min_docs=3, max_share=0.2).collect()
    assert {(r.kind, r.term): (r.docs, r.occurrences) for r in got} == want
    assert {r.n_records for r in got} == {n}
    for r in got:
        assert r.mark == ("rare" if r.docs < 3 else "common" if r.docs > 0.2 * n else "kept")


def test_union_and_gap_coding():
    r = np.random.default_rng(1)
    for top in (50, 2**40):
        t, i = r.integers(-top, top, 500), r.integers(0, top, 500)
        a, b, n = ts.union(np.r_[t, t[:100]], np.r_[i, i[:100]])
        assert list(zip(a, b, strict=True)) == sorted(set(zip(t.tolist(), i.tolist(), strict=True)))
        assert n.sum() == 600
        low = b & 16383
        back = ts.decoded(ts.coded(a, low, n))
        assert all((x == y).all() for x, y in zip(back, (a, low, n), strict=True))
        again = ts.union(np.r_[a, a], np.r_[b, b], np.r_[n, n])
        assert (again[0] == a).all() and (again[2] == 2 * n).all()


def test_merge_of_chunks_in_pieces(monkeypatch):
    """Small limits: chunks are settled on the way and counts go out in pieces; the sums stay."""
    monkeypatch.setattr(ts, "FLUSH", 50)
    monkeypatch.setattr(ts, "SETTLE", 20)
    data = [r for r in rows(300, 8) if r[0] is not None]
    batches = [pa.RecordBatch.from_arrays([pa.array([r[0] for r in p]), pa.array([r[1] for r in p], pa.list_(pa.int32())), pa.array([r[2] for r in p], pa.list_(pa.float64()))], ["row_id", "idx", "val"]) for p in (data[k : k + 40] for k in range(0, len(data), 40))]
    blocks = sorted((tuple(r.values()) for b in ts._build(iter(batches)) for r in b.to_pylist()), key=lambda r: r[:2])
    out = Counter(), Counter()
    for k in ts._merge(iter([pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*blocks[s : s + 9], strict=True), ts.BLOCKS, strict=True)], schema=ts.BLOCKS) for s in range(0, len(blocks), 9)])):
        for r in k.to_pylist():
            out[0][r["kind"], r["term"]] += r["docs"]
            out[1][r["kind"], r["term"]] += r["occurrences"]
    want, n = brute(data)
    assert out[0].pop(("all", 0)) == n
    assert {t: (out[0][t], out[1][t]) for t in out[0]} == want


def test_empty(spark):
    assert ts.marked_terms(spark.createDataFrame([], SCHEMA)).count() == 0


def test_huge_values_are_terms_or_an_error():
    def terms(*values):
        batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([[0]], pa.list_(pa.int32())), pa.array([list(values)], pa.list_(pa.float64()))], ["row_id", "idx", "val"])
        return list(ts.postings(batch))[1][1].tolist()

    assert terms(9.1e15, -9.2e15, float("inf"), None, float("nan")) == [9_100_000_000_000_000_000, -9_200_000_000_000_000_000]
    for v in (9.3e15, -1e300, 1.7e308):
        with pytest.raises(OverflowError):
            terms(v)
