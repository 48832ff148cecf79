import random

import numpy as np
import pytest

from grovelight.llm import split_overlap as so

SCHEMA = "row_id long, split_name string, source string, features array<double>, rep string, part string"


def agree(a, b):
    n = 0
    for x, y in zip(a, b, strict=True):
        x, y = (None if v is None or v != v else v for v in (x, y))
        if x is None or y is None:
            n += x is None and y is None
        else:
            n += x == y or abs(x - y) <= max(0.005 * max(abs(x), abs(y)), 0.01)
    return n


def near(r, x):
    d = max(0.005 * abs(x), 0.01)
    return x + r.choice([0, d * 0.999, -d * 0.99, d * 1.02, r.uniform(-d, d)])


def data(seed):
    r = random.Random(seed)
    base = [[r.choice([r.uniform(-3, 3), r.gauss(0, 500), 0.0, 1.0, None, float("nan")]) for _ in range(22)] for _ in range(60)]
    rows = []
    for i in range(260):
        f = list(r.choice(base))
        f = [v if v is None or v != v else near(r, v) if r.random() < 0.6 else v for v in f]
        for _ in range(r.randrange(4)):
            f[r.randrange(22)] = r.choice([None, r.uniform(-3, 3)])
        rows.append((i, r.choice(["train", "train", "check", "test"]), r.choice(["a", None]), f, "clash", "clash"))
    rows += [(1000 + k, s, "a", rows[0][3], "x", "x") for k, s in enumerate(["train"] * 5 + ["test"] * 5)]  # copies
    rows += [(2000, "train", "a", None, "x", "x"), (2001, "test", "a", [None] * 22, "x", "x"), (2002, "test", "a", [1.0], "x", "x"), (2003, "train", "a", [1.0] + [None] * 30, "x", "x"), (None, "test", "a", rows[0][3], "x", "x"), (2004, None, "a", rows[0][3], "x", "x")]
    return rows


def brute(rows):
    full = [(i, s, ([*(f or []), *[None] * 22])[:22]) for i, s, _, f, *_ in rows if i is not None and s is not None]
    return {(min(i, j), max(i, j)) for i, s, f in full if s == "train" for j, t, g in full if t != "train" and agree(f, g) >= 20}


@pytest.mark.parametrize("seed,hot,shared", [(1, 10**9, 32), (2, 10**9, 2), (3, 2, 32), (4, 5, 1)])
def test_against_brute_force(spark, seed, hot, shared):
    """hot=2 makes nearly every part a hot one, which is extended before it is dealt; shared=1 sends nearly every passage on to a next round."""
    rows = data(seed)
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows)
    got = so.overlaps(df, hot_least=hot, hot_share=0.0, shared=shared).collect()
    assert len(want) > 20
    assert {(r.row_id_a, r.row_id_b) for r in got} == want and len(got) == len(want)


def test_report(spark):
    df = spark.createDataFrame(data(1), SCHEMA)
    pairs = so.linked(so.records(df)).cache()
    found = so.expanded(pairs, so.records(df)).collect()
    cover = so.coverage(pairs, df).cache()
    rep = so.overlap_report(cover).collect()
    assert sum(r.pairs for r in rep) == len(found) and {r.split_name for r in rep} <= {"check", "test"}
    assert {r.row_id for r in cover.collect()} == {r.eval_row for r in found}
    assert all(20 <= r.covered <= 22 for r in cover.collect())
    # what the scan covered is part of what agrees or lies in a neighbouring bin; every pair has a whole segment
    assert all(bin(r.covered).count("1") >= 7 for r in pairs.collect())


def test_empty_and_one_sided(spark):
    df = spark.createDataFrame(data(1), SCHEMA)
    assert so.overlaps(df.limit(0)).count() == 0
    assert so.overlaps(df.filter("split_name = 'train'")).count() == 0


def test_grid_keeps_agreeing_values_near():
    r = np.random.default_rng(0)
    x = np.concatenate([r.normal(0, 1000, 20000), r.uniform(-4, 4, 20000)])
    y = x + r.uniform(-1, 1, len(x)) * np.maximum(0.005 * np.abs(x), 0.01)
    ok = np.abs(x - y) <= np.maximum(0.005 * np.maximum(np.abs(x), np.abs(y)), 0.01)
    assert (np.abs(so.grid(x, 0.005, 0.01) - so.grid(y, 0.005, 0.01))[ok] <= so.SLACK).all()
