"""Splits, bagging weights, folds and feature draws, all repeatable from hashes of identifiers."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grovelight.functions.expressions import poisson, uniform, uniform_array


def split(df: DataFrame, shares: Sequence[float] = (0.7, 0.3), names: Sequence[str] = ("train", "test"), seed: int = 0, row_id: str = "row_id") -> DataFrame:
    """``df`` with ``split``: each row in one part, by the hash of its identifier; shares are made to sum to 1."""
    total, upto, out = sum(shares), 1.0, F.lit(names[-1])
    u = uniform(F.col(row_id), F.lit(0), seed)
    bounds = []
    upto = 0.0
    for s in shares[:-1]:
        upto += s / total
        bounds.append(round(upto, 6))
    for name, b in reversed(list(zip(names[:-1], bounds, strict=True))):
        out = F.when(u < b, name).otherwise(out)
    return df.withColumn("split", out)


def threshold_sample(df: DataFrame, max_bins: int, seed: int = 0, most: int = 10_000) -> DataFrame:
    """A Bernoulli sample of about max(max_bins**2, ``most``) rows by the hash of row_id, or all rows if there are no more."""
    n = df.count()
    want = min(max(max_bins**2, most), n)
    return df if want >= n else df.filter(uniform(F.col("row_id"), F.lit(3), seed) < want / n)


def bagging(df: DataFrame, trees: Sequence[int], mean: float | None = 1.0, seed: int = 0) -> DataFrame:
    """``df`` with ``weights`` array<tinyint>, one Poisson number per tree; weight 1 without a mean."""
    t = F.array(*map(F.lit, trees)).cast("array<int>")
    if mean is None:
        return df.withColumn("weights", F.transform(t, lambda x: F.lit(1).cast("tinyint")))
    u = F.transform(t, lambda x: uniform(F.col("row_id"), x, seed))
    return df.withColumn("weights", F.transform(u, lambda x: poisson(x, mean).cast("tinyint")))


def folds(df: DataFrame, k: int, seed: int = 0) -> list[tuple[DataFrame, DataFrame]]:
    """(training, validation) of each fold."""
    d = df.withColumn("__fold", F.floor(uniform(F.col("row_id"), F.lit(1), seed) * k))
    return [(d.filter(F.col("__fold") != i).drop("__fold"), d.filter(F.col("__fold") == i).drop("__fold")) for i in range(k)]


NODES = 1 << 31  # more than a tree's node numbers


def node_key(forest, tree, node):
    """A number of its own for every node of every tree."""
    return (forest * 1009 + tree) * NODES + node


def draw_features(key: int, n: int, k: int, seed: int = 0) -> list[int]:
    """k of n features without replacement, in the order drawn; all of them in order if k = n."""
    return draw_many(np.array([key], np.int64), n, k, seed)[0].tolist()


def draw_many(keys: np.ndarray, n: int, k: int, seed: int = 0) -> np.ndarray:
    """The draws of many nodes: one row of k features each."""
    if k >= n:
        return np.tile(np.arange(n), (len(keys), 1))
    u = uniform_array(keys[:, None], np.arange(n)[None, :], seed)
    return np.argsort(u, axis=1, kind="stable")[:, :k]


def feature_subset(nodes: DataFrame, n: int, k: int, seed: int = 0) -> DataFrame:
    """tree, node, feature, pos: the same draw as a query, for tables of nodes."""
    u = uniform(node_key(0, F.col("tree").cast("long"), F.col("node")), F.col("feature"), seed)
    w = Window.partitionBy("tree", "node").orderBy("u", "feature")
    out = nodes.select("tree", "node", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("feature")).withColumn("u", u)
    return out.withColumn("pos", F.row_number().over(w) - 1).filter(F.col("pos") < k).select("tree", "node", "feature", "pos")
