"""Votes and labels from node tables, without a shuffle."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grovelight.functions.expressions import level_py
from grovelight.operators.growth import Model, is_sparse
from grovelight.operators.level import dense
from grovelight.operators.rotation import turned


def tree_expression(model: Model, forest: int, tree: int, features: str = "features", max_depth: int = 1 << 30) -> Column:
    """Label that one tree gives, as nested conditions over the raw values (whole-stage code)."""

    def at(n: int) -> Column:
        v = model.nodes.get((forest, tree, n))
        if v is None:
            return F.lit(None).cast("int")
        kids = [(forest, tree, k) in model.nodes for k in (2 * n + 1, 2 * n + 2)]
        if not v.get("kind") or level_py(n) >= max_depth or not any(kids):
            return F.lit(v["label"])
        x = F.get(F.col(features), F.lit(v["feature"]))
        gone = x.isNull() | F.isnan(x)
        if v["kind"] == "missing":
            return F.when(gone, at(2 * n + 1)).otherwise(at(2 * n + 2))
        test = x.cast("int") == int(v["threshold"]) if v["kind"] == "category" else x <= v["threshold"]
        # a value missing where training met none stays at this node
        return F.when(gone, F.lit(v["label"])).when(test, at(2 * n + 1)).otherwise(at(2 * n + 2))

    return at(0)


def predict_compiled(df: DataFrame, model: Model, classes: int, forest: int = 0, trees: Sequence[int] | None = None, max_depth: int = 1 << 30) -> DataFrame:
    """``df`` with ``tree_labels``, ``votes`` and ``predicted``; meant for depths up to about 6."""
    trees = model.trees(forest) if trees is None else trees
    labels = F.array(*[tree_expression(model, forest, t, max_depth=max_depth) for t in trees])
    return voted(df.withColumn("tree_labels", labels), classes)


def voted(df: DataFrame, classes: int) -> DataFrame:
    """``votes``: array of votes per class; ``predicted``: the class with most, the lowest class on a tie. Negative labels do not vote."""
    votes = F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda c: F.size(F.filter("tree_labels", lambda x: x == c)))
    return df.withColumn("votes", votes).withColumn("predicted", (F.array_position(F.col("votes"), F.array_max("votes")) - 1).cast("int"))


def vote_details(votes: Column) -> Column:
    """array<struct<class, votes>> of the classes that have any."""
    return F.filter(F.transform(votes, lambda v, i: F.struct(i.alias("class"), v.alias("votes"))), lambda s: s["votes"] > 0)


def packed_trees(model: Model, forest: int, trees: Sequence[int]) -> list[tuple[np.ndarray, ...]]:
    """Node tables as arrays: kind, feature, threshold, left, right, label, level of each tree."""
    out = []
    for t in trees:
        keys = sorted(n for f, u, n in model.nodes if (f, u) == (forest, t))
        at = {n: i for i, n in enumerate(keys)}
        v = [model.nodes[forest, t, n] for n in keys]
        kind = np.array([{"le": 1, "category": 2, "missing": 3}.get(x.get("kind"), 0) for x in v], np.int8)
        left = np.array([at.get(2 * n + 1, -1) for n in keys])
        right = np.array([at.get(2 * n + 2, -1) for n in keys])
        kind[(left < 0) | (right < 0)] = 0
        out.append((kind, np.array([x.get("feature") or 0 for x in v]), np.array([x.get("threshold") or 0.0 for x in v]), left, right, np.array([x["label"] for x in v]), np.array([level_py(n) for n in keys])))
    return out


def walk_trees(packed: list[tuple[np.ndarray, ...]], x: np.ndarray, max_depth: int) -> np.ndarray:
    """One label per row and tree of the matrix x, missing values as NaN: all rows one level at a time."""
    out = np.empty((len(x), len(packed)), np.int32)
    for j, (kind, feature, threshold, left, right, label, level) in enumerate(packed):
        at, alive = np.zeros(len(x), np.int64), np.arange(len(x))
        while len(alive):
            n = at[alive]
            v = x[alive, feature[n]]
            gone = np.isnan(v)
            go = (kind[n] > 0) & (level[n] < max_depth) & ~(gone & (kind[n] != 3))
            n, v, gone, alive = n[go], v[go], gone[go], alive[go]
            with np.errstate(invalid="ignore"):
                is_left = np.where(kind[n] == 1, v <= threshold[n], np.where(kind[n] == 2, np.trunc(v) == threshold[n], gone))
            at[alive] = np.where(is_left, left[n], right[n])
        out[:, j] = label[at]
    return out


def predict(df: DataFrame, model: Model, classes: int, forest: int = 0, max_trees: int | None = None, max_depth: int = 1 << 30, features: str = "features", rotation: np.ndarray | None = None) -> DataFrame:
    """``df`` with ``tree_labels``, ``votes``, ``predicted``: whole batches walked through every tree, any depth, no shuffle.

    ``max_trees`` takes the first trees only, ``max_depth`` stops at that level, ``rotation`` turns the
    points first. Rows whose array is NULL or shorter than the model count as missing there. Sparse rows
    (idx, val) are looked up at the features that the trees test; what is not stored is 0.
    """
    trees = model.trees(forest)[:max_trees]
    packed = packed_trees(model, forest, trees)
    used = np.unique(np.concatenate([t[1][t[0] > 0] for t in packed] or [np.zeros(0, np.int64)])).astype(np.int64)  # features that any test looks at
    n = int(used.max(initial=0)) + 1 if rotation is None else len(rotation)
    shared = df.sparkSession.sparkContext.broadcast((packed, rotation, used))  # arrays of the model's size

    @F.arrow_udf("array<int>")
    def walk(col: Iterator[pa.Array]) -> Iterator[pa.Array]:
        packed, turn, _ = shared.value
        for c in col:
            x = dense(c, n)
            if turn is not None:
                x = turned(x, turn)
            yield labels_of(packed, x)

    @F.arrow_udf("array<int>")
    def walk_sparse(cols: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        packed, _, used = shared.value
        place = [(kind, np.searchsorted(used, feature), *rest) for kind, feature, *rest in packed]
        for idx, val in cols:
            lens = idx.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            row, f = np.repeat(np.arange(len(idx)), lens), idx.flatten().to_numpy(zero_copy_only=False)
            at = np.minimum(np.searchsorted(used, f), max(0, len(used) - 1))
            hit = used[at] == f if len(used) else np.zeros(len(f), bool)
            x = np.zeros((len(idx), max(1, len(used))))
            x[row[hit], at[hit]] = val.flatten().to_numpy(zero_copy_only=False).astype(np.float64)[hit]
            yield labels_of(place, x)

    def labels_of(trees_: list, x: np.ndarray) -> pa.Array:
        out = walk_trees(trees_, x, max_depth)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(trees_)), pa.array(out.ravel()))

    if is_sparse(df):
        return voted(df.withColumn("tree_labels", walk_sparse(F.col("idx").cast("array<int>"), F.col("val").cast("array<double>"))), classes)
    return voted(df.withColumn("tree_labels", walk(F.col(features).cast("array<double>"))), classes)


def aggregate_votes(parts: Sequence[DataFrame], classes: int) -> DataFrame:
    """row_id, votes, predicted: votes of several models over the same rows added up."""
    u = parts[0].select("row_id", "votes")
    for p in parts[1:]:
        u = u.unionByName(p.select("row_id", "votes"))
    sums = u.groupBy("row_id").agg(*[F.sum(F.get("votes", F.lit(c))).alias(f"v{c}") for c in range(classes)])
    votes = F.array(*[F.col(f"v{c}").cast("int") for c in range(classes)])
    return sums.select("row_id", votes.alias("votes")).withColumn("predicted", (F.array_position(F.col("votes"), F.array_max("votes")) - 1).cast("int"))


def accuracy(predicted: DataFrame) -> DataFrame:
    """rows, matches, accuracy over rows with a label."""
    ok = F.sum((F.col("label") == F.col("predicted")).cast("long"))
    return predicted.filter("label is not null").agg(F.count("*").alias("n_rows"), F.coalesce(ok, F.lit(0)).alias("matches"), F.round(ok / F.count("*"), 6).alias("accuracy"))


def confusion(predicted: DataFrame) -> DataFrame:
    return predicted.groupBy("label", "predicted").agg(F.count("*").alias("n"))
