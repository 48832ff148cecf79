"""Growing all trees of all forests level by level.

One query per level for all trees of all forests: every row, held once with its bins and its weight in
each tree, is walked to its nodes; each task adds up the histograms of the open nodes; their cells are
shuffled, added up and scored. The best splits, one row per open node, reach the driver and become part
of the model.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovelight.functions.expressions import level_py
from grovelight.operators.discretize import MAX
from grovelight.operators.level import BEST_DDL, PARTIAL_DDL, candidates, coarse, facts, partial, pick, prepare, rows_of, scored, slots_of, space, summed, trees_of, walked

ROWS_DDL = "label int, bins array<smallint>, weights array<tinyint>"
NODES_DDL = "forest int, tree int, node int, kind string, feature int, bin int, threshold double, label int, n bigint, is_leaf boolean, is_open boolean"
Key = tuple[int, int, int]


@dataclass
class Model:
    """Node tables of forests. kind: 'le' value <= threshold goes left, 'category' the category goes left, 'missing' a missing value goes left, None a leaf."""

    nodes: dict[Key, dict] = field(default_factory=dict)

    def rows(self) -> list[tuple]:
        return [(*k, v.get("kind"), v.get("feature"), v.get("bin"), v.get("threshold"), v["label"], v["n"], v.get("kind") is None, bool(v.get("open"))) for k, v in sorted(self.nodes.items())]

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows(), NODES_DDL)

    def trees(self, forest: int = 0) -> list[int]:
        return sorted({t for f, t, _ in self.nodes if f == forest})

    def merged(self, other: Model) -> Model:
        """Nodes of both; where both have a node, one that has a split stays."""
        out = dict(other.nodes)
        for k, v in self.nodes.items():
            if k not in out or v.get("kind") or not out[k].get("kind"):
                out[k] = v
        return Model(out)

    def open_nodes(self, max_depth: int) -> list[Key]:
        return [k for k, v in sorted(self.nodes.items()) if not v.get("kind") and v.get("open") and level_py(k[2]) < max_depth]

    def dump(self) -> str:
        """Indented text of every tree."""
        out = []
        for f, t in sorted({k[:2] for k in self.nodes}):
            out.append(f"forest {f} tree {t}")
            todo = [0]
            while todo:
                n = todo.pop()
                v = self.nodes.get((f, t, n))
                if v is None:
                    continue
                what = "LEAF" if not v.get("kind") else f"{v['kind']} feature {v['feature']} {v['threshold']}"
                out.append(f"{'  ' * level_py(n)}{n} {what} label {v['label']}")
                todo += [2 * n + 2, 2 * n + 1]
        return "\n".join(out)


@dataclass(frozen=True)
class Shape:
    """What the level loop needs to know about the data."""

    classes: int
    thresholds: dict[int, list[float]]
    categorical: dict[int, int]
    per_node: dict[int, int]  # candidates per forest
    coarse: dict[int, int]  # bin number per forest
    seed: int = 0

    @property
    def features(self) -> int:
        return len(self.thresholds)

    def fine(self, feature: int) -> int:
        return len(self.thresholds[feature]) + 1

    def threshold_of(self, forest: int, feature: int, b: int) -> float:
        """Real value of a cut at the forest's bin b: the upper edge of the last fine bin that is folded into it."""
        fine, coarse, t = self.fine(feature), self.coarse[forest], self.thresholds[feature]
        if fine > coarse:
            b = max(x for x in range(1, fine + 1) if min(coarse, max(1, int(x / (fine / coarse)))) <= b)
        return MAX if b > len(t) else t[b - 1]


def apply_split(model: Model, shape: Shape, s: dict, max_depth: int, inner: bool = False) -> list[Key]:
    """Adds a best split to the model; returns the children that stay open. inner: only the real cut below its test for missing values."""
    f, t, n = s["forest"], s["tree"], s["node"]
    if not inner:
        here = model.nodes.setdefault((f, t, n), {"label": s["all_label"], "n": s["all_n"], "ok": s["all_ok"]})
        here.update(label=s["all_label"], n=s["all_n"], open=False)
    kind = "category" if s["categorical"] else "le"
    b = s["bin"]
    value = float(b - 1) if s["categorical"] else shape.threshold_of(f, s["feature"], b) if b else 0.0
    real = {"kind": kind, "feature": s["feature"], "bin": b, "threshold": value}
    opened: list[Key] = []

    def child(node: int, side: str) -> None:
        closed = s[f"{side}_ok"] == s[f"{side}_n"] or level_py(node) + 1 > max_depth
        model.nodes[f, t, node] = {"label": s[f"{side}_label"], "n": s[f"{side}_n"], "open": not closed, "deep": level_py(node) + 1 > max_depth and s[f"{side}_ok"] != s[f"{side}_n"]}
        if not closed:
            opened.append((f, t, node))

    if inner:
        m = 2 * n + 2
        model.nodes[f, t, m].update(real)
        child(2 * m + 1, "left")
        child(2 * m + 2, "right")
        return opened
    both = s["left_n"] > 0 and s["right_n"] > 0
    if s["missing_n"] == 0:
        if both:
            here.update(real)
            child(2 * n + 1, "left")
            child(2 * n + 2, "right")
        return opened
    if s["left_n"] + s["right_n"] == 0:
        return opened
    # missing values go left; the others meet the real cut one level below
    here.update(kind="missing", feature=s["feature"], bin=0, threshold=0.0)
    child(2 * n + 1, "missing")
    m = 2 * n + 2
    side = "left" if s["left_n"] >= s["right_n"] else "right"
    model.nodes[f, t, m] = {"label": s[f"{side}_label"] if both else s["left_label"] if s["left_n"] else s["right_label"], "n": s["left_n"] + s["right_n"], "open": False}
    if both and level_py(m) + 1 <= max_depth:
        model.nodes[f, t, m].update(real)
        child(2 * m + 1, "left")
        child(2 * m + 2, "right")
    elif both:
        model.nodes[f, t, m]["later"] = s
    return opened


def reopened(model: Model, shape: Shape, forests: Sequence[int], trees: Sequence[int], max_depth: int) -> list[Key]:
    """Nodes that a smaller depth limit had closed, opened again; cuts that it had put off are made."""
    out: list[Key] = []
    for k, v in list(model.nodes.items()):
        if k[0] not in forests or k[1] not in trees:
            continue
        if v.pop("deep", False):
            v["open"] = True
            out.append(k)
        elif "later" in v and level_py(k[2]) + 1 <= max_depth:
            out += apply_split(model, shape, v.pop("later"), max_depth, inner=True)
    return out


def prepared(df: DataFrame, shape: Shape, trees: Sequence[int], mean: float | None = 1.0, seed: int = 0) -> DataFrame:
    """label, bins, weights of every row with a label among the classes: one row per record, whatever the number of trees.

    ``df``: row_id, label, features; or row_id, label, idx, val for sparse rows, which then keep ``idx``
    beside the bins of their stored values and never become dense.
    """
    ok = df.filter(F.col("label").between(0, shape.classes - 1))
    head = [F.col("row_id").cast("long").alias("row_id"), F.col("label").cast("int").alias("label")]
    run = prepare(shape, trees, mean, seed)
    if is_sparse(df):
        return ok.select(*head, F.col("idx").cast("array<int>").alias("idx"), F.col("val").cast("array<double>").alias("val")).mapInArrow(run, ROWS_DDL + ", idx array<int>")
    return ok.select(*head, F.col("features").cast("array<double>").alias("features")).mapInArrow(run, ROWS_DDL)


def is_sparse(df: DataFrame) -> bool:
    return "features" not in df.columns and {"idx", "val"} <= set(df.columns)


def by_tree(keys: Sequence[Key]) -> dict[tuple[int, int], np.ndarray]:
    out: dict[tuple[int, int], list[int]] = {}
    for f, t, n in keys:
        out.setdefault((f, t), []).append(n)
    return {k: np.array(sorted(v), np.int64) for k, v in out.items()}


def passes(shape: Shape, keys: Sequence[Key], memory: int, most: int = -1) -> list[list[Key]]:
    """Open nodes in groups whose histograms fit ``memory`` bytes in a task, of at most ``most`` nodes if that is given."""
    out: list[list[Key]] = [[]]
    used = 0
    for k in sorted(keys):
        size = 8 * space(shape, k[0]).cells
        if out[-1] and (used + size > memory or 0 < most <= len(out[-1])):
            out.append([])
            used = 0
        out[-1].append(k)
        used += size
    return out


def level_histograms(rows: DataFrame, model: Model, shape: Shape, trees: Sequence[int], keys: Sequence[Key]) -> DataFrame:
    """Partial histograms of open nodes (see level.PARTIAL), brought together and ordered by node.

    ``rows`` as :func:`prepared` gives them. Each row is walked from the root by the splits so far, so
    nothing is kept from level to level and a lost task is simply run again. What is shuffled is
    the cells of histograms that are not 0, added up per task; never rows.
    """
    frontier = by_tree(keys)
    run = partial(shape, trees, trees_of(model, set(frontier)), frontier)
    return rows.mapInArrow(run, PARTIAL_DDL).repartition("forest", "tree", "node").sortWithinPartitions("forest", "tree", "node")


def histogram_rows(rows: DataFrame, model: Model, shape: Shape, trees: Sequence[int], keys: Sequence[Key]) -> DataFrame:
    """forest, tree, node, feature, pos, categorical, bin, counts (weight per class) of the bins that have any."""
    schema = pa.schema([("forest", pa.int32()), ("tree", pa.int32()), ("node", pa.int32()), ("feature", pa.int32()), ("pos", pa.int32()), ("categorical", pa.bool_()), ("bin", pa.int32()), ("counts", pa.list_(pa.int64()))])

    def finish(forest: int, tree: np.ndarray, node: np.ndarray, h: np.ndarray) -> Iterator[pa.RecordBatch]:
        drawn, flags = candidates(shape, forest, tree, node)
        i, j, b = np.nonzero(h.sum(-1))
        cols = [np.full(len(i), forest), tree[i], node[i], drawn[i, j], j, flags[i, j], b]
        yield pa.RecordBatch.from_arrays([*(pa.array(c).cast(f.type) for c, f in zip(cols, schema, strict=False)), pa.array(list(h[i, j, b]), pa.list_(pa.int64()))], schema=schema)

    return level_histograms(rows, model, shape, trees, keys).mapInArrow(summed(shape, finish, schema), "forest int, tree int, node int, feature int, pos int, categorical boolean, bin int, counts array<bigint>")


def score_rows(rows: DataFrame, model: Model, shape: Shape, trees: Sequence[int], keys: Sequence[Key]) -> DataFrame:
    """Every possible cut of the open nodes with its score, counts and labels, as level.BEST has them for the best one."""
    from grovelight.operators.level import BEST

    def finish(forest: int, tree: np.ndarray, node: np.ndarray, h: np.ndarray) -> Iterator[pa.RecordBatch]:
        drawn, flags = candidates(shape, forest, tree, node)
        score, counts = scored(h, flags)
        i, j, b = np.nonzero(np.isfinite(score))
        found = {"forest": np.full(len(i), forest), "tree": tree[i], "node": node[i], "feature": drawn[i, j], "pos": j, "categorical": flags[i, j], "bin": b, "score": score[i, j, b], **facts(counts, i, j, b)}
        yield pa.RecordBatch.from_arrays([pa.array(found[f.name]).cast(f.type) for f in BEST], schema=BEST)

    return level_histograms(rows, model, shape, trees, keys).mapInArrow(summed(shape, finish, BEST), BEST_DDL)


def rows_at_nodes(rows: DataFrame, model: Model, shape: Shape, trees: Sequence[int], forests: Sequence[int] = (0,)) -> DataFrame:
    """forest, tree, node, n_rows, weight: how many rows end at each node of the model so far."""
    packed = trees_of(model, {(f, t) for f in forests for t in trees})
    schema = pa.schema([("forest", pa.int32()), ("tree", pa.int32()), ("node", pa.int32()), ("n_rows", pa.int64()), ("weight", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, fine, weights = rows_of(b, shape, len(trees))
            for forest in forests:
                bins = coarse(fine, shape, forest)
                for k, tree in enumerate(trees):
                    at = np.flatnonzero(weights[:, k])
                    node, of = np.unique(walked(packed[forest, tree], bins[at]), return_inverse=True)
                    cols = [np.full(len(node), forest), np.full(len(node), tree), node, np.bincount(of), np.bincount(of, weights[at, k])] if len(node) else [[]] * 5
                    yield pa.RecordBatch.from_arrays([pa.array(c).cast(f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    found = rows.mapInArrow(run, "forest int, tree int, node int, n_rows bigint, weight bigint")
    return found.groupBy("forest", "tree", "node").agg(F.sum("n_rows").alias("n_rows"), F.sum("weight").alias("weight"))


def level_splits(rows: DataFrame, model: Model, shape: Shape, trees: Sequence[int], keys: Sequence[Key], memory: int = 64 << 20, most: int = -1) -> list[dict]:
    """The best split of every open node that has rows: one row per node comes to the driver, as part of the model."""
    out: list[dict] = []
    for group in passes(shape, keys, memory, most):
        out += level_histograms(rows, model, shape, trees, group).mapInArrow(pick(shape), BEST_DDL).toArrow().to_pylist()
    return sorted(out, key=lambda s: (s["forest"], s["tree"], s["node"]))


def grow(rows: DataFrame, shape: Shape, trees: Sequence[int], frontier: Sequence[Key], max_depth: int, model: Model | None = None, min_depth: int = 0, keep: Callable[[dict, int], bool] | None = None, memory: int = 64 << 20, most: int = -1) -> tuple[Model, list[Key]]:
    """The grown model and the open nodes that were set aside: those for which ``keep(node, depth)`` is false."""
    model = model or Model()
    todo, aside, depth = list(frontier), [], min_depth
    while todo and depth < max_depth:
        if keep:
            small = [k for k in todo if not keep(model.nodes.get(k, {}), depth)]
            aside += small
            todo = sorted(set(todo) - set(small))
            if not todo:
                break
        # a child of a missing-value test may lie two levels down: it is worked on with the next level all the same
        todo = [k for s in level_splits(rows, model, shape, trees, todo, memory, most) for k in apply_split(model, shape, s, max_depth)]
        depth += 1
    return model, aside
