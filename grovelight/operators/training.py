"""Training: standard, rotation, and model selection over a grid, with or without rotations."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from grovelight.operators import discretize as dz
from grovelight.operators import prediction as pr
from grovelight.operators import rotation as ro
from grovelight.operators import sampling as sa
from grovelight.operators.growth import Key, Model, Shape, grow, is_sparse, prepared, reopened
from grovelight.operators.local_growth import finish_locally
from grovelight.params import ForestParams, features_per_node, strategy_thresholds
from grovelight.sources.tables import cut


def fit_thresholds(df: DataFrame, bins: int, n: int, strategy: str = "distribution", seed: int = 0, sample: bool = True, sample_rows: int = 10_000) -> dict[int, list[float]]:
    """Thresholds of features 0..n-1 (at most bins - 1 each), from a sample by hash of about max(bins**2, sample_rows) rows, or from all rows."""
    some = sa.threshold_sample(df, bins, seed, sample_rows) if sample else df
    if is_sparse(df):
        if strategy.lower() != "distribution":
            raise ValueError("sparse rows take their thresholds from the distribution")
        t = dz.thresholds_by_distribution(cut(dz.sparse_value_counts(some)), bins)
    else:
        t = strategy_thresholds(strategy)(dz.to_long(some), bins, seed)
    got = {r.feature: list(r.thresholds) for r in t.collect()}  # one row per feature
    return {f: got.get(f, []) for f in range(n)}


@dataclass
class Trained:
    """A model with what is needed to apply it. A rotation ensemble has one part per rotation."""

    model: Model
    classes: int
    forest: int = 0
    max_depth: int = 1 << 30
    max_trees: int | None = None
    rotations: dict[int, np.ndarray] = field(default_factory=dict)
    spans: dict[int, tuple[float, float]] = field(default_factory=dict)
    parts: dict[int, Model] = field(default_factory=dict)
    dealt_over: int = 1  # rotations over which ``max_trees`` are dealt

    def predict(self, df: DataFrame) -> DataFrame:
        """``df`` with votes and predicted label. A rotation ensemble adds up the votes of its parts in the same row."""
        if not self.rotations:
            return pr.predict(df, self.model, self.classes, self.forest, self.max_trees, self.max_depth)
        d = ro.scale_arrays(df.withColumn("__raw", F.col("features")), self.spans)
        dealt, cols = ro.trees_per_rotation(self.max_trees or 1 << 30, self.dealt_over), []
        for r, m in self.parts.items():
            if k := min(dealt[r], len(m.trees(self.forest))):
                d = pr.predict(d, m, self.classes, self.forest, k, self.max_depth, rotation=self.rotations[r]).withColumn(f"__t{r}", F.col("tree_labels"))
                cols.append(f"__t{r}")
        d = pr.voted(d.withColumn("tree_labels", F.concat(*cols)), self.classes)
        return d.withColumn("features", F.col("__raw")).drop("__raw", *cols)

    def dump(self) -> str:
        return "\n".join(m.dump() for m in self.parts.values()) if self.parts else self.model.dump()


def shape_of(df: DataFrame, p: ForestParams) -> Shape:
    grid = p.grid()
    n = p.num_features
    thresholds = fit_thresholds(df, max(p.bin_numbers), n, p.split_strategy, p.seed, sample_rows=p.sample_rows)
    return Shape(p.num_classes, thresholds, dict(p.categorical), {i: features_per_node(p.feature_strategy, n, m) for i, _, m in grid}, {i: b for i, b, _ in grid}, p.seed)


def local_limit(p: ForestParams) -> int:
    """Rows of a node that one task may finish: those that fit the memory given, ``local_rows`` at most."""
    per_row = 8 * (p.num_features + 2) * 3  # arrays of a row while its sub-tree grows
    return max(1, min(p.local_rows, p.local_memory // per_row))


def stays_distributed(p: ForestParams, rows: int) -> Callable[[dict, int], bool]:
    """The planner's rule: whether a node is split over all partitions at a depth, or its sub-tree left to one task.

    Never local where it is switched off; from ``local_depth`` on where that is given; at once where it is
    forced; else as soon as a node's rows (its weight, which is no less) fit a task.
    """
    if not p.local_active:
        return lambda v, depth: True
    if p.local_force:
        return lambda v, depth: False
    if p.local_depth >= 0:
        return lambda v, depth: depth < p.local_depth
    limit = local_limit(p)
    return lambda v, depth: v.get("n", rows) > limit


def grow_to(rows: DataFrame, n: int, p: ForestParams, shape: Shape, trees: Sequence[int], frontier: Sequence[Key], depth: int, model: Model | None = None, min_depth: int = 0) -> Model:
    """Level by level while nodes are large, then sub-trees inside tasks. rows: see growth.prepared; n: their number."""
    model, aside = grow(rows, shape, trees, frontier, depth, model, min_depth, stays_distributed(p, n), most=p.max_nodes)
    return finish_locally(rows, shape, trees, aside, depth, model)


def usable(df: DataFrame) -> DataFrame:
    """row_id, label (from 0), features (or idx, val) of the rows with a label."""
    label = F.greatest(F.col("label"), F.lit(0)).cast("int")
    what = ["idx", "val"] if is_sparse(df) else [F.col("features").cast("array<double>").alias("features")]
    return df.filter(F.col("label").isNotNull() & ~F.isnan(F.col("label").cast("double"))).select("row_id", label.alias("label"), *what)


def train(df: DataFrame, params: ForestParams) -> Trained:
    """A forest on ``df`` (row_id, label 0.., features; or sparse idx, val). Rows with a NULL label are left out; an empty table raises.

    With ``model_selection`` the grid is scored on a fifth of the rows and the best model returned.
    """
    p = params.collapsed()
    df = usable(df).persist(StorageLevel.MEMORY_AND_DISK)
    if is_sparse(df):
        if p.rotation:
            raise ValueError("sparse rows cannot be rotated")
        p = replace(p, local_active=False)  # rows are not packed densely for one task
    try:
        if df.isEmpty():
            raise ValueError("no labelled rows to train on")
        if p.model_selection:
            d = sa.split(df, (0.8, 0.2), ("train", "check"), p.seed)
            return select_model(d.filter("split = 'train'"), d.filter("split = 'check'"), p).best
        spans = spans_of(df, p) if p.rotation else {}
        parts = [_Part(df, p, r, k, spans) for r, k in enumerate(ro.trees_per_rotation(max(p.num_trees), p.num_rotations)) if k] if p.rotation else [_Part(df, p, None, max(p.num_trees), spans)]
        for part in parts:
            part.grow_all(max(p.depths))
            part.close()
        return assembled(parts, p, spans, p.grid()[-1][0])
    finally:
        df.unpersist()


def spans_of(df: DataFrame, p: ForestParams) -> dict[int, tuple[float, float]]:
    spans = {r.feature: (r.lo, r.hi) for r in ro.minmax(dz.to_long(df)).collect()}  # one row per feature
    last = p.num_features - 1
    return spans | {last: spans.get(last, (0.0, 0.0))}


class _Part:
    """The trees of one rotation (or the only part of a forest) while they grow, for every forest of the grid."""

    def __init__(self, df: DataFrame, p: ForestParams, rotation: int | None, trees: int, spans: dict) -> None:
        self.p, self.rotation, self.trees = p, rotation, trees
        self.matrix = None
        if rotation is not None:
            self.matrix = ro.rotation_matrix(p.num_features, p.rotation_seed + rotation)
            df = ro.rotated(ro.scale_arrays(df, spans), self.matrix)
            p = self.p = p.plain()
        self.shape = shape_of(df, p)
        self.df = df
        self.model = Model()
        self.first = 0 if rotation is None else rotation * max(p.num_trees)
        self.rows: DataFrame | None = None
        self.own: list[int] = []
        self.n = 0

    def prepare(self, own: Sequence[int]) -> None:
        """Rows with the weights of some of the trees."""
        self.close()
        self.own = [self.first + t for t in own]
        self.rows = prepared(self.df, self.shape, self.own, self.p.poisson_mean, self.p.seed).persist(StorageLevel.MEMORY_AND_DISK)
        self.n = self.rows.count()

    def close(self) -> None:
        if self.rows is not None:
            self.rows.unpersist()
            self.rows = None

    def roots(self, forests: Sequence[int]) -> list[Key]:
        return [(f, t, 0) for f in forests for t in self.own]

    def grow_all(self, depth: int) -> None:
        self.prepare(range(self.trees))
        self.model = grow_to(self.rows, self.n, self.p, self.shape, self.own, self.roots([i for i, _, _ in self.p.grid()]), depth)

    def deepen(self, forests: Sequence[int], depth: int, before: int | None) -> None:
        """The prepared trees of the forests down to ``depth``; nodes that the depth before had closed are opened again."""
        todo = self.roots(forests) if before is None else reopened(self.model, self.shape, forests, self.own, depth)
        self.model = grow_to(self.rows, self.n, self.p, self.shape, self.own, todo, depth, self.model, before or 0)


def assembled(parts: Sequence[_Part], p: ForestParams, spans: dict, forest: int, depth: int = 1 << 30, trees: int | None = None) -> Trained:
    if parts[0].matrix is None:
        return Trained(parts[0].model, p.num_classes, forest, depth, trees)
    return Trained(Model(), p.num_classes, forest, depth, trees, {x.rotation: x.matrix for x in parts}, spans, {x.rotation: x.model for x in parts}, p.num_rotations)


@dataclass
class Selection:
    """The best model, every score on the check rows in order, and those of every model on the test rows."""

    best: Trained
    scores: list[dict]
    tests: list[dict] = field(default_factory=list)


def pruned(round_scores: Sequence[dict], epsilon_remove: float) -> set[int]:
    """Configurations that fall behind the round's best by more than ``epsilon_remove``."""
    top = max((s["accuracy"] for s in round_scores), default=0.0)
    return {s["forest"] for s in round_scores if top - s["accuracy"] > epsilon_remove}


def better(a: dict | None, b: dict) -> dict:
    """The score with the higher accuracy; the earlier one on a tie, inside a round the lower forest."""
    return b if a is None or b["accuracy"] > a["accuracy"] else a


def accuracies(models: Sequence[Trained], rows: DataFrame) -> list[float]:
    """Accuracy of each model, all in one pass over the rows."""
    d = rows
    for k, m in enumerate(models):
        d = m.predict(d).withColumnRenamed("predicted", f"__p{k}").drop("tree_labels", "votes")
    one = d.agg(*[F.round(F.avg((F.col("label") == F.col(f"__p{k}")).cast("int")), 6).alias(f"a{k}") for k in range(len(models))]).first()
    return [one[f"a{k}"] or 0.0 for k in range(len(models))]


def select_model(df: DataFrame, check: DataFrame, params: ForestParams, test: DataFrame | None = None) -> Selection:
    """The best of a grid of forests grown together, by accuracy on ``check``; every score; with ``test`` and ``test_all`` every model on the test rows.

    For each stage of trees the whole grid grows to each depth of the list in turn. A configuration
    that falls behind the round's best by more than epsilon_remove is skipped from then on; a stage
    stops deepening, and the stages end, when the best accuracy gains less than epsilon. With rotations
    every configuration is an ensemble over all of them, a stage's trees dealt over the rotations.
    """
    p = params
    d = usable(df).persist(StorageLevel.MEMORY_AND_DISK)
    checked = usable(check).persist(StorageLevel.MEMORY_AND_DISK)
    spans = spans_of(d, p) if p.rotation else {}
    most = ro.trees_per_rotation(max(p.num_trees), p.num_rotations) if p.rotation else [max(p.num_trees)]
    parts = [_Part(d, p, r if p.rotation else None, k, spans) for r, k in enumerate(most) if k]
    scores: list[dict] = []
    best: dict | None = None
    skipped: set[int] = set()
    had = [0] * len(parts)
    for n in p.num_trees:
        dealt = ro.trees_per_rotation(n, p.num_rotations) if p.rotation else [n]
        live = [i for i, _, _ in p.grid() if i not in skipped]
        busy = []
        for k, part in enumerate(parts):
            if dealt[k] > had[k]:
                part.prepare(range(had[k], dealt[k]))
                had[k] = dealt[k]
                busy.append(part)
        stage_best, before = best["accuracy"] if best else 0.0, None
        for depth in p.depths:
            live = [f for f in live if f not in skipped]
            for part in busy:
                part.deepen(live, depth, before)
            before = depth
            open_grid = [g for g in p.grid() if g[0] not in skipped]
            got = accuracies([assembled(parts, p, spans, f, depth, n) for f, _, _ in open_grid], checked)
            round_scores = [{"forest": f, "bins": b, "multiplier": m, "trees": n, "depth": depth, "accuracy": a} for (f, b, m), a in zip(open_grid, got, strict=True)]
            scores += round_scores
            skipped |= pruned(round_scores, p.epsilon_remove)
            last = best
            for s in round_scores:
                best = better(best, s)
            if last is not None and best["accuracy"] - last["accuracy"] < p.epsilon:
                break
        if best["accuracy"] - stage_best < p.epsilon:
            break
    tests = []
    if test is not None and p.test_all:
        grown = sorted({(s["forest"], s["bins"], s["multiplier"], s["trees"], s["depth"]) for s in scores})
        tested = usable(test).persist(StorageLevel.MEMORY_AND_DISK)
        got = accuracies([assembled(parts, p, spans, f, depth, n) for f, _, _, n, depth in grown], tested)
        tested.unpersist()
        tests = [{"forest": f, "bins": b, "multiplier": m, "trees": n, "depth": depth, "accuracy": a} for (f, b, m, n, depth), a in zip(grown, got, strict=True)]
    for x in parts:
        x.close()
    checked.unpersist()
    d.unpersist()
    return Selection(assembled(parts, p, spans, best["forest"], best["depth"], best["trees"]), scores, tests)
