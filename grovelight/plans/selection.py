"""Queries of whole forests: missing values, resuming, saving, model selection, runs from a file; and their SQL."""

from __future__ import annotations

import tempfile
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovelight.functions import expressions as ex
from grovelight.operators import prediction as pr
from grovelight.operators import rotation as ro
from grovelight.operators import sampling as sa
from grovelight.operators import training
from grovelight.operators.growth import Model, Shape, grow, prepared
from grovelight.operators.local_growth import finish_locally
from grovelight.operators.trainer import Trainer
from grovelight.params import ForestParams
from grovelight.plans import forest_sql as q
from grovelight.plans.forest import _NODES_SQL, _VOTES_SQL, N, TURN, _nodes, _rows, _voted, core4, frame, grown4, shape4
from grovelight.sources import formats
from grovelight.sources.tables import shared_folder, temp_name

CATEGORIES = {5: 5, 6: 5}


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/{temp_name('model')}"


def _grown_missing(df: DataFrame, depth: int = 3) -> Model:
    """All seven features, three of which have missing values."""
    df = df.persist()
    t = training.fit_thresholds(df, q.BINS, N, sample=False)
    shape = Shape(q.CLASSES, {f: [] if f in CATEGORIES else t[f] for f in range(N)}, CATEGORIES, {0: 4}, {0: 1 << 20})
    rows, roots = _rows(df, shape)
    return grow(rows, shape, range(q.TREES), roots, depth)[0]


def grow_missing(spark, d):
    return _nodes(spark, _grown_missing(frame(spark, d)))


def predict_missing(spark, d):
    df = frame(spark, d)
    return _voted(pr.predict(df, _grown_missing(df), q.CLASSES))


def predict_missing_compiled(spark, d):
    """The votes of predict_missing by nested conditions."""
    df = frame(spark, d)
    return _voted(pr.predict_compiled(df, _grown_missing(df), q.CLASSES))


def tree_dump(spark, d):
    lines = _grown_missing(frame(spark, d)).dump().split("\n")
    return spark.createDataFrame(list(enumerate(lines)), "line_no long, line string")


def grow_resumed(spark, d):
    """Two levels, saved; loaded again and grown on from the open nodes of the saved table."""
    df = core4(spark, d).persist()
    shape = shape4(df, 2)
    rows, roots = _rows(df, shape)
    model, _ = grow(rows, shape, range(q.TREES), roots, 3, keep=lambda v, depth: depth < 2)
    at = _folder(spark)
    formats.save_model(model.table(spark), at)
    again = formats.load_model(spark, at)
    return _nodes(spark, grow(rows, shape, range(q.TREES), again.open_nodes(3), 3, again, 2)[0])


def grow_switched(spark, d):
    """One level over all partitions, the sub-trees below inside tasks."""
    df = core4(spark, d).persist()
    shape = shape4(df, 2)
    rows, roots = _rows(df, shape)
    model, aside = grow(rows, shape, range(q.TREES), roots, 3, keep=lambda v, depth: depth < 1)
    return _nodes(spark, finish_locally(rows, shape, range(q.TREES), aside, 3, model))


def open_nodes(spark, d):
    """Nodes that wait for a split after two of three levels."""
    df = core4(spark, d).persist()
    shape = shape4(df, 2)
    rows, roots = _rows(df, shape)
    model, _ = grow(rows, shape, range(q.TREES), roots, 3, keep=lambda v, depth: depth < 2)
    return spark.createDataFrame([k[1:] for k in model.open_nodes(3)], "tree int, node int")


def merged_trees(spark, d):
    """The upper levels of one model filled up from another that has all levels of some trees."""
    df = core4(spark, d).persist()
    whole, shape = grown4(df, 3, 2)
    upper = Model({k: ({**v} if ex.level_py(k[2]) < 2 else {c: v[c] for c in ("label", "n")}) for k, v in whole.nodes.items() if ex.level_py(k[2]) <= 2})
    return _nodes(spark, upper.merged(whole))


def model_round_trip(spark, d):
    df = core4(spark, d)
    at = _folder(spark)
    formats.save_trained(spark, training.Trained(grown4(df, 3, 2)[0], q.CLASSES), at)
    return _voted(formats.load_trained(spark, at).predict(df))


def rotated_votes(spark, d):
    """Trees on turned points, applied to points as they are. Whole numbers, so that sums agree in any order."""
    df = core4(spark, d).withColumn("features", F.transform("features", lambda v: F.floor(v).cast("double"))).persist()
    turn = np.array(TURN) * 2
    turned = ro.rotated(df, turn).persist()
    t = training.fit_thresholds(turned, q.BINS, 4, sample=False)
    shape = Shape(q.CLASSES, t, {}, {0: 2}, {0: 1 << 20})
    rows, roots = _rows(turned, shape)
    model, _ = grow(rows, shape, range(q.TREES), roots, 3)
    return _voted(pr.predict(df, model, q.CLASSES, rotation=turn))


# ---- training from parameters

STANDARD = ForestParams(num_features=N, num_classes=q.CLASSES, num_trees=10, depths=5, categorical=CATEGORIES)


def standard_forest(spark, d):
    """Train on 70 %, predict the rest."""
    s = sa.split(frame(spark, d))
    return _voted(training.train(s.filter("split = 'train'").drop("split"), STANDARD).predict(s.filter("split = 'test'")))


def train_from_file(spark, d):
    """A run from a file of parameters over a written data set: test rows and accuracy."""
    at = _folder(spark)
    frame(spark, d).write.parquet(f"{at}/data")
    with tempfile.TemporaryDirectory() as here:  # the file of parameters, which only the driver reads
        path = Path(here) / "run.properties"
        path.write_text(f"dataset={at}/data\nfileType=PARQUET\nnumFeatures={N}\nnumClasses=3\nnumTrees=10\nmaxDepth=5\ncategory=5:5,6:5\noutput={at}/out\n")
        Trainer.of_file(spark, path).run()
    return spark.read.csv(f"{at}/out/stats", header=True, schema="dataset string, n_test long, accuracy double").select("n_test", "accuracy")


GRID = ForestParams(num_features=N, num_classes=q.CLASSES, num_trees=(2, 4), depths=(1, 3), bin_numbers=(8, 16), multipliers=(1.0, 2.0), model_selection=True, epsilon=0.0, epsilon_remove=1.0, categorical=CATEGORIES, test_all=True)
TURNED = ForestParams(num_features=N, num_classes=q.CLASSES, num_trees=4, depths=3, rotation=True, num_rotations=2)
TURNED_GRID = ForestParams(num_features=N, num_classes=q.CLASSES, num_trees=(2, 4), depths=(3,), bin_numbers=(8, 16), epsilon=0.0, model_selection=True, rotation=True, num_rotations=2)
SCORES = "forest int, bins int, multiplier double, trees int, depth int, accuracy double"


def rotation_forest_votes(spark, d):
    """An ensemble over two drawn rotations, trained on 70 %, applied to the rest."""
    s = sa.split(frame(spark, d))
    return _voted(training.train(s.filter("split = 'train'").drop("split"), TURNED).predict(s.filter("split = 'test'")))


def rotated_thresholds(spark, d):
    """Cut points of turned features."""
    t = training.fit_thresholds(ro.rotated(core4(spark, d).withColumn("features", F.transform("features", lambda v: F.floor(v).cast("double"))), np.array(TURN) * 2), q.BINS, 4, sample=False)
    return spark.createDataFrame([(f, k, v) for f, x in t.items() for k, v in enumerate(x)], "feature int, pos int, threshold double")


def _selected(spark, d, test: bool = False) -> training.Selection:
    s = sa.split(frame(spark, d), (0.6, 0.2, 0.2), ("train", "check", "test")).persist()
    part = {x: s.filter(F.col("split") == x).drop("split") for x in ("train", "check", "test")}
    return training.select_model(part["train"], part["check"], GRID, part["test"] if test else None)


def grid_scores(spark, d):
    """Scores of model selection over bins x multiplier x trees x depth on the check part."""
    return spark.createDataFrame([tuple(x.values()) for x in _selected(spark, d).scores], SCORES)


def selection_tests(spark, d):
    """Every model of the grid on the test part."""
    return spark.createDataFrame([tuple(x.values()) for x in _selected(spark, d, True).tests], SCORES)


def prune_configs(spark, d):
    """What falls behind the best of its round by more than 0.02."""
    scores, out = _selected(spark, d).scores, []
    for n, depth in sorted({(s["trees"], s["depth"]) for s in scores}):
        part = [s for s in scores if (s["trees"], s["depth"]) == (n, depth)]
        gone = training.pruned(part, 0.02)
        out += [(s["forest"], n, depth, s["accuracy"], s["forest"] in gone) for s in part]
    return spark.createDataFrame(out, "forest int, trees int, depth int, accuracy double, skipped boolean")


def best_model(spark, d):
    b = _selected(spark, d).best
    return spark.createDataFrame([(b.forest, b.max_trees, b.max_depth)], "forest int, trees int, depth int")


def rotation_selection(spark, d):
    """A grid of ensembles over two rotations: scores on the check part."""
    s = sa.split(frame(spark, d), (0.6, 0.2, 0.2), ("train", "check", "test")).persist()
    got = training.select_model(s.filter("split = 'train'").drop("split"), s.filter("split = 'check'").drop("split"), TURNED_GRID)
    return spark.createDataFrame([tuple(x.values()) for x in got.scores], SCORES)


_FUNCS = (
    grow_missing, predict_missing, predict_missing_compiled, tree_dump, grow_resumed, grow_switched, open_nodes, merged_trees, model_round_trip, rotated_votes,
    standard_forest, rotation_forest_votes, rotated_thresholds, train_from_file, grid_scores, selection_tests, prune_configs, best_model, rotation_selection,
)
QUERIES = {f.__name__: f for f in _FUNCS}

_MISSING = "with " + q.forest(q.ALL, 3, 4, q.TREES)
_D3 = ", ".join([q.walked(3), q.voted()])
_TRAIN, _SAMPLE = ex.uniform_sql("row_id", "0"), ex.uniform_sql("row_id", "3")


def _cuts(where: str) -> str:
    return f"row_id in (select row_id from frame where {where} and {_SAMPLE} < cast(10000 as double) / (select count(*) from frame where {where}))"


def _standard(tail: str) -> str:
    fit = f"{_TRAIN} < 0.7"
    return "with " + ", ".join([q.forest(q.ALL, 5, 3, 10, fit, _cuts(fit), 32), q.walked(5, f"not ({fit})"), q.voted()]) + tail


def _grid(part: str) -> str:
    """Accuracy of every forest of the grid, at each depth and number of trees, on the rows of a part."""
    fit, out = f"{_TRAIN} < 0.6", []
    for f, b, m in GRID.grid():
        chain = ", ".join([q.forest(q.ALL, max(GRID.depths), {1.0: 3, 2.0: 6}[m], max(GRID.num_trees), fit, _cuts(fit), max(GRID.bin_numbers), b, f), q.walked(max(GRID.depths), part)])
        chain += ", " + q.ends(GRID.depths, GRID.num_trees)
        out.append(f"select {f} as forest, {b} as bins, cast({m} as double) as multiplier, cast(trees as int) as trees, cast(depth as int) as depth, round(avg(case when label = {q.winner()} then 1.0 else 0.0 end), 6) as accuracy from (with {chain} select * from votes) group by trees, depth")
    return " union all ".join(out)


def _turned_votes(fit: str, part: str, bins: int, coarse: int | None, number: int, counts: tuple[int, ...], most: int) -> str:
    """row_id, label, trees, v0.. of the rotations together; ``counts`` trees in all, ``most`` trees set the numbers of each rotation's trees."""
    out = []
    for r in range(TURNED.num_rotations):
        matrix = ro.rotation_matrix(N, TURNED.rotation_seed + r).tolist()
        own = [ro.trees_per_rotation(n, TURNED.num_rotations)[r] for n in counts]
        bags = f"bags as (select row_id, cast(t as int) as tree, 1 as w from (select row_id from frame where {fit}), (select unnest(range({max(own)})) as t))"
        chain = [q.turned(matrix, fit), q.long(q.ALL), q.thresholds(bins, q.ALL, _cuts(fit)), q.binned([], coarse), bags, q.grown(3, N, 3, max(own), number, r * most), q.walked(3, part), q.ends((3,), tuple(own))]
        pick = " ".join(f"when {o} then {n}" for o, n in zip(own, counts, strict=True))
        out.append(f"select row_id, label, case trees {pick} end as trees, v0, v1, v2 from (with {', '.join(chain)} select * from votes)")
    return "select row_id, label, trees, cast(sum(v0) as int) as v0, cast(sum(v1) as int) as v1, cast(sum(v2) as int) as v2 from (" + " union all ".join(out) + ") group by row_id, label, trees"


def _turned_grid() -> str:
    fit, out = f"{_TRAIN} < 0.6", []
    for f, b, m in TURNED_GRID.grid():
        votes = _turned_votes(fit, _CHECK, max(TURNED_GRID.bin_numbers), b, f, TURNED_GRID.num_trees, max(TURNED_GRID.num_trees))
        out.append(f"select {f} as forest, {b} as bins, cast({m} as double) as multiplier, cast(trees as int) as trees, 3 as depth, round(avg(case when label = {q.winner()} then 1.0 else 0.0 end), 6) as accuracy from ({votes}) group by trees")
    return " union all ".join(out)


_CHECK, _TEST = f"{_TRAIN} >= 0.6 and {_TRAIN} < 0.8", f"{_TRAIN} >= 0.8"
_TURNED = ", ".join([q.FRAME.replace("frame as (", "frame0 as ("), "frame as (select row_id, label, " + ", ".join("cast(" + " + ".join(f"({2 * m:.0f}) * floor(f{f})" for m, f in zip(row, q.CORE4, strict=True)) + f" as double) as f{i}" for i, row in enumerate(TURN)) + " from frame0)"])
_ROTATED = "with " + ", ".join([_TURNED, q.long([0, 1, 2, 3]), q.thresholds(q.BINS, [0, 1, 2, 3]), q.binned([]), q.bags(), q.grown(3, 4, 2), _D3])
_C4 = q.core4(3, 2, "", _NODES_SQL)
SQL = {
    "grow_missing": _MISSING + " " + _NODES_SQL,
    "predict_missing": _MISSING + ", " + _D3 + " " + _VOTES_SQL,
    "predict_missing_compiled": _MISSING + ", " + _D3 + " " + _VOTES_SQL,
    "tree_dump": _MISSING + ", " + q.dump() + " select line_no, line from f",
    "grow_resumed": _C4,
    "grow_switched": _C4,
    "merged_trees": _C4,
    "open_nodes": q.core4(3, 2, "", "select cast(tree as int) as tree, cast(node as int) as node from open2"),
    "model_round_trip": q.core4(3, 2, _D3, _VOTES_SQL),
    "rotated_votes": _ROTATED + " " + _VOTES_SQL,
    "standard_forest": _standard(" " + _VOTES_SQL),
    "rotation_forest_votes": f"select row_id, v0, v1, v2, cast({q.winner()} as int) as predicted from ({_turned_votes(f'{_TRAIN} < 0.7', f'not ({_TRAIN} < 0.7)', 32, None, 0, (4,), 4)})",
    "rotation_selection": _turned_grid(),
    "rotated_thresholds": "with " + ", ".join([_TURNED, q.long([0, 1, 2, 3]), q.thresholds(q.BINS, [0, 1, 2, 3])]) + " select feature, cast(row_number() over (partition by feature order by threshold) - 1 as int) as pos, threshold from thr",
    "train_from_file": _standard(" select count(*) as n_test, round(avg(case when label = predicted then 1.0 else 0.0 end), 6) as accuracy from won"),
    "grid_scores": _grid(_CHECK),
    "selection_tests": _grid(_TEST),
    "prune_configs": f"with g as ({_grid(_CHECK)}) select forest, trees, depth, accuracy, max(accuracy) over (partition by trees, depth) - accuracy > 0.02 as skipped from g",
    "best_model": f"with g as ({_grid(_CHECK)}) select forest, trees, depth from g order by accuracy desc, trees, depth, forest limit 1",
}
