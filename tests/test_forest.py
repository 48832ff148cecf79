import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from grovelight import params as pa
from grovelight.functions import expressions as ex
from grovelight.operators import discretize as dz
from grovelight.operators import prediction as pr
from grovelight.operators import rotation as ro
from grovelight.operators import sampling as sa
from grovelight.operators import level as lv
from grovelight.operators import training
from grovelight.operators.growth import Model, Shape, grow, passes, prepared, rows_at_nodes
from grovelight.operators.local_growth import finish_locally
from grovelight.operators.trainer import Trainer
from grovelight.sources import formats


def column(spark, expr, **cols):
    names = list(cols)
    rows = list(zip(*cols.values(), strict=True))
    return [r[0] for r in spark.createDataFrame(rows, names).select(expr).collect()]


def tens():
    return F.array(*[F.lit(float(x)) for x in (10, 20, 30, 40, 50)])


def test_bins_and_cuts(spark):
    v = [-25.0, 0.0, 10.0, 10.1, 20.0, 48.5, 50.0, 50.5, 150.5, None, float("nan")]
    assert column(spark, dz.to_bin(F.col("v"), tens()), v=v) == [1, 1, 1, 2, 2, 5, 5, 6, 6, 0, 0]
    assert column(spark, dz.to_bin(F.col("v"), tens(), F.lit(True)), v=[0.0, 3.0, None]) == [1, 4, 0]
    assert column(spark, dz.cut_value(F.col("v"), tens()), v=[-1, 1, 2, 3, 4, 5, 6, 64]) == [0.0, 10.0, 20.0, 30.0, 40.0, 50.0, dz.MAX, dz.MAX]
    assert column(spark, dz.bin_count(tens()), v=[1]) == [7]


def test_shrink_tables(spark):
    def table(b, fine, coarse):
        return column(spark, dz.shrink(F.col("b"), F.lit(fine), F.lit(coarse)), b=b)

    assert table([0, 1, 5], 5, 8) == [0, 1, 5]
    assert table([0, 1, 2, 3, 16, 31, 32], 32, 16) == [0, 1, 1, 1, 8, 15, 16]
    assert column(spark, dz.deshrink(F.col("b"), F.lit(32), F.lit(16)), b=[1, 2, 16]) == [2, 4, 32]
    # fixed values: bins beyond the range, and features of 4, 8 and 7 thresholds folded into 8 bins
    assert table([0, -1, 32, 33, 100], 32, 16) == [0, 1, 16, 16, 16]
    assert table([5, 4, 1, 0], 5, 8) == [5, 4, 1, 0]
    assert table([0, -1, 32, 33, 100], 9, 8) == [0, 1, 8, 8, 8]
    assert table([8, 7, 6, 2, 1], 8, 8) == [8, 7, 6, 2, 1]
    assert column(spark, dz.deshrink(F.col("b"), F.lit(32), F.lit(16)), b=[0, 32, 33, 100]) == [0, 32, 32, 32]
    assert column(spark, dz.deshrink(F.col("b"), F.lit(9), F.lit(8)), b=[0, 32, 33, 100]) == [0, 9, 9, 9]


def walk(values, bins):
    """Thresholds value by value, as the definition has it."""
    counts = sorted({v: values.count(v) for v in values}.items())
    if len(counts) <= bins:
        return [v for v, _ in counts[:-1]]
    stride = len(values) / bins
    target, before, out = stride, counts[0][1], []
    for (a, _), (_, n) in zip(counts, counts[1:], strict=False):
        now = before + n
        if abs(before - target) < abs(now - target):
            out.append(a)
            target += stride
        before = now
    return out


@pytest.mark.parametrize("seed", range(6))
def test_thresholds_follow_the_walk(spark, seed):
    r = random.Random(seed)
    data = {f: [float(r.choice([1, 1, 1, 2, 50, r.randrange(60), r.randrange(400)])) for _ in range(r.randrange(1, 300))] for f in range(4)}
    long = spark.createDataFrame([(f, v) for f, x in data.items() for v in x] + [(0, None), (9, 1.0)], "feature int, value double")
    counts = dz.value_counts(long).cache()
    for bins, buckets in ((2, None), (5, 7), (8, 3)):
        got = {r.feature: r.thresholds for r in dz.thresholds_by_distribution(counts, bins, buckets).collect()}
        assert got == {**{f: walk(x, bins) for f, x in data.items()}, 9: []}


def best(counts, categorical=False):
    h = np.array(counts)[None, None]
    return {k: v[0] for k, v in lv.best(h, np.zeros((1, 1), int), np.full((1, 1), categorical)).items()}


def test_best_split_examples():
    h = [(0, 0), (10, 0), (5, 0), (0, 20), (0, 0)]
    s = best(h)
    assert [s[x] for x in ("bin", "left_n", "left_ok", "left_label", "right_n", "right_ok", "right_label", "all_label", "missing_n")] == [2, 15, 15, 0, 20, 20, 1, 1, 0]
    s = best(h, True)
    assert [s[x] for x in ("bin", "left_n", "left_label", "right_n", "right_label")] == [3, 20, 1, 15, 0]
    s = best([(3, 5), (0, 0)])
    assert [s[x] for x in ("bin", "left_n", "right_n", "missing_n", "all_label", "score")] == [0, 0, 0, 8, 1, 0.0]


def test_heap_params_and_draws(tmp_path):
    assert [ex.level_py(n) for n in (0, 1, 2, 3, 6, 7)] == [0, 1, 1, 2, 2, 3]
    assert [pa.features_per_node(s, 25) for s in ("all", "sqrt", "sqrtsqrt", "log2", "onethird", 7)] == [25, 5, 3, 5, 9, 7]
    assert pa.features_per_node("sqrt", 25, 100.0) == 25
    assert pa.parse_remap("1:0,2:1,3:2,4:3") == {1: 0, 2: 1, 3: 2, 4: 3}
    assert pa.parse_arity("-1:4", 3) == {0: 4, 1: 4, 2: 4} and pa.parse_arity("1:4,3:5", 9) == {1: 4, 3: 5}
    p = pa.ForestParams(num_trees=(100, 50), depths=(5, 10), bin_numbers=(32, 16), model_selection=True)
    assert p.num_trees == (50, 100) and [g[1] for g in p.grid()] == [16, 32]
    assert pa.ForestParams(num_trees=(50, 100)).collapsed().num_trees == (100,)
    assert pa.doubling(8, 40) == [8, 16, 32] and pa.stepping(1, 7, 3) == [1, 4, 7]
    f = tmp_path / "p.properties"
    f.write_text("dataset=x.svm\nnumTrees=50,100 # two\nrotation=true\npoissonMean=0.5\nunknown=1\n")
    q = pa.from_file(f)
    assert (q.dataset, q.num_trees, q.rotation, q.poisson_mean) == ("x.svm", (50, 100), True, 0.5)
    f.write_text("numTrees=5\n")
    with pytest.raises(ValueError):
        pa.from_file(f)
    with pytest.raises(ValueError):
        pa.ForestParams(num_trees=())
    draws = [sa.draw_features(k, 16, 4) for k in range(2000)]
    assert all(len(set(x)) == 4 for x in draws)
    assert all(0.2 < sum(f in x for x in draws) / 2000 < 0.3 for f in range(16))


def test_poisson_weights(spark):
    w = sa.bagging(spark.range(5000).select(F.col("id").alias("row_id")), range(4))
    m = w.select(*[F.avg(F.get("weights", F.lit(t))).alias(f"t{t}") for t in range(4)]).first()
    assert all(abs(x - 1) < 0.06 for x in m)
    assert sa.bagging(w, [0], None).filter("weights[0] <> 1").count() == 0
    a, b = sa.folds(spark.range(100).select(F.col("id").alias("row_id")), 4)[0]
    assert a.count() + b.count() == 100 and 0 < b.count() < 60


def test_rotation(spark):
    m = ro.rotation_matrix(5, 3)
    assert np.allclose(m @ m.T, np.eye(5))
    a = np.random.default_rng(0).random((6, 6))
    q = ro.orthogonal(a)
    assert (np.diag(q.T @ a) > 0).all()
    x = np.random.default_rng(1).random((7, 20))
    for n in (5, 20):
        t = ro.rotation_matrix(n, 1)
        df = spark.createDataFrame([(i, r[:n].tolist()) for i, r in enumerate(x)], "row_id int, features array<double>")
        got = np.array([r.features for r in ro.rotated(df, t).orderBy("row_id").collect()])
        assert np.allclose(got, x[:, :n] @ t.T)
        assert np.allclose(np.linalg.norm(got, axis=1), np.linalg.norm(x[:, :n], axis=1))
    assert ro.trees_per_rotation(10, 4) == [3, 3, 2, 2]


def sample(spark, n=600, seed=2, missing=0.1):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        f = [r.gauss(0, 1), r.gauss(0, 1), float(r.randrange(4))]
        label = int(f[0] > 0.3) + int(f[2] == 2)
        f = [None if r.random() < missing else v for v in f]
        rows.append((i, label, f, "clash"))
    return spark.createDataFrame(rows, "row_id long, label int, features array<double>, votes string")


def test_levels_equal_local_growth_with_missing_values(spark):
    df = sample(spark)
    shape = Shape(3, training.fit_thresholds(df, 8, 3, sample=False) | {2: []}, {2: 4}, {0: 2, 1: 3}, {0: 8, 1: 4})
    rows = prepared(df, shape, range(3)).cache()
    roots = [(f, t, 0) for f in (0, 1) for t in range(3)]
    one, _ = grow(rows, shape, range(3), roots, 4)
    two = finish_locally(rows, shape, range(3), roots, 4)
    # several passes a level, as when histograms do not fit a task, and a switch to local growth on the way
    assert len(passes(shape, roots, 1)) == 6
    assert grow(rows, shape, range(3), roots, 4, memory=1)[0].nodes.keys() == one.nodes.keys()
    mixed, aside = grow(rows, shape, range(3), roots, 4, keep=lambda v, depth: depth < 2)
    assert aside and all(ex.level_py(n) >= 2 for _, _, n in aside)
    mixed = finish_locally(rows, shape, range(3), aside, 4, mixed)
    assert {k: v["n"] for k, v in mixed.nodes.items()} == {k: v["n"] for k, v in one.nodes.items()}
    at = rows_at_nodes(rows, one, shape, range(3), (0, 1)).collect()
    assert all(one.nodes[r.forest, r.tree, r.node]["n"] == r.weight for r in at)
    keep = ("kind", "feature", "bin", "threshold", "label", "n")
    assert {k: [v.get(x) for x in keep] for k, v in one.nodes.items()} == {k: [v.get(x) for x in keep] for k, v in two.nodes.items()}
    assert any(v.get("kind") == "missing" for v in one.nodes.values()) and any(v.get("kind") == "category" for v in one.nodes.values())
    a = pr.predict_compiled(df, one, 3).select("row_id", "tree_labels", "votes", "predicted").orderBy("row_id").collect()
    c = pr.predict(df, one, 3).select("row_id", "tree_labels", "votes", "predicted").orderBy("row_id").collect()
    assert a == c and all(sum(r.votes) == 3 for r in a)
    limited = pr.predict(df, one, 3, max_trees=2, max_depth=1).select("votes").collect()
    assert all(sum(r.votes) == 2 for r in limited)
    # every node's weight is the sum of its children's
    for (f, t, n), v in one.nodes.items():
        kids = [one.nodes.get((f, t, k)) for k in (2 * n + 1, 2 * n + 2)]
        if v.get("kind"):
            assert v["n"] == sum(k["n"] for k in kids)
    assert "LEAF" in one.dump()
    assert Model({**dict(list(one.nodes.items())[:3])}).merged(one).nodes.keys() == one.nodes.keys()


def test_training_learns(spark):
    df = sample(spark, 800, missing=0.02)
    p = pa.ForestParams(num_features=3, num_classes=3, num_trees=8, depths=6, categorical={2: 4}, feature_strategy="all", local_rows=200)
    t = training.train(df, p)
    assert pr.accuracy(t.predict(df)).first().accuracy > 0.93
    assert t.predict(df.limit(0)).count() == 0
    odd = spark.createDataFrame([(1, 0, None), (2, 0, [1.0]), (3, 0, [None, None, None])], "row_id long, label int, features array<double>")
    assert t.predict(odd).filter("predicted is null").count() == 0
    with pytest.raises(ValueError):
        training.train(df.limit(0), p)


def test_rotation_forest_and_selection(spark):
    df = sample(spark, 300, missing=0.0)
    r = training.train(df, pa.ForestParams(num_features=3, num_classes=3, num_trees=3, depths=4, rotation=True, num_rotations=2))
    out = r.predict(df)
    assert out.filter("size(tree_labels) = 3").count() == 300
    p = pa.ForestParams(num_features=3, num_classes=3, num_trees=(1, 2), depths=(1, 3), bin_numbers=(4, 8), model_selection=True, categorical={2: 4}, feature_strategy="all", test_all=True)
    s = training.select_model(df, df, p, df)
    assert {(x["trees"], x["depth"]) for x in s.scores} >= {(1, 1), (1, 3)}
    assert max(x["accuracy"] for x in s.scores) == pytest.approx(pr.accuracy(s.best.predict(df)).first().accuracy)
    # the check rows are the test rows here: every model has the score it had
    assert {tuple(x.values()) for x in s.tests} == {tuple(x.values()) for x in s.scores}
    # growing on gives what growing at once gives
    whole = training.train(df, pa.ForestParams(num_features=3, num_classes=3, num_trees=1, depths=3, bin_numbers=8, categorical={2: 4}, feature_strategy="all"))
    kept = {k[2]: v["n"] for k, v in s.best.model.nodes.items() if k[:2] == (1, 0)}
    assert kept == {k[2]: v["n"] for k, v in whole.model.nodes.items()}
    t = training.select_model(df, df, pa.ForestParams(num_features=3, num_classes=3, num_trees=(2, 4), depths=(2,), bin_numbers=(4, 8), model_selection=True, rotation=True, num_rotations=2, feature_strategy="all"))
    assert t.best.rotations.keys() == {0, 1} and max(x["accuracy"] for x in t.scores) == pytest.approx(pr.accuracy(t.best.predict(df)).first().accuracy)
    assert training.train(df, p).max_trees in (1, 2)


def test_pruning_and_best():
    s = [{"forest": 0, "accuracy": 0.7}, {"forest": 1, "accuracy": 0.95}, {"forest": 2, "accuracy": 0.95}, {"forest": 3, "accuracy": 0.9}]
    assert training.pruned(s, 0.1) == {0} and training.pruned(s, 1.0) == set() and training.pruned([], 0.5) == set()
    top = None
    for x in s:
        top = training.better(top, x)
    assert top["forest"] == 1


def test_switch_to_local_growth():
    def stays(**kw):
        return training.stays_distributed(pa.ForestParams(num_features=3, **kw), 10**6)

    assert stays(local_active=False)({"n": 1}, 9)
    assert not stays(local_force=True)({}, 0)
    assert stays(local_depth=2)({"n": 1}, 1) and not stays(local_depth=2)({"n": 10**9}, 2)
    assert stays()({}, 0) and stays()({"n": 20_001}, 3) and not stays()({"n": 20_000}, 3)
    assert training.local_limit(pa.ForestParams(num_features=10_000, local_memory=1 << 20)) == 4


def test_trainer_from_a_file(spark, tmp_path):
    df = sample(spark, 500, missing=0.0).withColumn("features", F.expr("transform(features, (v, i) -> if(i = 2, v + 1, v))"))
    formats.write_libsvm(df, str(tmp_path / "data"))
    f = tmp_path / "run.properties"
    f.write_text(f"dataset={tmp_path}/data\nnumFeatures=3\nnumClasses=3\nnumTrees=5\nmaxDepth=5\nstrategyFeature=all\ncategory=2:4|1:0,2:1,3:2,4:3\noutputTree=true\noutput={tmp_path}/out\n")
    t = Trainer.of_file(spark, f)
    assert t.params.categorical == {2: 4}
    rows = t.load()
    assert {r.c for r in rows.select(F.get("features", F.lit(2)).alias("c")).distinct().collect()} == {0.0, 1.0, 2.0, 3.0}
    assert rows.filter("features[0] = 0 or features[0] = 1").count() == 0  # only the categorical feature is remapped
    r = t.run()
    assert r.accuracy > 0.85 and r.n_test > 100 and "LEAF" in r.dump
    t.run()
    assert spark.read.option("header", True).csv(f"{tmp_path}/out/stats").count() == 2
    again = formats.load_trained(spark, f"{tmp_path}/out/model")
    assert pr.accuracy(again.predict(rows)).first() == pr.accuracy(r.model.predict(rows)).first()
    f.write_text(f.read_text() + "modelSelection=true\ntestAll=true\nrotation=true\nnumRotation=2\nnumTrees=2,4\nmaxDepth=2,4\n")
    s = Trainer.of_file(spark, f).run()
    assert s.model.rotations and len(s.tests) == len(s.scores)
    again = formats.load_trained(spark, f"{tmp_path}/out/model")
    assert again.predict(rows).select("votes").collect() == s.model.predict(rows).select("votes").collect()


def test_trainer_counts_features_and_may_skip_the_test(spark, tmp_path):
    df = sample(spark, 300, missing=0.0)
    formats.write_libsvm(df, str(tmp_path / "data"))
    line = F.concat_ws(",", *[F.get("features", F.lit(i)).cast("string") for i in range(3)], F.col("label").cast("string"))
    df.select(line.alias("value")).write.text(str(tmp_path / "arff"))
    df.write.parquet(str(tmp_path / "parquet"))
    for kind, at in (("SVM", "data"), ("ARFF", "arff"), ("CSV", "arff"), ("PARQUET", "parquet")):
        assert formats.count_features(spark, str(tmp_path / at), kind) == 3
    f = tmp_path / "run.properties"
    f.write_text(f"dataset={tmp_path}/data\nnumClasses=3\nnumTrees=3\nmaxDepth=4\nstrategyFeature=all\ncategory=-1:4\nskipAccuracy=true\nmaxNodesConcurrent=2\nfcsActive=false\n")
    t = Trainer.of_file(spark, f)
    r = t.run()
    assert t.params.num_features == 3 and t.params.categorical == {0: 4, 1: 4, 2: 4} and r.accuracy is None and "test" not in r.seconds
    assert [len(x) for x in passes(Shape(3, {0: [1.0]}, {}, {0: 1}, {0: 8}), [(0, 0, k) for k in range(5)], 1 << 30, 2)] == [2, 2, 1]


def test_extension_points(spark):
    pa.register_feature_strategy("half", lambda n: n / 2)
    pa.register_split_strategy("one", lambda long, bins, seed: long.select("feature").distinct().withColumn("thresholds", F.array(F.lit(0.3))))
    formats.register_reader("made", lambda spark, path, n, remap, categorical: sample(spark, 200, missing=0.0).select("row_id", "label", "features"))
    assert pa.features_per_node("half", 5) == 3
    r = Trainer(spark, pa.ForestParams(num_features=3, num_classes=3, num_trees=3, depths=4, feature_strategy="half", split_strategy="one", file_type="made", dataset="x")).run()
    assert {v["threshold"] for v in r.model.model.nodes.values() if v.get("kind")} <= {0.3, dz.MAX}


def test_wide_numbers(spark):
    ids = [2**62, -(2**62), 2**63 - 1, 0, 7]
    df = spark.createDataFrame([(i,) for i in ids], "row_id long")
    got = [r.u for r in df.select(ex.uniform(F.col("row_id"), F.lit(3), 1).alias("u")).collect()]
    assert got == [ex.uniform_py(i, 3, 1) for i in ids] and all(0 <= u < 1 for u in got)
    assert sa.split(df).count() == 5 and sa.bagging(df, range(3)).filter("size(weights) = 3").count() == 5
    assert len({ex.uniform_py(i, 0) for i in range(200_000)}) > 199_000
    assert sa.node_key(0, 0, 4099) != sa.node_key(0, 1, 0)
    with pytest.raises(ValueError):
        pa.ForestParams(depths=30)
    one = sa.threshold_sample(spark.range(50_000).select(F.col("id").alias("row_id")), 2)
    assert 9000 < one.count() < 11_000
    assert {r.row_id for r in sa.threshold_sample(spark.range(50_000).repartition(7).select(F.col("id").alias("row_id")), 2).collect()} == {r.row_id for r in one.collect()}


def test_expressions(spark):
    df = spark.createDataFrame([([1.0, 2.3, 0.0, None, 123.34],)], "v array<double>")
    s = ex.to_sparse(F.col("v"))
    r = df.select(ex.active_count(F.col("v")), ex.nonzero_count(F.col("v")), ex.element(s, 3, -100.0), ex.element(s, 1, -100.0), ex.to_dense(s, 5), ex.append_bias(F.col("v")), ex.log1p_exp(F.lit(800.0)), ex.keeps_sparse(F.lit(5), F.lit(87))).first()
    assert list(r) == [4, 3, -100.0, 2.3, [1.0, 2.3, None, None, 123.34], [1.0, 2.3, 0.0, None, 123.34, 1.0], 800.0, True]
    assert math.isclose(df.select(ex.entropy([F.lit(2), F.lit(2)])).first()[0], math.log(2))


def test_stock_forests_take_categories(spark):
    """A category that only a subset split tells apart."""
    from grovelight.operators import stock

    r = random.Random(1)
    rows = [(i, float(c in (1, 3)), [r.gauss(0, 1), float(c)]) for i in range(400) for c in [r.randrange(5)]]
    df = spark.createDataFrame(rows, "row_id long, label double, features array<double>")
    for impurity in ("gini", "entropy"):
        m = stock.train_classifier(df, trees=3, depth=1, impurity=impurity, strategy="all", num_features=2, categorical={1: 5})
        assert "in {" in m.toDebugString
        assert stock.predict(m, df).filter("label <> prediction").count() == 0
    m = stock.train_regressor(df, trees=3, depth=1, strategy="all", num_features=2, categorical={1: 5})
    assert stock.predict(m, df).filter("abs(label - prediction) > 0.01").count() == 0
    assert stock.from_ml(stock.to_ml(df)).select("features").collect() == df.select("features").collect()


def test_sparse_rows_give_the_trees_of_dense_ones(spark, tmp_path):
    r = random.Random(6)
    rows = []
    for i in range(500):
        x = [0.0] * 40
        for f in r.sample(range(40), 6):
            x[f] = float(r.randrange(1, 9))
        x[7] = float(r.choice([0, 0, 1, 2, 3]))
        rows.append((i, int(x[3] > 0) + int(x[7] == 2), x))
    dense = spark.createDataFrame(rows, "row_id long, label int, features array<double>")
    stored = F.filter(F.transform("features", lambda v, i: F.struct(i.alias("i"), v.alias("v"))), lambda s: s["v"] != 0)
    sparse = dense.select("row_id", "label", F.transform(stored, lambda s: s["i"]).alias("idx"), F.transform(stored, lambda s: s["v"]).alias("val"))
    p = pa.ForestParams(num_features=40, num_classes=3, num_trees=4, depths=5, bin_numbers=8, feature_strategy="onethird", categorical={7: 4}, local_active=False)
    a, b = training.train(dense, p), training.train(sparse, p)
    keep = ("kind", "feature", "bin", "threshold", "label", "n")
    assert {k: [v.get(x) for x in keep] for k, v in a.model.nodes.items()} == {k: [v.get(x) for x in keep] for k, v in b.model.nodes.items()}
    one = a.predict(dense).select("row_id", "votes").orderBy("row_id").collect()
    assert one == b.predict(sparse).select("row_id", "votes").orderBy("row_id").collect()
    grid = Shape(3, {f: [1.0, 2.0, 3.0, 4.0] for f in range(40)} | {7: []}, {7: 4}, {0: 13, 1: 13}, {0: 5, 1: 2})
    rows_ = [prepared(d, grid, range(2)).cache() for d in (dense, sparse)]
    m = [grow(x, grid, range(2), [(f, t, 0) for f in (0, 1) for t in range(2)], 3)[0] for x in rows_]
    assert m[0].nodes == m[1].nodes
    formats.write_libsvm(dense, str(tmp_path / "d"))
    q = pa.ForestParams(num_features=40, num_classes=3, num_trees=6, depths=6, feature_strategy="onethird", sparse=True, dataset=str(tmp_path / "d"), file_type="SVM")
    t = Trainer(spark, q)
    assert t.load().columns == ["row_id", "label", "idx", "val"] and t.run().accuracy > 0.6
    empty = spark.createDataFrame([(1, 0, [], []), (2, 0, None, None)], "row_id long, label int, idx array<int>, val array<double>")
    assert b.predict(empty).filter("predicted is null").count() == 0


def test_bags_of_arrays_equal_those_of_columns(spark):
    ids = [0, 1, 2**61, -5, 99999]
    df = spark.createDataFrame([(i,) for i in ids], "row_id long")
    got = [r.weights for r in sa.bagging(df, [0, 3, 7], 0.7, 4).collect()]
    assert lv.bag_weights(np.array(ids), [0, 3, 7], 0.7, 4).tolist() == [list(w) for w in got]
