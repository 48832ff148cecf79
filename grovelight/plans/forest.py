"""Forest queries: each operator over the order table, end-to-end forests, and their SQL."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovelight.functions import expressions as ex
from grovelight.operators import discretize as dz
from grovelight.operators import prediction as pr
from grovelight.operators import rotation as ro
from grovelight.operators import sampling as sa
from grovelight.operators import stock, training
from grovelight.operators.growth import Model, Shape, grow, histogram_rows, level_splits, prepared, rows_at_nodes, score_rows
from grovelight.operators.local_growth import finish_locally
from grovelight.params import ForestParams, features_per_node
from grovelight.plans import forest_sql as q
from grovelight.sources import formats
from grovelight.sources.tables import cut, table

N = 7
NAMES = ["total_price", "acct_bal", "sum_qty", "avg_disc", "n_lines", "priority", "segment"]


def frame(spark: SparkSession, d: str) -> DataFrame:
    """row_id, label, features of every order; NULL where an order has no line."""
    a = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").cast("double").alias("n_lines"))
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(a, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    v = F.col("o_totalprice") + 20 * F.col("c_acctbal")
    seg = F.create_map(*[F.lit(x) for i, s in enumerate(q.SEGMENTS) for x in (s, float(i))])
    feats = [F.col("o_totalprice"), F.col("c_acctbal"), F.col("sum_qty"), F.col("avg_disc"), F.col("n_lines"), (F.substring("o_orderpriority", 1, 1).cast("int") - 1).cast("double"), F.try_element_at(seg, F.col("c_mktsegment"))]
    return o.select(F.col("o_orderkey").alias("row_id"), F.when(v <= 165000, 0).when(v <= 331000, 1).otherwise(2).cast("int").alias("label"), F.array(*feats).alias("features"))


def core4(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d).withColumn("features", F.array(*[F.get("features", F.lit(i)) for i in q.CORE4]))


def shape4(df: DataFrame, k: int) -> Shape:
    t = training.fit_thresholds(df, q.BINS, 4, sample=False)
    return Shape(q.CLASSES, {0: t[0], 1: t[1], 2: [], 3: []}, {2: 5, 3: 5}, {0: k}, {0: 1 << 20})


def _rows(df: DataFrame, shape: Shape, trees: int = q.TREES) -> tuple[DataFrame, list]:
    """Rows ready for growth, computed once, and the roots."""
    return prepared(df, shape, range(trees)).persist(), [(0, t, 0) for t in range(trees)]


def grown4(df: DataFrame, depth: int, k: int, trees: int = q.TREES) -> tuple[Model, Shape]:
    df = df.persist()
    shape = shape4(df, k)
    rows, roots = _rows(df, shape, trees)
    model, _ = grow(rows, shape, range(trees), roots, depth)
    rows.unpersist()
    return model, shape


def feature_frame(spark, d):
    return frame(spark, d).select("row_id", "label", *[F.get("features", F.lit(i)).alias(n) for i, n in enumerate(NAMES)])


def features_long(spark, d):
    return dz.to_long(frame(spark, d)).select("row_id", "feature", "value")


def split_counts(spark, d):
    f = frame(spark, d)
    two = sa.split(f).groupBy("split").agg(F.count("*").alias("n")).withColumn("plan", F.lit("standard"))
    three = sa.split(f, (0.6, 0.2, 0.2), ("train", "check", "test")).groupBy("split").agg(F.count("*").alias("n")).withColumn("plan", F.lit("selection"))
    return two.unionByName(three).select("plan", "split", "n")


def kfold_counts(spark, d):
    f = frame(spark, d)
    parts = [v.select(F.lit(i).alias("fold")) for i, (_, v) in enumerate(sa.folds(f, 4))]
    return reduce(DataFrame.unionByName, parts).groupBy("fold").agg(F.count("*").alias("n"))


def minmax_per_feature(spark, d):
    return ro.minmax(dz.to_long(frame(spark, d)))


def scaled_features(spark, d):
    long = dz.to_long(frame(spark, d))
    return ro.scaled(long, ro.minmax(long)).select("row_id", "feature", F.round("value", 6).alias("value"))


def distinct_value_counts(spark, d):
    return dz.value_counts(dz.to_long(frame(spark, d)))


def _thresholds(spark, d, bins):
    return dz.thresholds_by_distribution(cut(dz.value_counts(dz.to_long(frame(spark, d)).filter("feature < 5"))), bins)


def thresholds_distribution(spark, d):
    t = _thresholds(spark, d, q.BINS)
    return t.select("feature", F.posexplode("thresholds").alias("pos", "threshold"))


def thresholds_random(spark, d):
    return dz.thresholds_at_random(dz.to_long(frame(spark, d)), q.BINS).select("feature", F.posexplode("thresholds").alias("pos", "threshold")).select("feature", "pos", F.round("threshold", 6).alias("threshold"))


def _bins(spark, d):
    f = frame(spark, d)
    return dz.binned(f, training.fit_thresholds(f, q.BINS, N, sample=False), {5: 5, 6: 5})


def bin_values(spark, d):
    return _bins(spark, d).select("row_id", F.posexplode("bins").alias("feature", "b")).select("row_id", "feature", F.col("b").cast("int").alias("bin"))


def bin_histogram(spark, d):
    return bin_values(spark, d).groupBy("feature", "bin").agg(F.count("*").alias("n"))


def cut_values(spark, d):
    t = _thresholds(spark, d, q.BINS)
    e = t.select("feature", "thresholds", F.explode(F.sequence(F.lit(-1), F.size("thresholds") + 1)).alias("cut"))
    return e.select("feature", "cut", dz.cut_value(F.col("cut"), F.col("thresholds")).alias("value"), (F.size("thresholds") + 2).alias("n_bins"))


def _bin_grid(spark):
    return spark.range(65).select(F.col("id").cast("int").alias("b")).select("b", F.explode(F.array(*map(F.lit, (4, 8, 7, 32, 64)))).alias("fine")).select("*", F.explode(F.array(*map(F.lit, (4, 8, 16, 32)))).alias("coarse")).filter("b <= fine")


def bin_shrink(spark, d):
    return _bin_grid(spark).select("b", "fine", "coarse", dz.shrink(F.col("b"), F.col("fine"), F.col("coarse")).alias("shrunk"))


def bin_deshrink(spark, d):
    return _bin_grid(spark).filter("b <= coarse").select("b", "fine", "coarse", dz.deshrink(F.col("b"), F.col("fine"), F.col("coarse")).alias("restored"))


def bagging_weights(spark, d):
    w = sa.bagging(frame(spark, d), range(q.TREES))
    return w.select(F.posexplode("weights").alias("tree", "w")).groupBy("tree", F.col("w").cast("int").alias("w")).agg(F.count("*").alias("n"))


def feature_subset(spark, d):
    nodes = spark.range(8).select(F.col("id").cast("int").alias("tree")).select("tree", F.explode(F.sequence(F.lit(0), F.lit(14))).alias("node"))
    return sa.feature_subset(nodes, N, features_per_node("sqrt", N))


def feature_strategies(spark, d):
    rows = [(str(s), n, m, features_per_node(s, n, m)) for s in ("all", "sqrt", "sqrtsqrt", "log2", "onethird", 7) for n in (2, 7, 25, 54, 1000) for m in (1.0, 2.0)]
    return spark.createDataFrame(rows, "strategy string, n int, multiplier double, k int")


def heap_nodes(spark, d):
    n = F.col("id").cast("int")
    return spark.range(1000).select(n.alias("node"), ex.left_child(n).alias("left_child"), ex.right_child(n).alias("right_child"), ex.parent(n).alias("parent"), ex.level(n).alias("level"))


def vectors(spark, d):
    v = F.col("v")
    s = ex.to_sparse(v)
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.when(x > 0, F.round(x.cast("double"), 3)).otherwise(0.0)).alias("v"))
    return e.select(
        "vec_id", ex.active_count(v).alias("active"), ex.nonzero_count(v).alias("nonzero"), ex.keeps_sparse(ex.nonzero_count(v), F.size(v)).alias("sparse"),
        ex.element(s, 3, -100.0).alias("at3"), F.round(ex.squared_distance(ex.to_dense(s, 64, 0.0), ex.append_bias(F.slice(v, 2, 63))), 6).alias("distance"), F.round(ex.log1p_exp(F.get(v, F.lit(0))), 6).alias("softplus"),
    )


def _root(spark, d, features):
    """Rows, shape and roots over some features of the whole frame, all of them candidates in the order given."""
    f = frame(spark, d).withColumn("features", F.array(*[F.get("features", F.lit(i)) for i in features])).persist()
    t = training.fit_thresholds(f, q.BINS, len(features), sample=False)
    cat = {k: 5 for k, i in enumerate(features) if i >= 5}
    shape = Shape(q.CLASSES, {k: [] if k in cat else v for k, v in t.items()}, cat, {0: len(features)}, {0: 1 << 20})
    return *_rows(f, shape), shape, F.element_at(F.array(*map(F.lit, features)), F.col("feature") + 1).alias("feature")


def _histogram(spark, d, features):
    rows, roots, shape, feature = _root(spark, d, features)
    h = histogram_rows(rows, Model(), shape, range(q.TREES), roots)
    return h.select("tree", "node", feature, "bin", *[F.get("counts", F.lit(k)).alias(f"c{k}") for k in range(q.CLASSES)])


def node_histogram_query(spark, d):
    return _histogram(spark, d, range(N))


def node_entropy(spark, d):
    h = _histogram(spark, d, [0]).groupBy("tree").agg(*[F.sum(f"c{k}").alias(f"c{k}") for k in range(q.CLASSES)])
    c = [F.col(f"c{k}") for k in range(q.CLASSES)]
    return h.select("tree", F.round(ex.entropy(c), 6).alias("entropy"), ex.majority(c).alias("label"))


_SPLIT = ["tree", "feature", "bin", "left_n", "left_label", "left_ok", "right_n", "right_label", "right_ok", "missing_n", "all_label"]
_SPLIT_DDL = "tree int, feature int, bin int, left_n bigint, left_label int, left_ok bigint, right_n bigint, right_label int, right_ok bigint, missing_n bigint, all_label int, score double"


def _best(spark, d, features):
    rows, roots, shape, _ = _root(spark, d, features)
    s = level_splits(rows, Model(), shape, range(q.TREES), roots)
    return spark.createDataFrame([(*[features[x[c]] if c == "feature" else x[c] for c in _SPLIT], round(x["score"], 6)) for x in s], _SPLIT_DDL)


def best_split_continuous(spark, d):
    return _best(spark, d, [0, 1])


def best_split_missing(spark, d):
    return _best(spark, d, [2, 3, 4])


def best_split_categorical(spark, d):
    return _best(spark, d, [5, 6])


def split_candidates(spark, d):
    rows, roots, shape, feature = _root(spark, d, range(N))
    s = score_rows(rows, Model(), shape, range(q.TREES), roots).filter("bin > 0")
    return s.select("tree", feature, "bin", "left_n", "right_n", "missing_n", F.round("score", 6).alias("score"))


def majority_label(spark, d):
    c = [F.col(f"c{k}") for k in range(q.CLASSES)]
    return _histogram(spark, d, range(N)).select("tree", "feature", "bin", ex.majority(c).alias("label"), F.greatest(*c).alias("ok"))


def route_rows(spark, d):
    df = core4(spark, d)
    model, shape = grown4(df, 1, 4)
    return rows_at_nodes(prepared(df, shape, range(q.TREES)), model, shape, range(q.TREES)).select("tree", "node", "n_rows", "weight")


def _nodes(spark, model):
    return model.table(spark).select("tree", "node", "label", "n", F.coalesce("feature", F.lit(-1)).alias("feature"), F.coalesce("bin", F.lit(-1)).alias("bin"))


def grow_depth2(spark, d):
    return _nodes(spark, grown4(core4(spark, d), 2, 2)[0])


def grow_depth3(spark, d):
    return _nodes(spark, grown4(core4(spark, d), 3, 2)[0])


def subtree_local(spark, d):
    """The trees of grow_depth3, grown inside one task per tree."""
    df = core4(spark, d).persist()
    shape = shape4(df, 2)
    rows, roots = _rows(df, shape)
    return _nodes(spark, finish_locally(rows, shape, range(q.TREES), roots, 3))


def _predicted(spark, d, depth=3, trees=None):
    df = core4(spark, d)
    return pr.predict_compiled(df, grown4(df, 3, 2)[0], q.CLASSES, trees=trees, max_depth=depth)


def _voted(p):
    return p.select("row_id", *[F.get("votes", F.lit(c)).alias(f"v{c}") for c in range(q.CLASSES)], "predicted")


def predict_votes(spark, d):
    return _voted(_predicted(spark, d))


def predict_batches(spark, d):
    """The votes of predict_votes by the walk over packed trees."""
    df = core4(spark, d)
    return _voted(pr.predict(df, grown4(df, 3, 2)[0], q.CLASSES))


def predict_limited(spark, d):
    return _voted(_predicted(spark, d, depth=1, trees=[0, 1]))


def accuracy(spark, d):
    return pr.accuracy(_predicted(spark, d))


def confusion(spark, d):
    return pr.confusion(_predicted(spark, d))


def vote_details(spark, d):
    return _predicted(spark, d).select("row_id", F.explode(pr.vote_details(F.col("votes"))).alias("v")).select("row_id", F.col("v.class").alias("class"), F.col("v.votes").alias("votes"))


def ensemble_aggregate(spark, d):
    df = core4(spark, d)
    m = grown4(df, 3, 2)[0]
    parts = [pr.predict_compiled(df, m, q.CLASSES, trees=[t]) for t in range(q.TREES)]
    return _voted(pr.aggregate_votes(parts, q.CLASSES))


TURN = [[0.5, 0.5, 0.5, 0.5], [0.5, -0.5, 0.5, -0.5], [0.5, 0.5, -0.5, -0.5], [0.5, -0.5, -0.5, 0.5]]


def rotate_features(spark, d):
    r = ro.rotated(core4(spark, d), np.array(TURN))
    return r.select("row_id", *[F.round(F.get("features", F.lit(i)), 6).alias(f"y{i}") for i in range(4)])


def _trained_votes(t, df, classes=q.CLASSES):
    return t.predict(df).select("row_id", "label", *[F.get("votes", F.lit(c)).alias(f"v{c}") for c in range(classes)], "predicted")


def _libsvm_lines(spark, d):
    f = frame(spark, d)
    return f.select("row_id", F.trim(formats.format_libsvm(F.col("label") - 1, F.transform("features", lambda v: F.floor(v)))).alias("value"))


def libsvm_format(spark, d):
    return _libsvm_lines(spark, d).select("row_id", F.col("value").alias("line"))


def libsvm_parse(spark, d):
    p = formats.parse_libsvm(_libsvm_lines(spark, d))
    return p.select("row_id", "label", F.size("idx").alias("n_entries"), F.array_max("idx").alias("max_idx"), F.aggregate("val", F.lit(0.0), lambda s, v: s + v).alias("total"))


def arff_parse(spark, d):
    f = frame(spark, d)
    line = f.select("row_id", F.concat_ws(",", *[F.coalesce(F.floor(F.get("features", F.lit(i))).cast("string"), F.lit("?")) for i in range(N)], F.col("label").cast("string")).alias("value"))
    p = formats.parse_arff(line)
    return p.select("row_id", "label", F.size("features").alias("n_values"), F.size(F.filter("features", lambda v: v.isNull())).alias("n_missing"), F.get("features", F.lit(0)).alias("first"))


def feature_count(spark, d):
    return formats.feature_count(formats.parse_libsvm(_libsvm_lines(spark, d)))


def embedding_forest(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), "label", F.col("embedding").cast("array<double>").alias("features"))
    s = sa.split(e)
    t = training.train(s.filter("split = 'train'").drop("split"), ForestParams(num_features=64, num_classes=10, num_trees=5, depths=6))
    return _trained_votes(t, s.filter("split = 'test'"), 10)


def stock_classifier(spark, d):
    f = core4(spark, d)
    return stock.predict(stock.train_classifier(f, trees=5, depth=4, num_features=4, categorical={2: 5, 3: 5}), f)


def stock_regressor(spark, d):
    f = core4(spark, d).withColumn("label", F.get("features", F.lit(0)) / 1000)
    return stock.predict(stock.train_regressor(f, trees=5, depth=4, num_features=4, categorical={2: 5, 3: 5}), f)


_FUNCS = (
    feature_frame, features_long, split_counts, kfold_counts, minmax_per_feature, scaled_features, distinct_value_counts, thresholds_distribution, thresholds_random,
    bin_values, bin_histogram, cut_values, bin_shrink, bin_deshrink, bagging_weights, feature_subset, feature_strategies, heap_nodes, vectors, node_entropy,
    best_split_continuous, best_split_missing, best_split_categorical, split_candidates, majority_label, route_rows, grow_depth2, grow_depth3, subtree_local,
    predict_votes, predict_batches, predict_limited, accuracy, confusion, vote_details, ensemble_aggregate, rotate_features,
    libsvm_format, libsvm_parse, arff_parse, feature_count, embedding_forest, stock_classifier, stock_regressor,
)
QUERIES = {f.__name__: f for f in _FUNCS} | {"node_histogram": node_histogram_query}

ALL = list(range(N))
_W = f"with {q.FRAME}, "
_LONG = _W + q.long(ALL)
_BINNED = _LONG + ", " + q.thresholds(q.BINS, [0, 1, 2, 3, 4]) + ", " + q.binned([5, 6])
_U = ex.uniform_sql("row_id", "0")
_GRID = "g as (select cast(b as int) as b, cast(fine as int) as fine, cast(coarse as int) as coarse from (select unnest(range(65)) as b), (select unnest([4, 8, 7, 32, 64]) as fine), (select unnest([4, 8, 16, 32]) as coarse) where b <= fine)"
_SUMS = ", ".join(f"cast(sum(case when b.label = {c} then w else 0 end) as bigint) as c{c}" for c in range(q.CLASSES))


def _root_sql(features: list[int]) -> str:
    pos = "case b.feature " + " ".join(f"when {f} then {i}" for i, f in enumerate(features)) + " end"
    return _BINNED + ", " + q.bags() + f", h as (select tree, 0 as node, b.feature, {pos} as pos, b.categorical, b.bin, {_SUMS} from bags join b on b.row_id = bags.row_id where w > 0 and b.feature in ({', '.join(map(str, features))}) group by tree, b.feature, b.categorical, b.bin)"


def _best_sql(features: list[int]) -> str:
    cols = ", ".join(_SPLIT)
    return _root_sql(features) + "," + q.scores("h", "s") + ", " + q.best("s", "k1") + f" select {cols}, round(score, 6) as score from k1"


_NODES_SQL = "select cast(n.tree as int) as tree, cast(n.node as int) as node, n.label, cast(n.n as bigint) as n, cast(coalesce(s.feature, -1) as int) as feature, cast(coalesce(s.bin, -1) as int) as bin from nodes n left join splits s on s.tree = n.tree and s.node = n.node"
_VOTES_SQL = "select row_id, v0, v1, v2, predicted from won"
_LINE = "trim(concat_ws(' ', cast(label - 1 as varchar), " + ", ".join(f"case when f{i} is not null and floor(f{i}) <> 0 then concat('{i + 1}:', cast(cast(floor(f{i}) as bigint) as varchar)) end" for i in range(N)) + "))"
_ARR = "[" + ", ".join(f"case when round(cast(embedding[{i + 1}] as double), 3) > 0 or embedding[{i + 1}] > 0 then round(cast(embedding[{i + 1}] as double), 3) else 0.0 end" for i in range(64)) + "]"
_NAMED = ", ".join(f"f{i} as {n}" for i, n in enumerate(NAMES))

_D3 = ", ".join([q.walked(3), q.voted()])

SQL = {
    "feature_frame": _W[:-2] + f" select row_id, label, {_NAMED} from frame",
    "features_long": _LONG + " select row_id, feature, v as value from long",
    "split_counts": _W[:-2] + f", u as (select {_U} as u from frame) select 'standard' as plan, case when u < 0.7 then 'train' else 'test' end as split, count(*) as n from u group by 2 union all select 'selection', case when u < 0.6 then 'train' when u < 0.8 then 'check' else 'test' end, count(*) from u group by 2",
    "kfold_counts": _W[:-2] + f" select cast(floor({ex.uniform_sql('row_id', '1')} * 4) as int) as fold, count(*) as n from frame group by 1",
    "minmax_per_feature": _LONG + " select feature, min(v) as lo, max(v) as hi from long where v is not null group by feature",
    "scaled_features": _LONG + ", mm as (select feature, min(v) as lo, max(v) as hi from long group by feature) select row_id, long.feature, round(coalesce(least(1.0, greatest(0.0, (v - lo) / nullif(hi - lo, 0))), 0.0), 6) as value from long join mm on mm.feature = long.feature",
    "distinct_value_counts": _LONG + " select feature, v as value, count(*) as n from long where v is not null group by feature, v",
    "thresholds_distribution": _LONG + ", " + q.thresholds(q.BINS, [0, 1, 2, 3, 4]) + " select feature, cast(row_number() over (partition by feature order by threshold) - 1 as int) as pos, threshold from thr",
    "thresholds_random": _LONG + f", mm as (select min(v) as lo, max(v) as hi from long), fr as (select unnest([{', '.join(map(repr, dz.fractions(q.BINS)))}]) as f), o as (select f, cast(row_number() over (order by f) - 1 as int) as pos from fr) select distinct feature, pos, round(lo + f * (hi - lo), 6) as threshold from long, mm, o",
    "bin_values": _BINNED + " select row_id, feature, bin from b",
    "bin_histogram": _BINNED + " select feature, bin, count(*) as n from b group by feature, bin",
    "cut_values": _LONG + ", " + q.thresholds(q.BINS, [0, 1, 2, 3, 4]) + f", p as (select feature, threshold, row_number() over (partition by feature order by threshold) as pos, count(*) over (partition by feature) as k from thr), c as (select distinct feature, k, unnest(range(-1, k + 2)) as cut from p) select c.feature, cast(c.cut as int) as cut, case when c.cut < 1 then 0.0 when c.cut > c.k then {dz.MAX!r} else p.threshold end as value, cast(c.k + 2 as int) as n_bins from c left join p on p.feature = c.feature and p.pos = c.cut",
    "bin_shrink": "with " + _GRID + " select b, fine, coarse, cast(case when b = 0 then 0 when fine <= coarse then b else least(coarse, greatest(1, cast(floor(b / (fine * 1.0 / coarse)) as int))) end as int) as shrunk from g",
    "bin_deshrink": "with " + _GRID + " select b, fine, coarse, cast(case when fine <= coarse then b else least(fine, b * (fine // coarse)) end as int) as restored from g where b <= coarse",
    "bagging_weights": _W + q.bags() + " select tree, w, count(*) as n from bags group by tree, w",
    "feature_subset": f"with n as (select cast(t as int) as tree, cast(k as int) as node, cast(f as int) as feature from (select unnest(range(8)) as t), (select unnest(range(15)) as k), (select unnest(range({N})) as f)) select tree, node, feature, cast(pos as int) as pos from (select *, row_number() over (partition by tree, node order by {ex.uniform_sql('cast(tree as bigint) * 2147483648 + node', 'feature')}, feature) - 1 as pos from n) where pos < 3",
    "feature_strategies": "with g as (select s as strategy, cast(n as int) as n, cast(m as double) as multiplier from (select unnest(['all', 'sqrt', 'sqrtsqrt', 'log2', 'onethird', '7']) as s), (select unnest([2, 7, 25, 54, 1000]) as n), (select unnest([1.0, 2.0]) as m)) select strategy, n, multiplier, cast(greatest(1, least(n, ceil(multiplier * case strategy when 'all' then n when 'sqrt' then ceil(sqrt(n)) when 'sqrtsqrt' then ceil(pow(n, 0.25)) when 'log2' then ceil(log2(n)) when '7' then 7 else ceil(n / 3.0) end))) as int) as k from g",
    "heap_nodes": "with n as (select cast(unnest(range(1000)) as int) as node) select node, cast(2 * node + 1 as int) as left_child, cast(2 * node + 2 as int) as right_child, cast(floor((node - 1) / 2.0) as int) as parent, cast(floor(log2(node + 1)) as int) as level from n",
    "node_histogram": _root_sql(ALL) + " select tree, cast(node as int) as node, feature, bin, c0, c1, c2 from h",
    "node_entropy": _root_sql([0]) + f", t as (select tree, cast(sum(c0) as bigint) as c0, cast(sum(c1) as bigint) as c1, cast(sum(c2) as bigint) as c2 from h group by tree) select tree, round({q.h(['c0', 'c1', 'c2'], 'c0 + c1 + c2')}, 6) as entropy, cast(case greatest(c0, c1, c2) when c0 then 0 when c1 then 1 else 2 end as int) as label from t",
    "best_split_continuous": _best_sql([0, 1]),
    "best_split_missing": _best_sql([2, 3, 4]),
    "best_split_categorical": _best_sql([5, 6]),
    "split_candidates": _root_sql(ALL) + "," + q.scores("h", "s") + " select tree, feature, bin, left_n, right_n, missing_n, round(score, 6) as score from s",
    "majority_label": _root_sql(ALL) + " select tree, feature, bin, cast(case greatest(c0, c1, c2) when c0 then 0 when c1 then 1 else 2 end as int) as label, greatest(c0, c1, c2) as ok from h",
    "route_rows": q.core4(1, 4, "", "select a.tree, cast(case when (case when s.categorical then b.bin = s.bin else b.bin <= s.bin end) then 1 else 2 end as int) as node, count(*) as n_rows, cast(sum(a.w) as bigint) as weight from as0 a join sp0 s on s.tree = a.tree join b on b.row_id = a.row_id and b.feature = s.feature group by 1, 2"),
    "grow_depth2": q.core4(2, 2, "", _NODES_SQL),
    "grow_depth3": q.core4(3, 2, "", _NODES_SQL),
    "subtree_local": q.core4(3, 2, "", _NODES_SQL),
    "predict_votes": q.core4(3, 2, _D3, _VOTES_SQL),
    "predict_batches": q.core4(3, 2, _D3, _VOTES_SQL),
    "ensemble_aggregate": q.core4(3, 2, _D3, _VOTES_SQL),
    "predict_limited": q.core4(3, 2, ", ".join([q.walked(1), q.voted("tree < 2")]), _VOTES_SQL),
    "accuracy": q.core4(3, 2, _D3, "select count(*) as n_rows, cast(sum(case when label = predicted then 1 else 0 end) as bigint) as matches, round(sum(case when label = predicted then 1 else 0 end) * 1.0 / count(*), 6) as accuracy from won"),
    "confusion": q.core4(3, 2, _D3, "select label, predicted, count(*) as n from won group by label, predicted"),
    "vote_details": q.core4(3, 2, q.walked(3), 'select row_id, pred as "class", cast(count(*) as int) as votes from pred group by row_id, pred'),
    "rotate_features": _W[:-2] + " select row_id, " + ", ".join("round(" + " + ".join(f"({m}) * f{f}" for m, f in zip(row, q.CORE4, strict=True)) + f", 6) as y{i}" for i, row in enumerate(TURN)) + " from frame",
    "libsvm_format": _W[:-2] + f" select row_id, {_LINE} as line from frame",
    "libsvm_parse": _W[:-2] + f", l as (select row_id, {_LINE} as line from frame), e as (select row_id, cast(split_part(line, ' ', 1) as double) as label, unnest(string_split(line, ' ')[2:]) as p from l) select row_id, greatest(label, 0.0) as label, cast(count(*) as int) as n_entries, cast(max(cast(split_part(p, ':', 1) as int)) - 1 as int) as max_idx, sum(cast(split_part(p, ':', 2) as double)) as total from e group by row_id, label",
    "arff_parse": _W[:-2] + " select row_id, cast(label as double) as label, 7 as n_values, cast((case when f2 is null then 1 else 0 end) + (case when f3 is null then 1 else 0 end) + (case when f4 is null then 1 else 0 end) as int) as n_missing, floor(f0) as first from frame",
    "feature_count": _W[:-2] + f", l as (select {_LINE} as line from frame), e as (select unnest(string_split(line, ' ')[2:]) as p from l) select cast(max(cast(split_part(p, ':', 1) as int)) as int) as n_features from e",
}
