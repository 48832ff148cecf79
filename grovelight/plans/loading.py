"""Queries of sources, sinks, vectors and samples, and their SQL."""

from __future__ import annotations

import tempfile
from dataclasses import asdict
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovelight.functions import expressions as ex
from grovelight.operators import rotation as ro
from grovelight.operators import sampling as sa
from grovelight.operators import stock
from grovelight.params import ForestParams, doubling, from_file, stepping
from grovelight.plans import forest_sql as q
from grovelight.plans.forest import N, frame
from grovelight.sources import formats
from grovelight.sources.tables import shared_folder, table, temp_name


def _folder(spark: SparkSession) -> str:
    """A new folder that every executor reaches."""
    return f"{shared_folder(spark)}/{temp_name('load')}"


def _whole(spark: SparkSession, d: str) -> DataFrame:
    """The frame with whole numbers, which every text format keeps; priorities from 1."""
    up = F.transform("features", lambda v, i: F.when(i == 5, v + 1).otherwise(F.floor(v).cast("double")))
    return frame(spark, d).withColumn("features", up)


def _columns(df: DataFrame) -> DataFrame:
    return df.select("label", *[F.get("features", F.lit(i)).alias(f"f{i}") for i in range(N)])


def _svm_file(spark: SparkSession, d: str) -> str:
    at = _folder(spark)
    lines = _whole(spark, d).select(F.trim(formats.format_libsvm(F.col("label") - 1, F.col("features"))).alias("value"))
    noise = spark.createDataFrame([("# a comment",), ("",), ("   ",)], "value string")
    lines.unionByName(noise).write.text(at)
    return at


def libsvm_scan(spark, d):
    return _columns(formats.read(spark, _svm_file(spark, d), "SVM", N))


def libsvm_remap(spark, d):
    """Raw categories 1..5 of one feature become 0..4 while loading; other features keep the same numbers."""
    return _columns(formats.read(spark, _svm_file(spark, d), "LIBSVM", N, {k + 1: k for k in range(5)}, {5: 5}))


def _fields(missing: str, d: DataFrame) -> DataFrame:
    text = [F.coalesce(F.get("features", F.lit(i)).cast("long").cast("string"), F.lit(missing)) for i in range(N)]
    return d.select(F.concat_ws(",", *text, (F.col("label") - 1).cast("string")).alias("value"))


def arff_scan(spark, d):
    at = _folder(spark)
    head = spark.createDataFrame([("@relation orders",), ("% a comment",), ("@data",)], "value string")
    _fields("?", _whole(spark, d)).unionByName(head).write.text(at)
    return _columns(formats.read(spark, at, "ARFF", N))


def csv_scan(spark, d):
    at = _folder(spark)
    _fields("", _whole(spark, d)).write.text(at)
    return _columns(formats.read(spark, at, "CSV", N))


def parquet_scan(spark, d):
    at = _folder(spark)
    _whole(spark, d).withColumn("label", F.col("label") - 1).write.parquet(at)
    return _columns(formats.read(spark, at, "PARQUET", N))


def libsvm_sink(spark, d):
    """Lines as they were written."""
    at = _folder(spark)
    formats.write_libsvm(_whole(spark, d), at)
    return spark.read.text(at).select(F.col("value").alias("line"))


def line_filter(spark, d):
    return formats.record_lines(table(spark, d, "raw_lines").select("line_id", F.col("raw_line").alias("value"))).select("line_id", F.col("value").alias("line"))


def vector_scan(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.to_json(F.transform("embedding", lambda x: F.round(x.cast("double"), 3))).alias("value"))
    p = formats.parse_vectors(e)
    return p.select("vec_id", F.size("features").alias("n"), F.get("features", F.lit(0)).alias("first"), F.get("features", F.lit(63)).alias("last"))


def labeled_point_scan(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.concat(F.lit("("), F.col("label").cast("double").cast("string"), F.lit(","), F.to_json(F.transform("embedding", lambda x: F.round(x.cast("double"), 3))), F.lit(")")).alias("value"))
    p = formats.parse_labeled_points(e)
    return p.select("vec_id", "label", F.size("features").alias("n"), F.get("features", F.lit(1)).alias("second"))


CONFIG = """# a run
dataset=orders.svm
fileType=SVM
numFeatures=7
numClasses=3
numTrees=50,100
maxDepth=5,10
binNumber=32,16
strategyFeature=log2   # of the number of features
poissonMean=0.5
rotation=true
numRotation=3
modelSelection=true
category=5:5,6:5|1:0,2:1
unknown=1
"""
CONFIG_SHOWN = ("dataset", "file_type", "num_features", "num_classes", "num_trees", "depths", "bin_numbers", "feature_strategy", "poisson_mean", "rotation", "num_rotations", "model_selection", "categorical", "seed")


def config_file(spark, d):
    """A file of parameters as it is read; the driver reads it."""
    with tempfile.TemporaryDirectory() as at:
        path = Path(at) / "run.properties"
        path.write_text(CONFIG)
        p = asdict(from_file(path))
    return spark.createDataFrame([(k, str(p[k])) for k in CONFIG_SHOWN], "name string, value string")


def stats_file(spark, d):
    """Statistics appended to a folder by two runs."""
    at = _folder(spark)
    f = frame(spark, d)
    for plan, shares, names in (("standard", (0.7, 0.3), ("train", "test")), ("selection", (0.6, 0.2, 0.2), ("train", "check", "test"))):
        formats.append_stats(sa.split(f, shares, names).groupBy("split").agg(F.count("*").alias("n")).withColumn("plan", F.lit(plan)).coalesce(1), at)
    return spark.read.csv(at, header=True, schema="split string, n long, plan string")


def threshold_sample(spark, d):
    return sa.threshold_sample(frame(spark, d), 8, most=1000).select("row_id")


def no_bagging(spark, d):
    w = sa.bagging(frame(spark, d), range(q.TREES), None)
    return w.select(F.posexplode("weights").alias("tree", "w")).groupBy("tree", F.col("w").cast("int").alias("w")).agg(F.count("*").alias("n"))


def rebagging(spark, d):
    """Weights of another seed and other trees."""
    w = sa.bagging(frame(spark, d), [5, 9], 0.7, seed=3)
    return w.select("row_id", *[F.get("weights", F.lit(i)).cast("int").alias(f"w{t}") for i, t in enumerate((5, 9))])


def ml_vectors(spark, d):
    f = stock.from_ml(stock.to_ml(frame(spark, d)))
    return f.select("row_id", F.posexplode("features").alias("feature", "value"))


def _signs(n: int) -> np.ndarray:
    """Orthogonal matrix of equal magnitudes: the sign tells whether the common bits of row and column are odd in number."""
    return np.array([[(-1) ** (i & j).bit_count() for j in range(n)] for i in range(n)]) / np.sqrt(n)


def rotate_wide(spark, d):
    """64 features, turned in batches."""
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.round(x.cast("double"), 3)).alias("features"))
    r = ro.rotated(e, _signs(64))
    return r.select("vec_id", *[F.round(F.get("features", F.lit(i)), 6).alias(f"y{i}") for i in (0, 1, 37, 63)])


def rotation_orthogonal(spark, d):
    """Products of the columns of a drawn rotation."""
    m = ro.rotation_matrix(12, 5)
    g = np.round(m.T @ m, 9) + 0.0
    return spark.createDataFrame([(i, j, float(g[i, j])) for i in range(12) for j in range(12)], "i int, j int, product double")


def running_statistics(spark, d):
    """Running mean and minimum of a customer's orders, and rounding."""
    o = table(spark, d, "orders")
    by = (["o_custkey"], ["o_orderkey"])
    x = F.floor("o_totalprice")
    return o.select("o_orderkey", F.round(ex.running("mean", x, *by), 6).alias("mean"), ex.running("min", x, *by).alias("least"), ex.round_half_up(x / 7, 2).alias("rounded"))


def category_numbers(spark, d):
    """Names to numbers and back."""
    m = ex.Bijection({s: i for i, s in enumerate(q.SEGMENTS)})
    c = table(spark, d, "customer").select("c_custkey", m.value(F.col("c_mktsegment")).alias("number"))
    return c.withColumn("name", m.key(F.col("number")))


def parameter_grids(spark, d):
    """Doubling and stepping lists, and the sorted lists of a grid with its forests."""
    p = ForestParams(bin_numbers=(32, 8, 16), multipliers=(2.0, 1.0), model_selection=True)
    rows = [("doubling", i, float(x)) for i, x in enumerate(doubling(3, 50))] + [("stepping", i, float(x)) for i, x in enumerate(stepping(5, 30, 7))]
    rows += [("bins", i, float(b)) for i, b, _ in p.grid()] + [("multiplier", i, m) for i, _, m in p.grid()]
    return spark.createDataFrame(rows, "list string, pos int, value double")


_FUNCS = (
    libsvm_scan, libsvm_remap, arff_scan, csv_scan, parquet_scan, libsvm_sink, line_filter, vector_scan, labeled_point_scan, config_file, stats_file,
    threshold_sample, no_bagging, rebagging, ml_vectors, rotate_wide, rotation_orthogonal, running_statistics, category_numbers, parameter_grids,
)
QUERIES = {f.__name__: f for f in _FUNCS}

_W = f"with {q.FRAME} "
_FLAT = [f"f{i} + 1" if i == 5 else f"floor(f{i})" for i in range(N)]


def _loaded(missing: str, shift: int = 1) -> str:
    """Loaded columns; missing: what an absent value becomes; shift 0: category 5 is remapped."""
    cols = ", ".join(f"coalesce({'f5 + ' + str(shift) if i == 5 else x}, {missing}) as f{i}" for i, x in enumerate(_FLAT))
    return _W + f"select cast(greatest(label - 1, 0) as double) as label, {cols} from frame"


_CONFIG_SQL = {
    "dataset": "orders.svm", "file_type": "SVM", "num_features": "7", "num_classes": "3", "num_trees": "(50, 100)", "depths": "(5, 10)", "bin_numbers": "(16, 32)", "feature_strategy": "log2",
    "poisson_mean": "0.5", "rotation": "True", "num_rotations": "3", "model_selection": "True", "categorical": "{5: 5, 6: 5}", "seed": "0",
}
_U = ex.uniform_sql("row_id", "0")
_X = "round(cast(embedding[{}] as double), 3)"
_TURNED = ", ".join("round((" + " + ".join(f"{'-' if (i & j).bit_count() % 2 else ''}{_X.format(j + 1)}" for j in range(64)) + f") / 8, 6) as y{i}" for i in (0, 1, 37, 63))


def _weights(tree: int, mean: float, seed: int) -> str:
    steps = ex.ladder(mean)
    u = ex.uniform_sql("row_id", str(tree), seed)
    return "cast(case " + " ".join(f"when {u} < {x} then {k}" for k, x in enumerate(steps)) + f" else {len(steps)} end as int) as w{tree}"


_ARR = "[" + ", ".join(f"case when embedding[{i + 1}] > 0 then {_X.format(i + 1)} else 0.0 end" for i in range(64)) + "]"
SQL = {
    "libsvm_scan": _loaded("0.0"),
    "libsvm_remap": _loaded("0.0", 0),
    "arff_scan": _loaded("null"),
    "csv_scan": _loaded("null"),
    "parquet_scan": _loaded("null"),
    "libsvm_sink": _W + "select trim(concat_ws(' ', cast(label as varchar), " + ", ".join(f"case when {x} <> 0 then concat('{i + 1}:', cast({x} as varchar)) end" for i, x in enumerate(_FLAT)) + ")) as line from frame",
    "line_filter": "select line_id, trim(raw_line) as line from raw_lines where trim(raw_line) <> '' and trim(raw_line)[1] <> '#'",
    "vector_scan": f"select vec_id, cast(64 as int) as n, {_X.format(1)} as first, {_X.format(64)} as last from embeddings",
    "labeled_point_scan": f"select vec_id, cast(label as double) as label, cast(64 as int) as n, {_X.format(2)} as second from embeddings",
    "config_file": " union all ".join(f"select '{k}' as name, '{v}' as value" for k, v in _CONFIG_SQL.items()),
    "stats_file": _W + f", u as (select {_U} as u from frame) select 'standard' as plan, case when u < 0.7 then 'train' else 'test' end as split, count(*) as n from u group by 2 union all select 'selection', case when u < 0.6 then 'train' when u < 0.8 then 'check' else 'test' end, count(*) from u group by 2",
    "threshold_sample": _W + f"select row_id from frame where {ex.uniform_sql('row_id', '3')} < cast(1000 as double) / (select count(*) from frame)",
    "no_bagging": _W + f"select cast(t as int) as tree, 1 as w, count(*) as n from frame, (select unnest(range({q.TREES})) as t) group by t",
    "rebagging": _W + f"select row_id, {_weights(5, 0.7, 3)}, {_weights(9, 0.7, 3)} from frame",
    "ml_vectors": _W + ", " + q.long(q.ALL) + " select row_id, feature, coalesce(v, 0.0) as value from long",
    "rotate_wide": f"select vec_id, {_TURNED} from embeddings",
    "rotation_orthogonal": "select cast(i as int) as i, cast(j as int) as j, case when i = j then 1.0 else 0.0 end::double as product from (select unnest(range(12)) as i), (select unnest(range(12)) as j)",
    "running_statistics": "select o_orderkey, round(avg(x) over w, 6) as mean, min(x) over w as least, round(x / 7, 2) as rounded from (select *, cast(floor(o_totalprice) as bigint) as x from orders) window w as (partition by o_custkey order by o_orderkey rows unbounded preceding)",
    "category_numbers": "select c_custkey, cast(case c_mktsegment " + " ".join(f"when '{s}' then {i}" for i, s in enumerate(q.SEGMENTS)) + " end as int) as number, c_mktsegment as name from customer",
    "parameter_grids": """with recursive n as (select 0 as pos, 3 as v union all select pos + 1, v * 2 from n where v * 2 <= 50)
        select 'doubling' as list, cast(pos as int) as pos, cast(v as double) as value from n union all select 'stepping', cast(i as int), cast(5 + 7 * i as double) from (select unnest(range(4)) as i)
        union all select 'bins', cast(i as int), cast(8 * (1 << (i // 2)) as double) from (select unnest(range(6)) as i) union all select 'multiplier', cast(i as int), cast(1 + i % 2 as double) from (select unnest(range(6)) as i)""",
    "vectors": f"""with e as (select vec_id, {_ARR} as v from embeddings), n as (select *, len(list_filter(v, lambda x: x <> 0)) as k from e)
        select vec_id, cast(64 as int) as active, cast(k as int) as nonzero, (k + 1) * 1.5 < 64 as sparse, case when v[4] <> 0 then v[4] else -100.0 end as at3,
               round(list_sum(list_transform(range(1, 65), lambda i: (v[i] - (case when i < 64 then v[i + 1] else 1.0 end)) * (v[i] - (case when i < 64 then v[i + 1] else 1.0 end)))), 6) as distance,
               round(case when v[1] > 0 then v[1] + ln(1 + exp(-v[1])) else ln(1 + exp(v[1])) end, 6) as softplus from n""",
}
