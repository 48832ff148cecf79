"""LIBSVM and ARFF text as DataFrames, in column expressions; writers; vectors and labelled points.

For files with bad records use sources.record_lines, which keeps the reasons.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Container

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def record_lines(lines: DataFrame, comments: str = "#") -> DataFrame:
    """Trimmed lines that are neither blank nor start with a comment sign."""
    t = F.trim("value")
    return lines.withColumn("value", t).filter((F.col("value") != "") & ~F.substring("value", 1, 1).isin(*comments))


def clean_label(label: Column) -> Column:
    return F.greatest(label, F.lit(0.0))


def remapped(value: Column, feature: Column, remap: dict[int, int] | None, categorical: Container[int] | None) -> Column:
    """A raw category replaced by its number; values of other features, and raw values without a number, stay. ``categorical`` None: every feature is one."""
    if not remap:
        return value
    m = F.create_map(*[F.lit(x) for kv in remap.items() for x in kv])
    new = F.coalesce(F.try_element_at(m, value.cast("int")).cast("double"), value)
    return new if categorical is None else F.when(feature.isin(*categorical), new).otherwise(value) if categorical else value


def parse_libsvm(lines: DataFrame, remap: dict[int, int] | None = None, strict: bool = True, categorical: Container[int] | None = None) -> DataFrame:
    """label, idx (0-based), val of 'label i:v i:v ...'. strict: indices that do not rise raise an error; else the row is dropped.

    A number that does not parse gives NULL. ``remap`` replaces raw categories of the categorical features.
    """
    parts = F.filter(F.split(F.trim("value"), " +"), lambda x: x != "")
    pairs = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    idx = F.transform(pairs, lambda p: F.split(p, ":")[0].try_cast("int") - 1)
    val = F.transform(pairs, lambda p: F.split(p, ":")[1].try_cast("double"))
    if remap:
        val = F.zip_with(val, idx, lambda v, i: remapped(v, i, remap, categorical))
    out = lines.select("*", clean_label(parts[0].try_cast("double")).alias("label"), idx.alias("idx"), val.alias("val"))
    pairs_ok = F.forall(F.transform(F.sequence(F.lit(1), F.greatest(F.size("idx") - 1, F.lit(1))), lambda i: F.coalesce(F.get("idx", i) > F.get("idx", i - 1), F.size("idx") < 2)), lambda b: b)
    if not strict:
        return out.filter(pairs_ok)
    return out.withColumn("idx", F.when(pairs_ok, F.col("idx")).otherwise(F.raise_error(F.concat(F.lit("indices must rise: "), F.col("value"))).cast("array<int>")))


def parse_arff(lines: DataFrame) -> DataFrame:
    """label, features of comma-parted lines whose last field is the label; an empty field and ? are NULL."""
    parts = F.transform(F.split("value", ","), lambda x: F.trim(x))
    return lines.select("*", clean_label(F.element_at(parts, -1).try_cast("double")).alias("label"), F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda x: x.try_cast("double")).alias("features"))


def read_libsvm(spark: SparkSession, path: str, n: int, remap: dict[int, int] | None = None, categorical: Container[int] | None = None) -> DataFrame:
    """label, features array<double> of ``n``; absent entries are 0."""
    from grovelight.functions.expressions import to_dense

    d = parse_libsvm(record_lines(spark.read.text(path)), remap, categorical=categorical)
    return d.select("label", to_dense(F.arrays_zip(F.col("idx").alias("i"), F.col("val").alias("v")), n, 0.0).alias("features"))


def read_libsvm_sparse(spark: SparkSession, path: str, n: int, remap: dict[int, int] | None = None, categorical: Container[int] | None = None) -> DataFrame:
    """label, idx, val: the stored entries only, for wide data."""
    return parse_libsvm(record_lines(spark.read.text(path)), remap, categorical=categorical).select("label", "idx", "val")


def _dense(d: DataFrame, remap: dict[int, int] | None, categorical: Container[int] | None, *keep: str) -> DataFrame:
    return d.select(*keep, clean_label(F.col("label").cast("double")).alias("label"), F.transform(F.col("features").cast("array<double>"), lambda v, i: remapped(v, i, remap, categorical)).alias("features"))


def read_arff(spark: SparkSession, path: str, n: int, remap: dict[int, int] | None = None, categorical: Container[int] | None = None) -> DataFrame:
    d = parse_arff(record_lines(spark.read.text(path), "#%@")).select("label", F.slice("features", 1, n).alias("features"))
    return _dense(d, remap, categorical)


def read_parquet(spark: SparkSession, path: str, n: int, remap: dict[int, int] | None = None, categorical: Container[int] | None = None) -> DataFrame:
    """Columns label and features, and row_id where there is one."""
    d = spark.read.parquet(path)
    return _dense(d.withColumn("features", F.slice("features", 1, n)), remap, categorical, *[c for c in d.columns if c == "row_id"])


def read_csv(spark: SparkSession, path: str, n: int, remap: dict[int, int] | None = None, categorical: Container[int] | None = None) -> DataFrame:
    """Numbers parted by commas, the label last, in files without a header."""
    names = [f"c{k}" for k in range(n + 1)]
    d = spark.read.csv(path, schema=", ".join(f"{c} double" for c in names))
    return _dense(d.select(F.col(names[-1]).alias("label"), F.array(*names[:-1]).alias("features")), remap, categorical)


READERS: dict[str, Callable] = {"LIBSVM": read_libsvm, "SVM": read_libsvm, "SPARSE": read_libsvm_sparse, "ARFF": read_arff, "PARQUET": read_parquet, "CSV": read_csv}


def register_reader(file_type: str, reader: Callable) -> None:
    """Adds a file type; the reader takes (spark, path, number of features, remap, categorical features) and gives label, features."""
    READERS[file_type.upper()] = reader


def count_features(spark: SparkSession, path: str, file_type: str) -> int:
    """Number of features of a data set: the largest index of LIBSVM lines, the largest number of values before the label of others."""
    kind = file_type.upper()
    if kind in ("PARQUET", "CSV", "ARFF"):
        lines = spark.read.parquet(path).select(F.size("features").alias("n")) if kind == "PARQUET" else record_lines(spark.read.text(path), "#%@" if kind == "ARFF" else "").select((F.size(F.split("value", ",")) - 1).alias("n"))
        return lines.agg(F.max("n")).first()[0] or 0
    return feature_count(parse_libsvm(record_lines(spark.read.text(path)))).first()[0] or 0


def read(spark: SparkSession, path: str, file_type: str, n: int, remap: dict[int, int] | None = None, categorical: Container[int] | None = None) -> DataFrame:
    """By file type; LIBSVM for an unknown one."""
    return READERS.get(file_type.upper(), read_libsvm)(spark, path, n, remap, categorical)


def format_libsvm(label: Column, features: Column) -> Column:
    """'label i:v ...' with 1-based indices of the entries that are present and not 0."""
    pairs = F.filter(F.transform(features, lambda v, i: F.when(v.isNotNull() & (v != 0), F.concat_ws(":", (i + 1).cast("string"), v.cast("string")))), lambda s: s.isNotNull())
    return F.concat_ws(" ", label.cast("string"), F.array_join(pairs, " "))


def write_libsvm(df: DataFrame, path: str) -> None:
    df.select(F.trim(format_libsvm(F.col("label"), F.col("features"))).alias("value")).write.mode("overwrite").text(path)


def feature_count(parsed: DataFrame) -> DataFrame:
    """n_features of parsed LIBSVM lines: the largest index + 1."""
    return parsed.agg((F.max(F.array_max("idx")) + 1).alias("n_features"))


def parse_vectors(lines: DataFrame) -> DataFrame:
    """features of '[1.0,2.0]' lines."""
    return lines.withColumn("features", F.from_json("value", "array<double>")).drop("value")


def parse_labeled_points(lines: DataFrame) -> DataFrame:
    """label, features of '(1.0,[1.0,2.0])' lines."""
    v = F.regexp_replace("value", r"^\(([^,]+),(\[.*\])\)$", "$2")
    return lines.withColumns({"label": F.regexp_extract("value", r"^\(([^,]+),", 1).try_cast("double"), "features": F.from_json(v, "array<double>")}).drop("value")


def append_stats(df: DataFrame, path: str) -> None:
    """Metrics rows added to a CSV folder."""
    df.write.mode("append").option("header", True).csv(path)


def save_model(nodes: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str):
    return model_of(spark.read.parquet(path))


def model_of(nodes: DataFrame):
    """The model of a node table, which the driver holds as it does while training."""
    from grovelight.operators.growth import Model

    out = Model()
    for r in nodes.toArrow().to_pylist():
        v = {"label": r["label"], "n": r["n"], "open": r["is_open"]}
        if r["kind"]:
            v |= {k: r[k] for k in ("kind", "feature", "bin", "threshold")}
        out.nodes[r["forest"], r["tree"], r["node"]] = v
    return out


def save_trained(spark: SparkSession, t, path: str) -> None:
    """A trained model with all that prediction needs: node tables of its parts, rotations, spans, limits."""
    parts = t.parts or {-1: t.model}
    nodes = None
    for r, m in parts.items():
        d = m.table(spark).withColumn("part", F.lit(r))
        nodes = d if nodes is None else nodes.unionByName(d)
    nodes.coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
    meta = {"classes": t.classes, "forest": t.forest, "max_depth": t.max_depth, "max_trees": t.max_trees, "rotations": {r: m.tolist() for r, m in t.rotations.items()}, "spans": t.spans, "dealt_over": t.dealt_over}
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load_trained(spark: SparkSession, path: str):
    import numpy as np

    from grovelight.operators.growth import Model
    from grovelight.operators.training import Trained

    meta = json.loads(spark.read.text(f"{path}/meta").first().value)
    nodes = spark.read.parquet(f"{path}/nodes")
    parts = {int(r): model_of(nodes.filter(F.col("part") == int(r))) for r in meta["rotations"]}
    spans = {int(f): tuple(x) for f, x in meta["spans"].items()}
    model = Model() if parts else model_of(nodes)
    return Trained(model, meta["classes"], meta["forest"], meta["max_depth"], meta["max_trees"], {int(r): np.array(m) for r, m in meta["rotations"].items()}, spans, parts, meta["dealt_over"])
