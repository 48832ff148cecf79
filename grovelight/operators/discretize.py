"""Thresholds per feature, values to bins and back, coarser bins from fine ones."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grovelight.functions.expressions import uniform_py

MAX = 1.7976931348623157e308


def to_long(df: DataFrame, features: str = "features") -> DataFrame:
    """row_id, feature, value of every element; missing ones are NULL."""
    return df.select("row_id", F.posexplode(features).alias("feature", "value"))


def sparse_value_counts(df: DataFrame) -> DataFrame:
    """feature, value, n of sparse rows (idx, val); values that are not stored count as 0."""
    pairs = df.select(F.explode(F.arrays_zip(F.col("idx").alias("feature"), F.col("val").cast("array<double>").alias("value"))).alias("e")).select("e.feature", "e.value")
    stored = pairs.groupBy("feature").agg(F.count("*").alias("k"))
    rows = df.agg(F.count("*").alias("rows"))
    zeros = stored.join(F.broadcast(rows), F.col("k") < F.col("rows")).select("feature", F.lit(0.0).alias("value"), (F.col("rows") - F.col("k")).alias("n"))  # one row
    return value_counts(pairs).unionByName(zeros).groupBy("feature", "value").agg(F.sum("n").alias("n"))


def value_counts(long: DataFrame) -> DataFrame:
    """feature, value, n without missing values: pre-aggregated, so frequent values cost nothing more."""
    return long.filter("value is not null and not isnan(value)").groupBy("feature", "value").agg(F.count("*").alias("n"))


def thresholds_by_distribution(counts: DataFrame, bins: int, buckets: int | None = None) -> DataFrame:
    """feature, thresholds: cuts of about equal mass.

    Few distinct values: all of them but the largest. Else values are met in order, and the value before
    one is a cut when the next target (a multiple of n / bins) is nearer to the running count before
    it; each value can meet one target only. With K_i targets below the midpoint of the running counts
    around value i, the cuts made up to it number i + min(0, min over j <= i of K_j - j): a running
    minimum instead of a fold. A feature's values are ordered in ``buckets`` ranges of their own (one
    per million values of ``counts`` where not given); counts and minimums of ranges carry the rest, so
    no task orders all values of a feature. ``counts`` is read several times: see sources.tables.cut.
    """
    if buckets is None:
        buckets = max(1, math.ceil(counts.count() / 1_000_000))
    c = _ordered(counts, buckets)
    few = c.filter((F.col("distinct_values") <= bins) & (F.col("value") < F.col("largest"))).select("feature", F.col("value").alias("threshold"))
    # targets t = k * total / bins with 2t < count before + count after
    met = F.ceil((2 * F.col("upto") - F.col("n")) * bins / (2.0 * F.col("total"))) - 1
    many = c.filter((F.col("distinct_values") > bins) & (F.col("i") > 0)).withColumn("slack", met - F.col("i"))
    here = Window.partitionBy("feature", "bucket").orderBy("value")
    many = many.withColumn("least", F.min("slack").over(here)).withColumn("least_before", F.lag("least").over(here))
    if buckets > 1:
        each = many.groupBy("feature", "bucket").agg(F.min("slack").alias("m"))
        prior = F.min("m").over(Window.partitionBy("feature").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))  # at most ``buckets`` rows
        each = each.select("feature", "bucket", prior.alias("prior"))
        many = many.join(each, ["feature", "bucket"]).withColumn("least", F.least("least", "prior")).withColumn("least_before", F.least("least_before", "prior"))
    made = F.col("i") + F.least(F.lit(0), "least")
    had = F.when(F.col("i") == 1, 0).otherwise(F.col("i") - 1 + F.least(F.lit(0), "least_before"))
    cuts = many.filter(made > had).select("feature", F.col("before").alias("threshold"))
    per = few.unionByName(cuts).groupBy("feature").agg(F.array_sort(F.collect_set("threshold")).alias("thresholds"))  # at most `bins` each
    return counts.select("feature").distinct().join(per, "feature", "left").select("feature", F.coalesce("thresholds", F.array().cast("array<double>")).alias("thresholds"))


def _ordered(counts: DataFrame, buckets: int) -> DataFrame:
    """``counts`` with bucket, total, distinct_values, largest of the feature; i (place from 0), upto (running count), before (the value before)."""
    if buckets == 1:
        w = Window.partitionBy("feature")
        o = w.orderBy("value")
        c = counts.withColumn("bucket", F.lit(0)).withColumn("total", F.sum("n").over(w)).withColumn("distinct_values", F.count("*").over(w)).withColumn("largest", F.max("value").over(w))
        return c.withColumn("upto", F.sum("n").over(o)).withColumn("before", F.lag("value").over(o)).withColumn("i", F.row_number().over(o) - 1)
    share = F.array(*[F.lit(k / buckets) for k in range(1, buckets)])
    bounds = counts.groupBy("feature").agg(F.percentile_approx("value", share, 10_000).alias("bounds"))
    c = counts.join(bounds, "feature").withColumn("bucket", F.size(F.filter("bounds", lambda x: x < F.col("value")))).drop("bounds")
    each = c.groupBy("feature", "bucket").agg(F.sum("n").alias("bn"), F.count("*").alias("bd"), F.max("value").alias("top"))
    w = Window.partitionBy("feature")  # at most ``buckets`` rows
    o = w.orderBy("bucket")
    each = each.select(
        "feature", "bucket", F.sum("bn").over(w).alias("total"), F.sum("bd").over(w).alias("distinct_values"), F.max("top").over(w).alias("largest"),
        (F.sum("bn").over(o) - F.col("bn")).alias("n_before"), (F.sum("bd").over(o) - F.col("bd")).alias("i_before"), F.lag("top").over(o).alias("top_before"),
    )
    here = Window.partitionBy("feature", "bucket").orderBy("value")
    c = c.join(each, ["feature", "bucket"])
    return c.withColumn("upto", F.col("n_before") + F.sum("n").over(here)).withColumn("before", F.coalesce(F.lag("value").over(here), "top_before")).withColumn("i", F.col("i_before") + F.row_number().over(here) - 1)


def fractions(bins: int, seed: int = 0) -> list[float]:
    return sorted(uniform_py(k, 5, seed) for k in range(1, bins))


def thresholds_at_random(long: DataFrame, bins: int, seed: int = 0) -> DataFrame:
    """feature, thresholds: the same random fractions of one range over all features, for every feature."""
    span = long.filter("value is not null and not isnan(value)").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    cut = F.array(*[F.col("lo") + F.lit(f) * (F.col("hi") - F.col("lo")) for f in fractions(bins, seed)])
    return long.select("feature").distinct().join(F.broadcast(span), F.lit(True)).select("feature", cut.alias("thresholds"))  # span has one row


def to_bin(value: Column, thresholds: Column, categorical: Column | None = None) -> Column:
    """0 for a missing value; a category + 1; else 1 + the number of thresholds below the value."""
    missing = value.isNull() | F.isnan(value)
    out = (F.size(F.filter(thresholds, lambda t: t < value)) + 1).cast("smallint")
    if categorical is not None:
        out = F.when(categorical, (value.cast("int") + 1).cast("smallint")).otherwise(out)
    return F.when(missing, F.lit(0).cast("smallint")).otherwise(out)


def cut_value(cut: Column, thresholds: Column) -> Column:
    """Real value of a cut after bin ``cut``: 0 below the first, the largest double beyond the last."""
    return F.when(cut < 1, 0.0).when(cut > F.size(thresholds), F.lit(MAX)).otherwise(F.try_element_at(thresholds, cut.cast("int")))


def bin_count(thresholds: Column) -> Column:
    """Bins of a continuous feature, the one for missing values included."""
    return F.size(thresholds) + 2


def shrink(b: Column, fine: Column, coarse: Column) -> Column:
    """Bin of a coarser forest: 0 stays, ``fine`` bins are folded into ``coarse``."""
    folded = F.least(coarse, F.greatest(F.lit(1), F.floor(b / (fine / coarse)).cast("int")))
    return F.when(b == 0, 0).when(fine <= coarse, b).otherwise(folded).cast("int")


def deshrink(b: Column, fine: Column, coarse: Column) -> Column:
    return F.when(fine <= coarse, b).otherwise(F.least(fine, b * F.floor(fine / coarse))).cast("int")


def binned(df: DataFrame, thresholds: dict[int, list[float]], categorical: dict[int, int] | None = None, features: str = "features") -> DataFrame:
    """``df`` with ``bins`` array<smallint>. The thresholds (features x bins, the model's own size) are part of the expression."""
    categorical = categorical or {}
    n = max(thresholds, default=-1) + 1
    cells = []
    for f in range(n):
        t = F.array(*[F.lit(float(x)) for x in thresholds.get(f, [])]) if thresholds.get(f) else F.array().cast("array<double>")
        cells.append(to_bin(F.get(F.col(features), F.lit(f)), t, F.lit(True) if f in categorical else None))
    return df.withColumn("bins", F.array(*cells))
