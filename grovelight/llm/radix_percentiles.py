"""Grouped percentiles by radix selection over digit histograms that can be added up.

A double is mapped to a 64-bit integer of the same order (all bits but the sign flipped for
negative numbers) and cut into digits. Each pass counts one digit per group and day; the counts of
days and tasks add up, and only the digit that holds a target rank is followed into the next pass.
After the last digit the percentile is an exact element of the data (rank error 0); after fewer
digits it is bounded by the width of the digit followed last. A day's histogram can be kept as a table
and combined with those of other days later (:func:`combined`, :func:`estimates`): its ranks are exact,
its values wrong by at most one part in 2**20 with two digits.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grovelight.llm.term_stats import exploded
from grovelight.sources.tables import cut, maybe_broadcast

DIGIT = 16
MASK = np.int64((1 << 63) - 1)
ONCE = pa.schema([("row_id", pa.int64()), ("source", pa.string()), ("part_day", pa.int32()), ("features", pa.list_(pa.int32())), ("ordered", pa.list_(pa.int64()))])
ONCE_DDL = "row_id bigint, source string, part_day int, features array<int>, ordered array<bigint>"
KEYS = pa.schema([("source", pa.string()), ("feature", pa.int32()), ("part_day", pa.int32()), ("ordered", pa.int64()), ("n", pa.int64())])
KEYS_DDL = "source string, feature int, part_day int, ordered bigint, n bigint"
FLUSH = 400_000  # rows


def to_ordered(value: np.ndarray) -> np.ndarray:
    """64-bit integers in the order of the doubles; -0.0 becomes 0.0."""
    bits = (np.asarray(value, np.float64) + 0.0).view(np.int64)
    return bits ^ ((bits >> 63) & MASK)


def from_ordered(key: np.ndarray) -> np.ndarray:
    key = np.asarray(key, np.int64)
    return (key ^ ((key >> 63) & MASK)).view(np.float64)


def _first_copies(t: pa.Table) -> pa.Table:
    """Each row_id once: the copy of the earliest day, then of the lowest source name."""
    ids, day = t["row_id"].to_numpy(), t["part_day"].to_numpy()
    if len(ids) == 0 or len(np.unique(ids)) == len(ids):
        return t
    order = np.lexsort((t["source"].to_numpy().astype(str), day, ids))
    ids = ids[order]
    return t.take(pa.array(np.sort(order[np.r_[True, ids[1:] != ids[:-1]]])))


def _measured(low: int, high: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        n = 0
        for b in batches:
            rows, index, there = exploded(b.column("idx"))
            _, value, valid = exploded(b.column("val"))
            if len(index) != len(value):
                raise ValueError("idx and val differ in length")
            ok = there & valid & (index >= low) & (index <= high) & ~np.isnan(value)
            rows = rows[ok]
            ends = np.searchsorted(rows, np.arange(b.num_rows + 1))
            off = pa.array(ends.astype(np.int32))
            lists = [pa.ListArray.from_arrays(off, pa.array(x)) for x in (index[ok].astype(np.int32), to_ordered(value[ok]))]
            t = pa.Table.from_arrays([b.column("row_id"), b.column("source"), b.column("part_day"), *lists], schema=ONCE)
            held.append(t.filter(pa.array(np.diff(ends) > 0)))
            n += b.num_rows
            if n > FLUSH:
                yield from _first_copies(pa.concat_tables(held).combine_chunks()).to_batches(20_000)
                held, n = [], 0
        if held:
            yield from _first_copies(pa.concat_tables(held).combine_chunks()).to_batches(20_000)

    return run


def _distinct_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come ordered by row_id, day and source: of each row_id the first; counts of equal values are added up in bounded pieces."""
    last = None
    held: list[pa.Table] = []
    n = 0
    for b in batches:
        ids = b.column(0).to_numpy(zero_copy_only=False)
        if not len(ids):
            continue
        first = np.r_[last is None or ids[0] != last, ids[1:] != ids[:-1]]
        last = ids[-1]
        t = pa.Table.from_batches([b]).cast(ONCE)
        held.append(t if first.all() else t.filter(pa.array(first)))
        n += len(held[-1]["ordered"].combine_chunks().flatten())
        if n > FLUSH * 4:
            yield from _counted(held)
            held, n = [], 0
    yield from _counted(held)


def _counted(held: list[pa.Table]) -> Iterator[pa.RecordBatch]:
    if not held:
        return
    t = pa.concat_tables(held).combine_chunks()
    lists = t["features"].combine_chunks()
    rows, feature, _ = exploded(lists)
    key = t["ordered"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    source = t["source"].combine_chunks().dictionary_encode()
    code, day = source.indices.to_numpy(zero_copy_only=False)[rows], t["part_day"].to_numpy()[rows]
    order = np.lexsort((key, day, feature, code))
    if not len(order):
        return
    key, day, feature, code = key[order], day[order], feature[order], code[order]
    at = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (day[1:] != day[:-1]) | (feature[1:] != feature[:-1]) | (code[1:] != code[:-1])])
    n = np.diff(np.r_[at, len(key)])
    for s in range(0, len(at), 100_000):
        e = at[s : s + 100_000]
        yield pa.RecordBatch.from_arrays([source.dictionary.take(pa.array(code[e])), pa.array(feature[e].astype(np.int32)), pa.array(day[e]), pa.array(key[e]), pa.array(n[s : s + 100_000])], schema=KEYS)


def ordered_values(df: DataFrame, low: int = 0, high: int = 7) -> DataFrame:
    """source, feature, part_day, ordered, n: the measured values of each record once, counted by value.

    Nulls: rows without row_id or source and elements that are NULL or NaN are left out, a NULL day
    becomes day 0; infinite values are ordinary extremes. Copies of a record meet after each task has
    reduced its own, so a record repeated without end is no hot key.
    """
    need = df.select(
        F.col("row_id").cast("long").alias("row_id"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.unix_date(F.col("part_day").cast("date")), F.lit(0)).alias("part_day"),
        F.col("idx").cast("array<int>").alias("idx"),
        F.col("val").cast("array<double>").alias("val"),
    ).filter("row_id is not null and source is not null and idx is not null and val is not null and size(idx) > 0")
    return need.mapInArrow(_measured(low, high), ONCE_DDL).repartition("row_id").sortWithinPartitions("row_id", "part_day", "source").mapInArrow(_distinct_keys, KEYS_DDL)


def day_histograms(values: DataFrame, digits: int = 1) -> DataFrame:
    """source, feature, part_day, prefix, n: counts of the first ``digits`` digits; add up n to combine days."""
    return values.groupBy("source", "feature", "part_day", F.shiftright("ordered", 64 - DIGIT * digits).alias("prefix")).agg(F.sum("n").alias("n"))


def combined(*histograms: DataFrame) -> DataFrame:
    """Histograms of days, computed apart, as one. They must have the same number of digits and no record in common."""
    out = histograms[0]
    for h in histograms[1:]:
        out = out.unionByName(h)
    return out.groupBy("source", "feature", "part_day", "prefix").agg(F.sum("n").alias("n"))


def estimates(histogram: DataFrame, pcts: Sequence[int] = (50, 90, 99), digits: int = 2) -> DataFrame:
    """source, feature, pct, n_values, value from kept histograms: of the value of rank ceil(pct/100 * n) the lower edge of its digits."""
    group = ["source", "feature"]
    merged = histogram.groupBy(*group, "prefix").agg(F.sum("n").alias("n"))
    # counts of leading digits first: a window never orders more than one digit's prefixes
    lead = merged.groupBy(*group, F.shiftright("prefix", DIGIT * (digits - 1)).alias("lead")).agg(F.sum("n").alias("m"))
    w = Window.partitionBy(*group)
    lead = lead.withColumn("total", F.sum("m").over(w)).withColumn("upto", F.sum("m").over(w.orderBy("lead")))
    lead = lead.withColumn("pct", F.explode(F.array(*map(F.lit, pcts)))).withColumn("rank", F.greatest(F.lit(1), F.ceil(F.col("pct") * F.col("total") / 100)))
    lead = lead.filter("upto >= rank and upto - m < rank").select(*group, "lead", "pct", "total", (F.col("rank") - F.col("upto") + F.col("m")).alias("rank"))
    inside = merged.withColumn("lead", F.shiftright("prefix", DIGIT * (digits - 1)))
    inside = inside.withColumn("upto", F.sum("n").over(Window.partitionBy(*group, "lead").orderBy("prefix")))
    found = inside.join(maybe_broadcast(lead), [*group, "lead"]).filter("upto >= rank and upto - n < rank")
    return found.select(*group, "pct", F.col("total").alias("n_values"), value_of(F.shiftleft("prefix", 64 - DIGIT * digits)).alias("value"))


def value_of(key: Column) -> Column:
    """The doubles of ordered integers, whole batches at a time."""

    @F.arrow_udf("double")
    def run(k: pa.Array) -> pa.Array:
        return pa.array(from_ordered(k.to_numpy(zero_copy_only=False)))

    return run(key)


def percentiles(values: DataFrame, pcts: Sequence[int] = (50, 90, 99), digits: int = 4) -> DataFrame:
    """source, feature, pct, n_values, value: the element of rank ceil(pct/100 * n) of each group.

    ``values`` as :func:`ordered_values` gives them. digits=4 follows all 64 bits (exact); with fewer
    the value is the lower edge of the last digit. Ties are counted, an empty input gives no rows.
    """
    values = cut(values)
    group = ["source", "feature"]
    follow = None
    for k in range(1, digits + 1):
        if follow is None:
            days = day_histograms(values, 1)
        else:
            part = values.withColumn("before", F.shiftright("ordered", 64 - DIGIT * (k - 1)))
            wanted = maybe_broadcast(follow.select(*group, F.col("prefix").alias("before")).distinct())
            days = day_histograms(part.join(wanted, [*group, "before"]), k)
        merged = days.groupBy(*group, "prefix").agg(F.sum("n").alias("n"))
        # a group has at most 65,536 digits behind each of its followed prefixes
        if follow is None:
            w = Window.partitionBy(*group)
            found = merged.withColumn("total", F.sum("n").over(w)).withColumn("upto", F.sum("n").over(w.orderBy("prefix")))
            found = found.withColumn("pct", F.explode(F.array(*map(F.lit, pcts)))).withColumn("rank", F.greatest(F.lit(1), F.ceil(F.col("pct") * F.col("total") / 100)))
        else:
            merged = merged.withColumn("before", F.shiftright("prefix", DIGIT))
            w = Window.partitionBy(*group, "before").orderBy("prefix")
            found = merged.withColumn("upto", F.sum("n").over(w)).join(follow.withColumnRenamed("prefix", "before"), [*group, "before"])
        follow = cut(found.filter("upto >= rank and upto - n < rank").select(*group, "pct", "total", "prefix", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank")))
    return follow.select(*group, "pct", F.col("total").alias("n_values"), value_of(F.shiftleft("prefix", 64 - DIGIT * digits) if digits < 4 else F.col("prefix")).alias("value"))


def outside_limits(found: DataFrame, limits: DataFrame, min_values: int = 30) -> DataFrame:
    """Percentiles below ``lo`` or above ``hi`` of their (feature, pct), in groups of at least min_values values."""
    lim = limits.select("feature", "pct", "lo", "hi")
    return found.filter(F.col("n_values") >= min_values).join(maybe_broadcast(lim), ["feature", "pct"]).filter("value < lo or value > hi").select("source", "feature", "pct", "value", "lo", "hi", "n_values")
