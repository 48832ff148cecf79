"""Queries of the general data operators (rejected lines)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovelight.sources import record_lines as rl
from grovelight.sources.tables import table


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    return rl.parse_lines(table(spark, d, "raw_lines"), table(spark, d, "raw_files"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return rl.rejected_lines(_parsed(spark, d)).select("line_id")


def p3_rejected(spark: SparkSession, d: str) -> DataFrame:
    return rl.rejected_lines(_parsed(spark, d))


def p3_records(spark: SparkSession, d: str) -> DataFrame:
    return rl.valid_records(_parsed(spark, d))


def p3_values(spark: SparkSession, d: str) -> DataFrame:
    """Every value of the valid records."""
    r = p3_records(spark, d)
    e = r.select("line_id", "label", F.explode(F.arrays_zip(F.col("idx").alias("feature"), F.col("val").alias("value"))).alias("e"))
    return e.select("line_id", "label", "e.feature", "e.value")


QUERIES = {f.__name__: f for f in (p3_found, p3_rejected, p3_records, p3_values)}

_N = "[+-]?[0-9]+([.][0-9]+)?([eE][+-]?[0-9]+)?"
_PARSED = rf"""
with l as (select line_id, fmt, num_features as nf, num_classes as nc, trim(raw_line) as s from raw_lines join raw_files using (file_id)),
     r as (select * from l where s <> '' and s[1] <> '#' and not (fmt = 'ARFF' and s[1] in ('%', '@'))),
     svm as (select line_id, nf, nc, list_filter(string_split(s, ' '), lambda x: x <> '') as p from r where fmt = 'LIBSVM'),
     svm2 as (select *, p[1] as label, list_filter(p[2:], lambda x: not regexp_full_match(x, '[0-9]+:({_N}|NaN)')) as odd,
                     list_transform(p[2:], lambda x: try_cast(split_part(x, ':', 1) as double)) as k,
                     list_transform(p[2:], lambda x: coalesce(try_cast(split_part(x, ':', 2) as double), 0)) as v from svm),
     arff as (select line_id, nf, nc, list_transform(string_split(s, ','), lambda x: trim(x)) as p from r where fmt = 'ARFF'),
     arff2 as (select line_id, nf, nc, list_transform(p, lambda x: case when regexp_full_match(x, '\x27[^\x27"]*\x27|"[^\x27"]*"') then trim(x[2:-2]) else x end) as q from arff),
     flat as (select line_id, nc, label, len(odd) = 0 and len(list_filter(v, lambda x: isinf(x))) = 0
                     and len(list_filter(k, lambda x: x is null or x < 1 or x > nf)) = 0 and k = list_sort(list_distinct(k)) as ok from svm2
              union all
              select line_id, nc, q[-1], len(q) = nf + 1 and len(list_filter(q[:-2], lambda x: not (x in ('NaN', '?', '') or regexp_full_match(x, '{_N}')))) = 0
                     and len(list_filter(q[:-2], lambda x: isinf(coalesce(try_cast(x as double), 0)))) = 0 from arff2)
"""
_BAD = rf"""
select line_id from flat
where not (coalesce(ok, true) and regexp_full_match(label, '{_N}') and not isinf(coalesce(try_cast(label as double), 0))
           and coalesce(try_cast(label as double) = floor(try_cast(label as double)) and try_cast(label as double) < nc, false))
"""
_REJECTED = _PARSED + _BAD
_VALUES = f"""{_PARSED}, bad as ({_BAD}),
     pairs as (select line_id, label, unnest(list_zip(k, list_transform(p[2:], lambda x: split_part(x, ':', 2)))) as t from svm2 where line_id not in (select line_id from bad)),
     cells as (select line_id, q[-1] as label, unnest(list_zip(range(len(q) - 1), q[:-2])) as t from arff2 where line_id not in (select line_id from bad)),
     every as (select line_id, label, cast(t[1] - 1 as int) as feature, t[2] as v from pairs union all select line_id, label, cast(t[1] as int), t[2] from cells)
select line_id, cast(greatest(0, cast(label as double)) as int) as label, feature, case when v in ('', '?', 'NaN') then null else cast(v as double) end as value from every"""
SQL = {
    "p3_found": _REJECTED,
    "p3_values": _VALUES,
}
