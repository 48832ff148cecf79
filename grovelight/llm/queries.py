"""Queries of the training-data operators of this subpackage, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovelight.llm import abuse, contamination, mixing, quota_sampling, split_overlap
from grovelight.llm import radix_percentiles as rp
from grovelight.llm import term_stats as ts
from grovelight.sources.tables import cut, table


def _allocation(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = quota_sampling.usable_rows(table(spark, d, "raw_data_labeled"))
    return rows, cut(quota_sampling.allocation(quota_sampling.counted(rows), table(spark, d, "label_targets")))  # one row per target


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_report(spark, d).filter("short").select("plan_id", "label_id")


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return quota_sampling.report(*_allocation(spark, d))


def p1_sample(spark: SparkSession, d: str) -> DataFrame:
    return quota_sampling.draw(*_allocation(spark, d))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return split_overlap.overlaps(table(spark, d, "raw_data_labeled")).select("row_id_a", "row_id_b")


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return split_overlap.overlap_report(p2_coverage(spark, d))


def p2_coverage(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "raw_data_labeled")
    return split_overlap.coverage(split_overlap.linked(split_overlap.records(rows)), rows)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return ts.marked_terms(table(spark, d, "raw_data_sparse")).filter("mark <> 'kept'").select("kind", "term")


def p4_term_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return ts.marked_terms(table(spark, d, "raw_data_sparse"))


def _percentiles(spark: SparkSession, d: str) -> DataFrame:
    return rp.percentiles(rp.ordered_values(table(spark, d, "raw_data_sparse")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return rp.outside_limits(_percentiles(spark, d), table(spark, d, "feature_limits")).select("source", "feature", "pct")


def p5_kept_days(spark: SparkSession, d: str) -> DataFrame:
    """Estimates from the histograms of days (two digits), held against the exact values: their ranks are exact, their values within 2**-19."""
    values = cut(rp.ordered_values(table(spark, d, "raw_data_sparse")))
    kept = rp.estimates(rp.combined(cut(rp.day_histograms(values, 2))))
    exact = rp.percentiles(values).select("source", "feature", "pct", F.col("n_values").alias("n"), F.col("value").alias("exact"))
    near = (F.abs(F.col("value") - F.col("exact")) <= F.abs("exact") * 2.0**-19) & (F.col("n") == F.col("n_values"))
    return kept.join(exact, ["source", "feature", "pct"]).select("source", "feature", "pct", "n_values", near.alias("within"))


def p5_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return _percentiles(spark, d).select("source", "feature", "pct", "n_values", "value")


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return contamination.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("item_id", "doc_id")


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return contamination.leak_report(_leaks(spark, d), table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_shares(spark, d).filter("short").select("mix_id", "source")


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(*mixing.mixed(table(spark, d, "documents"), table(spark, d, "mix_targets")))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.emit(mixing.mixed(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0])


def p7_shares_by_chars(spark: SparkSession, d: str) -> DataFrame:
    """Shares of mixes whose sizes are characters, which SQL can count."""
    s = mixing.shares(*mixing.mixed(table(spark, d, "documents"), table(spark, d, "mix_targets"), size="n_chars"))
    return s.select("mix_id", "source", "tokens", "docs", F.round("rate", 6).alias("rate"), F.round("reached_share", 6).alias("reached_share"), "short")


def p7_mix_by_chars(spark: SparkSession, d: str) -> DataFrame:
    return mixing.emit(mixing.mixed(table(spark, d, "documents"), table(spark, d, "mix_targets"), size="n_chars")[0])


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return abuse.abusive(abuse.scored(table(spark, d, "documents"), table(spark, d, "doc_labels"))).select("doc_id")


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    return abuse.scored(table(spark, d, "documents"), table(spark, d, "doc_labels"))


def p8_rates(spark: SparkSession, d: str) -> DataFrame:
    return abuse.rates(abuse.scored(table(spark, d, "documents"), table(spark, d, "doc_labels")))


QUERIES = {f.__name__: f for f in (p1_found, p1_report, p1_sample, p2_found, p2_report, p2_coverage, p4_found, p4_term_frequencies, p5_found, p5_percentiles, p5_kept_days, p6_found, p6_report, p7_found, p7_shares, p7_mix, p7_shares_by_chars, p7_mix_by_chars, p8_found, p8_scores, p8_rates)}

_USABLE = """
with u as (select row_id, cast(greatest(label, 0) as int) as label_id from raw_data_labeled
           where split_name = 'train' and label is not null and not isnan(label) and greatest(label, 0) <= 11),
     c as (select label_id, count(*) as available from u group by label_id),
     n as (select count(*) as usable from u),
     t as (select t.plan_id, t.label_id, t.target_share, t.min_rows, coalesce(available, 0) as available,
                  target_share * (sample_share * usable) as wanted,
                  (cast(round(sample_share * 1000000) as bigint) * usable + 500000) // 1000000 as size, cast(round(target_share * 1000000) as bigint) as micro
           from n, label_targets t left join c on c.label_id = t.label_id)
"""


def _dealt(tag: str, room: str) -> str:
    """Quotas of the binary label tree, level by level: every node shares its quota between two children, in whole numbers."""
    out = [
        f"l{tag} as (select plan_id, label_id, size, cast({room} as hugeint) as room, cast(least(min_rows, {room}) as hugeint) as kept, cast(greatest(0, micro * size - cast(min_rows as bigint) * 1000000) + 1 as hugeint) as weight from t)",
        f"q{tag}4 as (select plan_id, 0 as node, least(greatest(max(size), sum(kept)), sum(room)) as q from l{tag} group by plan_id)",
    ]
    for k in (3, 2, 1, 0):
        side = ", ".join(f"coalesce(sum({c}) filter ((label_id >> {k}) & 1 = {b}), 0) as {c}{b}" for c in ("room", "kept", "weight") for b in (0, 1))
        out += [
            f"a{tag}{k} as (select l.plan_id, label_id >> {k + 1} as node, max(q) as q, {side} from l{tag} l join q{tag}{k + 1} q on q.plan_id = l.plan_id and q.node = label_id >> {k + 1} group by l.plan_id, label_id >> {k + 1})",
            f"b{tag}{k} as (select *, q - kept0 - kept1 as f, weight0 + weight1 as w from a{tag}{k})",
            f"d{tag}{k} as (select *, kept0 + (f * weight0) // w + case when (f * weight0) % w >= (f * weight1) % w then f - (f * weight0) // w - (f * weight1) // w else 0 end as want0 from b{tag}{k})",
            f"e{tag}{k} as (select *, least(room0, greatest(want0, q - room1)) as q0 from d{tag}{k})",
            f"q{tag}{k} as (select plan_id, 2 * node as node, q0 as q from e{tag}{k} union all select plan_id, 2 * node + 1, q - q0 from e{tag}{k})",
        ]
    return ", ".join(out)


_ALLOCATED = _USABLE + f", {_dealt('x', 'available')}, {_dealt('y', '1000000000000000')}" + """,
     alloc as (select t.*, cast(x.q as bigint) as quota, cast(greatest(0, y.q - available) as bigint) as passed, cast(greatest(0, x.q - least(y.q, available)) as bigint) as received,
                      available < min_rows or available < wanted as short
               from t join qx0 x on x.plan_id = t.plan_id and x.node = label_id join qy0 y on y.plan_id = t.plan_id and y.node = label_id),
     a0 as (select row_id, label_id, (((row_id % 2147483647) + 2147483647) % 2147483647 * 48271 + 11) % 2147483647 as a from u),
     o as (select row_id, label_id, ((a % 46337) * 46309 + a // 46337 * 7919 + 13) % 2147483647 as place from a0),
     k as (select *, row_number() over (partition by label_id order by place, row_id) as k from o),
     s as (select plan_id, alloc.label_id, row_id from alloc join k on k.label_id = alloc.label_id and k.k <= quota),
     g as (select plan_id, label_id, count(*) as drawn from s group by plan_id, label_id),
     r as (select plan_id, label_id, target_share, min_rows, available, wanted, quota, passed, received, short, coalesce(drawn, 0) as drawn, cast(sum(coalesce(drawn, 0)) over (partition by plan_id) as bigint) as sample_rows
           from alloc left join g using (plan_id, label_id))
"""
_TERMS = """
with x as (select row_id, 'idx' as kind, cast(unnest(idx) as bigint) as term from raw_data_sparse where row_id is not null
           union all
           select row_id, 'val' as kind, cast(round(v * 1000) as bigint) as term
           from (select row_id, unnest(val) as v from raw_data_sparse where row_id is not null) where v is not null and not isnan(v)),
     n as (select count(distinct row_id) as n_records from raw_data_sparse),
     t as (select kind, term, count(distinct row_id) as docs, count(*) as occurrences from x where term is not null group by kind, term),
     m as (select kind, term, docs, occurrences, n_records,
                  case when docs < 3 then 'rare' when docs > 0.7 * n_records then 'common' else 'kept' end as mark from t, n)
"""
_PCT = """
with c as (select row_id, source, part_day, idx, val,
                  row_number() over (partition by row_id order by part_day, source) as k
           from raw_data_sparse where source is not null and row_id is not null),
     e as (select source, unnest(idx) as feature, unnest(val) as v from c where k = 1),
     g as (select source, feature, count(*) as n_values, quantile_disc(v, [0.5, 0.9, 0.99]) as q
           from e where feature between 0 and 7 and v is not null and not isnan(v) group by source, feature),
     p as (select source, feature, n_values, unnest([50, 90, 99]) as pct, unnest(q) as value from g)
"""
_MIX = """
with s as (select source, cast(sum(coalesce(n_chars, 0)) as bigint) as size from documents group by source),
     t as (select mix_id, t.source, max_repeats, coalesce(size, 0) as size, target_weight * budget_share * (select sum(size) from s) as wanted from mix_targets t left join s on s.source = t.source),
     p as (select *, size * max_repeats < wanted as short, case when size > 0 then least(wanted / size, cast(max_repeats as double)) else 0.0 end as rate from t),
     u as (select mix_id, p.source, doc_id, coalesce(n_chars, 0) as tokens, rate, max_repeats, cast('0x' || substr(md5('17:' || mix_id || ':' || doc_id), 1, 13) as bigint) / 4503599627370496.0 as u from p join documents d on d.source = p.source where rate > 0),
     c as (select *, least(cast(floor(rate) as bigint) + case when u < rate - floor(rate) then 1 else 0 end, max_repeats) as copies from u),
     g as (select mix_id, source, cast(sum(tokens * copies) as bigint) as tokens, count(*) as docs from c where copies > 0 group by mix_id, source),
     m as (select mix_id, sum(tokens) as mix_tokens from g group by mix_id)
"""
_PAIRS = """
with r as (select row_id, split_name, source, list_transform(features, lambda x: case when isnan(x) then null else x end) as f from raw_data_labeled where row_id is not null and split_name is not null),
     p as (select t.row_id as t_id, e.row_id as e_id, e.split_name, e.source,
                  list_transform(range(1, 23), lambda i: case when (t.f[i] is null and e.f[i] is null) or abs(t.f[i] - e.f[i]) <= greatest(0.005 * greatest(abs(t.f[i]), abs(e.f[i])), 0.01) then 1 else 0 end) as same
           from r t, r e where t.split_name = 'train' and e.split_name <> 'train'),
     g as (select * from p where list_sum(same) >= 20)
"""
_PLAIN = "text"
for _entity, _sign in (("amp", "&"), ("lt", "<"), ("gt", ">"), ("nbsp", " "), ("quot", '"')):
    _PLAIN = f"replace({_PLAIN}, '&{_entity};', '{_sign}')"
_PLAIN = f"regexp_replace({_PLAIN}, '</?(?:b|i|u|s|em|strong|span|a|font|sup|sub|small|big|mark|wbr|code|tt)(?:\\s[^<>]*)?/?>', '', 'gi')"
_PLAIN = f"regexp_replace({_PLAIN}, '<!--.*?-->|</?[a-zA-Z!?][^<>]*>', ' ', 'gs')"
_PLAIN = f"regexp_replace({_PLAIN}, '[\u00ad\u200b\u200c\u200d\u2060\ufeff]', '', 'g')"
_WORDS = f"regexp_extract_all(lower({_PLAIN}), '[\\p{{L}}\\p{{N}}]+')"
#: Pairs by the rule itself. Items have at most 120 words, so that a set of their words fits a whole number of 128 bits.
_LEAKED = f"""
with i as (select item_id, w, len(w) as n, cast(ceil(len(w) * 2 / 3.0) as bigint) as least, cast(floor(len(w) * 1.5) as bigint) as width, (cast(1 as hugeint) << len(w)) - 1 as whole
           from (select item_id, {_WORDS} as w from (select item_id, item_text as text from eval_items))),
     d as (select doc_id, w from (select doc_id, {_WORDS} as w from documents)),
     ir as (select distinct item_id, array_to_string(w[k:k + 11], ' ') as run from (select item_id, w, unnest(range(1, n - 10)) as k from i)),
     dr as (select distinct doc_id, array_to_string(w[k:k + 11], ' ') as run from (select doc_id, w, unnest(range(1, len(w) - 10)) as k from d)),
     passages as (select distinct item_id, doc_id from ir join dr on dr.run = ir.run),
     iw as (select item_id, w, k, row_number() over (partition by item_id, w order by k) as r from (select item_id, unnest(w) as w, unnest(range(n)) as k from i)),
     dw as (select doc_id, w, p, row_number() over (partition by doc_id, w order by p) as r from (select doc_id, unnest(w) as w, unnest(range(len(w))) as p from d) where w in (select w from iw)),
     c as (select item_id, doc_id, count(*) as common from iw join dw on dw.w = iw.w and dw.r = iw.r group by item_id, doc_id),
     near as (select c.item_id, c.doc_id from c join i on i.item_id = c.item_id where common >= least),
     m as (select item_id, w, cast(sum(cast(1 as hugeint) << k) as hugeint) as bits from iw group by item_id, w),
     l as (select near.item_id, near.doc_id, list(p order by p) as ps, list(bits order by p) as ms from near join m on m.item_id = near.item_id join dw on dw.doc_id = near.doc_id and dw.w = m.w group by near.item_id, near.doc_id),
     s as (select l.item_id, doc_id, least, n, whole, ms[j:j + len(list_filter(ps, lambda p: p >= ps[j] and p < ps[j] + width)) - 1] as seq from (select *, unnest(range(1, len(ps) + 1)) as j from l) l join i on i.item_id = l.item_id),
     e as (select distinct item_id, doc_id from s where len(seq) >= least and n - bit_count(list_reduce(seq, lambda row, b: ((row + (row & b)) | (row - (row & b))) & whole, whole)) >= least),
     leaked as (select * from passages union select * from e)
"""
SQL = {
    "p6_found": _LEAKED + "select item_id, doc_id from leaked",
    "p6_report": _LEAKED + "select suite, held_split, source, count(distinct item_id) as n_items, count(distinct doc_id) as n_docs from leaked join documents using (doc_id) join eval_items using (item_id) group by suite, held_split, source",
    "p1_found": _USABLE + "select plan_id, label_id from t where available < min_rows or available < wanted",
    "p1_report": _ALLOCATED + "select *, round(case when sample_rows > 0 then drawn * 1.0 / sample_rows else 0.0 end, 6) as reached_share from r",
    "p1_sample": _ALLOCATED + "select plan_id, label_id, row_id from s",
    "p4_found": _TERMS + "select kind, term from m where mark <> 'kept'",
    "p4_term_frequencies": _TERMS + "select kind, term, docs, occurrences, n_records, mark from m",
    "p5_found": _PCT + "select p.source, p.feature, p.pct from p join feature_limits l on l.feature = p.feature and l.pct = p.pct where n_values >= 30 and (value < lo or value > hi)",
    "p5_percentiles": _PCT + "select source, feature, pct, n_values, value from p",
    "p5_kept_days": _PCT + "select source, feature, pct, n_values, true as within from p",
    "p7_found": _MIX + "select mix_id, source from p where short",
    "p7_shares_by_chars": _MIX + "select p.mix_id, p.source, coalesce(g.tokens, 0) as tokens, coalesce(docs, 0) as docs, round(rate, 6) as rate, round(coalesce(g.tokens * 1.0 / mix_tokens, 0.0), 6) as reached_share, short from p left join g on g.mix_id = p.mix_id and g.source = p.source left join m on m.mix_id = p.mix_id",
    "p7_mix_by_chars": _MIX + "select mix_id, source, doc_id, tokens, cast(unnest(range(1, copies + 1)) as bigint) as copy_no from c where copies > 0",
    "p2_found": _PAIRS + "select least(t_id, e_id) as row_id_a, greatest(t_id, e_id) as row_id_b from g",
    "p2_coverage": _PAIRS + ", u as (select e_id, split_name, source, t_id, unnest(same) as hit, unnest(range(22)) as i from g), m as (select e_id, split_name, source, i, max(hit) as hit, count(*) as n from u group by e_id, split_name, source, i) select e_id as row_id, split_name, source, max(n) as train_rows, cast(sum(hit) as int) as covered from m group by e_id, split_name, source",
    "p2_report": _PAIRS + "select split_name, source, count(*) as pairs, count(distinct e_id) as eval_rows from g group by split_name, source",
}
