"""Mixing sources to target weights by repetition rates."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovelight.sources.tables import cut, maybe_broadcast

#: Place of the public vocabulary and the splitting pattern published with it.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def tokenizer(path: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
    return tiktoken.Encoding("mix", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_tokens(docs: DataFrame, text: str = "text", path: str = VOCABULARY, keep: tuple[str, ...] = ("doc_id", "source")) -> DataFrame:
    """``keep`` and ``tokens``, the number of tokens of the whole text; a NULL or empty text has 0."""

    @F.arrow_udf("long")
    def count(col: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode = tokenizer(path).encode_ordinary
        for c in col:
            yield pa.array([len(encode(t)) if t else 0 for t in c.to_pylist()], pa.int64())

    return docs.select(*keep, count(F.col(text).cast("string")).alias("tokens"))


def mix_plan(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Per mix and source: size, wanted and given tokens, rate, short, target and expected share.

    ``sizes``: source, size. rate = wanted / size, at most max_repeats; ``short`` where size *
    max_repeats < wanted. A source without documents has size 0, rate 0; a target with a NULL weight
    or cap counts as 0; NULL sources count in the total only, as no target names them.
    """
    total = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total"))
    named = maybe_broadcast(sizes.filter("source is not null").select(F.col("source").alias("s"), "size"), 100_000)
    t = targets.select("mix_id", "source", F.coalesce("target_weight", F.lit(0.0)).alias("target_weight"), F.coalesce("max_repeats", F.lit(0)).alias("max_repeats"), F.coalesce("budget_share", F.lit(0.0)).alias("budget_share"))
    p = t.join(named, F.col("source") == F.col("s"), "left").drop("s").join(F.broadcast(total), F.lit(True))  # one row
    p = p.withColumn("size", F.coalesce("size", F.lit(0))).withColumn("wanted", F.col("target_weight") * F.col("budget_share") * F.col("total"))
    p = p.withColumn("most", F.col("size") * F.col("max_repeats")).withColumn("short", F.col("most") < F.col("wanted"))
    return p.withColumn("rate", F.when(F.col("size") > 0, F.least(F.col("wanted") / F.col("size"), F.col("max_repeats").cast("double"))).otherwise(0.0))


def copies_of(sized: DataFrame, plan: DataFrame, seed: int = 17) -> DataFrame:
    """mix_id, source, doc_id, tokens, copies: floor(rate) copies and one more with the chance of the rest.

    The chance is decided by the digest of (seed, mix, doc_id), so the draw is the same on any cluster
    and in any order. Only rows with at least one copy come out. The plan is joined by broadcast
    where it has few rows, so a source that holds most documents is not shuffled to one task.
    """
    rates = maybe_broadcast(plan.filter("rate > 0").select("mix_id", "source", "rate", "max_repeats"))
    # 52 bits of a digest that every SQL engine has
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "mix_id", F.col("doc_id").cast("string"))), 1, 13), 16, 10).cast("long") / float(1 << 52)
    whole = F.floor("rate")
    out = sized.join(rates, "source").withColumn("copies", F.least(whole + (u < F.col("rate") - whole).cast("long"), F.col("max_repeats").cast("long")))
    return out.filter("copies > 0").select("mix_id", "source", "doc_id", "tokens", "copies")


def emit(copies: DataFrame) -> DataFrame:
    """One row per copy: mix_id, source, doc_id, tokens, copy_no from 1."""
    return copies.select("mix_id", "source", "doc_id", "tokens", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy_no"))


def shares(copies: DataFrame, plan: DataFrame) -> DataFrame:
    """mix_id, source, target_weight, reached_share, tokens, docs, short: what the mix came to."""
    got = copies.groupBy("mix_id", "source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("docs"))
    whole = got.groupBy("mix_id").agg(F.sum("tokens").alias("mix_tokens"))
    out = plan.select("mix_id", "source", "target_weight", "rate", "short").join(got, ["mix_id", "source"], "left").join(whole, "mix_id", "left")
    return out.select("mix_id", "source", "target_weight", F.coalesce(F.col("tokens") / F.col("mix_tokens"), F.lit(0.0)).alias("reached_share"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("docs", F.lit(0)).alias("docs"), "rate", "short")


def mixed(docs: DataFrame, targets: DataFrame, path: str = VOCABULARY, size: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The copies and the plan. Every document is tokenised once; ``size`` names a column to take instead of token counts."""
    sized = cut(with_tokens(docs, path=path)) if size is None else docs.select("doc_id", "source", F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("tokens"))
    plan = cut(mix_plan(cut(sized.groupBy("source").agg(F.sum("tokens").alias("size"))), targets))  # rows per source, rows per target
    return copies_of(sized, plan), plan
