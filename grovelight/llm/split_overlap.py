"""The same or nearly the same record in the training split and in an evaluation split.

Every record becomes a normalised text of one letter per position: the letter names the position and
a bin of its value, on a grid on which two values that agree lie at most one bin border apart. A text
is cut into one segment more than positions may disagree, so of two matching records at least one
segment agrees as a whole. The segments of evaluation records are passages (one for each side of the
bin borders that a value is close to). Passages are dealt to shards by hash; each shard builds one
Aho-Corasick automaton over its passages and scans with it the whole training texts that can hold one
of them. Matched intervals are merged per pair, pairs are verified position by position, and what
of an evaluation record is covered by training records comes out beside the pairs.

A passage of many evaluation records is not matched at once: both sides go on to a next round, in
which a segment of the remaining positions must agree as well, by the same argument. Passages shared
by a fixed share of all records are extended before they are dealt, so no shard holds most rows.
Exact copies are reduced to one representative first.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grovelight.sources.tables import cut

PARTS = pa.schema([("shard", pa.int32()), ("is_train", pa.bool_()), ("rep", pa.int64()), ("prefix", pa.int64()), ("mask", pa.int64()), ("part", pa.int64()), ("text", pa.string())])
PARTS_DDL = "shard int, is_train boolean, rep bigint, prefix bigint, mask bigint, part bigint, text string"
COUNTS = pa.schema([("part", pa.int64()), ("is_train", pa.bool_()), ("n", pa.int64())])
COUNTS_DDL = "part bigint, is_train boolean, n bigint"
FOUND = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("mask", pa.int64())])
FOUND_DDL = "kind int, a bigint, b bigint, mask bigint"
HIT, NEXT_TRAIN, NEXT_EVAL = 0, 1, 2  # a hit: training and evaluation record; else record and passage to go on with
BIN = 8.0  # widths of the tolerance per bin
SHIFT = 2.0  # puts 0, 1 and 2 inside a bin
SLACK = 1.01  # tolerances by which agreeing values differ at most on the grid, with rounding
FIRST, LAST = 0xE000, 0x110000  # letters in use, beyond the surrogates
SHARED = 32  # evaluation records of one passage that are matched at once
#: Odd multipliers of the hashes.
MULTIPLY, STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def grid(v: np.ndarray, rel: float, low: float) -> np.ndarray:
    """Monotone scale on which values that agree differ by about 1 at most."""
    turn = low / rel
    a = np.abs(v)
    far = turn / low + np.log(np.maximum(a, turn) / turn) / -math.log1p(-rel)
    return np.copysign(np.where(a <= turn, a / low, far), v)


def letters(x: np.ndarray, rel: float, low: float) -> tuple[np.ndarray, np.ndarray]:
    """Of each element of a matrix the letter of its bin, and that of the other bin which agreeing values can fall into (its own if there is none).

    Missing (NaN) has a letter of its own, as has each infinity. Should there be more bins than letters
    for a position, distant bins share one, which the verification sorts out.
    """
    n = x.shape[1]
    width = (LAST - FIRST) // n
    odd = ~np.isfinite(x)
    g = grid(np.where(odd, 0.0, x), rel, low) + SHIFT
    own, first, last = (np.floor(y / BIN).astype(np.int64) for y in (g, g - SLACK, g + SLACK))
    alt = np.where(first != own, first, last)
    special = np.where(np.isnan(x), width - 1, np.where(x > 0, width - 2, width - 3))
    base = FIRST + np.arange(n) * width
    return tuple((base + np.where(odd, special, b % (width - 3))).astype(np.uint32) for b in (own, alt))


def text_order(n: int, ways: int) -> list[int]:
    """Positions in the order of the text: neighbours in the record come into different segments."""
    return [p for j in range(ways) for p in range(j, n, ways)]


def part_hash(prefix: np.ndarray, seg: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = prefix.astype(np.uint64) * MULTIPLY
        for k in range(seg.shape[1]):
            h = (h ^ (h >> np.uint64(29))) * STEP + seg[:, k].astype(np.uint64) * MULTIPLY
        h = (h ^ (h >> np.uint64(32))) * STEP
    return (h ^ (h >> np.uint64(31))).view(np.int64)


def strings(codes: np.ndarray) -> np.ndarray:
    codes = np.ascontiguousarray(codes)
    return codes.view(f"<U{codes.shape[1]}").ravel() if codes.size else np.zeros(len(codes), "<U1")


def segments(own: np.ndarray, alt: np.ndarray | None, prefix: np.ndarray, mask: np.ndarray, ways: int, hot: np.ndarray, at: np.ndarray | None = None) -> Iterator[tuple]:
    """(rows, prefix, mask, part, letters of the segment or None) of every segment; hot ones are extended. alt is None for training texts."""
    at = np.arange(len(own)) if at is None else at
    n = own.shape[1]
    for m in np.unique(mask):
        here = np.flatnonzero(mask == m)
        left = np.array([k for k in range(n) if not int(m) >> k & 1])
        for seg in np.array_split(left, ways):
            rows, codes = here, own[at[here]][:, seg]
            if alt is not None:
                other = alt[at[here]][:, seg]
                for k in range(len(seg)):
                    two = np.flatnonzero(other[:, k] != codes[:, k])
                    extra = codes[two].copy()
                    extra[:, k] = other[two, k]
                    rows, codes, other = np.r_[rows, rows[two]], np.r_[codes, extra], np.r_[other, other[two]]
            part = part_hash(prefix[rows], codes)
            go_on = np.isin(part, hot) if len(hot) and len(left) - len(seg) >= ways else np.zeros(len(part), bool)
            if go_on.any():
                r = rows[go_on]
                yield from segments(own, alt, part[go_on], mask[r] | np.int64(sum(1 << int(k) for k in seg)), ways, hot, at[r])
            r = rows[~go_on]
            yield at[r], prefix[r], mask[r], part[~go_on], left, None if alt is None else codes[~go_on]


def _sides(b: pa.RecordBatch, n: int, ways: int, rel: float, low: float, hot: np.ndarray) -> Iterator[tuple]:
    train = b.column(0).to_numpy(zero_copy_only=False).astype(bool)
    rep, prefix, mask = (b.column(k).to_numpy(zero_copy_only=False) for k in (1, 3, 4))
    x = b.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, n)  # NULL becomes NaN
    own, alt = letters(x[:, text_order(n, ways)], rel, low)
    for side in (True, False):
        at = np.flatnonzero(train == side)
        if len(at):
            for rows, *rest in segments(own[at], None if side else alt[at], prefix[at], mask[at], ways, hot):
                if len(rows):
                    yield side, rep[at[rows]], own[at[rows]], *rest


def _emit(n: int, ways: int, rel: float, low: float, shards: int, hot: np.ndarray):
    """Passages of evaluation records, and for each segment of a training record its text (what of it is not matched yet)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for side, rep, own, prefix, mask, part, left, codes in _sides(b, n, ways, rel, low, hot):
                text = strings(own[:, left] if side else codes)
                shard = (part.view(np.uint64) % np.uint64(shards)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(np.full(len(rep), side)), pa.array(rep), pa.array(prefix), pa.array(mask), pa.array(part), pa.array(text.tolist(), pa.string())], schema=PARTS)

    return run


def _count(n: int, ways: int, rel: float, low: float, hot: np.ndarray):
    """Records of each part, summed up per batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for side in (True, False):
                parts = [t[5] for t in _sides(b, n, ways, rel, low, hot) if t[0] == side]
                if parts:
                    part, k = np.unique(np.concatenate(parts), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.full(len(part), side)), pa.array(k)], schema=COUNTS)

    return run


class _Shard:
    """The passages of one shard, and its automaton once training texts come."""

    def __init__(self, n: int, ways: int, shared: int) -> None:
        self.n, self.ways, self.shared, self.width = n, ways, shared, (LAST - FIRST) // n
        self.passages: dict[tuple[int, str], list] = {}  # prefix, letters -> part, mask covered, records or None
        self.automaton = None

    def covered(self, mask: int, seg: str) -> int:
        for c in seg:
            mask |= 1 << (ord(c) - FIRST) // self.width
        return mask

    def add(self, rep: int, prefix: int, mask: int, part: int, seg: str, out: list) -> None:
        p = self.passages.get((prefix, seg))
        if p is None:
            p = self.passages[prefix, seg] = [part, self.covered(mask, seg), []]
        if p[2] is None:
            out.append((NEXT_EVAL, rep, p[0], p[1]))
            return
        p[2].append(rep)
        # with fewer positions left than segments all of them may disagree: every pair is looked at
        if len(p[2]) > self.shared and self.n - p[1].bit_count() >= self.ways:
            out += [(NEXT_EVAL, r, p[0], p[1]) for r in p[2]]
            p[2] = None

    def scan(self, rep: int, prefix: int, text: str, out: list) -> None:
        if self.automaton is None:
            import ahocorasick

            self.automaton = ahocorasick.Automaton()
            for _, seg in self.passages:
                self.automaton.add_word(seg, seg)
            self.automaton.make_automaton()
        for _, seg in self.automaton.iter(text):
            p = self.passages.get((prefix, seg))
            if p is None:
                continue
            if p[2] is None:
                out.append((NEXT_TRAIN, rep, p[0], p[1]))
            else:
                out += [(HIT, rep, e, p[1]) for e in p[2]]


def _scan(n: int, ways: int, shared: int):
    """Rows come by shard, passages before texts: one automaton at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, shard = None, None
        for b in batches:
            out: list = []
            for k, train, rep, prefix, mask, part, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if k != number:
                    number, shard = k, _Shard(n, ways, shared)
                if not train:
                    shard.add(rep, prefix, mask, part, text, out)
                elif shard.passages:
                    shard.scan(rep, prefix, text, out)
                if len(out) > 50_000:
                    yield _found(out)
                    out = []
            if out:
                yield _found(out)

    return run


def _found(out: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), FOUND, strict=True)], schema=FOUND)


def agreeing(a: Column, b: Column, rel: float, low: float) -> Column:
    """Bit mask of the positions that agree: both missing, or present and within the tolerance."""

    def one(x: Column, y: Column) -> Column:
        near = F.abs(x - y) <= F.greatest(rel * F.greatest(F.abs(x), F.abs(y)), F.lit(low))
        return F.when(x.isNull() & y.isNull(), True).when(x.isNull() | y.isNull(), False).otherwise((x == y) | near)

    bits = F.transform(F.zip_with(a, b, one), lambda ok, i: F.when(ok, F.expr("1L") * F.pow(F.lit(2.0), i).cast("long")).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda s, v: s + v)


def records(df: DataFrame, train: str = "train", positions: int = 22) -> DataFrame:
    """row_id, is_train, features (cleaned, of fixed length), key (their hash) of the rows with row_id and split."""
    clean = F.transform(F.sequence(F.lit(0), F.lit(positions - 1)), lambda i: F.get(F.coalesce("features", F.array().cast("array<double>")), i))
    clean = F.transform(clean, lambda v: F.when(~F.isnan(v), v + F.lit(0.0)))
    rows = df.filter("row_id is not null and split_name is not null").select(F.col("row_id").cast("long").alias("row_id"), (F.col("split_name") == train).alias("is_train"), clean.alias("features"))
    return rows.withColumn("key", F.xxhash64("features"))


def linked(rows: DataFrame, least: int = 20, positions: int = 22, rel: float = 0.005, low: float = 0.01, hot_share: float = 0.001, hot_least: int = 2000, shared: int = SHARED) -> DataFrame:
    """Pairs of distinct records, one row per pair of representatives: t_key, tf, e_key, ef, agree, mask (bits of the agreeing positions), covered (merged intervals that the scan found).

    ``rows`` as :func:`records` gives them; together with them as the membership of the
    representatives (join on key and features) this is the whole result.
    """
    spark, ways = rows.sparkSession, positions - least + 1
    reps = cut(rows.groupBy("is_train", "key", "features").agg(F.min("row_id").alias("rep")))
    n = max(1, reps.count())
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n / 20_000))
    state = reps.select("is_train", "rep", "features", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("mask"))
    hot = np.zeros(0, np.int64)
    limit = max(hot_least, math.ceil(hot_share * n))
    for _ in range(positions):  # at most one round per level of parts
        # each count is over hot_share of all records: their number is bounded by its inverse times the parts of a record
        counts = state.mapInArrow(_count(positions, ways, rel, low, hot), COUNTS_DDL).groupBy("part", "is_train").agg(F.sum("n").alias("n")).filter(F.col("n") > limit)
        new = np.setdiff1d(np.array([r.part for r in counts.select("part").distinct().toLocalIterator()], np.int64), hot)
        if not len(new):
            break
        hot = np.union1d(hot, new)
    hits = None
    while True:
        parts = state.mapInArrow(_emit(positions, ways, rel, low, shards, hot), PARTS_DDL).repartition("shard").sortWithinPartitions("shard", "is_train")
        found = cut(parts.mapInArrow(_scan(positions, ways, shared), FOUND_DDL))
        some = found.filter(F.col("kind") == HIT).select(F.col("a").alias("train_rep"), F.col("b").alias("eval_rep"), "mask")
        hits = some if hits is None else hits.unionByName(some)
        more = found.filter(F.col("kind") != HIT).select((F.col("kind") == NEXT_TRAIN).alias("is_train"), F.col("a").alias("rep"), F.col("b").alias("prefix"), "mask").distinct()
        if more.isEmpty():
            break
        state, hot = cut(more.join(reps, ["is_train", "rep"]).select("is_train", "rep", "features", "prefix", "mask")), np.zeros(0, np.int64)
    pairs = hits.groupBy("train_rep", "eval_rep").agg(F.expr("bit_or(mask)").alias("covered"))
    t = reps.filter("is_train").select(F.col("rep").alias("train_rep"), F.col("key").alias("t_key"), F.col("features").alias("tf"))
    e = reps.filter("not is_train").select(F.col("rep").alias("eval_rep"), F.col("key").alias("e_key"), F.col("features").alias("ef"))
    good = pairs.join(t, "train_rep").join(e, "eval_rep").withColumn("mask", agreeing(F.col("tf"), F.col("ef"), rel, low)).withColumn("agree", F.bit_count("mask"))
    return cut(good.filter(F.col("agree") >= least).select("t_key", "tf", "e_key", "ef", "agree", "mask", "covered"))


def expanded(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """row_id_a < row_id_b, agree, train_row, eval_row: the pairs of rows behind pairs of representatives."""
    tm = rows.filter("is_train").select(F.col("row_id").alias("train_row"), F.col("key").alias("t_key"), F.col("features").alias("tf"))
    em = rows.filter("not is_train").select(F.col("row_id").alias("eval_row"), F.col("key").alias("e_key"), F.col("features").alias("ef"))
    out = pairs.join(tm, ["t_key", "tf"]).join(em, ["e_key", "ef"])
    return out.select(F.least("train_row", "eval_row").alias("row_id_a"), F.greatest("train_row", "eval_row").alias("row_id_b"), "agree", "train_row", "eval_row")


def overlaps(df: DataFrame, train: str = "train", least: int = 20, positions: int = 22, **params) -> DataFrame:
    """row_id_a < row_id_b, agree, train_row, eval_row: pairs of a training and another row that agree in ``least`` positions.

    Missing elements are NULL or NaN. A NULL array counts as all missing; arrays shorter than
    ``positions`` are filled up with missing elements, longer ones are cut there. Labels and extra
    columns play no part. Rows without row_id or split are left out. Copies come out as pairs, as
    each row is a case of its own. An empty side gives no pairs.
    """
    rows = records(df, train, positions)
    return expanded(linked(rows, least, positions, **params), rows)


def coverage(pairs: DataFrame, df: DataFrame, train: str = "train", positions: int = 22) -> DataFrame:
    """row_id, split_name, source, train_rows, covered of every evaluation row with an overlap: the training rows
    that overlap with it, and how many of its positions agree with any of them."""
    rows = records(df, train, positions)
    size = rows.filter("is_train").groupBy(F.col("key").alias("t_key"), F.col("features").alias("tf")).agg(F.count("*").alias("copies"))
    each = pairs.join(size, ["t_key", "tf"]).groupBy("e_key", "ef").agg(F.sum("copies").alias("train_rows"), F.bit_count(F.expr("bit_or(mask)")).alias("covered"))
    e = rows.filter("not is_train").select("row_id", F.col("key").alias("e_key"), F.col("features").alias("ef"))
    side = df.filter("row_id is not null").select(F.col("row_id").cast("long").alias("row_id"), "split_name", "source").filter(F.col("split_name") != train)
    return each.join(e, ["e_key", "ef"]).join(side, "row_id").select("row_id", "split_name", "source", "train_rows", F.col("covered").cast("int").alias("covered"))


def overlap_report(covered: DataFrame) -> DataFrame:
    """split_name, source, pairs, eval_rows: overlaps counted per split and source of the evaluation row (see :func:`coverage`)."""
    return covered.groupBy("split_name", "source").agg(F.sum("train_rows").alias("pairs"), F.count("*").alias("eval_rows"))
