"""Frequency of every distinct index and value of a sparse data set.

Vertical layout: each term has a bitmap of the records that hold it and beside it a counter of its
occurrences in each. A bitmap is cut into chunks of record identifiers; the chunk of a term holds
the low bits of its identifiers, gap-coded and compressed. Every task builds the bitmaps of its own
records. Those of one chunk are merged by union, so a record that was sent again counts once, and a
chunk's cardinality is read from it. Chunks hold disjoint identifiers: the cardinalities of a term's
chunks add up to its document frequency. A merge task meets one chunk at a time, in order, so its
memory is that of one chunk whatever the table; repeated records are merged before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovelight.sources.tables import cut

KINDS = ("idx", "val", "all")  # all: one term that every record holds, for the number of records
CHUNK = 14  # bits of a record identifier inside a chunk
BLOCKS = pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), ("bitmaps", pa.binary())])
BLOCKS_DDL = "chunk bigint, kind int, bitmaps binary"
COUNTS = pa.schema([("kind", pa.string()), ("term", pa.int64()), ("docs", pa.int64()), ("occurrences", pa.int64())])
COUNTS_DDL = "kind string, term bigint, docs bigint, occurrences bigint"
FLUSH = 3_000_000  # postings that a task holds before it writes their bitmaps out
SETTLE = 500_000  # counts that a merge task holds before it adds them up


def exploded(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row number, value and validity of each element of a list column; a NULL list has none."""
    lens = col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = col.flatten()
    return np.repeat(np.arange(len(col)), lens), flat.fill_null(0).to_numpy(zero_copy_only=False), np.asarray(flat.is_valid())


def postings(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Kind, terms and record identifiers of a batch."""
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    rows, index, valid = exploded(batch.column(1))
    yield 0, index[valid].astype(np.int64), ids[rows[valid]]
    rows, value, valid = exploded(batch.column(2))
    valid &= np.isfinite(value)
    with np.errstate(over="ignore"):
        value = value[valid] * 1000.0
    if np.any(np.abs(value) >= 2.0**63):
        raise OverflowError(f"the term of the value {value[np.abs(value) >= 2.0**63][0] / 1000.0} does not fit a BIGINT")
    yield 1, (np.sign(value) * np.floor(np.abs(value) + 0.5)).astype(np.int64), ids[rows[valid]]
    yield 2, np.zeros(len(ids), np.int64), ids


def union(term: np.ndarray, ids: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (term, identifier) pairs in order, and how often each occurred."""
    if not len(term):
        return term, ids, np.zeros(0, np.int64)
    if -(1 << 31) <= term.min() and term.max() < 1 << 31 and ids.max() - (low := ids.min()) < 1 << 32:
        key = (term << 32) | (ids - low)  # one sort of single integers
        order = None
        if times is None:
            key.sort()
        else:
            order = np.argsort(key)
            key = key[order]
        new = np.r_[True, key[1:] != key[:-1]]
    else:
        order = np.lexsort((ids, term))
        key, low = None, 0
        term, ids = term[order], ids[order]
        new = np.r_[True, (term[1:] != term[:-1]) | (ids[1:] != ids[:-1])]
    at = np.flatnonzero(new)
    if times is None:
        n = np.diff(np.r_[at, len(new)])
    else:
        n = np.add.reduceat(times[order], at)
    if key is None:
        return term[at], ids[at], n
    key = key[at]
    return key >> 32, (key & 0xFFFFFFFF) + low, n


def coded(term: np.ndarray, low: np.ndarray, n: np.ndarray) -> bytes:
    """The bitmaps of one chunk: distinct terms as gaps, the size of each bitmap, low bits of the identifiers as gaps, occurrences."""
    at = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.zeros(0, np.int64)
    gaps = np.diff(low, prepend=0)
    gaps[at] = low[at]
    parts = [np.array([len(at), len(term)], "<i8"), np.diff(term[at], prepend=np.int64(0)).astype("<i8"), np.diff(np.r_[at, len(term)]).astype("<i4"), gaps.astype("<u2"), n.astype("<i8")]
    return zstandard.compress(b"".join(p.tobytes() for p in parts), 1)


def decoded(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms, low bits and occurrences, in order."""
    raw = zstandard.decompress(block)
    terms, postings_ = np.frombuffer(raw, "<i8", 2)
    at = 16
    out = []
    for kind, count in (("<i8", terms), ("<i4", terms), ("<u2", postings_), ("<i8", postings_)):
        out.append(np.frombuffer(raw, kind, count, at))
        at += out[-1].nbytes
    term, size, gaps, n = out
    term, size = np.cumsum(term), size.astype(np.int64)
    low = np.cumsum(gaps.astype(np.int64))
    start = np.cumsum(size) - size
    before = np.where(start > 0, low[np.maximum(start, 1) - 1], 0) if len(low) else start
    return np.repeat(term, size), low - np.repeat(before, size), n.astype(np.int64)


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def blocks(held: dict[int, list]) -> Iterator[pa.RecordBatch]:
        out = []
        for kind, parts in held.items():
            term, ids, n = union(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
            chunk = ids >> CHUNK
            order = np.argsort(chunk, kind="stable")  # inside a chunk by term, then identifier
            chunk, term, low, n = chunk[order], term[order], ids[order] & ((1 << CHUNK) - 1), n[order]
            at = np.r_[0, np.flatnonzero(np.diff(chunk)) + 1, len(chunk)]
            out += [(int(chunk[a]), kind, coded(term[a:b], low[a:b], n[a:b])) for a, b in zip(at[:-1], at[1:], strict=True) if b > a]
        for s in range(0, len(out), 2000):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out[s : s + 2000], strict=True), BLOCKS, strict=True)], schema=BLOCKS)

    held: dict[int, list] = {}
    n = 0
    for batch in batches:
        for kind, term, ids in postings(batch):
            held.setdefault(kind, []).append((term, ids))
            n += len(term)
        if n > FLUSH:
            yield from blocks(held)
            held, n = {}, 0
    yield from blocks(held)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks come ordered by chunk and kind: the union of one chunk at a time, then its cardinalities."""
    parts: list[tuple] = []
    waiting = 0
    key = None
    counts: dict[int, list] = {}
    held = 0

    def settled() -> tuple:
        return union(*(np.concatenate([p[i] for p in parts]) for i in range(3))) if len(parts) > 1 else parts[0]

    def close() -> None:
        nonlocal held
        if not parts:
            return
        term, _, n = settled()
        if len(term):
            at = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
            counts.setdefault(key[1], []).append((term[at], np.diff(np.r_[at, len(term)]), np.add.reduceat(n, at)))
            held += len(at)
        parts.clear()

    def added_up() -> None:
        nonlocal held
        held = 0
        for kind, rows in counts.items():
            term, docs, n = (np.concatenate([r[i] for r in rows]) for i in range(3))
            term, of = np.unique(term, return_inverse=True)
            sums = [np.zeros(len(term), np.int64) for _ in range(2)]
            np.add.at(sums[0], of, docs)
            np.add.at(sums[1], of, n)
            counts[kind] = [(term, *sums)]
            held += len(term)

    def out() -> Iterator[pa.RecordBatch]:
        for kind, rows in counts.items():
            for term, docs, n in rows:
                for s in range(0, len(term), 100_000):
                    e = slice(s, s + 100_000)
                    yield pa.RecordBatch.from_arrays([pa.array([KINDS[kind]] * len(term[e]), pa.string()), pa.array(term[e]), pa.array(docs[e]), pa.array(n[e])], schema=COUNTS)
        counts.clear()

    for batch in batches:
        for chunk, kind, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (chunk, kind) != key:
                close()
                key, waiting = (chunk, kind), 0
                if held > SETTLE:
                    added_up()
                    if held > SETTLE // 2:
                        yield from out()
                        held = 0
            parts.append(decoded(block))
            waiting += len(parts[-1][0])
            if waiting > FLUSH and len(parts) > 1:  # a chunk sent again many times
                parts[:] = [settled()]
                waiting = len(parts[0][0])
    close()
    added_up()
    yield from out()


def term_bitmaps(df: DataFrame) -> DataFrame:
    """chunk, kind, bitmaps: per task and chunk of identifiers the terms' bitmaps and counters (before the union)."""
    need = df.select(F.col("row_id").cast("long").alias("row_id"), F.col("idx").cast("array<int>").alias("idx"), F.col("val").cast("array<double>").alias("val"))
    return need.filter(F.col("row_id").isNotNull()).mapInArrow(_build, BLOCKS_DDL)


def term_frequencies(df: DataFrame) -> DataFrame:
    """kind, term, docs, occurrences: in how many distinct records and how often each term occurs.

    kind 'idx': term = index; 'val': term = value times 1000, rounded half away from zero; 'all': one
    row with the number of distinct records (term 0). A record's terms are those of all its copies
    together; occurrences count every copy. Nulls: a NULL or empty list adds no term, NULL, NaN and
    infinite elements are no terms, rows without row_id are left out. A finite value whose term does
    not fit a BIGINT (9.2e15 or more) is an error, as in the SQL. Extra columns are ignored, an empty
    table gives no rows.
    """
    parts = term_bitmaps(df).repartition("chunk").sortWithinPartitions("chunk", "kind").mapInArrow(_merge, COUNTS_DDL)
    return parts.groupBy("kind", "term").agg(F.sum("docs").alias("docs"), F.sum("occurrences").alias("occurrences"))


def marked_terms(df: DataFrame, min_docs: int = 3, max_share: float = 0.7) -> DataFrame:
    """Term frequencies with ``mark``: 'rare' (in under min_docs records), 'common' (in over max_share of all
    distinct records, those with NULL lists included), else 'kept'."""
    counts = cut(term_frequencies(df))
    total = counts.filter("kind = 'all'").select(F.col("docs").alias("n_records"))  # at most one row
    mark = F.when(F.col("docs") < min_docs, "rare").when(F.col("docs") > max_share * F.col("n_records"), "common").otherwise("kept")
    return counts.filter("kind <> 'all'").join(F.broadcast(total), F.lit(True)).select("kind", "term", "docs", "occurrences", "n_records", mark.alias("mark"))
