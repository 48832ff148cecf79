"""Bulk parsing of LIBSVM and ARFF lines: valid records, and rejected lines with the reason.

Lines that share a declared shape form blocks. A block is split, unquoted, screened and converted in
whole Arrow columns. A block with lines that are not plainly valid is cut in halves until these stand
alone; runs without one come out as columns, the others are diagnosed field by field.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovelight.sources.tables import maybe_broadcast

NUM = r"[+-]?[0-9]++(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?"
NUMBER = re.compile(NUM, re.A)
INDEX = re.compile(r"[0-9]+", re.A)
#: Numbers that are surely finite; others are left to the strict way.
PLAIN_NUMBER = r"[+-]?[0-9]{1,40}(?:\.[0-9]{1,40})?(?:[eE][+-]?[0-9]{1,2})?"
PLAIN = rf"^{PLAIN_NUMBER}$"
PLAIN_PAIR = rf"^[0-9]{{1,9}}:(?:{PLAIN_NUMBER}|NaN)$"
QUOTED = r"^(?:'([^'\"]*)'|\"([^'\"]*)\")$"
SCHEMA = "line_id bigint, file_id string, line_no int, label int, idx array<int>, val array<double>, reason string"
ARROW = pa.schema([("line_id", pa.int64()), ("file_id", pa.string()), ("line_no", pa.int32()), ("label", pa.int32()), ("idx", pa.list_(pa.int32())), ("val", pa.list_(pa.float64())), ("reason", pa.string())])
SPACE = " \t\r\n\f\v"

Record = tuple[int, list[int], list[float | None]]


class Rejected(ValueError):
    """A line that is not a valid record; the message is the reason."""


def _number(text: str, what: str) -> float:
    if not NUMBER.fullmatch(text):
        raise Rejected(f"{what}: not a number")
    v = float(text)
    if math.isinf(v):
        raise Rejected(f"{what}: out of range")
    return v


def _label(text: str, classes: int) -> int:
    v = _number(text, "label")
    if v != math.floor(v):
        raise Rejected("label: not whole")
    if v >= classes:
        raise Rejected("label: class not declared")
    return max(0, int(v))


def _unquoted(field: str) -> str:
    if len(field) >= 2 and field[0] in "'\"" and field[-1] == field[0]:
        field = field[1:-1]
    if "'" in field or '"' in field:
        raise Rejected("quoting: broken or misplaced quote")
    return field


def strict(line: str, fmt: str, features: int, classes: int) -> Record:
    """One line field by field; raises Rejected with the first reason."""
    if fmt == "LIBSVM":
        parts = [p for p in line.strip(SPACE).split(" ") if p]
        label = _label(parts[0], classes)
        idx, val, last = [], [], 0
        for p in parts[1:]:
            i, colon, v = p.partition(":")
            if not colon:
                raise Rejected("pair: no colon")
            if not INDEX.fullmatch(i):
                raise Rejected("index: not a whole number")
            k = int(i)
            if k < 1 or k > features:
                raise Rejected("index: outside the declared features")
            if k <= last:
                raise Rejected("index: not ascending")
            last = k
            idx.append(k - 1)
            val.append(None if v == "NaN" else _number(v, "value"))
        return label, idx, val
    fields = line.split(",")
    if len(fields) != features + 1:
        # a comma can only be data inside quotes, where it is no valid number either
        raise Rejected("columns: too few" if len(fields) < features + 1 else "columns: too many")
    plain = [_unquoted(f.strip(SPACE)).strip(SPACE) for f in fields]
    label = _label(plain[-1], classes)
    val = [None if f in ("", "?", "NaN") else _number(f, "value") for f in plain[:-1]]
    return label, list(range(features)), val


# ---- the fast path: whole columns at a time


def _is(texts: pa.Array, pattern: str) -> np.ndarray:
    return pc.match_substring_regex(texts, pattern).to_numpy(zero_copy_only=False)


def _number_column(texts: pa.Array) -> np.ndarray:
    """Doubles of texts that are plain numbers; NaN for the others."""
    plain = pc.if_else(pa.array(_is(texts, PLAIN)), pc.replace_substring_regex(texts, r"^\+", ""), pa.scalar(None, pa.string()))
    return pc.cast(plain, pa.float64()).to_numpy(zero_copy_only=False)


def _heads(lens: np.ndarray) -> np.ndarray:
    return np.cumsum(lens) - lens


def _label_ok(label: np.ndarray, classes: int) -> np.ndarray:
    with np.errstate(invalid="ignore"):
        return (label == np.floor(label)) & (label < classes)


@dataclass
class Columns:
    """A block split into columns: which lines are plainly valid, and their labels, indices and values (NaN for a missing one)."""

    ok: np.ndarray
    label: np.ndarray
    size: np.ndarray
    idx: np.ndarray
    val: np.ndarray

    def of(self, lines: np.ndarray) -> tuple[pa.Array, pa.Array, pa.Array]:
        """Arrow columns of some lines, in order."""
        size = self.size[lines]
        at = np.repeat(_heads(self.size)[lines], size) + np.arange(size.sum()) - np.repeat(_heads(size), size)
        ends = pa.array(np.r_[0, np.cumsum(size)], pa.int32())
        val = self.val[at]
        return (
            pa.array(np.maximum(self.label[lines], 0).astype(np.int32)),
            pa.ListArray.from_arrays(ends, pa.array(self.idx[at].astype(np.int32))),
            pa.ListArray.from_arrays(ends, pa.array(val, mask=np.isnan(val))),
        )


def _any_bad(bad: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """For each list whether one of its elements is marked."""
    upto = np.r_[0, np.cumsum(bad)]
    first = _heads(lens)
    return upto[first + lens] > upto[first]


def svm_columns(lines: pa.Array, features: int, classes: int) -> Columns:
    parts = pc.split_pattern_regex(pc.utf8_trim(lines, " "), " +")
    lens = parts.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = parts.flatten()
    label = _number_column(flat.take(pa.array(_heads(lens))))
    rest = np.ones(len(flat), bool)
    rest[_heads(lens)] = False
    pairs = flat.filter(pa.array(rest))
    size = lens - 1
    good = _is(pairs, PLAIN_PAIR)
    pairs = pc.if_else(pa.array(good), pairs, pa.scalar("0:0"))
    both = pc.split_pattern(pairs, ":").flatten()
    odd = np.arange(1, len(both), 2)
    idx = pc.cast(both.take(pa.array(odd - 1)), pa.int64()).to_numpy(zero_copy_only=False)
    val = _number_column(both.take(pa.array(odd)))
    rises = np.r_[True, idx[1:] > idx[:-1]] if len(idx) else np.zeros(0, bool)
    rises[_heads(size)[size > 0]] = True
    bad = ~good | ~rises | (idx < 1) | (idx > features)
    return Columns(_label_ok(label, classes) & ~_any_bad(bad, size), label, size, idx - 1, val)


def arff_columns(lines: pa.Array, features: int, classes: int) -> Columns:
    parts = pc.split_pattern(lines, ",")
    lens = parts.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    right = lens == features + 1
    flat = pc.utf8_trim(parts.filter(pa.array(right)).flatten(), SPACE)
    flat = pc.utf8_trim(pc.replace_substring_regex(flat, QUOTED, r"\1\2"), SPACE)
    n = int(right.sum())
    value = _number_column(flat)
    table = value.reshape(n, features + 1)
    fit = (~np.isnan(value) | _is(flat, r"^(?:NaN|\?|)$")).reshape(n, features + 1)
    ok, label, size = np.zeros(len(lines), bool), np.full(len(lines), np.nan), np.where(right, features, 0)
    ok[right] = _label_ok(table[:, -1], classes) & fit[:, :-1].all(1)
    label[right] = table[:, -1]
    return Columns(ok, label, size, np.tile(np.arange(features), n), table[:, :-1].ravel())


def bisected(bad: np.ndarray) -> tuple[list[tuple[int, int]], list[int]]:
    """Runs of lines without a bad one, and the bad lines: a block with bad lines is halved until they stand alone."""
    upto = np.r_[0, np.cumsum(bad)]
    runs, alone, todo = [], [], [(0, len(bad))]
    while todo:
        a, b = todo.pop()
        if upto[a] == upto[b]:
            if b > a:
                runs.append((a, b))
        elif b - a == 1:
            alone.append(a)
        else:
            todo += [((a + b) // 2, b), (a, (a + b) // 2)]
    return runs, alone


def parse_block(lines: pa.Array, fmt: str, features: int, classes: int) -> tuple[list[tuple[np.ndarray, tuple]], dict[int, Record | str]]:
    """Columns of the runs of plainly valid lines, with their places; and a record or the reason for each other line."""
    block = (svm_columns if fmt == "LIBSVM" else arff_columns)(lines, features, classes)
    runs, alone = bisected(~block.ok)
    good = np.concatenate([np.arange(a, b) for a, b in runs]) if runs else np.zeros(0, np.int64)
    rest: dict[int, Record | str] = {}
    for k, text in zip(alone, lines.take(pa.array(alone, pa.int64())).to_pylist(), strict=True):
        try:
            rest[k] = strict(text, fmt, features, classes)
        except Rejected as e:
            rest[k] = str(e)
    return ([(good, block.of(good))] if len(good) else []), rest


BLOCK, BLOCK_BYTES = 4096, 8 << 20


def _blocks(rows: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """Rows in blocks of bounded number and, but for single long lines, bounded size."""
    at = np.maximum(np.arange(len(rows)) // BLOCK, 0) + np.cumsum(size) // BLOCK_BYTES
    return np.split(rows, np.flatnonzero(np.diff(at)) + 1)


def _rejected(keys: list[pa.Array], reason: list[str]) -> pa.RecordBatch:
    n = len(reason)
    return pa.RecordBatch.from_arrays([*keys, pa.nulls(n, pa.int32()), pa.nulls(n, pa.list_(pa.int32())), pa.nulls(n, pa.list_(pa.float64())), pa.array(reason, pa.string())], schema=ARROW)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, line = [b.column(k) for k in range(3)], pc.utf8_trim(b.column(3), SPACE)
        fmt, features, classes, twice = b.column(4), b.column(5), b.column(6), b.column(7)
        known = pc.and_(pc.fill_null(pc.is_in(fmt, pa.array(["LIBSVM", "ARFF"])), False), pc.and_(pc.fill_null(pc.greater_equal(features, 0), False), pc.is_valid(classes)))
        known = pc.and_not(known, pc.fill_null(twice, False)).to_numpy(zero_copy_only=False)
        there = line.is_valid().to_numpy(zero_copy_only=False)
        for mask, reason in ((~known, None), (known & ~there, "line: missing")):
            if mask.any():
                at = pa.array(np.flatnonzero(mask))
                why = [reason or ("file: declared twice" if t else "file: no declared shape") for t in twice.take(at).to_pylist()]
                yield _rejected([c.take(at) for c in ids], why)
        at = np.flatnonzero(known & there)
        if not len(at):
            continue
        size = pc.fill_null(pc.binary_length(line), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        shapes, of = np.unique(np.array([f"{f} {n} {c}" for f, n, c in zip(*(c.take(pa.array(at)).to_pylist() for c in (fmt, features, classes)), strict=True)]), return_inverse=True)
        for k, shape in enumerate(shapes):
            kind, n, c = shape.split()
            own = at[of == k]
            for rows in _blocks(own, size[own]):
                runs, rest = parse_block(line.take(pa.array(rows)), kind, int(n), int(c))
                for good, cols in runs:
                    where = pa.array(rows[good])
                    yield pa.RecordBatch.from_arrays([*(x.take(where) for x in ids), *cols, pa.nulls(len(good), pa.string())], schema=ARROW)
                bad = [k for k, r in rest.items() if isinstance(r, str)]
                if bad:
                    where = pa.array(rows[bad])
                    yield _rejected([x.take(where) for x in ids], [rest[k] for k in bad])
                fine = [k for k, r in rest.items() if not isinstance(r, str)]
                if fine:
                    where = pa.array(rows[fine])
                    yield pa.RecordBatch.from_arrays([*(x.take(where) for x in ids), *(pa.array([rest[k][i] for k in fine], ARROW.field(3 + i).type) for i in range(3)), pa.nulls(len(fine), pa.string())], schema=ARROW)


def parse_lines(lines: DataFrame, files: DataFrame) -> DataFrame:
    """line_id, file_id, line_no, label, idx (0-based), val, reason of every record line; reason is NULL for valid ones.

    Blank lines, lines that start with # and in ARFF also with % or @ are no records and do not come
    out. A NULL line is rejected ('line: missing'), as is a line of a file without a declared
    shape ('file: no declared shape') or with two ('file: declared twice'). A missing value is NULL. Lines of any length are parsed whole;
    repeated lines each count; extra columns are ignored. The shapes are broadcast while they are few;
    beyond that they are joined by file, where Spark splits a file that holds most lines.
    """
    shape = files.filter("file_id is not null").select(F.col("file_id").alias("f"), F.upper("fmt").alias("fmt"), F.col("num_features").cast("int").alias("nf"), F.col("num_classes").cast("int").alias("nc"))
    # a file declared again alike is declared once; one declared in two ways has no shape
    shape = shape.groupBy("f").agg(F.min("fmt").alias("fmt"), F.min("nf").alias("nf"), F.min("nc").alias("nc"), (F.countDistinct(F.struct("fmt", "nf", "nc")) > 1).alias("twice"))
    need = lines.select(F.col("line_id").cast("long").alias("line_id"), F.col("file_id").cast("string").alias("file_id"), F.col("line_no").cast("int").alias("line_no"), F.col("raw_line").cast("string").alias("raw_line"))
    joined = need.join(maybe_broadcast(shape, 50_000), F.col("file_id") == F.col("f"), "left")
    start = F.substring(F.regexp_replace("raw_line", r"^\s+", ""), 1, 1)
    skip = (start == "") | (start == "#") | ((F.col("fmt") == "ARFF") & start.isin("%", "@"))
    return joined.filter(F.coalesce(~skip, F.lit(True))).select("line_id", "file_id", "line_no", "raw_line", "fmt", "nf", "nc", "twice").mapInArrow(_parse, SCHEMA)


def valid_records(parsed: DataFrame) -> DataFrame:
    return parsed.filter("reason is null").select("line_id", "file_id", "line_no", "label", "idx", "val")


def rejected_lines(parsed: DataFrame) -> DataFrame:
    return parsed.filter("reason is not null").select("line_id", "file_id", "line_no", "reason")
