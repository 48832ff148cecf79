"""Column expressions shared by the forest operators."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, Window
from pyspark.sql import functions as F

# ---- fixed values: multipliers and moduli of the repeatable uniform numbers
A1, A2, A3, P1 = 7919, 104729, 1299709, 100003
B1, B2, B3, P2 = 31, 17, 101, 9973


def uniform(r: Column, t: Column, seed: int = 0) -> Column:
    """Repeatable number in [0, 1) for two whole numbers of 64 bits, the same in any SQL engine; about 10**9 distinct values."""
    r, t = r.cast("long"), t.cast("long")
    p1, p2 = F.lit(P1).cast("long"), F.lit(P2).cast("long")
    a = F.pmod(F.pmod(r, p1) * A1 + F.pmod(t, p1) * A2 + (13 + seed * A3) % P1, p1)
    b = F.pmod(F.pmod(r, p2) * B1 + F.pmod(t, p2) * B2 + (7 + seed * B3) % P2, p2) + 1
    return ((a * b) % p1 + (b - 1) / F.lit(float(P2))) / F.lit(float(P1))


def uniform_array(r: np.ndarray, t: np.ndarray, seed: int = 0) -> np.ndarray:
    a = (r % P1 * A1 + t % P1 * A2 + (13 + seed * A3) % P1) % P1
    b = (r % P2 * B1 + t % P2 * B2 + (7 + seed * B3) % P2) % P2 + 1
    return ((a * b) % P1 + (b - 1) / P2) / P1


def uniform_py(r: int, t: int, seed: int = 0) -> float:
    return float(uniform_array(np.int64(r), np.int64(t), seed))


def uniform_sql(r: str, t: str, seed: int = 0) -> str:
    a = f"((({r}) % {P1} * {A1} + ({t}) % {P1} * {A2} + {(13 + seed * A3) % P1}) % {P1})"
    b = f"((({r}) % {P2} * {B1} + ({t}) % {P2} * {B2} + {(7 + seed * B3) % P2}) % {P2} + 1)"
    return f"((({a} * {b}) % {P1} + ({b} - 1) / cast({P2} as double)) / cast({P1} as double))"


def ladder(mean: float, most: int = 12) -> list[float]:
    """Cumulative Poisson probabilities, rounded so that engines agree on them."""
    out, p, total = [], math.exp(-mean), 0.0
    for k in range(most):
        total += p
        out.append(round(total, 8))
        p *= mean / (k + 1)
        if total > 0.9999995:
            break
    return out


def poisson(u: Column, mean: float = 1.0) -> Column:
    """Inverse of the Poisson distribution at u."""
    steps = ladder(mean)
    out = F.lit(len(steps))
    for k in reversed(range(len(steps))):
        out = F.when(u < steps[k], k).otherwise(out)
    return out


def left_child(n: Column) -> Column:
    return n * 2 + 1


def right_child(n: Column) -> Column:
    return n * 2 + 2


def parent(n: Column) -> Column:
    return F.floor((n - 1) / 2).cast("int")


def level(n: Column) -> Column:
    return F.floor(F.log2(n + 1)).cast("int")


def level_py(n: int) -> int:
    return (n + 1).bit_length() - 1


def entropy(counts: Sequence[Column]) -> Column:
    """-sum p ln p over class counts; 0 for none."""
    n = sum(counts[1:], counts[0])
    return sum((F.when(c > 0, -(c / n) * F.log(c / n)).otherwise(0.0) for c in counts[1:]), F.when(counts[0] > 0, -(counts[0] / n) * F.log(counts[0] / n)).otherwise(0.0))


def majority(counts: Sequence[Column]) -> Column:
    """Class with the largest count, the lowest class on a tie."""
    most = F.greatest(*counts) if len(counts) > 1 else counts[0]
    out = F.lit(len(counts) - 1)
    for k in reversed(range(len(counts) - 1)):
        out = F.when(counts[k] == most, k).otherwise(out)
    return out


# ---- dense and sparse vectors


def to_sparse(dense: Column) -> Column:
    """array<struct<i, v>> of the present elements that are not 0."""
    pairs = F.transform(dense, lambda v, i: F.struct(i.alias("i"), v.alias("v")))
    return F.filter(pairs, lambda p: p["v"].isNotNull() & (p["v"] != 0))


def to_dense(sparse: Column, size: int, absent: float | None = None) -> Column:
    """array<double> of ``size``; positions without an entry get ``absent``."""
    m = F.map_from_entries(sparse)
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at(m, i), F.lit(absent).cast("double")))


def element(sparse: Column, i: Column | int, absent: float) -> Column:
    return F.coalesce(F.try_element_at(F.map_from_entries(sparse), i if isinstance(i, Column) else F.lit(i)), F.lit(absent))


def active_count(dense: Column) -> Column:
    return F.size(F.filter(dense, lambda v: v.isNotNull()))


def nonzero_count(dense: Column) -> Column:
    return F.size(F.filter(dense, lambda v: v != 0))


def keeps_sparse(nonzero: Column, size: Column | int) -> Column:
    """Whether the sparse form is the smaller one."""
    return (nonzero + 1) * 1.5 < size


def append_bias(dense: Column) -> Column:
    return F.concat(dense, F.array(F.lit(1.0)))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def log1p_exp(x: Column) -> Column:
    """ln(1 + e^x) without overflow."""
    return F.when(x > 0, x + F.log1p(F.exp(-x))).otherwise(F.log1p(F.exp(x)))


def round_half_up(x: Column, digits: int = 0) -> Column:
    return F.round(x, digits)


def running(what: str, x: Column, group: Sequence[str], order: Sequence[str]) -> Column:
    """Running 'mean', 'min' or 'max' of x inside groups that are ordered as a whole; for groups that fit a task."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return {"mean": F.avg, "min": F.min, "max": F.max}[what](x).over(w)


class Bijection:
    """A one-to-one map of constants, as columns in both directions."""

    def __init__(self, pairs: dict) -> None:
        if len(set(pairs.values())) != len(pairs):
            raise ValueError("two keys have one value")
        self.pairs = dict(pairs)

    def _map(self, items: list[tuple]) -> Column:
        return F.create_map(*[F.lit(x) for kv in items for x in kv])

    def value(self, key: Column) -> Column:
        return F.try_element_at(self._map(list(self.pairs.items())), key)

    def key(self, value: Column) -> Column:
        return F.try_element_at(self._map([(v, k) for k, v in self.pairs.items()]), value)
