"""Scaling to [0, 1], random rotations, and forests grown on rotated points."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovelight.operators.level import dense
from grovelight.sources.tables import maybe_broadcast


DIGITS = 9


def minmax(long: DataFrame) -> DataFrame:
    """feature, lo, hi over present values."""
    return long.filter("value is not null and not isnan(value)").groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))


def scaled(long: DataFrame, spans: DataFrame) -> DataFrame:
    """row_id, feature, value in [0, 1]; a constant feature and a missing value give 0."""
    v = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("value") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))))
    return long.join(maybe_broadcast(spans, 1_000_000), "feature", "left").select("row_id", "feature", F.coalesce(F.when(F.col("value").isNull() | F.isnan("value"), None).otherwise(v), F.lit(0.0)).alias("value"))  # one row per feature


def scale_arrays(df: DataFrame, spans: dict[int, tuple[float, float]], features: str = "features") -> DataFrame:
    """The same on arrays, in place: no shuffle."""
    cells = []
    for f in range(max(spans, default=-1) + 1):
        lo, hi = spans.get(f, (0.0, 0.0))
        x = F.get(F.col(features), F.lit(f))
        cells.append(F.lit(0.0) if hi == lo else F.when(x.isNull() | F.isnan(x), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (x - lo) / (hi - lo)))))
    return df.withColumn(features, F.array(*cells))


def rotation_matrix(n: int, seed: int = 0) -> np.ndarray:
    """Orthogonal n x n matrix from uniform numbers of the seed."""
    return orthogonal(np.random.Generator(np.random.MT19937(seed)).random((n, n)))


def orthogonal(m: np.ndarray) -> np.ndarray:
    """Q of the QR decomposition, columns turned so that R has a positive diagonal."""
    q, r = np.linalg.qr(m)
    return q * np.where(np.diag(r) < 0, -1.0, 1.0)


def turned(x: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Rows of x turned by the matrix, missing values as 0."""
    return np.round(np.nan_to_num(x) @ matrix.T, DIGITS)


def rotated(df: DataFrame, matrix: np.ndarray, features: str = "features") -> DataFrame:
    """``features`` turned by the matrix, missing values as 0: y_i = sum_j m_ij x_j in column expressions up to 4 features, by Arrow batches beyond.

    Rounded to DIGITS decimals, so that sums in another order give the same points.
    """
    n = len(matrix)
    if n <= 4:
        x = [F.coalesce(F.get(F.col(features), F.lit(j)), F.lit(0.0)) for j in range(n)]
        out = [sum((float(row[j]) * x[j] for j in range(1, n)), float(row[0]) * x[0]) for row in matrix]
        return df.withColumn(features, F.array(*[F.round(y, DIGITS) for y in out]))
    turn = np.asarray(matrix)

    @F.arrow_udf("array<double>")
    def product(c: pa.Array) -> pa.Array:
        y = turned(dense(c, n), turn)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(c) + 1, dtype=np.int32) * n), pa.array(y.ravel()))

    return df.withColumn(features, product(F.col(features).cast("array<double>")))


def trees_per_rotation(trees: int, rotations: int) -> list[int]:
    """Trees dealt over the rotations, the remainder to the first ones."""
    return [trees // rotations + (r < trees % rotations) for r in range(rotations)]
