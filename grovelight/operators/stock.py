"""Spark ML forests behind the same frame: regression, other impurities, ordered and unordered categories."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_ml(df: DataFrame, num_features: int | None = None, categorical: dict[int, int] | None = None) -> DataFrame:
    """``features`` as a vector, missing values as 0. With ``categorical`` ({feature: number of categories}, needs
    ``num_features``) the column says which features are categories, and Spark splits these by subsets."""
    out = df.withColumn("features", array_to_vector(F.transform(F.col("features").cast("array<double>"), lambda v: F.coalesce(v, F.lit(0.0)))))
    if not categorical:
        return out
    if num_features is None:
        raise ValueError("categorical features need num_features")
    nominal = [{"idx": f, "name": f"f{f}", "vals": [str(c) for c in range(k)]} for f, k in sorted(categorical.items())]
    numeric = [{"idx": f, "name": f"f{f}"} for f in range(num_features) if f not in categorical]
    return out.withMetadata("features", {"ml_attr": {"attrs": {"nominal": nominal, "numeric": numeric}, "num_attrs": num_features}})


def from_ml(df: DataFrame) -> DataFrame:
    return df.withColumn("features", vector_to_array("features"))


def train_classifier(
    df: DataFrame, trees: int = 20, depth: int = 5, bins: int = 32, impurity: str = "gini", strategy: str = "auto", min_rows: int = 1, min_gain: float = 0.0, seed: int = 0,
    num_features: int | None = None, categorical: dict[int, int] | None = None, memory_mb: int = 256,
):
    """impurity: gini or entropy. memory_mb bounds the histograms of one pass, so how many nodes are split in it."""
    f = RandomForestClassifier(numTrees=trees, maxDepth=depth, maxBins=bins, impurity=impurity, featureSubsetStrategy=strategy, minInstancesPerNode=min_rows, minInfoGain=min_gain, seed=seed, maxMemoryInMB=memory_mb)
    return f.fit(to_ml(df, num_features, categorical))


def train_regressor(
    df: DataFrame, trees: int = 20, depth: int = 5, bins: int = 32, strategy: str = "auto", min_rows: int = 1, min_gain: float = 0.0, seed: int = 0,
    num_features: int | None = None, categorical: dict[int, int] | None = None, memory_mb: int = 256,
):
    """By variance."""
    f = RandomForestRegressor(numTrees=trees, maxDepth=depth, maxBins=bins, featureSubsetStrategy=strategy, minInstancesPerNode=min_rows, minInfoGain=min_gain, seed=seed, maxMemoryInMB=memory_mb)
    return f.fit(to_ml(df, num_features, categorical))


def predict(model, df: DataFrame) -> DataFrame:
    return model.transform(to_ml(df)).select("row_id", "label", "prediction")
