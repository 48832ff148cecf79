"""Parquet tables of a data directory, and small helpers that every plan shares."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """Folder that every executor reaches: ``spark.checkpoint.dir``, which a cluster must set.

    Only a local session without the setting (tests) gets a folder of its own, below the warehouse
    directory. What is cut there is deleted with its DataFrame where the session sets
    ``spark.cleaner.referenceTracking.cleanCheckpoints``.
    """
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = spark.conf.get("spark.sql.warehouse.dir") + "/grovelight-checkpoints"
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and read back from the shared folder (lineage cut that survives lost executors)."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def small(df: DataFrame, max_rows: int) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows; reads no more than it needs to know."""
    return df.limit(max_rows + 1).count() <= max_rows


def maybe_broadcast(df: DataFrame, max_rows: int = 20_000) -> DataFrame:
    """A broadcast hint only for a side whose row count was measured to be small; beyond that Spark's own choice."""
    return F.broadcast(df) if small(df, max_rows) else df


def temp_name(stem: str) -> str:
    return f"__{stem}_{uuid.uuid4().hex[:8]}"
