"""Scoring a stream of rows with a trained forest: stateless, the batch plan unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from grovelight.operators.training import Trained


def score_stream(rows: DataFrame, model: Trained, path: str, checkpoint: str) -> StreamingQuery:
    """Appends row_id, predicted to parquet as rows arrive; restarts from ``checkpoint``, a shared folder of this stream's own."""
    out = model.predict(rows).select("row_id", "predicted")
    return out.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path)
