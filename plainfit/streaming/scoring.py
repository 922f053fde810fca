"""Compiled models are stateless Columns, so they score a stream as they score a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.model import TermModel


def score_stream(stream: DataFrame, model: TermModel, path: str, checkpoint: str) -> StreamingQuery:
    """Scores all rows that are there, appends them to ``path`` and ends; exactly once by the checkpoint."""
    writer = model.transform(stream).writeStream.format("parquet").outputMode("append")
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
