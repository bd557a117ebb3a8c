"""A fitted pipeline is DataFrame -> DataFrame, so it runs on a stream as it is."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def serve(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Writes transform(stream) to Parquet until the input that is there has been read."""
    if not stream.isStreaming:
        raise ValueError("not a stream")
    return transform(stream).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
