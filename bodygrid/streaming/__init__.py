"""Row-local functions on streams: nothing here keeps state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


def run_available(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> None:
    """Apply a row-local function (address cleaning, point encoding, text forms) to everything that has landed, then stop."""
    q = transform(stream).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
