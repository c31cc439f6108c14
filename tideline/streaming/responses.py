"""Responses taken in as they arrive, each file once.

An extension: the data come in whole releases, but staged responses of slow services
trickle in. A stream over their folder hands every micro-batch to a function and
remembers in its checkpoint what it has seen, so a run that was stopped goes on where it
was. ``available_now`` takes what is there and ends.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def follow(spark: SparkSession, folder: str, schema: str, handle: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True, files: int = 100) -> StreamingQuery:
    """Start a stream of JSON lines under ``folder``; ``handle(rows, batch_id)`` may see a batch again after a failure."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(folder)
    writer = rows.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def append_once(path: str) -> Callable[[DataFrame, int], None]:
    """A handler that writes each batch to a folder of its own, so that a batch seen again replaces itself."""

    def handle(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch_id}")

    return handle
