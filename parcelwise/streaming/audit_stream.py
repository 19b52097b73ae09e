"""Append-once audit feed as a structured stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import relational as R


def read_events(
    spark: SparkSession, folder: str, schema: str, pattern: str = "*.parquet", files_per_trigger: int = 16
) -> DataFrame:
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_trigger)
        .option("pathGlobFilter", pattern)
        .parquet(folder)
    )


def append_audit(events: DataFrame, out: str, checkpoint: str, key: str = "execution_id") -> StreamingQuery:
    """ON CONFLICT DO NOTHING on a stream: each micro-batch appends the keys not yet stored.

    A row is never too late. A batch writes to a folder of its own number, so one that
    is run again after a failure replaces what it wrote and never adds to it.
    """

    def append(batch: DataFrame, number: int) -> None:
        stored = batch.select(key).limit(0)
        if number:
            every = batch.sparkSession.read.parquet(out)  # `batch` is the folder's number
            stored = every.where(every["batch"] < number).select(key)
        R.append_new(stored, batch, key).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return events.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
