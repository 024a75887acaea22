"""Incremental and continuous refresh of materialised views and indexes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def tumble(time: Column | str, width: str) -> Column:
    """Tumbling window of an event time, as a struct of start and end."""
    return F.window(time, width).alias("window")


def _started(writer, interval: str | None, checkpoint: str) -> StreamingQuery:  # noqa: ANN001
    if not checkpoint:
        raise ValueError("a checkpoint location is needed")
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def refresh_view(
    spark: SparkSession, source: str, query: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, *,
    time: str | None = None, delay: str = "0 seconds", interval: str | None = None, output_mode: str = "append",
    files_per_trigger: int | None = None,
) -> StreamingQuery:
    """Write what ``query`` makes of new rows of the parquet table ``source`` behind ``target``.

    Without ``interval`` it takes what there is and stops (incremental); with it, it goes on. Rows
    later than ``delay`` behind the latest ``time`` are dropped, and a window is written once it is
    closed. The checkpoint keeps offsets and state, so a restart goes on where it stopped.
    """
    reader = spark.readStream.schema(spark.read.parquet(source).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    rows = reader.parquet(source)
    if time:
        rows = rows.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    return _started(query(rows).writeStream.format("parquet").outputMode(output_mode).option("path", target), interval, checkpoint)


def refresh_index(
    spark: SparkSession, source: str, build: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, *, interval: str | None = None
) -> StreamingQuery:
    """Append what ``build`` makes of each batch of new files (a skipping or covering index) to ``target``."""
    schema = spark.read.parquet(source).schema
    rows = spark.readStream.schema(schema).parquet(source)

    def append(batch: DataFrame, _: int) -> None:
        build(batch).write.mode("append").parquet(target)

    return _started(rows.select("*", "_metadata").writeStream.foreachBatch(append), interval, checkpoint)
