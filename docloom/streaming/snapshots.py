"""Streams: deliveries of snapshot rows, and windows over event samples."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table_stream(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int = 16) -> DataFrame:
    """Parquet files of a folder as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def event_windows(events: DataFrame, window: str = "5 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Count, sum and largest value per event type and time window; rows later than ``late`` are dropped.

    Works on a stream (append mode: a window comes out once it is closed) and on
    a batch alike. Rows without a time belong to no window.
    """
    timed = events.where("ts is not null").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    frame = F.window("ts", window, slide) if slide else F.window("ts", window)
    return timed.groupBy(frame.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.max("value").alias("largest")).select(
        F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total", "largest"
    )


def delivered_once(rows: DataFrame, key: str, time: str, late: str = "30 days") -> DataFrame:
    """Each delivered row once: repeated deliveries of (key, time) within the watermark are dropped."""
    return rows.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark([key, time])


def for_each_batch(stream: DataFrame, folder: str, write: Callable[[DataFrame, int], None]):
    """Run ``write(batch, number)`` on every micro-batch available now; exactly once if ``write`` replaces by number."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", folder).trigger(availableNow=True).start()


def replace_batches(stream: DataFrame, folder: str, progress: str):
    """Run what is available now and leave each result in ``folder``, whole: a batch replaces the one before."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(folder)

    return stream.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", progress).trigger(availableNow=True).start()


def newest_rows(rows: DataFrame, key: str, time: str) -> DataFrame:
    """The newest row of every key so far, for ``outputMode("complete")`` or a batch; rows without key or time are left out.

    One state row a key is kept: the key's largest (time, row), so deliveries may
    come in any order and any number of times.
    """
    columns = [c for c in rows.columns if c not in (key, time)]
    known = rows.where(F.col(key).isNotNull() & F.col(time).isNotNull())
    newest = known.groupBy(key).agg(F.max(F.struct(F.col(time).alias("t"), *columns)).alias("row"))
    return newest.select(key, F.col("row.t").alias(time), *(F.col(f"row.`{c}`").alias(c) for c in columns))
