"""Interval algebra on half-open ranges; touching ranges belong together."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge_ranges(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Union of the ranges of each key: maximal ``(start, end)``. Null or empty ranges are ignored."""
    by = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    marked = ranges.where("start < end").select(*keys, "start", "end").withColumn("fresh", F.coalesce(F.col("start") > reach, F.lit(True)).cast("int"))
    island = F.sum("fresh").over(by.rowsBetween(Window.unboundedPreceding, 0))
    return (
        marked.withColumn("island", island)
        .groupBy(*keys, "island")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"))
        .select(*keys, "start", "end")
    )


def covered_spans(spans: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Each distinct span with ``covered``: whether one merged range of its key holds it."""
    asked = spans.select(*keys, "start", "end").distinct()
    merged = merge_ranges(ranges, keys).withColumnsRenamed({"start": "from", "end": "to"})
    return (
        asked.join(merged, keys, "left")
        .groupBy(*keys, "start", "end")
        .agg(F.coalesce(F.bool_or((F.col("from") <= F.col("start")) & (F.col("to") >= F.col("end"))), F.lit(False)).alias("covered"))
    )


def atoms(spans: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Spans cut at every range end inside them: ``(keys, span_start, span_end, start, end)``."""
    asked = spans.select(*keys, F.col("start").alias("span_start"), F.col("end").alias("span_end")).where("span_start < span_end").distinct()
    points = ranges.select(*keys, F.explode(F.array("start", "end")).alias("point")).distinct()
    inner = asked.join(points, keys).where("point > span_start and point < span_end")
    every = inner.unionByName(asked.withColumn("point", F.col("span_start"))).unionByName(asked.withColumn("point", F.col("span_end")))
    by = Window.partitionBy(*keys, "span_start", "span_end").orderBy("point")
    return (
        every.withColumn("next", F.lead("point").over(by))
        .where("next is not null")
        .select(*keys, "span_start", "span_end", F.col("point").alias("start"), F.col("next").alias("end"))
    )


def uncovered(spans: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """The parts of each distinct span that no range of its key holds, as maximal gaps."""
    asked = spans.select(*keys, F.col("start").alias("span_start"), F.col("end").alias("span_end")).where("span_start < span_end").distinct()
    merged = merge_ranges(ranges, keys)
    inside = asked.join(merged, keys).where("start < span_end and end > span_start").select(*keys, "span_start", "span_end", "start", "end")
    # A sentinel at the span's end makes the last gap the gap before a range like all others.
    stops = inside.unionByName(asked.select(*keys, "span_start", "span_end", F.col("span_end").alias("start"), F.col("span_end").alias("end")))
    by = Window.partitionBy(*keys, "span_start", "span_end").orderBy("start", "end")
    return (
        stops.withColumn("gap", F.coalesce(F.lag("end").over(by), F.col("span_start")))
        .where("gap < start")
        .select(*keys, "span_start", "span_end", F.col("gap").alias("start"), F.col("start").alias("end"))
    )


def clip(ranges: DataFrame, start: str, end: str) -> DataFrame:
    """Intersection of ``(start, end)`` with the range in two other columns; empty ones are left out."""
    return ranges.withColumns({"start": F.greatest("start", start), "end": F.least("end", end)}).where("start < end")
