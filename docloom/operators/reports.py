"""Comparing runs: order-preserving selections, arms against a control, first and warm passes, equal settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def select_in_order(rows: DataFrame, key: str, wanted: list) -> DataFrame:
    """The rows of a stated list of keys in its order (``position`` from 0), repeats included."""
    spark = rows.sparkSession
    kind = rows.schema[key].dataType.simpleString()
    order = spark.createDataFrame(list(enumerate(wanted)), f"position long, {key} {kind}")
    return order.join(rows, key)


def against_control(samples: DataFrame, arm: str, value: str, control: str) -> DataFrame:
    """Mean of every arm and its ratio to the control's mean (null without a control or if that is zero)."""
    means = samples.groupBy(arm).agg(F.avg(value).alias("mean"))
    base = means.where(F.col(arm) == control).select(F.col("mean").alias("base"))
    return means.join(base, how="left").select(arm, "mean", F.try_divide("mean", "base").alias("ratio"))  # one row of control


def pass_pairs(samples: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """First and second sample of every key side by side; keys with one sample have a null ``warm``."""
    by = Window.partitionBy(*keys).orderBy(*order)
    ranked = samples.withColumn("n", F.row_number().over(by)).where("n <= 2")
    return ranked.groupBy(*keys).agg(F.max(F.when(F.col("n") == 1, F.col(value))).alias("first"), F.max(F.when(F.col("n") == 2, F.col(value))).alias("warm"))


def differing_settings(reports: DataFrame, setting: str) -> DataFrame:
    """Keys of a map column under which reports hold more than one value, with the number of values."""
    pairs = reports.select(F.explode(setting).alias("key", "value"))
    return pairs.groupBy("key").agg(F.count_distinct("value").alias("n_values")).where("n_values > 1")


def run_difference(a: DataFrame, b: DataFrame, ignore: list[str]) -> DataFrame:
    """Rows that two runs don't share, times and other ignored columns aside, with ``surplus`` (of a over b)."""
    keep = [c for c in a.columns if c not in ignore]
    signed = a.select(*keep, F.lit(1).alias("surplus")).union(b.select(*keep, F.lit(-1)))
    return signed.groupBy(*keep).agg(F.sum("surplus").alias("surplus")).where("surplus <> 0")


def published(rows: DataFrame, updated: str, until: str, instant) -> DataFrame:
    """Rows whose strict instant is not after ``until``; unreadable or null instants are left out, never let in."""
    known = F.when(instant(F.col(updated)).isNotNull(), instant(F.col(updated)) <= F.lit(until)).otherwise(False)
    return rows.where(known)


#: Fixed value: the only form in which a publishing time is read.
PUBLISH_TIME = r"^[0-9]{4}-(0[1-9]|1[0-2])-([0-2][0-9]|3[01])T([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]\.[0-9]{3}\+00:00$"


def publishable(rows: DataFrame, now: str) -> DataFrame:
    """Rows that may be published at ``now`` (in the form of PUBLISH_TIME), with all others left out.

    ``content_type`` and ``editor`` must be Markdown, ``is_published`` true and
    ``is_private`` false; an empty start or end is no limit, one that is null or in
    another form lets nothing through.
    """

    def reached(column: str, inside) -> Column:
        value = F.col(column)
        return F.when(value == "", True).when(value.rlike(PUBLISH_TIME), inside(value)).otherwise(False)

    markdown = (F.col("content_type") == "markdown") & (F.col("editor") == "markdown")
    shown = F.coalesce(F.col("is_published"), F.lit(False)) & ~F.coalesce(F.col("is_private"), F.lit(True))
    return rows.where(markdown & shown & reached("publish_start", lambda v: v <= F.lit(now)) & reached("publish_end", lambda v: v >= F.lit(now)))
