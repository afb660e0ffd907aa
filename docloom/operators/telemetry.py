"""Sample gaps, counter deltas and fields of log lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators.evaluation import nearest_rank


def sample_gaps(samples: DataFrame, keys: list[str], time: str, order: str) -> DataFrame:
    """Adds ``gap_us``: microseconds since the group's previous sample, null for the first."""
    by = Window.partitionBy(*keys).orderBy(time, order)
    return samples.withColumn("gap_us", F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(F.lag(time).over(by).cast("timestamp")))


def since_baseline(samples: DataFrame, keys: list[str], counter: str, time: str, order: str) -> DataFrame:
    """Adds ``delta``: the counter minus its value in the group's first sample."""
    by = Window.partitionBy(*keys).orderBy(time, order).rowsBetween(Window.unboundedPreceding, 0)
    return samples.withColumn("delta", F.col(counter) - F.first(counter).over(by))


def log_fields(lines: DataFrame, line: str, fields: dict[str, str]) -> DataFrame:
    """Adds one nullable double per field: the first group of its pattern in the line, where it is a number."""
    out = lines
    for name, pattern in fields.items():
        out = out.withColumn(name, F.nullif(F.regexp_extract(line, pattern, 1), F.lit("")).try_cast("double"))
    return out


def first_stops(samples: DataFrame, keys: list[str], time: str, order: str, counter: str, most_gap_us: int, most_growth: float) -> DataFrame:
    """``(keys, order, reason)``: the first sample of each group that stops its series, by its gap or its counter's growth.

    Groups that never stop have no row; a null time or counter stops nothing.
    """
    rows = since_baseline(sample_gaps(samples, keys, time, order), keys, counter, time, order)
    reason = F.when(F.col("gap_us") > most_gap_us, "gap").when(F.col("delta") > most_growth, "growth")
    found = rows.withColumn("reason", reason).where("reason is not null")
    return found.groupBy(*keys).agg(F.min_by(F.struct(order, "reason"), F.struct(time, order)).alias("first")).select(*keys, f"first.{order}", "first.reason")


def load_gate(samples: DataFrame, group: str, value: str, idle: str, most_ratio: float = 2.0, least_samples: int = 20) -> DataFrame:
    """``(group, samples, p95, ratio, passes)``: whether each group's nearest-rank 95th percentile is at most
    ``most_ratio`` times that of the idle group, with enough finite samples in both.

    Values that are null or not finite count as a failed group.
    """
    sound = F.coalesce(~F.isnan(value) & (F.abs(value) != float("inf")), F.lit(False))
    found = samples.groupBy(group).agg(
        F.count_if(sound).alias("samples"), F.count_if(~sound).alias("unsound")
    )
    found = found.join(nearest_rank(samples, [group], value, 0.95).withColumnRenamed("value", "p95"), group, "left")
    base = found.where(F.col(group) == idle).select(F.col("p95").alias("base"), F.col("samples").alias("base_samples"))  # one row
    ratio = F.try_divide("p95", "base")
    passes = (ratio <= most_ratio) & (F.col("samples") >= least_samples) & (F.col("base_samples") >= least_samples) & (F.col("unsound") == 0)
    return found.join(base, how="left").select(group, "samples", "p95", F.round(ratio, 9).alias("ratio"), F.coalesce(passes, F.lit(False)).alias("passes"))
