"""Event patterns per key: strict sequences, repetitions, an automaton, and relaxed sequences with a time limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def consecutive(df: DataFrame, key: str, is_hit: Column, order: list[str], times: int, time: str, kind: str | None = "timestamp_ntz") -> DataFrame:
    """Every run of ``times`` hits in a row with nothing between; runs overlap. One row each, with the times of all hits."""
    line = Window.partitionBy(key).orderBy(*order)
    rows = df.withColumn("hit", is_hit)
    for k in range(times):
        rows = rows.withColumn(f"time_{k + 1}", F.lead(time, k).over(line)).withColumn(f"hit_{k + 1}", F.lead("hit", k).over(line))
    all_hit = F.lit(True)
    for k in range(times):
        all_hit = all_hit & F.coalesce(F.col(f"hit_{k + 1}"), F.lit(False))
    out = [F.col(f"time_{k + 1}") for k in range(times)]
    return rows.where(all_hit).select(key, *[(c.cast(kind) if kind else c).alias(f"time_{k + 1}") for k, c in enumerate(out)])


def state_machine(df: DataFrame, key: str, is_hit: Column, order: list[str], times: int) -> DataFrame:
    """Alerts of an automaton in arrival order: from the ``times``-th hit since the last other event, every hit alerts."""
    line = Window.partitionBy(key).orderBy(*order)
    rows = df.withColumn("hit", is_hit).withColumn("resets", F.sum(F.when(F.col("hit"), 0).otherwise(1)).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    streak = F.sum(F.when(F.col("hit"), 1).otherwise(0)).over(Window.partitionBy(key, "resets").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("streak", streak).where(F.col("hit") & (F.col("streak") >= times)).drop("hit", "resets")


def followed_by(first: DataFrame, then: DataFrame, key: str, first_time: str, then_time: str, within_s: int) -> DataFrame:
    """For each first event the earliest then-event of its key at or after it and less than ``within_s`` later.

    Other events may lie between. One window per key finds it, so a key with many of both makes no pairs. ``status`` is "completed", or "timeout" where the limit passed without one.
    """
    start = first.select(key, F.struct(*first.columns).alias("row"), F.unix_micros(first_time).alias("at_us"), F.lit(None).cast("bigint").alias("then_us"))
    end = then.select(F.col(key), F.lit(None).cast(start.schema["row"].dataType).alias("row"), F.unix_micros(then_time).alias("at_us"), F.unix_micros(then_time).alias("then_us"))
    # Walked backwards, the last then-event so far is the next one after a row; at equal times it comes before the first.
    backwards = Window.partitionBy(key).orderBy(F.desc("at_us"), F.col("then_us").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    rows = start.unionByName(end).withColumn("next_us", F.last("then_us", True).over(backwards)).where("row is not null")
    rows = rows.withColumn("next_us", F.when(F.col("next_us") < F.col("at_us") + within_s * 1_000_000, F.col("next_us")))
    status = F.when(F.col("next_us").isNull(), "timeout").otherwise("completed")
    return rows.select("row.*", F.timestamp_micros("next_us").cast("timestamp_ntz").alias("matched_time"), status.alias("status"))
