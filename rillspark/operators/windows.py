"""Time, session, count and cumulative windows. Time windows align to the epoch; starts are inclusive, ends are not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bounds(window: str = "window") -> list[Column]:
    return [F.col(f"{window}.start").cast("timestamp_ntz").alias("window_start"), F.col(f"{window}.end").cast("timestamp_ntz").alias("window_end")]


def windowed(df: DataFrame, time: str, size: str, keys: list[str], *aggs: Column, slide: str | None = None) -> DataFrame:
    """Tumbling (or sliding) event-time windows per key; without keys the group-by still runs in parallel."""
    names = [c for c in keys]
    out = df.groupBy(*names, F.window(time, size, slide) if slide else F.window(time, size)).agg(*aggs)
    made = [c for c in out.columns if c not in (*names, "window")]
    return out.select(*names, *bounds(), *made)


def session(df: DataFrame, time: str, gap: str | Column, keys: list[str], *aggs: Column) -> DataFrame:
    """Sessions per key; ``gap`` is fixed or read from each row."""
    out = df.groupBy(*keys, F.session_window(time, gap)).agg(*aggs)
    made = [c for c in out.columns if c not in (*keys, "session_window")]
    return out.select(*keys, *bounds("session_window"), *made)


def count_tumbling(df: DataFrame, key: str, size: int, order: list[str], *aggs: Column) -> DataFrame:
    """Every ``size`` rows of a key; the last, incomplete window never comes out."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    rows = df.withColumn("nth", nth).withColumn("window_no", F.floor((F.col("nth") - 1) / size))
    return rows.groupBy(key, "window_no").agg(F.count("*").alias("n"), *aggs).where(F.col("n") == size)


def count_sliding(df: DataFrame, key: str, size: int, slide: int, order: list[str], **aggs: Column) -> DataFrame:
    """After every ``slide`` rows of a key, aggregates over its last ``size`` rows, or as many as there are."""
    line = Window.partitionBy(key).orderBy(*order)
    last = line.rowsBetween(1 - size, 0)
    rows = df.withColumn("nth", F.row_number().over(line)).withColumns({k: a.over(last) for k, a in aggs.items()})
    return rows.where(F.col("nth") % slide == 0).select(key, *order, "nth", *aggs)


def cumulate(df: DataFrame, time: str, step_s: int, size_s: int, keys: list[str], *aggs: Column) -> DataFrame:
    """Windows of ``size_s`` that also report after each ``step_s``: growing windows with a common start.

    Each row is exploded to the ends at or after its own step, at most ``size_s / step_s`` of them.
    """
    at = F.unix_seconds(time)
    start = at - F.pmod(at, F.lit(size_s))
    step_end = at - F.pmod(at, F.lit(step_s)) + step_s
    rows = df.withColumn("start_s", start).withColumn("end_s", F.explode(F.sequence(step_end, start + size_s, F.lit(step_s))))
    stamp = lambda c: F.timestamp_seconds(c).cast("timestamp_ntz")
    out = rows.groupBy(*keys, "start_s", "end_s").agg(*aggs)
    made = [c for c in out.columns if c not in (*keys, "start_s", "end_s")]
    return out.select(*keys, stamp("start_s").alias("window_start"), stamp("end_s").alias("window_end"), *made)


def early_fires(df: DataFrame, time: str, step_s: int, size_s: int, key: str) -> DataFrame:
    """The count so far at each whole step inside a tumbling window, from its start and without its end.

    A fire at t counts the rows up to and including t. Steps before a key's first row in the window don't fire.
    """
    at = F.unix_seconds(time)
    start = at - F.pmod(at, F.lit(size_s))
    exact = F.unix_micros(time)
    first = F.ceil(exact / (1_000_000 * step_s)) * step_s
    inside = F.sequence(first, start + size_s - step_s, F.lit(step_s))
    fires = F.when(first <= start + size_s - step_s, inside).otherwise(F.array().cast("array<bigint>"))
    rows = df.select(key, start.alias("start_s"), F.explode(fires).alias("fire_s"))
    out = rows.groupBy(key, "start_s", "fire_s").agg(F.count("*").alias("cnt"))
    stamp = lambda c: F.timestamp_seconds(c).cast("timestamp_ntz")
    return out.select(key, stamp("start_s").alias("window_start"), stamp("fire_s").alias("fire_time"), "cnt")


def manual_window(df: DataFrame, time: str, size_s: int, keys: list[str], *aggs: Column) -> DataFrame:
    """Tumbling windows by integer arithmetic on epoch seconds."""
    at = F.unix_seconds(time)
    rows = df.withColumn("start_s", at - F.pmod(at, F.lit(size_s)))
    out = rows.groupBy(*keys, "start_s").agg(*aggs)
    made = [c for c in out.columns if c not in (*keys, "start_s")]
    return out.select(*keys, F.timestamp_seconds("start_s").cast("timestamp_ntz").alias("window_start"), *made)
