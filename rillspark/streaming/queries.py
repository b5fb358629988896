"""Windowed, joined and ranked streams out of the same operators as the batch forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillspark.operators.windows import windowed


def closed_windows(rows: DataFrame, time: str, size: str, keys: list[str], *aggs: Column, slide: str | None = None) -> DataFrame:
    """Event-time windows of a stream with a watermark; in append mode each comes out once, when it is closed."""
    return windowed(rows, time, size, keys, *aggs, slide=slide)


def processing_windows(rows: DataFrame, size: str, keys: list[str], *aggs: Column, slide: str | None = None) -> DataFrame:
    """Windows by the time that rows are handled: all rows of a micro-batch fall at its start. Without lateness, a window
    closes with the first micro-batch that starts after its end and has rows."""
    handled = rows.withColumn("handled", F.current_timestamp()).withWatermark("handled", "0 seconds")
    return windowed(handled, "handled", size, keys, *aggs, slide=slide)


def views_per_user(rows: DataFrame, time: str, size: str, user: str, slide: str | None = None) -> DataFrame:
    """Rows per distinct user of each closed window."""
    return windowed(rows, time, size, [], (F.count("*") / F.size(F.collect_set(user))).alias("ratio"), slide=slide)


def unique_visitors(rows: DataFrame, time: str, size: str, user: str) -> DataFrame:
    """Distinct users per window: a set per window, since streams can't count distinct values."""
    return windowed(rows, time, size, [], F.size(F.collect_set(user)).alias("visitors"))


def cumulated(rows: DataFrame, time: str, step_s: int, size_s: int, keys: list[str], delay_s: int) -> DataFrame:
    """Growing windows: counts from a window's start to each of its steps, each once, when the watermark passes its end.

    ``rows`` has no watermark yet: it is put on the ends, which run ahead of the rows by up to ``size_s``.
    """
    at = F.unix_seconds(time)
    start = at - F.pmod(at, F.lit(size_s))
    ends = F.sequence(at - F.pmod(at, F.lit(step_s)) + step_s, start + size_s, F.lit(step_s))
    rows = rows.select(*keys, F.timestamp_seconds(start).alias("window_start"), F.explode(F.transform(ends, F.timestamp_seconds)).alias("window_end"))
    counts = rows.withWatermark("window_end", f"{delay_s + size_s} seconds").groupBy(*keys, "window_start", "window_end").agg(F.count("*").alias("cnt"))
    return counts.select(*keys, *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("window_start", "window_end")], "cnt")


def cogrouped(left: DataFrame, right: DataFrame, key: str, time: str, size: str, value: str) -> DataFrame:
    """Both sides' sorted values per key and window, when it is closed; ``left`` and ``right`` are streams with a watermark."""
    side = lambda df, k: df.select(key, time, F.when(F.lit(k == 0), F.col(value)).alias("left"), F.when(F.lit(k == 1), F.col(value)).alias("right"))
    lists = [F.sort_array(F.collect_list(c)).alias(f"{c}_values") for c in ("left", "right")]
    return windowed(side(left, 0).unionByName(side(right, 1)), time, size, [key], *lists)


def late_windows_writer(time: str, size_s: int, delay_s: int, lateness_s: int, path: str) -> Callable[[DataFrame, int], None]:
    """A batch writer of tumbling counts with allowed lateness: every micro-batch writes the counts of the windows that it
    touches, a fired one again; rows whose window is closed for good go to a side output.

    The watermark of a micro-batch is the largest time of those before it, less ``delay_s``. Each micro-batch carries on
    what the one before left: the largest time and the windows that are still open, so its cost doesn't grow with the age of
    the stream. All is written under its number and made from the number before alone, so a replayed one writes the
    same again. Read the windows with ``fired_windows`` and the late rows from ``{path}/late``.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        top, open_ = None, spark.createDataFrame([], "start_s bigint, cnt bigint")
        if number:
            top = spark.read.schema("top bigint").parquet(f"{path}/tops/number={number - 1}").agg(F.max("top")).first()[0]
            open_ = spark.read.schema(open_.schema).parquet(f"{path}/open/number={number - 1}")
        at = F.unix_seconds(time)
        rows = batch.withColumn("start_s", at - F.pmod(at, F.lit(size_s)))
        closed = lambda c: F.lit(False) if top is None else c + size_s + lateness_s <= top - delay_s
        rows.where(closed(F.col("start_s"))).drop("start_s").write.mode("overwrite").parquet(f"{path}/late/number={number}")
        new = rows.where(~closed(F.col("start_s"))).groupBy("start_s").agg(F.count("*").alias("n"))
        counts = new.join(open_.where(~closed(F.col("start_s"))), "start_s", "full").select("start_s", "n", (F.coalesce("n", F.lit(0)) + F.coalesce("cnt", F.lit(0))).alias("cnt"))
        counts.select("start_s", "cnt").write.mode("overwrite").parquet(f"{path}/open/number={number}")
        counts.where("n is not null").select("start_s", "cnt").write.mode("overwrite").parquet(f"{path}/fired/number={number}")
        batch.agg(F.greatest(F.max(at), F.lit(top)).alias("top")).where("top is not null").write.mode("overwrite").parquet(f"{path}/tops/number={number}")

    return write


def fired_windows(spark: SparkSession, path: str) -> DataFrame:
    """(window_start, cnt, number): every firing of every window; the last number has the final count."""
    rows = spark.read.schema("start_s bigint, cnt bigint, number bigint").parquet(f"{path}/fired")
    return rows.select(F.timestamp_seconds("start_s").cast("timestamp_ntz").alias("window_start"), "cnt", "number")


def rank_closed_windows(path: str, key: str, n: int) -> Callable[[DataFrame, int], None]:
    """A batch writer that ranks keys within each window that a micro-batch closed, and appends them under its number."""

    def write(batch: DataFrame, number: int) -> None:
        from pyspark.sql import Window

        rank = F.row_number().over(Window.partitionBy("window_start", "window_end").orderBy(F.desc("cnt"), key))
        batch.withColumn("rank", rank).where(F.col("rank") <= n).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def rank_all_writer(path: str, key: str, n: int) -> Callable[[DataFrame, int], None]:
    """A batch writer of the top list over everything so far, from counts in complete mode; the last number is the newest."""

    def write(batch: DataFrame, number: int) -> None:
        best = batch.orderBy(F.desc("cnt"), key).limit(n)
        best.withColumn("number", F.lit(number)).write.mode("overwrite").parquet(f"{path}/number={number}")

    return write


def control_writer(control: Callable[[], DataFrame], value: str, threshold: str, default: float, path: str) -> Callable[[DataFrame, int], None]:
    """A batch writer that re-reads the control table for every micro-batch and keeps rows above its last value."""

    def write(batch: DataFrame, number: int) -> None:
        last = control().agg(F.max_by(threshold, "seq").alias("held"))  # one row
        held = batch.crossJoin(F.broadcast(last)).withColumn("held", F.coalesce("held", F.lit(default)))
        held.where(F.col(value) > F.col("held")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


