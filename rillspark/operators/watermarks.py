"""Watermarks and late rows, as a batch model: rows carry an arrival time, the watermark trails the largest event time.

A running maximum over all arrivals would pull everything into one task. Here each range of arrivals finds its own
maximum first; the few maxima are put in order, and rows only look back within their range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillspark.operators.ranges import in_ranges, with_earlier, within


def with_watermark_column(df: DataFrame, time: str, arrival: list[str], delay_ms: int, keys: list[str] | None = None) -> DataFrame:
    """``watermark_ms`` after each row: the largest event time so far, less ``delay_ms`` and one millisecond.

    With ``keys``, each key is a source partition of its own.
    """
    rows = df.withColumn("event_ms", F.unix_millis(time))
    if keys:
        so_far = Window.partitionBy(*keys).orderBy(*arrival).rowsBetween(Window.unboundedPreceding, 0)
        return rows.withColumn("watermark_ms", F.max("event_ms").over(so_far) - delay_ms - 1)
    rows = with_earlier(in_ranges(rows, *arrival), F.max("event_ms"), F.max)
    largest = F.greatest(F.max("event_ms").over(within(order=tuple(arrival))), F.col("earlier"))
    return rows.withColumn("watermark_ms", largest - delay_ms - 1).drop("part", "earlier")


def late(size_ms: int, lateness_ms: int = 0) -> Column:
    """Whether a row's tumbling window was closed for good before the row came: tested against the watermark before it."""
    end = F.col("event_ms") - F.pmod(F.col("event_ms"), F.lit(size_ms)) + size_ms
    return F.coalesce(end + lateness_ms - 1 <= F.col("watermark_before"), F.lit(False))


def with_watermark_before(df: DataFrame, time: str, arrival: list[str], delay_ms: int, keys: list[str] | None = None) -> DataFrame:
    """``watermark_before`` is the watermark that a row meets: the one after the row before it, null for the first."""
    rows = with_watermark_column(df, time, arrival, delay_ms, keys)
    if keys:
        return rows.withColumn("watermark_before", F.lag("watermark_ms").over(Window.partitionBy(*keys).orderBy(*arrival)))
    # The watermark only falls behind a row's own event time if an earlier row set it, so the row itself can be left out:
    # where the row is the largest so far, it isn't late against any watermark before it either.
    own = F.col("event_ms") - F.lit(delay_ms + 1)
    return rows.withColumn("watermark_before", F.when(F.col("watermark_ms") > own, F.col("watermark_ms")))


def split_late(df: DataFrame, time: str, arrival: list[str], delay_ms: int, size_ms: int, lateness_ms: int = 0, keys: list[str] | None = None) -> DataFrame:
    """All rows with ``is_late``: true goes to the side output, false to the window."""
    return with_watermark_before(df, time, arrival, delay_ms, keys).withColumn("is_late", late(size_ms, lateness_ms))


def least_watermark(df: DataFrame, time: str, arrival: list[str], delay_ms: int, source: str) -> DataFrame:
    """The final watermark of each source partition, and the least of them, which holds downstream."""
    per = df.groupBy(source).agg((F.max(F.unix_millis(time)) - delay_ms - 1).alias("watermark_ms"))
    low = per.agg(F.min("watermark_ms").alias("joint_watermark_ms"))
    return per.crossJoin(F.broadcast(low))  # one row on the right
