"""Rows in one global order, by ranges: what a window over all rows would give, without one task for all rows.

The order is fixed by writing the ranges to the shared folder, so that sums of earlier ranges and the rows themselves
agree on where a range begins. There are as many ranges as the shuffle has partitions, of about equal numbers of rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillspark.session import scratch


def in_ranges(df: DataFrame, *order: str, out: str = "part") -> DataFrame:
    """``df`` with the number of its range of ``order``."""
    path = scratch(df.sparkSession, "ranges")
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(out, F.spark_partition_id())
    rows.write.parquet(path)
    return df.sparkSession.read.schema(rows.schema).parquet(path)


def with_earlier(rows: DataFrame, value: Column, carry: Callable[[Column], Column], keys: tuple[str, ...] = (), out: str = "earlier") -> DataFrame:
    """``rows`` of ``in_ranges`` with ``carry`` (a sum, a maximum, the last) of ``value`` over all earlier ranges.

    ``value`` is an aggregate of a range. The table of ranges has a row per range (and key), so it is broadcast.
    """
    per = rows.groupBy(*keys, "part").agg(value.alias("of range"))
    if keys:  # a key may be absent from a range, and its rows still need what came before
        ranges = rows.select("part").distinct().crossJoin(F.broadcast(rows.select(*keys).distinct()))
        per = ranges.join(per, [*keys, "part"], "left")
    before = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*keys, "part", carry(F.col("of range")).over(before).alias(out))
    return rows.join(F.broadcast(per), [*keys, "part"])


def within(*keys: str, order: tuple[str, ...]) -> Window:
    return Window.partitionBy(*keys, "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def as_of(rows: DataFrame, control: DataFrame, order: list[str], columns: list[str]) -> DataFrame:
    """Each row with ``columns`` of the last control row at or before it in ``order``; nulls before the first one."""
    held = F.struct(*columns).alias("held")
    tagged = rows.withColumn("is row", F.lit(1)).unionByName(control.select(*order, held).withColumn("is row", F.lit(0)), allowMissingColumns=True)
    line = in_ranges(tagged, *order, "is row")
    last = F.max_by("held", F.when(F.col("is row") == 0, F.struct(*order)))
    line = with_earlier(line, last, lambda c: F.last(c, True))
    now = F.coalesce(F.last("held", True).over(within(order=(*order, "is row"))), "earlier")
    out = line.withColumn("now", now).where(F.col("is row") == 1)
    return out.select(*rows.columns, *[F.col(f"now.{c}").alias(c) for c in columns])
