"""Aggregates per key: running ones after every row, and final ones.

Running forms are segmented scans (``scan.py``), which spread a key's rows over tasks; final forms are plain group-bys,
so that partial aggregation comes before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillspark.operators import scan as S
from rillspark.operators.ranges import in_ranges, with_earlier, within


def so_far(key: str, order: list[str]) -> Window:
    return Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def words(df: DataFrame, text_col: str) -> DataFrame:
    """Words between single spaces; a text's trailing empty words are no words, inner ones are."""
    trimmed = F.rtrim(F.col(text_col))
    return df.where(F.length(trimmed) > 0).select(F.explode(F.split(trimmed, " ")).alias("word"))


def word_count(df: DataFrame, text_col: str) -> DataFrame:
    return words(df, text_col).groupBy("word").agg(F.count("*").alias("cnt"))


def running_sum(df: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    return S.scan(df, key, order, running_sum=S.total(F.col(value)))


def running_extreme(df: DataFrame, key: str, value: str, others: list[str], order: list[str], kind: str = "max") -> DataFrame:
    """The extreme of ``value`` so far; other fields stay those of the key's first row."""
    rows = df.select(key, *order, F.col(value).alias("value so far"), *[F.col(c).alias(f"first_{c}") for c in others])
    out = S.scan(rows, key, order, **{"value so far": S.extreme(F.col("value so far"), kind)}, **{f"first_{c}": S.first(F.col(f"first_{c}"), order) for c in others})
    return out.select(key, *order, F.col("value so far").alias(value), *[f"first_{c}" for c in others])


def running_extreme_row(df: DataFrame, key: str, value: str, others: list[str], order: list[str], kind: str = "max") -> DataFrame:
    """The extreme so far with the other fields of its row; of ties the first row counts."""
    whole = F.struct(*[F.col(c) for c in [value, *others]])
    out = S.scan(df, key, order, best=S.best(F.col(value) if kind == "max" else -F.col(value), whole))
    return out.select(key, *order, *[F.col(f"best.{c}").alias(f"best_{c}") for c in [value, *others]])


def keyed_reduce(df: DataFrame, key: str, value: str, time: str, order: list[str]) -> DataFrame:
    """Final fold of each key: the sum of ``value`` and the newest ``time``."""
    return df.groupBy(key).agg(F.sum(value).alias("sum_value"), F.max_by(time, F.struct(*order)).alias("last_time"))


def most_active_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The key with the most rows; of ties the one seen last. Two levels, so only one row per key meets at the end."""
    counts = df.groupBy(key).agg(F.count("*").alias("cnt"), F.max(F.struct(*order)).alias("last"))
    return counts.agg(F.max_by(F.struct(key, "cnt"), F.struct("cnt", "last")).alias("top")).select("top.*")


def filtered_group_sum(df: DataFrame, where: Column, key: str, value: str) -> DataFrame:
    return df.where(where).groupBy(key).agg(F.sum(value).alias("sum_value"))


def distinct_by_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key, by an aggregate rather than a sort of whole groups."""
    return df.groupBy(key).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("first")).select("first.*")


def predicate_keyed_sum(df: DataFrame, test: Column, value: str) -> DataFrame:
    return df.groupBy(F.when(test, 0).otherwise(1).alias("side")).agg(F.sum(value).alias("sum_value"))


def running_collect(df: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """The growing list of each key. Its output grows with the square of a group; ``collected`` gives the last list only."""
    return df.select(key, *order, F.collect_list(value).over(so_far(key, order)).alias("values"))


def collected(df: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    pairs = F.sort_array(F.collect_list(F.struct(*order, value)))
    return df.groupBy(key).agg(pairs.alias("pairs")).select(key, F.col(f"pairs.{value}").alias("values"))


def global_running_count(df: DataFrame, order: str) -> DataFrame:
    """A running count over all rows without one task for all: ranges count first, and what came before them is added."""
    rows = with_earlier(in_ranges(df, order), F.count("*"), F.sum)
    nth = F.row_number().over(Window.partitionBy("part").orderBy(order))
    return rows.withColumn("running_count", nth + F.coalesce("earlier", F.lit(0))).drop("part", "earlier")


def running_reduce(df: DataFrame, key: str, value: str, time: str, order: list[str]) -> DataFrame:
    """The fold of each key after each row: the sum of ``value`` so far and the newest ``time``; the first comes out as it is."""
    out = S.scan(df, key, order, sum_value=S.total(F.col(value)), last_time=S.extreme(F.col(time)))
    return out.select(key, *order, "sum_value", "last_time")


def predicate_running_sum(df: DataFrame, test: Column, value: str, order: list[str]) -> DataFrame:
    """After each row the sum of its side so far. There are two sides, so sums go by ranges of the order."""
    rows = in_ranges(df.withColumn("side", F.when(test, 0).otherwise(1)), *order)
    rows = with_earlier(rows, F.sum(value), F.sum, ("side",))
    total = F.sum(value).over(within("side", order=tuple(order)))
    return rows.withColumn("running_sum", total + F.coalesce("earlier", F.lit(0))).drop("part", "earlier")
