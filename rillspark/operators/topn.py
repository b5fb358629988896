"""Top-N: over everything, per window, and averages over the last rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillspark.operators.windows import windowed


def rows_average(df: DataFrame, key: str, value: str, order: list[str], preceding: int) -> DataFrame:
    """The whole-number average of a key's last ``preceding`` rows and the current one."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(-preceding, 0)
    rows = df.withColumn("total", F.sum(value).over(w)).withColumn("n", F.count(value).over(w))
    return rows.withColumn("average", F.expr("total div n")).drop("total", "n")


def topn_global(df: DataFrame, key: str, n: int) -> DataFrame:
    """The ``n`` keys with the most rows, ties by key. Ranks only the ``n`` rows left by a limit, which each task applies first."""
    best = df.groupBy(key).agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), key).limit(n)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("cnt"), key)))


def topn_per_window(df: DataFrame, time: str, size: str, key: str, n: int, slide: str | None = None) -> DataFrame:
    """The ``n`` keys with the most rows in each window, ties by key; fewer where a window has fewer."""
    counts = windowed(df, time, size, [key], F.count("*").alias("cnt"), slide=slide)
    rank = F.row_number().over(Window.partitionBy("window_start", "window_end").orderBy(F.desc("cnt"), key))
    return counts.withColumn("rank", rank).where(F.col("rank") <= n)


def topn_all_window(df: DataFrame, time: str, size: str, slide: str, key: str, n: int) -> DataFrame:
    """The same by window end alone. Each task drops what can't be among the ``n`` before the rows of a window meet."""
    return topn_per_window(df, time, size, key, n, slide).select("window_end", "rank", key, "cnt")


def top_values(df: DataFrame, key: str, value: str, n: int, order: list[str]) -> DataFrame:
    """A table aggregate: each key's ``n`` largest values as rows with their rank; equal values each count."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(value), *order))
    return df.withColumn("rank", rank).where(F.col("rank") <= n).select(key, "rank", value)
