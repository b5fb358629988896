"""Joins of two streams or tables: by window, by interval, by rules, by dimension, with changes and with reconciliation."""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillspark.operators.ranges import as_of


def bucketed(df: DataFrame, time: str, size_s: int, out: str = "bucket") -> DataFrame:
    return df.withColumn(out, F.floor(F.unix_seconds(time) / size_s))


def window_join(left: DataFrame, right: DataFrame, key: str, time: str, size_s: int) -> DataFrame:
    """Pairs of rows with the same key in the same tumbling window: an equi-join on (key, bucket), on streams too."""
    l, r = bucketed(left, time, size_s), bucketed(right, time, size_s)
    r = r.select(*[F.col(c).alias(c if c in (key, "bucket") else f"right_{c}") for c in r.columns])
    return l.join(r, [key, "bucket"])


def window_cogroup(left: DataFrame, right: DataFrame, key: str, time: str, size_s: int, value: str) -> DataFrame:
    """Both sides' sorted values per key and window, also where one side has none."""
    side = lambda df, out: bucketed(df, time, size_s).groupBy(key, "bucket").agg(F.sort_array(F.collect_list(value)).alias(out))
    both = side(left, "left_values").join(side(right, "right_values"), [key, "bucket"], "full")
    none = F.array().cast("array<bigint>")
    return both.select(key, "bucket", F.coalesce("left_values", none).alias("left_values"), F.coalesce("right_values", none).alias("right_values"))


def interval_join(left: DataFrame, right: DataFrame, key: str, time: str, low_s: int, high_s: int) -> DataFrame:
    """Pairs with right time in [left time + low, left time + high], both ends included.

    Rows meet by key and time bucket: a left row looks into the few buckets its interval touches, so no task compares a
    key's whole history.
    """
    size = max(1, high_s - low_s)
    at = F.unix_micros(time)
    l = left.withColumn("bucket", F.explode(F.sequence(F.floor((at + low_s * 1_000_000) / (size * 1_000_000)), F.floor((at + high_s * 1_000_000) / (size * 1_000_000)))))
    r = right.withColumn("bucket", F.floor(at / (size * 1_000_000)))
    r = r.select(*[F.col(c).alias(c if c in (key, "bucket") else f"right_{c}") for c in r.columns])
    gap = F.unix_micros(f"right_{time}") - F.unix_micros(time)
    return l.join(r, [key, "bucket"]).where(gap.between(low_s * 1_000_000, high_s * 1_000_000)).drop("bucket")


def stream_interval_join(left: DataFrame, right: DataFrame, key: str, time: str, low_s: int, high_s: int, how: str = "inner") -> DataFrame:
    """The same as a plain range condition, which lets Structured Streaming drop state; both sides need watermarks."""
    r = right.select(*[F.col(c).alias(f"right_{c}") for c in right.columns])
    near = (F.col(f"right_{time}") >= F.col(time) + F.expr(f"interval {low_s} seconds")) & (F.col(f"right_{time}") <= F.col(time) + F.expr(f"interval {high_s} seconds"))
    return left.join(r, (F.col(key) == F.col(f"right_{key}")) & near, how)


def full_history_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Every pair with equal keys once; rows without a partner never come out."""
    return left.join(right.select(*[F.col(c).alias(c if c == key else f"right_{c}") for c in right.columns]), key)


def connect_map(left: DataFrame, right: DataFrame, left_map: Column, right_map: Column, out: str = "value") -> DataFrame:
    """Two record types, one function each, into one stream."""
    return left.select(left_map.alias(out)).unionByName(right.select(right_map.alias(out)))


def union(first: DataFrame, *others: DataFrame) -> DataFrame:
    for other in others:
        first = first.unionByName(other)
    return first


def reconcile(left: DataFrame, right: DataFrame, key: str, time: str, within_s: int) -> DataFrame:
    """One row per key and side pair: matched within ``within_s``, or which side lacks the other."""
    l = left.select(key, F.col(time).alias("left_time"))
    r = right.select(key, F.col(time).alias("right_time"))
    both = l.join(r, key, "full")
    gap = F.abs(F.unix_micros("left_time") - F.unix_micros("right_time"))
    status = F.when(F.col("right_time").isNull(), "right missing").when(F.col("left_time").isNull(), "left missing").when(gap <= within_s * 1_000_000, "matched").otherwise("too late")
    return both.select(key, "left_time", "right_time", status.alias("status"))


def apply_changes(changes: DataFrame, key: str, order: list[str], columns: list[str], op: str = "op") -> DataFrame:
    """The latest row of each key from a feed of changes; keys whose last change deletes them are gone."""
    last = F.max_by(F.struct(op, *columns), F.struct(*order))
    return changes.groupBy(key).agg(last.alias("last")).where(F.col(f"last.{op}") != "DELETE").select(key, *[F.col(f"last.{c}").alias(c) for c in columns])


def dimension_lookup(facts: DataFrame, dimension: DataFrame, key: str, dim_key: str, most_bytes: int = 64 << 20) -> DataFrame:
    """Left join to a dimension, broadcast only if the plan's own size estimate is within ``most_bytes``, else shuffled."""
    size = int(str(dimension._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    side = F.broadcast(dimension) if size <= most_bytes else dimension
    return facts.join(side, facts[key] == side[dim_key], "left")


def cached_lookup(facts: DataFrame, dimension: DataFrame, key: str, dim_key: str) -> DataFrame:
    """Each distinct key is looked up once; keys that find nothing stay null and are not remembered."""
    found = facts.select(key).distinct().join(dimension, F.col(key) == dimension[dim_key]).drop(dim_key)
    return facts.join(found, key, "left")


def async_enrich(df: DataFrame, call: Callable[[dict], dict], schema: str, fallback: Callable[[dict], dict], capacity: int = 100, timeout_s: float = 19.0) -> DataFrame:
    """A slow call per row, at most ``capacity`` at once in each task; a call that takes too long gets ``fallback``.

    Time counts from a call's own start. A call that hangs is left behind with its threads, and nobody waits for it.
    """

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pool, waiting = ThreadPoolExecutor(capacity), deque()
        try:
            for frame in frames:
                rows, out = iter(frame.to_dict("records")), []
                while True:
                    while len(waiting) < capacity and (row := next(rows, None)) is not None:
                        waiting.append((row, pool.submit(call, row), time.monotonic() + timeout_s))
                    if not waiting:
                        break
                    row, answer, end = waiting.popleft()
                    try:
                        out.append(answer.result(max(0.0, end - time.monotonic())))
                    except TimeoutError:
                        out.append(fallback(row))
                        pool.shutdown(wait=False)  # its calls go on; new ones must not queue behind a hung thread
                        pool = ThreadPoolExecutor(capacity)
                yield pd.DataFrame(out)
        finally:
            pool.shutdown(wait=False, cancel_futures=True)

    return df.mapInPandas(work, schema)


def control_threshold(rows: DataFrame, control: DataFrame, time: str, value: str, threshold: str, default: float) -> DataFrame:
    """Rows above the latest control value at or before them, an as-of lookup over two streams without a key."""
    known = as_of(rows, control.groupBy(time).agg(F.max(threshold).alias(threshold)), [time], [threshold])
    held = known.withColumn("held", F.coalesce(threshold, F.lit(default))).drop(threshold)
    return held.where(F.col(value) > F.col("held"))


def pattern_rule(rows: DataFrame, rules: DataFrame, key: str, action: str, order: list[str]) -> DataFrame:
    """Rows whose key did ``action1`` just before and ``action2`` now, by the rule that was the last when the row came.

    ``rules`` has ``order``, action1 and action2. Rows before the first rule match nothing.
    """
    before = F.lag(action).over(Window.partitionBy(key).orderBy(*order))
    known = as_of(rows.withColumn("before", before), rules, order, ["action1", "action2"])
    return known.where((F.col("before") == F.col("action1")) & (F.col(action) == F.col("action2")))


def lateral_split(df: DataFrame, text_col: str, separator: str, keep_empty: bool) -> DataFrame:
    """Each row with each of its words and its length; rows without any vanish, or stay with nulls."""
    parts = F.filter(F.split(F.col(text_col), separator), lambda x: x != "")
    explode = F.explode_outer if keep_empty else F.explode
    return df.withColumn("word", explode(parts)).withColumn("length", F.length("word"))
