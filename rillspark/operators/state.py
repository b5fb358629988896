"""Keyed state in batch form: what a stateful function emits after each row, by segmented scans (``scan.py``)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillspark.operators import scan as S


def jump_alerts(df: DataFrame, key: str, value: str, order: list[str], jump: float) -> DataFrame:
    """Rows whose value differs from the key's one before, at first from 0, by more than ``jump``."""
    rows = S.scan(df, key, order, previous=S.previous(F.col(value), order, 0))
    return rows.where(F.abs(F.col(value) - F.col("previous")) > jump)


class Largest(S.State):
    """The ``n`` largest values, falling. Nulls are no values."""

    def __init__(self, n: int, values: list | None = None) -> None:
        self.n, self.values = n, values or []

    def rows(self, values: pa.Array) -> pa.Array:
        out, best = [], self.values
        for v in values.to_pylist():
            if v is not None and (len(best) < self.n or v > best[-1]):
                best = sorted([*best, v], reverse=True)[: self.n]
            out.append(best)
        self.values = best
        return pa.array(out, pa.list_(values.type))

    def merged(self, later: Largest) -> None:
        self.values = sorted(self.values + later.values, reverse=True)[: self.n]

    def saved(self) -> list:
        return self.values


def top_so_far(df: DataFrame, key: str, value: str, order: list[str], n: int = 3) -> DataFrame:
    """After each row the key's ``n`` largest values, falling. A step keeps ``n`` values, which a window can't."""
    kind = f"array<{df.schema[value].dataType.simpleString()}>"
    return S.folded(df, key, value, order, lambda: Largest(n), lambda saved: Largest(n, list(saved)), kind, "top", kind)


class Counts(S.State):
    """How often each value has come. Nulls are no values."""

    def __init__(self, counts: dict | None = None) -> None:
        self.counts = counts or {}

    def rows(self, values: pa.Array) -> pa.Array:
        """The map after each row, values ascending: a matrix of rows by values, added up along the rows, in blocks."""
        new = [v for v in values.unique().to_pylist() if v is not None]
        known = sorted(self.counts.keys() | set(new))
        place = {v: i for i, v in enumerate(known)}
        code = np.array([place.get(v, -1) for v in values.to_pylist()], np.int64)
        now = np.array([self.counts.get(v, 0) for v in known], np.int64)
        sizes, keys, numbers = [], [], []
        block = max(1, (1 << 20) // max(len(known), 1))
        for a in range(0, len(code), block):
            some = code[a : a + block]
            hits = np.zeros((len(some), len(known)), np.int64)
            real = np.flatnonzero(some >= 0)
            hits[real, some[real]] = 1
            table = np.cumsum(hits, axis=0) + now
            now = table[-1] if len(table) else now
            row, column = np.nonzero(table)
            sizes.append(np.bincount(row, minlength=len(some)))
            keys.append(column)
            numbers.append(table[row, column])
        self.counts = {v: int(n) for v, n in zip(known, now, strict=True) if n}
        offsets = np.r_[0, np.cumsum(np.concatenate(sizes))].astype(np.int32)
        return pa.MapArray.from_arrays(pa.array(offsets), pa.array(known, values.type).take(pa.array(np.concatenate(keys))), pa.array(np.concatenate(numbers)))

    def merged(self, later: Counts) -> None:
        for v, n in later.counts.items():
            self.counts[v] = self.counts.get(v, 0) + n

    def saved(self) -> list:
        return list(self.counts.items())


def value_counts(df: DataFrame, key: str, value: str) -> DataFrame:
    """Each key's value-to-count map, values ascending."""
    counts = df.groupBy(key, value).agg(F.count("*").alias("n"))
    return counts.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(value, "n")))).alias("counts"))


def running_value_counts(df: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """The value-to-count map after each row. The output itself grows with rows times values of a key; ``value_counts``
    gives the last map only, ``value_count_changes`` the one entry that each row changes."""
    kind = f"map<{df.schema[value].dataType.simpleString()},bigint>"
    return S.folded(df, key, value, order, Counts, lambda saved: Counts(dict(saved)), kind, "counts", kind)


def value_count_changes(df: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """After each row how often its value has come in its key."""
    pair = df.select(key, *order, value).withColumn("pair", F.struct(key, value))
    return S.scan(pair, "pair", order, n=S.rows_so_far()).select(key, *order, value, "n")


def running_five_states(df: DataFrame, key: str, value: str, other: str, time: str, order: list[str]) -> DataFrame:
    """After each row, side by side: the value, the list's length, the map's size, the reduced sum with the first row's
    ``other`` and the newest time, and the average."""
    rows = df.select(key, *order, F.col(value).alias("value"), F.col(other).alias(f"first_{other}"), F.col(time).alias("newest"), F.struct(key, value).alias("pair"))
    rows = S.scan(rows, "pair", order, nth=S.rows_so_far()).drop("pair").withColumn("new", F.when((F.col("nth") == 1) & F.col("value").isNotNull(), 1).otherwise(0))
    out = S.scan(
        rows, key, order, list_size=S.known_so_far(F.col("value")), map_size=S.total(F.col("new")), reduced=S.total(F.col("value")),
        **{f"first_{other}": S.first(F.col(f"first_{other}"), order)}, newest=S.extreme(F.col("newest")),
    )
    return out.select(key, *order, "value", "list_size", "map_size", "reduced", f"first_{other}", "newest", mean("reduced", "list_size").alias("average"))


def mean(total: str, count: str) -> Column:
    return F.when(F.col(count) > 0, F.col(total) / F.col(count))


def running_average(df: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    rows = S.scan(df, key, order, **{"sum so far": S.total(F.col(value)), "values so far": S.known_so_far(F.col(value))})
    return rows.withColumn("running_avg", mean("sum so far", "values so far")).drop("sum so far", "values so far")


def average_every(df: DataFrame, key: str, value: str, order: list[str], every: int) -> DataFrame:
    """At each ``every``-th row of a key, the whole-number average of all its values so far."""
    rows = S.scan(df, key, order, total=S.total(F.col(value)), n=S.rows_so_far())
    return rows.where(F.col("n") % every == 0).withColumn("average", F.expr("total div n")).drop("total")


def five_states(df: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """The final value, list length, map size, reduced sum and average of each key, side by side."""
    last = F.max_by(value, F.struct(*order))
    return df.groupBy(key).agg(last.alias("last_value"), F.count(value).alias("list_size"), F.count_distinct(value).alias("map_size"), F.sum(value).alias("reduced"), F.avg(value).alias("average"))


def with_expiry(df: DataFrame, key: str, value: str, time: str, order: list[str], ttl_s: int, refresh_on_read: bool = False) -> DataFrame:
    """The value a key's state holds before each row: the last one written, unless it expired.

    State is written where ``value`` isn't null and read at every row; it lives ``ttl_s`` seconds from its last write,
    or with ``refresh_on_read`` from its last use while alive.
    """
    ttl = ttl_s * 1_000_000
    rows = df.withColumn("at", F.unix_micros(time)).withColumn("write", F.when(F.col(value).isNotNull(), F.struct(F.col(value).alias("value"), "at", F.struct(*order).alias("nth"))))
    if not refresh_on_read:
        out = S.scan(rows, key, order, write=S.last_known(F.col("write"), order, -1))
        return out.withColumn("held", F.when(F.col("at") - F.col("write.at") < ttl, F.col("write.value"))).drop("at", "write")
    rows = S.scan(rows, key, order, **{"at before": S.previous(F.col("at"), order)})
    lapse = F.when(F.col("at") - F.col("at before") >= ttl, F.struct(*order))
    out = S.scan(rows.withColumn("lapse", lapse), key, order, write=S.last_known(F.col("write"), order, -1), lapse=S.last_known(F.col("lapse"), order))
    alive = F.col("lapse").isNull() | (F.col("write.nth") >= F.col("lapse"))
    return out.withColumn("held", F.when(alive, F.col("write.value"))).drop("at", "at before", "write", "lapse")


def periodic_count(df: DataFrame, key: str, time: str, order: list[str], every_s: int) -> DataFrame:
    """Counts at timers: a key's first row sets one ``every_s`` later; when it fires, its rows so far are reported, and
    the next row sets the next one. A timer that no later row reaches fires at the end of the input.

    The timers depend on each other, so each key is walked through once, in order, in batches of its partition.
    """
    rows = df.select(F.col(key), F.unix_micros(time).alias("at"), *order).repartition(key).sortWithinPartitions(key, *order)
    step = every_s * 1_000_000

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, timer, count, out = None, None, 0, []
        for frame in frames:
            for k, at in zip(frame[key], frame["at"], strict=True):
                if k != now:
                    if timer is not None:
                        out.append((now, timer, count))
                    now, timer, count = k, None, 0
                if timer is not None and at > timer:
                    out.append((now, timer, count))
                    timer = None
                count += 1
                timer = at + step if timer is None else timer
            yield pd.DataFrame(out, columns=[key, "fire_us", "cnt"])
            out = []
        if timer is not None:
            yield pd.DataFrame([(now, timer, count)], columns=[key, "fire_us", "cnt"])

    kind = df.schema[key].dataType.simpleString()
    out = rows.mapInPandas(work, f"{key} {kind}, fire_us bigint, cnt bigint")
    return out.select(key, F.timestamp_micros("fire_us").cast("timestamp_ntz").alias("fire_time"), "cnt")


def event_timers(df: DataFrame, key: str, time: str, delay_s: int) -> DataFrame:
    """One timer per key and time: ``delay_s`` after each row; rows that set the same one are counted."""
    fire = (F.col(time) + F.expr(f"interval {delay_s} seconds")).cast("timestamp_ntz")
    return df.groupBy(key, fire.alias("fire_time")).agg(F.count("*").alias("set_by"))


def count_per_instance(df: DataFrame) -> DataFrame:
    """Rows per parallel instance, and what a restart redistributes: their sum."""
    return df.groupBy(F.spark_partition_id().alias("instance")).agg(F.count("*").alias("n"))
