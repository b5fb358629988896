"""Keyed logic that looks at the clocks: windows that fire again by processing time, watermarks read in the logic, and
state that another query left behind."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillspark.streaming.processors import PROVIDER, Ordered, RunningSum, held, millis


class PeriodicFire(Ordered):
    """Tumbling event-time windows that come out again every ``every_ms`` of processing time, as far as rows have come.

    Timers stand at whole multiples of the interval, the last one at the window's end; there the window comes out for
    good and is forgotten. They fire without new rows, and as a window's end caps them, a stalled stream makes at most
    ``size_ms / every_ms`` + 1 of them. A window whose end has passed already fires once. Rows that come after that open
    the window anew, with a count of their own.
    """

    fields = {"window_start_ms": "bigint", "fire_ms": "bigint", "cnt": "bigint", "last": "boolean"}
    time_mode = "ProcessingTime"

    def __init__(self, size_ms: int, every_ms: int) -> None:
        self.size_ms, self.every_ms = size_ms, every_ms

    def open(self, handle):
        self.windows = handle.getMapState("windows", "start bigint", "n bigint, fire bigint")

    def next_fire(self, now: int, start: int) -> int:
        return min(now - now % self.every_ms + self.every_ms, start + self.size_ms)

    def row(self, key, row):
        start = millis(row.at) - millis(row.at) % self.size_ms
        if self.windows.containsKey((start,)):
            n, fire = self.windows.getValue((start,))
        else:
            n, fire = 0, self.next_fire(self.now_ms, start)
            self.handle.registerTimer(max(fire, self.now_ms + 1))
        self.windows.updateValue((start,), (n + 1, fire))
        return []

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, out = timerValues.getCurrentProcessingTimeInMs(), []
        for (start,), (n, fire) in list(self.windows.iterator()):
            if fire > now:
                continue
            end = start + self.size_ms
            out.append((key[0], start, fire, n, fire >= end))
            if fire >= end:
                self.windows.removeKey((start,))
            else:  # intervals that passed unseen are skipped
                fire = self.next_fire(now, start)
                self.windows.updateValue((start,), (n, fire))
                self.handle.registerTimer(max(fire, now + 1))
        yield from self.emitted(out)


class ReadWatermark(Ordered):
    """Each row with the watermark that stands when it is handled, and with its key's own one.

    The key's own watermark trails the largest time of the rows before it by ``delay_ms``; with a ``marker`` only rows
    where that column is true move it. A row before it is late, which only this logic knows: Spark has let it pass.
    """

    fields = {"id": "id", "watermark_ms": "bigint", "own_ms": "bigint", "late": "boolean"}
    time_mode = "EventTime"

    def __init__(self, delay_ms: int, marker: str | None = None) -> None:
        self.delay_ms, self.marker = delay_ms, marker

    def open(self, handle):
        self.top = handle.getValueState("top", "at bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        """Rows in order of arrival, that of their ids."""
        mark = timerValues.getCurrentWatermarkInMs()
        frame = pd.concat(list(rows)).rename(columns=self.names).sort_values("id", kind="stable")
        top, out = held(self.top, None), []
        for row in frame.itertuples():
            at = millis(row.at)
            own = None if top is None else top - self.delay_ms
            out.append((key[0], row.id, mark, own, own is not None and at < own))
            if self.marker is None or getattr(row, self.marker):
                top = at if top is None else max(top, at)
        if top is not None:
            self.top.update((top,))
        table = pd.DataFrame(out, columns=self.columns)
        table["own_ms"] = table["own_ms"].astype("Int64")
        yield table


class WatermarkAtFire(Ordered):
    """Counts of tumbling windows, with the watermark that stood when each was fired."""

    fields = {"window_start_ms": "bigint", "cnt": "bigint", "watermark_ms": "bigint"}
    time_mode = "EventTime"

    def __init__(self, size_ms: int) -> None:
        self.size_ms = size_ms

    def open(self, handle):
        self.counts = handle.getMapState("counts", "start bigint", "n bigint")

    def row(self, key, row):
        start = millis(row.at) - millis(row.at) % self.size_ms
        n = self.counts.getValue((start,))[0] if self.counts.containsKey((start,)) else 0
        self.counts.updateValue((start,), (n + 1,))
        self.handle.registerTimer(start + self.size_ms)
        return []

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        start = expiredTimerInfo.getExpiryTimeInMs() - self.size_ms
        n = self.counts.getValue((start,))[0]
        self.counts.removeKey((start,))
        yield from self.emitted([(key[0], start, n, timerValues.getCurrentWatermarkInMs())])


class SeededSum(RunningSum):
    """A running sum that starts from what another query's state held, by key."""

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.sum.update((self.cast(initialState["s"].iloc[0]),))
        self.flush()


def seeded(rows: DataFrame, key: str, processor: SeededSum, initial: DataFrame, value: str = "vc", order: tuple[str, str] = ("ts", "event_id")) -> DataFrame:
    """``processors.run`` from an initial state: ``initial`` has a row (key, s) for each key that has any."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    processor.bind(rows, key, value, order)
    return rows.groupBy(key).transformWithStateInPandas(processor, processor.schema, "append", processor.time_mode, initial.groupBy(key))


def state_of(spark: SparkSession, checkpoint: str, variable: str) -> DataFrame:
    """What a stopped query's state holds in a value state: the key's columns and the value's, read from its checkpoint."""
    rows = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", variable).load()
    return rows.select("key.*", "value.*")


def live_keys(spark: SparkSession, checkpoint: str, variable: str) -> int:
    """How many keys a state variable holds: one that never shrinks points to state without expiry."""
    return state_of(spark, checkpoint, variable).select(F.count("*")).first()[0]
