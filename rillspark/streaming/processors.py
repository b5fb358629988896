"""Stateful processors for streams: one object per key's logic, with state that Spark keeps, checkpoints and expires.

Rows of a key arrive in any order within a micro-batch, so each processor sorts what it gets by (time, id) first. ``run``
tells a processor the names and types of the columns that it works on; it also works on batch frames.
"""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from rillspark.streaming.kept import Kept

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run(rows: DataFrame, key: str, processor: Ordered, value: str = "vc", order: tuple[str, str] = ("ts", "event_id"), mode: str = "append") -> DataFrame:
    """What ``processor`` emits: its rows by ``key``, in ``order`` (an instant and an id), about a numeric ``value``."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    processor.bind(rows, key, value, order)
    return rows.groupBy(key).transformWithStateInPandas(processor, processor.schema, mode, processor.time_mode)


class Ordered(StatefulProcessor):
    """Feeds a key's rows one by one, in order; ``row`` returns what to emit for each.

    ``fields`` names what is emitted after the key, with types; "id" and "number" stand for those of the id and the value.
    In ``row``, the time, id and value are ``row.at``, ``row.id`` and ``row.value``, the rest as it is called.
    States stay in Python while a key's rows pass, or a timer fires, unless a subclass handles these by itself.
    """

    fields: dict[str, str] = {}
    time_mode = "None"

    def bind(self, rows: DataFrame, key: str, value: str, order: tuple[str, str]) -> None:
        kind = lambda c: rows.schema[c].dataType.simpleString()
        whole = kind(value) in ("tinyint", "smallint", "int", "bigint")
        self.number, self.cast = ("bigint", int) if whole else ("double", float)
        self.key, self.names = key, {order[0]: "at", order[1]: "id", value: "value"}
        known = {"id": (order[1], kind(order[1])), "value": (value, self.number)}
        columns = [known.get(name, (name, self.number if form == "number" else form)) for name, form in self.fields.items()]
        self.columns = [key, *(name for name, _ in columns)]
        self.schema = ", ".join(f"{name} {form}" for name, form in [(key, kind(key)), *columns])

    def init(self, handle: StatefulProcessorHandle) -> None:
        own = type(self)
        plain = own.handleInputRows is not Ordered.handleInputRows or own.handleExpiredTimer is not Ordered.handleExpiredTimer
        self.handle = handle if plain else Kept(handle)
        self.tuples: dict[tuple, type] = {}
        self.open(self.handle)

    def flush(self) -> None:
        """Write the states that are kept."""
        if isinstance(self.handle, Kept):
            self.handle.flush()

    def open(self, handle: StatefulProcessorHandle) -> None:
        """Make the states."""

    def row(self, key, row) -> list[tuple]:
        """What to emit for a row."""
        return []

    def fired(self, key, at_ms: int) -> list[tuple]:
        """What to emit at a timer."""
        return []

    def emitted(self, out: list[tuple]) -> Iterator[pd.DataFrame]:
        if out:
            yield pd.DataFrame(out, columns=self.columns)

    def in_order(self, frames: list[pd.DataFrame]) -> Iterator[tuple]:
        """Rows by (time, id). Plain numbers are sorted as arrays: most keys have few rows, and a frame's own sort costs more than they do."""
        frame = pd.concat(frames) if len(frames) > 1 else frames[0]
        names = [self.names.get(c, c) for c in frame.columns]
        at, ids = (frame.iloc[:, names.index(c)] for c in ("at", "id"))
        if isinstance(at.dtype, np.dtype) and isinstance(ids.dtype, np.dtype) and at.dtype.kind == "M" and ids.dtype.kind in "iu":
            order = np.lexsort((ids.to_numpy(), at.to_numpy()))
        else:
            order = pd.DataFrame({"at": at.array, "id": ids.array}).sort_values(["at", "id"], kind="stable").index
        one = self.tuples.get(tuple(names)) or self.tuples.setdefault(tuple(names), namedtuple("Row", names, rename=True))
        return map(one._make, zip(*(frame.iloc[:, i].take(order) for i in range(len(names))), strict=True))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        self.now_ms = timerValues.getCurrentProcessingTimeInMs() if self.time_mode == "ProcessingTime" else None
        out = [x for row in self.in_order(list(rows)) for x in self.row(key[0], row)]
        self.flush()
        yield from self.emitted(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = self.fired(key[0], expiredTimerInfo.getExpiryTimeInMs())
        self.flush()
        yield from self.emitted(out)

    def close(self) -> None:
        """Nothing is held outside states."""


def held(state, default):
    return state.get()[0] if state.exists() else default


def millis(at) -> int:
    return int(at.timestamp() * 1000)


class RunningSum(Ordered):
    """The key's sum after each row: a reducing state."""

    fields = {"id": "id", "running_sum": "number"}

    def open(self, handle):
        self.sum = handle.getValueState("sum", f"s {self.number}")

    def row(self, key, row):
        total = held(self.sum, 0) + self.cast(row.value)
        self.sum.update((total,))
        return [(key, row.id, total)]


class RunningExtreme(Ordered):
    """The extreme so far, with ``other`` of the key's first row, or, if ``of_best``, of the extreme's own."""

    def __init__(self, kind: str, other: str, of_best: bool = False) -> None:
        self.kind, self.other, self.of_best = kind, other, of_best
        self.fields = {"id": "id", "best_value": "number", f"{'best' if of_best else 'first'}_{other}": "string"}

    def open(self, handle):
        self.best = handle.getValueState("best", f"v {self.number}, other string")

    def row(self, key, row):
        value, other = self.cast(row.value), getattr(row, self.other)
        if self.best.exists():
            best, kept = self.best.get()
            better = value > best if self.kind == "max" else value < best
            value, other = (value if better else best), (other if better and self.of_best else kept)
        self.best.update((value, other))
        return [(key, row.id, value, other)]


class RunningReduce(Ordered):
    """The sum so far and the newest time, after each row."""

    fields = {"id": "id", "sum_value": "number", "last_time": "timestamp"}

    def open(self, handle):
        self.both = handle.getValueState("both", f"s {self.number}, at timestamp")

    def row(self, key, row):
        total, at = self.both.get() if self.both.exists() else (0, row.at)
        total, at = total + self.cast(row.value), max(pd.Timestamp(at).tz_localize(None), pd.Timestamp(row.at).tz_localize(None))
        self.both.update((total, at))
        return [(key, row.id, total, at)]


class RunningAverage(Ordered):
    """The average so far: an aggregating state."""

    fields = {"id": "id", "running_avg": "double"}

    def open(self, handle):
        self.both = handle.getValueState("both", f"n bigint, s {self.number}")

    def row(self, key, row):
        n, s = self.both.get() if self.both.exists() else (0, 0)
        n, s = n + 1, s + self.cast(row.value)
        self.both.update((n, s))
        return [(key, row.id, s / n)]


class FiveStates(Ordered):
    """Value, list, map, reducing and aggregating state side by side, after each row; the reduced one keeps the first ``other``."""

    def __init__(self, other: str) -> None:
        self.other = other
        self.fields = {"id": "id", "value": "number", "list_size": "bigint", "map_size": "bigint", "reduced": "number", f"first_{other}": "string", "average": "double"}

    def open(self, handle):
        self.list = handle.getListState("list", f"v {self.number}")
        self.map = handle.getMapState("map", f"v {self.number}", "n bigint")
        self.sizes = handle.getValueState("sizes", "n bigint, kinds bigint")
        self.sum = handle.getValueState("sum", f"s {self.number}, other string")

    def row(self, key, row):
        value = self.cast(row.value)
        self.list.appendValue((value,))
        known = self.map.containsKey((value,))
        self.map.updateValue((value,), (self.map.getValue((value,))[0] + 1 if known else 1,))
        n, kinds = self.sizes.get() if self.sizes.exists() else (0, 0)
        n, kinds = n + 1, kinds + (not known)
        self.sizes.update((n, kinds))
        total, other = self.sum.get() if self.sum.exists() else (0, getattr(row, self.other))
        total += value
        self.sum.update((total, other))
        return [(key, row.id, value, n, kinds, total, other, total / n)]


class JumpAlert(Ordered):
    """Rows that differ from the one before by more than ``jump``; at first from 0."""

    fields = {"id": "id", "value": "number", "previous": "number"}

    def __init__(self, jump: float) -> None:
        self.jump = jump

    def open(self, handle):
        self.last = handle.getValueState("last", f"v {self.number}")

    def row(self, key, row):
        before = held(self.last, 0)
        self.last.update((self.cast(row.value),))
        return [(key, row.id, self.cast(row.value), before)] if abs(row.value - before) > self.jump else []


class TopSoFar(Ordered):
    """After each row the key's largest values, as text: a list state of bounded length."""

    fields = {"id": "id", "top": "string"}

    def __init__(self, n: int = 3) -> None:
        self.n = n

    def open(self, handle):
        self.values = handle.getListState("values", f"v {self.number}")

    def row(self, key, row):
        best = sorted([*(x[0] for x in self.values.get()), self.cast(row.value)], reverse=True)[: self.n]
        self.values.put([(x,) for x in best])
        return [(key, row.id, ",".join(map(str, best)))]


class ValueCounts(Ordered):
    """After each row how often its value has come: a map state."""

    fields = {"id": "id", "value": "number", "n": "bigint"}

    def open(self, handle):
        self.counts = handle.getMapState("counts", f"v {self.number}", "n bigint")

    def row(self, key, row):
        value = (self.cast(row.value),)
        n = self.counts.getValue(value)[0] + 1 if self.counts.containsKey(value) else 1
        self.counts.updateValue(value, (n,))
        return [(key, row.id, value[0], n)]


class AverageEvery(Ordered):
    """At each n-th row of a key the whole-number average of all its values so far."""

    fields = {"id": "id", "n": "bigint", "average": "bigint"}

    def __init__(self, every: int) -> None:
        self.every = every

    def open(self, handle):
        self.both = handle.getValueState("both", "n bigint, s bigint")

    def row(self, key, row):
        n, s = self.both.get() if self.both.exists() else (0, 0)
        n, s = n + 1, s + int(row.value)
        self.both.update((n, s))
        return [(key, row.id, n, s // n)] if n % self.every == 0 else []


class RowsAverage(Ordered):
    """The whole-number average of a key's last ``size`` rows after each: a list state as an analytic window."""

    fields = {"id": "id", "average": "bigint"}

    def __init__(self, size: int) -> None:
        self.size = size

    def open(self, handle):
        self.last = handle.getListState("last", "v bigint")

    def row(self, key, row):
        values = [*(x[0] for x in self.last.get()), int(row.value)][-self.size :]
        self.last.put([(x,) for x in values])
        return [(key, row.id, sum(values) // len(values))]


class Changelog(Ordered):
    """A key's count as changes: +I, then -U and +U."""

    fields = {"id": "id", "op": "string", "cnt": "bigint"}

    def open(self, handle):
        self.count = handle.getValueState("count", "n bigint")

    def row(self, key, row):
        n = held(self.count, 0)
        self.count.update((n + 1,))
        return [(key, row.id, "+I", 1)] if n == 0 else [(key, row.id, "-U", n), (key, row.id, "+U", n + 1)]


class CountWindow(Ordered):
    """The sum of every ``size`` rows of a key, once they are there."""

    fields = {"window_no": "bigint", "n": "bigint", "sum_value": "number"}

    def __init__(self, size: int) -> None:
        self.size = size

    def open(self, handle):
        self.both = handle.getValueState("both", f"n bigint, s {self.number}")

    def row(self, key, row):
        n, s = self.both.get() if self.both.exists() else (0, 0)
        n, s = n + 1, s + self.cast(row.value)
        full = n % self.size == 0
        self.both.update((n, 0 if full else s))
        return [(key, n // self.size - 1, self.size, s)] if full else []


class SlidingCount(Ordered):
    """After every ``slide`` rows of a key the sum of its last ``size`` rows, or of as many as there are."""

    fields = {"id": "id", "nth": "bigint", "sum_value": "number"}

    def __init__(self, size: int, slide: int) -> None:
        self.size, self.slide = size, slide

    def open(self, handle):
        self.n = handle.getValueState("n", "n bigint")
        self.last = handle.getListState("last", f"v {self.number}")

    def row(self, key, row):
        n, values = held(self.n, 0) + 1, [*(x[0] for x in self.last.get()), self.cast(row.value)][-self.size :]
        self.n.update((n,))
        self.last.put([(x,) for x in values])
        return [(key, row.id, n, sum(values))] if n % self.slide == 0 else []


class HitStreak(Ordered):
    """The automaton of repeated hits: from the ``times``-th since another event, every hit alerts."""

    fields = {"id": "id", "streak": "bigint"}

    def __init__(self, column: str, hit: str, times: int) -> None:
        self.column, self.hit, self.times = column, hit, times

    def open(self, handle):
        self.streak = handle.getValueState("streak", "n bigint")

    def row(self, key, row):
        n = held(self.streak, 0) + 1 if getattr(row, self.column) == self.hit else 0
        self.streak.update((n,))
        return [(key, row.id, n)] if n >= self.times else []


class ConsecutiveHits(Ordered):
    """Every run of ``times`` hits in a row with nothing between, as the ids of its first and last; runs overlap."""

    fields = {"first_id": "bigint", "last_id": "bigint"}

    def __init__(self, column: str, hit: str, times: int) -> None:
        self.column, self.hit, self.times = column, hit, times

    def open(self, handle):
        self.run = handle.getListState("run", "id bigint")

    def row(self, key, row):
        if getattr(row, self.column) != self.hit:
            self.run.clear()
            return []
        ids = [*(x[0] for x in self.run.get()), int(row.id)][-self.times :]
        self.run.put([(x,) for x in ids])
        return [(key, ids[0], ids[-1])] if len(ids) == self.times else []


class Buffered(Ordered):
    """Rows of a key held back until there are ``size``, then all of them, with the number of the flush. What is held
    is state, so it outlives a restart; with a transactional sink each row of a flush comes out once."""

    fields = {"flush": "bigint", "id": "id", "value": "number"}

    def __init__(self, size: int) -> None:
        self.size = size

    def open(self, handle):
        self.held = handle.getListState("held", f"id bigint, v {self.number}")
        self.sizes = handle.getValueState("sizes", "flushes bigint, held bigint")

    def row(self, key, row):
        flushes, n = self.sizes.get() if self.sizes.exists() else (0, 0)
        self.held.appendValue((int(row.id), self.cast(row.value)))
        if n + 1 < self.size:
            self.sizes.update((flushes, n + 1))
            return []
        out = [(key, flushes, i, v) for i, v in self.held.get()]
        self.held.clear()
        self.sizes.update((flushes + 1, 0))
        return out


class ExpiringValue(Ordered):
    """The value held before each row; it expires ``ttl_ms`` of processing time after its last write.

    ``refresh_on_read`` writes it back at every read, so that a read counts as a use.
    """

    fields = {"id": "id", "held": "number"}
    time_mode = "ProcessingTime"

    def __init__(self, ttl_ms: int, refresh_on_read: bool = False) -> None:
        self.ttl_ms, self.refresh = ttl_ms, refresh_on_read

    def open(self, handle):
        self.state = handle.getValueState("value", f"v {self.number}", ttlDurationMs=self.ttl_ms)

    def row(self, key, row):
        before = held(self.state, None)
        if row.value == row.value and row.value is not None:
            self.state.update((self.cast(row.value),))
        elif self.refresh and before is not None:
            self.state.update((before,))
        return [(key, row.id, before)]


class TimedCount(Ordered):
    """Periodic counts: a key's first row sets an event-time timer; when the watermark passes it, the count so far comes
    out, and the next row sets the next timer."""

    fields = {"fire_ms": "bigint", "cnt": "bigint"}
    time_mode = "EventTime"

    def __init__(self, every_ms: int) -> None:
        self.every_ms = every_ms

    def open(self, handle):
        self.count = handle.getValueState("count", "n bigint")
        self.timer = handle.getValueState("timer", "at bigint")

    def row(self, key, row):
        self.count.update((held(self.count, 0) + 1,))
        if not self.timer.exists():
            self.timer.update((millis(row.at) + self.every_ms,))
            self.handle.registerTimer(millis(row.at) + self.every_ms)
        return []

    def fired(self, key, at_ms):
        self.timer.clear()
        return [(key, at_ms, held(self.count, 0))]


class EventTimer(Ordered):
    """One timer per key and time, ``delay_ms`` after each row: when it fires, how many rows had set it."""

    fields = {"fire_ms": "bigint", "set_by": "bigint"}
    time_mode = "EventTime"

    def __init__(self, delay_ms: int) -> None:
        self.delay_ms = delay_ms

    def open(self, handle):
        self.setters = handle.getMapState("setters", "at bigint", "n bigint")

    def row(self, key, row):
        at = (millis(row.at) + self.delay_ms,)
        n = self.setters.getValue(at)[0] if self.setters.containsKey(at) else 0
        self.setters.updateValue(at, (n + 1,))
        self.handle.registerTimer(at[0])
        return []

    def fired(self, key, at_ms):
        n = self.setters.getValue((at_ms,))[0]
        self.setters.removeKey((at_ms,))
        return [(key, at_ms, n)]


class ProcessingTimer(EventTimer):
    """The same by the time that rows are handled: one timer per key and micro-batch."""

    time_mode = "ProcessingTime"

    def row(self, key, row):
        at = (self.now_ms + self.delay_ms,)
        n = self.setters.getValue(at)[0] if self.setters.containsKey(at) else 0
        self.setters.updateValue(at, (n + 1,))
        self.handle.registerTimer(at[0])
        return []


class ManualWindow(Ordered):
    """Tumbling windows kept by hand: a count per window start, which comes out at the window's end; with ``step_ms``
    also at every whole step inside the window from the key's first row on, as far as rows had come by then."""

    fields = {"window_start_ms": "bigint", "fire_ms": "bigint", "cnt": "bigint"}
    time_mode = "EventTime"

    def __init__(self, size_ms: int, step_ms: int | None = None) -> None:
        self.size_ms, self.step_ms = size_ms, step_ms or size_ms

    def open(self, handle):
        self.rows = handle.getMapState("rows", "start bigint, step bigint", "n bigint")

    def row(self, key, row):
        at = millis(row.at)
        start, step = at - at % self.size_ms, at - at % self.step_ms
        for fire in range(step + self.step_ms, start + self.size_ms + 1, self.step_ms):
            self.handle.registerTimer(fire)
        n = self.rows.getValue((start, step))[0] if self.rows.containsKey((start, step)) else 0
        self.rows.updateValue((start, step), (n + 1,))
        return []

    def fired(self, key, at_ms):
        start = at_ms - 1 - (at_ms - 1) % self.size_ms
        steps = range(start, at_ms, self.step_ms)
        count = sum(self.rows.getValue((start, s))[0] for s in steps if self.rows.containsKey((start, s)))
        if at_ms == start + self.size_ms:
            for s in steps:
                if self.rows.containsKey((start, s)):
                    self.rows.removeKey((start, s))
        return [(key, start, at_ms, count)] if count else []


class Reconcile(Ordered):
    """Two halves of a bill, told apart by ``column``: "matched" when the second comes, or at ``within_ms`` after the first
    which side is missing. A half that comes after that opens the bill anew."""

    fields = {"status": "string"}
    time_mode = "EventTime"

    def __init__(self, column: str, left: str, within_ms: int) -> None:
        self.column, self.left, self.within_ms = column, left, within_ms

    def open(self, handle):
        self.first = handle.getValueState("first", "side string, timer bigint")

    def row(self, key, row):
        side = "left" if getattr(row, self.column) == self.left else "right"
        if self.first.exists() and self.first.get()[0] != side and millis(row.at) <= self.first.get()[1]:
            self.handle.deleteTimer(self.first.get()[1])
            self.first.clear()
            return [(key, "matched")]
        if not self.first.exists():
            timer = millis(row.at) + self.within_ms
            self.first.update((side, timer))
            self.handle.registerTimer(timer)
        return []

    def fired(self, key, at_ms):
        if not self.first.exists():
            return []
        side = self.first.get()[0]
        self.first.clear()
        return [(key, "right missing" if side == "left" else "left missing")]


class FollowedBy(Ordered):
    """For each first event of a key the next then-event less than ``within_ms`` later, or a timeout."""

    fields = {"first_id": "bigint", "status": "string"}
    time_mode = "EventTime"

    def __init__(self, column: str, first: str, then: str, within_ms: int) -> None:
        self.column, self.one, self.two, self.within_ms = column, first, then, within_ms

    def open(self, handle):
        self.waiting = handle.getMapState("waiting", "id bigint", "end bigint")

    def row(self, key, row):
        kind, at, out = getattr(row, self.column), millis(row.at), []
        if kind == self.one:
            self.waiting.updateValue((int(row.id),), (at + self.within_ms,))
            self.handle.registerTimer(at + self.within_ms)
        elif kind == self.two:
            done = [x[0] for x, end in self.waiting.iterator() if at < end[0]]
            for first in done:
                self.waiting.removeKey((first,))
                out.append((key, first, "completed"))
        return out

    def fired(self, key, at_ms):
        late = [x[0] for x, end in self.waiting.iterator() if end[0] <= at_ms]
        for first in late:
            self.waiting.removeKey((first,))
        return [(key, first, "timeout") for first in late]
