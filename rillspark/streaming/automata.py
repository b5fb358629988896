"""Event patterns over streams: the automaton of ``operators.automata`` in keyed state, fed in event time."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from rillspark.operators.automata import SCHEMA, Automaton, Entry, Pattern, Run, emitted, tagged, untagged
from rillspark.streaming.processors import PROVIDER


def numbers(text: str) -> tuple[int, ...]:
    return tuple(int(x) for x in text.split("."))


def dotted(version: tuple[int, ...]) -> str:
    return ".".join(map(str, version))


def place_of(row: list) -> tuple:
    """Where a waiting row (time, order, number, fits, payload) comes: by time, order with nulls first, and number."""
    return row[0], [(v is not None, v) for v in row[1]], row[2]


def filled(column: pd.Series) -> list:
    """A column's values, None for missing ones."""
    values = column.tolist()
    return [None if pd.isna(v) else v for v in values] if column.hasnans else values


class PatternMatcher(StatefulProcessor):
    """Holds rows until the watermark has passed them, then feeds them in order of (time, order); late rows never come.

    State: rows that wait, as a list, and the automaton's partial matches with its buffer as one text. A key's rows of a
    micro-batch are one entry of the list, read when the key's only timer fires, so calls of state and their entries grow
    with keys and micro-batches, not with rows. The timer stands at the first waiting row or end of a partial match.
    """

    def __init__(self, pattern: Pattern, key: str) -> None:
        self.steps, self.within_us, self.strict = pattern.steps, pattern.within_us, pattern.strict()
        self.columns = [key, *(f.split()[0] for f in SCHEMA.split(", "))]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows string")
        self.held = handle.getValueState("held", "rows bigint, begun bigint, due bigint, machine string")

    def rung(self, before: int | None, due: int | None) -> None:
        """Move the timer."""
        if before != due:
            if before is not None:
                self.handle.deleteTimer(before)
            if due is not None:
                self.handle.registerTimer(due)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        more = []
        for frame in rows:
            if not self.strict:  # the others came to move the watermark, which a filter before would have kept them from
                frame = frame[frame.iloc[:, 2].to_numpy() > 0]
            columns = [filled(frame.iloc[:, i]) for i in range(1, frame.shape[1]) if i != frame.shape[1] - 2]
            more += [(at, order, fits, payload or "") for at, fits, *order, payload in zip(*columns, strict=True)]
        if more:
            count, begun, due, machine = self.held.get() or (0, 0, None, "")
            chunk = [(at, order, count + i, fits, payload) for i, (at, order, fits, payload) in enumerate(more)]
            self.waiting.appendValue((json.dumps(chunk, default=str),))
            first = min(at for at, *_ in more) // 1000 + 1
            new = first if due is None else min(due, first)
            self.rung(due, new)
            self.held.update((count + len(more), begun, new, machine))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        count, begun, due, text = self.held.get() or (0, 0, None, "")
        if due is None or due > mark:
            return
        machine = self.loaded(text, count, begun)
        ready, rest = [], []
        for (chunk,) in self.waiting.get():
            for row in json.loads(chunk):
                (ready if row[0] // 1000 < mark else rest).append(row)
        out = []
        for at, _, _, fits, payload in sorted(ready, key=place_of):
            out += machine.feed(at, fits, payload)
        if rest:
            self.waiting.put([(json.dumps(rest),)])
        else:
            self.waiting.clear()
        out += machine.expire(mark * 1000 - 1)
        dues = [row[0] // 1000 + 1 for row in rest]
        if self.within_us is not None:
            dues += [-(-(r.began + self.within_us) // 1000) + 1 for r in machine.runs]
        new = min(dues) if dues else None
        if new is not None:  # the timer that fired goes by itself
            self.handle.registerTimer(new)
        self.held.update((machine.count, machine.begun, new, self.saved(machine)))
        if out:
            yield pd.DataFrame([(key[0], *emitted(self.steps, x)) for x in out], columns=self.columns)

    def loaded(self, text: str, count: int, begun: int) -> Automaton:
        machine = Automaton(self.steps, self.within_us, count=count, begun=begun)
        runs, entries = json.loads(text) if text else ([], [])
        machine.runs = [Run(steps, numbers(version), tuple(last), began) for steps, version, last, began in runs]
        for place, payload, at, links in entries:
            machine.buffer[tuple(place)] = Entry(payload, at, {numbers(v): tuple(b) if b else None for v, b in links.items()})
        return machine

    def saved(self, machine: Automaton) -> str:
        if not machine.runs:
            return ""
        runs = [(r.steps, dotted(r.version), r.last, r.began) for r in machine.runs]
        return json.dumps((runs, [(place, e.payload, e.at, {dotted(v): b for v, b in e.links.items()}) for place, e in machine.buffer.items()]))

    def close(self) -> None:
        """Nothing is held outside states."""


def pattern_stream(df: DataFrame, pattern: Pattern, key: str, time: str, order: list[str], carry: list[str]) -> DataFrame:
    """``operators.automata.matches`` of a stream with a watermark on ``time``; a match comes out once the watermark passed it."""
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    processor = PatternMatcher(pattern, key)
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, {SCHEMA}"
    found = tagged(df, pattern, key, time, order, carry).groupBy(key).transformWithStateInPandas(processor, schema, "append", "EventTime")
    return untagged(found, df, carry)
