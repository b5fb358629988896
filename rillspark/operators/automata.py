"""Event patterns per key: a pattern is compiled to an automaton, which batches and streams run alike.

    Pattern.begin("create", F.col("kind") == "create").followed_by("pay", F.col("kind") == "pay").within(900)

``next`` wants its row at once after the one before it, ``followed_by`` skips rows that don't fit, ``followed_by_any``
also goes on looking for later ones; ``times`` repeats a step, strictly one after another if ``consecutive``. Every row
that fits the first step begins a match of its own. Conditions are columns, which Spark evaluates; the automaton only
sees which steps a row fits.

Partial matches share their rows: each row taken is one entry in a buffer, with a link back for every partial match that
goes through it, told apart by versions; an entry leaves with the last partial match that needs it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Step:
    name: str
    test: int
    link: str


@dataclass(frozen=True)
class Pattern:
    steps: tuple[Step, ...] = ()
    tests: tuple[Column, ...] = ()
    within_us: int | None = None

    @classmethod
    def begin(cls, name: str, test: Column) -> Pattern:
        return cls()._and(name, test, "begin")

    def _and(self, name: str, test: Column, link: str) -> Pattern:
        return replace(self, steps=(*self.steps, Step(name, len(self.tests), link)), tests=(*self.tests, test))

    def next(self, name: str, test: Column) -> Pattern:
        return self._and(name, test, "strict")

    def followed_by(self, name: str, test: Column) -> Pattern:
        return self._and(name, test, "relaxed")

    def followed_by_any(self, name: str, test: Column) -> Pattern:
        return self._and(name, test, "any")

    def times(self, n: int, consecutive: bool = False) -> Pattern:
        """The last step ``n`` times; relaxed unless ``consecutive``."""
        last = self.steps[-1]
        return replace(self, steps=(*self.steps, *(replace(last, link="strict" if consecutive else "relaxed") for _ in range(n - 1))))

    def within(self, seconds: float) -> Pattern:
        """The last row comes less than this after the first."""
        return replace(self, within_us=int(seconds * 1_000_000))

    def fits(self) -> Column:
        """Which tests a row passes, as the bits of a number."""
        bits = [F.when(F.coalesce(test, F.lit(False)), 1 << i).otherwise(0) for i, test in enumerate(self.tests)]
        out = bits[0]
        for b in bits[1:]:
            out = out + b
        return out.cast("bigint")

    def strict(self) -> bool:
        return any(s.link == "strict" for s in self.steps)


@dataclass
class Run:
    """A partial match: how many steps it has, its version, the last entry, when it began."""

    steps: int
    version: tuple[int, ...]
    last: tuple[int, int]
    began: int


@dataclass
class Entry:
    """A row taken at a step. ``links`` leads from each version that goes through it to the entry before."""

    payload: str
    at: int
    links: dict[tuple[int, ...], tuple[int, int] | None] = field(default_factory=dict)


@dataclass
class Automaton:
    """The automaton of one key. ``feed`` takes rows in order; both it and ``expire`` return (status, payloads, times)."""

    steps: tuple[Step, ...]
    within_us: int | None
    runs: list[Run] = field(default_factory=list)
    buffer: dict[tuple[int, int], Entry] = field(default_factory=dict)
    count: int = 0
    begun: int = 0

    def path(self, run: Run) -> list[Entry]:
        out, at = [], run.last
        for n in range(run.steps, 0, -1):
            entry = self.buffer[at]
            out.append(entry)
            at = entry.links[run.version[:n]]
        return out[::-1]

    def ended(self, run: Run, status: str) -> tuple[str, list[str], list[int]]:
        path = self.path(run)
        return status, [e.payload for e in path], [e.at for e in path]

    def take(self, run: Run | None, bits_at: int, payload: str, branch: int) -> Run:
        steps = 1 if run is None else run.steps + 1
        if run is None:
            version, before, began = (self.begun,), None, bits_at
            self.begun += 1
        else:
            version, before, began = (*run.version, branch), run.last, run.began
        place = (steps, self.count)
        self.buffer.setdefault(place, Entry(payload, bits_at)).links[version] = before
        return Run(steps, version, place, began)

    def pruned(self) -> None:
        """Drop links and entries that no partial match goes through."""
        used = {(at, run.version[:n]) for run in self.runs for n, at in self.places(run)}
        for at in list(self.buffer):
            entry = self.buffer[at]
            entry.links = {v: before for v, before in entry.links.items() if (at, v) in used}
            if not entry.links:
                del self.buffer[at]

    def places(self, run: Run) -> Iterator[tuple[int, tuple[int, int]]]:
        at = run.last
        for n in range(run.steps, 0, -1):
            yield n, at
            at = self.buffer[at].links[run.version[:n]]

    def expire(self, now: int) -> list[tuple[str, list[str], list[int]]]:
        """Partial matches whose time is over at ``now``: each comes out with the steps that it had."""
        if self.within_us is None or not self.runs:
            return []
        late = [r for r in self.runs if r.began + self.within_us <= now]
        if not late:
            return []
        out = [self.ended(r, "timeout") for r in late]
        self.runs = [r for r in self.runs if r.began + self.within_us > now]
        self.pruned()
        return out

    def feed(self, at: int, fits: int, payload: str) -> list[tuple[str, list[str], list[int]]]:
        out, runs, ended = self.expire(at), [], False
        for run in self.runs:
            step = self.steps[run.steps]
            if fits >> step.test & 1:
                # Versions stay apart because a partial match that goes on looking numbers its branches by rows.
                taken = self.take(run, at, payload, self.count if step.link == "any" else 0)
                if taken.steps == len(self.steps):
                    out.append(self.ended(taken, "matched"))
                    ended = True
                else:
                    runs.append(taken)
                if step.link == "any":
                    runs.append(run)
            elif step.link == "strict":
                ended = True
            else:
                runs.append(run)
        if fits >> self.steps[0].test & 1:
            taken = self.take(None, at, payload, 0)
            if len(self.steps) == 1:
                out.append(self.ended(taken, "matched"))
                ended = True
            else:
                runs.append(taken)
        self.runs = runs
        self.count += 1
        if ended:
            self.pruned()
        return out


SCHEMA = "status string, steps array<string>, payloads array<string>, first_us bigint, last_us bigint"


def emitted(pattern_steps: tuple[Step, ...], found: tuple[str, list[str], list[int]]) -> tuple:
    status, payloads, times = found
    return status, [s.name for s in pattern_steps[: len(payloads)]], payloads, times[0], times[-1]


def tagged(df: DataFrame, pattern: Pattern, key: str, time: str, order: list[str], carry: list[str]) -> DataFrame:
    """What the automaton needs of the rows."""
    return df.select(F.col(key), F.unix_micros(time).alias("at"), pattern.fits().alias("fits"), *[F.col(c).alias(f"order {i}") for i, c in enumerate(order)], F.col(time).alias("when"), F.when(pattern.fits() > 0, F.to_json(F.struct(*carry))).alias("payload"))


def untagged(found: DataFrame, df: DataFrame, carry: list[str]) -> DataFrame:
    """Results with ``events``: the rows of each match, by step, with the columns in ``carry``."""
    kind = df.select(*carry).schema
    events = F.transform(F.arrays_zip("steps", "payloads"), lambda x: F.struct(x["steps"].alias("step"), F.from_json(x["payloads"], kind).alias("row")))
    return found.withColumn("events", events).drop("steps", "payloads")


def matches(df: DataFrame, pattern: Pattern, key: str, time: str, order: list[str], carry: list[str]) -> DataFrame:
    """(key, status, first_us, last_us, events) of every match of a table, and of every partial one that ran out of time.

    The end of the table counts as the end of time. Each key's rows pass one task in ``order``, a batch at a time; what
    is held are its partial matches, which ``within`` bounds. Rows with a null time are left out; null keys are one key.
    """
    steps, within_us, n = pattern.steps, pattern.within_us, len(order)
    rows = tagged(df.where(F.col(time).isNotNull()), pattern, key, time, order, carry)
    if not pattern.strict():  # rows that fit no step matter only to strict ones
        rows = rows.where("fits > 0")
    line = rows.repartition(key).sortWithinPartitions(key, "at", *[f"order {i}" for i in range(n)]).select(key, "at", "fits", "payload")
    kind = df.schema[key].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, machine = None, None
        for batch in batches:
            out = []
            for k, at, fits, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if machine is None or k != now:
                    if machine is not None:
                        out += [(now, *emitted(steps, x)) for x in machine.expire(1 << 62)]
                    now, machine = k, Automaton(steps, within_us)
                if fits or machine.runs:
                    out += [(k, *emitted(steps, x)) for x in machine.feed(at, fits, payload)]
            yield table(out, batch.schema.field(0).type)
        if machine is not None:
            yield table([(now, *emitted(steps, x)) for x in machine.expire(1 << 62)], batch.schema.field(0).type)

    def table(rows: list[tuple], key_type: pa.DataType) -> pa.RecordBatch:
        kinds = [key_type, pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.int64(), pa.int64()]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[key, "status", "steps", "payloads", "first_us", "last_us"])

    return untagged(line.mapInArrow(work, f"`{key}` {kind}, {SCHEMA}"), df, carry)
