"""Segmented scans: what a key's state is after each of its rows, with a key's rows spread over many tasks.

Rows lie in ranges of (key, order) of about equal numbers of rows, so a key with a third of all rows takes a third of the
ranges. What a range starts from concerns one key alone, its first: the state after that key's rows in earlier ranges.
So a scan folds, for each range, the rows of its first and of its last key (at most two small states a range), combines
one key's states in the order of the ranges, and hands each range what its first key had come to. Within a range, rows
only look back as far as the range begins. No key meets all ranges, and no task sees more than a range.

``scan`` builds running values of SQL functions; ``folded`` runs a state object over the rows in Arrow batches, where the
state (a list, a map) has no such form.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from rillspark.operators.ranges import in_ranges

PART, NTH = "part of scan", "nth of scan"
#: The same of marked ranges, under names that no table's columns have.
MARK, MARKED = "mark of scan", "marked key of scan"
KEY, VALUE, STATE = "key of scan", "value of scan", "state of scan"


@dataclass(frozen=True)
class Running:
    """A value that rows of a key build up.

    ``whole`` is the aggregate of some rows, ``across`` the window function that combines those of earlier ranges in
    order, ``so_far`` the value after each row of a range from its rows alone, ``joined`` that of (earlier, so far).
    """

    whole: Column
    across: Callable[[Column], Column]
    so_far: Callable[[WindowSpec], Column]
    joined: Callable[[Column, Column], Column]
    out: Callable[[Column], Column] = lambda c: c


def upto(w: WindowSpec, end: int = 0) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, end)


def total(value: Column) -> Running:
    return Running(F.sum(value), F.sum, lambda w: F.sum(value).over(upto(w)), lambda a, b: F.coalesce(a + b, a, b))


def rows_so_far() -> Running:
    return Running(F.count("*"), F.sum, lambda w: F.row_number().over(w).cast("bigint"), lambda a, b: F.coalesce(a, F.lit(0)) + b)


def known_so_far(value: Column) -> Running:
    """How many values that aren't null."""
    return Running(F.count(value), F.sum, lambda w: F.count(value).over(upto(w)), lambda a, b: F.coalesce(a, F.lit(0)) + b)


def extreme(value: Column, kind: str = "max") -> Running:
    one, two = (F.max, F.greatest) if kind == "max" else (F.min, F.least)
    return Running(one(value), one, lambda w: one(value).over(upto(w)), two)


def first(value: Column, order: list[str]) -> Running:
    """The value of the key's first row, null or not."""
    held = F.struct(value.alias("v"))
    return Running(F.min_by(held, F.struct(*order)), lambda c: F.first(c, True), lambda w: F.first(held).over(upto(w)), F.coalesce, lambda c: c["v"])


def previous(value: Column, order: list[str], default: Any = None) -> Running:
    """The value of the row before, null or not; before the key's first row ``default``."""
    held = F.struct(value.alias("v"))
    return Running(F.max_by(held, F.struct(*order)), lambda c: F.last(c, True), lambda w: F.lag(held).over(w), lambda a, b: F.coalesce(b, a), lambda c: F.when(c.isNull(), F.lit(default)).otherwise(c["v"]))


def last_known(value: Column, order: list[str], end: int = 0) -> Running:
    """The last value that isn't null up to this row, or with ``end`` -1 up to the one before."""
    return Running(F.max_by(value, F.when(value.isNotNull(), F.struct(*order))), lambda c: F.last(c, True), lambda w: F.last(value, True).over(upto(w, end)), lambda a, b: F.coalesce(b, a))


def best(rank: Column, held: Column) -> Running:
    """``held`` of the row with the largest ``rank`` so far, of ties the first one."""
    both = F.struct(rank.alias("rank"), held.alias("held"))
    whole = F.max_by(both, F.struct(rank, -F.col(NTH)))
    across = lambda c: F.max_by(c, F.struct(c["rank"], -F.col(PART)))
    joined = lambda a, b: F.when(a["rank"].isNull() | (b["rank"] > a["rank"]), b).otherwise(a)
    return Running(whole, across, lambda w: F.max_by(both, F.struct(rank, -F.col(NTH))).over(upto(w)), joined, lambda c: c["held"])


def edges(rows: DataFrame, key: str) -> DataFrame:
    """(part, key) of each range's first and last key."""
    k = F.struct(F.col(key).alias("k"))
    ends = rows.groupBy(PART).agg(F.min(k).alias("lo"), F.max(k).alias("hi"))
    return ends.select(PART, F.explode(F.array_distinct(F.array("lo", "hi"))).alias("edge")).select(PART, F.col("edge.k").alias(key))


def at_edges(rows: DataFrame, key: str) -> DataFrame:
    """The rows of ranges' first and last keys. The marks are two rows a range, so they are broadcast."""
    marks = F.broadcast(edges(rows, key).withColumnsRenamed({PART: MARK, key: MARKED}))
    return rows.join(marks, (F.col(PART) == F.col(MARK)) & F.col(key).eqNullSafe(F.col(MARKED)), "left_semi")


def with_carried(rows: DataFrame, carried: DataFrame, key: str, small: bool = True) -> DataFrame:
    """``rows`` with what their key's earlier ranges had come to: at most two rows a range, broadcast if these are ``small``."""
    marks = carried.withColumnsRenamed({PART: MARK, key: MARKED})
    marks = F.broadcast(marks) if small else marks
    return rows.join(marks, (F.col(PART) == F.col(MARK)) & F.col(key).eqNullSafe(F.col(MARKED)), "left").drop(MARK, MARKED)


def scan(df: DataFrame, key: str, order: list[str], **values: Running) -> DataFrame:
    """``df`` with each of ``values`` after each row, in ``order`` within ``key``. Null keys are a key of their own.

    Rows that tie in ``order`` come in any order, as in a window. ``order`` ascends, nulls first.
    """
    rows = in_ranges(df, key, *order, out=PART)
    line = Window.partitionBy(PART, key).orderBy(*order)
    numbered = lambda frame: frame.withColumn(NTH, F.row_number().over(line))
    per = numbered(at_edges(rows, key)).groupBy(PART, key).agg(*[v.whole.alias(name) for name, v in values.items()])
    earlier = upto(Window.partitionBy(key).orderBy(PART), -1)
    carried = per.select(PART, key, *[v.across(F.col(name)).over(earlier).alias(f"{name} before") for name, v in values.items()])
    now = numbered(with_carried(rows, carried, key)).withColumns({f"{name} now": v.so_far(line) for name, v in values.items()})
    out = {name: v.out(v.joined(F.col(f"{name} before"), F.col(f"{name} now"))) for name, v in values.items()}
    return now.select(*[F.col(c) for c in df.columns if c not in out], *[c.alias(name) for name, c in out.items()])


class State:
    """What ``folded`` keeps of a key. ``rows`` takes the next rows in order and gives what to emit for each; ``merged``
    adds what other rows, later ones, came to; ``saved`` and ``loaded`` turn it into and out of a value of ``kind``."""

    kind: str

    def rows(self, values: pa.Array) -> pa.Array:
        raise NotImplementedError

    def merged(self, later: State) -> None:
        raise NotImplementedError

    def saved(self) -> Any:
        raise NotImplementedError

    @classmethod
    def loaded(cls, value: Any) -> State:
        raise NotImplementedError


def segments(parts: pa.Array, keys: pa.Array) -> list[tuple[int, int]]:
    """(start, end) of runs that agree in both."""
    if not len(keys):
        return []
    codes = [x.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False) for x in (parts, keys)]
    cuts = np.flatnonzero((codes[0][1:] != codes[0][:-1]) | (codes[1][1:] != codes[1][:-1])) + 1
    return list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True))


def folded(df: DataFrame, key: str, value: str, order: list[str], new: Callable[[], State], load: Callable[[Any], State], state_kind: str, out: str, out_kind: str) -> DataFrame:
    """(key, order, ``out``): what a ``State`` of the key emits after each row."""
    rows = in_ranges(df.select(key, *order, F.col(value).alias(VALUE)), key, *order, out=PART)
    kinds = {c: df.schema[c].dataType.simpleString() for c in (key, *order)}
    edge_kind = f"`{PART}` int, `{KEY}` {kinds[key]}, `{STATE}` {state_kind}"
    schema = to_arrow_schema(StructType.fromDDL(edge_kind))

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The state of each edge key's rows in a range, from nothing."""
        now, state = None, None
        for batch in batches:
            parts, keys = batch.column(PART), batch.column(KEY)
            for a, b in segments(parts, keys):
                this = (parts[a].as_py(), keys[a].as_py())
                if this != now:
                    if state is not None:
                        yield made(*([x] for x in (*now, state.saved())), schema)
                    now, state = this, new()
                state.rows(batch.column(VALUE)[a:b])
        if state is not None:
            yield made(*([x] for x in (*now, state.saved())), schema)

    def befores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What each range starts from: one key's states of earlier ranges, in order, one after another."""
        now, state = None, None
        for batch in batches:
            for p, k, saved in zip(*(batch.column(c).to_pylist() for c in (PART, KEY, STATE)), strict=True):
                if now is None or k != now[0]:
                    now, state = (k,), None
                if state is not None:
                    yield made([p], [k], [state.saved()], schema)
                    state.merged(load(saved))
                else:
                    state = load(saved)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            parts, keys, pieces = batch.column(PART), batch.column(key), []
            for a, b in segments(parts, keys):
                this = (parts[a].as_py(), keys[a].as_py())
                if this != now:
                    saved = batch.column(STATE)[a].as_py()
                    now, state = this, new() if saved is None else load(saved)
                pieces.append(state.rows(batch.column(VALUE)[a:b]))
            if pieces:
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (key, *order)), pa.concat_arrays(pieces)], names=[key, *order, out])

    some = at_edges(rows, key).withColumnRenamed(key, KEY)
    edge = some.repartition(PART).sortWithinPartitions(PART, KEY, *order).mapInArrow(states, edge_kind)
    carried = edge.repartition(KEY).sortWithinPartitions(KEY, PART).mapInArrow(befores, edge_kind).withColumnRenamed(KEY, key)
    line = with_carried(rows, carried, key, small=False).repartition(PART).sortWithinPartitions(PART, key, *order)
    return line.mapInArrow(work, ", ".join(f"`{c}` {kind}" for c, kind in {**kinds, out: out_kind}.items()))


def made(parts: list, keys: list, saved: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((parts, keys, saved), schema.types, strict=True)], schema=schema)
