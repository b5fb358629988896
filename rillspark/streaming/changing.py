"""Second levels over results that still change, rules that travel with the rows, and chained windows and ranks.

``top_changes`` takes a stream of changes (+I, -U, +U, -D) of items' values and gives the changes of each group's ranks.
``broadcast_state`` puts rules and rows in one stream of shards: every shard gets every rule, and a row only its own.
``ranked_windows`` counts per window and ranks the closed windows in a second stateful operator of the same query.
"""

from __future__ import annotations

import bisect
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from rillspark.streaming.processors import PROVIDER, Ordered, held, millis

ADDED = ("+I", "+U")
#: Rows that leave Arrow at a time.
BATCH = 10_000


def stateful(rows: DataFrame, keys: list[str], processor: StatefulProcessor, schema: str, time_mode: str = "None") -> DataFrame:
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return rows.groupBy(*keys).transformWithStateInPandas(processor, schema, "append", time_mode)


class Ranks(StatefulProcessor):
    """Order statistics of a group's items, whose values come and go: its ``n`` largest, of ties the smaller item.

    State: each item's value, and the head of the order: at least ``n`` items (all, if there are fewer), at most four
    times as many, none of which is below an item outside. A change within the head or below it costs the head alone;
    the items are read again only when retractions have left fewer than ``n`` in it. Changes of a micro-batch add up, in
    whatever order they come. What comes out are the ranks that differ after the micro-batch: -U or -D the old row of a
    rank, +I or +U the new one.
    """

    def __init__(self, n: int, keys: int) -> None:
        self.n, self.keys = n, keys

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.items = handle.getMapState("items", "item string", "value bigint")
        self.head = handle.getValueState("head", "rows string, whole boolean")

    def changed(self, head: list[tuple[int, str]], whole: bool, rows: Iterator[pd.DataFrame]) -> bool:
        """Apply a micro-batch to the items and to ``head`` (-value, item), ascending; whether it has all items then."""
        net: dict[tuple[str, int], int] = {}
        for frame in rows:
            for item, op, value in frame[["item", "op", "value"]].itertuples(index=False):
                k = (item, int(value))
                net[k] = net.get(k, 0) + (1 if op in ADDED else -1)
        for item, value in (k for k, n in net.items() if n < 0):
            self.items.removeKey((item,))
            i = bisect.bisect_left(head, (-value, item))
            if i < len(head) and head[i] == (-value, item):
                del head[i]
        for item, value in (k for k, n in net.items() if n > 0):
            self.items.updateValue((item,), (value,))
            if whole or (head and (-value, item) < head[-1]):
                bisect.insort(head, (-value, item))
        return whole

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        text, whole = self.head.get() if self.head.exists() else ("[]", True)
        head = [(v, i) for v, i in json.loads(text)]
        before = head[: self.n]
        whole = self.changed(head, whole, rows)
        if len(head) < self.n and not whole:
            head = sorted((-v[0], k[0]) for k, v in self.items.iterator())
            whole = True
        if len(head) > 4 * self.n:
            del head[2 * self.n :]
            whole = False
        self.head.update((json.dumps(head), whole))
        out = []
        for rank in range(self.n):
            old, new = (x[rank] if rank < len(x) else None for x in (before, head))
            if old == new:
                continue
            if old:
                out.append((*key, "-U" if new else "-D", rank + 1, old[1], -old[0]))
            if new:
                out.append((*key, "+U" if old else "+I", rank + 1, new[1], -new[0]))
        if out:
            yield pd.DataFrame(out, columns=[*(f"k{i}" for i in range(self.keys)), "op", "rank", "item", "value"])

    def close(self) -> None:
        """Nothing is held outside states."""


def top_changes(changes: DataFrame, group: str, item: str, value: str, n: int, shards: int = 16) -> DataFrame:
    """(group, op, rank, item, value): how each group's ``n`` largest items change, from changes (op, group, item, value).

    Groups are ranked in ``shards`` by item first, then the shards' best ones, so a group with most items is spread and
    its last step sees at most ``n`` changes a shard.
    """
    kind = changes.schema[group].dataType.simpleString()
    rows = changes.select(F.col(group).alias("k0"), F.pmod(F.xxhash64(item), F.lit(shards)).cast("int").alias("k1"), "op", F.col(item).cast("string").alias("item"), F.col(value).cast("bigint").alias("value"))
    columns = "op string, rank int, item string, value bigint"
    local = stateful(rows, ["k0", "k1"], Ranks(n, 2), f"k0 {kind}, k1 int, {columns}")
    return stateful(local.select("k0", "op", "item", "value"), ["k0"], Ranks(n, 1), f"k0 {kind}, {columns}").withColumnRenamed("k0", group)


class CountChanges(Ordered):
    """A key's count after each micro-batch, as changes: the one before goes, the new one comes."""

    fields = {"op": "string", "cnt": "bigint"}

    def open(self, handle):
        self.count = handle.getValueState("count", "n bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n = held(self.count, 0)
        more = n + sum(len(frame) for frame in rows)
        self.count.update((more,))
        yield from self.emitted([(key[0], "-U", n), (key[0], "+U", more)] if n else [(key[0], "+I", more)])


class Rules(Ordered):
    """Rows of a shard by the rule that held at their time: subclasses decide in ``decided``.

    Rules are kept with their times, so a row that comes late, or in the same micro-batch as two rules, meets the right
    one. Versions older than the last one that is ``keep_ms`` behind the newest row are dropped.
    """

    time_mode = "None"

    def __init__(self, keep_ms: int = 86_400_000) -> None:
        self.keep_ms = keep_ms

    def open(self, handle):
        self.versions = handle.getValueState("versions", "rules string")
        self.more(handle)

    def more(self, handle) -> None:
        """Make further states."""

    def decided(self, key, row, rule: list | None) -> list[tuple]:
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        """Rules are held as numbers beside each different text once, rows in Arrow; what comes out leaves by the batch."""
        number: dict[str, int] = {}
        known = json.loads(held(self.versions, "[]"))
        rules = [np.array([(at, i, number.setdefault(text, len(number))) for at, i, text in known], np.int64).reshape(-1, 3)]
        plain, newest = [], None
        for frame in rows:
            frame = frame.rename(columns=self.names)
            top = int(frame["at_us"].max())
            newest = top if newest is None else max(newest, top)
            is_rule = frame["is_rule"].to_numpy(bool)
            if is_rule.any():
                new = frame.loc[is_rule, ["at_us", "id", "rule"]]
                rules.append(np.column_stack([new["at_us"].to_numpy(np.int64), new["id"].to_numpy(np.int64), [number.setdefault(x, len(number)) for x in new["rule"]]]).astype(np.int64))
            if not is_rule.all():
                plain.append(pa.Table.from_pandas(frame[~is_rule].drop(columns=["is_rule", "rule"]), preserve_index=False))
        texts = list(number)
        place = np.argsort(np.argsort(np.array(texts, object))) if texts else np.zeros(0, np.int64)
        rules = np.concatenate(rules)
        rules = rules[np.lexsort((place[rules[:, 2]], rules[:, 1], rules[:, 0]))]
        old = max(int(np.searchsorted(rules[:, 0], newest - self.keep_ms * 1000)) - 1, 0)
        self.versions.update((json.dumps([(at, i, texts[n]) for at, i, n in rules[old:].tolist()]),))
        if not plain:
            return
        table = pa.concat_tables(plain, promote_options="permissive")
        del plain
        at, ids = (table[c].to_numpy().astype(np.int64) for c in ("at_us", "id"))
        n = len(at)
        # Rows before rules of the same time and id, so what stands before a row are the rules that hold for it.
        order = np.lexsort((np.arange(n + len(rules)) >= n, np.r_[ids, rules[:, 1]], np.r_[at, rules[:, 0]]))
        is_row = order < n
        order, before = order[is_row], np.cumsum(~is_row)[is_row]
        parsed = [json.loads(x) for x in texts]
        for first in range(0, n, BATCH):
            part = table.take(pa.array(order[first : first + BATCH])).to_pandas()
            out = []
            for row, i in zip(part.itertuples(), before[first : first + BATCH].tolist(), strict=True):
                out += self.decided(key[0], row, parsed[rules[i - 1, 2]] if i else None)
            yield from self.emitted(out)

class AboveThreshold(Rules):
    """Rows whose value is above the rule's number, or ``default`` before the first rule."""

    fields = {"id": "id", "value": "number", "held": "double"}

    def __init__(self, default: float, keep_ms: int = 86_400_000) -> None:
        super().__init__(keep_ms)
        self.default = default

    def decided(self, key, row, rule):
        limit = self.default if rule is None else float(rule[0])
        return [(key, row.id, self.cast(row.value), limit)] if row.value > limit else []


class TwoActions(Rules):
    """Rows of an owner who did the rule's first action just before, and its second one now."""

    fields = {"id": "id", "owner": "string"}

    def more(self, handle):
        self.last = handle.getMapState("last", "owner string", "action string")

    def decided(self, key, row, rule):
        before = self.last.getValue((row.owner,))[0] if self.last.containsKey((row.owner,)) else None
        self.last.updateValue((row.owner,), (row.action,))
        return [(key, row.id, row.owner)] if rule and before == rule[0] and row.action == rule[1] else []


def broadcast_state(rows: DataFrame, rules: DataFrame, processor: Rules, owner: Column, value: str, rule: list[Column], time: str, id_: str, action: Column | None = None, shards: int = 16) -> DataFrame:
    """What ``processor`` decides of ``rows``, which lie in ``shards`` by ``owner``; each of ``rules`` goes to all shards.

    ``rules`` have ``time`` and ``id_`` too: a rule holds for rows that come after it in (time, id). Rules are few: each
    one is repeated ``shards`` times.
    """
    at = F.unix_micros(time).alias("at_us")
    shard = F.coalesce(F.pmod(F.xxhash64(owner), F.lit(shards)), F.lit(0)).cast("int")
    one = rows.select(shard.alias("shard"), time, at, F.col(id_), F.col(value), owner.cast("string").alias("owner"), (action if action is not None else F.lit(None)).cast("string").alias("action"), F.lit(False).alias("is_rule"), F.lit("").alias("rule"))
    texts = F.to_json(F.array(*[r.cast("string") for r in rule]))
    two = rules.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), time, at, F.col(id_), F.lit(None).cast(rows.schema[value].dataType).alias(value), F.lit(None).cast("string").alias("owner"), F.lit(None).cast("string").alias("action"), F.lit(True).alias("is_rule"), texts.alias("rule"))
    both = one.unionByName(two)
    processor.bind(both, "shard", value, (time, id_))
    return stateful(both, ["shard"], processor, processor.schema)


class WindowRanks(StatefulProcessor):
    """The largest counts of a window once it is closed: a list until a timer one millisecond after its end."""

    def __init__(self, n: int, item: str) -> None:
        self.n, self.item = n, item

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "item string, cnt bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        best = [(i, int(c)) for i, c in self.rows.get()]
        for frame in rows:
            best = self.first([*best, *((i, int(c)) for i, c in frame[["item", "cnt"]].itertuples(index=False))])
        self.rows.put(best)
        self.handle.registerTimer(millis(key[0]) + 1)
        yield from ()

    def first(self, rows: list[tuple[str, int]]) -> list[tuple[str, int]]:
        return sorted(rows, key=lambda r: (-r[1], r[0]))[: self.n]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        best = self.first([(i, int(c)) for i, c in self.rows.get()])
        self.rows.clear()
        if best:
            yield pd.DataFrame([(key[0], i, c, rank) for rank, (i, c) in enumerate(best, 1)], columns=["window_end", "item", "cnt", "rank"])

    def close(self) -> None:
        """Nothing is held outside states."""


def ranked_windows(rows: DataFrame, time: str, size: str, item: str, n: int, slide: str | None = None) -> DataFrame:
    """(window_end, item, cnt, rank) of every closed window, once: counts per window feed ranks keyed by the window's end.

    Only a window's counts meet in one task, a row per item; of these ``n`` are kept.
    """
    window = F.window(time, size, slide) if slide else F.window(time, size)
    counts = rows.groupBy(window.alias("window"), F.col(item).cast("string").alias("item")).agg(F.count("*").alias("cnt"))
    ends = counts.select(F.col("window.end").alias("window_end"), F.window_time("window").alias("when"), "item", "cnt")
    return stateful(ends, ["window_end"], WindowRanks(n, item), "window_end timestamp, item string, cnt bigint, rank int", "EventTime")
