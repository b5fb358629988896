"""A cache for lookups in tasks: one per Python worker process, bounded, with expiry."""

from __future__ import annotations

import time
from collections import OrderedDict
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame


class Cache:
    """The ``capacity`` answers used last, each for ``ttl_s`` seconds from when it was fetched. A missing answer is not kept."""

    def __init__(self, capacity: int, ttl_s: float) -> None:
        self.capacity, self.ttl_s = capacity, ttl_s
        self.held: OrderedDict[Any, tuple[Any, float]] = OrderedDict()

    def get(self, key: Any, call: Callable[[Any], Any]) -> Any:
        now = time.monotonic()
        if key in self.held:
            answer, end = self.held[key]
            if now < end:
                self.held.move_to_end(key)
                return answer
            del self.held[key]
        answer = call(key)
        if answer is not None:
            self.held[key] = (answer, now + self.ttl_s)
            while len(self.held) > self.capacity:
                self.held.popitem(last=False)
        return answer


#: The caches of this process, by name: they outlive tasks, as Spark goes on using its Python workers.
CACHES: dict[str, Cache] = {}


def cached_lookup(df: DataFrame, name: str, key: str, call: Callable[[Any], str | None], out: str = "answer", capacity: int = 10_000, ttl_s: float = 300.0) -> DataFrame:
    """``df`` with ``call`` of ``key`` as text; a null key has no answer. ``name`` tells caches of different calls apart.

    Each worker process asks once per key while the answer is fresh, and again for keys without an answer. Rows are not
    moved; put equal keys together before, where calls cost more than a shuffle.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from rillspark.functions import cache

        mine = cache.CACHES.get(name)
        if mine is None or (mine.capacity, mine.ttl_s) != (capacity, ttl_s):
            mine = cache.CACHES[name] = cache.Cache(capacity, ttl_s)
        for batch in batches:
            answers = [None if k is None else mine.get(k, call) for k in batch.column(key).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(answers, pa.string())], names=[*batch.schema.names, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(work, f"{schema}, `{out}` string")
