"""Best-fit packing of token pieces into sequences by a grouping genetic algorithm.

Documents become token pieces of at most ``capacity``; full pieces are sequences already. The rest is dealt at random
into blocks of bounded size. Each block is solved by several islands; an island evolves packings whose genes are whole
sequences: a child takes well-filled sequences from one parent, drops the other's sequences that repeat their items,
and best-fits the displaced items. After an epoch each island sends its elite to the next island of its block. What the
blocks fill badly is dealt out and packed once more.
"""

from __future__ import annotations

import base64
import json
import re
import sys
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillspark.llm.common import dropped, small_batches, staged

#: The alternative of the split pattern that leaves the last of several white-space characters to the next word.
LOOK_AHEAD = r"\s+(?!\S)|"
LONG_GAP = 50_000


def token_pieces(docs: DataFrame, ranks: str, pattern: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", added: dict[str, int] | None = None, vocabulary: str | None = None) -> DataFrame:
    """(id, piece, start, length, ids) for each piece of each text: ``ids`` holds little-endian unsigned 32-bit token ids.

    A document is its text's byte-pair tokens, from the vocabulary file of ``ranks`` that each executor reads, and then
    ``end_id``. A longer one is cut so that only its first piece may be shorter than ``capacity``. Null texts are empty.
    Strings of ``added`` are one token wherever they stand in a text; what lies between them is split on its own.
    ``vocabulary`` is the same vocabulary as a ``tokenizers`` file: it takes texts with a run of over ``LONG_GAP`` white
    space, on which the pattern's look-ahead runs out of stack.
    """
    small_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        lines = Path(ranks).read_bytes().splitlines()
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        # The look-ahead only matters where white space follows white space; without it the pattern runs twice as fast.
        plain, exact = (tiktoken.Encoding("vocabulary", pat_str=p, mergeable_ranks=merges, special_tokens={}) for p in (pattern.replace(LOOK_AHEAD, ""), pattern))
        gap = re.compile(r"\s\s")
        long_gap = re.compile(rf"\s{{{LONG_GAP}}}")
        slow: list = []
        marks = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None

        def encoded(text: str) -> list[int]:
            if not gap.search(text):
                return plain.encode_ordinary(text)
            if not vocabulary or not long_gap.search(text):
                return exact.encode_ordinary(text)
            if not slow:
                from tokenizers import Tokenizer

                slow.append(Tokenizer.from_file(vocabulary))
            return slow[0].encode(text, add_special_tokens=False).ids

        for batch in batches:
            rows, piece, start, length, ids, size = [], [], [], [], [], 0
            for row, text in enumerate(batch.column(1).to_pylist()):
                text = text or ""
                if marks and marks.search(text):
                    parts = marks.split(text)  # texts and added tokens in turn
                    tokens = array("I", [t for i, part in enumerate(parts) for t in ([added[part]] if i % 2 else encoded(part))])
                else:
                    tokens = array("I", encoded(text))
                tokens.append(end_id)
                if sys.byteorder == "big":
                    tokens.byteswap()
                n = len(tokens)
                cuts = [0, *range(n % capacity or capacity, n, capacity), n]
                for k in range(len(cuts) - 1):
                    rows.append(row)
                    piece.append(k)
                    start.append(cuts[k])
                    length.append(cuts[k + 1] - cuts[k])
                    ids.append(tokens[cuts[k] : cuts[k + 1]].tobytes())
                size += 4 * n
                if size > 1 << 22:
                    yield made(batch, rows, piece, start, length, ids)
                    rows, piece, start, length, ids, size = [], [], [], [], [], 0
            yield made(batch, rows, piece, start, length, ids)

    def made(batch: pa.RecordBatch, rows: list, piece: list, start: list, length: list, ids: list) -> pa.RecordBatch:
        columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=[id_col, "piece", "start", "length", "ids"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(work, f"{id_col} {kind}, piece int, start bigint, length bigint, ids binary")


def added_tokens(vocabulary: str) -> dict[str, int]:
    """The added tokens of a ``tokenizers`` file and their ids; only plain ones, matched as they are written, are known."""
    tokens = json.loads(Path(vocabulary).read_text())["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in tokens):
        raise ValueError(f"{vocabulary}: added tokens that look at their surroundings are not supported")
    return {t["content"]: t["id"] for t in tokens}


class Packing:
    """One individual: the bin of each item, and each bin's fill."""

    def __init__(self, bins: np.ndarray, lengths: np.ndarray) -> None:
        _, self.bins = np.unique(bins, return_inverse=True)
        self.fill = np.bincount(self.bins, weights=lengths).astype(np.int64)

    def score(self, capacity: int) -> tuple[int, float]:
        """Fewer bins first, then more uneven ones: full bins next to nearly empty ones are easier to improve."""
        return len(self.fill), -float(np.square(self.fill / capacity).sum())


def best_fit(order: list[int], lengths: list[int], bins: np.ndarray, free: list[int], capacity: int) -> None:
    """Put items in the given order each into the bin with the least room that holds it; ``bins`` and ``free`` change.

    The rooms that occur are the set bits of one integer, so the least sufficient room is found by a shift.
    """
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    for b, room in enumerate(free):
        if room > 0:
            by_room[room].append(b)
            rooms |= 1 << room
    for item in order:
        need = lengths[item]
        above = rooms >> need
        if above:
            room = need + (above & -above).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            b, room = len(free), capacity
            free.append(capacity)
        bins[item] = b
        free[b] = room = room - need
        if room:
            by_room[room].append(b)
            rooms |= 1 << room


def crossed(a: Packing, b: Packing, lengths: np.ndarray, capacity: int, rng: np.random.Generator) -> Packing:
    """``a`` with whole well-filled bins of ``b`` put in; bins of ``a`` that share items with them are opened."""
    full = np.argsort(-b.fill, kind="stable")[: max(1, len(b.fill) // 2)]
    chosen = np.zeros(len(b.fill), bool)
    chosen[rng.choice(full, max(1, len(full) // 4), replace=False)] = True
    injected = chosen[b.bins]
    opened = np.zeros(len(a.fill), bool)
    opened[a.bins[injected]] = True
    opened[np.argsort(a.fill, kind="stable")[: 1 + len(a.fill) // 50]] = True  # mutation: the emptiest are opened too
    bins = np.where(injected, len(a.fill) + b.bins, a.bins)
    loose = np.flatnonzero(opened[a.bins] & ~injected)
    bins[loose] = -1
    used, dense = np.unique(bins[bins >= 0], return_inverse=True)
    bins[bins >= 0] = dense
    free = (capacity - np.bincount(dense, weights=lengths[bins >= 0], minlength=len(used))).astype(int).tolist()
    best_fit(loose[np.argsort(-lengths[loose], kind="stable")].tolist(), lengths.tolist(), bins, free, capacity)
    return Packing(bins, lengths)


def evolved(lengths: np.ndarray, elites: list[np.ndarray], capacity: int, seed: int, population: int, generations: int) -> Packing:
    """The best packing of an island after some generations; it ends early at the bound no packing can beat."""
    rng = np.random.default_rng(seed)
    least = max(-(-int(lengths.sum()) // capacity), int((2 * lengths > capacity).sum()))
    members = [Packing(e, lengths) for e in elites]
    while len(members) < population and not any(len(m.fill) <= least for m in members):
        noise = 0 if not members and seed % 2 == 0 else rng.normal(0, 0.02 * capacity, len(lengths))
        bins, free = np.full(len(lengths), -1), []
        best_fit(np.argsort(-(lengths + noise), kind="stable").tolist(), lengths.tolist(), bins, free, capacity)
        members.append(Packing(bins, lengths))
    members.sort(key=lambda m: m.score(capacity))
    for _ in range(generations):
        if len(members[0].fill) <= least or len(members) < 2:
            break
        i, j = rng.choice(len(members), 2, replace=False)
        members.append(crossed(members[i], members[j], lengths, capacity, rng))
        members.sort(key=lambda m: m.score(capacity))
        members.pop()
    return members[0]


def packed_blocks(items: DataFrame, n_items: int, capacity: int, block: int, islands: int, epochs: int, population: int, generations: int, seed: int) -> DataFrame:
    """(item, length, block, bin, fill, offset): every item's place. ``items`` has item, unique, and length."""
    blocks = max(1, -(-n_items // block))
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item", F.lit(seed)), F.lit(blocks)))
    state = dealt.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("length", "item")), asc=False).alias("items"))
    state = state.select("block", F.col("items.item").alias("items"), F.col("items.length").alias("lengths"))
    state = state.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1)))).withColumn("elites", F.lit(None).cast("array<array<int>>"))
    state = state.repartition(F.col("block"), F.col("island"))

    def epoch(number: int):
        def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                found, counts = [], []
                for row in frame.itertuples():
                    elites = [] if row.elites is None else [np.asarray(e, np.int64) for e in row.elites]
                    own = hash((int(row.block), int(row.island), number, seed)) % (1 << 32) * 2 + int(row.island) % 2
                    best = evolved(np.asarray(row.lengths, np.int64), elites, capacity, own, population, generations)
                    found.append(best.bins.astype(np.int32))
                    counts.append(best.score(capacity)[0])
                yield frame.assign(genome=found, bins=counts)[["block", "island", "items", "lengths", "genome", "bins"]]

        return work

    kind = "block bigint, island int, items array<bigint>, lengths array<bigint>, genome array<int>, bins int"
    before = None
    for number in range(epochs):
        state = staged(state.mapInPandas(epoch(number), kind), "islands")
        if before:
            dropped(before)
        before = state
        if number < epochs - 1:
            elite = state.select("block", ((F.col("island") + 1) % islands).alias("island"), F.col("genome").alias("guest"))
            state = state.join(elite, ["block", "island"]).withColumn("elites", F.array("genome", "guest"))
    best = state.groupBy("block").agg(F.min_by(F.struct("items", "lengths", "genome"), F.struct("bins", "island")).alias("best"))

    def places(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                lengths, bins = np.asarray(row.lengths, np.int64), np.asarray(row.genome, np.int64)
                order = np.argsort(bins, kind="stable")
                before = np.cumsum(lengths[order]) - lengths[order]
                first = np.r_[True, np.diff(bins[order]) != 0]
                offset = np.empty(len(bins), np.int64)
                offset[order] = before - np.repeat(before[first], np.diff(np.r_[np.flatnonzero(first), len(bins)]))
                fill = np.bincount(bins, weights=lengths).astype(np.int64)
                yield pd.DataFrame({"item": np.asarray(row.items, np.int64), "length": lengths, "block": row.block, "bin": bins, "fill": fill[bins], "offset": offset})

    return best.select("block", "best.*").mapInPandas(places, "item bigint, length bigint, block bigint, bin bigint, fill bigint, offset bigint")


def pack(pieces: DataFrame, capacity: int = 1024, block: int = 4096, islands: int = 2, epochs: int = 2, population: int = 4, generations: int = 6) -> DataFrame:
    """``pieces`` with sequence_id and offset. Needs a column ``length`` from 1 to ``capacity``; others pass through.

    No sequence holds more than ``capacity``; the pieces of a sequence lie one after another from offset 0. Repeated
    rows are packed as often as they come; an empty table gives an empty one. Pieces of one length are alike:
    which of them lies where is not fixed. A very long text comes as many pieces.
    """
    pieces = staged(pieces.withColumn("item", F.monotonically_increasing_id()), "pieces")
    loose = pieces.where(F.col("length") < capacity).select("item", "length")
    setting = {"capacity": capacity, "block": block, "islands": islands, "epochs": epochs, "population": population, "generations": generations}
    first = staged(packed_blocks(loose, loose.count(), seed=1, **setting), "packed")
    poor = F.col("fill") < capacity - capacity // 64
    again = first.where(poor).select("item", "length")
    second = staged(packed_blocks(again, again.count(), seed=2, **setting), "packed")
    bins = lambda df: df.select("block", "bin").distinct().count()
    if bins(second) < bins(first.where(poor)):
        placed = first.where(~poor).withColumn("round", F.lit(0)).unionByName(second.withColumn("round", F.lit(1)))
    else:
        placed = first.withColumn("round", F.lit(0))
    number = (F.col("block") * 2 + F.col("round")) * F.lit(1 << 24) + F.col("bin")
    placed = placed.select("item", number.alias("sequence_id"), "offset")
    full = F.col("length") >= capacity
    alone = pieces.where(full).withColumn("sequence_id", -1 - F.col("item")).withColumn("offset", F.lit(0).cast("long"))
    return pieces.where(~full).join(placed, "item").unionByName(alone).drop("item")
