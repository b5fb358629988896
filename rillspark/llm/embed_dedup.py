"""Near-deduplication of embeddings by collision-counting projections.

Vectors are projected on many random directions. A window in the middle of a sorted projection holds a fixed share of all
vectors, close or not, so windows are taken at the far ends, where projections are thin: in each of several tables the
directions come in groups, and a vector stands at the far end of the one direction of each group on which it projects
furthest. Two close vectors stand at the same ends far more often than others do. The vectors at the same ends are the
candidates of each other; for each pair of them, collisions are counted over further projections in windows centred on
either one, and pairs that reach the count are verified by their cosine in double precision.

The numbers follow from the number of vectors, the similarity and the recall that are asked for: directions in a group and
groups in a table, so that about ``window`` vectors meet; tables, so that two close vectors meet in one; the width of a
centred window, and the count. Projections of a unit vector on random directions are normal whatever the data, so the
recall holds for every pair. Vectors compared per vector are about tables
times ``window``: 5,900 for 10^5 vectors, 19,500 for 10^8.

Links are counted where they are found: a pair that meets in several tables counts in the first. A window gives back one
count per vector and the edges of a spanning forest, so a group of copies of any size gives back as many rows as it has.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillspark.llm.common import components, dropped, staged, with_groups

KEY = ["hash_a", "hash_b"]
#: The most directions in a group: more would make projections dearer than the tables that they save.
MOST = 256


def upper(t: float) -> float:
    return 0.5 * math.erfc(t / math.sqrt(2))


def same_end(m: int, cosine: float, draws: int = 20_000) -> float:
    """The chance that two vectors at ``cosine`` project furthest on the same of ``m`` directions, less three errors."""
    if m == 1:
        return 1.0
    rng = np.random.default_rng(m)
    x = rng.normal(size=(draws, m))
    y = cosine * x + math.sqrt(1 - cosine * cosine) * rng.normal(size=(draws, m))
    p = float((x.argmax(axis=1) == y.argmax(axis=1)).mean())
    return p - 3 * math.sqrt(p * (1 - p) / draws)


def calibrated(n: int, cosine: float, recall: float, window: int, checks: int) -> tuple[int, int, int, float, int]:
    """(tables, groups, directions in a group, centred half-width, least count): a pair at ``cosine`` is kept with ``recall``."""
    miss = (1 - recall) / 2
    groups = 1
    while (m := math.ceil(max(1.0, n / window) ** (1 / groups))) > MOST:
        groups += 1
    chance = same_end(m, cosine) ** groups
    tables = 1 if chance >= 1 else math.ceil(math.log(miss) / math.log(1 - chance))
    width = 1.5 * math.sqrt(2 * (1 - cosine))
    hit = 1 - 2 * upper(1.5)
    under, least = 0.0, 0
    while least < checks:
        under += math.comb(checks, least) * hit**least * (1 - hit) ** (checks - least)
        if under > miss:
            break
        least += 1
    return tables, groups, m, width, least


def drawn(size: int, directions: int, checks: int) -> tuple[np.ndarray, np.ndarray]:
    """The directions of the tables and of the counted windows for vectors of ``size`` components."""
    rng = np.random.default_rng(97 + size)
    return rng.normal(0, 1, (size, directions)).astype(np.float32), rng.normal(0, 1, (size, checks)).astype(np.float32)


def binaries(rows: np.ndarray) -> pa.Array:
    """One binary value per row of a matrix."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows.tobytes())])


def window_rows(classes: DataFrame, tables: int, groups: int, m: int, width: float, checks: int, narrow: bool) -> DataFrame:
    """(table, ends, size, node, weight, raw, codes, own): each class once for each table, at the ends where it stands.

    ``codes`` are its counted projections in units of a quarter of the half-width, ``own`` its ends in all tables. Vectors
    travel as 32-bit floats if they came as such.
    """
    float_kind = "<f4" if narrow else "<f8"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        axes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        radix = np.array([m**i for i in range(groups)], np.int64)
        for batch in batches:
            lists = batch.column(2)
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            at = np.cumsum(sizes) - sizes
            for size in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == size)
                directions, counted = axes.setdefault(size, drawn(size, tables * groups * m, checks))
                for a in range(0, len(rows), 512):
                    some = rows[a : a + 512]
                    raw = flat[at[some][:, None] + np.arange(size)]
                    unit = raw.astype(np.float64)
                    unit = unit / np.abs(unit).max(axis=1, keepdims=True)
                    unit = (unit / np.linalg.norm(unit, axis=1, keepdims=True)).astype(np.float32)
                    ends = (unit @ directions).reshape(len(some), tables, groups, m).argmax(axis=3)
                    ends = ((ends * radix).sum(axis=2) % ((1 << 31) - 1)).astype("<i4")
                    codes = np.clip(np.rint(unit @ counted * (4 / width)), -127, 127).astype(np.int8)
                    row = np.repeat(np.arange(len(some)), tables)
                    where = pa.array(some[row])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.tile(np.arange(tables, dtype=np.int32), len(some))), pa.array(ends.ravel()), pa.array(np.full(len(row), size, np.int32)),
                            batch.column(0).take(where), batch.column(1).take(where), binaries(raw.astype(float_kind)[row]), binaries(codes[row]), binaries(ends[row]),
                        ],
                        names=["table", "ends", "size", "node", "weight", "raw", "codes", "own"],
                    )

    return classes.select("node", "weight", "embedding").mapInArrow(work, "table int, ends int, size int, node bigint, weight bigint, raw binary, codes binary, own binary")


def close_pairs(codes: np.ndarray, unit: np.ndarray, earlier: np.ndarray, left: np.ndarray, right: np.ndarray, cosine: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of ``left`` and ``right`` that are linked and meet in no earlier table; once each if the two are the same."""
    found_a, found_b = [np.zeros(0, int)], [np.zeros(0, int)]
    for s in range(0, len(left), 256):
        some = left[s : s + 256]
        count = np.zeros((len(some), len(right)), np.uint8)
        for k in range(codes.shape[1]):  # the rows in the window of projection k that is centred on each query
            near = codes[some, k][:, None] - codes[right, k][None, :]
            count += (np.abs(near) <= 4).view(np.uint8)
        i, j = np.nonzero(count >= least)
        a, b = some[i], right[j]
        if left is right:
            a, b = a[a < b], b[a < b]
        for u in range(0, len(a), 1 << 15):
            x, y = a[u : u + (1 << 15)], b[u : u + (1 << 15)]
            near = np.einsum("ij,ij->i", unit[x], unit[y]) >= cosine
            x, y = x[near], y[near]
            first = ~(earlier[x] == earlier[y]).any(axis=1)
            found_a.append(x[first]), found_b.append(y[first])
    return np.concatenate(found_a), np.concatenate(found_b)


def forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the pairs: each round, every root that can takes one edge to a smaller one."""
    root, kept_a, kept_b = np.arange(n), [np.zeros(0, int)], [np.zeros(0, int)]
    while True:
        high, low = np.maximum(root[a], root[b]), np.minimum(root[a], root[b])
        apart = high != low
        if not apart.any():
            return np.concatenate(kept_a), np.concatenate(kept_b)
        a, b, high, low = a[apart], b[apart], high[apart], low[apart]
        top, at = np.unique(high, return_index=True)
        kept_a.append(a[at]), kept_b.append(b[at])
        root[top] = low[at]
        while (root[root] != root).any():
            root = root[root]


def window_links(rows: DataFrame, cosine: float, least: int, block: int, narrow: bool) -> DataFrame:
    """(node, links, other): link counts (other is null) and forest edges (links is null), window by window.

    A window of over ``block`` rows is cut into blocks by a hash of the node, and each pair of its blocks is a task's work.
    """
    place = ["table", "ends", "size"]
    crowded = staged(rows.groupBy(*place).agg(F.count("*").alias("n")).where(F.col("n") > block), "crowded")
    rows = rows.join(crowded, place, "left").withColumn("blocks", F.ceil(F.coalesce("n", F.lit(1)) / block).cast("int"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("block_a", F.least("block", "with")).withColumn("block_b", F.greatest("block", "with"))
    group = [*place, "block_a", "block_b"]
    rows = rows.select(*group, "block", "node", "weight", "raw", "codes", "own").repartition(*group).sortWithinPartitions(*group)
    float_kind = "<f4" if narrow else "<f8"

    def solve(key: tuple, table: pa.Table) -> pa.RecordBatch:
        matrix = lambda name, kind: np.frombuffer(b"".join(table[name].to_pylist()), kind).reshape(len(table), -1)
        unit = matrix("raw", float_kind).astype(np.float64)
        unit = unit / np.abs(unit).max(axis=1, keepdims=True)
        unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
        node, weight, block = (table[c].to_numpy() for c in ("node", "weight", "block"))
        left = np.flatnonzero(block == key[3])
        right = left if key[3] == key[4] else np.flatnonzero(block == key[4])
        a, b = close_pairs(matrix("codes", np.int8).astype(np.int16), unit, matrix("own", "<i4")[:, : key[0]], left, right, cosine, least)
        links = np.bincount(a, weights=weight[b], minlength=len(node)) + np.bincount(b, weights=weight[a], minlength=len(node))
        has, (x, y) = np.flatnonzero(links), forest(a, b, len(node))
        gap = lambda n: pa.nulls(n, pa.int64())
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([node[has], node[x]])), pa.concat_arrays([pa.array(links[has].astype(np.int64)), gap(len(x))]),
                pa.concat_arrays([gap(len(has)), pa.array(node[y])]),
            ],
            names=["node", "links", "other"],
        )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts = None, []
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy() for i in range(5)], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                now = tuple(keys[a].tolist())
                if now != key and parts:
                    yield solve(key, pa.Table.from_batches(parts).combine_chunks())
                    parts = []
                key = now
                parts.append(batch.slice(a, b - a))
        if parts:
            yield solve(key, pa.Table.from_batches(parts).combine_chunks())

    return rows.mapInArrow(work, "node bigint, links bigint, other bigint")


def embedding_groups(vectors: DataFrame, cosine: float = 0.9, recall: float = 0.9998, window: int = 256, checks: int = 32, block: int = 2048, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept) of every row; other columns of ``vectors`` play no part.

    ``n_links`` counts the other rows at ``cosine`` or more, ``component_id`` is the smallest id reachable over links.
    Vectors that are null, empty or zero, or hold null or non-finite components, link with nothing; vectors of different
    lengths neither. Equal vectors are one class, told apart only in the counts. ``window`` is how many unlike vectors
    should meet at the same ends of a table; ids are integers. An empty table gives an empty one.

    A null id stands for no vector of its own: it is counted by, and linked with, rows of the same vector, but a vector
    whose rows all have null ids is compared with no other. Repeated rows count as often as they come.
    """
    part = F.col(vector_col)
    good = part.isNotNull() & F.forall(part, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(part, lambda x: x != 0)
    rows = vectors.select(F.col(id_col), F.when(good, part.cast("array<double>")).alias("embedding"))
    rows = rows.withColumn("hash_a", F.xxhash64("embedding")).withColumn("hash_b", F.xxhash64(F.lit("b"), "embedding"))
    lone = rows.where("embedding is null").select(id_col, F.lit(0).cast("long").alias("n_links"), F.col(id_col).alias("component_id"))
    rows = rows.where("embedding is not null")
    classes = staged(rows.groupBy(*KEY).agg(F.min(id_col).cast("long").alias("node"), F.count("*").alias("weight"), F.any_value("embedding").alias("embedding")), "vector-classes")
    tables, per_table, m, width, least = calibrated(classes.count(), cosine, recall, window, checks)
    narrow = vectors.schema[vector_col].dataType.elementType.simpleString() == "float"
    placed = staged(window_rows(classes.where("node is not null").repartition(F.col("node")), tables, per_table, m, width, checks, narrow), "windows")
    found = staged(window_links(placed, cosine, least, block, narrow), "window-links")
    dropped(placed)
    counts = found.where("links is not null").groupBy("node").agg(F.sum("links").alias("links"))
    labels = components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    groups = classes.drop("embedding").join(counts, "node", "left").join(labels, "node", "left")
    groups = staged(groups.select(*KEY, "weight", F.col("node").alias("class_id"), "links", "component"), "vector-groups")
    out = with_groups(rows.drop("embedding"), groups, KEY, "weight", rows.count())
    out = out.select(id_col, (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "class_id", F.col(id_col)).alias("component_id"))
    return out.unionByName(lone).withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
