"""Near-deduplication by MinHash: one-permutation hashing with optimal densification, banded, with star candidates.

1. One pass over the texts gives each its number of shingles, a fingerprint of its shingle set and a signature. The set
   is hashed once: each of ``BINS`` ranges of the hash keeps its smallest value, and an empty bin borrows that of a
   full one, chosen by a hash of (bin, attempt) alone, so that equal sets borrow alike.
2. Texts with equal sets are one class, however many; classes meet in band buckets.
3. A bucket links its members to one hub, so it makes fewer pairs than it has members: to the one that meets most others,
   which is the same in most of its buckets. Pairs are confirmed on full sets.
4. A bucket whose members are not all in one component yet is compared in full, whatever its size, and no pair leaves a
   task: its members are dealt over parts of about ``CELL``, every two parts meet in one cell with their sets, and a cell
   gives back a spanning forest of the links between components that it finds. Buckets of the same members count once.

So each pair at the threshold that shares a band is linked. At 85 % a pair shares none of 32 bands with a chance of 1e-10,
at 80 % of 5e-8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillspark.llm import bytescan
from rillspark.llm.common import components, dropped, small_batches, staged, with_groups

BINS, BANDS = 128, 32
#: Word hashes that sketches are made of, and independent ones that pairs are confirmed on.
SKETCHED, CONFIRMED = 0x1234567, 0x7654321
#: About so many members of a bucket, or pairs of a hub, are one task's work at a time.
CELL = 512
SET = ["n_shingles", "set_a", "set_b"]


def lenders(attempts: int = 256) -> np.ndarray:
    """For every attempt and empty bin, the bin that it asks."""
    grid = np.arange(attempts * BINS, dtype=np.uint64).reshape(attempts, BINS)
    return (bytescan.mixed(grid, 0xA5A5A5A5) % np.uint64(BINS)).astype(np.int64)


def densified(values: np.ndarray, full: np.ndarray, lend: np.ndarray) -> np.ndarray:
    """Fill the empty bins of each row of ``values``. Rows without any full bin stay as they are."""
    rows, bins = np.nonzero(~full & full.any(axis=1)[:, None])
    for asked in lend:
        if not len(rows):
            return values
        found = full[rows, asked[bins]]
        values[rows[found], bins[found]] = values[rows[found], asked[bins[found]]]
        rows, bins = rows[~found], bins[~found]
    for step in range(1, BINS):  # the few that are left take the next full bin
        near = (bins + step) % BINS
        found = full[rows, near]
        values[rows[found], bins[found]] = values[rows[found], near[found]]
        rows, bins = rows[~found], bins[~found]
    return values


def signatures(found: np.ndarray, counts: np.ndarray, lend: np.ndarray) -> np.ndarray:
    """Band keys of each text from its ascending shingle hashes."""
    doc = np.repeat(np.arange(len(counts)), counts)
    cell = doc * BINS + (found >> np.uint64(57)).astype(np.int64)
    first = np.ones(len(cell), bool)
    first[1:] = cell[1:] != cell[:-1]
    values, full = np.zeros(len(counts) * BINS, np.uint64), np.zeros(len(counts) * BINS, bool)
    values[cell[first]], full[cell[first]] = found[first], True
    values = densified(values.reshape(-1, BINS), full.reshape(-1, BINS), lend)
    values = bytescan.mixed(values).reshape(len(counts), BANDS, BINS // BANDS)
    keys = np.zeros((len(counts), BANDS), np.uint64)
    keys[:] = np.arange(BANDS, dtype=np.uint64)
    for i in range(BINS // BANDS):
        keys = bytescan.mixed(keys + values[:, :, i], 0x2545F491 + i)
    return keys


def long_lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


def sketches(docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """(id, text_key, n_shingles, set_a, set_b, bands) of every row; set_a and set_b are sums over the shingles' two independent hashes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lend = lenders()
        for batch in batches:
            for first, data, offsets in bytescan.pieces(batch.column(1)):
                sums = []
                for seed in (CONFIRMED, SKETCHED):
                    found, counts = bytescan.shingles(*bytescan.word_hashes(data, offsets, seed), k)
                    total = np.zeros(len(counts), np.uint64)
                    np.add.at(total, np.repeat(np.arange(len(counts)), counts), bytescan.mixed(found, 11))
                    sums.append(pa.array(total.view(np.int64)))
                keys = signatures(found, counts, lend)
                bands = np.where(counts > 0, BANDS, 0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(counts)), batch.column(2).slice(first, len(counts)), pa.array(counts), *sums, long_lists(keys[counts > 0].ravel(), bands)],
                    names=[id_col, "text_key", *SET, "bands"],
                )

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    rows = docs.select(id_col, text_col, F.xxhash64(text_col).alias("text_key"))
    return rows.mapInArrow(work, f"{id_col} {kind}, text_key bigint, n_shingles bigint, set_a bigint, set_b bigint, bands array<bigint>")


def shingle_sets(docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """(node, shingles): the whole set of each row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in bytescan.pieces(batch.column(1)):
                found, counts = bytescan.shingles(*bytescan.word_hashes(data, offsets, CONFIRMED), k)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(counts)), long_lists(found, counts)], names=["node", "shingles"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(work, f"node {kind}, shingles array<bigint>")


def fitting(a: str, b: str, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (node, hub) whose sets overlap in at least ``percent`` of their union.

    A hub's set goes once to each part of its pairs, and a part has about ``CELL`` of them.
    """
    sizes = staged(pairs.groupBy("hub").agg(F.count("*").alias("n")), "hubs")
    parts = F.ceil(F.col("n") / CELL)
    pairs = with_groups(pairs, sizes, ["hub"], "n", pairs.count()).withColumn("part", F.pmod(F.xxhash64("node"), parts))
    hubs = sizes.join(sets.select(F.col("node").alias("hub"), F.col("shingles").alias("of_hub")), "hub")
    hubs = hubs.select("hub", "of_hub", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"))
    both = F.size(F.array_intersect("shingles", "of_hub"))
    near = 100 * both >= percent * (F.size("shingles") + F.size("of_hub") - both)
    return pairs.join(sets, "node").join(hubs, ["hub", "part"]).where(near).select(F.col("node").alias("a"), F.col("hub").alias("b"))


def shared_buckets(listed: DataFrame) -> DataFrame:
    """The rows (bucket, node, ...) of buckets with several members, with their number ``n``."""
    sizes = listed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    return listed.join(sizes, "bucket")


def star(members: DataFrame, percent: int) -> DataFrame:
    """Pairs (node, hub) of each member and its bucket's hub: the member with the largest ``meets``."""
    hubs = members.groupBy("bucket").agg(F.max(F.struct("meets", "node", "n_shingles")).alias("hub"))
    pairs = members.join(hubs, "bucket").where("node <> hub.node").where(fitting("n_shingles", "hub.n_shingles", percent))
    return pairs.select("node", F.col("hub.node").alias("hub")).distinct()


def open_members(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(bucket, node, component, n): the members of buckets that hold several components, one bucket for each set of members."""
    named = members.select("bucket", "node").join(labels.withColumnRenamed("node", "labelled"), F.col("node") == F.col("labelled"), "left")
    named = staged(named.select("bucket", "node", F.coalesce("component", "node").alias("component")), "named-members")
    held = [F.bit_xor(F.xxhash64("node")).alias("held_a"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("held_b")]
    split = named.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n"), *held).where("low < high")
    once = staged(split.groupBy("n", "held_a", "held_b").agg(F.min("bucket").alias("bucket")).select("bucket", "n"), "open-buckets")
    return with_groups(named, once, ["bucket"], "n", named.count()).where("n is not null")


def meeting(component: np.ndarray, part: np.ndarray, flat: np.ndarray, sizes: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Index pairs that link components: a spanning forest of all links between the members of one cell.

    ``flat`` holds the members' sets one after another. If the cell has two parts, only pairs across them are compared.
    """
    k = len(sizes)
    row = np.repeat(np.arange(k), sizes)
    token = np.unique(flat, return_inverse=True)[1]
    often = np.bincount(token) > 1  # a shingle of one member alone is in no overlap
    column = (np.cumsum(often) - 1)[token]
    row, column = row[often[token]], column[often[token]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((k, k), np.float64 if sizes.max(initial=0) > 1 << 24 else np.float32)
    wide = 2048
    for low in range(0, int(often.sum()), wide):
        a, b = np.searchsorted(column, [low, low + wide])
        has = np.zeros((k, min(wide, int(often.sum()) - low)), both.dtype)
        has[row[a:b], column[a:b] - low] = 1
        both += has @ has.T
    near = 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)
    near &= component[:, None] != component[None, :]
    if part.min() != part.max():
        near &= part[:, None] != part[None, :]
    i, j = np.nonzero(near)
    if not len(i):
        return []
    code = np.unique(component, return_inverse=True)[1]
    m = int(code.max()) + 1
    example = np.full((m, m), -1, np.int64)
    example[code[i], code[j]] = i * k + j
    seen, edges = np.zeros(m, bool), []
    for root in np.unique(code[i]).tolist():
        waiting = [] if seen[root] else [root]
        seen[root] = True
        while waiting:
            c = waiting.pop()
            new = np.flatnonzero((example[c] >= 0) & ~seen)
            seen[new] = True
            edges += [(x // k, x % k) for x in example[c, new].tolist()]
            waiting += new.tolist()
    return edges


def cell_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): links that connect the components of each bucket of ``members`` (bucket, node, component, n)."""
    parts = F.ceil(F.col("n") / CELL)
    rows = members.withColumn("part", F.pmod(F.xxhash64("node"), parts)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    rows = rows.withColumn("one", F.least("part", "other")).withColumn("two", F.greatest("part", "other"))
    cell = ["bucket", "one", "two"]
    rows = rows.join(sets, "node").select(*cell, "part", "node", "component", "shingles").repartition(*cell).sortWithinPartitions(*cell)

    def solve(table: pa.Table) -> pa.RecordBatch:
        lists = table["shingles"].chunk(0)
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        component = table["component"].chunk(0).dictionary_encode().indices.to_numpy()
        edges = meeting(component, table["part"].to_numpy(), flat, np.diff(lists.offsets.to_numpy()), percent)
        node = table["node"].chunk(0)
        ends = [node.take(pa.array([e[side] for e in edges], pa.int64())) for side in (0, 1)]
        return pa.RecordBatch.from_arrays(ends, names=["a", "b"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                now = tuple(keys[a].tolist())
                if now != key and held:
                    yield solve(pa.Table.from_batches(held).combine_chunks())
                    held = []
                key = now
                held.append(batch.slice(a, b - a))
        if held:
            yield solve(pa.Table.from_batches(held).combine_chunks())

    kind = members.select("node").schema[0].dataType.simpleString()
    return rows.mapInArrow(work, f"a {kind}, b {kind}")


def near_links(classes: DataFrame, docs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(node, component) of the classes that are linked to another.

    ``classes`` has node, the class's smallest id, n_shingles and bands.
    """
    listed = classes.select("node", "n_shingles", F.explode("bands").alias("bucket"))
    members = staged(shared_buckets(listed), "bucket-members")
    nodes = staged(members.groupBy("node").agg(F.sum("n").alias("meets")), "meets")
    texts = docs.join(nodes.select(F.col("node").alias("wanted")), docs[id_col] == F.col("wanted"), "left_semi")
    sets = staged(shingle_sets(texts, k, id_col, text_col), "shingle-sets")
    pairs = staged(star(members.join(nodes, "node"), percent), "pairs")
    links = staged(confirmed(pairs, sets, percent), "links")
    labels = staged(components(links), "labels")
    rest = open_members(members, labels)
    more = staged(cell_links(rest, sets, percent), "links")
    if more.head(1):
        labels = staged(components(links.unionByName(more)), "labels")
    dropped(members, nodes, sets, pairs)
    return labels


def grouped(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(id, text_key, n_shingles, set_a, component_id) for every row of ``docs``."""
    small_batches(docs.sparkSession)
    rows = staged(sketches(docs, k, id_col, text_col), "sketches")
    classes = rows.where("n_shingles > 0").groupBy(*SET).agg(F.min(id_col).alias("node"), F.count("*").alias("size"), F.any_value("bands").alias("bands"))
    classes = staged(classes, "classes")
    found = near_links(classes.where("node is not null").select("node", "n_shingles", "bands"), docs, k, percent, id_col, text_col)
    found = found.withColumnRenamed("component", "reached")
    named = classes.join(found, "node", "left").select(*SET, "size", F.coalesce("reached", "node").alias("component_id"))
    named = staged(named, "named")
    out = with_groups(rows.drop("bands"), named, SET, "size", rows.count())
    return out.select(id_col, "text_key", "n_shingles", "set_a", F.coalesce("component_id", F.col(id_col)).alias("component_id"))


def near_groups(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row of ``docs``. Ids may be numbers or strings.

    Documents are linked if their sets of ``k``-word shingles overlap in ``percent`` of the union or more. The component
    is the smallest id reachable. Texts without words, null ones too, are linked with nothing. Rows that share an id are
    one node: what either is linked with, both are. Rows with a null id are linked through equal sets alone, and never
    lend their id. A very long text is read whole; its set is one row. Other columns play no part, whatever their names.
    An empty table gives an empty one.
    """
    out = grouped(docs, k, percent, id_col, text_col)
    return out.select(id_col, "n_shingles", "component_id", F.col(id_col).eqNullSafe(F.col("component_id")).alias("kept"))


def near_dedup(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of ``docs``, the one with the smallest id, with all its columns.

    Of rows that share that id, or have none, the text with the smallest hash stays; rows that repeat id and text stay or
    go together. Rows without words all stay.
    """
    rows = staged(grouped(docs, k, percent, id_col, text_col).where("n_shingles > 0"), "grouped")
    first = F.col(id_col).eqNullSafe(F.col("component_id"))
    rivals = rows.where(first).withColumn("set of none", F.when(F.col(id_col).isNull(), F.col("set_a")).otherwise(0))
    twice = rivals.groupBy(F.col(id_col).alias("rival id"), F.col("set of none").alias("rival set"))
    twice = twice.agg(F.min("text_key").alias("low key"), F.max("text_key").alias("high key")).where(F.col("low key") < F.col("high key"))
    same = rivals[id_col].eqNullSafe(F.col("rival id")) & (F.col("set of none") == F.col("rival set"))
    later = rivals.join(twice, same).where(F.col("text_key") > F.col("low key"))
    gone = rows.where(~first).select(F.col(id_col).alias("gone id"), F.col("text_key").alias("gone key"))
    gone = gone.unionByName(later.select(F.col(id_col).alias("gone id"), F.col("text_key").alias("gone key")))
    return docs.join(gone, docs[id_col].eqNullSafe(gone["gone id"]) & (F.xxhash64(docs[text_col]) == gone["gone key"]), "left_anti")
