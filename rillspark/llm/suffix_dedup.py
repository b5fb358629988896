"""Suffix-array deduplication: remove bytes covered by a string of ``span`` bytes that starts anywhere else as well.

Blockwise construction with a difference cover. Suffixes are compared by their first ``span`` bytes only.

1. Buckets. The suffix at s belongs to the bucket of its anchor, the rarest-looking gram among the ``span`` bytes at s
   (the smallest hash, the first of equals). Equal strings have equal anchors at equal distances, so equal suffixes
   share a bucket. Neighbouring suffixes share an anchor: one row stands for about a hundred of them, with a
   fingerprint of all the bytes that they cover.
2. Whole rows. Rows with equal anchors and fingerprints, two hashes over different codes, repeat as they are; one of them
   stands for all. A gram that only one kind of row has needs no sort. What is left are buckets whose rows differ
   somewhere: edges of repeated passages and edited copies.
3. Blockwise sort. Only those rows fetch their bytes, and each task sorts a few buckets at a time in byte order: suffixes
   by the rank of their first ``COVER`` bytes, and where these tie, by comparison of the ranks of cover samples. For any
   two positions i, j there is a shift k < COVER such that i + k and j + k are both sampled, so the long ranks are kept
   for one position in seven. All ranks come from comparing bytes, by doubling; no hash decides a tie.
4. A bucket of over ``most`` different rows would not fit a block. Its rows are cut into slices, a quarter as wide each
   time, by the suffixes' distance to the anchor. All suffixes of a slice hold one stretch around the anchor, longer the
   thinner the slice, and it is dealt to a new bucket by that: 2 and 3 start over with these, and what is still crowded is
   cut again. A slice of one distance has its whole suffix for a stretch, so this ends. A cut makes at most five lines of
   one, so lines grow with rows and not with the suffixes of crowded buckets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillspark.llm import bytescan
from rillspark.llm.common import dropped, small_batches, staged

#: The cover's period: 24 r^2 + 36 r + 13 for r = 1; its 6 r + 4 residues come from Colbourn and Ling's rule.
COVER = 73
GRAM = 100
#: A cut of crowded buckets makes slices thinner by this factor.
CUTS = 4
ROW = ["doc_id", "text_id"]
#: Codes of bytes for the second of two fingerprints.
OTHER_CODE = np.random.default_rng(8).integers(1, 1 << 63, 256, dtype=np.uint64)


def difference_cover(r: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Residues D mod v, and the table of shifts: table[a, b] = k with a + k and b + k both in D."""
    steps = [1] * r + [r + 1] + [2 * r + 1] * r + [4 * r + 3] * (2 * r + 1) + [2 * r + 2] * (r + 1) + [1] * r
    v = 24 * r * r + 36 * r + 13
    cover = np.unique(np.concatenate([[0], np.cumsum(steps)]) % v)
    table = np.full((v, v), -1, np.int64)
    for c in cover:
        for d in cover:
            for k in range(v):
                table[(c - k) % v, (d - k) % v] = k if table[(c - k) % v, (d - k) % v] < 0 else table[(c - k) % v, (d - k) % v]
    assert (table >= 0).all()
    return cover, table


def window_minimum(values: np.ndarray, w: int) -> np.ndarray:
    """The minimum of every ``w`` values in a row, by running minima from both ends of blocks of ``w``."""
    n = len(values) - w + 1
    padded = np.full(-(-len(values) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    grid = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def stretches(first: int, data: np.ndarray, offsets: np.ndarray, span: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """A piece as it is, or a very long text in parts that overlap so that each suffix is in one: (row, start, bytes, offsets)."""
    if len(offsets) > 2 or len(data) <= 2 * bytescan.PIECE:
        yield first, 0, data, offsets
        return
    for c in range(0, len(data) - span + 1, bytescan.PIECE):
        end = min(len(data), c + bytescan.PIECE + span - 1)
        yield first, c, data[c:end], np.array([0, end - c])


def whole_print(others: np.ndarray, powers: bytescan.Powers, begin: np.ndarray, end: np.ndarray, at: np.ndarray, span: int) -> np.ndarray:
    """Fingerprints of all bytes of suffixes begin..end and of their places around the anchor."""
    cover = bytescan.mixed(bytescan.window_hash(others, powers, begin, end + span))
    return bytescan.mixed(cover + (((at - begin) << 32) | (end - begin)).astype(np.uint64), 3)


def anchor_rows(docs: DataFrame, span: int) -> DataFrame:
    """(doc_id, text_id, low, high, at, gram, cover): suffixes low..high have their anchor at ``at``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = bytescan.Powers()
        for batch in batches:
            whole = (part for piece in bytescan.pieces(batch.column(2)) for part in stretches(*piece, span))
            for first, skipped, data, offsets in whole:
                if len(data) < span:
                    continue
                sums, others = bytescan.prefix_sums(data, powers), bytescan.prefix_sums(data, powers, OTHER_CODE)
                start = np.arange(len(data) - GRAM + 1)
                grams = bytescan.mixed((sums[GRAM:] - sums[:-GRAM]) * powers.down[start])
                low = window_minimum((grams & np.uint64(0xFFFFFFFF00000000)) | start.astype(np.uint64), span - GRAM + 1)
                at = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
                sizes = np.diff(offsets)
                doc = np.repeat(np.arange(len(sizes)), sizes)[: len(at)]
                inside = np.arange(len(at)) + span <= offsets[doc + 1]
                s = np.flatnonzero(inside)
                if not len(s):
                    continue
                new = np.r_[True, (at[s[1:]] != at[s[:-1]]) | (s[1:] != s[:-1] + 1) | (doc[s[1:]] != doc[s[:-1]])]
                begin, end = s[new], s[np.r_[new[1:], True]]
                p, d = at[begin], doc[begin]
                cover = whole_print(others, powers, begin, end, p, span)
                rows = pa.array(first + d)
                base = offsets[d] - skipped
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(begin - base), pa.array(end - base), pa.array(p - base), pa.array(grams[p].view(np.int64)), pa.array(cover.view(np.int64))],
                    names=[*ROW, "low", "high", "at", "gram", "cover"],
                )

    return docs.select(*ROW, "text").mapInArrow(work, f"{row_kind(docs)}, low bigint, high bigint, at bigint, gram bigint, cover bigint")


def row_kind(docs: DataFrame) -> str:
    return f"doc_id {docs.select('doc_id').schema[0].dataType.simpleString()}, text_id bigint"


def runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The indices start[i] .. start[i] + size[i] - 1, one run after another."""
    return np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)


PART = ["low", "high", "at", "gram", "cover", "known", "sliced", "raw"]
PART_KIND = "low bigint, high bigint, at bigint, gram bigint, cover bigint, known boolean, sliced boolean, raw binary"


def part_batch(batch: pa.RecordBatch, row: np.ndarray, columns: list[np.ndarray], sliced: bool, raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
    """Lines of PART with the ids of ``batch``'s rows ``row`` and the bytes start[i] .. start[i] + size[i] - 1 of ``raw``."""
    where = pa.array(row)
    cuts = np.r_[0, np.cumsum(size)].astype(np.int32)
    own = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(cuts), pa.py_buffer(raw[runs(start, size)].tobytes())])
    return pa.RecordBatch.from_arrays([batch.column(0).take(where), batch.column(1).take(where), *map(pa.array, columns), pa.array(np.full(len(row), sliced)), own], names=[*ROW, *PART])


def slice_batch(batch: pa.RecordBatch, row: np.ndarray, low: np.ndarray, high: np.ndarray, at: np.ndarray, gram: np.ndarray, known: np.ndarray, raw: np.ndarray, where: np.ndarray, span: int, width: int, powers: bytescan.Powers) -> pa.RecordBatch:
    """Rows, whose bytes begin at ``where`` in ``raw``, cut into slices of ``width`` distances from suffix to anchor.

    All suffixes of a slice hold the bytes from the last possible start to the first possible end. Its new gram is made of
    these, of the old gram and of the slice's number, so equal suffixes still share a bucket.
    """
    nearest, farthest = (at - high) // width, (at - low) // width
    n = farthest - nearest + 1
    i, nth = np.repeat(np.arange(len(n)), n), runs(nearest, n)
    low, high, at, shift = np.maximum(low[i], at[i] - (nth + 1) * width + 1), np.minimum(high[i], at[i] - nth * width), at[i], (where - low)[i]
    sums, others = bytescan.prefix_sums(raw, powers), bytescan.prefix_sums(raw, powers, OTHER_CODE)
    start = at - nth * width + shift
    stretch = bytescan.window_hash(sums, powers, start, start + span - width + 1)
    gram = bytescan.mixed(stretch + bytescan.mixed(gram[i].view(np.uint64) + nth.astype(np.uint64)))
    cover = whole_print(others, powers, low + shift, high + shift, at + shift, span)
    return part_batch(batch, row[i], [low, high, at, gram.view(np.int64), cover.view(np.int64), known[i]], True, raw, low + shift, high - low + span)


def fetched(docs: DataFrame, rows: DataFrame, span: int, width: int, most_bytes: int = 1 << 22) -> DataFrame:
    """``rows`` of one bucket each with their bytes; those of crowded buckets in slices of ``width``."""
    lists = rows.groupBy(*ROW).agg(F.collect_list(F.struct("low", "high", "at", "gram", "known", "crowded")).alias("parts"))
    lists = lists.select(F.col("doc_id").alias("of"), F.col("text_id").alias("of_text"), "parts")
    joined = docs.join(lists, docs["doc_id"].eqNullSafe(lists["of"]) & (docs["text_id"] == lists["of_text"])).select(*ROW, "text", "parts")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = bytescan.Powers()
        for batch in batches:
            texts = batch.column(2).cast(pa.large_binary())
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
            parts = batch.column(3)
            row_of = np.repeat(np.arange(len(parts)), np.diff(parts.offsets.to_numpy()))
            low, high, at, gram, known, crowded = (parts.flatten().field(i).to_numpy(zero_copy_only=False) for i in range(6))
            known, crowded = known.astype(bool), crowded.astype(bool)
            size = high - low + span
            end = np.cumsum(size)
            first = 0
            while first < len(low):
                last = max(first + 1, int(np.searchsorted(end, end[first] + most_bytes)))
                i = np.arange(first, last)
                first = last
                plain, split = i[~crowded[i]], i[crowded[i]]
                if len(plain):
                    columns = [low[plain], high[plain], at[plain], gram[plain], np.zeros(len(plain), np.int64), known[plain]]
                    yield part_batch(batch, row_of[plain], columns, False, data, offsets[row_of[plain]] + low[plain], size[plain])
                if len(split):
                    raw = data[runs(offsets[row_of[split]] + low[split], size[split])]
                    yield slice_batch(batch, row_of[split], *(x[split] for x in (low, high, at, gram, known)), raw, np.cumsum(size[split]) - size[split], span, width, powers)

    return joined.mapInArrow(work, f"{row_kind(docs)}, {PART_KIND}")


def sliced(parts: DataFrame, span: int, width: int) -> DataFrame:
    """Slices of crowded buckets cut into slices of ``width``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = bytescan.Powers()
        for batch in batches:
            if not len(batch):
                continue
            low, high, at, gram, known = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2, 7))
            bytes_ = batch.column(7)
            offsets = np.frombuffer(bytes_.buffers()[1], np.int32)[bytes_.offset : bytes_.offset + len(batch) + 1].astype(np.int64)
            raw = np.frombuffer(bytes_.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
            yield slice_batch(batch, np.arange(len(batch)), low, high, at, gram, known.astype(bool), raw, offsets[:-1] - offsets[0], span, width, powers)

    return parts.select(*ROW, "low", "high", "at", "gram", "known", "raw").mapInArrow(work, f"{row_kind(parts)}, {PART_KIND}")


def dense(keys: np.ndarray) -> np.ndarray:
    """The rank of each key among the different ones."""
    order = np.argsort(keys)
    ranked = keys[order]
    out = np.empty(len(keys), np.int64)
    out[order] = np.cumsum(np.r_[False, ranked[1:] != ranked[:-1]])
    return out


def later(ranks: np.ndarray, step: int) -> np.ndarray:
    """Of each position the rank, from 1, of the one ``step`` further on; 0 beyond the end."""
    return np.r_[ranks[step:] + 1, np.zeros(min(step, len(ranks)), np.int64)]


def cover_ranks(data: np.ndarray, middle: int, cover: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks in byte order of the ``COVER`` bytes at every position, and of the ``middle`` bytes at the sampled ones (else 0)."""
    n = len(data)
    padded = np.r_[data, np.zeros(8, np.uint8)]
    ranks = dense(np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)[:n]).view(">u8").ravel().astype(np.uint64))
    length = 8
    while length < COVER:
        step = min(length, COVER - length)
        ranks = dense(ranks * (n + 1) + later(ranks, step))
        length += step
    sampled = np.isin(np.arange(COVER), cover)[np.arange(n) % COVER]
    places = np.flatnonzero(sampled)
    long = np.zeros(n + middle, np.int64)
    long[places] = ranks[places] + 1
    have = COVER
    while 2 * have <= middle:  # a cover's positions repeat after COVER, so those that double the length are sampled too
        long[places] = dense(long[places] * (n + 1) + long[places + have]) + 1
        have *= 2
    short = np.r_[ranks + 1, np.zeros(middle, np.int64)]
    while have < middle:
        step = min(have, middle - COVER)
        long[places] = dense(long[places] * (n + 1) + short[places + step]) + 1
        have = step + COVER
    return ranks, long


def repeated_in_buckets(data: np.ndarray, sizes: np.ndarray, span: int, cover: np.ndarray, shifts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of bytes: (row, offset in the row) of each suffix whose ``span`` bytes another suffix has as well.

    The suffixes are sorted by their first bytes' ranks, and ties by quicksort in three parts on cover ranks, all groups
    of ties at once: what equals a pivot is settled, what is smaller or larger goes on.
    """
    base = np.cumsum(sizes) - sizes
    n = sizes - span + 1
    row = np.repeat(np.arange(len(sizes)), n)
    offset = runs(np.zeros(len(n), np.int64), n)
    s = base[row] + offset
    ranks, long = cover_ranks(data, span - COVER, cover)
    found = np.zeros(len(s), bool)
    active, group = np.arange(len(s)), ranks[s]
    while len(active):
        order = np.argsort(group, kind="stable")
        active, group = active[order], group[order]
        new = np.r_[True, group[1:] != group[:-1]]
        start = np.flatnonzero(new)
        size = np.diff(np.r_[start, len(active)])
        pivot = np.repeat(active[start + size // 2], size)
        a, b = s[active], s[pivot]
        shift = shifts[a % COVER, b % COVER]
        side = np.sign(long[a + shift] - long[b + shift])
        tail = span - COVER
        side = np.where(side == 0, np.sign(ranks[a + tail] - ranks[b + tail]), side)
        equal = np.add.reduceat((side == 0).astype(np.int64), start)
        found[active[(side == 0) & np.repeat(equal > 1, size)]] = True
        on = side != 0
        active, group = active[on], (2 * np.cumsum(new) + (side > 0))[on]
        lone = np.bincount(group, minlength=1)[group] == 1
        active, group = active[~lone], group[~lone]
    return row[found], offset[found]


def sorted_buckets(parts: DataFrame, span: int, batch_bytes: int = 1 << 21) -> DataFrame:
    """(doc_id, text_id, low, high) of repeated suffixes, from rows that carry bytes, sorted a few buckets at a time."""

    def solve(table: pa.Table, tools: tuple) -> pa.RecordBatch:
        raw = table["raw"].chunk(0)
        ends = raw.offset + np.arange(len(raw) + 1)
        offsets = np.frombuffer(raw.buffers()[1], np.int32)[ends].astype(np.int64)
        data = np.frombuffer(raw.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        row, offset = repeated_in_buckets(data, np.diff(offsets), span, *tools)
        open_rows = ~table["known"].to_numpy()[row] if len(row) else np.zeros(0, bool)
        row, offset = row[open_rows], offset[open_rows]
        order = np.lexsort((offset, row))
        row, offset = row[order], offset[order]
        new = np.r_[True, (row[1:] != row[:-1]) | (offset[1:] != offset[:-1] + 1)] if len(row) else np.zeros(0, bool)
        begin, end = np.flatnonzero(new), np.flatnonzero(np.r_[new[1:], True]) if len(row) else np.zeros(0, np.int64)
        where, low = pa.array(row[begin]), table["low"].to_numpy()[row[begin]]
        columns = [table[c].chunk(0).take(where) for c in ROW]
        return pa.RecordBatch.from_arrays([*columns, pa.array(low + offset[begin]), pa.array(low + offset[end])], names=[*ROW, "low", "high"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = difference_cover()
        held, size, last = [], 0, None
        for batch in batches:
            gram = batch.column(4).to_numpy()
            length = np.diff(np.frombuffer(batch.column(6).buffers()[1], np.int32)[batch.column(6).offset :][: len(batch) + 1])
            cuts = [0, *(np.flatnonzero(gram[1:] != gram[:-1]) + 1).tolist(), len(gram)]
            begin = 0
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if size > batch_bytes and gram[a] != last:
                    if a > begin:
                        held.append(batch.slice(begin, a - begin))
                    yield solve(pa.Table.from_batches(held).combine_chunks(), tools)
                    held, size, begin = [], 0, a
                last = gram[a]
                size += int(length[a:b].sum())
            if begin < len(batch):
                held.append(batch.slice(begin))
        if held:
            yield solve(pa.Table.from_batches(held).combine_chunks(), tools)

    return parts.repartition("gram").sortWithinPartitions("gram").select(*ROW, "low", "high", "gram", "known", "raw").mapInArrow(work, f"{row_kind(parts)}, low bigint, high bigint")


def kinds(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One line, with ``columns`` of one row, for all rows of a bucket that are equal as a whole; ``known``: it needs no answer.

    Buckets of one row are left out. ``kinds`` counts a bucket's lines, ``mixed`` tells if some are to be compared.
    """
    covers = rows.groupBy("gram", "cover").agg(F.count("*").alias("n"), F.max("known").alias("known"), F.min(F.struct(*columns)).alias("one"))
    covers = covers.withColumn("known", F.col("known") | (F.col("n") > 1))
    grams = covers.groupBy("gram").agg(F.sum("n").alias("all"), F.count("*").alias("kinds"), F.min("known").alias("done")).where("all > 1")
    return covers.join(grams, "gram").withColumn("mixed", (F.col("kinds") > 1) & ~F.col("done"))


def whole_spans(rows: DataFrame, covers: DataFrame) -> DataFrame:
    """(doc_id, text_id, low, high) of rows that repeat as a whole."""
    return rows.join(covers.where("n > 1").select("gram", "cover"), ["gram", "cover"], "left_semi").where("not known").select(*ROW, "low", "high")


def repeated_spans(docs: DataFrame, span: int, most: int) -> DataFrame:
    """(doc_id, text_id, low, high): suffixes low..high of a text each repeat somewhere. ``docs`` has ROW and text."""
    rows = staged(anchor_rows(docs, span), "anchors").withColumn("known", F.lit(False))
    covers = staged(kinds(rows, [*ROW, "low", "high", "at"]), "covers")
    spans, tables = whole_spans(rows, covers), [rows, covers]
    width = -(-(span - GRAM + 1) // CUTS)
    mixed_rows = covers.where("mixed").select("gram", "one.*", "known", (F.col("kinds") > most).alias("crowded"))
    parts = staged(fetched(docs, mixed_rows, span, width), "parts")
    tables.append(parts)
    blocks, rows, more = parts.where("not sliced"), parts.where("sliced"), mixed_rows.where("crowded").head(1)
    while more:
        covers = staged(kinds(rows, [*ROW, "low", "high", "at", "raw"]), "slices")
        tables.append(covers)
        spans = spans.unionByName(whole_spans(rows, covers))
        lines = covers.where("mixed").select("gram", "cover", "one.*", "known", ((F.col("kinds") > most) & F.lit(width > 1)).alias("sliced"))
        blocks = blocks.unionByName(lines.where("not sliced").select(blocks.columns))
        more = lines.where("sliced").head(1)
        if more:
            width = -(-width // CUTS)
            rows = staged(sliced(lines.where("sliced"), span, width), "parts")
            tables.append(rows)
    out = staged(spans.unionByName(sorted_buckets(blocks, span)), "spans")
    dropped(*tables)
    return out


def remove_repeats(docs: DataFrame, span: int = 400, most: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept) of every row: ``kept`` holds the bytes left, in order.

    Strings are judged on the input, may overlap, and never cross rows; copies within a row count. Null texts are empty.
    Shorter texts than ``span`` stay whole. Rows that repeat an id and a text are treated alike, each a copy of the other.
    Very long texts are taken in parts. Other columns play no part, whatever their names. An empty table gives an empty one.
    """
    if span < 2 * COVER:
        raise ValueError(f"span must be {2 * COVER} or more")
    small_batches(docs.sparkSession)
    plain = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    plain = plain.withColumn("text_id", F.xxhash64("text")).select(*ROW, "text")
    spans = repeated_spans(plain, span, most)
    lists = spans.groupBy(*ROW).agg(F.collect_list("low").alias("lows"), F.collect_list("high").alias("highs"))
    lists = lists.select(F.col("doc_id").alias("of"), F.col("text_id").alias("of_text"), "lows", "highs")
    joined = plain.join(lists, plain["doc_id"].eqNullSafe(lists["of"]) & (plain["text_id"] == lists["of_text"]), "left").select("doc_id", "text", "lows", "highs")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for text, lows, highs in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                data = text.encode()
                if not lows:
                    out.append((len(data), 0, 0, data))
                    continue
                edge = np.zeros(len(data) + 1, np.int64)
                np.add.at(edge, np.array(lows), 1)
                np.add.at(edge, np.array(highs) + span, -1)
                gone = np.cumsum(edge[:-1]) > 0
                runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                out.append((len(data), int(gone.sum()), runs, np.frombuffer(data, np.uint8)[~gone].tobytes()))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            columns = [pa.array([x[i] for x in out], kinds[i]) for i in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    kind = plain.select("doc_id").schema[0].dataType.simpleString()
    out = joined.mapInArrow(work, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
    return out.withColumnRenamed("doc_id", id_col)
