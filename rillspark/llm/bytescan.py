"""Vectorised scans over the UTF-8 bytes of Arrow string columns: polynomial hashes, words and shingles.

The hash of bytes [s, e) is the sum of code[b_i] * BASE^(i - s) modulo 2^64, taken from prefix sums, so any window costs
two reads. Arrays cover one piece of about ``PIECE`` bytes of whole texts, so memory does not grow with the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
CODE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
LOWER_CODE = CODE.copy()
LOWER_CODE[65:91] = CODE[97:123]
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scramble of 64-bit words, so that sums and leading bits of hashes look random."""
    x = x ^ np.uint64(seed)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """BASE^i and BASE^-i for i below the longest piece seen so far."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        while len(self.up) < n:
            k = np.uint64(len(self.up))
            for name, base in (("up", BASE), ("down", BASE_INVERSE)):
                old = getattr(self, name)
                step = np.uint64(pow(int(base), int(k), 1 << 64))
                setattr(self, name, np.concatenate([old, old * step]))


def pieces(column: pa.Array, size: int = PIECE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) for runs of whole texts that hold about ``size`` bytes; nulls are empty."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if column.null_count:
        lengths = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), 0)
        if lengths.sum() != offsets[-1] - offsets[0]:  # a null row may span bytes
            column = column.fill_null(b"")
            offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size)) - 1)
        last = min(last, len(column))
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def prefix_sums(data: np.ndarray, powers: Powers, code: np.ndarray = CODE) -> np.ndarray:
    powers.grow(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(code[data] * powers.up[: len(data)], out=sums[1:])
    return sums


def window_hash(sums: np.ndarray, powers: Powers, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return (sums[end] - sums[start]) * powers.down[start]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first byte and the end of every word, in order. ``data`` is not empty."""
    text = ~SPACE[data]
    begins, ends = text.copy(), text.copy()
    begins[1:] &= ~text[:-1]
    ends[:-1] &= ~text[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    begins[inner] |= text[inner]
    ends[inner - 1] |= text[inner - 1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def words(data: np.ndarray, offsets: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word, A-Z lower-cased, in order, and how many words each text has.

    Prefix sums are made for ``PIECE`` bytes at a time, so a very long text takes no more memory than its words need.
    """
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    start, end = word_spans(data, offsets)
    hashes, base = np.zeros(len(start), np.uint64), np.uint64(0)
    shift = np.zeros(len(start), np.uint64)
    for low in range(0, len(data), PIECE):
        sums = prefix_sums(data[low : low + PIECE], powers, LOWER_CODE)
        up, down = (np.uint64(pow(int(x), low, 1 << 64)) for x in (BASE, BASE_INVERSE))
        sums = sums * up + base
        base = sums[-1]
        a, b = np.searchsorted(start, [low, low + PIECE])
        hashes[a:b] -= sums[start[a:b] - low]
        shift[a:b] = powers.down[start[a:b] - low] * down
        a, b = np.searchsorted(end, [low + 1, low + PIECE + 1])
        hashes[a:b] += sums[end[a:b] - low]
    return mixed(hashes * shift), np.diff(np.searchsorted(start, offsets))


LOWER = np.arange(256, dtype=np.uint64)
LOWER[65:91] += 32


def word_hashes(data: np.ndarray, offsets: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Like ``words``, but keyed: a word's bytes are taken eight at a time and scrambled with their place and ``seed``.

    ``words`` is a polynomial modulo 2^64, under which some long words (that of ``abba...`` and its complement) agree
    whatever the base. Hashes of two seeds are independent, so what one takes for equal the other tells apart.
    """
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    start, end = word_spans(data, offsets)
    n = (end - start + 7) // 8
    first = np.cumsum(n) - n
    nth = np.arange(int(n.sum())) - np.repeat(first, n)
    place = np.repeat(start, n) + 8 * nth
    left = np.repeat(end, n) - place
    low = np.concatenate([LOWER[data], np.zeros(8, np.uint64)])
    eight = np.zeros(len(place), np.uint64)
    for i in range(8):
        eight |= np.where(left > i, low[place + i], np.uint64(0)) << np.uint64(8 * i)
    eight = mixed(mixed(eight, seed) + nth.astype(np.uint64) * BASE, seed + 1)
    sums = np.add.reduceat(eight, first) if len(first) else eight
    return mixed(sums + (end - start).astype(np.uint64) * BASE_INVERSE, seed + 2), np.diff(np.searchsorted(start, offsets))


def shingles(hashes: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's distinct runs of ``k`` words, ascending within a text, and how many each text has.

    A text of fewer words has its whole sequence as its one run; a text without words has none.
    """
    ends = np.cumsum(counts)
    starts = ends - counts
    n = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    out = np.zeros(int(n.sum()), np.uint64)
    at = np.cumsum(n) - n
    position = np.arange(len(out)) - np.repeat(at, n) + np.repeat(starts, n)
    length = np.repeat(np.minimum(counts, k), n)
    for i in range(k):
        has = length > i
        word = hashes[np.minimum(position + i, len(hashes) - 1)] if len(hashes) else out
        out = np.where(has, mixed(out + word, 0x51ED270B * (i + 1)), out)
    doc = np.repeat(np.arange(len(n)), n)
    for a, b in zip(at.tolist(), (at + n).tolist(), strict=True):
        out[a:b].sort()
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (doc[1:] != doc[:-1])
    return out[new], np.bincount(doc[new], minlength=len(n)).astype(np.int64)
