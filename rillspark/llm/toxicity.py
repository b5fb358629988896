"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word enters as its own log-odds and those of its character 4-grams (the largest and the mean), both counted on the
training rows, and as a learnt vector. Windows of ``WINDOW`` words start every ``STRIDE`` words and cover the whole
text; a text scores as its most toxic window, and the network learns through that window alone. Words are hashed, so
the model has one size whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from rillspark.llm import bytescan
from rillspark.llm.common import small_batches, stretches

WINDOW, STRIDE = 32, 24
BUCKETS, VECTORS, LEARNT, HIDDEN, ATTENTION = 1 << 16, 1 << 12, 5, 8, 8
NGRAM = 4


def word_table(data: np.ndarray, offsets: np.ndarray, powers: bytescan.Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of a piece: (hash, of each token its word, tokens per text, gram buckets, where each word's grams start).

    A word of fewer than ``NGRAM`` bytes is its own gram.
    """
    hashes, counts = bytescan.words(data, offsets, powers)
    unique, first, token = np.unique(hashes, return_index=True, return_inverse=True)
    if not len(unique):
        return unique, token, counts, np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = ~bytescan.SPACE[data]
    begins, ends = text.copy(), text.copy()
    begins[1:] &= ~text[:-1]
    ends[:-1] &= ~text[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    begins[inner] |= text[inner]
    ends[inner - 1] |= text[inner - 1]
    start, end = np.flatnonzero(begins)[first], np.flatnonzero(ends)[first] + 1
    size = np.minimum(end - start, NGRAM)
    n = end - start - size + 1
    at = np.cumsum(n) - n
    place = np.arange(int(n.sum())) - np.repeat(at - start, n)
    sums = bytescan.prefix_sums(data, powers, bytescan.LOWER_CODE)
    grams = bytescan.mixed(bytescan.window_hash(sums, powers, place, place + np.repeat(size, n)), 21)
    return unique, token, counts, (grams % np.uint64(BUCKETS)).astype(np.int64), at


def windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, first token) of every window; the last window of a text ends with it. Texts without words have none."""
    n = np.where(counts > 0, np.maximum(0, -(-(counts - WINDOW) // STRIDE)) + 1, 0)
    text = np.repeat(np.arange(len(counts)), n)
    k = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    last = np.maximum(counts - WINDOW, 0)
    begin = np.cumsum(counts) - counts
    return text, begin[text] + np.minimum(k * STRIDE, last[text])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Network:
    word_odds: np.ndarray
    gram_odds: np.ndarray
    p: dict[str, np.ndarray]

    @classmethod
    def new(cls, word_odds: np.ndarray, gram_odds: np.ndarray, seed: int) -> Network:
        rng, size = np.random.default_rng(seed), 3 + LEARNT
        draw = lambda *shape: (rng.normal(0, 1, shape) / np.sqrt(shape[0])).astype(np.float32)
        p = {"vectors": 0.1 * draw(VECTORS, LEARNT)}
        for d in ("ahead", "back"):
            p |= {f"in_{d}": draw(size, 3 * HIDDEN), f"bias_{d}": np.zeros(3 * HIDDEN, np.float32), f"state_{d}": draw(HIDDEN, 3 * HIDDEN)}
        p |= {"look": draw(2 * HIDDEN, ATTENTION), "look_bias": np.zeros(ATTENTION, np.float32), "look_at": draw(ATTENTION), "out": draw(2 * HIDDEN), "out_bias": np.full(1, -1, np.float32)}
        return cls(word_odds, gram_odds, p)

    def inputs(self, unique: np.ndarray, grams: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The input of each distinct word, and a row of zeros for the place after a text's end."""
        x = np.zeros((len(unique) + 1, 3 + LEARNT), np.float32)
        if len(unique):
            odds = self.gram_odds[grams]
            x[:-1, 0] = self.word_odds[(unique % np.uint64(BUCKETS)).astype(np.int64)]
            x[:-1, 1] = np.maximum.reduceat(odds, at)
            x[:-1, 2] = np.add.reduceat(odds, at) / np.diff(np.r_[at, len(grams)])
            x[:-1, 3:] = self.p["vectors"][((unique >> np.uint64(20)) % np.uint64(VECTORS)).astype(np.int64)]
        return x

    def forward(self, x: np.ndarray, ids: np.ndarray, mask: np.ndarray | None, trace: list | None = None) -> np.ndarray:
        """The logit of each window: ``ids`` (windows, WINDOW) are rows of ``x``; ``mask`` marks real words."""
        p, n = self.p, len(ids)
        states = np.empty((n, WINDOW, 2 * HIDDEN), np.float32)
        for side, d in enumerate(("ahead", "back")):
            drive = x @ p[f"in_{d}"] + p[f"bias_{d}"]
            h = np.zeros((n, HIDDEN), np.float32)
            for t in range(WINDOW) if side == 0 else range(WINDOW - 1, -1, -1):
                a = drive[ids[:, t]]
                u = h @ p[f"state_{d}"]
                gates = sigmoid(a[:, : 2 * HIDDEN] + u[:, : 2 * HIDDEN])
                z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
                new = np.tanh(a[:, 2 * HIDDEN :] + r * u[:, 2 * HIDDEN :])
                old = h
                h = new + z * (old - new)
                if mask is not None:
                    h = np.where(mask[:, t, None], h, old)
                if trace is not None:
                    trace.append((d, t, old, u, z, r, new))
                states[:, t, side * HIDDEN : (side + 1) * HIDDEN] = h
        look = np.tanh(states.reshape(-1, 2 * HIDDEN) @ p["look"] + p["look_bias"])
        weight = (look @ p["look_at"]).reshape(n, WINDOW)
        if mask is not None:
            weight = np.where(mask, weight, -1e9)
        weight = np.exp(weight - weight.max(axis=1, keepdims=True))
        weight /= weight.sum(axis=1, keepdims=True)
        pooled = np.matmul(weight[:, None, :], states)[:, 0]
        if trace is not None:
            trace.append((states, look, weight, pooled))
        return pooled @ p["out"] + p["out_bias"][0]

    def gradients(self, x: np.ndarray, ids: np.ndarray, mask: np.ndarray, slope: np.ndarray, trace: list) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Of the parameters, and of each window's inputs, for the loss's ``slope`` by logit."""
        p, n = self.p, len(ids)
        states, look, weight, pooled = trace[-1]
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["out"], g["out_bias"][0] = pooled.T @ slope, slope.sum()
        pull = slope[:, None] * p["out"]
        by_weight = np.matmul(states, pull[:, :, None])[:, :, 0]
        by_score = weight * (by_weight - (weight * by_weight).sum(axis=1, keepdims=True))
        flat = by_score.reshape(-1)
        g["look_at"] = look.T @ flat
        by_look = flat[:, None] * p["look_at"] * (1 - look * look)
        g["look"], g["look_bias"] = states.reshape(-1, 2 * HIDDEN).T @ by_look, by_look.sum(axis=0)
        by_state = weight[:, :, None] * pull[:, None, :] + (by_look @ p["look"].T).reshape(n, WINDOW, 2 * HIDDEN)
        by_input = np.zeros((n, WINDOW, x.shape[1]), np.float32)
        carry = {"ahead": np.zeros((n, HIDDEN), np.float32), "back": np.zeros((n, HIDDEN), np.float32)}
        for d, t, old, u, z, r, new in reversed(trace[:-1]):
            part = slice(0, HIDDEN) if d == "ahead" else slice(HIDDEN, 2 * HIDDEN)
            real = mask[:, t, None]
            whole = by_state[:, t, part] + carry[d]
            by_h = np.where(real, whole, 0)
            by_new = by_h * (1 - z) * (1 - new * new)
            by_u = np.concatenate([by_h * (old - new) * z * (1 - z), by_new * u[:, 2 * HIDDEN :] * r * (1 - r), by_new], axis=1)
            g[f"in_{d}"] += x[ids[:, t]].T @ by_u
            g[f"bias_{d}"] += by_u.sum(axis=0)
            by_input[:, t] += by_u @ p[f"in_{d}"].T
            by_u[:, 2 * HIDDEN :] *= r
            g[f"state_{d}"] += old.T @ by_u
            carry[d] = by_h * z + by_u @ p[f"state_{d}"].T + np.where(real, 0, whole)
        return g, by_input

    def text_logits(self, column: pa.Array, powers: bytescan.Powers, block: int = 4096) -> np.ndarray:
        """The largest window logit of each text; of a text without words, the network's output for an empty pool."""
        out = np.full(len(column), self.p["out_bias"][0], np.float32)
        for first, data, offsets in bytescan.pieces(column):
            unique, token, counts, grams, at = word_table(data, offsets, powers)
            x = self.inputs(unique, grams, at)
            text, begin = windows(counts)
            best = np.full(len(counts), -np.inf, np.float32)
            for a in range(0, len(text), block):
                ids, mask = window_ids(token, counts, text[a : a + block], begin[a : a + block], len(unique))
                np.maximum.at(best, text[a : a + block], self.forward(x, ids, None if mask.all() else mask))
            has = counts > 0
            out[first : first + len(counts)][has] = best[has]
        return out


def window_ids(token: np.ndarray, counts: np.ndarray, text: np.ndarray, begin: np.ndarray, blank: int) -> tuple[np.ndarray, np.ndarray]:
    place = begin[:, None] + np.arange(WINDOW)
    mask = place < np.cumsum(counts)[text][:, None]
    return np.where(mask, token[np.minimum(place, len(token) - 1)], blank), mask


def log_odds(n: np.ndarray, t: np.ndarray, base: float, prior: float = 8.0) -> np.ndarray:
    """Smoothed log-odds of the label among the ``n`` texts that have a bucket, ``t`` of them toxic, against all texts."""
    share = (t + prior * base) / (n + prior)
    return (np.log(share / (1 - share)) - np.log(base / (1 - base))).astype(np.float32)


def counted(bucket: np.ndarray, text: np.ndarray, toxic: np.ndarray, fold: np.ndarray, n: np.ndarray, t: np.ndarray) -> None:
    """Add the texts of each bucket, once each, to ``n`` and the toxic ones to ``t``, by fold."""
    pairs = np.unique(bucket * len(toxic) + text)
    which, of = pairs // len(toxic), pairs % len(toxic)
    np.add.at(n, (fold[of], which), 1)
    np.add.at(t, (fold[of], which), toxic[of])


def runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The indices start[i] .. start[i] + size[i] - 1, one run after another."""
    return np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)


def fit(texts: list[str], toxic: np.ndarray, turns: int = 3, steps: int = 300, batch: int = 128, rate: float = 0.01, decay: float = 0.05, folds: int = 4, seed: int = 5) -> Network | float:
    """Train on labelled texts; with one class only, the share of toxic ones takes the network's place.

    A text's inputs come from odds counted without its fold, as they will for texts that training never saw.
    """
    toxic = np.asarray(toxic, np.float32)
    if not len(toxic) or toxic.min() == toxic.max():
        return float(toxic.mean()) if len(toxic) else 0.0
    powers = bytescan.Powers()
    fold = np.random.default_rng(seed).permutation(len(texts)) % folds
    word_n, word_t, gram_n, gram_t = (np.zeros((folds, BUCKETS)) for _ in range(4))
    parts, tokens, sizes, words_before, grams_before = [], [], [], 0, 0
    for first, data, offsets in bytescan.pieces(pa.array(texts, pa.string())):
        unique, token, counts, grams, at = word_table(data, offsets, powers)
        of = first + np.repeat(np.arange(len(counts)), counts)
        used = np.unique(token.astype(np.int64) * len(texts) + of)
        word, text = used // len(texts), used % len(texts)
        per_word = np.diff(np.r_[at, len(grams)])
        counted((unique[word] % np.uint64(BUCKETS)).astype(np.int64), text, toxic, fold, word_n, word_t)
        counted(grams[runs(at[word], per_word[word])], np.repeat(text, per_word[word]), toxic, fold, gram_n, gram_t)
        parts.append((unique, at + grams_before, per_word, grams.astype(np.int32)))
        tokens.append((token + words_before).astype(np.int32))
        sizes.append(counts)
        words_before, grams_before = words_before + len(unique), grams_before + len(grams)
    unique, where, again = np.unique(np.concatenate([x[0] for x in parts]), return_index=True, return_inverse=True)
    token, counts = again.astype(np.int32)[np.concatenate(tokens)], np.concatenate(sizes)
    start, per_word = (np.concatenate([x[i] for x in parts])[where] for i in (1, 2))
    grams, at = np.concatenate([x[3] for x in parts])[runs(start, per_word)], np.cumsum(per_word) - per_word
    of = np.repeat(np.arange(len(texts)), counts)
    base = min(max(float(toxic.mean()), 1e-3), 1 - 1e-3)
    without = [Network.new(log_odds(word_n.sum(0) - word_n[k], word_t.sum(0) - word_t[k], base), log_odds(gram_n.sum(0) - gram_n[k], gram_t.sum(0) - gram_t[k], base), seed) for k in range(folds)]
    del parts, tokens
    rows = len(unique) + 1
    fixed = np.empty((folds * rows, 3 + LEARNT), np.float32)
    for k, part in enumerate(without):
        fixed[k * rows : (k + 1) * rows] = part.inputs(unique, grams, at)
    net = Network.new(log_odds(word_n.sum(0), word_t.sum(0), base), log_odds(gram_n.sum(0), gram_t.sum(0), base), seed)
    text, begin = windows(counts)
    first_window = np.searchsorted(text, np.arange(len(texts) + 1))
    vector_of = np.r_[((unique >> np.uint64(20)) % np.uint64(VECTORS)).astype(np.int64), 0]
    mean, square = ({k: np.zeros_like(v) for k, v in net.p.items()} for _ in range(2))
    rng, step = np.random.default_rng(seed), 0
    order = np.flatnonzero(counts > 0)
    for turn in range(turns):
        for k in range(folds):
            fixed[k * rows : (k + 1) * rows - 1, 3:] = net.p["vectors"][vector_of[:-1]]
            fixed[(k + 1) * rows - 1, 3:] = 0
        if turn == 0:  # before the network knows anything, the window with the largest odds is the one to look at
            hot = fixed[:, :3].sum(axis=1)[token + fold[of] * rows]
            logit = np.array([hot[b : b + WINDOW].max() for b in begin.tolist()])
        else:
            logit = []
            for i in range(0, len(text), 1024):
                ids, mask = window_ids(token, counts, text[i : i + 1024], begin[i : i + 1024], len(unique))
                logit.append(net.forward(fixed, ids + fold[text[i : i + 1024], None] * rows, mask))
            logit = np.concatenate(logit)
        best = np.lexsort((-logit, text))[first_window[order]]
        for _ in range(steps // turns):
            half = rng.integers(0, len(order), batch // 2)
            toxic_half = rng.choice(np.flatnonzero(toxic[order] == 1), batch // 4)
            chosen = np.r_[best[half], best[toxic_half]]
            clean = order[rng.choice(np.flatnonzero(toxic[order] == 0), batch // 4)]
            chosen = np.r_[chosen, rng.integers(first_window[clean], first_window[clean + 1])]  # any window of a clean text is clean
            word_ids, mask = window_ids(token, counts, text[chosen], begin[chosen], len(unique))
            x = fixed[(word_ids + fold[text[chosen], None] * rows).ravel()]
            x[:, 3:] = np.where(mask.reshape(-1, 1), net.p["vectors"][vector_of[word_ids.ravel()]], 0)
            ids = np.arange(len(x)).reshape(-1, WINDOW)
            trace: list = []
            slope = (sigmoid(net.forward(x, ids, mask, trace)) - toxic[text[chosen]]) / len(chosen)
            g, by_input = net.gradients(x, ids, mask, slope.astype(np.float32), trace)
            np.add.at(g["vectors"], vector_of[word_ids][mask], by_input[:, :, 3:][mask])
            step += 1
            for k, v in net.p.items():
                mean[k] = 0.9 * mean[k] + 0.1 * g[k]
                square[k] = 0.999 * square[k] + 0.001 * g[k] ** 2
                pace = rate * (0.02 if k == "vectors" else 1)  # words are learnt slowly, or the network learns its texts by heart
                v -= (pace * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8) + rate * decay * v).astype(np.float32)
    return net


def train(docs: DataFrame, labels: DataFrame, most: int = 700, characters: int = 6_000_000) -> Network | float:
    """Fit on at most ``most`` toxic and 2 * ``most`` clean labelled texts, ``characters`` in all: a third of them toxic.

    Each class takes its first texts by a hash of the id, so reruns agree. Of a text longer than a thirtieth of all
    characters, stretches of that length take part; so each class has room for ten texts at least, whatever their length.
    Of rows that share an id one takes part. Labels with a null, and those of no document, are left out; of several labels
    of an id, toxic counts. The bounds hold whatever the corpus, so the texts may come to the driver, where it is fitted.
    Without labels of both kinds their share of toxic ones takes the network's place.
    """
    small_batches(docs.sparkSession)
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.join(docs.select("doc_id"), "doc_id", "left_semi")
    rank = F.md5(F.col("doc_id").cast("string"))
    some = known.where("toxic = 1").orderBy(rank, "doc_id").limit(most).unionByName(known.where("toxic = 0").orderBy(rank, "doc_id").limit(2 * most))
    cut = stretches(F.col("text"), characters // 30)
    rows = docs.select("doc_id", cut.alias("text")).join(F.broadcast(some), "doc_id")
    rows = rows.groupBy("doc_id", "toxic").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    line = Window.partitionBy("toxic").orderBy("rank", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("rank", rank).withColumn("upto", F.sum(F.coalesce(F.length("text"), F.lit(0))).over(line))
    share = F.when(F.col("toxic") == 1, characters // 3).otherwise(characters - characters // 3)
    rows = rows.where(F.col("upto") <= share).select("doc_id", "text", "toxic").toPandas().sort_values("doc_id", kind="stable")
    if rows["toxic"].nunique() == 1 and some.select("toxic").distinct().count() == 2:
        raise RuntimeError("the sample has labels of one kind, the documents have both")
    return fit(rows["text"].tolist(), rows["toxic"].to_numpy())


def toxicity(model: Network | float, text: Column) -> Column:
    """The score, 0 to 1, of a text column. Null and empty texts score as a text without words."""

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        powers = bytescan.Powers()
        for column in batches:
            if isinstance(model, float):
                yield pa.array(np.full(len(column), model))
            else:
                yield pa.array(sigmoid(model.text_logits(column, powers).astype(np.float64)))

    score.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(score, DoubleType())(text)
