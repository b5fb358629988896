"""Licence scans: a trained paragraph classifier whose predictions a comparison with the family's templates confirms.

Paragraphs are lines; longer ones are read in overlapping windows. Word 1- and 2-grams are hashed into ``BUCKETS``
weights per family, so a window's evidence is a sum of table rows. The network of classes has one for unknown text; a
prediction counts if its calibrated probability passes a threshold set on unknown paragraphs that training never saw,
and if the window shares enough word 3-grams with a template of that family, punctuation around words left out.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillspark.llm import bytescan
from rillspark.llm.common import small_batches, stretches

BUCKETS, WINDOW, STRIDE = 1 << 15, 48, 24
EDGES = string.punctuation.encode()

# How the families are commonly announced.
TEMPLATES = {
    "apache": [
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Licensed under the Apache License, Version 2.0.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "This project is released under the Apache License 2.0.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Released under the BSD License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Licensed under the 3-Clause BSD License.",
    ],
    "cc-by": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "Available under the Creative Commons Attribution License.",
    ],
    "cc-by-nc": [
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
        "Licensed under the Creative Commons Attribution-NonCommercial-ShareAlike License, CC BY-NC-SA 4.0.",
    ],
    "cc-by-sa": [
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
        "Licensed under CC BY-SA 4.0.",
    ],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related rights to this work.", "Released under CC0 1.0 Universal, public domain dedication."],
    "gpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "This work is licensed under the GNU General Public License, version 3.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "Licensed under the GPL, version 2 or later.",
    ],
    "lgpl": ["This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License.", "Licensed under the GNU Lesser General Public License, version 3."],
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
        "Released under the MIT License.",
        "Licensed under the MIT License.",
    ],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, Version 2.0."],
    "proprietary": ["All rights reserved. No part of this publication may be reproduced without the prior written permission of the publisher.", "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited."],
}


def text_words(data: np.ndarray, offsets: np.ndarray, powers: bytescan.Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, words per paragraph, text of each paragraph) with paragraphs cut after line feeds."""
    cuts = np.unique(np.concatenate([offsets, np.flatnonzero(data == 10) + 1]))
    cuts = cuts if len(cuts) > 1 else offsets
    hashes, counts = bytescan.words(data, cuts, powers)
    return hashes, counts, np.searchsorted(offsets, cuts[:-1], side="right") - 1


def paragraph_windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(paragraph, first word, end) of every window; paragraphs without words have none."""
    n = np.where(counts > 0, np.maximum(0, -(-(counts - WINDOW) // STRIDE)) + 1, 0)
    paragraph = np.repeat(np.arange(len(counts)), n)
    k = np.arange(len(paragraph)) - np.repeat(np.cumsum(n) - n, n)
    base = (np.cumsum(counts) - counts)[paragraph]
    first = base + np.minimum(k * STRIDE, np.maximum(counts[paragraph] - WINDOW, 0))
    return paragraph, first, np.minimum(first + WINDOW, base + counts[paragraph])


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return bytescan.mixed(a * np.uint64(3) + b, 77)


@dataclass
class Scanner:
    families: list[str]
    weights: np.ndarray  # BUCKETS + 1 rows, the last is the bias; a column per family and one for unknown text
    temperature: float
    threshold: float
    shapes: list[list[set]]  # the 3-grams of plain words of each family's templates

    def evidence(self, hashes: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Calibrated class probabilities of word windows."""
        sums = np.zeros((len(hashes) + 1, self.weights.shape[1]))
        np.cumsum(self.weights[(hashes % np.uint64(BUCKETS)).astype(np.int64)], axis=0, out=sums[1:])
        twos = np.zeros_like(sums)
        if len(hashes) > 1:
            np.cumsum(self.weights[(pair_hash(hashes[:-1], hashes[1:]) % np.uint64(BUCKETS)).astype(np.int64)], axis=0, out=twos[1:-1])
            twos[-1] = twos[-2]
        scale = 1 / np.sqrt(np.maximum(2 * (end - first) - 1, 1))
        logits = (sums[end] - sums[first] + twos[end - 1] - twos[first]) * scale[:, None] + self.weights[-1]
        logits = logits / self.temperature
        logits = np.exp(logits - logits.max(axis=1, keepdims=True))
        return logits / logits.sum(axis=1, keepdims=True)

    def scan(self, column: pa.Array, powers: bytescan.Powers) -> list[tuple[list[str], float, int, int]]:
        """For each text: its families, the largest probability, paragraphs read and paragraphs matched."""
        out: list[tuple[list[str], float, int, int]] = []
        for _, data, offsets in bytescan.pieces(column):
            hashes, counts, owner = text_words(data, offsets, powers)
            paragraph, first, end = paragraph_windows(counts)
            spans = None
            hits: dict[int, list[tuple[int, int, float]]] = {}
            for a in range(0, len(first), 1 << 14):
                lo, hi = first[a : a + (1 << 14)], end[a : a + (1 << 14)]
                base, stop = int(lo.min()), int(hi.max())
                p = self.evidence(hashes[base:stop], lo - base, hi - base)
                best = p.argmax(axis=1)
                for i in np.flatnonzero((best < len(self.families)) & (p.max(axis=1) >= self.threshold)).tolist():
                    spans = bytescan.word_spans(data, offsets) if spans is None else spans
                    window = [data[s:e].tobytes() for s, e in zip(spans[0][lo[i] : hi[i]], spans[1][lo[i] : hi[i]], strict=True)]
                    if self.confirmed(window, int(best[i])):
                        hits.setdefault(int(owner[paragraph[a + i]]), []).append((int(paragraph[a + i]), int(best[i]), float(p[i, best[i]])))
            read = np.bincount(owner[counts > 0], minlength=len(offsets) - 1)
            for t in range(len(offsets) - 1):
                found = hits.get(t, [])
                out.append((sorted({self.families[f] for _, f, _ in found}), max((x for *_, x in found), default=0.0), int(read[t]), len({k for k, *_ in found})))
        return out

    def confirmed(self, window: list[bytes], family: int) -> bool:
        """Whether the window shares three 3-grams, or all but one of the few it has, with the family's templates.

        Half of the 3-grams of one template, two at least, are enough too: short templates have only three.
        """
        grams = plain_grams(window)
        shared = len(grams & set().union(*self.shapes[family]))
        if grams and shared >= min(3, max(1, len(grams) - 1)):
            return True
        return any(len(grams & t) >= max(2, -(-len(t) // 2)) for t in self.shapes[family])


def plain_grams(words: list[bytes]) -> set[tuple[bytes, ...]]:
    """The 3-grams of words in lower case without punctuation at their edges; words of nothing else are left out."""
    plain = [w for w in (word.lower().strip(EDGES) for word in words) if w]
    return set(zip(plain, plain[1:], plain[2:]))


def three_grams(words: np.ndarray) -> np.ndarray:
    return pair_hash(pair_hash(words[:-2], words[1:-1]), words[2:]) if len(words) > 2 else np.zeros(0, np.uint64)


def hashed_words(texts: list[str]) -> list[np.ndarray]:
    powers = bytescan.Powers()
    joined = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in joined])]).astype(np.int64)
    hashes, counts = bytescan.words(np.frombuffer(b"".join(joined), np.uint8), offsets, powers)
    return np.split(hashes, np.cumsum(counts)[:-1])


def fit(unknown: list[str], seed: int = 3, rounds: int = 150, rate: float = 0.5, decay: float = 1e-4, false_rate: float = 0.001) -> Scanner:
    """Train on cuts of the templates set in unknown text, and on unknown paragraphs; a fifth calibrates."""
    rng, families = np.random.default_rng(seed), sorted(TEMPLATES)
    shapes = [[plain_grams(t.encode().split()) for t in TEMPLATES[f]] for f in families]
    every = np.unique(np.concatenate([three_grams(w) for f in families for w in hashed_words(TEMPLATES[f])]))
    foreign = [w for w in hashed_words(unknown) if len(w) and not np.isin(three_grams(w), every).any()] if unknown else []
    rows, label = [w[:WINDOW] for w in foreign], [len(families)] * len(foreign)
    for f, family in enumerate(families):
        for words in hashed_words(TEMPLATES[family]):
            for _ in range(40):
                size = int(rng.integers(min(4, len(words)), len(words) + 1))
                at = int(rng.integers(0, len(words) - size + 1))
                part = words[at : at + size] if rng.random() < 0.6 else words
                if foreign and rng.random() < 0.5:
                    other = foreign[int(rng.integers(len(foreign)))]
                    cut = int(rng.integers(0, min(len(other), WINDOW - min(WINDOW, len(part))) + 1))
                    part = np.concatenate([other[:cut], part])
                rows.append(part[:WINDOW])
                label.append(f)
    label, held = np.array(label), rng.random(len(label)) < 0.2
    grams = [np.concatenate([w, pair_hash(w[:-1], w[1:])]) for w in rows]
    size = np.array([len(g) for g in grams])
    bucket = (np.concatenate(grams) % np.uint64(BUCKETS)).astype(np.int64)
    row = np.repeat(np.arange(len(rows)), size)
    value = np.repeat(1 / np.sqrt(size), size)
    used, dense = np.unique(bucket, return_inverse=True)
    classes = len(families) + 1
    w, b = np.zeros((len(used), classes)), np.zeros(classes)
    start = np.cumsum(size) - size
    truth = np.eye(classes)[label] * (~held)[:, None]
    importance = 1 / np.maximum(np.bincount(label, minlength=classes), 1)[label] * (~held)
    importance /= importance.sum()
    square = np.full_like(w, 1e-8)
    by_feature = np.argsort(dense, kind="stable")
    feature_start = np.searchsorted(dense[by_feature], np.arange(len(used)))

    def logits() -> np.ndarray:
        return np.add.reduceat(w[dense] * value[:, None], start, axis=0) + b

    for _ in range(rounds):
        z = logits()
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        slope = (p * (~held)[:, None] - truth) * importance[:, None]
        g = np.add.reduceat((slope[row] * value[:, None])[by_feature], feature_start, axis=0) + decay * w
        square += g * g
        w -= rate * g / np.sqrt(square)
        b -= rate * slope.sum(axis=0)
    z = logits()[held]
    best = (np.inf, 1.0)
    for temperature in np.geomspace(0.2, 5, 33):  # the likeliest on the part that training never saw
        q = z / temperature
        q -= np.log(np.exp(q - q.max(axis=1, keepdims=True)).sum(axis=1, keepdims=True)) + q.max(axis=1, keepdims=True)
        best = min(best, (-float(q[np.arange(len(q)), label[held]].mean()), float(temperature)))
    weights = np.zeros((BUCKETS + 1, classes))
    weights[used], weights[-1] = w, b
    p = np.exp(z / best[1] - (z / best[1]).max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    strange = np.sort(p[label[held] == len(families)][:, :-1].max(axis=1))
    threshold = max(0.5, float(strange[min(len(strange) - 1, int(len(strange) * (1 - false_rate)))])) if len(strange) else 0.5
    return Scanner(families, weights, best[1], min(threshold, 0.99), shapes)


def train(docs: DataFrame, most: int = 400, characters: int = 2_000_000, text_col: str = "text") -> Scanner:
    """Fit with the lines of at most ``most`` different texts, ``characters`` in all, as unknown text.

    They are the first by a hash of the text, so reruns agree; only they come to the driver. Of a text longer than a
    twentieth of all characters, stretches of that length take part, so no text's length leaves the others without room.
    """
    texts = docs.where(F.col(text_col).isNotNull()).select(F.xxhash64(text_col).alias("order"), F.least(F.length(text_col), F.lit(characters // 20)).alias("length"))
    line = Window.orderBy("order").rowsBetween(Window.unboundedPreceding, 0)
    first = texts.groupBy("order").agg(F.max("length").alias("length")).orderBy("order").limit(most)
    last = first.withColumn("upto", F.sum("length").over(line)).where(F.col("upto") <= characters).agg(F.max("order")).first()[0]
    some = docs.where(F.col(text_col).isNotNull()).select(stretches(F.col(text_col), characters // 20).alias(text_col), F.xxhash64(text_col).alias("order")).where(F.col("order") <= F.lit(last)).dropDuplicates(["order"]).orderBy("order").select(text_col)
    lines = [line for row in some.collect() for line in row[0].split("\n") if line.strip()]
    return fit(lines)


def licences(docs: DataFrame, scanner: Scanner, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, families, probability, n_paragraphs, n_matched) of every row; ``families`` is sorted, empty if none is found.

    Null and empty texts have no paragraphs. Every line of a text is read, however long; repeated rows repeat. Of equally
    likely families the first by name counts. Other columns play no part. An empty table gives an empty one.
    """
    small_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = bytescan.Powers()
        for batch in batches:
            found = scanner.scan(batch.column(1), powers)
            kinds = [pa.list_(pa.string()), pa.float64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[i] for x in found], k) for i, k in enumerate(kinds))], names=[id_col, "families", "probability", "n_paragraphs", "n_matched"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(work, f"{id_col} {kind}, families array<string>, probability double, n_paragraphs bigint, n_matched bigint")
