"""Operators of the training-data pipeline against SQL, brute force and hand-made cases."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rillspark.llm import bytescan, chat, embed_dedup, exact_dedup, licenses, minhash, mixing, packing, queries, sharding, suffix_dedup, toxicity
from rillspark.llm.common import components
from tests.oracle import assert_same

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, row long, digest string, score double, gone long, copy int"
A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls in every column, empty and blank texts, a very long one, ties, repeated rows and clashing column names."""
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("abcdeé"), rng.integers(2, 8)))
    long = " ".join(word() for _ in range(30_000))
    base = [word() for _ in range(300)]
    near = base.copy()
    near[17] = "other"
    texts = [" ".join(base), " ".join(near), " ".join(base).upper().replace("É", "é"), long, "", None, "  \n\t ", "one", "One", "x " * 2000, long[:3000], "start " + long[1000:2500], None, "two words"]
    rows = [(i, t, "en", f"s{i % 3}", None if t is None else len(t), 1, 2, "d", 0.5, 3, 4) for i, t in enumerate(texts)]
    rows += [(7, "one", None, None, None, None, None, None, None, None, None), (None, "no id", None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    assert_same(queries.queries()[name](spark, SF), queries.oracle_sql()[name], SF)


def ids(df, column="doc_id"):
    return sorted((r[column] is None, r[column]) for r in df.collect())


# 1: sharding


def test_shards_are_even_and_places_gapless(spark):
    out = queries.op1_shard(spark, SF).toPandas()
    load = out.groupby("shard")["size"].sum().reindex(range(24), fill_value=0)
    assert load.max() - load.mean() <= out["size"].max()
    assert all(sorted(g) == list(range(len(g))) for _, g in out.groupby("shard")["slot"])
    texts = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    assert all(zlib.crc32(texts[r.doc_id].encode()) == r.text_crc32 and len(texts[r.doc_id].encode()) + 8 == r.size for r in out.itertuples())


def test_sharding_edge_cases(docs, none):
    rows, _ = sharding.shard(docs, shards=4, slots=64)
    got = rows.collect()
    assert len(got) == docs.count() and {r["size"] for r in got if r["text_crc32"] == 0} == {8}
    assert sharding.shard(none)[0].count() == 0


def test_a_hot_text_is_salted_and_others_stay_together(spark):
    df = spark.createDataFrame([(i, "hot" * 50 if i % 3 == 0 else f"t{i // 6}") for i in range(3000)], "doc_id long, text string")
    rows, slot_map = sharding.shard(df, shards=5, slots=512)
    load = rows.groupBy("shard").agg(F.sum("size").alias("w")).toPandas()["w"]
    assert load.max() / load.mean() < 1.02
    cold = rows.join(df, "doc_id").where("text not like 'hot%'").groupBy("text").agg(F.count_distinct("shard").alias("n"))
    assert cold.where("n > 1").count() == 0
    assert len(slot_map.versions) == 2 and slot_map.edits(1)


def test_slot_map_is_stored_and_continued(spark, tmp_path):
    path = str(tmp_path / "map")
    df = spark.createDataFrame([(i, "x" * (i % 50)) for i in range(4000)], "doc_id long, text string")
    _, one = sharding.shard(df, shards=3, slots=64, path=path)
    more = df.unionByName(spark.createDataFrame([(9000 + i, "y" * 90 + str(i)) for i in range(500)], "doc_id long, text string"))
    rows, two = sharding.shard(more, shards=3, slots=64, path=path)
    assert len(one.versions) == 2 and len(two.versions) == 3 and two.versions[:2] == one.versions
    assert sharding.SlotMap.read(spark, path, 3).versions == two.versions and 0 < len(two.edits(2)) < 64
    assert {r["map_version"] for r in rows.select("map_version").distinct().collect()} == {2}


def test_a_slot_of_many_short_rows_is_numbered_without_gaps(spark):
    df = spark.createDataFrame([(i, "" if i % 3 == 0 else f"text {i} " * 20) for i in range(9000)], "doc_id long, text string")
    out = sharding.shard(df, shards=4, slots=128)[0].toPandas()
    assert all(sorted(g) == list(range(len(g))) for _, g in out.groupby("shard")["place"]) and len(out) == 9000
    assert out[out["text_crc32"] == 0]["shard"].nunique() == 1


def test_shards_equal_brute_force(spark):
    """Slots, sums, map and places worked out again in plain Python."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows, slot_map = sharding.shard(docs, shards=5, slots=256)
    got = rows.toPandas()
    load = np.zeros(256, int)
    np.add.at(load, got["virtual_slot"], got["size"])
    again = sharding.SlotMap(5, 256)
    again.rebalance(load.tolist())
    assert again.versions == slot_map.versions and (got["shard"] == [again.versions[1][v] for v in got["virtual_slot"]]).all()
    texts = dict(docs.select("doc_id", "text").collect())
    assert got.assign(text=got["doc_id"].map(texts)).groupby("text")["virtual_slot"].nunique().max() == 1
    ends = {k: 0 for k in range(5)}
    for (_, k), g in got.groupby(["virtual_slot", "shard"]):
        assert sorted(g["place"]) == list(range(ends[k], ends[k] + len(g)))
        ends[k] += len(g)


# 2: embeddings


def test_embedding_edge_cases(spark):
    v = [1.0, 2.0, 3.0]
    data = [(1, v), (2, [x * 5 for x in v]), (3, v), (4, None), (5, [0.0, 0.0, 0.0]), (6, [float("nan"), 1.0, 1.0]), (7, [None, 1.0, 1.0]), (8, []), (9, [1.0, 2.0]), (10, [-1.0, -2.0, -3.0]), (11, [float("inf"), 0.0, 0.0]), (3, v)]
    out = embed_dedup.embedding_groups(spark.createDataFrame(data, "vec_id long, embedding array<float>"))
    got = {(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in out.collect()}
    assert got == {(1, 3, 1, True), (2, 3, 1, False), (3, 3, 1, False)} | {(i, 0, i, True) for i in (4, 5, 6, 7, 8, 9, 10, 11)}
    assert embed_dedup.embedding_groups(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_embedding_links_equal_brute_force_at_the_threshold(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(150, 32))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    noise = rng.normal(size=base.shape) / np.sqrt(32)
    x = np.concatenate([base, base + noise * rng.uniform(0.3, 0.6, (150, 1)), np.repeat(base[:1], 80, axis=0) + rng.normal(size=(80, 32)) * 0.05]).astype(np.float32)
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "vec_id long, embedding array<float>")
    out = embed_dedup.embedding_groups(df.withColumn("node", F.lit(1)).withColumn("weight", F.lit("x")), block=64, window=20).orderBy("vec_id").toPandas()
    assert (out["n_links"].to_numpy() <= near.sum(axis=1)).all()
    assert out["n_links"].sum() >= 0.995 * near.sum()


def test_compared_vectors_hardly_grow_with_the_table():
    per_vector = {n: embed_dedup.calibrated(n, 0.9, 0.9998, 256, 32)[0] * 256 for n in (10**5, 10**6, 10**7, 10**8, 10**10)}
    assert per_vector[10**8] < 8 * per_vector[10**5] and per_vector[10**10] < 20 * per_vector[10**5]


# 3: repeated bytes


def removed(texts, span):
    counts = Counter(t[i : i + span] for t in texts for i in range(len(t) - span + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - span + 1):
            if counts[t[i : i + span]] > 1:
                gone[i : i + span] = b"\1" * span
        out.append((sum(gone), len(re.findall(b"\1+", bytes(gone))), bytes(x for x, g in zip(t, gone) if not g)))
    return out


@pytest.mark.parametrize("most", [256, 1])
def test_repeats_equal_brute_force(spark, docs, most):
    rng = np.random.default_rng(5)
    pieces = ["".join(rng.choice(list("abcdé "), int(n))) for n in rng.integers(100, 700, 12)]
    texts = ["".join(pieces[int(k)] for k in rng.integers(0, 12, int(rng.integers(1, 6)))) for _ in range(60)] + ["a" * 1500, "ab" * 500, "", "q"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffix_dedup.remove_repeats(df, most=most).collect()}
    want = removed([t.encode() for t in texts], 400)
    assert [got[i] for i in range(len(texts))] == want


def test_repeats_in_very_long_texts_equal_brute_force(spark, monkeypatch):
    """A text in many parts: repeats within it, across its parts' borders and in another text."""
    monkeypatch.setattr(bytescan, "PIECE", 3000)
    rng = np.random.default_rng(8)
    draw = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    one = draw(900)
    texts = [draw(5000) + one + draw(4000) + one[100:800] + draw(9000), draw(200) + one[:700] + draw(50), one[:399], draw(20_000)]
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffix_dedup.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(4)] == removed([t.encode() for t in texts], 400)


@pytest.mark.parametrize("n", [80, 320])
def test_lines_of_a_crowded_bucket_are_bounded_by_its_rows(spark, monkeypatch, n):
    """One passage of 390 bytes in every text, in every third with ten bytes more: its buckets are crowded in the larger table."""
    rng = np.random.default_rng(11)
    draw = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    passage, after = draw(390), draw(10)
    texts = [draw(150) + passage + (after if i % 3 == 0 else "") + draw(150) for i in range(n)]
    made, stage = {}, suffix_dedup.staged

    def counted(df, name):
        out = stage(df, name)
        made.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(suffix_dedup, "staged", counted)
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffix_dedup.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), most=256).collect()}
    assert [got[i] for i in range(n)] == removed([t.encode() for t in texts], 400)
    assert all(lines <= 4 * made["anchors"][0] for name in made for lines in made[name])
    assert n == 80 or len(made["parts"]) > 1


def test_cover_ranks_are_in_byte_order():
    rng = np.random.default_rng(4)
    data = np.frombuffer(b"".join([bytes(rng.integers(97, 99, 300, dtype=np.uint8))] * 3) + bytes(rng.integers(97, 100, 900, dtype=np.uint8)), np.uint8)
    cover, _ = suffix_dedup.difference_cover()
    ranks, long = suffix_dedup.cover_ranks(data, 327, cover)
    raw = data.tobytes()
    some = range(0, len(data) - 400)
    assert [raw[i : i + 73] for i in sorted(some, key=lambda i: (ranks[i], raw[i : i + 73]))] == sorted(raw[i : i + 73] for i in some)
    places = [i for i in some if i % 73 in cover]
    assert all((raw[i : i + 327] < raw[j : j + 327]) == (long[i] < long[j]) for i in places[::5] for j in places[::3])


def test_repeats_edge_cases(docs, none):
    got = suffix_dedup.remove_repeats(docs).collect()
    assert len(got) == docs.count() and all(r["n_bytes"] - r["n_removed"] == len(r["kept"]) for r in got)
    assert {r["n_bytes"] for r in got if r["doc_id"] in (4, 5)} == {0}
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_difference_cover_has_a_shift_for_every_pair():
    cover, table = suffix_dedup.difference_cover()
    a, b = np.meshgrid(np.arange(73), np.arange(73), indexing="ij")
    assert len(cover) == 10 and np.isin((a + table) % 73, cover).all() and np.isin((b + table) % 73, cover).all()


# 4: packing


def test_packing_round_trip(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    out = queries.packed(docs).toPandas()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in docs.where("doc_id is not null and doc_id <> 7").select("doc_id", "text").collect():
        want = np.array(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [2], "<u4")
        mine = out[out["doc_id"] == r["doc_id"]].sort_values("piece")
        assert mine["length"].sum() == len(want) and (mine["length"][1:] == 1024).all()
        assert [zlib.crc32(want[s : s + n].tobytes()) for s, n in zip(mine["start"], mine["length"])] == mine["ids_crc32"].tolist()
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert g["length"].sum() <= 1024 and g["offset"].tolist() == [0, *g["length"].cumsum()[:-1]]
    assert len(out[out["doc_id"] == 7]) == 2


def test_packing_white_space_and_empty(spark, none):
    import public_tokenizers
    import tiktoken

    texts = ["a  b", " \n b", "a\n\n  c ", "tab\t\tx", "end  ", "<|endoftext|> x", "I'll  be  there"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    got = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in packing.token_pieces(df, ranks, public_tokenizers.PATTERN).collect()}
    import base64

    merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks, "rb"))}
    whole = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})
    assert [got[i] for i in range(len(texts))] == [[*whole.encode_ordinary(t), 2] for t in texts]
    assert queries.packed(none).count() == 0


def test_added_tokens_inside_texts_are_those_of_tokenizers(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    mark = "<|endoftext|>"
    texts = [f"a {mark} b", mark, f"{mark}{mark} x", f"a  {mark}  b", f"é\n\n{mark}\n\nc ", f"x{mark}y", "<|endoftext|", f"<|{mark}|>", "<|ENDOFTEXT|>", f"{mark} w" * 900, "plain  text", "a" + " " * 1_000_000 + "b  c", "\n" * 60_000, f"x{mark}" + "\t" * 70_000 + "y"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = queries.packed(df).toPandas()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, text in enumerate(texts):
        want = np.array(tokenizer.encode(text, add_special_tokens=False).ids + [2], "<u4")
        mine = out[out["doc_id"] == i].sort_values("piece")
        assert mine["length"].sum() == len(want)
        assert [zlib.crc32(want[s : s + n].tobytes()) for s, n in zip(mine["start"], mine["length"])] == mine["ids_crc32"].tolist()


def test_evolution_never_gets_worse_and_meets_the_bound():
    rng = np.random.default_rng(2)
    lengths = np.sort(rng.integers(1, 1024, 600))[::-1].astype(np.int64)
    best = packing.evolved(lengths, [], 1024, 3, 4, 10)
    again = packing.evolved(lengths, [best.bins], 1024, 4, 4, 10)
    assert best.fill.max() <= 1024 and best.fill.sum() == lengths.sum()
    assert -(-lengths.sum() // 1024) <= len(again.fill) <= len(best.fill) <= 1.02 * lengths.sum() / 1024 + 1
    a, b = best, packing.evolved(lengths, [], 1024, 8, 1, 0)
    child = packing.crossed(a, b, lengths, 1024, rng)
    assert len(child.bins) == 600 and child.fill.max() <= 1024 and child.fill.sum() == lengths.sum()


def least_bins(lengths, capacity):
    """By trying all ways: the fewest sequences that hold all items."""
    best = [len(lengths)]

    def put(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(lengths):
            best[0] = len(rooms)
            return
        for i in range(len(rooms)):
            if rooms[i] >= lengths[k] and rooms[i] not in rooms[:i]:
                put(k + 1, [*rooms[:i], rooms[i] - lengths[k], *rooms[i + 1 :]])
        put(k + 1, [*rooms, capacity - lengths[k]])

    put(0, [])
    return best[0]


def test_packing_meets_small_exact_optima(spark):
    """Of 25 packings of eleven items at most one may need one sequence more than the exact optimum."""
    rng, over = np.random.default_rng(12), 0
    for _ in range(25):
        lengths = np.sort(rng.integers(120, 700, 11))[::-1].astype(np.int64)
        over += len(packing.evolved(lengths, [], 1024, 2, 4, 40).fill) - least_bins(lengths.tolist(), 1024)
    assert 0 <= over <= 1
    pieces = spark.createDataFrame([(i, int(x)) for i, x in enumerate(lengths)], "doc_id long, length long")
    assert packing.pack(pieces).select("sequence_id").distinct().count() == least_bins(lengths.tolist(), 1024)


# 5: licences


def test_licences_are_found_and_unknown_text_is_not():
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefghij"), rng.integers(2, 8)))
    unknown = [" ".join(word() for _ in range(30)) for _ in range(300)] + ["the driver has a license to drive this car and may use it"]
    scanner = licenses.fit(unknown)
    texts = ["Released under the MIT License.", "x\nThis work is licensed under the GNU General Public License, version 3.\ny", "Licensed under CC BY-NC 4.0.", unknown[3], "", None, "we like the mit campus and apache helicopters", " ".join(unknown[:80]) + " Licensed under the Apache License, Version 2.0."]
    found = [x[0] for x in scanner.scan(pa.array(texts, pa.string()), bytescan.Powers())]
    assert found[:4] == [["mit"], ["gpl"], ["cc-by-nc"], []] and found[4:7] == [[], [], []] and found[7] == ["apache"]


def test_inline_notices_are_confirmed():
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefghij"), rng.integers(2, 8)))
    unknown = [" ".join(word() for _ in range(30)) for _ in range(300)]
    scanner = licenses.fit(unknown)
    texts = ["This code is licensed under the MIT License, see LICENSE", "Project licensed under CC BY 4.0", " ".join(unknown[1].split()[:12]) + " (Licensed under CC BY-NC 4.0); see there", "the license of a driver, see there"]
    found = [x[0] for x in scanner.scan(pa.array(texts, pa.string()), bytescan.Powers())]
    assert found == [["mit"], ["cc-by"], ["cc-by-nc"], []]


def test_licence_edge_cases(docs, none):
    out = licenses.licences(docs, licenses.train(docs)).collect()
    assert len(out) == docs.count() and all(r["families"] == [] for r in out)
    assert licenses.licences(none, licenses.train(none)).count() == 0


# 6: toxicity


def test_toxicity_on_held_out_rows(spark):
    rng = np.random.default_rng(6)
    common = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(400)]
    bad = ["zorkil", "qwumpf", "vexxor"]

    def text(toxic):
        words = list(rng.choice(common, int(rng.integers(20, 120))))
        if toxic:
            for _ in range(3):
                words[int(rng.integers(len(words)))] = str(rng.choice(bad)) + str(rng.choice(["", "s", "ish"]))
        return " ".join(words)

    toxic = np.arange(300) % 4 == 0
    texts = [text(t) for t in toxic]
    net = toxicity.fit(texts[:200], toxic[:200])
    score = toxicity.sigmoid(net.text_logits(pa.array(texts[200:]), bytescan.Powers()))
    assert ((score >= 0.5) == toxic[200:]).mean() >= 0.97


def test_toxicity_gradients_are_right():
    rng = np.random.default_rng(0)
    net = toxicity.Network.new(np.zeros(toxicity.BUCKETS, np.float32), np.zeros(toxicity.BUCKETS, np.float32), 1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = rng.normal(size=(9, 3 + toxicity.LEARNT)).astype(np.float32)
    ids = rng.integers(0, 9, (4, toxicity.WINDOW))
    mask = np.ones_like(ids, bool)
    mask[1, 5:] = False
    slope, trace = np.array([0.3, -0.2, 0.5, 0.1]), []
    net.forward(x, ids, mask, trace)
    g, _ = net.gradients(x, ids, mask, slope, trace)
    for name in ("in_ahead", "state_back", "bias_back", "look", "look_at", "out"):
        flat, i = net.p[name].reshape(-1), 3
        old, loss = flat[i], []
        for step in (1e-2, -1e-2):
            flat[i] = old + step
            loss.append(float(slope @ net.forward(x, ids, mask)))
        flat[i] = old
        assert abs((loss[0] - loss[1]) / 2e-2 - g[name].reshape(-1)[i]) < 2e-3


def test_toxicity_edge_cases(spark, docs, none):
    labels = spark.createDataFrame([(0, 1), (1, 0), (3, 0), (None, 1), (5, None), (10, 1), (4, 0), (7, 0), (7, 1)], "doc_id long, toxic int")
    for df in (docs, none):
        model = toxicity.train(docs, labels)
        scores = [r[0] for r in df.select(toxicity.toxicity(model, F.col("text"))).collect()]
        assert len(scores) == df.count() and all(0 <= s <= 1 for s in scores)
    assert toxicity.train(docs, labels.where("false")) == 0.0


def test_windows_cover_every_word():
    counts = np.array([0, 1, 32, 33, 100])
    text, begin = toxicity.windows(counts)
    start = np.cumsum(counts) - counts
    for t, n in enumerate(counts):
        seen = {w for b in begin[text == t] for w in range(b, min(b + toxicity.WINDOW, start[t] + n))}
        assert seen == set(range(start[t], start[t] + n))


# 7: mixing


def test_targets_fill_up(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 100)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(sizes, [5, 2, 1], 1.5, 2).collect()}
    assert got["a"] == 20 and got[None] == 200 and got["b"] <= 2000 and abs(sum(got.values()) - 1.5 * 2110) < 1e-6
    assert abs(got["b"] / got["c"] - 2) < 1e-9 or got["b"] == 2000


def test_mix_is_cut_where_the_running_total_meets_the_budget(spark):
    mixed = mixing.mix(spark.read.parquet(f"{SF}/documents.parquet")).toPandas()
    mixed = mixed.sort_values("total", kind="stable")
    assert (mixed["finish"].diff().dropna() >= -1e-12).all() and mixed["total"].iloc[-1] == mixed["size"].sum()
    budget = sum(int(t) for t in mixed.drop_duplicates("source")["target"])
    assert mixed["taken"].sum() == budget
    assert (mixed[mixed["finish"] <= 1 - 1e-9]["taken"] == mixed[mixed["finish"] <= 1 - 1e-9]["size"]).mean() > 0.99
    late = mixed[mixed["total"] > budget]
    assert (late["taken"] > 0).sum() <= mixed["source"].nunique()


def test_mix_edge_cases(docs, none):
    for spans in (1, 1024):
        rows = mixing.taken_per_document(mixing.mix(docs, spans=spans)).collect()
        assert len(rows) == docs.count() and all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    words = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in mixed.collect())
    assert words == sum(r["taken"] for r in rows)
    assert mixing.taken_per_document(mixing.mix(none)).count() == 0 and mixing.mixed_documents(none).count() == 0


# 8: chat


def test_levels_of_chains_and_cycles(spark):
    data = [(f"c{i}", f"c{i - 1}" if i else None) for i in range(40)] + [("x", "y"), ("y", "x"), ("self", "self"), ("below", "x"), ("lone", "gone")]
    df = spark.createDataFrame(data, "call_id string, depends_on string")
    got = {r["call_id"]: r["level"] for r in chat.topological_levels(df).collect()}
    assert [got[f"c{i}"] for i in range(40)] == list(range(40)) and got["lone"] == 0 and all(got[c] is None for c in ("x", "y", "self", "below"))


def test_validation_and_canonical_json(spark):
    schema = {"t": {"b": {"type": "integer", "least": 1}, "a": {"type": "string", "optional": True, "most": 3}}}
    calls = [(1, 1, "i1", "t", '{"b": 2, "a" : "x"}', None), (1, 2, "i2", "t", '{"a":"long text"}', "i1"), (1, 3, "i3", "u", "[1]", None), (1, 4, "i4", "t", "nothing", None), (1, 5, None, "t", "{}", None), (1, 1, "i1", "t", '{"b": 2, "a" : "x"}', None), (1, 6, "i5", "t", '{"b":"2"}', None)]
    results = [(1, 2, "i1", 'say "é"'), (1, 9, "i9", "late")]
    out = chat.linked_calls(spark.createDataFrame(calls, "conv_id long, turn long, call_id string, name string, arguments string, depends_on string"), spark.createDataFrame(results, "conv_id long, turn long, call_id string, content string"), schema)
    got = {r["call_id"]: r for r in out.collect()}
    assert got["i1"]["json"] == '{"arguments":{"a":"x","b":2},"id":"i1","name":"t","result":"say \\"é\\"","status":"linked","valid":true}'
    assert got["i2"]["errors"] == "b: missing; a: too large" and got["i2"]["level"] == 1
    assert got["i3"]["errors"].startswith("unknown tool; no object") and got["i4"]["errors"].startswith("no object")
    assert got["i5"]["errors"] == "b: type" and got["i9"]["status"] == "orphan" and got["i1"]["copies"] == 2
    assert got[None]["status"] == "nameless call" and got["i1"]["result_copies"] == 1 and len(got) == 7


def test_chat_edge_cases(spark):
    data = [(1, 0, "user", None), (1, 1, "assistant", "a"), (1, 1, "assistant", "b"), (None, 0, "user", "x"), (2, None, "user", "y"), (3, 0, None, "z"), (4, 0, "user", ""), (5, 1, "assistant", None)]
    messages = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    out = chat.linked_calls(*chat.turn_calls(messages), queries.SCHEMAS).collect()
    assert {(r["conv_id"], r["status"]) for r in out} == {(1, "linked"), (4, "open"), (5, "orphan")}
    assert chat.linked_calls(*chat.turn_calls(messages.where("false")), queries.SCHEMAS).count() == 0


# 9: MinHash


def brute_components(texts, k, percent):
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(A_Z))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    label = {i: i for i in texts}
    changed = True
    while changed:
        changed = False
        for a in texts:
            for b in texts:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return label, {i: len(s) for i, s in sets.items()}


@pytest.mark.parametrize("k, percent", [(3, 85), (5, 80)])
def test_near_groups_equal_brute_force(spark, docs, k, percent):
    rng = np.random.default_rng(9)
    base = [[f"w{x}" for x in rng.integers(0, 5000, int(n))] for n in rng.integers(2, 120, 10)]
    texts = {}
    for i in range(120):
        words = list(base[i % 10])
        for _ in range(int(rng.integers(0, 4))):
            words[int(rng.integers(len(words)))] = "changed" + str(rng.integers(5))
        texts[i] = " ".join(words)
    texts |= {200: None, 201: "", 202: "single", 203: "Single"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    label, n = brute_components(texts, k, percent)
    got = {r["doc_id"]: r for r in minhash.near_groups(df, k, percent).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == label
    assert {i: r["n_shingles"] for i, r in got.items()} == n and all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_look_alikes_find_their_one_partner(spark):
    """400 texts of one template lie below the threshold to all others but one, which just passes it."""
    words = lambda name, n: [f"{name}x{i}" for i in range(n)]
    same = words("t", 240)
    texts = {i: " ".join(same + words(f"p{i // 2}", 8) + words(f"o{i}", 25)) for i in range(400)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_groups(df, 5, 80).collect()}
    assert got == {i: i - i % 2 for i in texts}


@pytest.mark.parametrize("kind", ["long", "string"])
def test_copies_without_their_original_equal_brute_force(spark, kind):
    """900 texts of one template with three words of 140 replaced: most lie below the threshold to any one hub."""
    rng = np.random.default_rng(3)
    texts = {}
    for i in range(900):
        words = [f"w{x}" for x in range(140)]
        for at in rng.choice(140, 3, replace=False):
            words[at] = f"r{rng.integers(1 << 30)}"
        texts[i if kind == "long" else f"d{i:04d}"] = " ".join(words)
    number: dict[tuple, int] = {}
    has = np.zeros((900, 900 * 10 + 140), np.float32)
    for i, text in enumerate(texts.values()):
        w = text.split()
        has[i, [number.setdefault(tuple(w[j : j + 3]), len(number)) for j in range(138)]] = 1
    both, size = has @ has.T, has.sum(axis=1)
    near = 100 * both >= 85 * (size[:, None] + size[None, :] - both)
    label = np.arange(900)
    while (new := np.where(near, label[None, :], 900).min(axis=1)).tolist() != label.tolist():
        label = new
    assert 200 < (label != np.arange(900)).sum() < 800
    ids = list(texts)
    df = spark.createDataFrame(list(texts.items()), f"doc_id {kind}, text string")
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_groups(df, 3, 85).collect()}
    assert got == {ids[i]: ids[k] for i, k in enumerate(label.tolist())}


def test_cells_of_many_parts_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(minhash, "CELL", 16)
    rng = np.random.default_rng(5)
    texts = {i: " ".join(f"w{x}" if rng.random() > 0.02 else f"r{i}x{x}" for x in range(100)) for i in range(150)}
    label, _ = brute_components(texts, 3, 85)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_groups(df, 3, 85).collect()} == label


def test_rows_that_share_or_lack_an_id_lose_only_near_copies(spark):
    a, b = (" ".join(f"{name}{i}" for i in range(40)) for name in "ab")
    data = [(1, a), (1, b), (2, a + " x"), (4, "lone text here"), (None, "c d e f"), (None, "C d  e f"), (None, None), (3, ""), (3, " ")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    kept = [(r["doc_id"], r["text"]) for r in minhash.near_dedup(df, 3, 85).collect()]
    assert [(1, a) in kept, (1, b) in kept].count(True) == 1  # rows of one id are one node, of which one row stays
    assert (2, a + " x") not in kept and (4, "lone text here") in kept and (None, None) in kept and (3, "") in kept and (3, " ") in kept
    assert len([t for i, t in kept if i is None and t]) == 1


def test_words_of_long_texts_are_hashed_in_pieces(monkeypatch):
    text = ("Ab c  déf " * 3000 + "x" * 5000 + " end").encode()
    data, offsets = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    whole = bytescan.words(data, offsets, bytescan.Powers())
    monkeypatch.setattr(bytescan, "PIECE", 997)
    parts = bytescan.words(data, offsets, bytescan.Powers())
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all() and len(np.unique(whole[0])) == 5


def test_near_edge_cases(docs, none):
    out = minhash.near_groups(docs)
    assert out.count() == docs.count()
    got = {r["doc_id"]: r["component_id"] for r in out.collect()}
    assert got[1] == 0 and got[2] == 0 and got[5] == 5 and got[8] == 7
    kept = minhash.near_dedup(docs)
    assert kept.columns == docs.columns and {1, 2, 8}.isdisjoint(r["doc_id"] for r in kept.collect())
    assert minhash.near_groups(none).count() == 0


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 200), (200, 150), (300, 300)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(31)) and got[200] == got[150] == 100 and 300 not in got


# 10: exact copies


def test_exact_edge_cases(docs, none):
    for keep, pick in (("largest", max), ("smallest", min)):
        groups = {}
        for r in docs.select("doc_id", "text").collect():
            groups.setdefault(hashlib.sha256((r["text"] or "").translate(A_Z).encode()).hexdigest(), []).append(r["doc_id"])
        out = exact_dedup.exact_groups(docs, keep=keep, fan_in=2).collect()
        assert len(out) == docs.count()
        for r in out:
            known = [x for x in groups[r["text_sha256"]] if x is not None]
            assert r["group_size"] == len(groups[r["text_sha256"]]) and r["keep_id"] == (pick(known) if known else None)
        assert sum(r["kept"] for r in out) == len(groups)
        kept = exact_dedup.exact_dedup(docs, keep=keep)
        assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exact_dedup.exact_groups(none).count() == 0 and exact_dedup.exact_dedup(none).count() == 0


# The pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = set(r["doc_id"] for r in docs.select("doc_id").collect())
    for name, stage in corpus_pipeline.STAGES[:-1]:
        from rillspark.llm.common import staged

        now = staged(stage(spark, docs, SF), "stage")
        assert now.columns == docs.columns, name
        kept = set(r["doc_id"] for r in now.select("doc_id").collect())
        assert kept and kept <= seen, name
        docs, seen = now, kept
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert out.where("length > 1024").count() == 0 and out.select("doc_id").distinct().count() == len(seen)


@pytest.mark.parametrize("at", range(5))
def test_pipeline_stages_take_odd_rows_and_empty_tables(spark, docs, none, at):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows and columns with clashing names."""
    import corpus_pipeline

    name, stage = corpus_pipeline.STAGES[at]
    more = docs.withColumns({"hub": F.lit(1), "part": F.lit("p"), "run": F.lit(2), "gone id": F.lit(3), "toxicity": F.lit(0.1), "finish": F.lit(1.0), "sequence_id": F.lit(9), "length": F.lit(7)})
    for df in (docs, more):
        out = stage(spark, df, SF)
        rows = out.collect()
        if name == "best-fit packing":
            assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in df.select("doc_id").collect()}
            continue
        assert out.columns == df.columns, name
        texts = {r["text"] for r in rows}
        whole = {r["text"] for r in df.select("text").collect()}
        assert name == "mixing to target weights" or texts <= whole
        assert name == "mixing to target weights" or "two words" in texts
    assert stage(spark, none, SF).count() == 0


def test_pipeline_keeps_clean_documents(spark):
    from corpus_pipeline import drop_copies, drop_near_copies

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one = drop_copies(spark, docs, SF)
    texts = docs.select(F.lower("text")).distinct().count()
    assert texts <= one.count() <= docs.count()
    groups = minhash.near_groups(one, 5, 80)
    assert drop_near_copies(spark, one, SF).count() == groups.where("kept").count()
