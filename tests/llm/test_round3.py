"""Conversation repair, Merkle manifests and decontamination against brute force, with odd rows; fits that can't starve."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillspark.llm import bytescan, decontaminate, licenses, merkle, minhash, mixing, queries, repair, toxicity
from rillspark.llm.common import stretches

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


# 11: conversation repair

SPACE = " \t\n\x0b\x0c\r"
LEADS = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        mine = out.setdefault(conv, [])
        read = lambda v: " " if v is None else str(v)
        h = zlib.crc32(f"{read(conv)}:{read(turn)}".encode()) % 20
        role, text = read(role), read(text)
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        if h:
            mine += [(turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    return out


def cheapest(turns, fault):
    """(cost, audit, lines) by trying every edit at every place, whole audits compared."""

    @lru_cache(None)
    def go(i, state, inserted):
        best = (0, "", ()) if i == len(turns) and state in ("", "a") else None
        options = []
        if i < len(turns):
            _, role, text = turns[i]
            options.append((4, "D", (i + 1, state, 0), ()))
            if fault[i] in ("", "truncated"):
                more = 3 if fault[i] else 0
                if (state, role[:1]) in LEADS:
                    options.append((more, "K", (i + 1, LEADS[state, role[:1]], 0), (f"{role}:{text}",)))
                options += [(more + 3, "R", (i + 1, LEADS[state, r[0]], 0), (f"{r}:{text}",)) for r in ("user", "assistant") if (state, r[0]) in LEADS]
        if inserted < 4:
            options += [(3, "I", (i, LEADS[state, r[0]], inserted + 1), (f"{r}:",)) for r in ("user", "assistant") if (state, r[0]) in LEADS]
        for cost, letter, then, line in options:
            rest = go(*then)
            if rest is not None and (best is None or (cost + rest[0], letter + rest[1]) < best[:2]):
                best = (cost + rest[0], letter + rest[1], line + rest[2])
        return best

    return go(0, "", 0)


def repaired(rows):
    out = []
    for conv, turns in damage(rows).items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), hashlib.sha256(t[2].encode()).digest()))
        seen, fault = set(), []
        for _, role, text in turns:
            tail = text.strip(SPACE)
            fault.append("blank" if not tail else "duplicate" if (role, text) in seen else "truncated" if tail[-1] not in ".!?" else "")
            seen.add((role, text))
        known = [t for t, _, _ in turns if t is not None]
        bad = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        cost, audit, lines = cheapest(tuple(turns), tuple(fault))
        out.append((conv, max(known) - min(known) + 1 - len(set(known)) if known else 0, *(fault.count(f) for f in ("blank", "duplicate", "truncated")), bad, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


def in_order(rows):
    return sorted(rows, key=lambda r: [(v is None, str(v)) for v in r])


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_repair_equals_brute_force(spark):
    rng = random.Random(3)
    roles, texts = ["user", "assistant", "system", "tool", None, "", "user", "assistant"], ["Hi.", "so", "", "Yes! ", "ok?", " \t", None, "a.b", "x" * 5000 + " " * 5000 + "!"]
    rows = [(rng.choice([None, *range(1, 25)]), rng.choice([None, 0, 0, 1, 2, 3, 4, 5, 7, 9]), rng.choice(roles), rng.choice(texts)) for _ in range(300)]
    rows += rows[:20]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("copies", F.lit("clash")).withColumn("conv", F.lit(1))
    got = [tuple(r) for r in queries.damaged_repairs(table).select(*COLUMNS).collect()]
    assert in_order(got) == in_order(repaired(rows))
    assert queries.damaged_repairs(table.where("false")).count() == 0


def test_repair_of_the_given_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = [tuple(r) for r in queries.op11_repair(spark, SF).select(*COLUMNS).collect()]
    assert in_order(got) == in_order(repaired(rows))


def test_suffixes_are_made_once():
    known = repair.Suffixes()
    rng = random.Random(1)
    signatures = sorted({"".join(rng.choice("suaUA-01") for _ in range(rng.randint(0, 6))) + "uaua" for _ in range(500)}, key=lambda s: s[::-1])
    for s in signatures:
        known.read(s)
    assert known.count == len({s[i:] for s in signatures for i in range(len(s))})
    alone = {s: repair.Suffixes().read(s) for s in signatures}
    again = repair.Suffixes()
    assert all(again.read(s) == alone[s] for s in signatures)
    assert len(repair.Suffixes().read("ua" * 100_000)[1]) == 200_000


def test_a_conversation_with_most_rows(spark):
    rows = [(7, t, "user" if t % 2 == 0 else "assistant", "Same." if t % 3 else f"Line {t}.") for t in range(3000)] + [(c, 0, "user", "Hi.") for c in range(100)]
    got = queries.damaged_repairs(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    mine = got.where("conv_id = 7").first()
    turns = damage(rows)[7]
    assert len(mine["audit"].replace("I", "")) == len(turns) and mine["duplicate"] > 1000


# 12: Merkle manifest


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def proved(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, n: H(field(r[0]), field(r[3]), field(r[2]), field(n), field(r[1]))
    other = lambda r: leaf(r, r[4] + 1) if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 else leaf(r, r[4])
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4]), other(r)))
    trees = {g: levels([leaf(r, r[4]) for r in groups[g]]) for g in order}
    top, out = levels([trees[g][-1][0] for g in order]), []
    for k, g in enumerate(order):
        for i, r in enumerate(groups[g]):
            h, siblings = other(r), []
            for tree, place in ((trees[g], i), (top, k)):
                for level in tree[:-1]:
                    s = level[place ^ 1 : (place ^ 1) + 1]
                    siblings += s
                    h = H(*s, h) if place % 2 else H(h, *s)
                    place //= 2
            out.append((r[0], leaf(r, r[4]), trees[g][-1][0], top[-1][0], H(*siblings), h, h == top[-1][0]))
    return out


def merkle_rows(spark, table, tmp_path):
    table.write.parquet(f"{tmp_path}/documents.parquet")
    return [tuple(r) for r in queries.op12_merkle(spark, str(tmp_path)).collect()]


@pytest.mark.parametrize("n", [1, 2, 16, 17, 33, 300])
def test_merkle_equals_brute_force(spark, tmp_path, n):
    rng = random.Random(n)
    rows = [(rng.choice([None, *range(n)]), rng.choice(["a", "", None, "é" * 9, "x" * 50_000]), rng.choice(["en", "en", "en", "de", "", None, "ß"]), rng.choice(["web", None]), rng.choice([None, 1, 50])) for _ in range(n)]
    rows += rows[: n // 10]
    table = spark.createDataFrame(rows, DOC).withColumn("node", F.lit("clash")).withColumn("tree", F.lit(0))
    assert in_order(merkle_rows(spark, table, tmp_path)) == in_order(proved(rows))


def test_merkle_of_nothing(spark, tmp_path):
    assert merkle_rows(spark, spark.createDataFrame([], DOC), tmp_path) == []
    before = {c: spark.conf.get(c) for c in merkle.LIMITS}
    assert all(v != "-1" for v in before.values())


# 13: decontamination

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def hit(docs, items, span):
    words = lambda t: WORD.findall((t or "").translate(LOWER))
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(span, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for doc, text in docs:
        w, places, ids = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    places |= set(range(i, i + n))
                    ids |= windows[tuple(w[i : i + n])]
        ids = sorted(str(i) for i in ids - {None})
        out.append((doc, len(w), len(places), len(ids), ids))
    return out


@pytest.mark.parametrize("span", [1, 3, 10])
def test_decontamination_equals_brute_force(spark, span):
    rng = random.Random(span)
    some = lambda n: "".join(rng.choice(["a", "B", "c", "D", "é", "1"]) + rng.choice([" ", ", ", "-", "\n"]) for _ in range(n))
    items = [(rng.choice([None, *range(30)]), rng.choice([some(rng.randint(0, 14)), some(rng.randint(9, 40)), None, "", "!!"])) for _ in range(40)]
    docs = [(rng.choice([None, *range(60)]), rng.choice([some(rng.randint(0, 60)), (items[rng.randrange(40)][1] or "") + " x " + some(12), None, "", "..."])) for _ in range(80)]
    docs += [*docs[:5], (1000, some(20_000)), (1001, "Z" * 100_000)]
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumn("set", F.lit(1)).withColumn("window", F.lit("clash")).withColumn("text key", F.lit(2))
    got = decontaminate.contamination(table, spark.createDataFrame(items, "item_id long, text string"), span=span)
    assert got.columns[:4] == ["doc_id", "set", "window", "text key"]
    rows = [tuple(r) for r in got.select("doc_id", "n_words", "n_hit", "n_items", "items").collect()]
    assert in_order(rows) == in_order(hit(docs, items, span))


def test_decontamination_of_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[1:] for r in decontaminate.contamination(docs, items).collect()] == [(2, 0, 0, [])]
    assert decontaminate.contamination(docs.where("false"), spark.createDataFrame([(1, "a b")], items.schema)).count() == 0


def test_a_passage_that_most_texts_share(spark):
    """A third of all texts, and of all items, hold one passage: prints, windows and item lists make no pairs."""
    shared = " ".join(f"w{i}" for i in range(12))
    docs = [(i, f"{shared} d{i}" if i % 3 == 0 else f"other text {i}") for i in range(3000)]
    items = [(i, f"{shared} q{i}" if i % 3 == 0 else " ".join(f"i{i}x{k}" for k in range(11))) for i in range(300)]
    got = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    rows = got.groupBy("n_hit", "n_items").agg(F.count("*").alias("n")).collect()
    assert {tuple(r) for r in rows} == {(12, 100, 1000), (0, 0, 2000)}


# Fits that a text's length can't starve


def labelled(spark, texts, toxic):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return docs, spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int")


def words_of(rng, bad):
    return " ".join([*(rng.choice(["sun", "sea", "tree", "road", "hill", "rain"]) for _ in range(20)), *(["vile", "awful"] if bad else [])])


def test_a_giant_text_leaves_room_for_others(spark):
    rng = random.Random(5)
    toxic = [int(i % 2 == 0) for i in range(40)]
    texts = [words_of(rng, t) for t in toxic]
    first = min(range(40), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
    texts[first] = texts[first] * 400
    docs, labels = labelled(spark, texts, toxic)
    net = toxicity.train(docs, labels, characters=10_000)
    assert isinstance(net, toxicity.Network)
    scanner = licenses.train(docs, characters=10_000)
    assert scanner.threshold >= 0.5 and len(licenses.licences(docs, scanner).collect()) == 40


def test_an_id_that_repeats_is_one_text(spark):
    rng = random.Random(6)
    docs, labels = labelled(spark, [words_of(rng, i % 2) for i in range(30)], [i % 2 for i in range(30)])
    many = docs.unionByName(spark.range(10_000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("sun sea "), F.col("id").cast("string")).alias("text")))
    assert isinstance(toxicity.train(many, labels, most=5), toxicity.Network)


def test_stretches_reach_both_ends(spark):
    got = spark.createDataFrame([("a" * 500 + "b" * 500,), ("short",), (None,)], "t string").select(stretches(F.col("t"), 100).alias("s"), "t").collect()
    assert got[0]["s"].replace("\n", "").startswith("a" * 40) and got[0]["s"].endswith("b" * 10) and len(got[0]["s"].replace("\n", "")) == 100
    assert got[1]["s"] == "short" and got[2]["s"] is None


# 7: the order of finish decides what is taken


def served(rows, wanted, order):
    """{(doc, pass): words} of a line of packets in ``order``, cut at the sum of all targets."""
    line, upto = [], {}
    keyed = [(hashlib.md5(f"{d}:{p}".encode()).hexdigest(), d, s, n, p) for d, s, n in rows for p in (0, 1)]
    for key, doc, source, size, turn in sorted(keyed, key=lambda r: (r[4], int(r[0][:8], 16), r[0], r[3])):
        for k in range(max(1, -(-size // mixing.PACKET))):
            n = min(size - k * mixing.PACKET, mixing.PACKET)
            upto[source] = upto.get(source, 0) + n
            line.append((upto[source] / wanted[source] if wanted[source] else 0.0, key, size, k, n, doc, turn))
    left, out = sum(int(t) for t in wanted.values()), {}
    for _, _, _, _, n, doc, turn in sorted(line, key=order):
        out[doc, turn] = out.get((doc, turn), 0) + min(n, left)
        left -= min(n, left)
    return out


def test_the_order_of_finish_decides(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice("aaaabbc"), rng.choice([0, 1, 30, 127, 128, 129, 700])) for i in range(200)]
    docs = spark.createDataFrame([(i, s, "w " * n) for i, s, n in rows], "doc_id long, source string, text string")
    got = mixing.mix(docs, spans=16).collect()
    wanted = {r["source"]: r["target"] for r in got}
    taken = {(r["doc_id"], r["pass"]): r["taken"] for r in got}
    assert taken == served(rows, wanted, lambda p: p[:4])
    assert taken != served(rows, wanted, lambda p: p[1:4]) and taken != served(rows, wanted, lambda p: (-p[0], *p[1:4]))
    for s in "abc":
        assert abs(sum(r["taken"] for r in got if r["source"] == s) - wanted[s]) <= 2 * mixing.PACKET


# 9: words that a polynomial modulo 2^64 takes for equal


def test_words_that_collide_under_a_polynomial(spark):
    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    rows = [(1, word), (2, other), (3, f"x y {word} z"), (4, f"x y {other} z"), (5, other.upper())]
    got = minhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), k=3, percent=85)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 2}


def test_keyed_hashes_tell_lengths_and_places_apart():
    texts = ["abcdefgh", "abcdefghabcdefgh", "a", "aa", "hgfedcba", "abcdefghi", "iabcdefgh", "b" * 17, "b" * 16, "A"]
    data, offsets = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *map(len, texts)])
    hashes, counts = bytescan.word_hashes(data, offsets, 5)
    assert counts.tolist() == [1] * 10 and len(set(hashes.tolist())) == 9 and hashes[2] == hashes[9]
    assert not set(hashes.tolist()) & set(bytescan.word_hashes(data, offsets, 6)[0].tolist())
    assert bytescan.word_hashes(data[:0], np.zeros(3, int), 5)[1].tolist() == [0, 0]
