"""Benchmark decontamination by winnowing: documents that hold passages of benchmark items, word by word.

A window is ``span`` consecutive words of an item, or all words of a shorter item. Within every window of a text the
smallest hash of its k-grams is kept, once for a run of windows that share it. A window that stands in both texts keeps
the same hash in both, so each shared span of ``span`` words or more is found; nothing is sampled. Short windows take k
by their own length, so the guarantee holds down to items of one word.

Documents' prints meet the items' prints by a semi-join, so a print that is common on both sides makes no pairs. Only
runs of windows that were hit are extended: their words are compared with the items' windows in full. All of it is built
of SQL functions. Items' tables are staged, so Spark knows their size and broadcasts or shuffles them by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillspark.llm.common import dropped, staged
from rillspark.llm.exact_dedup import normalised

#: What lies between words once A-Z are lower-cased: all of ASCII but digits and a-z.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Words in order. A split costs a fifth of taking out all matches, whose every match copies the text."""
    return F.array_remove(F.split(normalised(text), BETWEEN), "")


def counted(n: Column) -> Column:
    """1 .. n; empty for n below 1."""
    return F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))


def windows(tokens: Column, n: Column) -> Column:
    """Every run of ``n`` words, as texts."""
    return F.transform(counted(F.size(tokens) - n + 1), lambda i: F.array_join(F.slice(tokens, i, n), " "))


def prints(hashes: Column, n: int) -> Column:
    """Of every window of ``n`` words the smallest hash of its k-grams, as runs of windows (n, print, first, last) that share it.

    ``hashes`` are those of the words; windows are numbered from 1 by their first word.
    """
    k = (n + 1) // 2
    w = n - k + 1
    grams = F.transform(counted(F.size(hashes) - k + 1), lambda i: F.xxhash64(*[F.element_at(hashes, i + j) for j in range(k)]))
    least = lambda g: F.transform(counted(F.size(g) - w + 1), lambda i: F.least(*[F.element_at(g, i + j) for j in range(w)]) if w > 1 else F.element_at(g, i))
    new = lambda m: F.filter(counted(F.size(m)), lambda i: (i == 1) | (F.get(m, i - 1) != F.get(m, i - 2)))
    run = lambda m, s: F.transform(s, lambda i, at: F.struct(F.lit(n).alias("n"), F.get(m, i - 1).alias("print"), i.alias("first"), F.coalesce(F.get(s, at + 1) - 1, F.size(m)).alias("last")))
    return let(grams, lambda g: let(least(g), lambda m: let(new(m), lambda s: run(m, s))))


def all_prints(tokens: Column, lengths: list[int]) -> Column:
    return let(F.transform(tokens, lambda w: F.xxhash64(w)), lambda h: F.concat(*[prints(h, n) for n in lengths]))


def item_windows(items: DataFrame, item: str, text: str, span: int) -> tuple[DataFrame, DataFrame, DataFrame, list[int]]:
    """(windows with a key of the set of items that hold them, the ids of each such set, prints), staged, and the windows' lengths.

    An item without words has no windows. Rows of one item count together; a null id takes part, but is no id.
    """
    rows = items.select(F.col(item).cast("string").alias("item"), words(F.col(text)).alias("words")).where(F.size("words") > 0)
    rows = staged(rows.withColumn("n", F.least(F.lit(span), F.size("words"))), "item-words")
    lengths = sorted(r["n"] for r in rows.select("n").distinct().collect())  # at most ``span`` numbers
    by_length = F.coalesce(*[F.when(F.col("n") == n, all_prints(F.col("words"), [n])) for n in lengths or [span]])
    known = staged(rows.select(F.explode(by_length).alias("p")).select("p.n", "p.print").distinct(), "item-prints")
    held = rows.select("item", "n", F.explode(windows(F.col("words"), F.col("n"))).alias("window"))
    sets = held.groupBy("n", "window").agg(F.array_sort(F.collect_set("item")).alias("items"))
    sets = staged(sets.withColumn("set", F.sha2(F.array_join("items", ","), 256)), "item-windows")
    return sets.select("n", "window", "set"), staged(sets.select("set", "items").distinct(), "item-sets"), known, lengths


def covered(runs: Column) -> Column:
    """How many places the runs (first, end) cover, ``end`` not included. They are sorted by ``first``."""
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("upto"))
    step = lambda a, r: F.struct((a["n"] + F.greatest(r["end"] - F.greatest(r["first"], a["upto"]), F.lit(0))).alias("n"), F.greatest(a["upto"], r["end"]).alias("upto"))
    return F.aggregate(runs, start, step, lambda a: a["n"])


def maybe(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """``rows`` without most of those whose ``key`` isn't ``wanted``, so that texts without hits don't move.

    It tests a bit of 2^23 by a hash of the key: a table of a megabyte at most, whatever is wanted. A join must follow.
    """
    slot = F.pmod(F.xxhash64(key), F.lit(1 << 23))
    bits = wanted.select(F.bitmap_bucket_number(slot).alias("bucket"), F.bitmap_bit_position(slot).alias("at")).groupBy("bucket").agg(F.bitmap_construct_agg("at").alias("bits"))
    at = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.substring("bits", (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    marked = rows.withColumn("bucket", F.bitmap_bucket_number(slot)).join(F.broadcast(bits), "bucket")
    return marked.where(F.call_function("shiftright", byte, at.bitwiseAND(F.lit(7)).cast("int")) % 2 == 1).drop("bucket", "bits")


def contamination(docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", span: int = 10) -> DataFrame:
    """``docs`` with n_words, n_hit (words inside any window of an item), n_items and items (ids as strings, ascending).

    Null and empty texts have no words and no hits. Equal texts are worked out once and all get the result; repeated rows
    stay. A very long text is one row of words, which moves only if it has hits. Without documents or items the result is
    empty or without hits. Other columns of ``docs`` pass through, whatever their names, but for those that are added.
    """
    sets, members, known, lengths = item_windows(items, item, item_text, span)
    text_key = F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("row"), text_key.alias("text key"), words(F.col(text)).alias("words"))
    of = lambda w: F.struct(F.size(w).cast("bigint").alias("n_words"), *([all_prints(w, lengths).alias("prints")] if lengths else []))
    lines = staged(keyed.select("row", "text key", let(F.col("words"), of).alias("t")).select("row", "text key", "t.*"), "document-prints")
    if not lengths:
        return lines.select("row.*", "n_words", F.lit(0).cast("bigint").alias("n_hit"), F.lit(0).cast("bigint").alias("n_items"), F.array().cast("array<string>").alias("items"))

    seen = lines.select("text key", F.explode("prints").alias("p")).select("text key", "p.*").join(known, ["n", "print"], "left_semi")
    runs = seen.groupBy("text key").agg(F.collect_set(F.struct("n", "first", "last")).alias("runs"))
    runs = staged(runs, "hit-runs")

    texts = maybe(docs.select(F.col(text).alias("text"), text_key.alias("text key")), runs, "text key")
    texts = texts.groupBy("text key").agg(F.any_value("text").alias("text")).join(runs, "text key")
    each = lambda w: F.flatten(F.transform("runs", lambda r: F.transform(F.sequence(r["first"], r["last"]), lambda i: F.struct(r["n"].alias("n"), i.alias("first"), F.array_join(F.slice(w, i, r["n"]), " ").alias("window")))))
    found = texts.select("text key", F.explode(let(words(F.col("text")), each)).alias("w")).select("text key", "w.*").join(sets, ["n", "window"])
    spans = found.groupBy("text key").agg(F.array_sort(F.collect_set(F.struct("first", (F.col("first") + F.col("n")).alias("end")))).alias("spans"), F.array_sort(F.collect_set("set")).alias("sets"))
    hits = staged(spans.select("text key", covered(F.col("spans")).alias("n_hit"), "sets", F.sha2(F.array_join("sets", ","), 256).alias("union")), "hits")

    unions = hits.select("union", "sets").distinct().select("union", F.explode("sets").alias("set")).join(members, "set")
    unions = unions.select("union", F.explode_outer("items").alias("item")).groupBy("union").agg(F.array_sort(F.collect_set("item")).alias("items"))
    result = lines.drop("prints").join(hits.drop("sets"), "text key", "left").join(staged(unions, "item-lists"), "union", "left")
    zero = F.lit(0).cast("bigint")
    dropped(runs, known)
    return result.select(
        "row.*", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce(F.size("items").cast("bigint"), zero).alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )
