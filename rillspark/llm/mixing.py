"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled; a document that may be taken several times stands in line once per pass. As in fair
queueing, what is served is packets: a document of up to ``PACKET`` words is one, a longer one several, in order. A
packet's virtual finish time is its source's cumulative words up to its end divided by the source's target; a document's is
that of its last packet. All packets are sorted by finish time in ranges, the ranges' words are added up, and the line
is cut where the running total meets the budget: what stands before the cut is taken, the packet at it in part, nothing
behind it. So a source ends within about one packet of its target.

Cumulative sums never meet in one task: a source's line is split into ``spans`` ranges of the shuffle key, the ranges'
sums are added up first, and rows are only counted within a range. The global sum over finish times goes the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillspark.llm.common import WORD, staged

#: The most words that are served at once.
PACKET = 128


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: list[float], budget: float, most: float, source_col: str = "source") -> DataFrame:
    """(source, source_size, weight, target) from (source, source_size), one row per source.

    Sources by code point, null last, take ``weights`` in turn and share ``budget`` times all sizes; a target stops at
    ``most`` times its source's size, and what it leaves is shared again by weight. The rank and the sums come from
    windows over the table of sources, which has a row per source and none per document.
    """
    everything = Window.orderBy(F.col(source_col).asc_nulls_last())
    ranked = sizes.withColumn("rank", F.row_number().over(everything) - 1)
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = staged(ranked.withColumn("weight", F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int"))), "sources")
    total = budget * (ranked.agg(F.sum("source_size")).first()[0] or 0)
    level, capped = 0.0, F.lit(False)
    while True:
        sums = ranked.agg(F.sum(F.when(capped, F.col("source_size") * most)), F.sum(F.when(~capped, F.col("weight")))).first()
        new = (total - (sums[0] or 0)) / sums[1] if sums[1] else level
        if new <= level:
            break
        level, capped = new, F.col("source_size") * most <= new * F.col("weight")
    return ranked.select(source_col, "source_size", "weight", F.least(F.col("source_size") * most, F.lit(level) * F.col("weight")).cast("double").alias("target"))


def mix(docs: DataFrame, weights: list[float] = (5, 2, 1), budget: float = 1.5, passes: int = 2, spans: int = 1024, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """One row per document and pass: (id, source, pass, size, source_size, target, finish, total, taken).

    ``taken`` words of the document are taken in that pass: those of its packets that stand before the cut. ``total``
    counts the words up to the document's last packet in order of finish. Sources with a null name mix as one
    source; texts without words take part with size 0; the order is that of md5(id:pass), so reruns agree; repeated ids
    are told apart by size alone, which leaves sums alike. A source's line has at least ``spans`` ranges, and more so
    that none has over about 65,536 documents. A very long text is many packets. Other columns play no part. An empty
    table gives an empty one.
    """
    rows = docs.select(F.col(id_col), F.col(source_col), word_count(F.col(text_col)).alias("size"))
    rows = staged(rows, "word-counts")
    spans = max(spans, rows.count() >> 16)
    wanted = staged(targets(rows.groupBy(source_col).agg(F.sum("size").alias("source_size")), list(weights), budget, passes, source_col), "targets")
    words_wanted = wanted.agg(F.sum(F.floor("target"))).first()[0] or 0
    wanted = wanted.withColumnRenamed(source_col, "of")

    line = rows.withColumn("pass", F.explode(F.array(*[F.lit(k) for k in range(passes)])))
    key = F.md5(F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.col("pass").cast("string")))
    span = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * spans / F.lit(1 << 32)).cast("int")
    line = line.withColumn("key", key).withColumn("span", span)
    place = ["pass", "span"]
    sums = line.groupBy(source_col, *place).agg(F.sum("size").alias("words"))
    before = Window.partitionBy(source_col).orderBy(*place).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("base", F.coalesce(F.sum("words").over(before), F.lit(0))).drop("words")
    sums = sums.join(wanted, sums[source_col].eqNullSafe(wanted["of"])).drop("of").withColumnRenamed(source_col, "of")

    within = Window.partitionBy(source_col, *place).orderBy("key", "size").rowsBetween(Window.unboundedPreceding, 0)
    line = line.withColumn("upto", F.sum("size").over(within)).withColumn("nth", F.row_number().over(within.rowsBetween(Window.unboundedPreceding, 0)))
    line = line.join(sums, line[source_col].eqNullSafe(sums["of"]) & (line["pass"] == sums["pass"]) & (line["span"] == sums["span"])).drop(sums["pass"]).drop(sums["span"])
    begin = F.col("base") + F.col("upto") - F.col("size")
    packets = F.sequence(F.lit(0), F.greatest(F.floor((F.col("size") - 1) / PACKET), F.lit(0)).cast("int"))
    whole = [id_col, source_col, *place, "nth", "key", "size", "source_size", "target", "weight"]
    line = line.select(*whole, begin.alias("begin"), F.explode(packets).alias("packet"))
    line = line.withColumn("words", F.least(F.col("size") - F.col("packet") * PACKET, F.lit(PACKET)))
    end = F.col("begin") + F.col("packet") * PACKET + F.col("words")
    line = line.withColumn("finish", F.coalesce(F.try_divide(end, "target"), F.lit(0.0))).drop("begin")

    order = ["finish", "key", "size", "packet"]
    line = staged(line.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("range", F.spark_partition_id()), "finish-order")
    ranges = line.groupBy("range").agg(F.sum("words").alias("sum"))  # a row per partition
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("range", F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("words before"))
    upto = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    line = line.withColumn("in range", F.sum("words").over(upto)).join(F.broadcast(ranges), "range")
    line = line.withColumn("total", F.col("words before") + F.col("in range"))
    taken = F.greatest(F.lit(0), F.least("words", F.lit(words_wanted) - (F.col("total") - F.col("words"))))
    out = line.withColumn("taken", taken).groupBy(*whole).agg(F.max("finish").alias("finish"), F.max("total").alias("total"), F.sum("taken").cast("long").alias("taken"))
    return out.select(id_col, source_col, "pass", "key", "size", "source_size", "target", "weight", "finish", "total", "taken")


def taken_per_document(mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, size, source_size, target, taken): each document's words over all passes. Repeated rows come out repeated.

    A document's passes are put together by its id; rows that share an id are told apart by size and source, or else by
    their order.
    """
    keys = [id_col, "size", "source_size", "target"]
    nth = Window.partitionBy(*keys, "pass").orderBy("taken")
    return mixed.withColumn("nth", F.row_number().over(nth)).groupBy(*keys, "nth").agg(F.sum("taken").alias("taken")).select(*keys, "taken")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **setting: object) -> DataFrame:
    """The rows of ``docs`` that the mix takes, with their columns: a document taken in two passes comes out twice.

    The one document at a source's cut keeps its first words up to the cut. Rows that share an id are matched by size.
    """
    takes = mix(docs, id_col=id_col, source_col=source_col, text_col=text_col, **setting)
    same = lambda size, *keys: Window.partitionBy(*keys).orderBy(size, source_col)
    takes = takes.withColumn("copy", F.row_number().over(same("size", id_col, "pass"))).where("taken > 0")
    takes = takes.select(F.col(id_col).alias("mixed id"), F.col("copy").alias("mixed nth"), F.col("taken").alias("words taken"))
    rows = docs.withColumn("words of text", word_count(F.col(text_col)))
    rows = rows.withColumn("nth of id", F.row_number().over(same("words of text", id_col)))
    out = rows.join(takes, rows[id_col].eqNullSafe(takes["mixed id"]) & (rows["nth of id"] == takes["mixed nth"]))
    starts = F.split(F.regexp_replace(text_col, r"^[\x20\x09-\x0D]+", ""), r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    first = F.rtrim(F.array_join(F.slice(starts, 1, F.col("words taken").cast("int")), ""))
    cut = F.when(F.col("words taken") < F.col("words of text"), first).otherwise(F.col(text_col))
    return out.withColumn(text_col, cut).select(*docs.columns)
