"""Sharding by fixed virtual slots.

Records hash into thousands of virtual slots, whose number never changes. Bytes are summed per slot, and a versioned
map gives each slot its shard. The map is a table in a shared folder. Version 0 deals the slots out in turn; a later
version is made from the last one that is stored, by moving slots from the fullest to the emptiest shards, and appended.
Only the map's rows (slots times versions) and the sums of slots reach the driver.
"""

from __future__ import annotations

import heapq
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillspark.llm.common import shared_dir, staged


@dataclass
class SlotMap:
    """Versions of a slot-to-shard map; ``edits`` says which slots each version moved, and where to."""

    shards: int
    slots: int
    versions: list[list[int]] = field(default_factory=list)

    def __post_init__(self) -> None:
        if not self.versions:
            self.versions.append([s % self.shards for s in range(self.slots)])

    def edits(self, version: int) -> dict[int, tuple[int, int]]:
        old, new = self.versions[version - 1], self.versions[version]
        return {s: (a, b) for s, (a, b) in enumerate(zip(old, new, strict=True)) if a != b}

    def rebalance(self, weight: list[int]) -> int:
        """Add a version whose shards weigh nearly the same; the slots that fit under the mean stay where they are."""
        now, mean = self.versions[-1], sum(weight) / self.shards
        load, moving = [0] * self.shards, []
        for s in sorted(range(self.slots), key=lambda s: (-weight[s], s)):
            if now[s] < self.shards and load[now[s]] + weight[s] <= mean:
                load[now[s]] += weight[s]
            else:
                moving.append(s)
        new, heap = list(now), [(x, k) for k, x in enumerate(load)]
        heapq.heapify(heap)
        for s in moving:
            x, k = heapq.heappop(heap)
            new[s] = k
            heapq.heappush(heap, (x + weight[s], k))
        self.versions.append(new)
        return len(self.versions) - 1

    def to_df(self, spark: SparkSession, first: int = 0) -> DataFrame:
        """The versions from ``first`` on."""
        rows = [(v, s, k) for v, m in enumerate(self.versions) if v >= first for s, k in enumerate(m)]
        return spark.createDataFrame(rows, "map_version int, virtual_slot int, shard int")

    def write(self, spark: SparkSession, path: str, first: int = 0) -> None:
        """Append the versions from ``first`` on to the table at ``path``; what is stored stays."""
        self.to_df(spark, first).coalesce(1).write.partitionBy("map_version").mode("append").parquet(path)

    @classmethod
    def read(cls, spark: SparkSession, path: str, shards: int) -> SlotMap:
        rows = spark.read.parquet(path).orderBy("map_version", "virtual_slot").collect()
        versions: list[list[int]] = [[] for _ in range(1 + max(r["map_version"] for r in rows))]
        for r in rows:
            versions[r["map_version"]].append(r["shard"])
        return cls(shards, len(versions[0]), versions)

    @classmethod
    def stored(cls, spark: SparkSession, path: str, shards: int, slots: int) -> SlotMap:
        """The map at ``path``, or a new one, stored there as version 0."""
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
            cls(shards, slots).write(spark, path)
        return cls.read(spark, path, shards)


def sized(docs: DataFrame, id_col: str, text_col: str, overhead: int) -> DataFrame:
    """(id, size, text_crc32, text_hash): UTF-8 bytes of the text plus ``overhead``; null text: no bytes, no group."""
    text, raw = F.col(text_col), F.encode(F.col(text_col), "UTF-8")
    return docs.select(
        id_col,
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + overhead).alias("size"),
        F.crc32(F.coalesce(raw, F.lit(b""))).alias("text_crc32"),
        F.when(text.isNull(), F.xxhash64(F.lit("null"), F.col(id_col))).otherwise(F.xxhash64(text)).alias("text_hash"),
    )


def shard(docs: DataFrame, shards: int = 24, slots: int = 8192, id_col: str = "doc_id", text_col: str = "text", overhead: int = 8, path: str | None = None) -> tuple[DataFrame, SlotMap]:
    """Give every row of ``docs`` a virtual slot, a shard and a place in it, so that the shards' bytes are near equal.

    The map is stored at ``path`` (a new folder of the shared one if none is given): a run starts from its last version
    and appends one. Rows with equal texts share a virtual slot and so a shard, but for texts whose copies weigh over half
    a shard: their number is under twice ``shards``, and their rows are salted over all slots by id. Returns (id, size,
    text_crc32, virtual_slot, map_version, shard, place) and the map. ``place`` counts from 0 without gaps within a shard:
    slots lie one after another; a slot of very many short rows is numbered in several tasks. Null ids, repeated rows and
    empty tables are allowed; a null text weighs ``overhead`` and is grouped with nothing.
    """
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/slot-map-{uuid.uuid4().hex}"
    rows = staged(sized(docs, id_col, text_col, overhead).withColumn("row", F.monotonically_increasing_id()), "sizes")
    whole = rows.agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).first()
    heavy = rows.groupBy("text_hash").agg(F.sum("size").alias("w")).where(F.col("w") > max(1, (whole["bytes"] or 0) / (2 * shards))).select("text_hash", F.lit(True).alias("heavy"))
    salted = F.when(F.col("heavy"), F.xxhash64("text_hash", id_col)).otherwise(F.col("text_hash"))
    rows = rows.join(F.broadcast(heavy), "text_hash", "left").withColumn("virtual_slot", F.pmod(salted, F.lit(slots)).cast("int"))
    rows = rows.select(id_col, "size", "text_crc32", "virtual_slot", "row")

    sums = rows.groupBy("virtual_slot").agg(F.sum("size").alias("w"), F.count("*").alias("n")).collect()  # a row per slot
    weight = [0] * slots
    for r in sums:
        weight[r["virtual_slot"]] = r["w"]
    slot_map = SlotMap.stored(spark, path, shards, slots)
    version = slot_map.rebalance(weight)
    slot_map.write(spark, path, version)

    # A slot has a part per thousandth of all rows, so all parts together are under 1,000 more than the slots.
    most = max(1, whole["rows"] // 1000)
    parts = spark.createDataFrame([(r["virtual_slot"], 1 + r["n"] // most) for r in sums], "virtual_slot int, parts long")
    rows = rows.join(F.broadcast(parts), "virtual_slot").withColumn("part", F.pmod("row", "parts"))
    base, start = [0] * shards, []
    for r in rows.groupBy("virtual_slot", "part").agg(F.count("*").alias("n")).orderBy("virtual_slot", "part").collect():
        k = slot_map.versions[version][r["virtual_slot"]]
        start.append((r["virtual_slot"], r["part"], version, k, base[k]))
        base[k] += r["n"]
    places = spark.createDataFrame(start, "virtual_slot int, part long, map_version int, shard int, base long")
    nth = F.row_number().over(Window.partitionBy("virtual_slot", "part").orderBy(id_col, "size", "text_crc32", "row"))
    out = rows.withColumn("nth", nth).join(F.broadcast(places), ["virtual_slot", "part"]).withColumn("place", F.col("base") + F.col("nth") - 1)
    return out.select(id_col, "size", "text_crc32", "virtual_slot", "map_version", "shard", "place"), slot_map
