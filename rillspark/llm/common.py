"""Helpers that the operators share: tables in the shared folder, joins that survive hot groups, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A separator of words: a space or one of the five control characters from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's checkpoint folder; a new local one in local mode alone."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(path or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later jobs start from the files, whichever executor is lost."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Let Python tasks take few rows at a time: texts have no bounded length, so a batch's size is only held by its rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def stretches(text: Column, most: int, pieces: int = 10) -> Column:
    """A text of at most ``most`` characters as it is; of a longer one that many, in stretches spread evenly from its start to its end."""
    size = most // pieces
    start = lambda i: (i * (F.length(text) - size) / (pieces - 1)).cast("int") + 1
    return F.when(text.isNull() | (F.length(text) <= most), text).otherwise(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(pieces - 1)), lambda i: F.substring(text, start(i), F.lit(size))), "\n"))


def dropped(*tables: DataFrame) -> None:
    """Delete the files of staged tables that no later plan reads."""
    for df in tables:
        spark = df.sparkSession
        for name in df.inputFiles()[:1]:
            path = spark._jvm.org.apache.hadoop.fs.Path(name).getParent()
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def with_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, n_rows: int, share: float = 0.001) -> DataFrame:
    """Left join of ``rows`` to the one row of its group, by null-free ``keys``.

    Groups with over ``share`` of all rows number at most ``1 / share``, a bound that does not depend on the input, so
    they are broadcast and their rows stay where they are; all others are joined by a shuffle.
    """
    most = max(1, int(n_rows * share))
    hot, rest = groups.where(F.col(size) > most), groups.where(F.col(size) <= most)
    marks = F.broadcast(hot.select(*keys))
    return rows.join(F.broadcast(hot), keys, "inner").unionByName(rows.join(marks, keys, "left_anti").join(rest, keys, "left"))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (a, b): rows (node, component), the smallest node of each component.

    Alternates the two star steps of distributed label propagation: every node links its larger neighbours, then its
    smaller ones, to its smallest neighbour. Each step is written out; it ends when every edge leads straight to a root.
    """
    now = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(rounds):
        if stars_only(now):
            break
        sides = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = sides.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = sides.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        large = staged(large, "edges")
        dropped(now)
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        now = staged(small, "edges")
        dropped(large)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def stars_only(edges: DataFrame) -> bool:
    """Whether every node on the left has one edge, and none of them stands on the right."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("left")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("left")))
    nodes = ends.groupBy("node").agg(F.sum("left").alias("out"), F.min("left").alias("least"))
    return not nodes.where("out > 1 or (out > 0 and least = 0)").head(1)
