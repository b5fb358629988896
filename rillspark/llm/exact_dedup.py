"""Exact deduplication by a tree-merge of sorted digest runs.

Each partition makes one run: its digests in order, each once, with the identifier that stays and the number of rows.
Runs then exchange in rounds, as in a binomial tree, only with ``fan_in`` branches: in round r, runs whose numbers agree
above digit r meet, and are merged multiway. A round is one sort-based aggregation: every partition sorts and folds what
it holds, which is its run; the exchange deals the runs out by digest, so no task ever sees a whole run; the other side
merges the runs that it got and folds equal neighbours. The last round has one run, in sorted pieces. A text repeated in
a third of the rows arrives as one row per run.

Texts are hashed in the JVM. At every level digests only merge if length and checksum agree as well.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillspark.llm.common import dropped, staged, with_groups

KEYS = ["text_sha256", "n_bytes", "check"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """The text with A-Z lower-cased and nothing else; null is empty. Texts of ASCII alone take the fast way."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.coalesce(F.translate(text, UPPER, LOWER), F.lit("")))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_key, text_sha256, n_bytes, check, run) of every row; ``text_key`` tells texts of one id apart."""
    rows = docs.select(id_col, F.xxhash64(text_col).alias("text_key"), normalised(F.col(text_col)).alias("norm"), F.spark_partition_id().alias("run"))
    return rows.select(id_col, "text_key", F.sha2("norm", 256).alias("text_sha256"), F.octet_length("norm").alias("n_bytes"), F.crc32("norm").alias("check"), "run")


def merged_runs(runs: DataFrame, keep: str, n_runs: int, fan_in: int) -> DataFrame:
    """One row per digest: the kept struct ``best`` and the group's size. ``runs`` has KEYS, run and best, a row per row.

    The first round takes rows, so its partial aggregation makes the runs; later rounds take the runs of the one before.
    """
    pick = F.max if keep == "largest" else F.min
    now = runs.withColumn("group_size", F.lit(1).cast("long"))
    for _ in range(max(1, math.ceil(math.log(max(n_runs, 1), fan_in) - 1e-9))):
        now = now.withColumn("run", F.floor(F.col("run") / fan_in)).groupBy("run", *KEYS)
        now = now.agg(pick("best").alias("best"), F.sum("group_size").alias("group_size"))
    return now.drop("run")


def ranked_groups(docs: DataFrame, id_col: str, text_col: str, keep: str, fan_in: int) -> tuple[DataFrame, DataFrame]:
    """The staged rows (digests and row), and one row per group of equal texts (KEYS, best, group_size)."""
    rows = staged(digests(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "digests")
    n_runs = 1 + (rows.agg(F.max("run")).first()[0] or 0)
    lost = F.col(id_col).isNull()
    rank = F.struct(lost if keep == "smallest" else ~lost, F.col(id_col).alias("id"), F.col("text_key"), F.col("row"))
    return rows, staged(merged_runs(rows.withColumn("best", rank), keep, n_runs, fan_in), "digest-groups")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", fan_in: int = 8) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) for every row of ``docs``.

    Of rows with equal text, the one with the ``keep`` ("smallest" or "largest") id stays; of rows that repeat an id as
    well, one. Null ids lose to any other id. Null texts count as empty, and all empty texts are one group. A text of any
    length is hashed whole, in its row. Other columns play no part. An empty table gives an empty one.
    """
    rows, groups = ranked_groups(docs, id_col, text_col, keep, fan_in)
    out = with_groups(rows, groups, KEYS, "group_size", rows.count())
    return out.select(id_col, F.col("best.id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), "text_sha256")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", fan_in: int = 8) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. Rows equal in id and text come out once.

    The kept rows are found again by id and a hash of the text, so texts move once, and digests aren't made twice.
    """
    rows, groups = ranked_groups(docs, id_col, text_col, keep, fan_in)
    named = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))
    kept = staged(groups.select(named(F.col("best.id")).alias("id of row"), F.col("best.text_key").alias("text of row")), "kept")
    dropped(rows, groups)
    marked = docs.withColumn("id of row", named(F.col(id_col))).withColumn("text of row", F.xxhash64(text_col))
    keys = ["id of row", "text of row"]
    return marked.join(kept, keys, "left_semi").dropDuplicates(keys).select(*docs.columns)
