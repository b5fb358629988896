"""Batches of a map with a set-up of its own hold few bytes, however long the texts are."""

from pyspark.sql import functions as F

from rillspark.operators.rows import rich_map


def test_batches_end_at_a_size_in_bytes(spark):
    def make(index):
        return lambda frame: frame.assign(size=frame["text"].str.len().sum())[["id", "size"]]

    texts = spark.range(0, 120, 1, 1).select("id", F.repeat(F.lit("x"), 100_000).alias("text"))
    got = rich_map(texts, make, "id bigint, size bigint", batch_bytes=1 << 20).collect()
    assert len(got) == 120 and max(r["size"] for r in got) <= (1 << 20) + 100_000
