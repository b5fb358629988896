"""Generated rows: literals, sequences, functions of an index, random tables and key patterns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def collection(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def sequence(spark: SparkSession, first: int, last: int) -> DataFrame:
    return spark.range(first, last + 1)


def generated(spark: SparkSession, count: int, record: Callable[[Column], dict[str, Column]]) -> DataFrame:
    """``count`` rows, each a record made from its index by column expressions."""
    return spark.range(count).select(*[c.alias(name) for name, c in record(F.col("id")).items()])


def generated_stream(spark: SparkSession, rows_per_second: int, record: Callable[[Column], dict[str, Column]]) -> DataFrame:
    rows = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    return rows.select("timestamp", *[c.alias(name) for name, c in record(F.col("value")).items()])


def per_batch_stream(spark: SparkSession, rows_per_batch: int, record: Callable[[Column], dict[str, Column]]) -> DataFrame:
    """A fixed number of rows for each micro-batch, and so for each checkpoint."""
    rows = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", rows_per_batch).load()
    return rows.select("timestamp", *[c.alias(name) for name, c in record(F.col("value")).items()])


def datagen_table(spark: SparkSession, name: str, count: int, fields: dict[str, tuple], seed: int = 42) -> DataFrame:
    """A table of ("sequence", first, last) and ("random", least, most) fields, both ends included, as a view."""
    columns = []
    for i, (field, (kind, low, high)) in enumerate(fields.items()):
        if kind == "sequence":
            columns.append((F.col("id") % (high - low + 1) + low).alias(field))
        else:
            columns.append((F.floor(F.rand(seed + i) * (high - low + 1)) + low).alias(field))
    rows = spark.range(count).select(*columns)
    rows.createOrReplaceTempView(name)
    return rows


def key_of_mode(index: Column, mode: str, per_batch: int, most: int) -> Column:
    """A key for each index: always the same one, one more in each batch, or as many as rise to ``most`` and fall again."""
    batch = F.floor(index / per_batch)
    if mode == "constant":
        keys = F.lit(1)
    elif mode == "growing":
        keys = batch + 1
    else:
        place = batch % (2 * most)
        keys = F.when(place < most, place + 1).otherwise(2 * most - place)
    return F.pmod(index, keys)


class Share(InputPartition):
    def __init__(self, index: int) -> None:
        self.index = index


class ShareReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.count, self.parts = int(options.get("count", 100)), int(options.get("parts", 2))

    def partitions(self) -> list[InputPartition]:
        return [Share(i) for i in range(self.parts)]

    def read(self, partition: Share) -> Iterator[tuple]:
        for i in range(partition.index, self.count, self.parts):
            yield (i, partition.index)


class PartitionedSource(DataSource):
    """A source whose parallel instances each emit their own share of 0..count-1: those with ``i % parts == instance``."""

    @classmethod
    def name(cls) -> str:
        return "shares"

    def schema(self) -> str:
        return "value bigint, instance int"

    def reader(self, schema: object) -> DataSourceReader:
        return ShareReader(self.options)
