"""File sources, bounded and streaming, with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def text_scan(spark: SparkSession, *paths: str) -> DataFrame:
    """The lines of text files."""
    return spark.read.text(list(paths))


def text_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)


def timed_stream(spark: SparkSession, path: str, schema: str, time: str, delay: str, form: str = "parquet", files_per_trigger: int = 1) -> DataFrame:
    """A stream of files whose rows carry their event time; the watermark trails it by ``delay``."""
    rows = spark.readStream.schema(schema).format(form).option("maxFilesPerTrigger", files_per_trigger).load(path)
    return rows.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)


def csv_table(spark: SparkSession, name: str, path: str, schema: str) -> DataFrame:
    """A named table over CSV files; blanks after separators are no part of a value."""
    rows = spark.read.schema(schema).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    rows.createOrReplaceTempView(name)
    return rows


CHANGE = "db string, tableName string, before map<string,string>, after map<string,string>, op string"


def change_feed(lines: DataFrame, line_col: str = "value") -> DataFrame:
    """Changes of a table from JSON lines {db, tableName, before, after, op}; lines that don't parse have a null op."""
    return lines.withColumn("change", F.from_json(line_col, CHANGE)).select(line_col, "change.*")


def once_per_id(messages: DataFrame, correlation_id: str, order: list[str]) -> DataFrame:
    """Queue messages by correlation id, each consumed once: the first by ``order``. Messages without an id all pass."""
    sure = messages.where(F.col(correlation_id).isNotNull())
    first = sure.groupBy(correlation_id).agg(F.min_by(F.struct(*messages.columns), F.struct(*order)).alias("first")).select("first.*")
    return first.unionByName(messages.where(F.col(correlation_id).isNull()))


def once_per_id_stream(messages: DataFrame, correlation_id: str) -> DataFrame:
    """The same on a stream with a watermark, which bounds how long ids are remembered."""
    return messages.dropDuplicatesWithinWatermark([correlation_id])
