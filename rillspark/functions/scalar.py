"""Scalar, aggregate and table functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def string_hash(text: Column) -> Column:
    """The 32-bit string hash h = 31 h + unit over UTF-16 units: two for a character beyond the basic plane. Null stays null."""
    units = F.hex(F.encode(text, "UTF-16BE"))
    n = (F.length(units) / 4).cast("int")
    unit = lambda i: F.conv(F.substring(units, (i * 4 - 3).cast("int"), F.lit(4)), 16, 10).cast("long")
    step = lambda h, i: F.pmod(h * 31 + unit(i), F.lit(1 << 32))
    total = F.when(n > 0, F.aggregate(F.sequence(F.lit(1), n), F.lit(0).cast("long"), step)).when(n == 0, F.lit(0).cast("long"))
    return F.when(total >= 1 << 31, total - (1 << 32)).otherwise(total).cast("int")


def weighted_average(value: Column, weight: Column) -> Column:
    """Null where the weights sum to zero or there is none."""
    return F.try_divide(F.sum(value * weight), F.sum(weight))


def weighted_average_whole(value: Column, weight: Column) -> Column:
    total, weights = F.sum(value * weight), F.sum(weight)
    return F.when(weights != 0, F.call_function("div", total.cast("long"), weights.cast("long")))


def window_label(start: Column, end: Column, n: Column) -> Column:
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSS")
    return F.format_string("window [%s,%s) has %d rows", stamp(start), stamp(end), n)


def to_json(*columns: str) -> Column:
    return F.to_json(F.struct(*columns))


def from_json(text: Column, schema: str) -> Column:
    """A struct, list or map, by the schema; text that doesn't parse gives null fields."""
    return F.from_json(text, schema)


def uuid_token() -> Column:
    return F.replace(F.uuid(), F.lit("-"), F.lit(""))


def weighted_average_udaf(value: pd.Series, weight: pd.Series) -> float:
    return float((value * weight).sum() / weight.sum()) if weight.sum() else float("nan")


def register(spark: SparkSession) -> None:
    """Make the functions callable by name in SQL. Two are SQL functions, which the optimizer inlines into the plan."""
    from pyspark.sql.functions import pandas_udf
    from pyspark.sql.types import DoubleType

    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION split_words(text STRING) RETURNS TABLE (word STRING, length INT) COMMENT 'words between single spaces' "
        "RETURN SELECT part, length(part) FROM (SELECT explode(filter(split(text, ' '), x -> x <> '')) AS part)"
    )
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION text_length(text STRING) RETURNS INT RETURN length(text)")
    weighted_average_udaf.__annotations__ = {"value": pd.Series, "weight": pd.Series, "return": float}
    spark.udf.register("weighted_average", pandas_udf(weighted_average_udaf, DoubleType()))
