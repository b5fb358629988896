"""Tables in the shapes that the queries use, and pieces of SQL that say the same for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillspark.session import events, table


def clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events(event_id, ts, user_id, event_type, vc): ``vc`` is the value's whole part."""
    return events(spark, sf_dir).select("event_id", "ts", "user_id", "event_type", F.floor("value").alias("vc"))


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows with an arrival time that lags the event time by up to an hour, in a fixed scrambled way."""
    lag = F.make_dt_interval(secs=((F.col("event_id") * 7919) % 3600).cast("decimal(18,6)"))
    return clicks(spark, sf_dir).withColumn("arrival", F.col("ts") + lag)


#: The same for DuckDB. Instants are microseconds.
E = "(SELECT event_id, ts, user_id, event_type, floor(value)::BIGINT AS vc, epoch_us(ts) AS us FROM events)"
A = f"(SELECT *, us + (event_id * 7919 % 3600) * 1000000 AS arr FROM {E})"
HOUR, DAY = 3_600_000_000, 86_400_000_000


def stamp(us: str) -> str:
    return f"make_timestamp(({us})::BIGINT)"


def start(size: int, us: str = "us") -> str:
    return f"({us} - {us} % {size})"


def naive(df: DataFrame, *columns: str) -> DataFrame:
    """Instants as naive timestamps in UTC, as the tables store them."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


__all__ = ["clicks", "arrivals", "E", "A", "HOUR", "DAY", "stamp", "start", "naive", "table", "events"]
