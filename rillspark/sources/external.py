"""Sources and sinks that other systems serve: sockets, topics and databases."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F


def socket_stream(spark: SparkSession, host: str, port: int) -> DataFrame:
    return spark.readStream.format("socket").option("host", host).option("port", port).load()


def kafka_options(servers: str, topic: str, group: str | None = None, start: str = "earliest", committed_only: bool = False) -> dict[str, str]:
    """Reader options; ``start`` is "earliest" or "latest"; committed_only skips rows of open or aborted transactions."""
    if start not in ("earliest", "latest"):
        raise ValueError(f"start must be earliest or latest, not {start}")
    options = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": start}
    if group:
        options["kafka.group.id"] = group
    if committed_only:
        options["kafka.isolation.level"] = "read_committed"
    return options


def kafka_stream(spark: SparkSession, **setting: object) -> DataFrame:
    """Topic values as text. Needs Spark's Kafka package on the cluster."""
    return decoded(spark.readStream.format("kafka").options(**kafka_options(**setting)).load())


def decoded(frame: DataFrame) -> DataFrame:
    return frame.select(F.col("value").cast("string").alias("value"))


def kafka_values(rows: DataFrame, value: str) -> DataFrame:
    """Rows in the shape of a topic without keys."""
    return rows.select(F.col(value).cast("binary").alias("value"))


def kafka_keyed(rows: DataFrame, line: str, separator: str = ",") -> DataFrame:
    """Key: the first field of the line. Value: the whole line."""
    return rows.select(F.split(F.col(line), separator)[0].cast("binary").alias("key"), F.col(line).cast("binary").alias("value"))


def jdbc_query(spark: SparkSession, url: str, query: str, driver: str, schema: str | None = None, fetch_size: int = 1000) -> DataFrame:
    """The rows of a query that the database runs, with declared column types if a ``schema`` is given."""
    reader: DataFrameReader = spark.read.format("jdbc").options(url=url, query=query, driver=driver, fetchsize=str(fetch_size))
    return (reader.option("customSchema", schema) if schema else reader).load()


def jdbc_insert(rows: DataFrame, url: str, table: str, driver: str, batch_rows: int = 100) -> None:
    rows.write.format("jdbc").options(url=url, dbtable=table, driver=driver, batchsize=str(batch_rows)).mode("append").save()


def jdbc_upsert(rows: DataFrame, url: str, table: str, key: str, driver: str, number: int, types: str | None = None, batch_rows: int = 100, retries: int = 3, within_s: float = 60.0) -> None:
    """Write a micro-batch, one row per ``key``, over what the table has of these keys. A replay writes the same again.

    ``types`` are columns' types in the database ("name VARCHAR(100)"), where the usual ones can't be compared.

    Tasks fill a table of the micro-batch's own; the database then takes its rows over in one transaction. A failure is
    tried again, ever later, at most ``retries`` times and while ``within_s`` lasts; the table is as before until then.
    """
    spark, stage, end = rows.sparkSession, f"{table}_batch_{number}", time.monotonic() + within_s
    options = {"url": url, "driver": driver, "batchsize": str(batch_rows)} | ({"createTableColumnTypes": types} if types else {})
    columns = ", ".join(f'"{c}"' for c in rows.columns)
    for attempt in range(retries + 1):
        try:
            rows.write.format("jdbc").options(dbtable=stage, **options).mode("overwrite").save()
            rows.limit(0).write.format("jdbc").options(dbtable=table, **options).mode("append").save()
            take = [f'DELETE FROM {table} WHERE "{key}" IN (SELECT "{key}" FROM {stage})', f"INSERT INTO {table} ({columns}) SELECT {columns} FROM {stage}", f"DROP TABLE {stage}"]
            return transaction(spark, url, driver, take)
        except Exception:
            left = end - time.monotonic()
            if attempt == retries or left <= 0:
                raise
            time.sleep(min(0.1 * 2**attempt, left))


def transaction(spark: SparkSession, url: str, driver: str, statements: list[str]) -> None:
    """Run statements in the database, all or none."""
    spark._jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(driver)
    connection = spark._jvm.java.sql.DriverManager.getConnection(url)
    try:
        connection.setAutoCommit(False)
        for text in statements:
            statement = connection.createStatement()
            statement.executeUpdate(text)
            statement.close()
        connection.commit()
    except Exception:
        connection.rollback()
        raise
    finally:
        connection.close()
