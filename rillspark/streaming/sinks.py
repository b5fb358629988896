"""Sinks of batches and streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery


def console(rows: DataFrame, label: str, mode: str = "append") -> StreamingQuery:
    """Print rows, each under a label."""
    return rows.withColumn("label", F.lit(label)).writeStream.format("console").outputMode(mode).start()


def printed(rows: DataFrame, label: str, op: str = "+I") -> DataFrame:
    """One line per row, as a print table shows it: label, kind of change, and the fields."""
    fields = F.concat_ws(", ", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in rows.columns])
    return rows.select(F.concat(F.lit(f"{label}> {op}["), fields, F.lit("]")).alias("line"))


def memory_table(rows: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> StreamingQuery:
    """A table that shows what a stream has emitted, for tests and demonstrations."""
    writer = rows.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()


def memory_table_live(rows: DataFrame, name: str) -> StreamingQuery:
    """The same for a source that never ends."""
    return rows.writeStream.format("memory").queryName(name).start()


def started(writer: DataStreamWriter, every: str | None) -> StreamingQuery:
    """Start with a trigger every so often, or, without one, over what is there now."""
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def rolling_files(rows: DataFrame, path: str, checkpoint: str, every: str | None = "15 minutes", most_rows: int = 1_000_000) -> StreamingQuery:
    """Text files that roll with each trigger, so by age, and after ``most_rows``; with the checkpoint, each row is written once."""
    return started(rows.writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint).option("maxRecordsPerFile", most_rows), every)


def with_bucket(rows: DataFrame, time: Column) -> DataFrame:
    return rows.withColumn("bucket", F.date_format(time, "yyyy-MM-dd HH"))


def bucketed_files(rows: DataFrame, path: str, time: Column, form: str = "parquet", parts: int | None = None) -> None:
    """Files in one folder per hour of ``time``. Rows go in ranges of time: small hours share a task, large ones take several."""
    parts = parts or max(rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = with_bucket(rows, time).repartitionByRange(parts, "bucket", F.xxhash64(*rows.columns)).sortWithinPartitions("bucket")
    ranged.write.partitionBy("bucket").format(form).mode("append").save(path)


def bucketed_file_stream(rows: DataFrame, path: str, checkpoint: str, form: str = "parquet", every: str | None = "1 minute") -> StreamingQuery:
    """The same by the time a row is handled."""
    return started(with_bucket(rows, F.current_timestamp()).writeStream.partitionBy("bucket").format(form).option("path", path).option("checkpointLocation", checkpoint), every)


def csv_files(rows: DataFrame, path: str) -> None:
    rows.write.csv(path)


def latest_per_key(rows: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """What a keyed store holds after all rows: the last write of each key."""
    return rows.groupBy(key).agg(F.max_by(F.struct(value), F.struct(*order)).alias("last")).select(key, f"last.{value}")


def upsert(batch: DataFrame, path: str, key: str, value: str, order: list[str], slots: int = 64) -> None:
    """Merge a micro-batch into a keyed table; a replayed batch changes nothing.

    The table lies in ``slots`` by a hash of the key, each slot as versions. A batch reads and writes only the slots that
    its keys fall in. A version is written whole before readers take it, so a failure leaves the one before.
    """
    spark = batch.sparkSession
    new = batch.select(key, value, *order).withColumn("slot", F.pmod(F.xxhash64(key), F.lit(slots)).cast("int"))
    folders, last = _slots(spark, path)
    if folders:
        touched = [r[0] for r in new.select("slot").distinct().collect() if r[0] in folders]  # at most ``slots`` numbers
        if touched:
            old = spark.read.schema(new.drop("slot").schema).parquet(*[folders[k] for k in touched])
            new = new.unionByName(old.withColumn("slot", F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")))
    best = new.groupBy(key).agg(F.max_by(F.struct(value, *order, "slot"), F.struct(*order)).alias("last")).select(key, "last.*")
    best.repartition(spark.sparkContext.defaultParallelism, "slot").write.partitionBy("slot").mode("overwrite").parquet(f"{path}/v{last + 1}")


def current(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The table as it is now."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(*_slots(spark, path)[0].values())


def compacted(spark: SparkSession, path: str) -> int:
    """Write the newest version of every slot once more as one version, and delete the older ones; how many these were.

    Upserts list all versions, so a long stream should do this now and then, between micro-batches. Readers that began
    before keep the old files' names and must begin again.
    """
    folders, last = _slots(spark, path)
    if not folders:
        return 0
    rows = None
    for slot, folder in folders.items():
        one = spark.read.parquet(folder).withColumn("slot", F.lit(slot))
        rows = one if rows is None else rows.unionByName(one)
    rows.repartition("slot").write.partitionBy("slot").mode("overwrite").parquet(f"{path}/v{last + 1}")
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    fs = path_of(path).getFileSystem(spark._jsc.hadoopConfiguration())
    old = [x.getPath() for x in fs.listStatus(path_of(path)) if int(x.getPath().getName()[1:]) <= last]
    for x in old:
        fs.delete(x, True)
    return len(old)


def _slots(spark: SparkSession, path: str) -> tuple[dict[int, str], int]:
    """The folder of each slot's newest version that is complete, and the number of the newest version."""
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    root = path_of(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    versions = sorted(int(x.getPath().getName()[1:]) for x in fs.listStatus(root)) if fs.exists(root) else []
    done = [v for v in versions if fs.exists(path_of(f"{path}/v{v}/_SUCCESS"))]
    folders: dict[int, str] = {}
    for v in done:
        for x in fs.listStatus(path_of(f"{path}/v{v}")):
            name = x.getPath().getName()
            if name.startswith("slot="):
                folders[int(name[5:])] = f"{path}/v{v}/{name}"
    return folders, done[-1] if done else -1


def documents(rows: DataFrame, field: str, value: str) -> DataFrame:
    """One JSON document per row whose only field is named by the row itself."""
    return rows.select(F.to_json(F.create_map(F.col(field).cast("string"), F.col(value))).alias("document"))


def routed(rows: DataFrame, exchange: str, routing_key: Column, body: Column) -> DataFrame:
    """Envelopes for a message broker, each with a correlation id of its own."""
    return rows.select(F.lit(exchange).alias("exchange"), routing_key.alias("routing_key"), F.uuid().alias("correlation_id"), body.alias("body"))


def unroutable(envelopes: DataFrame, bindings: DataFrame) -> DataFrame:
    """Envelopes whose routing key no queue is bound to: they go back to the sender."""
    return envelopes.join(bindings, ["exchange", "routing_key"], "left_anti")


def flushed(rows: DataFrame, key: str, size: int, order: list[str]) -> DataFrame:
    """Rows of full buffers of ``size`` per instance ``key``; what a buffer still holds at the end stays unflushed."""
    line = Window.partitionBy(key).orderBy(*order)
    numbered = rows.withColumn("flush", F.floor((F.row_number().over(line) - 1) / size))
    full = F.count("*").over(Window.partitionBy(key, "flush"))
    return numbered.withColumn("held", full).where(F.col("held") == size).drop("held")


def each_batch(rows: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hand each micro-batch to ``write`` with its number: a writer that skips numbers it has seen writes once."""
    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class RowWriter:
    """A sink with a life cycle: override ``write``; ``open`` and ``close`` frame each partition of each micro-batch."""

    def open(self, partition_id: int, epoch_id: int) -> bool:
        return True

    def process(self, row: object) -> None:
        self.write(row)

    def write(self, row: object) -> None:
        raise NotImplementedError

    def close(self, error: Exception | None) -> None:
        if error:
            raise error


def custom(rows: DataFrame, writer: RowWriter, checkpoint: str) -> StreamingQuery:
    return rows.writeStream.foreach(writer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
