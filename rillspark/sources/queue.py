"""A queue as a stream: partitions with offsets, a bound on what is fetched at a time, and acknowledgement.

Messages lie in Parquet files, a folder per partition; a message's offset is its place in its partition. A micro-batch
takes at most ``prefetch`` messages of each partition. When Spark has finished a micro-batch, its offsets are acknowledged
under the consumer's name. A query that resumes from its checkpoint goes on after what it finished; a new one of the same
consumer starts after the last acknowledged message, so what was fetched but never finished comes again.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from rillspark.streaming.transactional import names, opened, put

SCHEMA = "correlation_id string, body string, sent timestamp, part int, place bigint"


def publish(rows: DataFrame, path: str, correlation_id: Column, body: Column, sent: Column, parts: int = 4, order: list[str] | None = None) -> None:
    """Append ``rows`` as messages: an id stays in one partition, in ``order`` within it. Null ids go to partition 0."""
    part = F.coalesce(F.pmod(F.xxhash64("correlation_id"), F.lit(parts)), F.lit(0)).cast("int")
    line = rows.select(correlation_id.cast("string").alias("correlation_id"), body.cast("string").alias("body"), sent.cast("timestamp").alias("sent"), *[F.col(c).alias(f"order {c}") for c in order or []])
    line = line.withColumn("part", part).repartition(parts, "part").sortWithinPartitions("part", *[f"order {c}" for c in order or []])
    line.drop(*[f"order {c}" for c in order or []]).write.partitionBy("part").mode("append").parquet(path)


class Range(InputPartition):
    def __init__(self, part: int, start: int, end: int) -> None:
        self.part, self.start, self.end = part, start, end


class QueueReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.consumer = options["path"], options.get("consumer", "consumer")
        self.prefetch = int(options.get("prefetch", 0))
        self.position: dict[str, int] | None = None
        self.sizes: dict[str, int] = {}

    def files(self, fs: pafs.FileSystem, root: str, part: str) -> list[tuple[str, int]]:
        """(file, messages) of a partition: files as they were added, by time and name. A footer is read once per file."""
        found = [f for f in fs.get_file_info(pafs.FileSelector(f"{root}/part={part}", allow_not_found=True)) if f.base_name.endswith(".parquet")]
        out = []
        for f in sorted(found, key=lambda f: (f.mtime_ns or 0, f.path)):
            if f.path not in self.sizes:
                self.sizes[f.path] = pq.ParquetFile(f.path, filesystem=fs).metadata.num_rows
            out.append((f.path, self.sizes[f.path]))
        return out

    def ledger(self) -> dict[str, dict[str, int]]:
        fs, root = opened(self.path)
        if f"{self.consumer}.json" not in names(fs, f"{root}/_acks"):
            return {"acked": {}, "planned": {}}
        with fs.open_input_stream(f"{root}/_acks/{self.consumer}.json") as f:
            return json.loads(f.read())

    def note(self, kind: str, offsets: dict[str, int]) -> None:
        fs, root = opened(self.path)
        known = self.ledger()
        known[kind] = {p: max(n, known[kind].get(p, 0)) for p, n in offsets.items()} | {p: n for p, n in known[kind].items() if p not in offsets}
        put(fs, f"{root}/_acks", f"{self.consumer}.json", known)

    def initialOffset(self) -> dict:
        """Of a new query: after what the consumer has acknowledged."""
        fs, root = opened(self.path)
        known = self.ledger()["acked"]
        self.position = known
        put(fs, f"{root}/_acks", f"{self.consumer}.json", {"acked": known, "planned": known})
        return known

    def latestOffset(self) -> dict:
        fs, root = opened(self.path)
        if self.position is None:  # resumed: the checkpoint ends where the last planned micro-batch did
            known = self.ledger()
            self.position = {p: max(known["acked"].get(p, 0), known["planned"].get(p, 0)) for p in known["acked"] | known["planned"]}
        out = dict(self.position)
        for name in names(fs, root):
            if name.startswith("part="):
                part = name[5:]
                there, start = sum(n for _, n in self.files(fs, root, part)), self.position.get(part, 0)
                out[part] = max(start, min(there, start + self.prefetch) if self.prefetch else there)
        return out

    def partitions(self, start: dict, end: dict) -> list[Range]:
        self.note("planned", end)
        self.position = {p: max(n, (self.position or {}).get(p, 0)) for p, n in end.items()}
        return [Range(int(p), start.get(p, 0), n) for p, n in sorted(end.items()) if n > start.get(p, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        fs, root = opened(self.path)
        first = 0
        for file, n in self.files(fs, root, str(partition.part)):
            place = first
            first += n
            if place + n <= partition.start or place >= partition.end:
                continue
            for batch in pq.ParquetFile(file, filesystem=fs).iter_batches(columns=["correlation_id", "body", "sent"]):
                a, b = max(partition.start - place, 0), min(partition.end - place, batch.num_rows)
                if a < b:
                    some = batch.slice(a, b - a)
                    yield pa.RecordBatch.from_arrays(
                        [some.column(0), some.column(1), some.column(2).cast(pa.timestamp("us", "UTC")), pa.array([partition.part] * (b - a), pa.int32()), pa.array(range(place + a, place + b), pa.int64())],
                        names=["correlation_id", "body", "sent", "part", "place"],
                    )
                place += batch.num_rows

    def commit(self, end: dict) -> None:
        self.note("acked", end)


class Queue(DataSource):
    """Options: ``path``, ``consumer``, and ``prefetch``, the most messages of a partition in a micro-batch (0: no bound).

    With a bound, ``availableNow`` takes one micro-batch; use a trigger by time to go on.
    """

    @classmethod
    def name(cls) -> str:
        return "queue"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> QueueReader:
        return QueueReader(self.options)


def queue_stream(spark: SparkSession, path: str, consumer: str = "consumer", prefetch: int = 0) -> DataFrame:
    """Messages with their own time ``sent``; put a watermark on it and ``files.once_per_id_stream`` on the ids."""
    spark.dataSource.register(Queue)
    return spark.readStream.format("queue").option("path", path).option("consumer", consumer).option("prefetch", prefetch).load()


def acknowledged(path: str, consumer: str = "consumer") -> dict[str, int]:
    return QueueReader({"path": path, "consumer": consumer}).ledger()["acked"]
