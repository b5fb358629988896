"""A stream sink that commits in two phases: a micro-batch's files count once its commit lists them, and once only.

Tasks write files that nobody reads yet and report them. ``commit`` puts their list in place under the micro-batch's
number by one rename; if that number is there already, the micro-batch is a replay, and its new files go. ``abort``
deletes what its tasks reported. A task that dies leaves a file that no list names; ``vacuum`` removes such files.
Readers take the files of the lists alone. Paths lie in storage that driver and executors share.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType


@dataclass
class Written(WriterCommitMessage):
    file: str
    rows: int


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    fs, root = pafs.FileSystem.from_uri(path)
    return fs, root.rstrip("/")


def names(fs: pafs.FileSystem, folder: str) -> list[str]:
    return [f.base_name for f in fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True))]


def put(fs: pafs.FileSystem, folder: str, name: str, content: dict) -> None:
    """Write a small file that is there whole or not at all."""
    fs.create_dir(folder, recursive=True)
    draft = f"{folder}/.{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(draft) as out:
        out.write(json.dumps(content).encode())
    fs.move(draft, f"{folder}/{name}")


class FileCommitter(DataSourceStreamArrowWriter):
    def __init__(self, path: str, query: str) -> None:
        self.path, self.query = path, query

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = opened(self.path)
        name, rows, writer = f"{uuid.uuid4().hex}.parquet", 0, None
        fs.create_dir(f"{root}/rows", recursive=True)
        try:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                writer = writer or pq.ParquetWriter(f"{root}/rows/{name}", batch.schema, filesystem=fs)
                writer.write_batch(batch)
                rows += batch.num_rows
        finally:
            if writer:
                writer.close()
        return Written(name if writer else "", rows)

    def listed(self, batch_id: int) -> str:
        return f"{self.query}-{batch_id:012d}.json"

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        fs, root = opened(self.path)
        if self.listed(batchId) in names(fs, f"{root}/commits"):
            self.abort(messages, batchId)
            return
        files = [m for m in messages if m and m.file]
        put(fs, f"{root}/commits", self.listed(batchId), {"files": [m.file for m in files], "rows": sum(m.rows for m in files)})

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        fs, root = opened(self.path)
        there = set(names(fs, f"{root}/rows"))
        for m in messages:
            if m and m.file in there:
                fs.delete_file(f"{root}/rows/{m.file}")


class CommittedFiles(DataSource):
    """Options: ``path``, and ``query``, the name under which this query's micro-batches are numbered."""

    @classmethod
    def name(cls) -> str:
        return "committed_files"

    def streamWriter(self, schema: StructType, overwrite: bool) -> FileCommitter:
        return FileCommitter(self.options["path"], self.options.get("query", "query"))


def committed_files(rows: DataFrame, path: str, checkpoint: str, query: str = "query") -> DataStreamWriter:
    """A writer to start with any trigger. A new checkpoint numbers its micro-batches anew, so it needs another ``query``."""
    rows.sparkSession.dataSource.register(CommittedFiles)
    return rows.writeStream.format("committed_files").option("path", path).option("query", query).option("checkpointLocation", checkpoint)


def commits(path: str) -> list[dict]:
    fs, root = opened(path)
    out = []
    for name in sorted(n for n in names(fs, f"{root}/commits") if not n.startswith(".")):
        with fs.open_input_stream(f"{root}/commits/{name}") as f:
            out.append(json.loads(f.read()))
    return out


def read_committed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What has been committed so far; of uncommitted files nothing is read."""
    files = [f"{path}/rows/{f}" for c in commits(path) for f in c["files"]]
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


def vacuum(path: str) -> int:
    """Delete files that no commit lists, and say how many. Stop the queries before: files of a micro-batch under way are not listed yet."""
    fs, root = opened(path)
    known = {f for c in commits(path) for f in c["files"]}
    stray = [n for n in names(fs, f"{root}/rows") if n not in known]
    for n in stray:
        fs.delete_file(f"{root}/rows/{n}")
    return len(stray)
