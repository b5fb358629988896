"""Session and table helpers shared by queries, tests and the bench."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int = 8, app: str = "rillspark", **conf: str) -> SparkSession:
    """A local session for tests and benches; on a cluster, pass your own session instead."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table with ``ts`` as an instant: the stored type is a naive timestamp, which watermarks reject."""
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


#: The folder, within the shared one, of the run that is under way.
RUN: ContextVar[str] = ContextVar("run", default="")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the checkpoint folder; a new local one in local mode alone."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(path or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, within that of the run if one is under way."""
    return f"{shared_folder(spark)}/{RUN.get()}{name}-{uuid.uuid4().hex}"


@contextmanager
def run_folder(spark: SparkSession) -> Iterator[str]:
    """All intermediate tables made inside lie in one folder, which goes at the end.

    Results read from these tables, so write them, or collect them, before it ends.
    """
    token = RUN.set(f"run-{uuid.uuid4().hex}/")
    path = f"{shared_folder(spark)}/{RUN.get()}"
    try:
        yield path
    finally:
        RUN.reset(token)
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
