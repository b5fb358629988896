"""Row operators: projection, parsing, conditional flat maps, splits, changelogs and redistribution."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def map_project(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns)


def parse_lines(lines: DataFrame, fields: dict[str, str], line_col: str = "value", separator: str = ",") -> DataFrame:
    """Typed columns out of separated text; ``ok`` is false where a field is missing or does not convert."""
    parts = F.split(F.col(line_col), separator)
    out = lines.select(line_col, *[F.trim(F.get(parts, F.lit(i))).try_cast(kind).alias(name) for i, (name, kind) in enumerate(fields.items())])
    sure = F.lit(True)
    for name in fields:
        sure = sure & F.col(name).isNotNull()
    return out.withColumn("ok", sure & (F.size(parts) == len(fields)))


def key_filter(column: str, word: str) -> Callable[[], Column]:
    """A predicate that carries its argument."""
    return lambda: F.contains(F.col(column), F.lit(word))


def flat_map_conditional(df: DataFrame, key: str, cases: dict[str, list[str]], out: str = "value") -> DataFrame:
    """Each row becomes as many as its key's case lists columns; keys without a case vanish."""
    none = F.array().cast("array<string>")
    choice = none
    for value, columns in cases.items():
        choice = F.when(F.col(key) == value, F.array(*[F.col(c).cast("string") for c in columns])).otherwise(choice)
    return df.select(key, F.explode(choice).alias(out))


def repeat_by_key(df: DataFrame, key: str, times: dict[str, int]) -> DataFrame:
    """Rows of a key ``times`` over; other keys vanish."""
    n = F.lit(0)
    for value, k in times.items():
        n = F.when(F.col(key) == value, k).otherwise(n)
    return df.withColumn("copy", F.explode(F.array_repeat(F.lit(1), n))).drop("copy")


def changelog(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Running counts per key as changes: +I for the first, then -U with the old and +U with the new count."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long")
    change = lambda kind, value: F.struct(F.lit(kind).alias("op"), value.alias("cnt"))
    first = F.array(change("+I", F.col("n")))
    later = F.array(change("-U", F.col("n") - 1), change("+U", F.col("n")))
    return df.withColumn("n", n).select(key, *order, F.explode(F.when(F.col("n") == 1, first).otherwise(later)).alias("change")).select(key, *order, "change.*")


def rich_map(df: DataFrame, make: Callable[[int], Callable[[pd.DataFrame], pd.DataFrame]], schema: str, batch_bytes: int = 1 << 21) -> DataFrame:
    """``make`` runs once for each parallel instance, with its index, and gives the function for its batches.

    A batch ends at ``batch_bytes`` of Arrow data, or with the row that passes them: texts take several times that in Python.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", batch_bytes)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        f = make(TaskContext.get().partitionId())
        for frame in frames:
            yield f(frame)

    return df.mapInPandas(work, schema)


def split_by_predicate(df: DataFrame, predicates: dict[str, Column]) -> dict[str, DataFrame]:
    return {name: df.where(p) for name, p in predicates.items()}


def side_outputs(df: DataFrame, routes: dict[str, Column], main: str = "main") -> DataFrame:
    """One pass that names each row's output: the first route whose predicate holds, or ``main``."""
    tag = F.lit(main)
    for name, p in reversed(routes.items()):
        tag = F.when(p, name).otherwise(tag)
    return df.withColumn("output", tag)


def side_alerts(df: DataFrame, alarm: Column, alert: str = "alert") -> DataFrame:
    """All rows in ``main``, and those that alarm once more in ``alert``."""
    tags = F.when(alarm, F.array(F.lit("main"), F.lit(alert))).otherwise(F.array(F.lit("main")))
    return df.withColumn("output", F.explode(tags))


def computed_time(df: DataFrame, millis: str, out: str = "et") -> DataFrame:
    """Event time from epoch milliseconds, whole seconds only."""
    return df.withColumn(out, F.timestamp_seconds(F.floor(F.col(millis) / 1000)))


def rebalanced(df: DataFrame, n: int) -> DataFrame:
    return df.repartition(n)


def shuffled(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """Each row to a partition drawn at random; with the same input and ``seed`` the same one again, as a rerun task needs."""
    return df.repartition(n, F.rand(seed))


def rescaled(df: DataFrame, n: int) -> DataFrame:
    """Fewer partitions out of neighbouring ones, without a shuffle."""
    return df.coalesce(n)


def to_every_partition(df: DataFrame, n: int) -> DataFrame:
    """Each row once for each of ``n`` instances, told apart by ``instance``: an explode, so no side is collected."""
    return df.withColumn("instance", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).repartitionById(n, F.col("instance"))


def to_one_partition(df: DataFrame) -> DataFrame:
    """All rows in the first instance. For small results only."""
    return df.coalesce(1)


def custom_partition(df: DataFrame, n: int, key: str) -> DataFrame:
    """Row placement by ``key % n``."""
    return df.repartitionById(n, F.pmod(F.col(key), F.lit(n)).cast("int"))


def key_by(df: DataFrame, n: int, key: str) -> DataFrame:
    return df.repartition(n, key)
