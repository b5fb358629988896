"""Joined histories, change feeds, ratios per window, compaction, run folders, hashes of surrogates, random spreading."""

import datetime
import os
import time

import pytest
from pyspark.sql import functions as F

from rillspark.functions import scalar
from rillspark.operators import aggregates, rows, windows
from rillspark.plans.base import clicks
from rillspark.session import run_folder, scratch
from rillspark.sources import external, files
from rillspark.streaming import joined, queries, sinks

SF = "/root/testdata/sf0.001"
SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, vc bigint"


@pytest.fixture(autouse=True)
def few_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "8")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("more") / "in")
    some = clicks(spark, SF)
    for i in range(3):
        some.where(F.floor(F.col("event_id") / 400) == i).coalesce(1).write.parquet(f"{path}/f{i}")
    return path


def stream(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


def shown(spark, df, tmp_path, name, mode="append"):
    q = sinks.memory_table(df, name, mode, str(tmp_path / "c"))
    q.awaitTermination(120)
    q.stop()
    return spark.table(name)


def test_histories_meet_in_full(spark, folder, tmp_path):
    kind = lambda df, name: df.where(F.col("event_type") == name)
    got = shown(spark, joined.full_history(kind(stream(spark, folder), "click"), kind(stream(spark, folder), "purchase"), "user_id", "ts", "event_id"), tmp_path, "histories")
    some = spark.read.schema(SCHEMA).parquet(f"{folder}/*")
    left = kind(some, "click").select("user_id", F.col("event_id").alias("left_id"))
    want = left.join(kind(some, "purchase").select("user_id", F.col("event_id").alias("right_id")), "user_id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select("user_id", "left_id", "right_id").collect()))


def test_a_table_follows_its_changes(spark, tmp_path):
    """A replayed change and one that is older than what counted last change nothing."""
    parts = [[(1, 10, "CREATE", "a"), (2, 11, "CREATE", "b")], [(1, 20, "UPDATE", "c"), (1, 10, "CREATE", "a"), (2, 30, "DELETE", None)], [(2, 25, "UPDATE", "late"), (1, 20, "UPDATE", "c"), (2, 40, "CREATE", "d")]]
    for i, part in enumerate(parts):
        df = spark.createDataFrame([(k, s, s, op, image) for k, s, op, image in part], "k long, id long, s long, op string, image string")
        df.withColumn("ts", F.timestamp_seconds("s")).drop("s").coalesce(1).write.parquet(f"{tmp_path}/in/f{i}")
    feed = files.timed_stream(spark, f"{tmp_path}/in/*", "k bigint, id bigint, op string, image string, ts timestamp", "ts", "1 hour")
    got = sorted(map(tuple, shown(spark, joined.followed(feed, "k", "ts", "id"), tmp_path, "followed").collect()))
    assert got == [(1, 10, "a"), (1, 20, "c"), (2, 11, "b"), (2, 30, None), (2, 40, "d")]


def test_views_per_user_of_closed_windows(spark, folder, tmp_path):
    end = spark.createDataFrame([(10**9, 10**9, "end", 0)], "event_id bigint, user_id bigint, event_type string, vc bigint").withColumn("ts", F.lit("2100-01-01").cast("timestamp"))
    some = spark.read.schema(SCHEMA).parquet(f"{folder}/*")
    some.coalesce(1).write.parquet(f"{tmp_path}/in/a")
    end.select(*some.columns).coalesce(1).write.parquet(f"{tmp_path}/in/b")
    rows_ = files.timed_stream(spark, f"{tmp_path}/in/*", SCHEMA, "ts", "1 hour")
    got = shown(spark, queries.views_per_user(rows_, "ts", "1 day", "user_id", "6 hours"), tmp_path, "ratios").where("window_start < '2090-01-01'")
    want = windows.windowed(some, "ts", "1 day", [], (F.count("*") / F.count_distinct("user_id")).alias("ratio"), slide="6 hours")
    key = lambda df: sorted((r["window_start"], round(r["ratio"], 9)) for r in df.collect())
    assert key(got) == key(want)


def test_windows_by_the_time_that_rows_are_handled(spark, folder, tmp_path):
    began = time.time()
    some = spark.read.schema(SCHEMA).parquet(f"{folder}/*")
    for name, slide, times in (("tumbling", None, 1), ("sliding", "5 seconds", 2)):
        (tmp_path / name).mkdir()
        counts = queries.processing_windows(stream(spark, folder), "10 seconds", ["event_type"], F.count("*").alias("cnt"), slide=slide)
        rows_ = shown(spark, counts, tmp_path / name, f"handled_{name}", "complete").collect()
        want = {r["event_type"]: r["count"] * times for r in some.groupBy("event_type").count().collect()}
        got = {}
        for r in rows_:
            got[r["event_type"]] = got.get(r["event_type"], 0) + r["cnt"]
            assert began - 15 <= r["window_start"].replace(tzinfo=datetime.timezone.utc).timestamp() <= time.time()
        assert got == want


def test_slots_are_compacted(spark, tmp_path):
    path = str(tmp_path / "table")
    for k in range(3):
        sinks.upsert(spark.createDataFrame([(i, i * 10 + k, k) for i in range(k, 20)], "id long, v long, seq long"), path, "id", "v", ["seq"], slots=4)
    before = sorted(map(tuple, sinks.current(spark, path).select("id", "v").collect()))
    assert sinks.compacted(spark, path) == 3 and len([x for x in os.listdir(path) if x.startswith("v")]) == 1
    assert sorted(map(tuple, sinks.current(spark, path).select("id", "v").collect())) == before and len(before) == 20
    sinks.upsert(spark.createDataFrame([(5, 999, 9)], "id long, v long, seq long"), path, "id", "v", ["seq"], slots=4)
    assert dict(sinks.current(spark, path).select("id", "v").collect())[5] == 999
    assert sinks.compacted(spark, str(tmp_path / "nothing")) == 0


def test_a_run_leaves_nothing_behind(spark, folder):
    some = spark.read.schema(SCHEMA).parquet(f"{folder}/*")
    with run_folder(spark) as path:
        n = aggregates.running_sum(some, "user_id", "vc", ["ts", "event_id"]).count()
        local = path.removeprefix("file:")
        assert n == some.count() and os.listdir(local)
    assert not os.path.exists(local) and "/run-" not in scratch(spark, "x")


def test_hashes_of_surrogate_pairs(spark):
    def java(text):
        h, data = 0, text.encode("utf-16-be")
        for i in range(0, len(data), 2):
            h = (31 * h + int.from_bytes(data[i : i + 2], "big")) & 0xFFFFFFFF
        return h - (1 << 32) if h >> 31 else h

    texts = ["", "Mary", "hello world", "é漢", "😀", "a😀b😀", "x" * 1000, "\x00"]
    got = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select(scalar.string_hash(F.col("t")).alias("h")).collect()
    assert [r["h"] for r in got] == [*map(java, texts), None] and java("Mary") == 2390779


def test_rows_are_spread_at_random(spark):
    got = rows.shuffled(spark.range(8000), 8, 1).groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.countDistinct(F.col("id") % 8).alias("kinds")).collect()
    assert len(got) == 8 and all(800 < r["n"] < 1200 and r["kinds"] == 8 for r in got)
    assert rows.shuffled(spark.range(100), 4).distinct().count() == 100


URL, DRIVER = "jdbc:derby:memory:upserts;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"


def stored(spark):
    return sorted(map(tuple, external.jdbc_query(spark, URL, "SELECT * FROM kept", DRIVER).collect()))


def test_micro_batches_go_to_a_database_once(spark, tmp_path, monkeypatch):
    batches = [[("a", 1), ("b", 2)], [("b", 3), ("c", 4)]]
    for number, rows_ in enumerate(batches):
        df = spark.createDataFrame(rows_, "k string, v int")
        for _ in range(2):  # the second time is a replay
            external.jdbc_upsert(df, URL, "kept", "k", DRIVER, number, "k VARCHAR(20)")
    assert stored(spark) == [("a", 1), ("b", 3), ("c", 4)]

    calls, real = [], external.transaction

    def flaky(*args):
        calls.append(1)
        if len(calls) < 3:
            raise RuntimeError("connection lost")
        real(*args)

    monkeypatch.setattr(external, "transaction", flaky)
    external.jdbc_upsert(spark.createDataFrame([("a", 9)], "k string, v int"), URL, "kept", "k", DRIVER, 2, "k VARCHAR(20)")
    assert len(calls) == 3 and stored(spark)[0] == ("a", 9)
    calls.clear()
    monkeypatch.setattr(external, "transaction", lambda *args: calls.append(1) or 1 / 0)
    with pytest.raises(ZeroDivisionError):
        external.jdbc_upsert(spark.createDataFrame([("a", 0)], "k string, v int"), URL, "kept", "k", DRIVER, 3, "k VARCHAR(20)", retries=2)
    assert len(calls) == 3 and stored(spark)[0] == ("a", 9)


def test_a_transaction_is_all_or_nothing(spark):
    with pytest.raises(Exception):
        external.transaction(spark, URL, DRIVER, ["INSERT INTO kept VALUES ('z', 1)", "INSERT INTO nowhere VALUES (1)"])
    assert all(k != "z" for k, _ in stored(spark))
