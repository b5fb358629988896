"""Windows that fire again by processing time, watermarks read in the logic, seeded state, cached lookups."""

import os
import time

import pytest
from pyspark.sql import functions as F

from rillspark.functions.cache import Cache, cached_lookup
from rillspark.operators import aggregates
from rillspark.plans.base import clicks
from rillspark.sources import files
from rillspark.streaming import clocks, processors, sinks

SF = "/root/testdata/sf0.001"
SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, vc bigint"


@pytest.fixture(autouse=True)
def one_partition(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_a_stalled_window_fires_again_until_its_end(spark, tmp_path):
    """Three rows of a window that ends in some ten seconds, and no more: it comes out every two seconds, then for good."""
    size, every = 12_000, 2_000
    now = int(time.time() * 1000)
    start = now - now % size + (size if now % size > 3_000 else 0)
    rows = spark.createDataFrame([(i, (start + 100) / 1000, 1, 0) for i in range(3)], "event_id long, s double, user_id long, vc long").withColumn("ts", F.timestamp_seconds("s"))
    rows.drop("s").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("event_id bigint, user_id bigint, vc bigint, ts timestamp").parquet(f"{tmp_path}/in")
    q = processors.run(stream, "user_id", clocks.PeriodicFire(size, every)).writeStream.format("memory").queryName("periodic").start()
    for _ in range(160):
        if spark.table("periodic").where("last").count():
            break
        time.sleep(0.5)
    time.sleep(2 * every / 1000)
    q.stop()
    got = sorted(spark.table("periodic").collect(), key=lambda r: r["fire_ms"])
    assert 2 <= len(got) <= (start + size - now) // every + 2
    assert all(r["cnt"] == 3 and r["window_start_ms"] == start for r in got)
    assert [r["last"] for r in got] == [False] * (len(got) - 1) + [True] and got[-1]["fire_ms"] == start + size
    assert all(r["fire_ms"] % every == 0 for r in got)


def timed(spark, tmp_path, parts, columns="id, s, flag"):
    for i, part in enumerate(parts):
        rows = spark.createDataFrame([(k, s, 1, flag, 0) for k, s, flag in part], "event_id long, s long, user_id long, flag boolean, vc long")
        rows.withColumn("ts", F.timestamp_seconds("s")).drop("s").coalesce(1).write.parquet(f"{tmp_path}/in/f{i}")
    return files.timed_stream(spark, f"{tmp_path}/in/*", "event_id bigint, user_id bigint, flag boolean, vc bigint, ts timestamp", "ts", "10 seconds")


def shown(spark, df, tmp_path, name):
    q = sinks.memory_table(df, name, "append", str(tmp_path / "c"))
    q.awaitTermination(120)
    q.stop()
    return spark.table(name).collect()


def test_the_watermark_is_read_with_each_row(spark, tmp_path):
    """Largest times 100, 200, 210; the watermark of a file is that of the files before it, less ten seconds."""
    stream = timed(spark, tmp_path, [[(0, 50, False), (1, 100, True), (2, 60, False)], [(3, 200, False), (4, 95, False)], [(5, 195, True), (6, 210, False), (7, 191, False)]])
    got = {r["event_id"]: r for r in shown(spark, processors.run(stream, "user_id", clocks.ReadWatermark(20_000)), tmp_path, "marks")}
    assert [got[i]["watermark_ms"] for i in (0, 3, 5)] == [0, 90_000, 190_000]
    assert [got[i]["own_ms"] for i in range(8)] == [None, 30_000, 80_000, 80_000, 180_000, 180_000, 180_000, 190_000]
    assert [i for i in range(8) if got[i]["late"]] == [2, 4]


def test_only_marked_rows_move_a_punctuated_watermark(spark, tmp_path):
    stream = timed(spark, tmp_path, [[(0, 50, False), (1, 100, True), (2, 60, False)], [(3, 200, False), (4, 95, False)], [(5, 195, True), (6, 191, False)]])
    got = {r["event_id"]: r for r in shown(spark, processors.run(stream, "user_id", clocks.ReadWatermark(0, "flag")), tmp_path, "punctuated")}
    assert [got[i]["own_ms"] for i in range(7)] == [None, None, 100_000, 100_000, 100_000, 100_000, 195_000]
    assert [i for i in range(7) if got[i]["late"]] == [2, 4, 6]


def test_the_watermark_at_which_a_window_fires(spark, tmp_path):
    stream = timed(spark, tmp_path, [[(0, 5, False), (1, 20, False)], [(2, 75, False), (3, 15, False)], [(4, 140, False)]])
    got = sorted(tuple(r)[1:] for r in shown(spark, processors.run(stream, "user_id", clocks.WatermarkAtFire(60_000)), tmp_path, "fired_at"))
    assert got == [(0, 3, 65_000), (60_000, 1, 130_000)]


def test_state_seeds_another_query(spark, tmp_path):
    rows = clicks(spark, SF).cache()
    middle = rows.agg(F.percentile_approx(F.unix_micros("ts"), 0.5)).first()[0]
    parts = {"one": F.unix_micros("ts") <= middle, "two": F.unix_micros("ts") > middle}
    for name, half in parts.items():
        rows.where(half).coalesce(1).write.parquet(f"{tmp_path}/in/{name}")
    stream = lambda part: spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in/{part}")
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    first = shown(spark, processors.run(stream("one"), "user_id", processors.RunningSum()), tmp_path / "a", "first_half")
    held = clocks.state_of(spark, str(tmp_path / "a" / "c"), "sum")
    want = {r["user_id"]: r["s"] for r in rows.where(parts["one"]).groupBy("user_id").agg(F.sum("vc").alias("s")).collect()}
    assert {r["user_id"]: r["s"] for r in held.collect()} == want and clocks.live_keys(spark, str(tmp_path / "a" / "c"), "sum") == len(want)
    second = shown(spark, clocks.seeded(stream("two"), "user_id", clocks.SeededSum(), held), tmp_path / "b", "second_half")
    unbroken = aggregates.running_sum(rows, "user_id", "vc", ["ts", "event_id"]).collect()
    assert {r["event_id"]: r["running_sum"] for r in [*first, *second]} == {r["event_id"]: r["running_sum"] for r in unbroken}


def test_a_cache_asks_once_and_again(spark, tmp_path):
    calls, log = [], str(tmp_path / "calls")
    cache, call = Cache(2, 60), lambda k: calls.append(k) or (None if k == "none" else f"<{k}>")
    assert [cache.get(k, call) for k in ("a", "a", "none", "none", "b", "a", "c", "b")] == ["<a>", "<a>", None, None, "<b>", "<a>", "<c>", "<b>"]
    assert calls == ["a", "none", "none", "b", "c", "b"]  # "b" was the one used longest ago when "c" came
    short = Cache(10, 0.05)
    short.get("a", call)
    time.sleep(0.1)
    short.get("a", call)
    assert calls[-2:] == ["a", "a"]

    def slow(k):
        with open(log, "a") as f:
            f.write(f"{os.getpid()} {k}\n")
        return None if k == 3 else str(k * 10)

    rows = spark.range(1000).select((F.col("id") % 5).alias("k"), F.lit("x").alias("other")).repartition(4)
    for _ in range(2):
        got = cached_lookup(rows, f"test {tmp_path}", "k", slow).groupBy("k", "answer").count().collect()
        assert {r["k"]: r["answer"] for r in got} == {0: "0", 1: "10", 2: "20", 3: None, 4: "40"} and all(r["count"] == 200 for r in got)
    with open(log) as f:
        lines = f.read().splitlines()
    known = [x for x in lines if not x.endswith(" 3")]
    assert len(known) == len(set(known)) and sum(x.endswith(" 3") for x in lines) == 400
