"""A stream over several files gives the batch form's rows; a query that stops and resumes gives those of an unbroken one."""

import time

import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from rillspark.operators import aggregates, joins, patterns, rows, state, topn, windows
from rillspark.plans.base import clicks
from rillspark.sources import files
from rillspark.streaming import processors, queries, sinks

SF = "/root/testdata/sf0.001"
SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, vc bigint"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The events as three files, in order of time, and one far-future row that closes all windows."""
    path = str(tmp_path_factory.mktemp("stream") / "events")
    some = clicks(spark, SF).orderBy("event_id").toPandas()
    some["ts"] = some["ts"].dt.tz_localize("UTC") if some["ts"].dt.tz is None else some["ts"]
    n = len(some)
    cuts = [some.iloc[: n // 3], some.iloc[n // 3 : 2 * n // 3], some.iloc[2 * n // 3 :]]
    last = pd.DataFrame({"event_id": [10**9], "ts": [pd.Timestamp("2100-01-01", tz="UTC")], "user_id": [10**9], "event_type": ["end"], "vc": [0]})
    for i, part in enumerate([*cuts, last]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{path}/f{i}")
    return path


def stream(spark, folder, delay="1 hour"):
    return files.timed_stream(spark, f"{folder}/*", SCHEMA, "ts", delay)


def batch(spark, folder):
    return spark.read.schema(SCHEMA).parquet(f"{folder}/*").where("event_type <> 'end'")


def drained(spark, df, tmp_path, mode="append"):
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    name = f"t{abs(hash(str(tmp_path)))}"
    query = sinks.memory_table(df, name, mode, str(tmp_path / "checkpoint"))
    query.awaitTermination(180)
    query.stop()
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    return spark.table(name)


def same(one, two, columns):
    key = lambda df: sorted(tuple(r) for r in df.select(*columns).collect())
    assert key(one) == key(two)


def test_windows_close_once(spark, folder, tmp_path):
    out = drained(spark, queries.closed_windows(stream(spark, folder), "ts", "1 hour", ["event_type"], F.count("*").alias("cnt")), tmp_path)
    want = windows.windowed(batch(spark, folder), "ts", "1 hour", ["event_type"], F.count("*").alias("cnt"))
    same(out.where("event_type <> 'end'"), want, ["event_type", "window_start", "cnt"])


def test_cumulated_windows_grow(spark, folder, tmp_path):
    plain = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
    out = drained(spark, queries.cumulated(plain, "ts", 900, 3600, ["event_type"], 3600), tmp_path)
    want = windows.cumulate(batch(spark, folder), "ts", 900, 3600, ["event_type"], F.count("*").alias("cnt"))
    same(out.where("event_type <> 'end'"), want, ["event_type", "window_start", "window_end", "cnt"])


def test_sessions(spark, folder, tmp_path):
    for name, gap in (("fixed", "2 hours"), ("own", F.when(F.col("user_id") % 2 == 0, "1 hour").otherwise("3 hours"))):
        make = lambda df, gap=gap: windows.session(df, "ts", gap, ["user_id"], F.count("*").alias("cnt"))
        (tmp_path / name).mkdir()
        out = drained(spark, make(stream(spark, folder)), tmp_path / name)
        same(out.where("user_id < 1000000000"), make(batch(spark, folder)), ["user_id", "window_start", "window_end", "cnt"])


def test_cogrouped_windows(spark, folder, tmp_path):
    kind = lambda df, name: df.where(F.col("event_type").isin(name, "end"))
    rows_ = stream(spark, folder)
    out = drained(spark, queries.cogrouped(kind(rows_, "click"), kind(rows_, "purchase"), "user_id", "ts", "1 day", "event_id"), tmp_path)
    some = batch(spark, folder)
    want = joins.window_cogroup(kind(some, "click"), kind(some, "purchase"), "user_id", "ts", 86400, "event_id")
    same(out.where("user_id < 1000000000"), want, ["user_id", "left_values", "right_values"])


def test_late_rows_fire_again_or_go_aside(spark, tmp_path):
    """Three files; the watermark of each is the largest time before it less 10 s, and windows stay open 60 s longer."""
    parts = [[5, 20, 130], [15, 140, 250], [30, 70, 131, 260]]
    for i, part in enumerate(parts):
        rows_ = spark.createDataFrame([(100 * i + k, s) for k, s in enumerate(part)], "event_id long, s long")
        rows_.select("event_id", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.parquet(f"{tmp_path}/in/f{i}")
    write = queries.late_windows_writer("ts", 60, 10, 60, f"{tmp_path}/out")
    for folders in ("f[01]", "*"):  # stopped after two files and resumed
        plain = spark.readStream.schema("event_id bigint, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/{folders}")
        sinks.each_batch(plain, write, f"{tmp_path}/c").awaitTermination(120)
    got = sorted((r["number"], r["window_start"].minute, r["cnt"]) for r in queries.fired_windows(spark, f"{tmp_path}/out").collect())
    # The first window closes for good at 120 s, the watermark of the second file, and that of 120 s at 240 s, that of the third.
    assert got == [(0, 0, 2), (0, 2, 1), (1, 2, 2), (1, 4, 1), (2, 4, 2)]
    late = sorted(r["event_id"] for r in spark.read.schema("event_id bigint").parquet(f"{tmp_path}/out/late").collect())
    assert late == [100, 200, 201, 202]


def test_unique_visitors(spark, folder, tmp_path):
    out = drained(spark, queries.unique_visitors(stream(spark, folder), "ts", "1 day", "user_id"), tmp_path)
    want = windows.windowed(batch(spark, folder), "ts", "1 day", [], F.count_distinct("user_id").alias("visitors"))
    same(out.where("window_start < '2090-01-01'"), want, ["window_start", "visitors"])


def test_word_count_updates(spark, folder, tmp_path):
    out = drained(spark, aggregates.word_count(stream(spark, folder), "event_type"), tmp_path, "complete")
    same(out.where("word <> 'end'"), aggregates.word_count(batch(spark, folder), "event_type"), ["word", "cnt"])


def test_rows_pass_through(spark, folder, tmp_path):
    make = lambda df: rows.side_alerts(df, F.col("vc") > 200).select("event_id", "output")
    out = drained(spark, make(stream(spark, folder)), tmp_path)
    same(out.where("event_id < 1000000000"), make(batch(spark, folder)), ["event_id", "output"])


def test_interval_join(spark, folder, tmp_path):
    kind = lambda df, name: df.where(F.col("event_type") == name).select("event_id", "user_id", "ts")
    df = joins.stream_interval_join(kind(stream(spark, folder), "click"), kind(stream(spark, folder), "purchase"), "user_id", "ts", -3600, 7200)
    want = joins.interval_join(kind(batch(spark, folder), "click"), kind(batch(spark, folder), "purchase"), "user_id", "ts", -3600, 7200)
    same(drained(spark, df, tmp_path), want, ["event_id", "right_event_id"])


def test_queue_ids_are_consumed_once(spark, folder, tmp_path):
    df = files.once_per_id_stream(stream(spark, folder, "60 days").withColumn("id", F.col("user_id").cast("string")), "id").select("id")
    assert drained(spark, df, tmp_path).where("id <> '1000000000'").count() == batch(spark, folder).select("user_id").distinct().count()


ORDER = ["ts", "event_id"]


@pytest.mark.parametrize(
    "processor, want",
    [
        (processors.RunningSum(), lambda df: aggregates.running_sum(df, "user_id", "vc", ORDER)),
        (processors.RunningExtreme("max", "event_type"), lambda df: aggregates.running_extreme(df, "user_id", "vc", ["event_type"], ORDER).withColumnRenamed("vc", "best_value")),
        (processors.RunningExtreme("min", "event_type", True), lambda df: aggregates.running_extreme_row(df, "user_id", "vc", ["event_type"], ORDER, "min").withColumnRenamed("best_vc", "best_value")),
        (processors.RunningReduce(), lambda df: aggregates.running_reduce(df, "user_id", "vc", "ts", ORDER)),
        (processors.RunningAverage(), lambda df: state.running_average(df, "user_id", "vc", ORDER)),
        (processors.FiveStates("event_type"), lambda df: state.running_five_states(df, "user_id", "vc", "event_type", "ts", ORDER)),
        (processors.JumpAlert(10), lambda df: state.jump_alerts(df, "user_id", "vc", ORDER, 10)),
        (processors.AverageEvery(5), lambda df: state.average_every(df, "user_id", "vc", ORDER, 5)),
        (processors.RowsAverage(4), lambda df: topn.rows_average(df, "user_id", "vc", ORDER, 3)),
        (processors.Changelog(), lambda df: rows.changelog(df, "user_id", ORDER)),
        (processors.CountWindow(5), lambda df: windows.count_tumbling(df, "user_id", 5, ORDER, F.sum("vc").alias("sum_value"))),
        (processors.SlidingCount(5, 2), lambda df: windows.count_sliding(df, "user_id", 5, 2, ORDER, sum_value=F.sum("vc"))),
        (processors.TopSoFar(3), lambda df: state.top_so_far(df, "user_id", "vc", ORDER, 3).withColumn("top", F.array_join(F.transform("top", lambda x: x.cast("string")), ","))),
        (processors.HitStreak("event_type", "error", 2), lambda df: patterns.state_machine(df, "user_id", F.col("event_type") == "error", ORDER, 2)),
        (processors.ConsecutiveHits("event_type", "error", 2), lambda df: patterns.consecutive(df, "user_id", F.col("event_type") == "error", ORDER, 2, "event_id", None).toDF("user_id", "first_id", "last_id")),
        (processors.ValueCounts(), lambda df: df.withColumn("n", F.row_number().over(Window.partitionBy("user_id", "vc").orderBy(*ORDER)))),
    ],
    ids=lambda x: type(x).__name__ if isinstance(x, processors.StatefulProcessor) else "",
)
def test_processors_equal_batch(spark, folder, tmp_path, processor, want):
    out = drained(spark, processors.run(stream(spark, folder), "user_id", processor), tmp_path)
    columns = [c for c in processor.columns if c != "value"] + (["vc"] if "value" in processor.columns else [])
    rename = {"vc": "value"} if isinstance(processor, processors.FiveStates) else {}
    want_rows = want(batch(spark, folder))
    same(out.where("user_id < 1000000000"), want_rows.withColumnsRenamed({v: k for k, v in rename.items()}), columns)


def test_processors_take_other_columns(spark, folder, tmp_path):
    named = lambda df: df.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("who"), F.col("ts").alias("at time"), F.col("event_id").alias("no"), (F.col("vc") / 4).alias("price"))
    named = lambda df, f=named: f(df).withColumnRenamed("at time", "when_")
    out = drained(spark, processors.run(named(stream(spark, folder)), "who", processors.RunningSum(), "price", ("when_", "no")), tmp_path)
    want = aggregates.running_sum(named(batch(spark, folder)), "who", "price", ["when_", "no"])
    same(out.where("who <> 'u1000000000'").withColumn("running_sum", F.round("running_sum", 6)), want.withColumn("running_sum", F.round("running_sum", 6)), ["who", "no", "running_sum"])


def test_processing_timers_fire(spark, folder, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    some = spark.readStream.schema(SCHEMA).parquet(f"{folder}/f0")
    q = processors.run(some, "user_id", processors.ProcessingTimer(100)).writeStream.format("memory").queryName("proc_timers").start()
    want = {r["user_id"]: r["n"] for r in spark.read.schema(SCHEMA).parquet(f"{folder}/f0").groupBy("user_id").agg(F.count("*").alias("n")).collect()}
    for _ in range(120):
        if spark.table("proc_timers").count() >= len(want):
            break
        time.sleep(0.5)
    q.stop()
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert {r["user_id"]: r["set_by"] for r in spark.table("proc_timers").collect()} == want


@pytest.mark.parametrize("processor", [processors.RunningSum(), processors.FiveStates("event_type")], ids=lambda x: type(x).__name__)
def test_state_outlives_a_restart(spark, folder, tmp_path, processor):
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    out = str(tmp_path / "out")
    write = lambda df, number: df.write.mode("overwrite").parquet(f"{out}/number={number}")
    for part in (f"{folder}/f[01]", f"{folder}/*"):
        df = processors.run(files.timed_stream(spark, part, SCHEMA, "ts", "1 hour"), "user_id", processor)
        sinks.each_batch(df, write, str(tmp_path / "c")).awaitTermination(180)
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    got = spark.read.schema(processor.schema).parquet(f"{out}/number=*").where("user_id < 1000000000")
    column = "running_sum" if "running_sum" in processor.columns else "reduced"
    want = aggregates.running_sum(batch(spark, folder), "user_id", "vc", ORDER).withColumnRenamed("running_sum", column)
    same(got, want, ["user_id", "event_id", column])


def test_top_list_over_everything(spark, folder, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    counts = stream(spark, folder).where("event_type <> 'end'").groupBy("user_id").agg(F.count("*").alias("cnt"))
    out = str(tmp_path / "top")
    q = counts.writeStream.outputMode("complete").foreachBatch(queries.rank_all_writer(out, "user_id", 3)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    got = spark.read.schema("user_id bigint, cnt bigint, number int").parquet(f"{out}/number=*")
    last = got.agg(F.max("number")).first()[0]
    same(got.where(F.col("number") == last), topn.topn_global(batch(spark, folder), "user_id", 3), ["user_id", "cnt"])


def test_lines_from_a_socket(spark):
    import socket
    import threading

    from rillspark.sources import external

    server = socket.create_server(("127.0.0.1", 0))

    def serve():
        conn, _ = server.accept()
        conn.sendall(b"one two\nthree\n")
        time.sleep(20)
        conn.close()

    threading.Thread(target=serve, daemon=True).start()
    q = sinks.memory_table_live(external.socket_stream(spark, "127.0.0.1", server.getsockname()[1]), "socket_lines")
    for _ in range(60):
        if spark.table("socket_lines").count() == 2:
            break
        time.sleep(0.5)
    q.stop()
    assert sorted(r["value"] for r in spark.table("socket_lines").collect()) == ["one two", "three"]


def test_console_takes_all_rows(spark, folder):
    """What it prints goes to the JVM's own output, which a test can't read; what it took is in its progress.

    No condition is pushed into the scan, so every row of every file is read, and goes on to the sink.
    """
    q = sinks.console(stream(spark, folder).select("event_id"), "row")
    q.processAllAvailable()
    done = q.recentProgress
    q.stop()
    total = batch(spark, folder).count() + 1
    assert q.exception() is None and sum(p["numInputRows"] for p in done) == total
    assert all(p["sink"]["description"].startswith("org.apache.spark.sql.execution.streaming") or "onsole" in p["sink"]["description"] for p in done)


def test_event_timers_fire_once_each(spark, folder, tmp_path):
    out = drained(spark, processors.run(stream(spark, folder), "user_id", processors.EventTimer(10_000)), tmp_path)
    want = state.event_timers(batch(spark, folder), "user_id", "ts", 10).withColumn("fire_ms", F.unix_millis(F.col("fire_time").cast("timestamp")))
    same(out.where("user_id < 1000000000"), want, ["user_id", "fire_ms", "set_by"])


def test_windows_kept_by_hand_fire_early(spark, folder, tmp_path):
    out = drained(spark, processors.run(stream(spark, folder), "user_id", processors.ManualWindow(3_600_000, 900_000)), tmp_path)
    want = windows.cumulate(batch(spark, folder), "ts", 900, 3600, ["user_id"], F.count("*").alias("cnt"))
    ms = lambda c: F.unix_millis(F.col(c).cast("timestamp"))
    same(out.where("user_id < 1000000000"), want.withColumn("window_start_ms", ms("window_start")).withColumn("fire_ms", ms("window_end")), ["user_id", "window_start_ms", "fire_ms", "cnt"])


def test_bills_are_reconciled(spark, folder, tmp_path):
    day = lambda df: df.withColumn("bill", F.concat_ws(":", F.col("user_id").cast("string"), F.floor(F.unix_seconds("ts") / 86400).cast("string")))
    halves = day(batch(spark, folder)).where("event_type IN ('click', 'purchase')").groupBy("bill", "event_type").agg(F.min_by("event_id", "ts").alias("event_id"))
    first = [r["event_id"] for r in halves.collect()]
    some = lambda df: day(df).where(F.col("event_id").isin(*first) | (F.col("event_type") == "end"))
    out = drained(spark, processors.run(some(stream(spark, folder)), "bill", processors.Reconcile("event_type", "click", 3_600_000)), tmp_path)
    got = {r["bill"]: r["n"] for r in out.where("status = 'matched'").groupBy("bill").agg(F.count("*").alias("n")).collect()}
    side = lambda name: some(batch(spark, folder)).where(F.col("event_type") == name).select("bill", "ts")
    want = joins.reconcile(side("click"), side("purchase"), "bill", "ts", 3600)
    assert got == {r["bill"]: 1 for r in want.where("status = 'matched'").collect()}
    missing = lambda df: {(r["bill"], r["status"]) for r in df.where("status like '%missing'").collect()}
    assert missing(want) <= missing(out)


def test_followed_by_completes_or_times_out(spark, folder, tmp_path):
    out = drained(spark, processors.run(stream(spark, folder), "user_id", processors.FollowedBy("event_type", "click", "purchase", 86_400_000)), tmp_path)
    some = batch(spark, folder)
    first = some.where("event_type = 'click'").select("user_id", F.col("event_id").alias("first_id"), "ts")
    want = patterns.followed_by(first, some.where("event_type = 'purchase'"), "user_id", "ts", "ts", 86_400)
    same(out.where("user_id < 1000000000"), want, ["user_id", "first_id", "status"])


def test_expiring_value_is_forgotten(spark, tmp_path):
    data = [(1, "2024-01-01 00:00:00", 1, 5), (2, "2024-01-01 00:00:01", 1, None), (3, "2024-01-01 00:00:02", 1, None)]
    rows_ = spark.createDataFrame(data, "event_id long, ts string, user_id long, vc long").withColumn("ts", F.col("ts").cast("timestamp"))
    for i in (1, 2, 3):
        rows_.where(F.col("event_id") == i).coalesce(1).write.parquet(f"{tmp_path}/in/f{i}")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    for ttl_ms, want in ((1, [None, None, None]), (3_600_000, [None, 5, 5])):
        df = files.timed_stream(spark, f"{tmp_path}/in/*", "event_id bigint, ts timestamp, user_id bigint, vc bigint", "ts", "1 hour")
        name = f"expired_{ttl_ms}"
        q = processors.run(df, "user_id", processors.ExpiringValue(ttl_ms)).writeStream.format("memory").queryName(name).start()
        for _ in range(80):
            if spark.table(name).count() == 3:
                break
            time.sleep(0.5)
        q.stop()
        assert [r["held"] for r in spark.table(name).orderBy("event_id").collect()] == want
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_timers_fire_after_the_watermark(spark, folder, tmp_path):
    """The first timer of a key fires with all rows of the micro-batches that came before the watermark passed it."""
    out = drained(spark, processors.run(stream(spark, folder, "1 second"), "user_id", processors.TimedCount(3_600_000)), tmp_path)
    some = batch(spark, folder).withColumn("file", F.regexp_extract(F.input_file_name(), r"/f(\d)/", 1).cast("int")).select("user_id", "ts", "file").toPandas()
    tops = some.groupby("file")["ts"].max()
    fired = out.where("user_id < 1000000000").toPandas()
    assert set(fired["user_id"]) == set(some["user_id"])
    for user, mine in some.groupby("user_id"):
        came = mine[mine["file"] == mine["file"].min()]
        fire = came["ts"].min() + pd.Timedelta(hours=1)
        first = fired[fired["user_id"] == user].sort_values("fire_ms").iloc[0]
        assert first["fire_ms"] == int(fire.timestamp() * 1000)
        passed = [f for f in tops.index if tops[f] - pd.Timedelta(seconds=1) > fire]
        last = min(passed) if passed else 2
        assert first["cnt"] == (mine["file"] <= last).sum() or first["cnt"] == (mine["file"] <= min(last + 1, 2)).sum()


def test_restart_continues_from_the_checkpoint(spark, folder, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    written = []

    def write(df, number):
        written.append(number)
        df.write.mode("overwrite").parquet(f"{out}/batch={number}")

    for part in (f"{folder}/f[01]", f"{folder}/*"):
        df = files.timed_stream(spark, part, SCHEMA, "ts", "1 hour")
        q = sinks.each_batch(df, write, checkpoint)
        q.awaitTermination(120)
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert written == sorted(set(written))
    got = spark.read.schema(SCHEMA).parquet(f"{out}/*")
    same(got.where("event_type <> 'end'"), batch(spark, folder), ["event_id", "vc"])


def test_custom_writer_and_files(spark, folder, tmp_path):
    path = str(tmp_path / "rows")

    class Writer(sinks.RowWriter):
        def write(self, row):
            with open(path, "a") as f:
                f.write(f"{row.event_id}\n")

    q = sinks.custom(stream(spark, folder).select("event_id"), Writer(), str(tmp_path / "c"))
    q.awaitTermination(120)
    with open(path) as f:
        assert len(f.readlines()) == batch(spark, folder).count() + 1


def test_top_keys_of_closed_windows(spark, folder, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    counts = queries.closed_windows(stream(spark, folder), "ts", "4 hours", ["event_type"], F.count("*").alias("cnt"))
    out = str(tmp_path / "ranks")
    q = sinks.each_batch(counts, queries.rank_closed_windows(out, "event_type", 2), str(tmp_path / "c"))
    q.awaitTermination(120)
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    got = spark.read.option("mergeSchema", True).parquet(f"{out}/*").where("event_type <> 'end'")
    same(got, topn.topn_per_window(batch(spark, folder), "ts", "4 hours", "event_type", 2), ["event_type", "window_start", "cnt", "rank"])


def test_threshold_from_a_control_table(spark, folder, tmp_path):
    out = str(tmp_path / "above")
    control = lambda: spark.createDataFrame([(1, 50.0), (2, 200.0)], "seq int, threshold double")
    q = sinks.each_batch(stream(spark, folder), queries.control_writer(control, "vc", "threshold", 0.0, out), str(tmp_path / "c"))
    q.awaitTermination(120)
    assert spark.read.parquet(f"{out}/*").count() == batch(spark, folder).where("vc > 200").count()
