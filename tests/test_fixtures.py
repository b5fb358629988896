"""Small inputs with results worked out by hand."""

from datetime import datetime

from pyspark.sql import functions as F

from rillspark.functions import scalar
from rillspark.operators import aggregates, joins, patterns, rows, state, topn, watermarks, windows
from rillspark.sources import external, files, generated
from rillspark.streaming import sinks


def at(df, millis="ms", out="ts"):
    return df.withColumn(out, F.timestamp_millis(millis))


def events_cumulate(spark):
    minute = 60_000
    data = [("Alice", 1_000), ("Bob", 2_000), ("Alice", 25 * minute), ("Alice", 55 * minute), ("Bob", 3_600_000 + minute), ("Cary", 3_600_000 + 40 * minute), ("Cary", 3_600_000 + 50 * minute)]
    return at(spark.createDataFrame(data, "user string, ms long"))


def test_cumulate_grows_within_a_window(spark):
    out = windows.cumulate(events_cumulate(spark), "ts", 1800, 3600, ["user"], F.count("*").alias("cnt"))
    got = {(r["user"], r["window_end"].hour * 60 + r["window_end"].minute, r["cnt"]) for r in out.collect()}
    assert got == {("Alice", 30, 2), ("Bob", 30, 1), ("Alice", 60, 3), ("Bob", 60, 1), ("Bob", 90, 1), ("Bob", 120, 1), ("Cary", 120, 2)}


def test_string_hash(spark):
    df = spark.createDataFrame([("Mary",), ("hello world",), ("",), (None,)], "s string")
    assert [r[0] for r in df.select(scalar.string_hash(F.col("s"))).collect()] == [2390779, 1794106052, 0, None]


def test_weighted_averages(spark):
    df = spark.createDataFrame([("zs", 80, 3), ("zs", 90, 4), ("zs", 95, 4), ("ls", 75, 4), ("ls", 65, 4), ("ls", 85, 4)], "name string, v int, w int")
    out = {r["name"]: (r["a"], r["b"]) for r in df.groupBy("name").agg(scalar.weighted_average(F.col("v"), F.col("w")).alias("a"), scalar.weighted_average_whole(F.col("v"), F.col("w")).alias("b")).collect()}
    assert abs(out["zs"][0] - 980 / 11) < 1e-9 and out["zs"][1] == 89 and out["ls"] == (75.0, 75)
    none = df.where("false").groupBy("name").agg(scalar.weighted_average(F.col("v"), F.col("w")).alias("a"))
    assert none.count() == 0


def test_top_two_values_keep_duplicates(spark):
    df = spark.createDataFrame([(1, x, i) for i, x in enumerate([3, 6, 12, 5, 8, 9, 4])], "k int, v int, i int")
    assert [(r["rank"], r["v"]) for r in topn.top_values(df, "k", "v", 2, ["i"]).orderBy("rank").collect()] == [(1, 12), (2, 9)]


def test_interval_join_includes_both_ends(spark):
    orders = at(spark.createDataFrame([("Mary", "o1", 5000), ("Alice", "o2", 5000), ("Bob", "o3", 20000), ("Alice", "o4", 20000), ("Cary", "o5", 51000)], "user string, id string, ms long"))
    seen = at(spark.createDataFrame([("Bob", 2000), ("Alice", 3000), ("Alice", 3500), ("Bob", 2500), ("Alice", 36000), ("Bob", 30000), ("Bob", 23000), ("Bob", 33000)], "user string, ms long"))
    out = joins.interval_join(orders, seen, "user", "ts", -5, 10)
    assert sorted((r["id"], r["right_ms"]) for r in out.collect()) == [("o2", 3000), ("o2", 3500), ("o3", 23000), ("o3", 30000)]


def test_window_join_pairs(spark):
    one = at(spark.createDataFrame([("a", 1000), ("b", 1000), ("a", 2000), ("b", 2000)], "k string, ms long"))
    two = at(spark.createDataFrame([("a", 3000), ("b", 3000), ("a", 4000), ("b", 4000)], "k string, ms long"))
    assert joins.window_join(one, two, "k", "ts", 5).count() == 8
    assert joins.window_cogroup(one, two, "k", "ts", 5, "ms").count() == 2


def test_reconcile(spark):
    app = at(spark.createDataFrame([("order-1", 1000), ("order-2", 2000)], "id string, ms long"))
    third = at(spark.createDataFrame([("order-1", 3000), ("order-3", 4000)], "id string, ms long"))
    got = {r["id"]: r["status"] for r in joins.reconcile(app, third, "id", "ts", 5).collect()}
    assert got == {"order-1": "matched", "order-2": "right missing", "order-3": "left missing"}


def logins(spark):
    data = [("user_1", "fail", 2000), ("user_1", "fail", 3000), ("user_2", "fail", 4000), ("user_1", "fail", 5000), ("user_2", "success", 6000), ("user_2", "fail", 7000), ("user_2", "fail", 8000)]
    return at(spark.createDataFrame(data, "user string, kind string, ms long"))


def test_three_in_a_row(spark):
    out = patterns.consecutive(logins(spark), "user", F.col("kind") == "fail", ["ms"], 3, "ts").collect()
    assert [(r["user"], r["time_1"].second, r["time_3"].second) for r in out] == [("user_1", 2, 5)]
    alerts = patterns.state_machine(logins(spark), "user", F.col("kind") == "fail", ["ms"], 3).collect()
    assert [(r["user"], r["streak"]) for r in alerts] == [("user_1", 3)]


def test_followed_by_has_an_open_end(spark):
    first = at(spark.createDataFrame([("o1", 0), ("o2", 0), ("o3", 0)], "k string, ms long"), out="created").drop("ms")
    then = at(spark.createDataFrame([("o1", 60_000), ("o3", 900_000)], "k string, ms long"), out="paid").drop("ms")
    got = {r["k"]: r["status"] for r in patterns.followed_by(first, then, "k", "created", "paid", 900).collect()}
    assert got == {"o1": "completed", "o2": "timeout", "o3": "timeout"}


def test_running_extremes_and_ties(spark):
    df = spark.createDataFrame([("s1", 1, 1, "a"), ("s1", 2, 11, "b"), ("s1", 3, 11, "c"), ("s1", 4, 2, "d")], "id string, i int, vc int, x string")
    got = [(r["vc"], r["first_x"]) for r in aggregates.running_extreme(df, "id", "vc", ["x"], ["i"]).orderBy("i").collect()]
    assert got == [(1, "a"), (11, "a"), (11, "a"), (11, "a")]
    got = [(r["best_vc"], r["best_x"]) for r in aggregates.running_extreme_row(df, "id", "vc", ["x"], ["i"]).orderBy("i").collect()]
    assert got == [(1, "a"), (11, "b"), (11, "b"), (11, "b")]


def test_word_count_drops_trailing_blanks(spark):
    df = spark.createDataFrame([("hello world  ",), ("hello  java",), ("",), (None,)], "text string")
    assert {r["word"]: r["cnt"] for r in aggregates.word_count(df, "text").collect()} == {"hello": 2, "world": 1, "java": 1, "": 1}


def test_keyed_sums_of_a_hundred(spark):
    df = spark.range(100).withColumnRenamed("id", "v")
    assert {r["side"]: r["sum_value"] for r in aggregates.predicate_keyed_sum(df, F.col("v") < 50, "v").collect()} == {0: 1225, 1: 3725}


def test_running_collect_grows(spark):
    df = spark.createDataFrame([("a", 1, 10), ("a", 2, 20), ("b", 1, 5)], "k string, i int, v int")
    got = [r["values"] for r in aggregates.running_collect(df, "k", "v", ["i"]).orderBy("k", "i").collect()]
    assert got == [[10], [10, 20], [5]]


def test_late_rows_against_the_watermark(spark):
    rows = [(1, 1000), (2, 12000), (3, 2000), (4, 25000), (5, 11000), (6, 9000)]
    df = at(spark.createDataFrame(rows, "i int, ms long")).withColumn("arrival", F.timestamp_seconds("i"))
    out = watermarks.split_late(df, "ts", ["arrival", "i"], 2000, 10_000, 0)
    assert {r["i"]: r["is_late"] for r in out.collect()} == {1: False, 2: False, 3: True, 4: False, 5: True, 6: True}
    kept = watermarks.split_late(df, "ts", ["arrival", "i"], 2000, 10_000, 10_000)
    assert {r["i"] for r in kept.where("is_late").collect()} == {6}


def test_state_expires(spark):
    df = at(spark.createDataFrame([("k", 1, 0, 7), ("k", 2, 3000, None), ("k", 3, 6000, None), ("k", 4, 12000, None)], "k string, i int, ms long, v int"))
    assert [r["held"] for r in state.with_expiry(df, "k", "v", "ts", ["i"], 5).orderBy("i").collect()] == [None, 7, None, None]
    assert [r["held"] for r in state.with_expiry(df, "k", "v", "ts", ["i"], 5, True).orderBy("i").collect()] == [None, 7, 7, None]


def test_periodic_count(spark):
    df = at(spark.createDataFrame([("a", 0), ("a", 5000), ("a", 10000), ("a", 10001), ("a", 30000)], "k string, ms long"))
    got = [(r["fire_time"].second, r["cnt"]) for r in state.periodic_count(df, "k", "ts", ["ms"], 10).orderBy("fire_time").collect()]
    assert got == [(10, 3), (20, 4), (40, 5)]


def test_parse_lines_marks_bad_ones(spark):
    df = spark.createDataFrame([("s1, 1 ,10",), ("s1,x,10",), ("s1,1",), (None,)], "value string")
    assert [r["ok"] for r in rows.parse_lines(df, {"id": "string", "ts": "bigint", "vc": "int"}).collect()] == [True, False, False, False]


def test_changelog(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2)], "k string, i int")
    assert [(r["op"], r["cnt"]) for r in rows.changelog(df, "k", ["i"]).orderBy("i", "cnt").collect()] == [("+I", 1), ("-U", 1), ("+U", 2)]


def test_control_threshold_takes_the_last_control(spark):
    data = at(spark.createDataFrame([(1, 1000, 5), (2, 3000, 5), (3, 5000, 5)], "i int, ms long, v int")).drop("ms")
    control = at(spark.createDataFrame([(2000, 10.0), (4000, 3.0)], "ms long, threshold double")).drop("ms")
    assert {r["i"] for r in joins.control_threshold(data, control, "ts", "v", "threshold", 0.0).collect()} == {1, 3}


def test_generated_sources(spark):
    assert generated.sequence(spark, 1, 30).agg(F.sum("id")).first()[0] == 465
    assert generated.collection(spark, [(1, "a")], "i int, s string").count() == 1
    keys = generated.generated(spark, 100, lambda i: {"key": generated.key_of_mode(i, "rise and fall", 10, 5), "batch": F.floor(i / 10)})
    assert [r["n"] for r in keys.groupBy("batch").agg(F.count_distinct("key").alias("n")).orderBy("batch").collect()] == [1, 2, 3, 4, 5, 5, 4, 3, 2, 1]
    made = generated.datagen_table(spark, "made", 50, {"id": ("sequence", 1, 5), "vc": ("random", 1, 100)})
    assert made.agg(F.min("id"), F.max("id")).first()[:] == (1, 5) and made.where("vc < 1 or vc > 100").count() == 0


def test_partitioned_source(spark):
    spark.dataSource.register(generated.PartitionedSource)
    out = spark.read.format("shares").option("count", "10").option("parts", "2").load()
    assert sorted((r["value"], r["instance"]) for r in out.collect()) == [(i, i % 2) for i in range(10)]


def test_kafka_frames_and_options(spark):
    options = external.kafka_options("h:9092", "t", "g", "latest", committed_only=True)
    assert options["kafka.isolation.level"] == "read_committed" and options["startingOffsets"] == "latest"
    df = spark.createDataFrame([("s1,1,2",)], "line string")
    row = external.kafka_keyed(df, "line").first()
    assert bytes(row["key"]) == b"s1" and bytes(row["value"]) == b"s1,1,2"
    assert external.decoded(external.kafka_values(df, "line")).first()["value"] == "s1,1,2"


def test_jdbc_round_trip(spark):
    url, driver = "jdbc:derby:memory:shop;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    external.jdbc_insert(spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "channel string, days int"), url, "visits", driver)
    out = external.jdbc_query(spark, url, "SELECT * FROM visits WHERE \"days\" > 1", driver)
    out = out.toDF(*[c.lower() for c in out.columns])
    assert sorted(tuple(r) for r in out.groupBy("channel").agg(F.sum("days")).collect()) == [("a", 2), ("b", 3)]


def test_change_feed_marks_bad_lines(spark):
    df = spark.createDataFrame([('{"db":"d","tableName":"t","after":{"k":"1"},"op":"CREATE"}',), ("nothing",)], "value string")
    assert [r["op"] for r in files.change_feed(df).collect()] == ["CREATE", None]


def test_upsert_keeps_the_last_write(spark, tmp_path):
    path = str(tmp_path / "kv")
    first = spark.createDataFrame([("a", "x", 1), ("b", "y", 2)], "k string, v string, i int")
    sinks.upsert(first, path, "k", "v", ["i"])
    sinks.upsert(spark.createDataFrame([("a", "z", 3), ("b", "old", 1)], "k string, v string, i int"), path, "k", "v", ["i"])
    assert {r["k"]: r["v"] for r in sinks.current(spark, path).collect()} == {"a": "z", "b": "y"}


def test_async_falls_back_after_the_timeout(spark):
    import time

    df = spark.createDataFrame([(1,), (2,)], "i int")
    call = lambda row: (time.sleep(0.4 if row["i"] == 2 else 0), {"i": row["i"], "answer": "called"})[1]
    out = joins.async_enrich(df, call, "i int, answer string", lambda row: {"i": row["i"], "answer": "passed on"}, 4, 0.1)
    assert {r["i"]: r["answer"] for r in out.collect()} == {1: "called", 2: "passed on"}


def test_json_and_label(spark):
    df = spark.createDataFrame([('{"a":1}', datetime(2024, 1, 1, 0, 0, 10))], "j string, t timestamp")
    assert df.select(scalar.from_json(F.col("j"), "map<string,int>")["a"]).first()[0] == 1
    assert df.select(scalar.window_label(F.col("t"), F.col("t"), F.lit(2).cast("bigint"))).first()[0].startswith("window [")


def test_udfs_by_name(spark):
    scalar.register(spark)
    out = spark.sql("SELECT weighted_average(v, w) AS a FROM VALUES (80, 3), (90, 1) AS t(v, w)").first()
    assert abs(out["a"] - 82.5) < 1e-9
