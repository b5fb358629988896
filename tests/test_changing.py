"""Ranks over results that change, rules that travel with the rows, chained windows: streams equal batches."""

import json
import random

import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from rillspark.operators import joins, topn
from rillspark.plans.base import clicks
from rillspark.sources import files
from rillspark.streaming import changing, processors

SF = "/root/testdata/sf0.001"
SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, vc bigint"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The events in three files by time, and one row far ahead."""
    path, rows = str(tmp_path_factory.mktemp("changing") / "events"), clicks(spark, SF)
    nth = F.ntile(3).over(Window.orderBy("ts", "event_id")) - 1
    rows = rows.withColumn("nth", nth).cache()
    for i in range(3):
        rows.where(F.col("nth") == i).drop("nth").coalesce(1).write.parquet(f"{path}/f{i}")
    end = spark.createDataFrame([(10**9, 10**9, "end", 0)], "event_id bigint, user_id bigint, event_type string, vc bigint").withColumn("ts", F.lit("2100-01-01").cast("timestamp"))
    end.select("event_id", "ts", "user_id", "event_type", "vc").coalesce(1).write.parquet(f"{path}/f3")
    return path


@pytest.fixture(autouse=True)
def one_partition(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def stream(spark, folder, part="*", delay="1 hour"):
    return files.timed_stream(spark, f"{folder}/{part}", SCHEMA, "ts", delay)


def ran(df, out, state, mode="append"):
    """Run to the end, each micro-batch under its number."""
    write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/number={number}")
    q = df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None


def applied(rows):
    """The table that changes build up: the state of each (group, rank)."""
    table = {}
    for r in sorted(rows, key=lambda r: r["op"] in ("+I", "+U")):
        place = (r["group"], r["rank"])
        if r["op"] in ("+I", "+U"):
            table[place] = (r["item"], r["value"])
        else:
            table.pop(place, None)
    return table


def test_top_two_after_every_micro_batch(spark, folder, tmp_path):
    """Counts per user change with every micro-batch; so do the two most active ones, over a stop and a resume."""
    out, state = str(tmp_path / "out"), str(tmp_path / "c")
    for part in ("f[01]", "f[012]"):
        plain = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/{part}")
        counts = processors.run(plain, "user_id", changing.CountChanges())
        changes = changing.top_changes(counts.withColumn("group", F.lit("all")), "group", "user_id", "cnt", 2, shards=3)
        ran(changes, out, state)
    got = spark.read.schema("group string, op string, rank int, item string, value bigint, number int").parquet(out).collect()
    rows = {i: spark.read.schema(SCHEMA).parquet(f"{folder}/f{i}") for i in range(3)}
    table, seen = {}, None
    for number in range(3):
        mine = [r for r in got if r["number"] == number]
        gone = {(r["group"], r["rank"]): (r["item"], r["value"]) for r in mine if r["op"] in ("-U", "-D")}
        assert all(table[p] == v for p, v in gone.items())
        table = {p: v for p, v in table.items() if p not in gone} | applied(mine)
        seen = rows[number] if seen is None else seen.unionByName(rows[number])
        per = seen.groupBy("user_id").count().collect()
        want = sorted(((-r["count"], str(r["user_id"])) for r in per))[:2]
        assert table == {("all", k + 1): (u, -n) for k, (n, u) in enumerate(want)}


def test_ranks_over_random_changes():
    """Values that rise, fall, appear and go; the head is refilled when retractions have emptied it."""

    class Held:
        def __init__(self):
            self.v = None

        def exists(self):
            return self.v is not None

        def get(self):
            return self.v

        def update(self, v):
            self.v = v

    class Items(dict):
        def removeKey(self, k):
            del self[k]

        def updateValue(self, k, v):
            self[k] = v

        def iterator(self):
            return iter(list(self.items()))

    rng, ranks = random.Random(8), changing.Ranks(3, 1)
    ranks.items, ranks.head = Items(), Held()
    values, table, refills = {}, {}, 0
    for step in range(300):
        changes = []
        for _ in range(rng.randint(1, 6)):
            item = f"i{rng.randrange(30)}"
            if item in values:
                changes.append((item, "-U", values.pop(item)))
            if rng.random() < (0.8 if step % 60 < 40 else 0.2):
                values[item] = rng.randrange(50)
                changes.append((item, "+U", values[item]))
        rng.shuffle(changes)
        whole = ranks.head.get()[1] if ranks.head.exists() else True
        for frame in ranks.handleInputRows(("g",), iter([pd.DataFrame(changes, columns=["item", "op", "value"])]) if changes else iter([]), None):
            rows = [{"group": r.k0, "rank": r.rank, "op": r.op, "item": r.item, "value": r.value} for r in frame.itertuples()]
            for r in rows:
                if r["op"][0] == "-":
                    assert table.pop((r["group"], r["rank"])) == (r["item"], r["value"])
                else:
                    table[(r["group"], r["rank"])] = (r["item"], r["value"])
        refills += not whole and ranks.head.get()[1]
        want = sorted((-v, i) for i, v in values.items())[:3]
        assert table == {("g", k + 1): (i, -v) for k, (v, i) in enumerate(want)}
        assert len(json.loads(ranks.head.get()[0])) <= 12
    assert refills > 3


def test_thresholds_change_between_rows_of_a_micro_batch(spark, folder, tmp_path):
    rows, control = stream(spark, folder).where("event_type = 'click'"), stream(spark, folder).where("event_type = 'signup'")
    processor = changing.AboveThreshold(0.0)
    out = changing.broadcast_state(rows, control, processor, F.col("user_id"), "vc", [F.col("vc").cast("double")], "ts", "event_id", shards=3)
    ran(out, str(tmp_path / "out"), str(tmp_path / "c"))
    got = sorted(tuple(r) for r in spark.read.schema("event_id bigint, vc bigint, held double").parquet(f"{tmp_path}/out/*").collect())
    some = spark.read.schema(SCHEMA).parquet(f"{folder}/*")
    rules = some.where("event_type = 'signup'").select("ts", F.col("vc").cast("double").alias("threshold"))
    want = joins.control_threshold(some.where("event_type = 'click'").select("event_id", "ts", "vc"), rules, "ts", "vc", "threshold", 0.0)
    assert got == sorted(tuple(r) for r in want.select("event_id", "vc", "held").collect())


def test_pattern_rules_change_between_rows(spark, folder, tmp_path):
    first = F.when(F.col("event_id") % 2 == 0, "click").otherwise("view")
    rows, rules = stream(spark, folder).where("event_type not in ('signup', 'end')"), stream(spark, folder).where("event_type = 'signup'")
    out = changing.broadcast_state(rows, rules, changing.TwoActions(), F.col("user_id"), "vc", [first, F.lit("purchase")], "ts", "event_id", F.col("event_type"), shards=3)
    ran(out, str(tmp_path / "out"), str(tmp_path / "c"))
    got = sorted(r["event_id"] for r in spark.read.schema("event_id bigint").parquet(f"{tmp_path}/out/*").collect())
    some = spark.read.schema(SCHEMA).parquet(f"{folder}/f[012]")
    known = some.where("event_type = 'signup'").select("ts", "event_id", first.alias("action1"), F.lit("purchase").alias("action2"))
    want = joins.pattern_rule(some.where("event_type <> 'signup'"), known, "user_id", "event_type", ["ts", "event_id"])
    assert got and got == sorted(r["event_id"] for r in want.collect())


def test_ranks_of_closed_windows_in_one_query(spark, folder, tmp_path):
    out = changing.ranked_windows(stream(spark, folder), "ts", "4 hours", "event_type", 2)
    ran(out, str(tmp_path / "out"), str(tmp_path / "c"))
    got = spark.read.schema("window_end timestamp, item string, cnt bigint, rank int").parquet(f"{tmp_path}/out/*").where("item <> 'end'")
    want = topn.topn_per_window(spark.read.schema(SCHEMA).parquet(f"{folder}/f[012]"), "ts", "4 hours", "event_type", 2)
    key = lambda df, *c: sorted(tuple(r) for r in df.select(*c).collect())
    assert key(got.withColumn("start", (F.col("window_end") - F.expr("interval 4 hours")).cast("timestamp_ntz")), "item", "start", "cnt", "rank") == key(want, "event_type", "window_start", "cnt", "rank")
