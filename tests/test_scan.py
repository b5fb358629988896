"""Segmented scans equal windows per key, and spread a key that holds most rows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from rillspark.operators import aggregates, scan, state
from rillspark.operators.ranges import in_ranges

ORDER = ["at", "id"]


@pytest.fixture(scope="module", autouse=True)
def many_ranges(spark):
    """Small ranges are not joined, so that keys span several."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.fixture(scope="module")
def rows(spark):
    """A key with most rows, small keys, a null key, null values, ties in time."""
    rng = random.Random(4)
    keys = [None, *["hot"] * 12, *[f"k{i}" for i in range(6)]]
    data = [(i, rng.randrange(200), rng.choice(keys), rng.choice([None, *range(20)]), rng.choice(["a", "b", None])) for i in range(4000)]
    return spark.createDataFrame(data, "id long, at long, key string, v long, kind string").withColumn("time", F.timestamp_seconds("at")).repartition(5).cache()


def line():
    return Window.partitionBy("key").orderBy(*ORDER)


def upto(end=0):
    return line().rowsBetween(Window.unboundedPreceding, end)


def same(one, two):
    key = lambda df: sorted((tuple((x is None, str(x)) for x in r) for r in df.select(*sorted(df.columns)).collect()))
    assert key(one) == key(two)


def test_values_equal_windows(rows):
    v = F.col("v")
    got = scan.scan(
        rows.select("id", "at", "key", "v", "kind"), "key", ORDER,
        sum=scan.total(v), n=scan.rows_so_far(), known=scan.known_so_far(v), high=scan.extreme(v), low=scan.extreme(v, "min"),
        first=scan.first(F.col("kind"), ORDER), last=scan.last_known(v, ORDER), held=scan.last_known(v, ORDER, -1), before=scan.previous(v, ORDER, -5), best=scan.best(v, F.col("id")),
    )
    before = upto(-1)
    want = rows.select(
        "id", "at", "key", "v", "kind", F.sum("v").over(upto()).alias("sum"), F.row_number().over(line()).alias("n"), F.count("v").over(upto()).alias("known"),
        F.max("v").over(upto()).alias("high"), F.min("v").over(upto()).alias("low"), F.first("kind").over(upto()).alias("first"), F.last("v", True).over(upto()).alias("last"),
        F.last("v", True).over(before).alias("held"), F.lag("v", 1, -5).over(line()).alias("before"),
        F.max_by("id", F.struct("v", -F.col("at"), -F.col("id"))).over(upto()).alias("best"),
    )
    same(got, want)


def test_a_hot_key_is_spread(spark, rows):
    some = in_ranges(rows, "key", *ORDER, out=scan.PART).where("key = 'hot'").groupBy(scan.PART).count().collect()
    assert len(some) >= 4 and max(r["count"] for r in some) < 1500


def test_no_range_meets_every_key(spark, rows):
    edges = scan.edges(in_ranges(rows, "key", *ORDER, out=scan.PART), "key")
    assert edges.count() <= 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    plan = scan.scan(rows, "key", ORDER, s=scan.total(F.col("v")))._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan


@pytest.mark.parametrize("kind", ["max", "min"])
def test_extremes(rows, kind):
    some = rows.where("v is not null")
    fold = F.max if kind == "max" else F.min
    got = aggregates.running_extreme(some, "key", "v", ["kind"], ORDER, kind)
    same(got, some.select("key", *ORDER, fold("v").over(upto()).alias("v"), F.first("kind").over(upto()).alias("first_kind")))
    rank = F.struct(F.col("v") if kind == "max" else -F.col("v"), -F.col("at"), -F.col("id"))
    best = F.max_by(F.struct("v", "kind"), rank).over(upto())
    same(aggregates.running_extreme_row(some, "key", "v", ["kind"], ORDER, kind), some.withColumn("b", best).select("key", *ORDER, F.col("b.v").alias("best_v"), F.col("b.kind").alias("best_kind")))


def test_lists_and_maps(rows):
    seen = rows.select("key", *ORDER, F.collect_list("v").over(upto()).alias("seen"))
    top = F.slice(F.sort_array("seen", False), 1, 3)
    same(state.top_so_far(rows, "key", "v", ORDER), seen.select("key", *ORDER, top.alias("top")))
    count = lambda x: F.concat_ws("=", x.cast("string"), F.size(F.filter("seen", lambda y: y == x)).cast("string"))
    text = F.transform(F.map_entries("counts"), lambda e: F.concat_ws("=", e["key"].cast("string"), e["value"].cast("string")))
    got = state.running_value_counts(rows, "key", "v", ORDER).select("key", *ORDER, text.alias("counts"))
    same(got, seen.select("key", *ORDER, F.transform(F.array_sort(F.array_distinct("seen")), count).alias("counts")))
    per = Window.partitionBy("key", "v").orderBy(*ORDER)
    same(state.value_count_changes(rows, "key", "v", ORDER), rows.select("key", *ORDER, "v", F.row_number().over(per).alias("n")))


def test_expiry_by_write_and_by_use(rows):
    got = state.with_expiry(rows, "key", "v", "time", ORDER, 5).select("id", "held")
    before = upto(-1)
    last = rows.withColumn("w", F.last(F.when(F.col("v").isNotNull(), F.struct("v", "at")), True).over(before))
    same(got, last.select("id", F.when(F.col("at") - F.col("w.at") < 5, F.col("w.v")).alias("held")))
    mine, held, used = {}, {}, {}
    for r in sorted(rows.collect(), key=lambda r: (r["at"], r["id"])):
        k = r["key"]
        if k in used and r["at"] - used[k] >= 2:
            held.pop(k, None)
        mine[r["id"]] = held.get(k)
        used[k] = r["at"]
        if r["v"] is not None:
            held[k] = r["v"]
    assert {r["id"]: r["held"] for r in state.with_expiry(rows, "key", "v", "time", ORDER, 2, True).collect()} == mine


def test_no_rows(rows):
    none = rows.where("false")
    assert aggregates.running_sum(none, "key", "v", ORDER).count() == 0
    assert state.top_so_far(none, "key", "v", ORDER).count() == 0
    assert state.running_value_counts(none, "key", "v", ORDER).count() == 0


def test_columns_may_have_any_names(rows):
    named = rows.select(F.col("key").alias("k"), F.col("id").alias("p"), F.col("at").alias("state"), F.col("v").alias("edge"))
    got = aggregates.running_sum(named, "k", "edge", ["state", "p"]).select("p", "running_sum")
    same(got, aggregates.running_sum(rows, "key", "v", ORDER).select(F.col("id").alias("p"), "running_sum"))
    same(state.top_so_far(named, "k", "edge", ["state", "p"]).select("p", "top"), state.top_so_far(rows, "key", "v", ORDER).select(F.col("id").alias("p"), "top"))
