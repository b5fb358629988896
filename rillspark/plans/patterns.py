from __future__ import annotations

from pyspark.sql import functions as F

from rillspark.operators import patterns as P
from rillspark.operators.automata import Pattern, matches
from rillspark.plans.base import A, E, arrivals, clicks, table
from rillspark.plans.registry import query



def hit():
    return F.col("event_type") == "error"


LINE = "(PARTITION BY user_id ORDER BY ts, event_id)"


def runs(n: int) -> str:
    leads = ", ".join(f"lead(ts, {k}) OVER {LINE} AS time_{k + 1}, lead(event_type, {k}) OVER {LINE} AS e{k + 1}" for k in range(n))
    return f"SELECT user_id, {', '.join(f'time_{k + 1}' for k in range(n))} FROM (SELECT user_id, {leads} FROM {E}) WHERE {' AND '.join(f"e{k + 1} = 'error'" for k in range(n))}"


def alerts(spark, sf, pattern: Pattern):
    """The times of each match's rows."""
    rows = clicks(spark, sf).withColumn("us", F.unix_micros("ts"))
    found = matches(rows, pattern, "user_id", "ts", ["event_id"], ["us"])
    time = lambda i: F.timestamp_micros(F.get("events", i)["row"]["us"]).cast("timestamp_ntz").alias(f"time_{i + 1}")
    return found.select("user_id", *[time(i) for i in range(len(pattern.steps))])


@query("k01_pattern_next3", runs(3))
def pattern_next3(spark, sf):
    return alerts(spark, sf, Pattern.begin("first", hit()).next("second", hit()).next("third", hit()))


@query("k02_pattern_times_consecutive", runs(2))
def pattern_times(spark, sf):
    return alerts(spark, sf, Pattern.begin("fail", hit()).times(2, consecutive=True))


@query(
    "k03_state_machine",
    f"SELECT user_id, event_id, streak::BIGINT AS streak FROM (SELECT *, sum((event_type = 'error')::INT) OVER (PARTITION BY user_id, resets ORDER BY arr, event_id) AS streak FROM (SELECT *, sum((event_type <> 'error')::INT) OVER (PARTITION BY user_id ORDER BY arr, event_id) AS resets FROM {A})) WHERE event_type = 'error' AND streak >= 3",
)
def state_machine(spark, sf):
    return P.state_machine(arrivals(spark, sf), "user_id", hit(), ["arrival", "event_id"], 3).select("user_id", "event_id", "streak")


PAY = "FROM orders o LEFT JOIN (SELECT l_orderkey, l_shipdate FROM lineitem) l ON o.o_orderkey = l.l_orderkey AND l_shipdate >= o_orderdate AND l_shipdate < o_orderdate + INTERVAL 90 DAY"


def paid(spark, sf):
    """Of each order its first shipment within 90 days, as a pattern over both tables' rows; at one time orders come first."""
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), "o_custkey", F.col("o_orderdate").cast("timestamp").alias("at"), F.lit(0).alias("kind"))
    ships = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.lit(None).cast("bigint").alias("o_custkey"), F.col("l_shipdate").cast("timestamp").alias("at"), F.lit(1).alias("kind"))
    rows = orders.unionByName(ships).withColumn("us", F.unix_micros("at"))
    pattern = Pattern.begin("create", F.col("kind") == 0).followed_by("pay", F.col("kind") == 1).within(90 * 86400)
    found = matches(rows, pattern, "k", "at", ["kind"], ["us", "o_custkey"])
    return found.select("k", F.get("events", 0)["row"]["o_custkey"].alias("o_custkey"), F.timestamp_micros(F.get("events", 1)["row"]["us"]).cast("timestamp_ntz").alias("matched_time"), "status")


@query("k04_pattern_followed_by_within", f"SELECT o_orderkey AS k, min(l_shipdate) AS matched_time {PAY} GROUP BY 1 HAVING min(l_shipdate) IS NOT NULL")
def pattern_followed_by(spark, sf):
    return paid(spark, sf).where("status = 'matched'").select("k", "matched_time")


@query("k05_pattern_timeout", f"SELECT o_orderkey AS k, o_custkey, 'timeout' AS status {PAY} GROUP BY 1, 2 HAVING min(l_shipdate) IS NULL")
def pattern_timeout(spark, sf):
    return paid(spark, sf).where("status = 'timeout'").select("k", "o_custkey", "status")
