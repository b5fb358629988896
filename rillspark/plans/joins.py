from __future__ import annotations

from pyspark.sql import functions as F

from rillspark.functions import cache
from rillspark.operators import joins as J
from rillspark.operators.watermarks import split_late
from rillspark.plans.base import A, DAY, E, HOUR, arrivals, clicks, naive, table
from rillspark.plans.registry import query

C, P = f"(SELECT * FROM {E} WHERE event_type = 'click')", f"(SELECT * FROM {E} WHERE event_type = 'purchase')"


def sides(spark, sf):
    rows = clicks(spark, sf)
    return rows.where("event_type = 'click'"), rows.where("event_type = 'purchase'")


@query("g01_window_join", f"SELECT a.user_id, a.event_id, b.event_id AS right_event_id FROM {C} a JOIN {P} b ON a.user_id = b.user_id AND a.us // {DAY} = b.us // {DAY}")
def window_join(spark, sf):
    return J.window_join(*sides(spark, sf), "user_id", "ts", 86400).select("user_id", "event_id", "right_event_id")


def lists(side: str) -> str:
    return f"(SELECT user_id, us // {DAY} AS bucket, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS v FROM {side} GROUP BY 1, 2)"


@query("g02_window_cogroup", f"SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.bucket, b.bucket) AS bucket, coalesce(a.v, '') AS left_values, coalesce(b.v, '') AS right_values FROM {lists(C)} a FULL JOIN {lists(P)} b ON a.user_id = b.user_id AND a.bucket = b.bucket")
def window_cogroup(spark, sf):
    out = J.window_cogroup(*sides(spark, sf), "user_id", "ts", 86400, "event_id")
    return out.withColumns({c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",") for c in ("left_values", "right_values")})


BETWEEN = f"b.us BETWEEN a.us - {HOUR} AND a.us + {2 * HOUR}"


@query("g03_interval_join", f"SELECT a.user_id, a.event_id, b.event_id AS right_event_id FROM {C} a JOIN {P} b ON a.user_id = b.user_id AND {BETWEEN}")
def interval_join(spark, sf):
    return J.interval_join(*sides(spark, sf), "user_id", "ts", -3600, 7200).select("user_id", "event_id", "right_event_id")


ML = f"(SELECT *, us // 1000 AS ms, lag(wm) OVER (ORDER BY arr, event_id) AS wm0 FROM (SELECT *, max(us // 1000) OVER (ORDER BY arr, event_id ROWS UNBOUNDED PRECEDING) - 60001 AS wm FROM {A}))"
INTIME = f"(SELECT * FROM {ML} WHERE NOT coalesce(ms < wm0, false))"


@query(
    "g04_interval_join_late",
    f"SELECT a.event_id, b.event_id AS right_event_id, 'main' AS output FROM {INTIME} a JOIN {INTIME} b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'purchase' AND {BETWEEN} UNION ALL SELECT event_id, NULL, CASE event_type WHEN 'click' THEN 'left late' ELSE 'right late' END FROM {ML} WHERE event_type IN ('click', 'purchase') AND coalesce(ms < wm0, false)",
)
def interval_join_late(spark, sf):
    """Late is a row behind the joint watermark, so the window that decides is one millisecond wide."""
    rows = split_late(arrivals(spark, sf), "ts", ["arrival", "event_id"], 60_000, 1)
    left, right = rows.where("event_type = 'click'"), rows.where("event_type = 'purchase'")
    on_time = ~F.col("is_late")
    pairs = J.interval_join(left.where(on_time).select("user_id", "event_id", "ts"), right.where(on_time).select("user_id", "event_id", "ts"), "user_id", "ts", -3600, 7200)
    late = lambda df, name: df.where("is_late").select("event_id", F.lit(None).cast("bigint").alias("right_event_id"), F.lit(name).alias("output"))
    return pairs.select("event_id", "right_event_id", F.lit("main").alias("output")).unionByName(late(left, "left late")).unionByName(late(right, "right late"))


@query("g05_full_history_join", "SELECT o_orderkey AS k, o_custkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def full_history_join(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), "o_custkey")
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber"))
    return J.full_history_join(orders, lines, "k").select("k", "o_custkey", F.col("right_l_linenumber").alias("l_linenumber"))


@query("g06_connect_comap", "SELECT 'order ' || o_orderkey AS value FROM orders UNION ALL SELECT 'customer ' || c_name FROM customer")
def connect_comap(spark, sf):
    left, right = F.concat(F.lit("order "), F.col("o_orderkey").cast("string")), F.concat(F.lit("customer "), F.col("c_name"))
    return J.connect_map(table(spark, sf, "orders"), table(spark, sf, "customer"), left, right)


@query("g07_union", "SELECT s_suppkey AS k, s_name AS name FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer UNION ALL SELECT p_partkey, p_name FROM part")
def union(spark, sf):
    pick = lambda t, k, n: table(spark, sf, t).select(F.col(k).alias("k"), F.col(n).alias("name"))
    return J.union(pick("supplier", "s_suppkey", "s_name"), pick("customer", "c_custkey", "c_name"), pick("part", "p_partkey", "p_name"))


SIDE = "(SELECT user_id, us // 86400000000 AS day, min(us) AS us FROM {0} GROUP BY 1, 2)"


@query(
    "g08_bill_reconcile",
    f"SELECT coalesce(a.user_id, b.user_id) || ':' || coalesce(a.day, b.day) AS bill, make_timestamp(a.us) AS left_time, make_timestamp(b.us) AS right_time, CASE WHEN b.us IS NULL THEN 'right missing' WHEN a.us IS NULL THEN 'left missing' WHEN abs(a.us - b.us) <= {HOUR} THEN 'matched' ELSE 'too late' END AS status FROM {SIDE.format(C)} a FULL JOIN {SIDE.format(P)} b ON a.user_id = b.user_id AND a.day = b.day",
)
def bill_reconcile(spark, sf):
    """A user's first click and first purchase of a day stand for the two halves of a bill."""
    day = F.floor(F.unix_micros("ts") / DAY).cast("string")
    left, right = (df.groupBy(F.concat_ws(":", F.col("user_id").cast("string"), day).alias("bill")).agg(F.min("ts").alias("ts")) for df in sides(spark, sf))
    return naive(J.reconcile(left, right, "bill", "ts", 3600), "left_time", "right_time")


@query("g09_cdc_apply", "SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 5 THEN 'CHANGED' ELSE o_orderstatus END AS status FROM orders WHERE o_orderkey % 10 <> 7")
def cdc_apply(spark, sf):
    """A feed made of the orders: all are created, then one in ten is updated and one in ten deleted."""
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    kind = lambda op, seq: [F.lit(op).alias("op"), F.lit(seq).alias("seq")]
    feed = orders.select("*", *kind("CREATE", 0)).unionByName(orders.where("o_orderkey % 10 = 5").withColumn("status", F.lit("CHANGED")).select("*", *kind("UPDATE", 1)))
    feed = feed.unionByName(orders.where("o_orderkey % 10 = 7").withColumn("status", F.lit(None).cast("string")).select("*", *kind("DELETE", 2)))
    return J.apply_changes(feed, "o_orderkey", ["seq"], ["status"])


@query("g10_dimension_lookup", "SELECT o_orderkey, c_name, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def dimension_lookup(spark, sf):
    return J.dimension_lookup(table(spark, sf, "orders"), table(spark, sf, "customer"), "o_custkey", "c_custkey").select("o_orderkey", "c_name", "c_mktsegment")


@query("g11_cached_lookup", "SELECT s_suppkey, n_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def cached_lookup(spark, sf):
    return J.cached_lookup(table(spark, sf, "supplier"), table(spark, sf, "nation"), "s_nationkey", "n_nationkey").select("s_suppkey", "n_name")


@query("g11_cached_calls", "SELECT c_custkey, 'nation ' || c_nationkey AS answer FROM customer")
def cached_calls(spark, sf):
    """A call per nation and worker process; its answers are kept for as long as they are fresh."""
    rows = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    return cache.cached_lookup(rows, "nations", "c_nationkey", lambda k: f"nation {k}").select("c_custkey", "answer")


@query("g12_async_enrich", "SELECT c_custkey, 'segment ' || c_mktsegment AS answer FROM customer")
def async_enrich(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    call = lambda row: {"c_custkey": row["c_custkey"], "answer": f"segment {row['c_mktsegment']}"}
    return J.async_enrich(rows, call, "c_custkey bigint, answer string", lambda row: {"c_custkey": row["c_custkey"], "answer": None})


@query(
    "g13_broadcast_threshold",
    f"WITH t AS (SELECT *, last_value(CASE WHEN event_type = 'signup' THEN vc END IGNORE NULLS) OVER (ORDER BY us, event_type <> 'signup', event_id ROWS UNBOUNDED PRECEDING) AS held FROM {E} WHERE event_type IN ('signup', 'click')) SELECT event_id, vc, coalesce(held, 0)::DOUBLE AS held FROM t WHERE event_type = 'click' AND vc > coalesce(held, 0)",
)
def broadcast_threshold(spark, sf):
    rows = clicks(spark, sf)
    control = rows.where("event_type = 'signup'").select("ts", F.col("vc").cast("double").alias("threshold"))
    out = J.control_threshold(rows.where("event_type = 'click'").select("event_id", "ts", "vc"), control, "ts", "vc", "threshold", 0.0)
    return out.select("event_id", "vc", "held")


@query(
    "g14_broadcast_pattern",
    f"""WITH r AS (SELECT event_id, user_id, event_type, us, lag(event_type) OVER (PARTITION BY user_id ORDER BY us, event_id) AS b, NULL AS first FROM {E} WHERE event_type <> 'signup'),
    u AS (SELECT * FROM r UNION ALL SELECT event_id, NULL, NULL, us, NULL, CASE WHEN event_id % 2 = 0 THEN 'click' ELSE 'view' END FROM {E} WHERE event_type = 'signup')
    SELECT event_id, user_id FROM (SELECT *, last_value(first IGNORE NULLS) OVER (ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS held FROM u) WHERE b = held AND event_type = 'purchase'""",
)
def broadcast_pattern(spark, sf):
    """Each signup sets a rule, which holds until the next one: a click or a view, and then a purchase."""
    rows = clicks(spark, sf)
    first = F.when(F.col("event_id") % 2 == 0, "click").otherwise("view")
    rules = rows.where("event_type = 'signup'").select("ts", "event_id", first.alias("action1"), F.lit("purchase").alias("action2"))
    return J.pattern_rule(rows.where("event_type <> 'signup'"), rules, "user_id", "event_type", ["ts", "event_id"]).select("event_id", "user_id")


WORDS = "(SELECT p_partkey, unnest([x for x in string_split(p_name, ' ') if x <> '']) AS word FROM part)"


@query("g15_lateral_cross", f"SELECT p_partkey, word, length(word)::INT AS length FROM {WORDS}")
def lateral_cross(spark, sf):
    table(spark, sf, "part").createOrReplaceTempView("g15_parts")
    return spark.sql("SELECT p_partkey, word, length(word) AS length FROM g15_parts, LATERAL (SELECT explode(filter(split(p_name, ' '), x -> x <> '')) AS word)")


@query("g16_lateral_left", f"SELECT part.p_partkey, word, length(word)::INT AS length FROM part LEFT JOIN {WORDS} w ON w.p_partkey = part.p_partkey AND part.p_partkey % 3 <> 0")
def lateral_left(spark, sf):
    parts = table(spark, sf, "part").withColumn("text", F.when(F.col("p_partkey") % 3 != 0, F.col("p_name")))
    return J.lateral_split(parts, "text", " ", keep_empty=True).select("p_partkey", "word", "length")
