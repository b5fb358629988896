from __future__ import annotations

from pyspark.sql import functions as F

from rillspark.operators import aggregates as G
from rillspark.operators import state as S
from rillspark.plans.base import E, clicks, naive
from rillspark.plans.registry import query

ORDER = ["ts", "event_id"]
OVER = "OVER (PARTITION BY user_id ORDER BY ts, event_id)"
FAR = "OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query("h01_value_state_jump_alert", f"SELECT user_id, event_id, vc, previous FROM (SELECT *, lag(vc, 1, 0) {OVER} AS previous FROM {E}) WHERE abs(vc - previous) > 10")
def jump_alert(spark, sf):
    return S.jump_alerts(clicks(spark, sf), "user_id", "vc", ORDER, 10).select("user_id", "event_id", "vc", "previous")


@query("h02_list_state_top3", f"SELECT user_id, event_id, array_to_string(list_reverse(list_sort(list(vc) {OVER}))[1:3], ',') AS top FROM {E}")
def list_state_top3(spark, sf):
    out = S.top_so_far(clicks(spark, sf), "user_id", "vc", ORDER, 3)
    return out.select("user_id", "event_id", F.array_join(F.transform("top", lambda x: x.cast("string")), ",").alias("top"))


@query("h03_map_state_counts", f"SELECT user_id, string_agg(vc || '=' || n, ',' ORDER BY vc) AS counts FROM (SELECT user_id, vc, count(*) AS n FROM {E} GROUP BY 1, 2) GROUP BY 1")
def map_state_counts(spark, sf):
    out = S.value_counts(clicks(spark, sf), "user_id", "vc")
    pairs = F.transform(F.map_entries("counts"), lambda e: F.concat_ws("=", e["key"].cast("string"), e["value"].cast("string")))
    return out.select("user_id", F.array_join(pairs, ",").alias("counts"))


COUNTED = f"(SELECT user_id, event_id, list(vc) {OVER} AS seen FROM {E})"


@query("h03_map_state_counts_running", f"SELECT user_id, event_id, array_to_string([v || '=' || len(list_filter(seen, lambda x: x = v)) for v in list_sort(list_distinct(seen))], ',') AS counts FROM {COUNTED}")
def map_state_counts_running(spark, sf):
    out = S.running_value_counts(clicks(spark, sf), "user_id", "vc", ORDER)
    pairs = F.transform(F.map_entries("counts"), lambda e: F.concat_ws("=", e["key"].cast("string"), e["value"].cast("string")))
    return out.select("user_id", "event_id", F.array_join(pairs, ",").alias("counts"))


@query("h03_map_state_changes", f"SELECT user_id, event_id, vc, row_number() OVER (PARTITION BY user_id, vc ORDER BY ts, event_id) AS n FROM {E}")
def map_state_changes(spark, sf):
    """The one entry of the map that each row changes."""
    return S.value_count_changes(clicks(spark, sf), "user_id", "vc", ORDER).select("user_id", "event_id", "vc", "n")


@query("h04_reducing_state_sum", f"SELECT user_id, event_id, sum(vc) {OVER}::BIGINT AS running_sum FROM {E}")
def reducing_state(spark, sf):
    return G.running_sum(clicks(spark, sf), "user_id", "vc", ORDER).select("user_id", "event_id", "running_sum")


@query("h05_aggregating_state_avg", f"SELECT user_id, event_id, round(avg(vc) {OVER}, 6) AS running_avg FROM {E}")
def aggregating_state(spark, sf):
    return S.running_average(clicks(spark, sf), "user_id", "vc", ORDER).select("user_id", "event_id", F.round("running_avg", 6).alias("running_avg"))


@query("h06_avg_every_5", f"SELECT user_id, event_id, n, (s // n)::BIGINT AS average FROM (SELECT *, row_number() {OVER} AS n, sum(vc) {OVER} AS s FROM {E}) WHERE n % 5 = 0")
def avg_every_5(spark, sf):
    return S.average_every(clicks(spark, sf), "user_id", "vc", ORDER, 5).select("user_id", "event_id", "n", "average")


@query("h07_five_state_kinds", f"SELECT user_id, arg_max(vc, (ts, event_id)) AS last_value, count(vc) AS list_size, count(DISTINCT vc) AS map_size, sum(vc)::BIGINT AS reduced, round(avg(vc), 6) AS average FROM {E} GROUP BY 1")
def five_state_kinds(spark, sf):
    return S.five_states(clicks(spark, sf), "user_id", "vc", ORDER).withColumn("average", F.round("average", 6))


@query(
    "h07_five_state_kinds_running",
    f"SELECT user_id, event_id, vc AS value, count(vc) {OVER} AS list_size, sum(is_new) {OVER}::BIGINT AS map_size, sum(vc) {OVER}::BIGINT AS reduced, first_value(event_type) {OVER} AS first_event_type, max(ts) {OVER} AS newest, round(avg(vc) {OVER}, 6) AS average FROM (SELECT *, (row_number() OVER (PARTITION BY user_id, vc ORDER BY ts, event_id) = 1)::INT AS is_new FROM {E})",
)
def five_state_kinds_running(spark, sf):
    out = S.running_five_states(clicks(spark, sf), "user_id", "vc", "event_type", "ts", ORDER).drop("ts")
    return naive(out.withColumn("average", F.round("average", 6)), "newest")


W = f"(SELECT *, CASE WHEN event_type = 'click' THEN vc END AS v, CASE WHEN event_type = 'click' THEN us END AS w FROM {E})"


@query(
    "h08_state_ttl",
    f"SELECT user_id, event_id, CASE WHEN us - lw < 21600000000 THEN lv END AS held FROM (SELECT *, last_value(v IGNORE NULLS) {FAR} AS lv, last_value(w IGNORE NULLS) {FAR} AS lw FROM {W})",
)
def state_ttl(spark, sf):
    rows = clicks(spark, sf).withColumn("v", F.when(F.col("event_type") == "click", F.col("vc")))
    return S.with_expiry(rows, "user_id", "v", "ts", ORDER, 21600).select("user_id", "event_id", "held")


@query(
    "h08_state_ttl_read",
    f"SELECT user_id, event_id, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id, life ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held FROM (SELECT *, sum(CASE WHEN us - p >= 21600000000 THEN 1 ELSE 0 END) {OVER} AS life FROM (SELECT *, lag(us) {OVER} AS p FROM {W}))",
)
def state_ttl_read(spark, sf):
    rows = clicks(spark, sf).withColumn("v", F.when(F.col("event_type") == "click", F.col("vc")))
    return S.with_expiry(rows, "user_id", "v", "ts", ORDER, 21600, refresh_on_read=True).select("user_id", "event_id", "held")


@query(
    "h09_periodic_pv",
    f"""WITH RECURSIVE r AS (SELECT user_id, us, row_number() {OVER} AS n FROM {E}),
    t AS (SELECT user_id, min(us) + 86400000000 AS fire FROM r GROUP BY 1
          UNION ALL SELECT t.user_id, (SELECT min(us) FROM r WHERE r.user_id = t.user_id AND r.us > t.fire) + 86400000000 FROM t WHERE t.fire IS NOT NULL AND t.fire < (SELECT max(us) FROM r WHERE r.user_id = t.user_id))
    SELECT t.user_id, make_timestamp(fire) AS fire_time, (SELECT count(*) FROM r WHERE r.user_id = t.user_id AND r.us <= t.fire) AS cnt FROM t WHERE fire IS NOT NULL""",
)
def periodic_pv(spark, sf):
    return S.periodic_count(clicks(spark, sf), "user_id", "ts", ORDER, 86400)


@query("h10_event_timer", f"SELECT user_id, make_timestamp(us + 10000000) AS fire_time, count(*) AS set_by FROM {E} GROUP BY ALL")
def event_timer(spark, sf):
    return S.event_timers(clicks(spark, sf), "user_id", "ts", 10)


@query("h11_proc_timer", f"SELECT user_id, make_timestamp(us + 10000000) AS fire_time, count(*) AS set_by FROM {E} GROUP BY ALL")
def proc_timer(spark, sf):
    """In batch, a row's ingestion time is its own."""
    return S.event_timers(clicks(spark, sf).withColumn("ingested", F.col("ts")), "user_id", "ingested", 10)


@query("h12_operator_list_count", f"SELECT count(*) AS n FROM {E}")
def operator_list_count(spark, sf):
    return S.count_per_instance(clicks(spark, sf)).agg(F.sum("n").alias("n"))
