from __future__ import annotations

from pyspark.sql import functions as F

from rillspark.operators import aggregates as G
from rillspark.plans.base import E, clicks, naive, table
from rillspark.plans.registry import query

ORDER = ["ts", "event_id"]
OVER = "OVER (PARTITION BY user_id ORDER BY ts, event_id)"


@query("d01_word_count", "SELECT word, count(*) AS cnt FROM (SELECT unnest(string_split(rtrim(text, ' '), ' ')) AS word FROM documents WHERE rtrim(text, ' ') <> '') GROUP BY 1")
def word_count(spark, sf):
    return G.word_count(table(spark, sf, "documents"), "text")


@query("d02_running_sum", f"SELECT user_id, event_id, sum(vc) {OVER}::BIGINT AS running_sum FROM {E}")
def running_sum(spark, sf):
    return G.running_sum(clicks(spark, sf), "user_id", "vc", ORDER).select("user_id", "event_id", "running_sum")


@query("d03_running_max", f"SELECT user_id, ts, event_id, max(vc) {OVER} AS vc, first_value(event_type) {OVER} AS first_event_type FROM {E}")
def running_max(spark, sf):
    return naive(G.running_extreme(clicks(spark, sf), "user_id", "vc", ["event_type"], ORDER), "ts")


@query("d03_running_min", f"SELECT user_id, ts, event_id, min(vc) {OVER} AS vc, first_value(event_type) {OVER} AS first_event_type FROM {E}")
def running_min(spark, sf):
    return naive(G.running_extreme(clicks(spark, sf), "user_id", "vc", ["event_type"], ORDER, "min"), "ts")


RANKED = f"(SELECT *, vc * 100000000 - row_number() {OVER} AS up, vc * 100000000 + row_number() {OVER} AS down FROM {E})"


@query("d04_running_max_by", f"SELECT user_id, ts, event_id, max(vc) {OVER} AS best_vc, arg_max(event_type, up) {OVER} AS best_event_type FROM {RANKED}")
def running_max_by(spark, sf):
    return naive(G.running_extreme_row(clicks(spark, sf), "user_id", "vc", ["event_type"], ORDER), "ts")


@query("d04_running_min_by", f"SELECT user_id, ts, event_id, min(vc) {OVER} AS best_vc, arg_min(event_type, down) {OVER} AS best_event_type FROM {RANKED}")
def running_min_by(spark, sf):
    return naive(G.running_extreme_row(clicks(spark, sf), "user_id", "vc", ["event_type"], ORDER, "min"), "ts")


@query("d05_keyed_reduce", f"SELECT user_id, sum(vc)::BIGINT AS sum_value, arg_max(ts, (ts, event_id)) AS last_time FROM {E} GROUP BY 1")
def keyed_reduce(spark, sf):
    return naive(G.keyed_reduce(clicks(spark, sf), "user_id", "vc", "ts", ORDER), "last_time")


@query("d06_most_active_key", f"SELECT user_id, count(*) AS cnt FROM {E} GROUP BY 1 ORDER BY cnt DESC, max((ts, event_id)) DESC LIMIT 1")
def most_active_key(spark, sf):
    return G.most_active_key(clicks(spark, sf), "user_id", ORDER)


@query("d07_sql_group_count", f"SELECT user_id, count(event_type) AS cnt FROM {E} GROUP BY 1")
def sql_group_count(spark, sf):
    clicks(spark, sf).createOrReplaceTempView("d07_rows")
    return spark.sql("SELECT user_id, count(event_type) AS cnt FROM d07_rows GROUP BY user_id")


@query("d08_filtered_group_sum", f"SELECT user_id, sum(vc)::BIGINT AS sum_value FROM {E} WHERE user_id > 5 GROUP BY 1")
def filtered_group_sum(spark, sf):
    return G.filtered_group_sum(clicks(spark, sf), F.col("user_id") > 5, "user_id", "vc")


@query("d09_distinct_by_key", f"SELECT event_id, user_id, event_type FROM (SELECT *, row_number() {OVER} AS n FROM {E}) WHERE n = 1")
def distinct_by_key(spark, sf):
    return G.distinct_by_key(clicks(spark, sf), "user_id", ORDER).select("event_id", "user_id", "event_type")


@query("d10_predicate_keyed_sum", f"SELECT CASE WHEN vc < 50 THEN 0 ELSE 1 END AS side, sum(vc)::BIGINT AS sum_value FROM {E} GROUP BY 1")
def predicate_keyed_sum(spark, sf):
    return G.predicate_keyed_sum(clicks(spark, sf), F.col("vc") < 50, "vc")


@query("d11_batch_keyed_sum", "SELECT l_returnflag, sum(l_quantity)::BIGINT AS sum_qty, count(*) AS n FROM lineitem GROUP BY 1")
def batch_keyed_sum(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.sum("l_quantity").cast("bigint").alias("sum_qty"), F.count("*").alias("n"))


@query("d12_running_collect", f"SELECT user_id, string_agg(vc::VARCHAR, ',' ORDER BY ts, event_id) AS \"values\" FROM {E} GROUP BY 1")
def running_collect(spark, sf):
    return G.collected(clicks(spark, sf), "user_id", "vc", ORDER).withColumn("values", F.array_join("values", ","))


@query("d13_keyed_count_state", f"SELECT event_id, row_number() OVER (ORDER BY event_id) AS running_count FROM {E}")
def keyed_count_state(spark, sf):
    return G.global_running_count(clicks(spark, sf), "event_id").select("event_id", F.col("running_count").cast("bigint").alias("running_count"))


@query("d05_keyed_reduce_running", f"SELECT user_id, ts, event_id, sum(vc) {OVER}::BIGINT AS sum_value, max(ts) {OVER} AS last_time FROM {E}")
def keyed_reduce_running(spark, sf):
    return naive(G.running_reduce(clicks(spark, sf), "user_id", "vc", "ts", ORDER), "ts", "last_time")


@query("d10_predicate_keyed_sum_running", f"SELECT event_id, side, sum(vc) OVER (PARTITION BY side ORDER BY event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS running_sum FROM (SELECT *, CASE WHEN vc < 50 THEN 0 ELSE 1 END AS side FROM {E})")
def predicate_keyed_sum_running(spark, sf):
    return G.predicate_running_sum(clicks(spark, sf), F.col("vc") < 50, "vc", ["event_id"]).select("event_id", "side", "running_sum")


@query("d12_running_collect_running", f"SELECT user_id, event_id, string_agg(vc::VARCHAR, ',') {OVER} AS \"values\" FROM {E}")
def running_collect_running(spark, sf):
    return G.running_collect(clicks(spark, sf), "user_id", "vc", ORDER).select("user_id", "event_id", F.array_join("values", ",").alias("values"))
