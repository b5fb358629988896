from __future__ import annotations

from pyspark.sql import functions as F

from rillspark.functions.scalar import window_label
from rillspark.operators import windows as W
from rillspark.plans.base import DAY, HOUR, E, clicks, naive, stamp, start
from rillspark.plans.registry import query



def cnt():
    return F.count("*").alias("cnt")



def tumble(size: int, keys: str, aggs: str, where: str = "") -> str:
    lead = f"{keys}, " if keys else ""
    return f"SELECT {lead}{stamp(start(size))} AS window_start, {stamp(f'{start(size)} + {size}')} AS window_end, {aggs} FROM {E} {where} GROUP BY ALL"


def hop(size: int, slide: int, keys: str, aggs: str) -> str:
    n, lead = size // slide, f"{keys}, " if keys else ""
    rows = f"(SELECT *, us - us % {slide} - i * {slide} AS s FROM {E}, range({n}) AS r(i))"
    return f"SELECT {lead}{stamp('s')} AS window_start, {stamp(f's + {size}')} AS window_end, {aggs} FROM {rows} GROUP BY {lead}s"


@query("e01_tumbling_event", tumble(HOUR, "user_id", "count(*) AS cnt"))
def tumbling_event(spark, sf):
    return W.windowed(clicks(spark, sf), "ts", "1 hour", ["user_id"], cnt())


@query("e02_tumbling_reduce", tumble(DAY, "user_id", "sum(vc)::BIGINT AS sum_vc, max(ts) AS last_ts"))
def tumbling_reduce(spark, sf):
    return naive(W.windowed(clicks(spark, sf), "ts", "1 day", ["user_id"], F.sum("vc").alias("sum_vc"), F.max_by("ts", F.struct("ts", "event_id")).alias("last_ts")), "last_ts")


@query("e03_tumbling_aggregate", tumble(DAY, "user_id", "sum(vc)::BIGINT::VARCHAR AS sum_text"))
def tumbling_aggregate(spark, sf):
    return W.windowed(clicks(spark, sf), "ts", "1 day", ["user_id"], F.sum("vc").cast("string").alias("sum_text"))


@query("e04_window_full_process", tumble(DAY, "user_id", "count(*) AS cnt, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS contents"))
def window_full_process(spark, sf):
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("event_id")), lambda x: x.cast("string")), ",")
    return W.windowed(clicks(spark, sf), "ts", "1 day", ["user_id"], cnt(), ids.alias("contents"))


@query("e05_window_agg_and_process", tumble(HOUR, "event_type", "count(*) AS cnt"))
def window_agg_and_process(spark, sf):
    return W.windowed(clicks(spark, sf), "ts", "1 hour", ["event_type"], cnt())


@query("e06_sliding_event", hop(HOUR, HOUR // 2, "event_type", "count(*) AS cnt"))
def sliding_event(spark, sf):
    return W.windowed(clicks(spark, sf), "ts", "1 hour", ["event_type"], cnt(), slide="30 minutes")


@query("e07_pv_per_user_ratio", hop(DAY, DAY // 4, "", "round(count(*)::DOUBLE / count(DISTINCT user_id), 6) AS ratio"))
def pv_per_user_ratio(spark, sf):
    return W.windowed(clicks(spark, sf), "ts", "1 day", [], F.round(F.count("*") / F.count_distinct("user_id"), 6).alias("ratio"), slide="6 hours")


@query("e08_unique_visitors", tumble(HOUR, "", "count(DISTINCT user_id) AS visitors"))
def unique_visitors(spark, sf):
    return W.windowed(clicks(spark, sf), "ts", "1 hour", [], F.count_distinct("user_id").alias("visitors"))


@query("e09_proc_time_tumbling", tumble(HOUR, "event_type", "sum(vc)::BIGINT AS sum_vc"))
def proc_time_tumbling(spark, sf):
    """In batch, a row's ingestion time is its own."""
    return W.windowed(clicks(spark, sf).withColumn("ingested", F.col("ts")), "ingested", "1 hour", ["event_type"], F.sum("vc").alias("sum_vc"))


@query("e10_proc_time_sliding", hop(2 * HOUR, HOUR, "event_type", "sum(vc)::BIGINT AS sum_vc"))
def proc_time_sliding(spark, sf):
    return W.windowed(clicks(spark, sf).withColumn("ingested", F.col("ts")), "ingested", "2 hours", ["event_type"], F.sum("vc").alias("sum_vc"), slide="1 hour")


def sessions(gap: str) -> str:
    ends = f"(SELECT *, us + {gap} AS e FROM {E})"
    marks = f"(SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM {ends})"
    runs = f"(SELECT *, sum(CASE WHEN before IS NULL OR us > before THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us, event_id) AS run FROM {marks})"
    return f"SELECT user_id, {stamp('min(us)')} AS window_start, {stamp('max(e)')} AS window_end, count(*) AS cnt FROM {runs} GROUP BY user_id, run"


@query("e11_session_fixed_gap", sessions(str(6 * HOUR)))
def session_fixed_gap(spark, sf):
    return W.session(clicks(spark, sf), "ts", "6 hours", ["user_id"], cnt())


@query("e12_session_dynamic_gap", sessions(f"(vc % 10 + 1) * {HOUR}"))
def session_dynamic_gap(spark, sf):
    gap = F.make_interval(hours=(F.col("vc") % 10 + 1).cast("int"))
    return W.session(clicks(spark, sf), "ts", gap, ["user_id"], cnt())


NTH = f"(SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth FROM {E})"


@query("e13_count_tumbling", f"SELECT user_id, (nth - 1) // 5 AS window_no, count(*) AS n, sum(vc)::BIGINT AS sum_vc FROM {NTH} GROUP BY 1, 2 HAVING count(*) = 5")
def count_tumbling(spark, sf):
    return W.count_tumbling(clicks(spark, sf), "user_id", 5, ["ts", "event_id"], F.sum("vc").alias("sum_vc"))


@query("e14_count_sliding", f"SELECT user_id, ts, event_id, nth, s AS sum_vc FROM (SELECT *, sum(vc) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)::BIGINT AS s FROM {NTH}) WHERE nth % 2 = 0")
def count_sliding(spark, sf):
    return naive(W.count_sliding(clicks(spark, sf), "user_id", 5, 2, ["ts", "event_id"], sum_vc=F.sum("vc")), "ts")


@query("e15_global_window", f"SELECT user_id, count(*) AS cnt, sum(vc)::BIGINT AS sum_vc FROM {E} GROUP BY 1")
def global_window(spark, sf):
    return clicks(spark, sf).groupBy("user_id").agg(cnt(), F.sum("vc").alias("sum_vc"))


@query("e16_window_all", tumble(HOUR, "", "count(*) AS cnt, sum(vc)::BIGINT AS sum_vc"))
def window_all(spark, sf):
    return W.windowed(clicks(spark, sf), "ts", "1 hour", [], cnt(), F.sum("vc").alias("sum_vc"))


@query("e17_tvf_tumble", tumble(HOUR, "user_id", "count(*) AS cnt"))
def tvf_tumble(spark, sf):
    clicks(spark, sf).createOrReplaceTempView("e17_rows")
    return spark.sql("SELECT user_id, w.start::timestamp_ntz AS window_start, w.end::timestamp_ntz AS window_end, cnt FROM (SELECT user_id, window(ts, '1 hour') AS w, count(*) AS cnt FROM e17_rows GROUP BY user_id, window(ts, '1 hour'))")


@query("e18_tvf_hop", hop(HOUR, HOUR // 4, "user_id", "count(*) AS cnt"))
def tvf_hop(spark, sf):
    clicks(spark, sf).createOrReplaceTempView("e18_rows")
    return spark.sql("SELECT user_id, w.start::timestamp_ntz AS window_start, w.end::timestamp_ntz AS window_end, cnt FROM (SELECT user_id, window(ts, '1 hour', '15 minutes') AS w, count(*) AS cnt FROM e18_rows GROUP BY user_id, window(ts, '1 hour', '15 minutes'))")


CUM = f"(SELECT *, {start(HOUR)} AS s, unnest(range(us - us % {HOUR // 4} + {HOUR // 4}, {start(HOUR)} + {HOUR} + 1, {HOUR // 4})) AS e FROM {E})"


@query("e19_tvf_cumulate", f"SELECT event_type, {stamp('s')} AS window_start, {stamp('e')} AS window_end, count(*) AS cnt FROM {CUM} GROUP BY event_type, s, e")
def tvf_cumulate(spark, sf):
    return W.cumulate(clicks(spark, sf), "ts", 900, 3600, ["event_type"], cnt())


@query("e20_legacy_group_window", f"SELECT user_id, {stamp(f'{start(HOUR)} + {HOUR}')} AS window_end, count(*) AS cnt FROM {E} GROUP BY ALL")
def legacy_group_window(spark, sf):
    return W.windowed(clicks(spark, sf), "ts", "1 hour", ["user_id"], cnt()).select("user_id", "window_end", "cnt")


Q = HOUR // 4
FIRES = f"(SELECT *, {start(HOUR)} AS s, unnest(range(((us + {Q} - 1) // {Q}) * {Q}, {start(HOUR)} + {HOUR}, {Q})) AS f FROM {E})"


@query("e21_early_fire_event_trigger", f"SELECT event_type, {stamp('s')} AS window_start, {stamp('f')} AS fire_time, count(*) AS cnt FROM {FIRES} GROUP BY event_type, s, f")
def early_fire(spark, sf):
    return W.early_fires(clicks(spark, sf), "ts", 900, 3600, "event_type")


@query("e22_periodic_fire_trigger", f"SELECT event_type, {stamp('s')} AS window_start, {stamp('e')} AS window_end, sum(vc)::BIGINT AS sum_vc FROM {CUM} GROUP BY event_type, s, e")
def periodic_fire(spark, sf):
    """In batch, processing time is event time: an open window is re-emitted at each interval, the last time at its end."""
    return W.cumulate(clicks(spark, sf), "ts", 900, 3600, ["event_type"], F.sum("vc").alias("sum_vc"))


@query("e23_manual_window", f"SELECT event_type, {stamp(start(HOUR))} AS window_start, count(*) AS cnt FROM {E} GROUP BY ALL")
def manual_window(spark, sf):
    return W.manual_window(clicks(spark, sf), "ts", 3600, ["event_type"], cnt())


@query(
    "l01_window_label",
    f"SELECT 'window [' || strftime({stamp('s')}, '%Y-%m-%d %H:%M:%S.%g') || ',' || strftime({stamp(f's + {DAY}')}, '%Y-%m-%d %H:%M:%S.%g') || ') has ' || n || ' rows' AS label FROM (SELECT {start(DAY)} AS s, count(*) AS n FROM {E} GROUP BY 1)",
)
def label(spark, sf):
    return W.windowed(clicks(spark, sf), "ts", "1 day", [], cnt()).select(window_label(F.col("window_start"), F.col("window_end"), F.col("cnt")).alias("label"))
