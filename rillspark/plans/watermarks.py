from __future__ import annotations

from pyspark.sql import functions as F

from rillspark.operators import watermarks as M
from rillspark.operators.windows import windowed
from rillspark.plans.base import A, HOUR, arrivals, stamp, start
from rillspark.plans.registry import query

ARRIVAL = ["arrival", "event_id"]
MS = "(us // 1000)"


def marked(delay_ms: int, keys: str = "") -> str:
    part = f"PARTITION BY {keys} " if keys else ""
    wm = f"max({MS}) OVER ({part}ORDER BY arr, event_id ROWS UNBOUNDED PRECEDING) - {delay_ms} - 1"
    return f"(SELECT *, {wm} AS wm FROM {A})"


def before(delay_ms: int, keys: str = "") -> str:
    part = f"PARTITION BY {keys} " if keys else ""
    return f"(SELECT *, lag(wm) OVER ({part}ORDER BY arr, event_id) AS wm0 FROM {marked(delay_ms, keys)})"


@query("f01_wm_monotonous", f"SELECT event_id, wm::BIGINT AS watermark_ms FROM {marked(0)}")
def wm_monotonous(spark, sf):
    return M.with_watermark_column(arrivals(spark, sf), "ts", ARRIVAL, 0).select("event_id", "watermark_ms")


@query("f02_wm_bounded", f"SELECT event_id, wm::BIGINT AS watermark_ms FROM {marked(5000)}")
def wm_bounded(spark, sf):
    return M.with_watermark_column(arrivals(spark, sf), "ts", ARRIVAL, 5000).select("event_id", "watermark_ms")


@query("f03_wm_periodic_custom", f"SELECT arr // {HOUR} AS period, max(wm)::BIGINT AS watermark_ms FROM {marked(5000)} GROUP BY 1")
def wm_periodic(spark, sf):
    """Emitted once a period: the watermark after the period's last arrival."""
    rows = M.with_watermark_column(arrivals(spark, sf), "ts", ARRIVAL, 5000)
    return rows.groupBy(F.floor(F.unix_micros("arrival") / HOUR).alias("period")).agg(F.max("watermark_ms").alias("watermark_ms"))


@query("f04_wm_punctuated_custom", f"SELECT event_id, wm::BIGINT AS watermark_ms FROM {marked(2000, 'user_id')}")
def wm_punctuated(spark, sf):
    return M.with_watermark_column(arrivals(spark, sf), "ts", ARRIVAL, 2000, ["user_id"]).select("event_id", "watermark_ms")


@query(
    "f05_wm_idleness",
    f"WITH p AS (SELECT user_id % 4 AS source, max(arr) AS last_arr, max({MS}) - 5001 AS wm FROM {A} GROUP BY 1) SELECT source, wm::BIGINT AS watermark_ms, last_arr < (SELECT max(last_arr) FROM p) - 600000000 AS idle FROM p",
)
def wm_idleness(spark, sf):
    """A source silent for ten minutes is idle and no longer holds the joint watermark back."""
    per = arrivals(spark, sf).groupBy((F.col("user_id") % 4).alias("source")).agg(F.max("arrival").alias("last"), (F.max(F.unix_millis("ts")) - 5001).alias("watermark_ms"))
    newest = per.agg(F.max("last").alias("newest"))
    return per.crossJoin(F.broadcast(newest)).select("source", "watermark_ms", (F.unix_micros("last") < F.unix_micros("newest") - 600_000_000).alias("idle"))


@query("f06_wm_multi_input", f"WITH p AS (SELECT user_id % 4 AS source, max({MS}) - 5001 AS wm FROM {A} GROUP BY 1) SELECT source, wm::BIGINT AS watermark_ms, (SELECT min(wm) FROM p)::BIGINT AS joint_watermark_ms FROM p")
def wm_multi_input(spark, sf):
    rows = arrivals(spark, sf).withColumn("source", F.col("user_id") % 4)
    return M.least_watermark(rows, "ts", ARRIVAL, 5000, "source")


SIZE = 600_000
LATE = f"coalesce(({MS} - {MS} % {SIZE}) + {SIZE} + {{0}} - 1 <= wm0, false)"


@query(
    "f07_allowed_lateness",
    f"SELECT {stamp(start(SIZE * 1000))} AS window_start, {stamp(f'{start(SIZE * 1000)} + {SIZE * 1000}')} AS window_end, count(*) AS cnt FROM {before(60000)} WHERE NOT {LATE.format(120000)} GROUP BY ALL",
)
def allowed_lateness(spark, sf):
    """Windows of what came within the delay and the lateness allowed after it."""
    rows = M.split_late(arrivals(spark, sf), "ts", ARRIVAL, 60_000, SIZE, 120_000)
    return windowed(rows.where(~F.col("is_late")), "ts", "10 minutes", [], F.count("*").alias("cnt"))


@query("f08_late_side_output", f"SELECT event_id, {LATE.format(120000)} AS is_late FROM {before(60000)}")
def late_side_output(spark, sf):
    return M.split_late(arrivals(spark, sf), "ts", ARRIVAL, 60_000, SIZE, 120_000).select("event_id", "is_late")


@query("f09_wm_observed_at_fire", f"SELECT user_id, {stamp(start(HOUR))} AS window_start, max(wm)::BIGINT AS watermark_ms, count(*) AS cnt FROM {marked(5000, 'user_id')} GROUP BY ALL")
def wm_observed(spark, sf):
    """The largest watermark that a window's own rows have brought."""
    rows = M.with_watermark_column(arrivals(spark, sf), "ts", ARRIVAL, 5000, ["user_id"])
    return windowed(rows, "ts", "1 hour", ["user_id"], F.max("watermark_ms").alias("watermark_ms"), F.count("*").alias("cnt")).drop("window_end")
