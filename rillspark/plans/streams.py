"""Streams over the given tables: written as files, read as streams until all is read, stopped and resumed, and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillspark.operators.automata import Pattern, matches
from rillspark.operators.rows import parse_lines
from rillspark.plans.base import DAY, E, HOUR, clicks, stamp, start
from rillspark.plans.registry import query
from rillspark.session import scratch
from rillspark.sources import external, files, queue
from rillspark.streaming import changing, clocks, processors, sinks, transactional
from rillspark.streaming.automata import pattern_stream

SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, vc bigint"


def halves(spark, sf) -> str:
    """A folder with the first and the second half of the events by time, each in a folder of its own."""
    path, rows = scratch(spark, "halves"), clicks(spark, sf)
    middle = rows.agg(F.percentile_approx(F.unix_micros("ts"), 0.5)).first()[0]
    for name, half in (("one", F.unix_micros("ts") <= middle), ("two", F.unix_micros("ts") > middle)):
        rows.where(half).write.parquet(f"{path}/{name}")
    return path


def twice(spark, path: str, make) -> None:
    """Run a query over the first half until it has read all, and again, from its checkpoint, over both halves."""
    for folders in (f"{path}/one", f"{path}/*"):
        make(files.timed_stream(spark, folders, SCHEMA, "ts", "1 hour", files_per_trigger=100)).awaitTermination()


def now(writer):
    """Start over what is there, and stop."""
    return writer.trigger(availableNow=True).start()


@query("a02_file_source", f"SELECT event_id, user_id, event_type FROM {E}")
def file_source(spark, sf):
    """Lines of text files as a stream, parsed, into a table."""
    lines, out = scratch(spark, "lines"), scratch(spark, "parsed")
    clicks(spark, sf).select(F.concat_ws(",", F.col("event_id").cast("string"), F.col("user_id").cast("string"), "event_type").alias("value")).write.text(lines)
    rows = parse_lines(files.text_stream(spark, lines, files_per_trigger=100), {"event_id": "bigint", "user_id": "bigint", "event_type": "string"})
    rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch(spark, "state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(out).where("ok").select("event_id", "user_id", "event_type")


@query("a16_timestamped_source", f"SELECT event_id, ts FROM {E}")
def timestamped_source(spark, sf):
    """Rows that bring their event time, under a watermark that trails it."""
    out = scratch(spark, "timed")
    clicks(spark, sf).write.parquet(path := scratch(spark, "events"))
    rows = files.timed_stream(spark, path, SCHEMA, "ts", "10 seconds", files_per_trigger=100)
    rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch(spark, "state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(SCHEMA).parquet(out).select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("b03_rolling_file_sink", f"SELECT value, count(*) AS n FROM (SELECT user_id || ' ' || event_type AS value FROM {E}) GROUP BY 1")
def rolling_file_sink(spark, sf):
    """Text files of at most ten thousand lines."""
    out = scratch(spark, "rolling")
    clicks(spark, sf).write.parquet(path := scratch(spark, "events"))
    rows = files.timed_stream(spark, path, SCHEMA, "ts", "1 hour", files_per_trigger=100)
    line = F.concat_ws(" ", F.col("user_id").cast("string"), "event_type").alias("value")
    sinks.rolling_files(rows.select(line), out, scratch(spark, "state"), None, 10_000).awaitTermination()
    return spark.read.text(out).groupBy("value").agg(F.count("*").alias("n"))


@query("b06_kafka_value_sink", f"SELECT user_id || ' ' || event_type AS value, count(*) AS n FROM {E} GROUP BY 1")
def kafka_value_sink(spark, sf):
    """Rows in the shape of a topic without keys, as its reader decodes them."""
    line = F.concat_ws(" ", F.col("user_id").cast("string"), "event_type").alias("line")
    topic = external.kafka_values(clicks(spark, sf).select(line), "line")
    return external.decoded(topic).groupBy("value").agg(F.count("*").alias("n"))


@query("b08_exactly_once_pipeline", f"SELECT event_id, vc FROM {E}")
def exactly_once_pipeline(spark, sf):
    """A sink that commits each micro-batch by its number, over a stop and a resume: each row once."""
    out, state = scratch(spark, "once"), scratch(spark, "state")
    twice(spark, halves(spark, sf), lambda rows: now(transactional.committed_files(rows.select("event_id", "vc"), out, state)))
    return transactional.read_committed(spark, out, "event_id bigint, vc bigint")


@query(
    "b13_batching_stream",
    f"SELECT user_id, (n - 1) // 10 AS flush, event_id, vc FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS n, count(*) OVER (PARTITION BY user_id) AS c FROM {E}) WHERE n <= c - c % 10",
)
def batching_stream(spark, sf):
    """Ten rows of a user at a time; what a buffer holds at the stop is in its state, and goes out after the resume."""
    out, state = scratch(spark, "flushed"), scratch(spark, "state")
    twice(spark, halves(spark, sf), lambda rows: now(transactional.committed_files(processors.run(rows, "user_id", processors.Buffered(10)), out, state)))
    return transactional.read_committed(spark, out, "user_id bigint, flush bigint, event_id bigint, vc bigint")


@query("a14_queue_stream", f"SELECT DISTINCT user_id::VARCHAR AS id FROM {E}")
def queue_stream(spark, sf):
    """Messages of a queue by offsets, each correlation id once."""
    path, out = scratch(spark, "queue"), scratch(spark, "ids")
    queue.publish(clicks(spark, sf), path, F.col("user_id"), F.col("event_type"), F.col("ts"), order=["ts", "event_id"])
    rows = queue.queue_stream(spark, path).withColumnRenamed("correlation_id", "id").withWatermark("sent", "60 days")
    now(transactional.committed_files(files.once_per_id_stream(rows, "id").select("id"), out, scratch(spark, "state"))).awaitTermination()
    return transactional.read_committed(spark, out, "id string")


STEPS = f"""
WITH x AS (SELECT user_id, event_id, event_type, us, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS o FROM {E}),
v AS (SELECT * FROM x WHERE event_type = 'view'),
c AS (SELECT v.event_id AS view_id, min(c.o) AS o FROM v JOIN x c ON c.user_id = v.user_id AND c.event_type = 'click' AND c.o > v.o AND c.us < v.us + {DAY} GROUP BY 1),
p AS (SELECT v.event_id AS view_id, min(p.o) AS o FROM v JOIN c ON c.view_id = v.event_id JOIN x p ON p.user_id = v.user_id AND p.event_type = 'purchase' AND p.o > c.o AND p.us < v.us + {DAY} GROUP BY 1)
SELECT v.user_id, v.event_id AS view_id, xc.event_id AS click_id, xp.event_id AS purchase_id, CASE WHEN p.o IS NULL THEN 'timeout' ELSE 'matched' END AS status
FROM v LEFT JOIN c ON c.view_id = v.event_id LEFT JOIN p ON p.view_id = v.event_id LEFT JOIN x xc ON xc.user_id = v.user_id AND xc.o = c.o LEFT JOIN x xp ON xp.user_id = v.user_id AND xp.o = p.o"""


def funnel() -> Pattern:
    """A view, later a click, later a purchase, all within a day."""
    kind = lambda name: F.col("event_type") == name
    return Pattern.begin("view", kind("view")).followed_by("click", kind("click")).followed_by("purchase", kind("purchase")).within(86_400)


def steps_of(found):
    ids = [F.get("events", i)["row"]["event_id"].alias(f"{name}_id") for i, name in enumerate(("view", "click", "purchase"))]
    return found.select("user_id", *ids, "status")


@query("k04_pattern_two_steps", STEPS)
def pattern_two_steps(spark, sf):
    return steps_of(matches(clicks(spark, sf), funnel(), "user_id", "ts", ["event_id"], ["event_id"]))


def ending(spark, path: str) -> None:
    """A last file with one row far ahead, which lets the watermark pass all others."""
    row = spark.range(1).select(F.lit(-1).cast("bigint").alias("event_id"), F.timestamp_seconds(F.lit(4_000_000_000)).alias("ts"), F.lit(-1).cast("bigint").alias("user_id"), F.lit("end").alias("event_type"), F.lit(0).cast("bigint").alias("vc"))
    row.write.parquet(f"{path}/two ends")


@query("k04_pattern_stream", STEPS)
def pattern_over_stream(spark, sf):
    """The same automaton in keyed state, over a stop and a resume."""
    path, out, state = halves(spark, sf), scratch(spark, "matches"), scratch(spark, "state")
    ending(spark, path)
    twice(spark, path, lambda rows: now(steps_of(pattern_stream(rows, funnel(), "user_id", "ts", ["event_id"], ["event_id"])).writeStream.format("parquet").option("path", out).option("checkpointLocation", state)))
    return spark.read.schema("user_id bigint, view_id bigint, click_id bigint, purchase_id bigint, status string").parquet(out)


@query(
    "i05_topn_stream",
    f"SELECT {stamp(f'{start(4 * HOUR)} + {4 * HOUR}')} AS window_end, event_type, count(*) AS cnt, row_number() OVER (PARTITION BY {start(4 * HOUR)} ORDER BY count(*) DESC, event_type)::INT AS rank FROM {E} GROUP BY {start(4 * HOUR)}, event_type QUALIFY rank <= 2",
)
def topn_stream(spark, sf):
    """Counts per window and their ranks, as two stateful operators of one query; each window once."""
    path, out, state = halves(spark, sf), scratch(spark, "ranks"), scratch(spark, "state")
    ending(spark, path)
    twice(spark, path, lambda rows: now(transactional.committed_files(changing.ranked_windows(rows, "ts", "4 hours", "event_type", 2), out, state)))
    got = transactional.read_committed(spark, out, "window_end timestamp, item string, cnt bigint, rank int")
    return got.where("item <> 'end'").select(F.col("window_end").cast("timestamp_ntz").alias("window_end"), F.col("item").alias("event_type"), "cnt", "rank")


@query("j04_top2_stream", f"SELECT row_number() OVER (ORDER BY count(*) DESC, user_id::VARCHAR)::INT AS rank, user_id::VARCHAR AS item, count(*) AS value FROM {E} GROUP BY user_id QUALIFY rank <= 2")
def top2_stream(spark, sf):
    """The two most active users over counts that change: what the changes (-U, +U) of all micro-batches leave of each rank."""
    out, state = scratch(spark, "changes"), scratch(spark, "state")

    def write(df, number):
        df.withColumn("number", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    def ranks(rows):
        counts = processors.run(rows, "user_id", changing.CountChanges()).withColumn("everyone", F.lit(0))
        return sinks.each_batch(changing.top_changes(counts, "everyone", "user_id", "cnt", 2), write, state)

    twice(spark, halves(spark, sf), ranks)
    rows = spark.read.schema("everyone int, op string, rank int, item string, value bigint, number bigint").parquet(f"{out}/batch=*")
    last = F.max_by(F.struct("item", "value"), F.struct("number", F.col("op").isin("+I", "+U")))
    return rows.groupBy("rank").agg(last.alias("last")).select("rank", "last.*")


@query(
    "g13_broadcast_stream",
    f"WITH t AS (SELECT *, last_value(CASE WHEN event_type = 'signup' THEN vc END IGNORE NULLS) OVER (ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS held FROM {E} WHERE event_type IN ('signup', 'click')) SELECT event_id, vc, coalesce(held, 0)::DOUBLE AS held FROM t WHERE event_type = 'click' AND vc > coalesce(held, 0)",
)
def broadcast_stream(spark, sf):
    """Thresholds travel with the rows and stay in the state of each shard, over a stop and a resume."""
    out, state = scratch(spark, "above"), scratch(spark, "state")

    def above(rows):
        kind = lambda name: rows.where(F.col("event_type") == name)
        found = changing.broadcast_state(kind("click"), kind("signup"), changing.AboveThreshold(0.0), F.col("user_id"), "vc", [F.col("vc").cast("double")], "ts", "event_id", shards=8)
        return now(transactional.committed_files(found.drop("shard"), out, state))

    twice(spark, halves(spark, sf), above)
    return transactional.read_committed(spark, out, "event_id bigint, vc bigint, held double")


@query("h13_savepoint_restart", f"SELECT user_id, sum(vc)::BIGINT AS sum_value, count(*) AS n FROM {E} GROUP BY 1")
def savepoint_restart(spark, sf):
    """Sums per key whose state outlives a stop: what the resumed query has written last for each key."""
    out, state = scratch(spark, "sums"), scratch(spark, "state")

    def write(df, number):
        df.withColumn("number", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    def sums(rows):
        per_key = rows.groupBy("user_id").agg(F.sum("vc").alias("sum_value"), F.count("*").alias("n"))
        return per_key.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()

    twice(spark, halves(spark, sf), sums)
    rows = spark.read.schema("user_id bigint, sum_value bigint, n bigint, number bigint").parquet(f"{out}/batch=*")
    return rows.groupBy("user_id").agg(F.max_by("sum_value", "number").alias("sum_value"), F.max_by("n", "number").alias("n"))


MIDDLE = f"(SELECT (min(us) + max(us)) // 2 FROM {E})"


@query("h13_seeded_state", f"SELECT user_id, event_id, running_sum FROM (SELECT *, sum(vc) OVER (PARTITION BY user_id ORDER BY us, event_id)::BIGINT AS running_sum FROM {E}) WHERE us > {MIDDLE}")
def seeded_state(spark, sf):
    """The state that a query over the first half left in its checkpoint is read, and another query starts from it."""
    rows, path, state = clicks(spark, sf), scratch(spark, "parts"), scratch(spark, "state")
    ends = rows.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    middle = ((ends[0] or 0) + (ends[1] or 0)) // 2
    for name, half in (("one", F.unix_micros("ts") <= middle), ("two", F.unix_micros("ts") > middle)):
        rows.where(half).write.parquet(f"{path}/{name}")
    stream = lambda name: spark.readStream.schema(SCHEMA).parquet(f"{path}/{name}")
    now(transactional.committed_files(processors.run(stream("one"), "user_id", processors.RunningSum()), scratch(spark, "sums"), state)).awaitTermination()
    out = scratch(spark, "sums")
    seeded = clocks.seeded(stream("two"), "user_id", clocks.SeededSum(), clocks.state_of(spark, state, "sum"))
    now(transactional.committed_files(seeded, out, scratch(spark, "state"))).awaitTermination()
    return transactional.read_committed(spark, out, "user_id bigint, event_id bigint, running_sum bigint")


@query("h14_checkpointed_query", f"SELECT {stamp(start(24 * HOUR))} AS day, event_type, count(*) AS n FROM {E} GROUP BY 1, 2")
def checkpointed_query(spark, sf):
    """A SQL query over a stream, stopped and resumed; its last complete result."""
    out, state = scratch(spark, "daily"), scratch(spark, "state")

    def write(df, number):
        df.write.mode("overwrite").parquet(f"{out}/{number:06d}")

    def daily(rows):
        rows.createOrReplaceTempView("h14_rows")
        counts = spark.sql("SELECT window(ts, '1 day').start AS day, event_type, count(*) AS n FROM h14_rows GROUP BY window(ts, '1 day'), event_type")
        return counts.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()

    twice(spark, halves(spark, sf), daily)
    rows = spark.read.schema("day timestamp, event_type string, n bigint").parquet(f"{out}/*")
    rows = rows.withColumn("number", F.element_at(F.split(F.input_file_name(), "/"), -2))
    last = rows.agg(F.max("number").alias("last"))
    return rows.join(F.broadcast(last), F.col("number") == F.col("last")).select(F.col("day").cast("timestamp_ntz").alias("day"), "event_type", "n")
