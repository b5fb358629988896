from __future__ import annotations

from pyspark.sql import functions as F

from rillspark.plans.base import E, clicks, table
from rillspark.plans.registry import query
from rillspark.session import scratch
from rillspark.sources import external, files, generated
from rillspark.streaming import sinks


@query("a01_text_scan", "SELECT line AS value, count(*) AS n FROM (SELECT unnest(string_split(replace(text, chr(13), ''), chr(10))) AS line FROM benchmark) GROUP BY 1")
def text_scan(spark, sf):
    """The benchmark texts written as plain text files and read back by line."""
    path = scratch(spark, "text")
    table(spark, sf, "benchmark").select(F.replace("text", F.lit("\r"), F.lit("")).alias("text")).write.text(path)
    return files.text_scan(spark, path).groupBy("value").agg(F.count("*").alias("n"))


@query("a07_key_mode_generator", "SELECT key, count(*) AS n FROM (SELECT o_orderkey % (CASE WHEN o_orderkey // 100 % 10 < 5 THEN o_orderkey // 100 % 10 + 1 ELSE 10 - o_orderkey // 100 % 10 END) AS key FROM orders) GROUP BY 1")
def key_mode(spark, sf):
    key = generated.key_of_mode(F.col("o_orderkey"), "rise and fall", 100, 5)
    return table(spark, sf, "orders").groupBy(key.alias("key")).agg(F.count("*").alias("n"))


@query("a12_csv_table_source", f"SELECT user_id, event_type, count(*) AS n FROM {E} GROUP BY 1, 2")
def csv_table_source(spark, sf):
    path = scratch(spark, "csv")
    sinks.csv_files(clicks(spark, sf).select("user_id", F.concat(F.lit(" "), "event_type").alias("event_type")), path)
    files.csv_table(spark, "a12_rows", path, "user_id bigint, event_type string")
    return spark.sql("SELECT user_id, event_type, count(*) AS n FROM a12_rows GROUP BY user_id, event_type")


@query("a13_cdc_change_source", "SELECT o_orderkey::VARCHAR AS k, CASE o_orderkey % 10 WHEN 7 THEN 'DELETE' ELSE 'CREATE' END AS op, CASE WHEN o_orderkey % 10 <> 7 THEN o_orderstatus END AS status FROM orders")
def cdc_change_source(spark, sf):
    """The orders as JSON changes, one in ten a deletion, decoded again."""
    gone = F.col("o_orderkey") % 10 == 7
    row = F.create_map(F.lit("k"), F.col("o_orderkey").cast("string"), F.lit("status"), F.col("o_orderstatus"))
    op = F.when(gone, "DELETE").otherwise("CREATE")
    line = F.to_json(F.struct(F.lit("shop").alias("db"), F.lit("orders").alias("tableName"), F.when(gone, row).alias("before"), F.when(~gone, row).alias("after"), op.alias("op")))
    feed = files.change_feed(table(spark, sf, "orders").select(line.alias("value")))
    return feed.select(F.coalesce(F.col("after")["k"], F.col("before")["k"]).alias("k"), "op", F.col("after")["status"].alias("status"))


@query("a14_queue_source_dedup", f"SELECT user_id AS correlation_id, min(event_id) AS event_id FROM {E} GROUP BY 1")
def queue_source_dedup(spark, sf):
    rows = clicks(spark, sf).select(F.col("user_id").alias("correlation_id"), "event_id")
    return files.once_per_id(rows, "correlation_id", ["event_id"])


@query("b02_print_table_sink", f"SELECT 'clicks> +I[' || user_id || ', ' || event_type || ']' AS line, count(*) AS n FROM {E} GROUP BY 1")
def print_table_sink(spark, sf):
    return sinks.printed(clicks(spark, sf).select("user_id", "event_type"), "clicks").groupBy("line").agg(F.count("*").alias("n"))


@query("b04_bucketed_file_sink", f"SELECT strftime(ts, '%Y-%m-%d %H') AS bucket, count(*) AS n FROM {E} GROUP BY 1")
def bucketed_file_sink(spark, sf):
    path = scratch(spark, "buckets")
    sinks.bucketed_files(clicks(spark, sf).select("event_id", "ts"), path, F.col("ts"))
    return spark.read.schema("event_id bigint, ts timestamp, bucket string").parquet(path).groupBy("bucket").agg(F.count("*").alias("n"))


@query("b05_csv_table_sink", f"SELECT event_id, event_type, vc FROM {E}")
def csv_table_sink(spark, sf):
    path = scratch(spark, "csv")
    sinks.csv_files(clicks(spark, sf).select("event_id", "event_type", "vc"), path)
    return files.csv_table(spark, "b05_rows", path, "event_id bigint, event_type string, vc bigint")


@query("b07_kafka_keyed_sink", f"SELECT user_id::VARCHAR AS key, user_id || ',' || event_type AS value FROM {E}")
def kafka_keyed_sink(spark, sf):
    line = F.concat_ws(",", F.col("user_id").cast("string"), "event_type").alias("line")
    frame = external.kafka_keyed(clicks(spark, sf).select(line), "line")
    return frame.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


@query("b10_keyed_upsert_sink", f"SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type FROM {E} GROUP BY 1")
def keyed_upsert_sink(spark, sf):
    """Two micro-batches merged into one keyed table."""
    path, rows = scratch(spark, "upserts"), clicks(spark, sf)
    for part in (0, 1):
        sinks.upsert(rows.where(F.col("event_id") % 2 == part), path, "user_id", "event_type", ["ts", "event_id"], slots=16)
    return sinks.current(spark, path).select("user_id", "event_type")


@query("b11_document_index_sink", f"SELECT '{{\"' || user_id || '\":\"' || event_type || '\"}}' AS document FROM {E}")
def document_index_sink(spark, sf):
    return sinks.documents(clicks(spark, sf), "user_id", "event_type")


@query("b12_topic_routed_sink", f"SELECT 'events.' || event_type AS routing_key, count(*) AS n FROM {E} WHERE event_type NOT IN ('click', 'view') GROUP BY 1")
def topic_routed_sink(spark, sf):
    """Envelopes that no queue takes; queues are bound for clicks and views."""
    rows = clicks(spark, sf)
    key = F.concat(F.lit("events."), "event_type")
    bound = rows.where("event_type IN ('click', 'view')").select(F.lit("shop").alias("exchange"), key.alias("routing_key")).distinct()
    sent = sinks.routed(rows, "shop", key, F.to_json(F.struct("user_id", "vc")))
    return sinks.unroutable(sent, bound).groupBy("routing_key").agg(F.count("*").alias("n"))


@query("b13_batching_sink", f"SELECT user_id, event_id, (n - 1) // 10 AS flush FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, count(*) OVER (PARTITION BY user_id) AS c FROM {E}) WHERE (n - 1) // 10 < c // 10")
def batching_sink(spark, sf):
    return sinks.flushed(clicks(spark, sf), "user_id", 10, ["ts", "event_id"]).select("user_id", "event_id", "flush")


