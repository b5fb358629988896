from __future__ import annotations

from pyspark.sql import functions as F

from rillspark.operators import rows as R
from rillspark.plans.base import E, clicks, naive, table
from rillspark.plans.registry import query


@query("c01_map_project", f"SELECT user_id, event_type FROM {E}")
def map_project(spark, sf):
    return R.map_project(clicks(spark, sf), "user_id", "event_type")


LINE = "CASE WHEN event_id % 7 = 0 THEN 'x' ELSE user_id::VARCHAR END || ', ' || event_type || ' ,' || (us // 1000)::VARCHAR"


@query(
    "c02_parse_csv_line",
    f"SELECT line AS value, try_cast(trim(split_part(line, ',', 1)) AS BIGINT) AS user_id, trim(split_part(line, ',', 2)) AS event_type, try_cast(trim(split_part(line, ',', 3)) AS BIGINT) AS ts_ms, event_id % 7 <> 0 AS ok FROM (SELECT *, {LINE} AS line FROM {E})",
)
def parse_csv_line(spark, sf):
    user = F.when(F.col("event_id") % 7 == 0, "x").otherwise(F.col("user_id").cast("string"))
    lines = clicks(spark, sf).select(F.concat(user, F.lit(", "), "event_type", F.lit(" ,"), F.unix_millis("ts").cast("string")).alias("value"))
    return R.parse_lines(lines, {"user_id": "bigint", "event_type": "string", "ts_ms": "bigint"})


@query("c03_filter", f"SELECT event_id, event_type FROM {E} WHERE contains(event_type, 'ch')")
def filter_rows(spark, sf):
    return clicks(spark, sf).where(R.key_filter("event_type", "ch")()).select("event_id", "event_type")


@query(
    "c04_flat_map_conditional",
    f"SELECT event_type, user_id::VARCHAR AS value FROM {E} WHERE event_type IN ('click', 'purchase') UNION ALL SELECT event_type, event_id::VARCHAR FROM {E} WHERE event_type = 'purchase'",
)
def flat_map_conditional(spark, sf):
    return R.flat_map_conditional(clicks(spark, sf), "event_type", {"click": ["user_id"], "purchase": ["user_id", "event_id"]})


@query(
    "c05_process_duplicate",
    f"SELECT event_id, event_type FROM {E} WHERE event_type IN ('click', 'error') UNION ALL SELECT event_id, event_type FROM {E} WHERE event_type = 'error'",
)
def process_duplicate(spark, sf):
    return R.repeat_by_key(clicks(spark, sf).select("event_id", "event_type"), "event_type", {"click": 1, "error": 2})


N = f"(SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM {E})"


@query(
    "c06_changelog_stream",
    f"SELECT user_id, ts, event_id, CASE WHEN n = 1 THEN '+I' ELSE '+U' END AS op, n AS cnt FROM {N} UNION ALL SELECT user_id, ts, event_id, '-U', n - 1 FROM {N} WHERE n > 1",
)
def changelog_stream(spark, sf):
    return naive(R.changelog(clicks(spark, sf), "user_id", ["ts", "event_id"]), "ts")


@query("c07_append_stream", f"SELECT event_id, user_id, vc FROM {E} WHERE vc > 100")
def append_stream(spark, sf):
    return clicks(spark, sf).where("vc > 100").select("event_id", "user_id", "vc")


@query("c08_rich_map", "SELECT doc_id, md5(nfc_normalize(text)) AS normal FROM documents")
def rich_map(spark, sf):
    """Texts in Unicode's composed form, which only Python has here; each instance looks the function up once."""

    def make(index):
        import unicodedata
        from functools import partial

        composed = partial(unicodedata.normalize, "NFC")
        return lambda frame: frame.assign(text=frame["text"].map(composed, na_action="ignore"))

    out = R.rich_map(table(spark, sf, "documents").select("doc_id", "text"), make, "doc_id bigint, text string")
    return out.select("doc_id", F.md5("text").alias("normal"))


@query("c09_split_by_predicate", f"SELECT CASE WHEN vc % 2 = 0 THEN 'even' ELSE 'odd' END AS side, count(*) AS n, sum(vc)::BIGINT AS total FROM {E} GROUP BY 1")
def split_by_predicate(spark, sf):
    parts = R.split_by_predicate(clicks(spark, sf), {"even": F.col("vc") % 2 == 0, "odd": F.col("vc") % 2 == 1})
    done = [df.groupBy(F.lit(name).alias("side")).agg(F.count("*").alias("n"), F.sum("vc").alias("total")) for name, df in parts.items()]
    return done[0].unionByName(done[1])


@query("c10_side_output_split", f"SELECT event_id, CASE event_type WHEN 'click' THEN 'clicks' WHEN 'purchase' THEN 'sales' ELSE 'main' END AS output FROM {E}")
def side_output_split(spark, sf):
    routes = {"clicks": F.col("event_type") == "click", "sales": F.col("event_type") == "purchase"}
    return R.side_outputs(clicks(spark, sf), routes).select("event_id", "output")


@query("c11_side_output_alert", f"SELECT event_id, vc, 'main' AS output FROM {E} UNION ALL SELECT event_id, vc, 'alert' FROM {E} WHERE vc > 200")
def side_output_alert(spark, sf):
    return R.side_alerts(clicks(spark, sf), F.col("vc") > 200).select("event_id", "vc", "output")


@query("c12_rebalance", f"SELECT event_type, count(*) AS n FROM {E} GROUP BY 1")
def rebalance(spark, sf):
    return R.rescaled(R.rebalanced(clicks(spark, sf), 16), 8).groupBy("event_type").agg(F.count("*").alias("n"))


@query("c13_broadcast_rows", f"SELECT i::INT AS instance, count(*) AS n FROM {E}, range(4) AS r(i) GROUP BY 1")
def broadcast_rows(spark, sf):
    return R.to_every_partition(clicks(spark, sf), 4).groupBy("instance").agg(F.count("*").alias("n"))


@query("c14_global_partition", f"SELECT 0 AS instance, count(*) AS n FROM (SELECT DISTINCT event_type FROM {E})")
def global_partition(spark, sf):
    kinds = clicks(spark, sf).select("event_type").distinct()
    return R.to_one_partition(kinds).groupBy(F.spark_partition_id().alias("instance")).agg(F.count("*").alias("n"))


@query("c15_custom_partition", f"SELECT (user_id % 4)::INT AS instance, count(*) AS n FROM {E} GROUP BY 1")
def custom_partition(spark, sf):
    return R.custom_partition(clicks(spark, sf), 4, "user_id").groupBy(F.spark_partition_id().alias("instance")).agg(F.count("*").alias("n"))


@query("c16_key_by", f"SELECT user_id, 1::BIGINT AS instances, count(*) AS n FROM {E} GROUP BY 1")
def key_by(spark, sf):
    placed = R.key_by(clicks(spark, sf), 8, "user_id").withColumn("instance", F.spark_partition_id())
    return placed.groupBy("user_id").agg(F.count_distinct("instance").alias("instances"), F.count("*").alias("n"))


@query("c17_sql_select_where", f"SELECT user_id, vc FROM {E} WHERE event_type = 'click' AND vc > 50")
def sql_select_where(spark, sf):
    clicks(spark, sf).createOrReplaceTempView("c17_rows")
    spark.sql("SELECT * FROM c17_rows WHERE event_type = 'click'").createOrReplaceTempView("c17_clicks")
    return spark.sql("SELECT user_id, vc FROM c17_clicks WHERE vc > 50")


@query("c18_table_api_select", f"SELECT user_id, vc FROM {E} WHERE event_type = 'view' AND vc > 50")
def table_api_select(spark, sf):
    return clicks(spark, sf).where((F.col("event_type") == "view") & (F.col("vc") > 50)).select("user_id", "vc")


@query("c19_computed_time_column", f"SELECT event_id, make_timestamp(us // 1000000 * 1000000) AS et FROM {E}")
def computed_time_column(spark, sf):
    rows = clicks(spark, sf).withColumn("ms", F.unix_millis("ts"))
    return naive(R.computed_time(rows, "ms").select("event_id", "et"), "et")
