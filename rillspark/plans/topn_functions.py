from __future__ import annotations

from pyspark.sql import functions as F

from rillspark.functions import scalar as X
from rillspark.operators import topn as T
from rillspark.plans.base import HOUR, E, clicks, events, stamp, start, table
from rillspark.plans.registry import query

OVER3 = "OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)"


@query("i01_over_rows_avg", f"SELECT user_id, event_id, (sum(vc) {OVER3} // count(vc) {OVER3})::BIGINT AS average FROM {E}")
def over_rows_avg(spark, sf):
    return T.rows_average(clicks(spark, sf), "user_id", "vc", ["ts", "event_id"], 3).select("user_id", "event_id", "average")


@query("i02_topn_global", f"SELECT user_id, cnt, rank::INT AS rank FROM (SELECT user_id, count(*) AS cnt, row_number() OVER (ORDER BY count(*) DESC, user_id) AS rank FROM {E} GROUP BY 1) WHERE rank <= 2")
def topn_global(spark, sf):
    return T.topn_global(clicks(spark, sf), "user_id", 2)


def per_window(rows: str, s: str, size: int, n: int, columns: str) -> str:
    counts = f"(SELECT {s} AS s, event_type, count(*) AS cnt FROM {rows} GROUP BY 1, 2)"
    ranked = f"(SELECT *, row_number() OVER (PARTITION BY s ORDER BY cnt DESC, event_type) AS rank FROM {counts})"
    return f"SELECT {columns.format(start=stamp('s'), end=stamp(f's + {size}'))} FROM {ranked} WHERE rank <= {n}"


HOP = f"(SELECT *, us - us % {HOUR // 2} - i * {HOUR // 2} AS w FROM {E}, range(2) AS r(i))"


@query("i03_topn_per_window", per_window(HOP, "w", HOUR, 2, "event_type, {start} AS window_start, {end} AS window_end, cnt, rank::INT AS rank"))
def topn_per_window(spark, sf):
    return T.topn_per_window(clicks(spark, sf), "ts", "1 hour", "event_type", 2, slide="30 minutes")


@query("i04_topn_all_window", per_window(HOP, "w", HOUR, 2, "{end} AS window_end, rank::INT AS rank, event_type, cnt"))
def topn_all_window(spark, sf):
    return T.topn_all_window(clicks(spark, sf), "ts", "1 hour", "30 minutes", "event_type", 2)


@query("i05_topn_keyed_process", per_window(E, start(4 * HOUR), 4 * HOUR, 3, "event_type, {start} AS window_start, {end} AS window_end, cnt, rank::INT AS rank"))
def topn_keyed_process(spark, sf):
    return T.topn_per_window(clicks(spark, sf), "ts", "4 hours", "event_type", 3)


HASH = "list_reduce(list_prepend(0::HUGEINT, [ord(c)::HUGEINT for c in string_split({0}, '')]), lambda h, c: (h * 31 + c) % 4294967296)"


@query("j01_scalar_hash", f"SELECT c_custkey, (CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END)::INT AS hash FROM (SELECT c_custkey, {HASH.format('c_name')} AS h FROM customer)")
def scalar_hash(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", X.string_hash(F.col("c_name")).alias("hash"))


@query("j02_table_split", "SELECT p_partkey, word, length(word)::INT AS length FROM (SELECT p_partkey, unnest([x for x in string_split(p_name, ' ') if x <> '']) AS word FROM part)")
def table_split(spark, sf):
    X.register(spark)
    table(spark, sf, "part").createOrReplaceTempView("j02_parts")
    return spark.sql("SELECT p_partkey, word, length FROM j02_parts, LATERAL split_words(p_name)")


@query("j03_weighted_avg", "SELECT l_returnflag, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) AS average FROM lineitem GROUP BY 1")
def weighted_avg(spark, sf):
    value = X.weighted_average(F.col("l_extendedprice"), F.col("l_quantity"))
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.round(value, 4).alias("average"))


@query("j03_weighted_avg_whole", "SELECT l_returnflag, (sum(l_linenumber * l_quantity::BIGINT) // sum(l_quantity::BIGINT))::BIGINT AS average FROM lineitem GROUP BY 1")
def weighted_avg_whole(spark, sf):
    value = X.weighted_average_whole(F.col("l_linenumber"), F.col("l_quantity").cast("bigint"))
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(value.alias("average"))


@query("j04_top2_table_agg", f"SELECT user_id, rank::INT AS rank, vc FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY vc DESC, event_id) AS rank FROM {E}) WHERE rank <= 2")
def top2_table_agg(spark, sf):
    return T.top_values(clicks(spark, sf), "user_id", "vc", 2, ["event_id"])


@query("j05_udf_registration", "SELECT c_custkey, length(c_name)::INT AS size FROM customer")
def udf_registration(spark, sf):
    X.register(spark)
    return table(spark, sf, "customer").selectExpr("c_custkey", "text_length(c_name) AS size")


@query("j06_parameterised_function", "SELECT p_partkey FROM part WHERE contains(p_type, 'O')")
def parameterised_function(spark, sf):
    from rillspark.operators.rows import key_filter

    return table(spark, sf, "part").where(key_filter("p_type", "O")()).select("p_partkey")


@query("l02_json_decode", "SELECT event_id, (props::JSON->>'k')::INT AS k FROM events")
def json_decode(spark, sf):
    rows = events(spark, sf)
    return rows.select("event_id", X.from_json(F.col("props"), "struct<k:int>")["k"].alias("k"))


@query("l02_json_encode", "SELECT n_nationkey, '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}' AS json FROM nation")
def json_encode(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", X.to_json("n_nationkey", "n_name").alias("json"))


@query("l03_uuid_token")
def uuid_token(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", X.uuid_token().alias("token"))
