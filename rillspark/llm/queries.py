"""The registered queries of this subpackage and, where SQL can express them, the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillspark.llm import licenses
from rillspark.llm.chat import linked_calls, turn_calls
from rillspark.llm.decontaminate import contamination
from rillspark.llm.embed_dedup import embedding_groups
from rillspark.llm.exact_dedup import exact_groups
from rillspark.llm.merkle import hashed, hexed, leaf_hash, proofs
from rillspark.llm.minhash import near_groups
from rillspark.llm.mixing import mix, taken_per_document
from rillspark.llm.packing import added_tokens, pack, token_pieces
from rillspark.llm.repair import repaired
from rillspark.llm.sharding import shard

from rillspark.llm.suffix_dedup import remove_repeats
from rillspark.llm.toxicity import toxicity, train


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = shard(read(spark, sf_dir, "documents"), shards=24)
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("place").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version",
    )


def op2_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_groups(read(spark, sf_dir, "embeddings"), cosine=0.9)


OP2_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[64] AS e FROM embeddings),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND array_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, c.component_id, vec_id = c.component_id AS kept
FROM v JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = vec_id
"""


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = remove_repeats(read(spark, sf_dir, "documents"), span=400)
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def packed(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    pieces = token_pieces(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, capacity=1024, end_id=2, added=added_tokens(vocabulary), vocabulary=vocabulary)
    return pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), capacity=1024)


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(read(spark, sf_dir, "documents"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    rows = licenses.licences(docs, licenses.train(docs))
    return rows.withColumn("families", F.array_join("families", ","))


def held_out() -> Column:
    """Of a null id: false. Null ids have no labels, so nothing is learnt from them either."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def scored(spark: SparkSession, docs: DataFrame, sf_dir: str, out: str = "score") -> DataFrame:
    """``docs`` with their toxicity, learnt from labels of rows that are not held out."""
    labels = read(spark, sf_dir, "labels").where(~held_out())
    return docs.withColumn(out, toxicity(train(read(spark, sf_dir, "documents"), labels), F.col("text")))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, read(spark, sf_dir, "documents"), sf_dir)
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(read(spark, sf_dir, "documents"), weights=[5, 2, 1], budget=1.5, passes=2)
    return taken_per_document(mixed)


OP7_SQL = r"""
WITH words AS (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), sources AS (
    SELECT source, sum(size)::BIGINT AS source_size,
           [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight
    FROM words GROUP BY source
), ranked AS (
    SELECT *, row_number() OVER (ORDER BY 2 * source_size / weight, encode(source) NULLS LAST) AS k,
           coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS full_before,
           sum(weight) OVER (ORDER BY 2 * source_size / weight, encode(source) NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS weight_from
    FROM sources
), level AS (
    SELECT (1.5 * (SELECT sum(size) FROM words)::DOUBLE - full_before) / weight_from AS x
    FROM ranked WHERE 2 * source_size > (1.5 * (SELECT sum(size) FROM words)::DOUBLE - full_before) / weight_from * weight ORDER BY k LIMIT 1
), wanted AS (
    SELECT source, source_size, least((source_size * 2)::DOUBLE, (SELECT x FROM level) * weight) AS target FROM sources
), line AS (
    SELECT w.*, t.source_size, t.target, pass, md5(coalesce(doc_id::VARCHAR, 'null') || ':' || pass::VARCHAR) AS key,
           sum(size) OVER (PARTITION BY w.source ORDER BY pass, md5(coalesce(doc_id::VARCHAR, 'null') || ':' || pass::VARCHAR), size ROWS UNBOUNDED PRECEDING)::BIGINT AS upto
    FROM words w JOIN wanted t ON w.source IS NOT DISTINCT FROM t.source CROSS JOIN (VALUES (0), (1)) AS p(pass)
), packets AS (
    SELECT *, least(size - 128 * packet, 128)::BIGINT AS n FROM (SELECT *, unnest(range(greatest(1, (size + 127) // 128))) AS packet FROM line)
), served AS (
    SELECT *, coalesce((upto - size + 128 * packet + n) / target, 0) AS finish FROM packets
), total AS (
    SELECT *, sum(n) OVER (ORDER BY finish, key, size, packet ROWS UNBOUNDED PRECEDING)::BIGINT AS upto_here, (SELECT sum(floor(target)::BIGINT) FROM wanted)::BIGINT AS budget FROM served
)
SELECT doc_id, size, source_size, target, sum(greatest(0, least(n, budget - (upto_here - n))))::BIGINT AS taken
FROM total GROUP BY doc_id, size, source_size, target
"""


#: The tools of derived calls: short prompts look something up, others are answered if they are not too long.
SCHEMAS = {
    "lookup": {"prompt": {"type": "string", "least": 1}, "words": {"type": "integer", "least": 1, "most": 20}},
    "answer": {"prompt": {"type": "string"}, "words": {"type": "integer", "least": 21, "most": 100}},
}


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_calls(*turn_calls(read(spark, sf_dir, "conversations")), SCHEMAS)


OP8_SQL = r"""
WITH RECURSIVE m AS (
    SELECT *, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))::INT AS words FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL
), calls AS (
    SELECT conv_id, turn, md5(conv_id || ':' || turn) AS call_id, md5(conv_id || ':' || (turn - 2)) AS up, text, words,
           CASE WHEN words <= 20 THEN 'lookup' ELSE 'answer' END AS name FROM m WHERE role = 'user'
), results AS (
    SELECT conv_id, turn, md5(conv_id || ':' || (turn - 1)) AS call_id, text FROM m WHERE role = 'assistant'
), levels AS (
    SELECT call_id, 0 AS level FROM calls WHERE up NOT IN (SELECT call_id FROM calls)
    UNION ALL SELECT c.call_id, l.level + 1 FROM calls c JOIN levels l ON c.up = l.call_id
), linked AS (
    SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id, c.turn AS call_turn, r.turn AS result_turn, l.level, c.name, c.text AS prompt, c.words, r.text AS content,
           CASE WHEN c.call_id IS NULL THEN 'orphan' WHEN r.call_id IS NULL THEN 'open' ELSE 'linked' END AS status,
           CASE WHEN c.call_id IS NULL THEN '' WHEN c.name = 'lookup' THEN concat_ws('; ', CASE WHEN length(c.text) < 1 THEN 'prompt: too small' END, CASE WHEN c.words < 1 THEN 'words: too small' END)
                ELSE CASE WHEN c.words > 100 THEN 'words: too large' ELSE '' END END AS errors
    FROM calls c LEFT JOIN levels l ON l.call_id = c.call_id FULL JOIN results r ON c.call_id = r.call_id
)
SELECT conv_id, call_id, status, call_turn, result_turn, level,
       format('{:010d}.{:010d}', coalesce(level, -1), coalesce(call_turn, result_turn)) || CASE WHEN status = 'orphan' THEN '.1' ELSE '.0' END AS position,
       CASE WHEN status <> 'orphan' THEN 1 END AS copies, CASE WHEN status <> 'open' THEN 1 END AS result_copies, errors,
       '{' || CASE WHEN status <> 'orphan' THEN '"arguments":{"prompt":' || to_json(prompt) || ',"words":' || words || '},' ELSE '' END || '"id":"' || call_id || '",'
       || CASE WHEN status <> 'orphan' THEN '"name":"' || name || '",' ELSE '' END || CASE WHEN status <> 'open' THEN '"result":' || to_json(content) || ',' ELSE '' END
       || '"status":"' || status || '","valid":' || (errors = '')::VARCHAR || '}' AS json
FROM linked
"""


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(read(spark, sf_dir, "documents"), k=3, percent=85)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(read(spark, sf_dir, "documents"), keep="largest")


OP10_SQL = """
WITH d AS (
    SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents
)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""


def damaged_repairs(turns: DataFrame) -> DataFrame:
    """``turns`` damaged by a checksum of conversation and turn (nulls read as one space), and the cheapest repairs."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    harm = F.crc32(F.concat_ws(":", text("conv_id"), text("turn")).cast("binary")) % 20
    said = F.when(harm == 1, "").when(harm == 2, F.translate(text("text"), ".!?", "")).otherwise(text("text"))
    rows = turns.select(
        F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("none")).alias("conv"), "turn",
        F.when(harm == 4, "user").otherwise(text("role")).alias("role"), said.alias("text"),
        F.when(harm == 0, 0).when(harm == 3, 2).otherwise(1).cast("bigint").alias("copies"),
    )
    kind = turns.schema["conv_id"].dataType
    return repaired(rows).select(F.when(F.col("conv") != "none", F.substring("conv", 2, 1 << 30)).cast(kind).alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return damaged_repairs(read(spark, sf_dir, "conversations"))


#: CRC-32 of ASCII text in DuckDB, which has no function for it.
CRC = "xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({}, ''), lambda ch: ascii(ch)::BIGINT)), lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"

OP11_SQL = f"""
WITH RECURSIVE h AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {CRC.format("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS harm FROM conversations
), d AS (
    SELECT conv_id, turn, CASE WHEN harm = 4 THEN 'user' ELSE role END AS role, CASE harm WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
           unnest(CASE harm WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM h
), o AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS n, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS tail FROM d
), f AS (
    SELECT conv_id, turn, role, text, n, left(role, 1) AS r, tail = '' AS blank, tail <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS dup, right(tail, 1) NOT IN ('.', '!', '?') AS cut,
           left(role, 1) || left(lead(role) OVER (PARTITION BY conv_id ORDER BY n), 1) AS pair FROM o
), step(q1, lead, q2, said) AS (VALUES ('0', 's', 'S', ''), ('0', 'u', 'U', 'user'), ('S', 'u', 'U', 'user'), ('U', 'a', 'A', 'assistant'), ('A', 'u', 'U', 'user')
), e AS (
    SELECT conv_id, n, q1, 'D' AS op, q1 AS q2, 4 AS cost, '' AS line FROM f, (VALUES ('0'), ('S'), ('U'), ('A')) v(q1)
    UNION ALL SELECT conv_id, n, q1, 'K', q2, CASE WHEN cut THEN 3 ELSE 0 END, chr(10) || role || ':' || text FROM f JOIN step ON r = lead WHERE NOT blank AND NOT dup
    UNION ALL SELECT conv_id, n, q1, 'R', q2, CASE WHEN cut THEN 6 ELSE 3 END, chr(10) || said || ':' || text FROM f, step WHERE said <> '' AND NOT blank AND NOT dup
), ins AS (
    SELECT q1 AS q, q1, '' AS pre, 0 AS cost, '' AS line FROM (VALUES ('0'), ('S'), ('U'), ('A')) v(q1)
    UNION ALL SELECT q1, q2, 'I', 3, chr(10) || said || ':' FROM step WHERE said <> ''
    UNION ALL SELECT a.q1, b.q2, 'II', 6, chr(10) || a.said || ':' || chr(10) || b.said || ':' FROM step a JOIN step b ON a.q2 = b.q1 WHERE a.said <> '' AND b.said <> ''
), t AS (
    SELECT conv_id, max(n) + 1 AS n, q, {{'cost': min(cost), 'audit': min(pre), 'body': min(line)}} AS best FROM f, (SELECT * FROM ins WHERE q1 IN ('0', 'A') AND (q IN ('U', 'S') OR pre = '')) GROUP BY conv_id, q
    UNION ALL
    SELECT t.conv_id, e.n, ins.q, min({{'cost': ins.cost + e.cost + t.best.cost, 'audit': ins.pre || e.op || t.best.audit, 'body': ins.line || e.line || t.best.body}})
    FROM t JOIN e ON e.conv_id IS NOT DISTINCT FROM t.conv_id AND e.n = t.n - 1 AND e.q2 = t.q JOIN ins ON ins.q1 = e.q1 GROUP BY ALL
), c AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate,
           count(*) FILTER (cut AND NOT blank AND NOT dup) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id
)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(t.best.cost, 0)::BIGINT AS cost, coalesce(t.best.audit, '') AS audit, sha256(coalesce(substr(t.best.body, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM a.conv_id AND t.n = 1 AND t.q = '0'
"""


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where 7 divides the checksum of the doc_id, n_chars is tampered with; a null id or a null n_chars is left alone."""
    docs, n_chars = read(spark, sf_dir, "documents"), F.col("n_chars")
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    leaf = lambda n: leaf_hash(F.col("doc_id"), F.col("source"), F.col("lang"), n, F.col("text"))
    rows = proofs(docs, "lang", "doc_id", leaf(n_chars), leaf(F.when(tampered, n_chars + 1).otherwise(n_chars)), ("doc_id",))
    proof = hashed(F.array_join(F.transform("siblings", hexed), ""))
    return rows.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", "verified")


def leaf_sql(n_chars: str) -> str:
    return f"sha256({' || '.join(f"coalesce(strlen({v}::VARCHAR)::VARCHAR || ':' || {v}::VARCHAR, '-')" for v in ('doc_id', 'source', 'lang', n_chars, 'text'))})"


OP12_SQL = f"""
WITH RECURSIVE d AS (
    SELECT row_number() OVER () AS r, *, CASE WHEN {CRC.format("doc_id::VARCHAR")} % 7 = 0 THEN n_chars + 1 ELSE n_chars END AS m FROM documents
), h AS (
    SELECT r, doc_id, lang, {leaf_sql("n_chars")} AS leaf, {leaf_sql("m")} AS other FROM d
), l AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, other) - 1 AS place, count(*) OVER (PARTITION BY lang) AS n FROM h
), t AS (
    SELECT lang, 0 AS level, place, n, leaf AS digest FROM l
    UNION ALL SELECT lang, level + 1, place // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY place)) FROM t WHERE n > 1 GROUP BY ALL
), s AS (
    SELECT lang, digest, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM t WHERE n = 1
), u AS (
    SELECT 0 AS level, place, n, digest FROM s
    UNION ALL SELECT level + 1, place // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY place)) FROM u WHERE n > 1 GROUP BY ALL
), c AS (
    SELECT r, lang, 0 AS level, place, n, other AS folded, '' AS path FROM l
    UNION ALL
    SELECT r, c.lang, c.level + 1, c.place // 2, (c.n + 1) // 2, sha256(CASE WHEN c.place % 2 = 1 THEN coalesce(t.digest, '') || folded ELSE folded || coalesce(t.digest, '') END), path || coalesce(t.digest, '')
    FROM c LEFT JOIN t ON t.lang IS NOT DISTINCT FROM c.lang AND t.level = c.level AND t.place = xor(c.place, 1) WHERE c.n > 1
), e AS (
    SELECT r, 0 AS level, s.place, s.n, folded, path FROM c JOIN s ON c.lang IS NOT DISTINCT FROM s.lang WHERE c.n = 1
    UNION ALL
    SELECT r, e.level + 1, e.place // 2, (e.n + 1) // 2, sha256(CASE WHEN e.place % 2 = 1 THEN coalesce(u.digest, '') || folded ELSE folded || coalesce(u.digest, '') END), path || coalesce(u.digest, '')
    FROM e LEFT JOIN u ON u.level = e.level AND u.place = xor(e.place, 1) WHERE e.n > 1
)
SELECT l.doc_id, l.leaf, s.digest AS subroot, (SELECT digest FROM u WHERE n = 1) AS root, sha256(path) AS proof_sha256,
       folded AS folded_root, folded = (SELECT digest FROM u WHERE n = 1) AS verified
FROM l JOIN s ON l.lang IS NOT DISTINCT FROM s.lang JOIN e ON e.r = l.r WHERE e.n = 1
"""


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), span=10)
    return rows.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP13_SQL = r"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
    SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
    SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS win
    FROM (SELECT *, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
), dw AS (
    SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
    FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw))
), occ AS (
    SELECT r, i, n, item FROM dw JOIN bw USING (n, win)
), hit AS (
    SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM occ)) GROUP BY r
), its AS (
    SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM occ WHERE item IS NOT NULL) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN its USING (r)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_shard": op1_shard, "op2_embed_dedup": op2_embed_dedup, "op3_suffix_dedup": op3_suffix_dedup, "op4_pack": op4_pack, "op5_licenses": op5_licenses, "op6_toxicity": op6_toxicity, "op7_mix": op7_mix, "op8_chat": op8_chat, "op9_minhash": op9_minhash, "op10_exact_dedup": op10_exact_dedup, "op11_repair": op11_repair, "op12_merkle": op12_merkle, "op13_decontaminate": op13_decontaminate}


def oracle_sql() -> dict[str, str]:
    return {"op2_embed_dedup": OP2_SQL, "op7_mix": OP7_SQL, "op8_chat": OP8_SQL, "op10_exact_dedup": OP10_SQL, "op11_repair": OP11_SQL, "op12_merkle": OP12_SQL, "op13_decontaminate": OP13_SQL}
