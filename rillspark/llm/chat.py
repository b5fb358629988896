"""Chat formatting: tool calls linked to their results, ordered, validated and written as canonical JSON.

Only DataFrame functions. Calls and results meet in a hash join on the call's identifier, never by conversation, so a
conversation that holds a third of all rows is spread like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillspark.llm.common import WORD, dropped, staged

#: What a field's value may be, by the name that Spark gives a JSON value's type.
KINDS = {"string": ["STRING"], "integer": ["BIGINT", "DECIMAL"], "number": ["BIGINT", "DECIMAL", "DOUBLE"], "boolean": ["BOOLEAN"], "array": ["ARRAY"], "object": ["OBJECT"]}


def topological_levels(calls: DataFrame, id_col: str = "call_id", parent_col: str = "depends_on") -> DataFrame:
    """(id, level): 0 without a known parent, else one above it; null on a cycle and above one. Ids must be unique.

    Pointer doubling: after k joins every call knows its ancestor 2^k steps up, so even one chain of all calls takes a
    logarithmic number of rounds. A call that still has an ancestor then stands on a cycle, or depends on one.
    """
    known = calls.select(id_col, F.col(parent_col).alias("up"))
    exists = calls.select(F.col(id_col).alias("up"))
    rooted = known.join(exists, "up", "left_semi").withColumn("level", F.lit(1).cast("long"))
    now = rooted.unionByName(known.join(exists, "up", "left_anti").select(F.lit(None).cast("string").alias("up"), id_col, F.lit(0).cast("long").alias("level")))
    now = staged(now.select(id_col, "up", "level"), "levels")
    for _ in range(now.count().bit_length()):
        if not now.where("up is not null").head(1):
            break
        above = now.select(F.col(id_col).alias("up"), F.col("up").alias("next"), F.col("level").alias("more"))
        new = staged(now.join(above, "up", "left").select(id_col, F.col("next").alias("up"), (F.col("level") + F.coalesce("more", F.lit(0))).alias("level")), "levels")
        dropped(now)
        now = new
    return now.select(id_col, F.when(F.col("up").isNull(), F.col("level")).alias("level"))


def broken_rules(name: Column, arguments: Column, schemas: dict[str, dict[str, dict]]) -> Column:
    """The rules of the tool's schema that the JSON text breaks, in the schemas' order; an empty array if it is valid.

    A schema gives each field a type, and optionally "optional", "least" and "most" (of a number, or a string's length).
    Text that is no JSON object and tools without a schema break a rule of their own.
    """
    value = F.try_parse_json(arguments)
    found = [
        F.when(~F.coalesce(name.isin(*schemas), F.lit(False)), F.lit("unknown tool")),
        F.when(~F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False)), F.lit("no object")),
    ]
    for tool, fields in schemas.items():
        for field, rule in fields.items():
            part = F.try_variant_get(value, f"$.{field}", "variant")
            kind = F.schema_of_variant(part)
            missing = part.isNull() | (kind == "VOID")
            fits = F.lit(False)
            for known in KINDS[rule["type"]]:
                fits = fits | kind.startswith(known)
            size = F.length(F.try_variant_get(value, f"$.{field}", "string")) if rule["type"] == "string" else F.try_variant_get(value, f"$.{field}", "double")
            wrong = [(~fits & ~missing, "type")]
            if not rule.get("optional"):
                wrong.append((missing, "missing"))
            if "least" in rule:
                wrong.append((fits & (size < rule["least"]), "too small"))
            if "most" in rule:
                wrong.append((fits & (size > rule["most"]), "too large"))
            found += [F.when((name == tool) & F.coalesce(test, F.lit(False)), F.lit(f"{field}: {what}")) for test, what in wrong]
    return F.array_compact(F.array(*found))


def once(rows: DataFrame, id_col: str, order: list[str]) -> DataFrame:
    """One row per identifier, the first by ``order``, and how many there were."""
    whole = F.struct(*order, *[c for c in rows.columns if c not in order])
    return rows.groupBy(id_col).agg(F.min(whole).alias("first"), F.count("*").alias("copies")).select("first.*", "copies")


def linked_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict[str, dict]]) -> DataFrame:
    """One row per call and per result without a call.

    ``calls``: conv_id, turn, call_id, name, arguments (JSON text), depends_on. ``results``: conv_id, turn, call_id,
    content. Repeated identifiers: the smallest row counts, ``copies`` and ``result_copies`` say how many there were. Null
    identifiers link with nothing and come out as they are. Returns conv_id, call_id, status ("linked", "open", "orphan",
    "nameless call", "nameless result"), call_turn, result_turn, level, position (its place among the events, by level and
    turn, calls before results alone, as a sortable text), errors, and json: sorted keys, no blanks, nulls left out.
    Other columns play no part. Empty tables give an empty one.
    """
    nameless = calls.where("call_id is null").select("conv_id", F.lit("nameless call").alias("status"), F.col("turn").alias("call_turn"), "name", "arguments", F.lit(1).cast("long").alias("copies"))
    unnamed = results.where("call_id is null").select("conv_id", F.lit("nameless result").alias("status"), F.col("turn").alias("result_turn"), "content", F.lit(1).cast("long").alias("result_copies"))
    calls = calls.select("conv_id", "turn", "call_id", "name", "arguments", "depends_on")
    results = results.select("conv_id", "turn", "call_id", "content")
    calls = staged(once(calls.where("call_id is not null"), "call_id", ["turn", "conv_id", "name", "arguments"]), "calls")
    results = once(results.where("call_id is not null"), "call_id", ["turn", "conv_id", "content"]).withColumnRenamed("copies", "result_copies")
    levels = topological_levels(calls)
    right = results.select(F.col("call_id").alias("of"), F.col("conv_id").alias("result_conv"), F.col("turn").alias("result_turn"), "content", "result_copies")
    both = calls.join(levels, "call_id").join(right, F.col("call_id") == F.col("of"), "full")
    status = F.when(F.col("call_id").isNull(), "orphan").when(F.col("of").isNull(), "open").otherwise("linked")
    both = both.select(
        F.coalesce("conv_id", "result_conv").alias("conv_id"), F.coalesce("call_id", "of").alias("call_id"), status.alias("status"), F.col("turn").alias("call_turn"),
        "result_turn", "level", "name", "arguments", "content", "copies", "result_copies",
    )
    both = both.unionByName(nameless, allowMissingColumns=True).unionByName(unnamed, allowMissingColumns=True)
    alone = F.col("status").isin("orphan", "nameless result")
    errors = F.when(~alone, broken_rules(F.col("name"), F.col("arguments"), schemas)).otherwise(F.array().cast("array<string>"))
    place = F.format_string("%010d.%010d", F.coalesce("level", F.lit(-1)), F.coalesce("call_turn", "result_turn", F.lit(-1)))
    out = both.withColumn("errors", errors).withColumn("position", F.concat(place, F.when(alone, ".1").otherwise(".0")))
    line = F.to_json(
        F.struct(
            F.try_parse_json("arguments").alias("arguments"), F.col("call_id").alias("id"), "name", F.col("content").alias("result"), "status",
            (F.size("errors") == 0).alias("valid"),
        )
    )
    return out.select("conv_id", "call_id", "status", "call_turn", "result_turn", "level", "position", "copies", "result_copies", F.array_join("errors", "; ").alias("errors"), line.alias("json"))


def identifier(conv_id: Column, turn: Column) -> Column:
    return F.md5(F.concat_ws(":", conv_id.cast("string"), turn.cast("string")))


def turn_calls(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of plain conversations: a user's turn calls a tool, the turn after it by the assistant answers.

    A call depends on the user's turn two turns before, if there is one. Rows with a null conversation, turn or role
    have no identifier and make no call; null texts have null arguments.
    """
    here, turn = F.col("conv_id"), F.col("turn")
    words = F.regexp_count("text", F.lit(WORD))
    arguments = F.to_json(F.struct(words.alias("words"), F.col("text").alias("prompt")))
    sure = messages.where("conv_id is not null and turn is not null")
    calls = sure.where("role = 'user'").select(
        "conv_id", "turn", identifier(here, turn).alias("call_id"), F.when(words <= 20, "lookup").otherwise("answer").alias("name"), arguments.alias("arguments"), identifier(here, turn - 2).alias("depends_on")
    )
    results = sure.where("role = 'assistant'").select("conv_id", "turn", identifier(here, turn - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results
