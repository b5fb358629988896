"""Patterns against their definition, spelled out; streams against batches, with rows out of order."""

import json
import random

import pytest
from pyspark.sql import functions as F

from rillspark.operators.automata import Automaton, Pattern, matches
from rillspark.sources import files
from rillspark.streaming import sinks
from rillspark.streaming.automata import pattern_stream

def fits(kind):
    return F.col("kind") == kind


#: A pattern's making, the kinds of its steps, their links after the first, and its limit.
PATTERNS = {
    "strict": (lambda: Pattern.begin("x", fits("a")).next("y", fits("b")).next("z", fits("a")), "aba", ["strict", "strict"], None),
    "times": (lambda: Pattern.begin("x", fits("a")).times(3, consecutive=True), "aaa", ["strict", "strict"], None),
    "followed": (lambda: Pattern.begin("x", fits("a")).followed_by("y", fits("b")).within(30), "ab", ["relaxed"], 30),
    "two relaxed": (lambda: Pattern.begin("x", fits("a")).followed_by("y", fits("b")).followed_by("z", fits("c")).within(60), "abc", ["relaxed", "relaxed"], 60),
    "any": (lambda: Pattern.begin("x", fits("a")).followed_by_any("y", fits("b")).next("z", fits("c")).within(40), "abc", ["any", "strict"], 40),
    "any twice": (lambda: Pattern.begin("x", fits("a")).followed_by_any("y", fits("b")).followed_by_any("z", fits("c")).within(25), "abc", ["any", "any"], 25),
    "times relaxed": (lambda: Pattern.begin("x", fits("a")).times(3).within(90), "aaa", ["relaxed", "relaxed"], 90),
    "one step": (lambda: Pattern.begin("x", fits("c")), "c", [], None),
    "strict within": (lambda: Pattern.begin("x", fits("a")).next("y", fits("b")).within(10), "ab", ["strict"], 10),
}


def defined(rows, kinds, links, within):
    """(status, ids) of one key's rows (at, id, kind), in order."""
    out = []

    def extend(path):
        n, j = len(path), path[-1]
        if n == len(kinds):
            out.append(("matched", tuple(rows[i][1] for i in path)))
            return
        over = lambda: out.append(("timeout", tuple(rows[i][1] for i in path))) if within is not None else None
        end = float("inf") if within is None else rows[path[0]][0] + within
        for r in range(j + 1, len(rows)):
            at, _, kind = rows[r]
            if at >= end:
                break
            if kind == kinds[n]:
                extend([*path, r])
                if links[n - 1] != "any":
                    return
            elif links[n - 1] == "strict":
                return
        over()

    for i, (_, _, kind) in enumerate(rows):
        if kind == kinds[0]:
            extend([i])
    return sorted(out)


def drawn(seed, n=400):
    rng = random.Random(seed)
    return [(i, rng.randrange(300), rng.choice([None, 1, 1, 2, 3]), rng.choice("aabbcd")) for i in range(n)]


SCHEMA = "id long, at long, key long, kind string"


def found(df):
    return sorted(((r["key"] is None, r["key"] or 0), r["status"], tuple(e["row"]["id"] for e in r["events"])) for r in df.collect())


def wanted(rows, kinds, links, within):
    per = {}
    for i, at, key, kind in rows:
        per.setdefault(key, []).append((at, i, kind))
    return sorted(((k is None, k or 0), *x) for k, mine in per.items() for x in defined(sorted(mine), kinds, links, within))


@pytest.mark.parametrize("name", PATTERNS)
def test_batches_follow_the_definition(spark, name):
    make, *rest = PATTERNS[name]
    pattern = make()
    rows = drawn(len(name))
    df = spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_seconds("at")).repartition(4)
    assert found(matches(df, pattern, "key", "ts", ["id"], ["id"])) == wanted(rows, *rest)
    assert matches(df.where("false"), pattern, "key", "ts", ["id"], ["id"]).count() == 0


@pytest.mark.parametrize("name", ["strict", "two relaxed", "any twice"])
def test_streams_equal_batches(spark, tmp_path, name):
    """Rows come up to 20 s out of order, in four files; a last one far ahead lets the watermark pass all."""
    make, *rest = PATTERNS[name]
    pattern = make()
    rows = [(i, at, key or 0, kind) for i, at, key, kind in drawn(7, 150)]
    rng = random.Random(2)
    arrival = sorted(rows, key=lambda r: r[1] + rng.random() * 20)
    for n, part in enumerate([arrival[:40], arrival[40:80], arrival[80:], [(10**6, 10**6, 9, "d")]]):
        df = spark.createDataFrame(part, SCHEMA).withColumn("ts", F.timestamp_seconds("at"))
        df.coalesce(1).write.parquet(f"{tmp_path}/in/f{n}")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        df = files.timed_stream(spark, f"{tmp_path}/in/*", f"{SCHEMA}, ts timestamp", "ts", "30 seconds")
        table = f"pattern_{name.replace(' ', '_')}"
        q = sinks.memory_table(pattern_stream(df, pattern, "key", "ts", ["id"], ["id"]), table, "append", str(tmp_path / "c"))
        q.awaitTermination(180)
        q.stop()
        assert found(spark.table(table)) == wanted(rows, *rest)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_partial_matches_share_rows_and_leave(spark):
    pattern = PATTERNS["any twice"][0]()
    machine = Automaton(pattern.steps, 10_000_000)
    for i, kind in enumerate("aaabbb"):
        machine.feed(i, "abc".index(kind) and 2 or 1, json.dumps(i))
    # Three begun, nine with a second row: the three rows of the second step are one entry each.
    assert len(machine.runs) == 12 and len(machine.buffer) == 6
    assert len(machine.feed(7, 4, "c")) == 9
    assert len(machine.expire(10**9)) == 12 and not machine.buffer
