"""A Merkle manifest of a table, and proofs by a recursive query.

Every row is a leaf, its group (a language) a binary tree over the leaves in order, and the groups' roots the leaves of
one more tree. A node is the hash of two consecutive ones below it; a last one without a neighbour is hashed alone.

Levels are built ``RUNG`` at a time: 2^RUNG consecutive nodes meet in one small list, which gives the next nodes and, for
each node of the list, one stored row: its ancestor ``RUNG`` levels up, its place below that, and the siblings on the way
there. These parent-linked rows number a sixteenth more than the leaves. A recursive query of Spark SQL then climbs from
each leaf to the root: each step joins the rows of all leaves to their nodes, appends a row with that step's siblings and
folds the leaf's hash, tampered or not, with them. A column of all siblings so far would be moved again at every step, so
siblings are appended as rows, and gathered once at the end. The query's limits on rows and depth are lifted for it.

Order within a tree is by ranges of about equal numbers of rows, so a group with most rows is spread like any other.
Digests are 32 bytes in tables and lower-case hexadecimal inside hashes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillspark.llm.common import staged

RUNG = 4
#: Identifiers of nodes: the number of the round in the bits above these, the first leaf below the node in these.
LEAF_BITS = 53


def hashed(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def hexed(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def field(value: Column) -> Column:
    """A value in a leaf: its length in bytes, a colon and itself; a null is a dash."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(*values: Column) -> Column:
    return hashed(*[field(v) for v in values])


@dataclass
class Manifest:
    """``leaves`` (node, tree, row, digest, other), ``nodes`` (node, parent, place, siblings), ``subroots`` (tree, subroot) and the root in hexadecimal."""

    leaves: DataFrame
    nodes: DataFrame
    subroots: DataFrame
    root: str | None


def numbered(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with a unique number ``at`` in the order (tree, then ``order``), their ``place`` within their tree, and the tree's size."""
    line = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order).withColumn("at", F.monotonically_increasing_id())
    line = staged(line, "leaves").withColumn("part", F.shiftright("at", 33))
    per = line.groupBy("tree", "part").agg(F.min("at").alias("least"), F.count("*").alias("n"))
    whole = Window.partitionBy("tree")
    before = F.sum("n").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    per = staged(per.select("tree", "part", (F.col("least") - F.coalesce(before, F.lit(0))).alias("zero"), F.sum("n").over(whole).alias("of")), "leaf-ranges")
    return line.join(per, ["tree", "part"]).withColumn("place", F.col("at") - F.col("zero")).drop("part", "zero")


def above(nodes: Column) -> Column:
    """The level above a list of consecutive nodes."""
    pair = lambda i: F.unhex(hashed(hexed(F.get(nodes, 2 * i)), F.coalesce(hexed(F.get(nodes, 2 * i + 1)), F.lit(""))))
    return F.transform(F.sequence(F.lit(0), F.shiftright(F.size(nodes) - 1, 1)), pair)


def climbed(level: DataFrame, number: int) -> tuple[DataFrame, DataFrame]:
    """(rows of the nodes of ``level`` (tree, place, of, node, digest), the level ``RUNG`` above it or its trees' roots)."""
    group = level.groupBy("tree", F.shiftright("place", RUNG).alias("up"), "of").agg(F.array_sort(F.collect_list(F.struct("place", "node", "digest"))).alias("list"))
    rows = group.withColumn("l0", F.transform("list", lambda x: x["digest"]))
    for k in range(RUNG):
        rows = rows.withColumn(f"l{k + 1}", above(F.col(f"l{k}")))
    # The only list of a tree ends at its root; in other trees every list goes up RUNG levels.
    height = F.when(F.col("of") <= 1 << RUNG, F.ceil(F.log2("of")).cast("int")).otherwise(RUNG)
    rows = rows.withColumn("height", height).withColumn("levels", F.array(*[f"l{k}" for k in range(RUNG + 1)]))
    parent = F.lit(number << LEAF_BITS) + F.col("list")[0]["node"].bitwiseAND(F.lit((1 << LEAF_BITS) - 1))
    sibling = lambda j: F.transform(F.sequence(F.lit(0), F.col("height") - 1), lambda k: F.get(F.get("levels", k), F.call_function("shiftright", j, k).bitwiseXOR(F.lit(1))))
    child = lambda x, j: F.struct(x["node"].alias("node"), F.col("parent"), j.alias("place"), sibling(j).alias("siblings"))
    rows = staged(rows.select("tree", "up", "of", parent.alias("parent"), "height", "levels", "list").select("tree", "up", "of", "parent", F.get(F.get("levels", F.col("height")), F.lit(0)).alias("digest"), F.transform("list", child).alias("children")), "rungs")
    nodes = rows.select(F.explode("children").alias("c")).select("c.*")
    return nodes, rows.select("tree", F.col("up").alias("place"), F.ceil(F.col("of") / (1 << RUNG)).alias("of"), F.col("parent").alias("node"), "digest")


def trees(leaves: DataFrame, number: int) -> tuple[DataFrame, DataFrame, int]:
    """(node rows, (tree, node, digest) of the trees' roots, the next round's number) of ``leaves`` (tree, place, of, node, digest)."""
    level, nodes, roots = leaves, [], []
    while True:
        roots.append(level.where("of = 1").select("tree", "node", "digest"))
        level = level.where("of > 1")
        if not level.head(1):
            break
        rows, level = climbed(level, number)
        nodes.append(rows)
        number += 1
    return union(nodes) if nodes else None, union(roots), number


def union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def tree_key(group: Column) -> Column:
    """A text that sorts nulls first, then by bytes."""
    return F.concat(F.when(group.isNull(), "0").otherwise("1"), F.coalesce(group.cast("string"), F.lit("")))


def manifest(table: DataFrame, group: str, order: str, digest: Column, other: Column | None = None, keep: tuple[str, ...] = ()) -> Manifest:
    """The Merkle manifest of ``table``: leaves of hexadecimal ``digest``, one tree per ``group``, in ``order`` (nulls first).

    Rows that share the order are ordered by digest, so reruns agree and repeated rows are leaves of their own. ``other``
    is a second digest of the row, to be folded in place of the first one. Null groups are a tree of their own. An empty
    table has no leaves, and None as its root. Only the columns in ``keep`` go along; texts are hashed where they lie.
    """
    rows = table.select(
        tree_key(F.col(group)).alias("tree"), F.col(order).alias("by"), F.unhex(digest).alias("digest"),
        F.unhex(digest if other is None else other).alias("other"), F.struct(*keep).alias("row") if keep else F.lit(None).alias("row"),
    )
    leaves = numbered(rows, [F.col("by").asc_nulls_first(), F.col("digest"), F.col("other")]).withColumn("node", F.col("at"))
    nodes, roots, number = trees(leaves.select("tree", "place", "of", "node", "digest"), 1)
    roots = staged(roots, "subroots")
    top = numbered(roots.select(F.lit("").alias("tree"), F.col("tree").alias("by"), "node", "digest"), [F.col("by")])
    upper, last, _ = trees(top.select("tree", "place", "of", "node", "digest"), number)
    root = last.select(hexed(F.col("digest")).alias("root")).head(1)
    known = [x for x in (nodes, upper) if x is not None]
    empty = table.sparkSession.createDataFrame([], "node bigint, parent bigint, place int, siblings array<binary>")
    return Manifest(leaves.select("node", "tree", "row", "digest", "other"), staged(union([empty, *known]), "nodes"), roots.select("tree", hexed(F.col("digest")).alias("subroot")), root[0]["root"] if root else None)


CLIMB = """
WITH RECURSIVE climb (leaf, step, node, folded, siblings) AS (
    SELECT node, 0, node, other, CAST(array() AS array<binary>) FROM {leaves}
    UNION ALL
    SELECT c.leaf, c.step + 1, n.parent,
           aggregate(sequence(0, size(n.siblings) - 1), c.folded, (f, k) -> unhex(sha2(concat(
               if(shiftright(n.place, k) % 2 = 1, coalesce(lower(hex(get(n.siblings, k))), ''), ''), lower(hex(f)),
               if(shiftright(n.place, k) % 2 = 0, coalesce(lower(hex(get(n.siblings, k))), ''), '')), 256))),
           n.siblings
    FROM climb c JOIN {nodes} n ON c.node = n.node
)
SELECT leaf, step, folded, siblings FROM climb
"""
LIMITS = ("spark.sql.cteRecursionRowLimit", "spark.sql.cteRecursionLevelLimit")


def climb(spark: SparkSession, known: Manifest) -> DataFrame:
    """For each leaf the hash that its ``other`` digest folds to at the root, and its siblings from the bottom up (no gaps)."""
    before = {name: spark.conf.get(name) for name in LIMITS}
    try:
        for name in LIMITS:
            spark.conf.set(name, -1)
        steps = staged(spark.sql(CLIMB, leaves=known.leaves, nodes=known.nodes), "climb")
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    last = F.max_by("folded", "step").alias("folded")
    path = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("step", "siblings"))), lambda x: x["siblings"]))
    return steps.groupBy(F.col("leaf").alias("node")).agg(last, F.filter(path, lambda x: x.isNotNull()).alias("siblings"))


def proofs(table: DataFrame, group: str, order: str, digest: Column, other: Column, keep: tuple[str, ...]) -> DataFrame:
    """``keep`` of each row with leaf, subroot, root, siblings (binary), folded_root and verified: whether ``other`` folds to the root."""
    known = manifest(table, group, order, digest, other, keep)
    rows = known.leaves.join(climb(table.sparkSession, known), "node").join(known.subroots, "tree")
    root = F.lit(known.root)
    return rows.select("row.*", hexed(F.col("digest")).alias("leaf"), "subroot", root.alias("root"), "siblings", hexed(F.col("folded")).alias("folded_root"), (hexed(F.col("folded")) == root).alias("verified"))
