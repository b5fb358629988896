"""Conversation structure repair: the cheapest edits that make a conversation's roles follow (s?(ua)+)?.

Every row is a symbol: its role's initial and its fault. A conversation's symbols are its signature. The cheapest edits
from a row on depend on the suffix of the signature alone, and on how far the grammar has come. So distinct signatures,
whatever conversations they come from, are read from the end: sorted by their reversed form, those that share a suffix
follow each other, and a task that walks through them keeps the one path of suffix nodes that it stands on. A node is
made once for all signatures below it; it holds, for each state of the grammar, the cost to go and the first of the best
edits (as each of the four edits begins with another letter, the first letters settle every tie, and the best audit of a
suffix is the chain of first edits). Memory is one signature, whatever their number; no rounds are needed.

Rows of one conversation are put in order by ranges, so a conversation with a third of all rows is spread; rows that are
equal in all respects count once, with their number. The repaired text is hashed as rows stream by in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillspark.llm.common import small_batches, staged, with_groups

#: States of the grammar: nothing yet, after a system turn, after a user's, after an assistant's. It may end in the first and last.
START, SYSTEM, USER, ASSISTANT = range(4)
#: In each state, the one turn of a user or an assistant that may come next, and the state after it.
NEXT = {START: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}
#: Where the role of a row that is kept leads.
KEEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 3, 4, 3, 3
FAR = 1 << 60

#: A symbol is the role's initial (s, u, a, or - for all others); in upper case (= for -) the row is truncated; a digit is
#: the row to be deleted, by its role: 0 s, 1 u, 2 a, 3 others.
TRUNCATED = dict(zip("SUA=", "sua-", strict=True))
DELETED = "0123"


def node(symbol: str | None, below: list[int] | None) -> tuple[list[int], str]:
    """Of a suffix that begins with ``symbol``: cost to go and first edit in each state, given the costs of the suffix after it.

    Without a symbol it is the end, where edits insert what the grammar still needs.
    """
    cost, edit = [FAR] * 4, [""] * 4
    for state in range(4):
        if symbol is None:
            cost[state] = 0 if state in (START, ASSISTANT) else FAR
            continue
        cost[state], edit[state] = DELETE_COST + below[state], "D"
        if symbol in DELETED:
            continue
        more, role = (TRUNCATED_COST, TRUNCATED[symbol]) if symbol in TRUNCATED else (0, symbol)
        if (state, role) in KEEP:
            cost[state], edit[state] = min((cost[state], edit[state]), (more + below[KEEP[state, role]], "K"))
        cost[state], edit[state] = min((cost[state], edit[state]), (REROLE_COST + more + below[NEXT[state][1]], "R"))
    for _ in range(2):  # two inserted turns lead from any state to all that can be reached
        for state in range(4):
            cost[state], edit[state] = min((cost[state], edit[state]), (INSERT_COST + cost[NEXT[state][1]], "I"))
    return cost, "".join(e or "." for e in edit)


class Suffixes:
    """The path of suffix nodes of the signature that was read last; the next one keeps what it shares with it."""

    def __init__(self) -> None:
        self.symbols: list[str] = []
        self.nodes = [node(None, None)]
        self.made: dict[tuple[str | None, tuple[int, ...]], tuple[list[int], str]] = {}
        self.count = 0

    def read(self, signature: str) -> tuple[int, str]:
        """(cost, audit) of the cheapest repair."""
        backwards = signature[::-1]
        shared = 0
        while shared < min(len(backwards), len(self.symbols)) and backwards[shared] == self.symbols[shared]:
            shared += 1
        del self.symbols[shared:], self.nodes[shared + 1 :]
        for symbol in backwards[shared:]:
            self.nodes.append(self.grown(symbol))
            self.symbols.append(symbol)
        return self.nodes[-1][0][START], self.audit()

    def grown(self, symbol: str) -> tuple[list[int], str]:
        """The node above the last one. Nodes whose costs differ by one number in all states are alike but for that number."""
        self.count += 1
        below = self.nodes[-1][0]
        least = min(below)
        shape = (symbol, tuple(c - least for c in below))
        if shape not in self.made:  # few shapes exist: edits lead from any state to any other at a bounded cost
            self.made[shape] = node(symbol, list(shape[1]))
        cost, edit = self.made[shape]
        return [c + least for c in cost], edit

    def audit(self) -> str:
        """The chain of first edits from the last node's start state to the end."""
        out, state, at = [], START, len(self.symbols)
        while at or self.nodes[at][1][state] == "I":
            edit = self.nodes[at][1][state]
            out.append(edit)
            if edit == "I":
                state = NEXT[state][1]
                continue
            symbol = self.symbols[at - 1]
            if edit == "K":
                state = KEEP[state, TRUNCATED.get(symbol, symbol)]
            elif edit == "R":
                state = NEXT[state][1]
            at -= 1
        return "".join(out)


def repairs(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = Suffixes()
    for batch in frames:
        found = [known.read(s) for s in batch.column("signature").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("signature"), pa.array([c for c, _ in found], pa.int64()), pa.array([a for _, a in found], pa.string())], ["signature", "cost", "audit"])


def cheapest(signatures: DataFrame) -> DataFrame:
    """(signature, cost, audit) of distinct ``signatures``, in ranges of their reversed forms."""
    line = signatures.select("signature").distinct().repartitionByRange(F.reverse("signature")).sortWithinPartitions(F.reverse("signature"))
    return line.mapInArrow(repairs, "signature string, cost bigint, audit string")


def faults(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, text, copies) with the digest of the text and whether it is blank or breaks off."""
    last = F.rtrim("text", F.lit(" \t\n\x0b\x0c\r"))
    return rows.withColumns({
        "digest": F.unhex(F.sha2("text", 256)), "blank": F.length(last) == 0,
        "broken": (F.length(last) > 0) & ~F.substring(last, -1, 1).isin(".", "!", "?"),
    })


def symbol() -> tuple[Column, Column]:
    """The symbol of a row's first copy, and that of the others."""
    kind = F.substring("role", 1, 1)
    order = F.when(kind == "s", 1).when(kind == "u", 2).when(kind == "a", 3).otherwise(4)
    pick = lambda letters: F.substring(F.lit(letters), order, F.lit(1))
    first = F.when(F.col("blank") | ~F.col("is first"), pick(DELETED)).when(F.col("broken"), pick("".join(TRUNCATED))).otherwise(pick("".join(TRUNCATED.values())))
    return first, pick(DELETED)


def signatures(rows: DataFrame) -> DataFrame:
    """Per conversation of ``faults``: its signature, gaps, and how many rows have each fault.

    Turns ascend, nulls first; rows of one turn go by role, then by the digest of their text.
    """
    small = rows.groupBy("conv", "turn", "role", "digest", "blank", "broken").agg(F.sum("copies").alias("copies"))
    small = staged(small, "turns")
    turn = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"))
    firsts = small.where("copies > 0").groupBy("conv", "role", "digest").agg(F.min(turn).alias("first"), F.count("*").alias("turns"))
    small = with_groups(small, firsts, ["conv", "role", "digest"], "turns", small.count())
    first, others = symbol()
    small = small.withColumn("is first", F.coalesce(F.col("first") == turn, F.lit(False)))
    marked = small.select("conv", "turn", "role", "digest", "copies", "blank", "broken", "is first", F.when(F.col("copies") > 0, F.concat(first, F.repeat(others, (F.col("copies") - 1).cast("int")))).otherwise("").alias("symbols"))
    order = ["conv", F.col("turn").asc_nulls_first(), "role", "digest"]
    line = staged(marked.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "ordered-turns")
    piece = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "symbols"))), lambda x: x["symbols"]), "")
    count = lambda n: F.coalesce(F.sum(n), F.lit(0)).cast("bigint")
    there = F.col("copies") > 0
    # The first copy of a row is no duplicate where it is the text's first; blank rows are blank, whatever they repeat.
    part = line.groupBy("conv", F.shiftright("at", 33).alias("part")).agg(
        piece.alias("piece"),
        count(F.when(F.col("blank"), F.col("copies"))).alias("blank"),
        count(F.when(~F.col("blank"), F.col("copies") - F.col("is first").cast("int") * there.cast("int"))).alias("duplicate"),
        count(F.when(F.col("broken") & F.col("is first") & there, 1)).alias("truncated"),
    )
    whole = part.groupBy("conv").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "piece"))), lambda x: x["piece"]), "").alias("signature"),
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")],
    )
    turns = line.where(there).groupBy("conv").agg(F.max("turn").alias("high"), F.min("turn").alias("low"), F.count_distinct("turn").alias("turns"))
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).cast("bigint")
    return whole.join(turns.select("conv", gaps.alias("gaps")), "conv", "left").withColumn("gaps", F.coalesce("gaps", F.lit(0).cast("bigint")))


def illegal(signature: Column) -> Column:
    """How many neighbours are not a system's and a user's turn, a user's and an assistant's, or these two the other way round."""
    roles = F.translate(signature, "SUA=0123", "sua-sua-")
    legal = F.regexp_count(roles, F.lit("s(?=u)|u(?=a)|a(?=u)"))
    return (F.greatest(F.length(roles) - 1, F.lit(0)) - legal).cast("bigint")


RESULT = "blank bigint, duplicate bigint, truncated bigint, gaps bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
HEAD = [f.split()[0] for f in RESULT.split(", ")][:-1]


def hashes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Conversations' own rows after their head row, in order: applies the head's audit and hashes what comes out."""
    head, digest, lines, at, state = None, None, 0, 0, START

    def line(text: str) -> None:
        nonlocal lines
        digest.update(("\n" if lines else "").encode())
        digest.update(text.encode())
        lines += 1

    def inserted() -> None:
        nonlocal at, state
        while at < len(head[-1]) and head[-1][at] == "I":
            role, state = NEXT[state]
            line(f"{role}:")
            at += 1

    def ended() -> list:
        inserted()
        return [*head[:1], *head[1:], digest.hexdigest()]

    for frame in frames:
        out = []
        for conv, turn, role, text, copies, *rest in frame[["conv", "turn", "role", "text", "copies", *HEAD]].itertuples(index=False):
            if copies == 0:  # the head row
                if head is not None:
                    out.append(ended())
                head, digest, lines, at, state = [conv, *rest], hashlib.sha256(), 0, 0, START
                continue
            for _ in range(int(copies)):
                inserted()
                edit = head[-1][at]
                at += 1
                if edit == "K":
                    state = KEEP[state, role[:1]]
                    line(f"{role}:{text}")
                elif edit == "R":
                    role_now, state = NEXT[state]
                    line(f"{role_now}:{text}")
        if out:
            yield pd.DataFrame(out, columns=["conv", *HEAD, "repaired_sha256"])
    if head is not None:
        yield pd.DataFrame([ended()], columns=["conv", *HEAD, "repaired_sha256"])


def repaired(rows: DataFrame) -> DataFrame:
    """Per conversation of ``rows`` (conv, turn, role, text, copies): its faults, cheapest repair, and the repaired text's SHA-256.

    ``conv`` is a text without nulls; role and text have no nulls either; rows of 0 copies only name their conversation.
    Of equal rows of a turn all but the first are duplicates. A role that is empty or begins with no s, u or a can't be
    kept. A text of any length is one row. A table without rows gives none.
    """
    small_batches(rows.sparkSession)
    rows = faults(rows)
    whole = signatures(rows).withColumn("illegal", illegal(F.col("signature")))
    whole = staged(whole, "signatures")
    per = whole.groupBy("signature").agg(F.count("*").alias("conversations"))
    best = staged(cheapest(per), "repairs").join(per, "signature")
    heads = with_groups(whole, best, ["signature"], "conversations", whole.count())
    heads = heads.select("conv", F.lit(0).alias("copies"), *HEAD)
    body = rows.where("copies > 0").select("conv", "turn", "role", "digest", "text", F.col("copies").cast("int").alias("copies"))
    both = body.unionByName(heads, allowMissingColumns=True)
    line = both.repartition("conv").sortWithinPartitions("conv", F.col("copies") > 0, F.col("turn").asc_nulls_first(), "role", "digest")
    return line.drop("digest").mapInPandas(hashes, f"conv string, {RESULT}")
