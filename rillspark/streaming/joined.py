"""Two streams in one keyed state: all pairs of their histories, and tables that follow a change feed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillspark.streaming.processors import Ordered, run


class FullHistory(Ordered):
    """Every row of one side with every row of the other that its key has had: each new row meets the other side's list.

    Both lists only grow. A row comes out once with each partner, whichever of them came first.
    """

    fields = {"left_id": "bigint", "right_id": "bigint"}

    def open(self, handle):
        self.sides = [handle.getListState(name, "id bigint") for name in ("left", "right")]

    def row(self, key, row):
        mine, other = (0, 1) if row.is_left else (1, 0)
        self.sides[mine].appendValue((int(row.id),))
        partners = [x[0] for x in self.sides[other].get()]
        return [(key, int(row.id), p) if row.is_left else (key, p, int(row.id)) for p in partners]


def full_history(left: DataFrame, right: DataFrame, key: str, time: str, id_: str) -> DataFrame:
    """(key, left_id, right_id): an inner join of two streams by key, without any bound in time."""
    side = lambda df, is_left: df.select(key, time, id_, F.lit(is_left).alias("is_left"), F.lit(0).alias("vc"))
    return run(side(left, True).unionByName(side(right, False)), key, FullHistory(), "vc", (time, id_))


class Follow(Ordered):
    """A table that follows changes of its rows (``op`` CREATE, UPDATE or DELETE, and ``image``, the row after it).

    What comes out is the key's row after each change that counts; null once it is deleted. A change that is not newer
    than the last one that counted is a replay or came too late, and changes nothing.
    """

    fields = {"id": "id", "image": "string"}

    def open(self, handle):
        self.last = handle.getValueState("last", "at_us bigint, id bigint")

    def row(self, key, row):
        now = (int(row.at.value // 1000) if hasattr(row.at, "value") else int(row.at.timestamp() * 1_000_000), int(row.id))
        if self.last.exists() and now <= tuple(self.last.get()):
            return []
        self.last.update(now)
        return [(key, row.id, None if row.op == "DELETE" else row.image)]


def followed(feed: DataFrame, key: str, time: str, id_: str) -> DataFrame:
    """(key, id, image) after each change; upsert them by key, and delete where the image is null."""
    return run(feed.withColumn("vc", F.lit(0)), key, Follow(), "vc", (time, id_))
