"""A transactional sink over failures and replays, a queue source over stops, and buffers that outlive both."""

import glob
import json
import os
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rillspark.plans.base import clicks
from rillspark.sources import files, queue
from rillspark.streaming import processors, sinks, transactional

SF = "/root/testdata/sf0.001"
SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, vc bigint"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("once") / "in")
    for i in range(3):
        clicks(spark, SF).where(F.col("event_id") % 3 == i).coalesce(2).write.parquet(f"{path}/f{i}")
    return path


def stream(spark, path):
    return files.timed_stream(spark, path, SCHEMA, "ts", "60 days").select("event_id", "vc", "user_id", "ts")


def finished(writer):
    q = writer.trigger(availableNow=True).start()
    try:
        q.awaitTermination(120)
    finally:
        q.stop()


def once(spark, path, folder):
    got = [r["event_id"] for r in transactional.read_committed(spark, path, "event_id bigint, vc bigint").collect()]
    assert sorted(got) == sorted(r["event_id"] for r in spark.read.parquet(f"{folder}/*").select("event_id").collect())


def test_stop_and_resume(spark, folder, tmp_path):
    out, state = str(tmp_path / "out"), str(tmp_path / "c")
    assert transactional.read_committed(spark, out, "event_id bigint").count() == 0
    for part in (f"{folder}/f[01]", f"{folder}/*"):
        finished(transactional.committed_files(stream(spark, part).select("event_id", "vc"), out, state))
    once(spark, out, folder)
    assert transactional.vacuum(out) == 0


def test_a_task_that_dies_leaves_nothing_to_read(spark, folder, tmp_path):
    out, state, mark = str(tmp_path / "out"), str(tmp_path / "c"), str(tmp_path / "died")

    @F.udf("bigint")
    def dies_once(x):
        if x % 50 == 7 and not os.path.exists(mark):
            open(mark, "w").close()
            raise RuntimeError("the task dies here")
        return x

    rows = stream(spark, f"{folder}/*").select(dies_once("event_id").alias("event_id"), "vc")
    with pytest.raises(Exception, match="dies here"):
        finished(transactional.committed_files(rows, out, state))
    finished(transactional.committed_files(rows, out, state))
    once(spark, out, folder)
    transactional.vacuum(out)
    once(spark, out, folder)


def test_a_replayed_batch_changes_nothing(spark, folder, tmp_path):
    """The sink has committed, the query has not noted it: the micro-batch is run and committed again."""
    out, state = str(tmp_path / "out"), str(tmp_path / "c")
    rows = stream(spark, f"{folder}/*").select("event_id", "vc")
    finished(transactional.committed_files(rows, out, state))
    last = max(glob.glob(f"{state}/commits/*"), key=lambda f: int(os.path.basename(f)))
    before = len(glob.glob(f"{out}/commits/*.json"))
    os.remove(last)
    for crc in glob.glob(f"{state}/commits/.*.crc"):
        os.remove(crc)
    finished(transactional.committed_files(rows, out, state))
    assert len(glob.glob(f"{out}/commits/*.json")) == before
    once(spark, out, folder)


def test_writer_by_hand(tmp_path):
    writer = transactional.FileCommitter(str(tmp_path / "out"), "q")
    batch = pa.RecordBatch.from_pydict({"event_id": [1, 2]})

    def broken():
        yield batch
        raise RuntimeError("gone")

    with pytest.raises(RuntimeError):
        writer.write(broken())
    one, two, none = writer.write(iter([batch])), writer.write(iter([batch])), writer.write(iter([]))
    writer.commit([one, none], 5)
    writer.commit([two, None], 5)
    assert [c["files"] for c in transactional.commits(str(tmp_path / "out"))] == [[one.file]]
    three = writer.write(iter([batch]))
    writer.abort([three], 6)
    assert len(os.listdir(tmp_path / "out" / "rows")) == 2 and transactional.vacuum(str(tmp_path / "out")) == 1


def test_buffers_outlive_a_restart(spark, folder, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    out, state = str(tmp_path / "out"), str(tmp_path / "c")
    try:
        for part in (f"{folder}/f[01]", f"{folder}/*"):
            rows = processors.run(stream(spark, part), "user_id", processors.Buffered(10))
            finished(transactional.committed_files(rows, out, state))
        got = transactional.read_committed(spark, out, "user_id bigint, flush bigint, event_id bigint, vc bigint")
        sizes = got.groupBy("user_id", "flush").count().collect()
        per_user = {r["user_id"]: r["count"] for r in spark.read.parquet(f"{folder}/*").groupBy("user_id").count().collect()}
        assert all(r["count"] == 10 for r in sizes) and len(sizes) == sum(n // 10 for n in per_user.values())
        assert got.select("event_id").distinct().count() == got.count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


@pytest.fixture(scope="module")
def messages(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("queue") / "q")
    rows = clicks(spark, SF).withColumn("id", F.concat(F.lit("m"), (F.col("event_id") % 800).cast("string")))
    queue.publish(rows, path, F.col("id"), F.col("event_type"), F.col("ts"), parts=3, order=["event_id"])
    return path


def delivered(spark, out):
    return [(r["part"], r["place"]) for r in transactional.read_committed(spark, out, queue.SCHEMA).select("part", "place").collect()]


def run_until(spark, path, out, state, enough, consumer="consumer", query="query", prefetch=60):
    q = transactional.committed_files(queue.queue_stream(spark, path, consumer, prefetch), out, state, query).start()
    for _ in range(240):
        if q.exception() or enough():
            break
        time.sleep(0.25)
    progress = q.recentProgress
    q.stop()
    assert q.exception() is None
    return [p["numInputRows"] for p in progress if p["numInputRows"]]


def test_a_queue_is_read_once_over_a_stop(spark, messages, tmp_path):
    out, state = str(tmp_path / "out"), str(tmp_path / "c")
    total = spark.read.parquet(messages).count()
    first = run_until(spark, messages, out, state, lambda: len(transactional.commits(out)) >= 2)
    some = len(delivered(spark, out))
    assert 0 < some < total and max(first) <= 3 * 60
    run_until(spark, messages, out, state, lambda: sum(c["rows"] for c in transactional.commits(out)) >= total)
    got = delivered(spark, out)
    assert len(got) == total == len(set(got))
    ids = transactional.read_committed(spark, out, queue.SCHEMA)
    assert ids.where("correlation_id is null or sent is null or body is null").count() == 0


def test_what_was_not_acknowledged_comes_again(spark, messages, tmp_path):
    out = str(tmp_path / "out")
    run_until(spark, messages, out, str(tmp_path / "one"), lambda: len(transactional.commits(out)) >= 3, "again", "one")
    seen, acked = set(delivered(spark, out)), queue.acknowledged(messages, "again")
    assert acked and sum(acked.values()) < len(seen)
    more = str(tmp_path / "more")
    run_until(spark, messages, more, str(tmp_path / "two"), lambda: len(transactional.commits(more)) >= 1, "again", "two")
    again = set(delivered(spark, more))
    for part, n in acked.items():
        assert min(place for p, place in again if p == int(part)) == n
    assert again & seen


def test_ids_of_a_queue_count_once(spark, messages, tmp_path):
    rows = queue.queue_stream(spark, messages, "ids").withColumn("sent", F.col("sent")).withWatermark("sent", "60 days")
    rows = files.once_per_id_stream(rows.withColumnRenamed("correlation_id", "id"), "id").select("id")
    out = str(tmp_path / "out")
    finished(transactional.committed_files(rows, out, str(tmp_path / "c")))
    got = [r["id"] for r in transactional.read_committed(spark, out, "id string").collect()]
    assert len(got) == len(set(got)) == spark.read.parquet(messages).select("correlation_id").distinct().count()


def test_ledger_is_whole(messages):
    for f in glob.glob(f"{messages}/_acks/*.json"):
        with open(f) as text:
            assert set(json.load(text)) == {"acked", "planned"}
