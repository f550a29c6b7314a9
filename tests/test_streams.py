"""Streams that stop and go on: delta accumulation and the work queue."""

import random

import pytest
from pyspark.sql import functions as F

from skeinworks.streaming import events as S
from skeinworks.streaming.accumulate import Growing, deltas
from skeinworks.streaming.work_queue import WorkQueue, without_repeats

CHUNKS = "key string, seq long, chunk string, last boolean, ts timestamp"


def test_growing():
    rng = random.Random(1)
    for _ in range(50):
        text, g = "", Growing()
        for _ in range(12):
            new = "".join(rng.choice("aé\0 😀") for _ in range(rng.randint(0, 4)))
            cumulative = bool(text) and rng.random() < 0.5
            chunk = text + new if cumulative else new
            expected = chunk[len(text) :] if text and chunk.startswith(text) else chunk
            assert g.add(chunk) == (expected, bool(text) and chunk.startswith(text))
            text += expected
            assert g.signs == len(text)


def chunks_of(spark, path, rows):
    df = spark.createDataFrame(rows, "key string, seq long, chunk string, last boolean, at long").withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + 60 * F.col("at"))).drop("at")
    df.coalesce(1).write.mode("append").parquet(path)


def test_accumulation_goes_on_after_a_stop(spark, tmp_path):
    source, folder = f"{tmp_path}/in", f"{tmp_path}/out"
    spark.createDataFrame([], CHUNKS).write.parquet(source)

    def run():
        stream = spark.readStream.schema(CHUNKS).option("maxFilesPerTrigger", 1).parquet(source)
        found = S.run(deltas(stream, "60 minutes", 600), "x", folder=folder).collect()
        return sorted(((r.key, r.seq, r.delta, r.size, r.cumulative, r.ended) for r in found), key=str)

    chunks_of(spark, source, [("a", 0, "ab", False, 0), ("b", 1, "late first", False, 0), ("a", 1, "abc", False, 1)])
    assert run() == [("a", 0, "ab", 2, False, None), ("a", 1, "c", 3, True, None)]
    # again what was there, the gap of b, and the end of a
    chunks_of(spark, source, [("a", 1, "abc", False, 1), ("b", 0, None, False, 2), ("a", 2, "x", True, 3), ("a", 3, "after the end", False, 3)])
    second = [("a", 0, "ab", 2, False, None), ("a", 1, "c", 3, True, None), ("a", 2, "x", 4, False, "last"), ("b", 0, "", 0, False, None), ("b", 1, "late first", 10, False, None)]
    assert run() == second
    assert run() == second  # nothing new, nothing again
    # the watermark passes b: what waits is taken although a chunk is missing, then b ends
    chunks_of(spark, source, [("b", 3, "late first!", False, 4), (None, 0, "n", True, 5), ("c", None, "no number", False, 5)])
    chunks_of(spark, source, [("d", 0, "d", True, 500)])
    found = run()
    assert [r for r in found if r[0] == "b"][2:] == [("b", 3, "!", 11, True, None), ("b", 4, "", 11, None, "idle")]
    assert ("d", 0, "d", 1, False, "last") in found and len(found) == len(second) + 4


def items(spark, path, rows):
    spark.createDataFrame(rows, "id long, at long").withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + 60 * F.col("at"))).select("id", "ts").coalesce(1).write.mode("append").parquet(path)


def worker():
    """The work as a closure, which Spark can send without this file."""

    def work(rows):
        if any(r["id"] % 5 >= r["attempt"] for r in rows):
            raise ValueError("no")
        return [str(r["id"] * 2) for r in rows]

    return work


def outcome(queue):
    return sorted((r.id, r.attempts, r.result, r.status) for r in queue.outcomes().collect())


def test_queue_dies_halfway_and_goes_on(spark, tmp_path):
    source, folder = f"{tmp_path}/in", f"{tmp_path}/queue"
    items(spark, source, [(k % 30, 0) for k in range(60)])
    stream = lambda: without_repeats(spark.readStream.schema("id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(source), ["id"], "ts", "60 minutes")
    expected = sorted((k, min(k % 5, 3) + 1, str(2 * k) if k % 5 < 4 else None, "done" if k % 5 < 4 else "given_up") for k in range(30))

    def dies(done):
        raise RuntimeError("the machine is lost")

    broken = WorkQueue(spark, ["id"], worker(), size=4, index=dies, folder=folder)
    with pytest.raises(Exception, match="lost"):
        broken.run(stream())
    calls = spark.sparkContext.accumulator(0)

    work = worker()

    def counted(rows):
        calls.add(len(rows))
        return work(rows)

    index = lambda done: done.agg(F.count("*").alias("n"), F.sum(F.col("result").cast("long")).alias("total"))
    queue = WorkQueue(spark, ["id"], counted, size=4, index=index, folder=folder)
    queue.run(stream())
    assert outcome(queue) == expected and calls.value == 0  # all attempts were there
    assert [tuple(r) for r in queue.indexed().select("n", "total").collect()] == [(24, sum(2 * k for k in range(30) if k % 5 < 4))]
    before = sorted(map(str, queue.outcomes().collect()))
    queue.process(spark.createDataFrame([(99,)], "id long"), 0)  # a batch that is in the ledger
    assert sorted(map(str, queue.outcomes().collect())) == before


def test_queue_state_is_bounded(spark, tmp_path):
    source = f"{tmp_path}/in"
    for k in range(5):
        items(spark, source, [(100 * k + j, 1000 * k) for j in range(100)])
    queue = WorkQueue(spark, ["id"], lambda rows: ["x"] * len(rows), folder=f"{tmp_path}/queue")
    query = queue.run(without_repeats(spark.readStream.schema("id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(source), ["id"], "ts", "10 minutes"))
    assert queue.outcomes().count() == 500
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) <= 200
