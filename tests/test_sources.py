"""The record source, packed texts and bucketed snapshots: round trips, failures, untouched files."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from skeinworks.operators import merge
from skeinworks.operators.snapshots import Snapshot
from skeinworks.sources import packed, records

SCHEMA = "id long, name string, flags array<string>, notes map<string,string>, at struct<line: int, file: string>"
ROWS = [(1, "a\nb", ["x", None], {"k": "v"}, (3, "f")), (2, None, [], {}, None), (None, "é ", None, None, (None, None))]


def stored(spark, path):
    return spark.read.format(records.register(spark)).option("path", path).schema(SCHEMA).load()


def test_records_round_trip(spark, tmp_path):
    name, path = records.register(spark), f"file://{tmp_path}/r"
    df = spark.createDataFrame(ROWS * 5, SCHEMA).repartition(2)
    df.write.format(name).option("path", path).option("records", 4).mode("append").save()
    assert sorted(map(str, stored(spark, path).collect())) == sorted(map(str, df.collect()))
    store, base = records._store(path)
    assert len(records.manifest(store, base)) >= 4
    df.limit(1).write.format(name).option("path", path).mode("append").save()
    assert stored(spark, path).count() == 16
    df.limit(2).write.format(name).option("path", path).mode("overwrite").save()
    assert stored(spark, path).count() == 2
    assert stored(spark, f"file://{tmp_path}/nothing").count() == 0


def test_a_failing_chunk_leaves_nothing_visible(spark, tmp_path):
    name, path = records.register(spark), f"file://{tmp_path}/r"
    spark.createDataFrame(ROWS, SCHEMA).write.format(name).option("path", path).mode("append").save()
    bad = spark.createDataFrame(ROWS * 9, SCHEMA).coalesce(1).withColumn("id", F.when(F.col("name").isNull(), F.raise_error(F.lit("a broken row")).cast("long")).otherwise(F.col("id")))
    with pytest.raises(Exception, match="broken row"):
        bad.write.format(name).option("path", path).option("records", 1).mode("append").save()
    assert stored(spark, path).count() == 3
    assert len([d for d in glob.glob(f"{tmp_path}/r/chunks/*") if os.path.isdir(d)]) == 1  # those of the failed job are deleted


def test_chunks_are_sent_again(tmp_path, monkeypatch):
    calls = []

    def flaky(store, path, lines):
        calls.append(len(lines))
        if len(calls) % 3:
            raise OSError("try again")

    monkeypatch.setattr(records, "send", flaky)
    writer = records.RecordWriter(f"file://{tmp_path}/r", 2, 5, False)
    rows = [type("R", (), {"asDict": lambda self, recursive: {"a": 1}})() for _ in range(5)]
    assert len(writer.write(iter(rows)).chunks) == 3 and calls == [2, 2, 2, 2, 2, 2, 1, 1, 1]
    monkeypatch.setattr(records, "send", lambda *_: (_ for _ in ()).throw(OSError("down")))
    with pytest.raises(OSError, match="down"):
        records.RecordWriter(f"file://{tmp_path}/r", 2, 1, False).write(iter(rows))


def test_packed_texts(spark, monkeypatch):
    monkeypatch.setattr(packed, "FILE", 40)
    rows = [(k, "é" * (k % 7)) for k in range(50)] + [(None, None), (3, "again"), (60, "x" * 100)]
    df = spark.createDataFrame(rows, "id long, text string").repartition(3)
    places, folder = packed.pack(df, "id", "text")
    assert places.select("file").distinct().count() > 3
    found = packed.unpack(places, folder)
    assert sorted((str(r.key), r.size, r.content) for r in found.collect()) == sorted((str(i), len((t or "").encode()), t or "") for i, t in rows)
    assert [r.content for r in packed.unpack(places.filter("key = 60"), folder).collect()] == ["x" * 100]
    assert packed.unpack(*packed.pack(df.filter("false"), "id", "text")).count() == 0


def test_snapshots_rewrite_what_they_touch(spark):
    old = spark.createDataFrame([(k, f"n{k}", None if (k or 0) % 2 else "c", 1.0, "old") for k in [*range(200), None]], "id long, name string, content string, rank double, change string")
    table = Snapshot.create(old, ["id"], 32)
    before = set(table.read().inputFiles())
    new = spark.createDataFrame([(5, "five", None, 2.0), (1000, "new", "c", 2.0)], "id long, name string, content string, rank double")
    touched = table.upsert(new, ["name", "content"], ["rank"])
    after = set(table.read().inputFiles())
    assert touched == len(after - before) <= 2
    assert len(before & after) >= len(before) - 2  # all other files keep their names
    expected = merge.upsert(old, new, "id", ["name", "content"], ["rank"])
    assert sorted(map(str, table.read().select("id", "name", "content", "rank").collect())) == sorted(map(str, expected.select("id", "name", "content", "rank").collect()))
    table.delete(spark.createDataFrame([(k,) for k in range(100)], "id long"))
    assert table.read().count() == 102
    assert table.insert_or_ignore(spark.createDataFrame([(150, "x", "x", 0.0, "new"), (3, "x", "x", 0.0, "new")], old.schema)) <= 2
    assert table.read().filter("change = 'new'").select("id").collect()[0].id == 3 and table.read().count() == 103
    table.replace(spark.createDataFrame([(150, "y", "y", 0.0, "put")], old.schema))
    assert [r.name for r in table.read().filter("id = 150").collect()] == ["y"]
    assert table.upsert(new.filter("false"), ["name", "content"], ["rank"]) == 0
    empty = Snapshot.create(old.filter("false"), ["id"], 4)
    assert empty.read().count() == 0
    empty.insert_or_ignore(old.limit(3))
    assert empty.read().count() == 3
