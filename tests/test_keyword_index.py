"""The keyword index against BM25 over the texts, before and after changes."""

import random

import pytest
from pyspark.sql import functions as F

from skeinworks.operators import keyword_index, retrieval
from skeinworks.operators.keyword_index import KeywordIndex

SCHEMA = "id long, text string"


def texts(rng, n, first=0):
    vocabulary = [f"w{k}" for k in range(60)]
    return [(first + k, " ".join(rng.choice(vocabulary[: rng.choice([3, 20, 60])]) for _ in range(rng.randint(0, 40)))) for k in range(n)]


def best(df, query, k):
    found = retrieval.bm25(df, "id", "text", query).select("id", F.round("score", 6).alias("score"))
    return [(r.id, r.score) for r in retrieval.top(found, "score", k, "id").collect()]


def searched(index, query, k):
    return [(r.id, r.score) for r in index.search(query, k).collect()]


def same(index, df, queries=("w1 w50", "w2 w2 w40 w59 none", "")):
    for q in queries:
        for k in (7, 1000)[: 2 if len(q) > 6 else 1]:
            assert searched(index, q, k) == best(df, q, k), (q, k)


def test_index_and_upkeep(spark, monkeypatch):
    monkeypatch.setattr(keyword_index, "BLOCK", 4)
    monkeypatch.setattr(keyword_index, "FIRST", 2)
    rng = random.Random(8)
    rows = dict(texts(rng, 300)) | {900: None, 901: "", 902: "w0 " * 3000}
    frame = lambda d: spark.createDataFrame(sorted(d.items()), SCHEMA)
    index = KeywordIndex.build(frame(rows), "id", "text")
    same(index, frame(rows))
    assert len(index.parts(0, ["w7"])) < index._read(0, "ranges").count()  # a term's files alone
    plan = index._postings(["w7"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "part" in plan.split("PartitionFilters")[1][:60]
    new, edited, gone = dict(texts(rng, 40, 2000)), dict(texts(rng, 30, 10)), [5, 6, 7, 902, 12345]
    index.apply(frame(new | edited), spark.createDataFrame([(g,) for g in gone], "id long"))
    now = {i: t for i, t in (rows | new | edited).items() if i not in gone}
    same(index, frame(now))
    again = dict(texts(rng, 10, 12))  # what was edited is edited again, and a deleted id comes back
    index.apply(frame(again | {5: "w0 w1"}))
    now |= again | {5: "w0 w1"}
    same(index, frame(now))
    rebuilt = KeywordIndex.build(frame(now), "id", "text")
    for _ in range(2):
        assert index.totals() == rebuilt.totals()
        assert sorted(map(tuple, index.terms().collect())) == sorted(map(tuple, rebuilt.terms().collect()))
        index.merge()
    assert len(index.generations()) == 1
    same(index, frame(now), ("w1 w50",))


def test_blocks_are_skipped_by_bound(spark, monkeypatch):
    monkeypatch.setattr(keyword_index, "BLOCK", 8)
    rows = [(k, "hot " * (1 + (k % 50 == 0) * 20) + "filler " * 30) for k in range(2000)]
    df = spark.createDataFrame(rows, SCHEMA)
    index = KeywordIndex.build(df, "id", "text")
    read = []
    named = KeywordIndex._named
    monkeypatch.setattr(KeywordIndex, "_named", staticmethod(lambda postings, blocks: read.append(len(blocks)) or named(postings, blocks)))
    assert searched(index, "hot", 10) == best(df, "hot", 10)
    total = index._postings(["hot"]).count()
    assert read[-1] < total / 4, (read, total)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, ""), (None, "a b"), (None, "a c")]])
def test_small(spark, rows):
    index = KeywordIndex.build(spark.createDataFrame(rows, SCHEMA), "id", "text")
    assert len(searched(index, "a", 5)) == (1 if len(rows) == 3 else 0)
    index.apply(spark.createDataFrame([(7, "a")], SCHEMA))
    assert 7 in [r[0] for r in searched(index, "a", 5)] and index.totals()[0] == len(rows) + 1


def test_terms_are_counted_where_rows_are(spark):
    rows = [(1, "Ab ab, cd-ab 42"), (2, None), (3, ""), (4, "ÄB äb x"), (4, "x y"), (None, "z z"), (None, "z")]
    df = spark.createDataFrame(rows, SCHEMA)
    counts = retrieval.counted(df, "id", "text")
    assert "Exchange" not in counts._jdf.queryExecution().executedPlan().toString()  # words were shuffled to be counted
    assert [r.n for r in counts.orderBy("id", "n").collect()] == [1, 2, 5, 0, 0, 2, 3]
    plain = df.select("id", F.explode(retrieval.tokens(F.col("text"))).alias("term")).groupBy("term", "id").agg(F.count("*").alias("tf"))
    found = retrieval.postings(df, "id", "text")
    assert sorted(map(str, found.collect())) == sorted(map(str, plain.collect()))
    some = df.filter("id < 4")
    assert "Exchange" not in retrieval.postings(some, "id", "text")._jdf.queryExecution().executedPlan().toString()
