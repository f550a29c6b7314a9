"""The pruned vector search against a scan."""

import random

import pytest
from pyspark.sql import functions as F

from skeinworks.operators import retrieval, vector_index
from skeinworks.operators.vector_index import VectorIndex

SCHEMA = "vec_id long, embedding array<float>, n int"


def clusters(n, seed=3, dims=6, spread=0.08):
    rng = random.Random(seed)
    middles = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(12)]
    rows = []
    for k in range(n):
        scale = rng.choice([0.1, 1.0, 30.0])
        rows.append((k, [scale * (v + rng.gauss(0, spread)) for v in rng.choice(middles)], k))
    return rows


def plain(df, query, k):
    found = retrieval.vector_search(df, "embedding", df.sparkSession.createDataFrame([(query,)], "query array<float>"), k, "vec_id")
    return sorted((r.vec_id, round(r.score, 9)) for r in found.collect())


def test_equals_a_scan_and_prunes(spark, monkeypatch):
    monkeypatch.setattr(vector_index, "PER", 20)
    rows = clusters(600)
    odd = [(1000, None, 0), (1001, [0.0] * 6, 0), (1002, [1.0, 2.0], 0), (1003, rows[5][1], 0), (1003, rows[5][1], 0)]
    df = spark.createDataFrame(rows + odd, SCHEMA)
    index = VectorIndex.build(df, "embedding")
    asked = rows[::60] + [(-1, [-v for v in rows[7][1]], 0), (-2, [0.0] * 6, 0)]
    queries = spark.createDataFrame([(i, v) for i, v, _ in asked], "query_id long, query array<float>")
    for k in (5, 2):
        found = {}
        for r in index.search(queries, "query_id", "query", k, "vec_id").collect():
            found.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 9)))
        for i, v, _ in asked:
            assert sorted(found.get(i, [])) == plain(df.filter("embedding is null or size(embedding) = 6"), v, k), i
    some = spark.createDataFrame([(i, v) for i, v, _ in rows[::60]], "query_id long, query array<float>")
    assert index.share_read(some, "query_id", "query") < 0.4


@pytest.mark.parametrize("rows", [[], [(1, None, 0)], [(1, [1.0, 0.0], 0)]])
def test_small(spark, rows):
    index = VectorIndex.build(spark.createDataFrame(rows, SCHEMA), "embedding")
    queries = spark.createDataFrame([(1, [2.0, 0.0]), (2, None)], "query_id long, query array<float>")
    found = index.search(queries, "query_id", "query").select("query_id", "vec_id", F.round("score", 6)).collect()
    assert [tuple(r) for r in found] == ([(1, 1, 1.0)] if rows and rows[0][1] else [])


def test_chunks_of_cells_and_queries_give_the_same(spark, monkeypatch):
    """Chunks of a few rows, with many copies, odd vectors and ties: what SQL's order gives; no cosine is taken row by row."""
    for name, size in (("PER", 20), ("VECTORS", 7), ("QUERIES", 3), ("PAIRS", 16)):
        monkeypatch.setattr(vector_index, name, size)
    rows = clusters(300, 5) + [(1000 + k, [1.0, 2.0, 0.5, 0.0, -1.0, 3.0], 0) for k in range(60)]
    odd = [(2000, [1e-20] * 6, 0), (2001, [0.0] * 6, 0), (2002, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (2003, None, 0)]
    df = spark.createDataFrame(rows + odd, SCHEMA)
    asked = [*rows[::30], rows[-1], rows[-2], odd[0]]
    queries = spark.createDataFrame([(i, v) for i, v, _ in asked], "query_id long, query array<float>")
    index = VectorIndex.build(df, "embedding")
    wanted = [(i, *r) for i, v, _ in asked for r in plain(df, v, 5)]
    found = index.search(queries, "query_id", "query", 5, "vec_id")
    assert sorted((r.query_id, r.vec_id, round(r.score, 9)) for r in found.collect()) == sorted(wanted)
    assert "zip_with" not in found._jdf.queryExecution().toString()
