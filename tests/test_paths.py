"""Pruned path search, range joins and shared neighbours against plain versions."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from skeinworks.operators import graph, merge, paths

PAIRS = "source_id long, target_id long"


def ids(spark, values):
    return spark.createDataFrame([(v,) for v in values], "id long")


def plain_paths(pairs, sources, sinks, hops):
    out = defaultdict(list)
    for a, b in sorted(pairs):
        out[a].append(b)
    found = []
    for s in set(sources):
        best, level = {s: (s,)}, {s: (s,)}
        for _ in range(hops):
            new = {}
            for node, path in level.items():
                for t in out[node]:
                    if t not in best:
                        new[t] = min(new.get(t, (*path, t)), (*path, t))
            best |= new
            level = new
        found += [(s, t, len(p) - 1, list(p)) for t, p in best.items() if t in set(sinks) and t != s]
    return sorted(found)


def rows(df):
    return sorted((r.source, r.sink, r.hops, r.path) for r in df.collect())


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_shortest_paths(spark, seed):
    rng = random.Random(seed)
    pairs = {(rng.randrange(40), rng.randrange(40)) for _ in range(90)}
    sources, sinks = rng.sample(range(44), 6), rng.sample(range(44), 6)
    df = spark.createDataFrame(sorted(pairs), PAIRS)
    for hops in (1, 3, 10):
        expected = plain_paths(pairs, sources, sinks, hops)
        assert rows(paths.shortest_paths(df, ids(spark, [*sources, sources[0], None]), ids(spark, sinks), hops)) == expected
    assert rows(paths.shortest_paths(df, ids(spark, sources), ids(spark, sinks), 10, max_paths=4)) == expected[:4]


def test_bound_of_hops_and_empty_sets(spark):
    df = spark.createDataFrame([(k, k + 1) for k in range(20)] + [(None, 3), (3, None)], PAIRS)
    assert [r[:3] for r in rows(paths.shortest_paths(df, ids(spark, [0]), ids(spark, [10, 11])))] == [(0, 10, 10)]
    assert rows(paths.shortest_paths(df, ids(spark, []), ids(spark, [3]))) == rows(paths.shortest_paths(df, ids(spark, [3]), ids(spark, []))) == []


def test_dead_branches_never_enter_a_frontier(spark, monkeypatch):
    """99 of 100 nodes hang from the sources and lead to no sink."""
    live = [(k, k + 1) for k in range(6)]
    dead = [(k % 3, 1000 + k) for k in range(700)]
    dead += [(1000 + k, 2000 + k) for k in range(700)]
    met = []
    stored = paths.stored

    def watched(df, name):
        out, n = stored(df, name)
        if name in ("level", "next", "live"):
            met.extend(r[0] for r in out.select("node").collect())
        return out, n

    monkeypatch.setattr(paths, "stored", watched)
    df = spark.createDataFrame(live + dead, PAIRS)
    assert rows(paths.shortest_paths(df, ids(spark, [0, 1, 2]), ids(spark, [6]))) == plain_paths(live + dead, [0, 1, 2], [6], 10)
    assert max(met) <= 6


def test_paths_to(spark):
    pairs = [(1, 3), (2, 3), (3, 5), (4, 5), (1, 4), (5, 1)]
    found = rows(paths.paths_to(spark.createDataFrame(pairs, PAIRS), ids(spark, [5])))
    assert found == [(1, 5, 2, [1, 3, 5]), (2, 5, 2, [2, 3, 5]), (3, 5, 1, [3, 5]), (4, 5, 1, [4, 5])]


def test_path_records(spark):
    nodes = spark.createDataFrame([(1, "a", 16, []), (2, None, 255, ["BUFFER_OVERFLOW_RISK"]), (3, "c", 3, [])], "id long, name string, address long, flags array<string>")
    found = spark.createDataFrame([(1, 2, 2, [1, 9, 2]), (9, 2, 1, [9, 2])], "source long, sink long, hops int, path array<long>")
    (record,) = paths.path_records(found, nodes).collect()
    assert (record.source, record.sink, record.severity) == (1, 2, "HIGH")
    assert record.json == '{"source":"a","source_address":"0x10","sink":"sub_ff","sink_address":"0xff","severity":"HIGH","path_length":2,"path":[{"name":"a","address":"0x10"},{"name":"sub_ff","address":"0xff"}]}'


def test_intervals_of_all_bit_lengths(spark):
    """Spans about every power of two, at awkward places, with refs at and around their ends and inside."""
    top, rng = 2**63 - 1, random.Random(4)
    spans, refs = [], set()
    for k in range(63):
        for more in (-1, 0, 1, 2):
            for first in (0, 2**k - 1, -(2**k), -1, rng.randrange(-(2**62), 2**62)):
                last = first + 2**k + more - 1
                if last <= top and first <= last:
                    spans.append((len(spans), first, last))
                    refs |= {x for x in (first - 1, first, first + 6, (first + last) // 2, last, last + 1) if -top <= x <= top}
    spans += [(len(spans), -top - 1, top), (len(spans) + 1, 5, 4), (len(spans) + 2, None, 9), (len(spans) + 3, -(2**62), 2**62 + 1)]
    refs = [*sorted(refs)[::7], None]
    a = spark.createDataFrame([(r,) for r in refs], "at long")
    b = spark.createDataFrame(spans, "span long, first long, last long")
    expected = Counter((r, s) for s, x, y in spans if x is not None for r in refs if r is not None and x <= r <= y)
    for narrowest in (1, 1000):
        assert Counter((r["at"], r["span"]) for r in merge.intervals_containing(a, "at", b, "first", "last", narrowest).collect()) == expected


def test_siblings(spark):
    rng = random.Random(6)
    pairs = sorted({(rng.randrange(30), 100 + rng.randrange(60)) for _ in range(400)} | {(99, 100 + k) for k in range(60)})
    edges = spark.createDataFrame([(a, b, "CALLS") for a, b in pairs] + [(None, 100, "CALLS"), (3, None, "CALLS"), (3, 101, "REFERENCES")], f"{PAIRS}, type string")
    of = defaultdict(set)
    for a, b in pairs:
        of[b].add(a)
    for least in (1, 2, 3, 5):
        expected = sorted((x, y, len(of[x] & of[y])) for x in of for y in of if x != y and len(of[x] & of[y]) >= least)
        for chunk in (1000, 7):
            assert sorted(map(tuple, graph.siblings(edges, "callers", least, chunk).collect())) == expected


def test_a_large_hub_spreads_over_tasks_and_meets_nobody_where_two_are_asked_for(spark):
    hub = spark.range(100_000).select(F.lit(-1).cast("long").alias("hub"), "id")
    some = spark.createDataFrame([(k % 5, k) for k in range(20)], "hub long, id long")
    edges = hub.union(some).select(F.col("hub").alias("source_id"), F.col("id").alias("target_id"), F.lit("CALLS").alias("type"))
    found = graph.siblings(edges, "callers", 2)
    assert sorted(map(tuple, found.collect())) == sorted((x, y, 2) for x in range(20) for y in range(20) if x != y and x % 5 == y % 5)
    sized = hub.withColumn("n", F.lit(100_000))
    keys = sized.select("hub", F.pmod(F.xxhash64("id"), F.lit(100)).alias("a"))
    assert keys.groupBy("hub", "a").count().agg(F.max("count")).first()[0] < 1300  # what a key of two chunks holds on one side
