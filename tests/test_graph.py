import random
from collections import defaultdict, deque

from pyspark.sql import functions as F

from skeinworks.operators import communities, graph, paths
from skeinworks.sources import graph_tables

FLAGS = "id long, name string, flags array<string>"


def edges(spark, pairs, kind="CALLS"):
    return spark.createDataFrame([(a, b, kind) for a, b in pairs], "source_id long, target_id long, type string")


def ids(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "id long")


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def breadth_first(pairs, seed, most):
    near = defaultdict(set)
    for a, b in pairs:
        near[a].add(b)
    found, todo = {}, deque([(seed, 0)])
    while todo:
        node, d = todo.popleft()
        if d == most:
            continue
        for x in sorted(near[node]):
            if x not in found:
                found[x] = d + 1
                todo.append((x, d + 1))
    return found


def test_tiny_graph(spark):
    e = edges(spark, [(1, 2), (2, 3), (3, 1), (4, 4), (1, 5), (None, 5)]).unionByName(edges(spark, [(1, 2)], "CALLS_VULNERABLE"))
    assert rows(graph.callers(e, ids(spark, 2)), "id", "caller") == [(2, 1)]  # two types on a pair are one caller
    assert rows(graph.reach(graph.calls(e), ids(spark, 1), 5), "node", "hops") == [(1, 3), (2, 1), (3, 2), (5, 1)]  # the seed over its cycle
    assert rows(graph.n_hop(e, ids(spark, 1, 4, 9), 2), "seed", "node") == [(1, 2), (1, 3), (1, 5)]
    assert rows(graph.reach(graph.calls(e), ids(spark, 1), 3, ids(spark, 2)), "node") == [(5,)]  # 2 isn't passed
    assert rows(graph.without_nodes(e.filter("source_id is not null"), ids(spark, 1)), "source_id", "target_id") == [(2, 3), (4, 4)]
    assert rows(graph.touching(edges(spark, [(1, 2), (2, 3), (4, 4)]), ids(spark, 1, 4)), "source_id", "target_id") == [(1, 2), (4, 4)]
    assert rows(graph.has_edge(e, ids(spark, 1, 2), "CALLS_VULNERABLE"), "id") == [(1,)]


def test_reach_against_plain_search(spark):
    rng = random.Random(3)
    pairs = {(rng.randrange(60), rng.randrange(60)) for _ in range(120)}
    found = rows(graph.reach(graph.calls(edges(spark, pairs)), ids(spark, 0, 1, 2), 6), "seed", "node", "hops")
    assert found == sorted((s, n, d) for s in (0, 1, 2) for n, d in breadth_first(pairs, s, 6).items())


def test_path_bound_and_ties(spark):
    chain = [(k, k + 1) for k in range(12)]
    found = paths.shortest_paths(edges(spark, chain), ids(spark, 0), ids(spark, 10, 11))
    assert rows(found, "sink", "hops") == [(10, 10)]  # ten edges are kept, eleven are not
    both = paths.shortest_paths(edges(spark, [(1, 9), (1, 3), (9, 5), (3, 5), (5, 5)]), ids(spark, 1), ids(spark, 5))
    assert rows(both, "path") == [([1, 3, 5],)]
    back = paths.paths_to(edges(spark, [(1, 2), (2, 3)]), ids(spark, 3))
    assert rows(back, "source", "sink", "path") == [(1, 3, [1, 2, 3]), (2, 3, [2, 3])]
    assert rows(paths.path_edges(back), "source_id", "target_id", "n_paths") == [(1, 2, 1), (2, 3, 2)]
    assert paths.shortest_paths(edges(spark, []), ids(spark, 1)).count() == 0


def test_flags(spark):
    nodes = spark.createDataFrame([(1, "a", []), (2, "b", ["X_RISK"]), (3, "c", ["VULN_UAF", "X_RISK"]), (4, "d", ["MEDIUM_RISK"])], FLAGS)
    assert rows(nodes.filter(paths.is_vulnerable(nodes.flags)), "id") == [(2,), (3,), (4,)]
    assert rows(nodes.filter(paths.is_vulnerable(nodes.flags, strict=True)), "id") == [(2,), (3,)]
    assert rows(nodes.select("id", paths.vulnerability_type(nodes.flags).alias("t")), "id", "t") == [(1, "UNKNOWN"), (2, "X"), (3, "UAF"), (4, "MEDIUM")]
    out = paths.propagate(edges(spark, [(1, 2), (1, 3), (9, 2)]), nodes)
    assert rows(out, "id", "flags")[0] == (1, ["CALLS_VULNERABLE_FUNCTION"])


def test_label_propagation(spark):
    clique = lambda *v: [(a, b) for a in v for b in v if a < b]
    e = edges(spark, clique(1, 2, 3, 4) + clique(10, 11, 12, 13) + [(4, 10), (20, 20)])
    labels = communities.label_propagation(graph.calls(e))
    assert rows(labels, "id", "label") == [(k, 1) for k in (1, 2, 3, 4)] + [(k, 10) for k in (10, 11, 12, 13)] + [(20, 20)]
    members = communities.merge_small(labels)
    assert (20, 1) in rows(members, "id", "community")  # a single node goes to the largest, of equals the least
    assert rows(communities.stats(members), "communities", "members", "largest") == [(2, 9, 5)]
    nodes = spark.createDataFrame([(k, None if k == 20 else f"FUN_{k}" if k < 4 else "recv_loop", ["NETWORK_CAPABLE"] if k == 10 else []) for k in (1, 2, 3, 4, 10, 11, 12, 13, 20)], FLAGS)
    assert rows(communities.records(members, nodes), "community", "title", "score") == [(1, "recv_loop_group (5)", 0), (10, "recv_loop_group (4)", 1)]
    assert "Likely purpose: network I/O." in rows(communities.summaries(members, nodes), "community", "summary")[1][1]


def test_no_edges(spark):
    assert communities.label_propagation(graph.calls(edges(spark, []))).count() == 0
    assert graph.siblings(edges(spark, [])).count() == 0


def test_building(spark):
    from skeinworks.operators import build

    functions = spark.createDataFrame(
        [(0, 9, "main", False, False, None), (16, 31, "thunk_a", True, False, 32), (32, 47, "thunk_b", True, False, 48), (48, 60, "real", False, False, None), (64, 70, "__imp__recv@16", False, True, None), (80, 90, "__imp__lost@4", True, False, None)],
        "address long, end_address long, name string, is_thunk boolean, is_external boolean, thunk_target long",
    )
    refs = spark.createDataFrame([(3, 17), (4, 50), (5, 64), (6, 81), (7, 999), (50, 48), (500, 0), (None, 16)], "from_addr long, to_addr long")
    assert rows(build.call_edges(functions, refs), "source_id", "target_id") == [("0", "48"), ("0", "ext:lost"), ("0", "ext:recv"), ("48", "48")]
    assert rows(build.reference_edges(functions, refs), "source_id", "target_id") == [(0, 16), (0, 48), (0, 64), (0, 80)]


def test_long_and_endless_thunks(spark):
    from skeinworks.operators import build

    n = 100
    chain = [(16 * k, 16 * k + 15, f"t{k}", k < n, False, 16 * (k + 1) if k < n else None) for k in range(n + 1)]
    cycle = [(10_000 + 16 * k, 10_015 + 16 * k, f"c{k}", True, False, 10_000 + 16 * (1 + k % 3)) for k in range(4)]
    kind = "address long, end_address long, name string, is_thunk boolean, is_external boolean, thunk_target long"
    functions = spark.createDataFrame(chain + cycle, kind)
    ends = dict(rows(build.resolved_thunks(functions), "address", "real"))
    assert ends == {16 * k: 16 * n for k in range(n + 1)} | {10_000 + 16 * k: 10_000 + 16 * k for k in range(4)}
    refs = spark.createDataFrame([(16 * n + 3, 0), (16 * n + 4, 10_000)], "from_addr long, to_addr long")
    assert rows(build.call_edges(functions, refs), "source_id", "target_id") == [(str(16 * n), str(16 * n)), (str(16 * n), "ext:c0")]


def test_records(spark):
    from skeinworks.operators import build

    pending = spark.createDataFrame([(5, None, 2, "late"), (5, None, 1, None), (None, "x", 3, None), (None, "x", 4, "y")], "address long, name string, seq int, content string")
    assert sorted((r.seq, r.content) for r in build.first_wins(pending).collect()) == [(1, "late"), (3, "y")]
    wanted = spark.createDataFrame([("a", "b", "RELATED_TO", 7.0), ("a", "b", "RELATED_TO", None), ("a", "c", "CALLS", 0.5), ("x", "y", "IMPLEMENTS", -1.0)], "source_id string, target_id string, type string, confidence double")
    none = wanted.filter("false")
    assert rows(build.user_edges(wanted, none), "source_id", "weight") == [("a", 1.0), ("x", 0.0)]
    assert build.user_edges(wanted, wanted).count() == 0
    items = build.todo_items(spark.createDataFrame([(1, "# plan\n- [x] one\n2. two\n* three\nfree text\n- ")], "o int, t string"), "o", "t")
    assert rows(items, "seq", "task", "priority") == [(1, "one", 10), (2, "two", 9), (3, "three", 8)]


def test_shared_thrice_at_small_and_large_hubs(spark, monkeypatch):
    """Small hubs: pairs are counted where they meet, no pair meets all its neighbours again. Large hubs: the same by filtering first."""
    e = [(h, 1000 + k % 40) for h in range(60) for k in (h, 3 * h, 7 * h, 11 * h)]
    found = graph.siblings(edges(spark, e), "callers", 3)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    both = rows(found, "id", "other", "shared")
    monkeypatch.setattr(graph, "MEETINGS", 0)
    assert both and rows(graph.siblings(edges(spark, e), "callers", 3), "id", "other", "shared") == both
    hubs = {}
    for h, k in set(e):
        hubs.setdefault(h, []).append(k)
    counts = {}
    for of in hubs.values():
        for a in of:
            for b in of:
                if a != b:
                    counts[a, b] = counts.get((a, b), 0) + 1
    assert both == sorted((a, b, n) for (a, b), n in counts.items() if n >= 3)


def test_user_edges_deal_pairs_out(spark):
    from skeinworks.operators import build, merge

    left = spark.range(300, numPartitions=1).selectExpr("id as source_id", "if(id < 250, 1, id) as k", "'RELATED_TO' as type")
    right = spark.range(80, numPartitions=1).selectExpr("id as target_id", "1L as k")
    pairs = merge.dealt_join(left, right, ["k"], "source_id", 500)
    assert pairs.distinct().count() == pairs.count() == 250 * 80
    tasks = pairs.groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) > 10 and max(r["count"] for r in tasks) < 5000  # one task made all 20 000
    schema = "source_id long, target_id long, type string, confidence double"
    wanted = spark.createDataFrame([(1, 2, "RELATED_TO", 3.0), (1, 2, "RELATED_TO", 0.2), (1, 3, "RELATED_TO", None), (None, 3, "DEPENDS_ON", -1.0), (4, 5, "CALLS", 0.5)], schema)
    there = spark.createDataFrame([(1, 3, "RELATED_TO", None), (None, 3, "DEPENDS_ON", None), (9, 9, "RELATED_TO", None)], schema)
    found = build.user_edges(wanted, there)
    assert sorted(map(tuple, found.collect()), key=str) == [(1, 2, "RELATED_TO", 1.0), (None, 3, "DEPENDS_ON", 0.0)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0  # edges meet once


def test_labels_around_what_moved(spark, monkeypatch):
    """Rounds around moved nodes give what rounds over all give; the pairs are made once."""
    e = [(k, k + 1) for k in range(1, 9)] + [(k, k + 2) for k in range(100, 112)] + [(k % 7 + 200, k % 11 + 205) for k in range(50)]
    of = lambda few: (monkeypatch.setattr(communities, "FEW", few), rows(communities.label_propagation(graph.calls(edges(spark, e))), "id", "label"))[1]
    all_, some = of(10**9), of(0)
    assert all_ == some
    near, label = {}, {}
    for a, b in set(e):
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    label = {k: k for k in near}
    for _ in range(100):
        votes = {k: [label[k], *(label[x] for x in near[k])] for k in near}
        new = {k: min(set(v), key=lambda x: (-v.count(x), x)) for k, v in votes.items()}
        if new == label:
            break
        label = new
    assert some == sorted(label.items())


def test_layer_calls_are_dealt_out_by_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(graph_tables, "LINES", 50, raising=False)
    lines = [(k // 4, k % 7, k % 3) for k in range(2000)]
    lines = spark.createDataFrame(lines + lines, "l_orderkey long, l_partkey long, l_suppkey long")
    orders = spark.createDataFrame([(k % 9, k) for k in range(500)] * 2, "o_custkey long, o_orderkey long")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    found = graph_tables.layer_calls(spark, str(tmp_path), unique=True)
    assert found.count() == found.distinct().count() == 500 + lines.select("l_orderkey", "l_partkey").distinct().count() + lines.select("l_orderkey", "l_suppkey").distinct().count()
    most = found.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert most <= 200
    degrees = lambda **unique: rows(graph.degrees(found, **unique), "id", "n_callers", "n_callees")
    assert degrees(unique=True) == degrees()
