from pyspark.sql import functions as F

from skeinworks.functions import features, names, texts
from skeinworks.operators import merge, retrieval, sessions
from skeinworks.streaming.events import stable_end


def applied(spark, function, values, kind="string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r[0] for r in df.orderBy("k").select(function(F.col("v"))).collect()]


def test_names(spark):
    assert applied(spark, names.api_name, ["__imp__recv@16", "___main", "_", "@12", "f@x", None]) == ["recv", "main", "_", "@12", "f@x", None]
    assert applied(spark, names.external_name, ["___main", None]) == ["_main", "unknown"]
    assert applied(spark, names.thunk_name, ["thunk_foo", "__imp__WSARecv@28", None]) == ["foo", "WSARecv", "unknown_thunk"]
    assert applied(spark, names.library_name, ["WS2_32.dll::send", "KERNEL32.DLL_WSARecvFrom", "::x"]) == ["send", "WSARecvFrom", "::x"]
    assert applied(spark, names.is_default, ["Class::FUN_00401000", "j_x", "", None, "main", "dat_12", "local_4", "a0", "Foo::"]) == [True, True, True, True, False, True, True, False, False]
    assert applied(spark, names.hex_address, ["0xff", "10", "zz", "", "123456789abcdef0", None]) == [255, 16, 0, 0, 0, 0]


def test_string_kinds(spark):
    values = ["10.0.0.1", "999.1.1.1", "0.0.0.0", "http://a.b/c", "HKEY_LOCAL_MACHINE\\x", "/etc/passwd", "C:\\Windows\\x", "evil.com", "kernel32.dll", "ab", "", None, " a.io "]
    assert applied(spark, features.string_kind, values) == ["ip", None, "ip", "url", "registry", "path", "path", "domain", None, None, None, None, "domain"]


def test_calls_and_risk(spark):
    code = "if (x) { strcpy(a, recv(s)); while (1) fopen(f); Strlen (q) } for(;;)"
    assert applied(spark, features.called_names, [code, None, ""]) == [["Strlen", "fopen", "recv", "strcpy"], [], []]
    df = spark.createDataFrame([(["recv", "_fopen@4", "strcpy"],), (["connect"],), ([],)], "calls array<string>").withColumns(features.api_columns(F.col("calls")))
    none = F.array().cast("array<string>")
    c = {k: F.col(k) for k in ("network", "file", "crypto", "process", "risks")} | {k: none for k in ("ips", "urls", "domains", "paths", "registry")}
    profile = features.profile(c["network"], c["file"], c["crypto"], c["process"])
    found = df.select(profile.alias("p"), features.risk_score(c).alias("s"), features.risk_level(features.risk_score(c)).alias("l")).collect()
    assert [tuple(r) for r in found] == [("NETWORK_IO, MIXED_IO", 10, "HIGH"), ("NETWORK_CLIENT", 2, "LOW"), ("NONE", 0, "LOW")]


def test_texts(spark):
    assert applied(spark, texts.summary_category, ["Encrypts it", "opens a socket", "nothing", None]) == ["crypto", "network", "utility", None]
    assert applied(spark, texts.role, ["user", "Tool Call", "", None, "Critic"]) == ["user", "tool_call", "unknown", "unknown", "critic"]
    assert applied(spark, lambda c: texts.truncated(c, 3), ["abcd", "abc", None]) == ["abc...", "abc", None]
    assert applied(spark, lambda c: texts.section(c, "Summary"), ["**Summary:** it is\n**Other:** x", "Summary: a\n\nRisk: b", "none", None]) == ["it is", "a", None, None]
    assert applied(spark, texts.json_of_answer, ['x ```json\n{"a": 1}\n``` y', 'z {"b": 2} w']) == ['{"a": 1}', '{"b": 2}']
    assert applied(spark, lambda c: texts.snippet(c, "zz needle", 10), ["a" * 20 + "needle" + "b" * 20, "short", ""]) == ["..." + "a" * 5 + "needl" + "...", "short", ""]
    assert texts.search_words("a AND b* or not c") == ["a", "b", "c"]


def test_chunks(spark):
    long = "\n\n".join("x" * n for n in (100, 450, 10, 600, 30, 499))
    df = spark.createDataFrame([(1, long), (2, ""), (3, None), (4, "short"), (5, "y" * 499 + "\n\n" + "z"), (6, "y" * 500 + "\n\n" + "z")], "id int, text string")
    found = retrieval.chunks(df, "id", "text").orderBy("id", "chunk_id").collect()
    parts = {}
    for r in found:
        parts.setdefault(r.id, []).append(r.content)
    assert {k: "".join(v) for k, v in parts.items()} == {1: long, 4: "short", 5: "y" * 499 + "\n\nz", 6: "y" * 500 + "\n\nz"}
    assert len(parts[5]) == 1 and len(parts[6]) == 2 and all(len(p) >= 502 for p in parts[1][:-1])


def test_search(spark):
    df = spark.createDataFrame([(1, "a b b"), (2, "a"), (3, None), (4, "c")], "id int, text string")
    found = {r.id: r.score for r in retrieval.bm25(df, "id", "text", "b zz").collect()}
    assert list(found) == [1]
    assert [r.id for r in retrieval.full_text(df, "text", ["B", "c"]).orderBy("id").collect()] == [1, 4]
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 0.1])], "id int, v array<float>")
    hits = retrieval.vector_search(v, "v", v.filter("id = 1").select(F.col("v").alias("query")), 5, "id").collect()
    assert [h.id for h in hits] == [1, 3]


def test_merges(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, name string, n int")
    new = spark.createDataFrame([(2, None, 5), (3, "c", 6)], "k int, name string, n int")
    once = merge.upsert(old, new, "k", ["name"], ["n"]).drop("change")
    assert sorted(map(tuple, once.collect())) == [(1, "a", 1), (2, "b", 5), (3, "c", 6)]
    assert sorted(map(tuple, merge.upsert(once, new, "k", ["name"], ["n"]).drop("change").collect())) == sorted(map(tuple, once.collect()))
    spans = spark.createDataFrame([("f", 0, 99), ("g", 50, 60)], "f string, a long, b long")
    refs = spark.createDataFrame([(0,), (55,), (99,), (100,), (None,)], "at long")
    assert sorted((r["at"], r.f) for r in merge.intervals_containing(refs, "at", spans, "a", "b", 32).collect()) == [(0, "f"), (55, "f"), (55, "g"), (99, "f")]


def test_tool_calls(spark):
    calls = spark.createDataFrame([(1, ["x", "y"]), (2, ["z"]), (3, [])], "message int, call_ids array<string>")
    results = spark.createDataFrame([("x",), ("z",), ("w",)], "call_id string")
    assert sorted(r.message for r in sessions.complete_calls(calls, results).collect()) == [2, 3]


def test_stable_blocks():
    assert stable_end("") == 0
    assert stable_end("one\ntwo") == 0
    assert stable_end("one\n\ntwo") == 5
    assert stable_end("```\n# no\n") == 0
    assert stable_end("```\n# no\n```\nx") == 13
    assert stable_end("| a |\n| b |\n") == 0
    assert stable_end("# head\ntext") == 7


def test_fixed_values():
    """The catalogue by value: numbers of names, and the ones that are easily lost."""
    from skeinworks.functions import catalog

    assert {k: len(v) for k, v in catalog.CATEGORIES.items()} == {"network": 175, "file": 205, "crypto": 46, "process": 40}
    assert {"CancelIo", "CancelIoEx", "CancelSynchronousIo"} <= catalog.FILE
    assert (len(catalog.TAINT_SOURCES), len(catalog.TAINT_SINKS), len(catalog.SENDERS), len(catalog.RECEIVERS), len(catalog.ENTRY_NAMES)) == (31, 52, 19, 17, 19)
    assert sum(len(v) for v in catalog.DANGEROUS.values()) == sum(len(set(v)) for v in catalog.DANGEROUS.values())


def test_long_spans_and_hubs(spark):
    """A span of 2 ** 40 goes to two blocks; a hub with 3000 callees makes 11 pairs for each of them."""
    from skeinworks.operators import build, communities, graph, merge

    spans = spark.createDataFrame([("f", -5, 1 << 40), ("g", 7, 7)], "f string, a long, b long")
    refs = spark.createDataFrame([(7,), (-6,), (1 << 39,), ((1 << 40) + 1,)], "at long")
    assert sorted((r["at"], r.f) for r in merge.intervals_containing(refs, "at", spans, "a", "b").collect()) == [(7, "f"), (7, "g"), (1 << 39, "f")]
    hub = spark.range(1, 3001).selectExpr("0L as source_id", "id as target_id", "'CALLS' as type")
    found = graph.similar(hub).groupBy("id").agg(F.count("*").alias("n"), F.min("other").alias("least"), F.max("other").alias("most")).collect()
    assert len(found) == 3000 and all((r.n, r.least, r.most) == ((10, 2, 11) if r.id == 1 else (10, 1, 10 if r.id > 10 else 11)) for r in found)
    pending = spark.createDataFrame([(1, None, None, "a"), (2, None, None, "b"), (3, 5, "n", None), (4, 5, "n", "c")], "seq int, address long, name string, content string")
    assert sorted((r.seq, r.content) for r in build.first_wins(pending).collect()) == [(1, "a"), (2, "b"), (3, "c")]
    calls = spark.range(1, 8).selectExpr("id as source_id", "0L as target_id", "'CALLS' as type")
    plain = spark.range(8).selectExpr("id", "concat('f', id) as name", "id as address", "array() as flags", "cast(null as string) as summary")
    context = {r.id: r.context for r in build.local_context(plain, calls, 100, 3).collect()}
    assert "**Called by:**\n- f1\n- f2\n- f3\n- (+4 more)" in context[0] and "- f0" in context[5]
    members = spark.range(2000).selectExpr("id", "1L as community")
    nodes = spark.range(2000).selectExpr("id", "concat('name', lpad(id, 4, '0')) as name", "array('X') as flags")
    text = communities.summaries(members, nodes).first().summary
    assert text.startswith("Community of 2000 functions. Key functions: name0000, name0001, name0002, name0003, name0004 (+1995 more). ")


def test_clean_json(spark):
    cases = {
        '```json\n{"a": 1}\n```': '{"a": 1}',
        "'''[1, 2]'''": "[1, 2]",
        '"{"a": 1}"': '{"a": 1}',
        "'{\"a\": 1}'": '{"a": 1}',
        '"just words': '"just words',
        '"not {json"': '"not {json"',
        '{\\"a\\": 1}': '{"a": 1}',
        '{"a": "say \\"x\\""}': '{"a": "say \\"x\\""}',
        '{"a":1,\\n"b":2}': '{"a":1,\n"b":2}',
        '{"a":"{"b":1"}"}': '{"a":{"b":1"}}',
        "": "",
        None: None,
    }
    assert applied(spark, texts.clean_json, list(cases)) == list(cases.values())
    items = applied(spark, texts.json_items, ['[{"a": 1}, 2]', '{"a": 1}', "no json", None])
    assert items == [['{"a":1}', "2"], ['{"a": 1}'], None, None] or items == [['{"a": 1}', "2"], ['{"a": 1}'], None, None]


def test_semantic_analysis_of_a_hub(spark):
    from skeinworks.operators import access

    nodes = spark.range(50).selectExpr("id", "concat('f', lpad(id, 2, '0')) as name", "id as address", "if(id = 3, null, 'code') as content", "if(id = 0, 'opens a socket', null) as summary", "0.5 as confidence", "array('X') as flags")
    edges = spark.range(1, 50).selectExpr("id as source_id", "0L as target_id", "'CALLS' as type")
    none = spark.createDataFrame([], "id long, community long, title string")
    found = {r.id: r for r in access.semantic_analysis(nodes, edges, none, 3).collect()}
    assert (found[0].callers, found[0].n_callers, found[0].category) == ("f01,f02,f03", 49, "network")
    assert not found[3].indexed and found[3].callees is None and found[3].flags is None and found[4].callees == "f00"
    asked = spark.createDataFrame([(1, 7, None), (2, 999, "f05"), (3, None, "nothing")], "ask long, address long, name string")
    assert sorted((r.ask, r.id) for r in access.looked_up(asked, nodes).collect() if r.id is not None) == [(1, 7), (2, 5)]
