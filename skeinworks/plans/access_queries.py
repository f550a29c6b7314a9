"""Queries on records, names in taint sets, communities in order, sources and sinks, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skeinworks.functions import names, texts
from skeinworks.operators import access, communities, graph, paths, retrieval, sessions
from skeinworks.plans.graph_queries import PARTS, chain_sql, labels_sql, paths_sql, reach_sql
from skeinworks.plans.record_queries import _messages
from skeinworks.plans.text_queries import CHUNKS
from skeinworks.sources import graph_tables as G
from skeinworks.sources import packed, records
from skeinworks.sources import tables as T
from skeinworks.sources.tables import table

#: Names that every third part has in turn, beside the names of the table.
CALLED = ("recv", "WS2_32.dll::send", "strcpy", "main", "__imp__recv@16", "system", "fgets", "_WSASend@28", "FUN_00401000", "memcpy", "DllMain", "open", "getenv", "SSL_read", "write", "plain_helper")
QUERY = "the tion and haer"


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.chain_nodes(spark, sf_dir)


def _named(spark, sf_dir):
    """Parts, every third with a name of CALLED, and their calls."""
    nth = F.get(F.array(*map(F.lit, CALLED)), F.pmod(F.floor(F.col("id") / 3), F.lit(len(CALLED))).cast("int"))
    return _parts(spark, sf_dir).withColumn("name", F.when(F.col("id") % 3 == 0, nth).otherwise(F.col("name"))), G.chain_calls(spark, sf_dir)


def named_taint_sets(spark, sf_dir):
    """Sources, sinks, entry points, senders and receivers by flag, own name and names of what they call."""
    nodes, edges = _named(spark, sf_dir)
    found = None
    for kind, ids in (("is_source", paths.sources(nodes, edges)), ("is_sink", paths.sinks(nodes, edges)), ("is_entry", paths.entries(nodes)), ("sends", paths.senders(nodes, edges)), ("receives", paths.receivers(nodes, edges))):
        one = ids.select("id", F.lit(kind).alias("kind"))
        found = one if found is None else found.unionByName(one)
    kinds = ("is_source", "is_sink", "is_entry", "sends", "receives")
    return found.groupBy("id").agg(*[F.bool_or(F.col("kind") == k).alias(k) for k in kinds])


def named_network_edges(spark, sf_dir):
    nodes, edges = _named(spark, sf_dir)
    send = paths.send_edges(edges, paths.entries(nodes), paths.senders(nodes, edges), 4).withColumn("type", F.lit("NETWORK_SEND"))
    return send.unionByName(paths.receive_edges(edges, paths.receivers(nodes, edges)).withColumn("type", F.lit("NETWORK_RECV")))


def taint_stats(spark, sf_dir):
    return paths.taint_stats(*_named(spark, sf_dir))


def paths_to_sink(spark, sf_dir):
    """Shortest paths to parts that a COMMAND_INJECTION_RISK makes sinks, from all that reach them."""
    sinks = _parts(spark, sf_dir).filter(F.array_contains("flags", "COMMAND_INJECTION_RISK")).select("id")
    found = paths.paths_to(graph.calls(G.chain_calls(spark, sf_dir)), sinks, 4)
    return found.select("source", "sink", "hops", F.array_join("path", ">").alias("path"))


def address_lookup(spark, sf_dir):
    """Customers by (nation, key), renamed ones pending; wanted are those of one segment."""
    c = table(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c_name", "c_acctbal", "c_mktsegment")
    rows = c.select(F.col("c_nationkey").alias("binary_id"), F.col("c_custkey").alias("address"), F.col("c_name").alias("name"))
    pending = c.filter("c_acctbal < 0").select(F.col("c_nationkey").alias("binary_id"), F.col("c_custkey").alias("address"), F.concat("c_name", F.lit("_pending")).alias("name"))
    wanted = c.filter("c_mktsegment = 'BUILDING'").select(F.col("c_nationkey").alias("binary_id"), F.col("c_custkey").alias("address"))
    return access.by_keys(access.pending_first(rows, pending, "binary_id", "address"), wanted, "binary_id", "address")


def _with_loops(spark, sf_dir):
    """Calls between parts, and of every tenth part to itself."""
    loops = _parts(spark, sf_dir).filter("id % 10 = 0").select(F.col("id").alias("source_id"), F.col("id").alias("target_id"), F.lit("CALLS").alias("type"))
    return G.chain_calls(spark, sf_dir).unionByName(loops)


def node_edges(spark, sf_dir):
    """Edges of parts with a flag, out and in."""
    return access.edges_of(_with_loops(spark, sf_dir), _parts(spark, sf_dir).filter(F.size("flags") > 0)).groupBy("id", "other", "direction").agg(F.count("*").alias("n"))


def edge_tests(spark, sf_dir):
    edges, nodes = _with_loops(spark, sf_dir), _parts(spark, sf_dir)
    return access.edge_tests(edges, nodes, "CALLS")


def edges_between(spark, sf_dir):
    """Whether each part calls the next one or itself."""
    nodes = _parts(spark, sf_dir)
    pairs = nodes.select(F.col("id").alias("source_id"), F.explode(F.array(F.col("id"), F.col("id") + 1)).alias("target_id"))
    return access.edges_between(_with_loops(spark, sf_dir), pairs, "CALLS")


def node_tests(spark, sf_dir):
    """Tests of parts: features, content and flags depend on their sizes; kinds are those of findings and edges."""
    some = lambda test: F.when(F.expr(test), F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    p = table(spark, sf_dir, "part", "p_partkey", "p_size", "p_name").withColumns({
        "flags": some("p_size % 5 = 0"), "network_apis": some("p_size = 1"), "ip_addresses": some("p_size = 2"), "urls": some("p_size = 3"), "domains": some("p_size = 4"),
        "file_io_apis": some("p_size % 7 = 0"), "file_paths": some("p_size % 11 = 0"), "registry_keys": some("p_size = 13"),
        "crypto_apis": some("p_size = 17"), "process_apis": some("p_size = 19"), "dangerous_functions": some("p_size = 23"),
        "content": F.expr("case when p_size % 3 = 0 then p_name when p_size % 3 = 1 then '' end"), "summary": F.expr("case when p_size % 4 = 0 then p_name end"),
        "kind": F.expr("case p_size % 4 when 0 then 'buffer_overflow' when 1 then 'USE_AFTER_FREE' when 2 then 'RELATED_TO' end"), "severity": F.expr("case p_size % 3 when 0 then 'critical' when 1 then 'NONE' end"),
        "address": F.expr("case when p_size % 2 = 0 then p_partkey else 0 end"),
    })
    return p.select(
        F.col("p_partkey").alias("id"), access.has_flags().alias("has_flags"), access.has_network_activity().alias("network"), access.has_file_activity().alias("files"), access.features_empty().alias("empty"),
        access.is_indexed(F.col("content"), F.col("summary")).alias("indexed"), access.needs_security_update(F.col("flags"), F.col("address")).alias("needs_update"),
        access.is_vulnerability(F.col("kind")).alias("vulnerability"), access.is_severity(F.col("severity")).alias("severity"), access.is_semantic_edge(F.col("kind")).alias("semantic"),
    )


def _members(spark, sf_dir):
    return T.cut(communities.merge_small(communities.label_propagation(graph.calls(G.chain_calls(spark, sf_dir, G.SPARSE)))))


def community_ranking(spark, sf_dir):
    """The communities with the highest scores, of equals the largest."""
    found = communities.records(_members(spark, sf_dir), _parts(spark, sf_dir))
    return communities.by_security(found, 15).select("rank", "community", "score", "members", "title")


def community_sizes(spark, sf_dir):
    """The largest communities, of equals the first."""
    sizes = communities.records(_members(spark, sf_dir), _parts(spark, sf_dir)).select("community", "members", "title")
    return access.ranked(sizes, 20, F.desc("members"), F.col("community"))


def community_key_functions(spark, sf_dir):
    return communities.key_functions(_members(spark, sf_dir), _parts(spark, sf_dir))


def community_insights(spark, sf_dir):
    return communities.insights(_members(spark, sf_dir), _parts(spark, sf_dir))


def global_findings(spark, sf_dir):
    members, nodes = _members(spark, sf_dir), _parts(spark, sf_dir)
    return communities.findings(communities.records(members, nodes), communities.flag_spread(members, nodes))


def reflections_parsed(spark, sf_dir):
    """Agents' reflections made of parts: some in the usual form, some without a decision."""
    p = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_size")
    size = F.col("p_size")
    usual = F.concat(
        F.lit("**Assessment:** "), "p_name", F.lit("\n**Plan Updates:**\n- ADD: look at "), "p_name", F.lit("\n- ADD: None\n-REMOVE: "), F.when(size % 2 == 0, "old task").otherwise("none"),
        F.lit("\n**Decision:** "), F.when(size % 4 == 0, "ready now").when(size % 4 == 1, "Not ready").otherwise("continue"), F.lit("\n- ADD: too late\n**Reason:** size "), size.cast("string"),
    )
    answer = F.when(size % 5 == 0, F.concat(F.lit("Ready with "), "p_name")).when(size % 5 == 1, F.col("p_name")).otherwise(usual)
    r = p.select(F.col("p_partkey").alias("id"), texts.reflection(answer).alias("r"))
    return r.select("id", "r.assessment", "r.decision", "r.reason", F.array_join("r.to_add", ",").alias("to_add"), F.array_join("r.to_remove", ",").alias("to_remove"))


def community_of_nodes(spark, sf_dir):
    members, nodes = _members(spark, sf_dir), _parts(spark, sf_dir)
    return communities.titles_of(nodes, members, communities.records(members, nodes))


def community_members_named(spark, sf_dir):
    """The members of each community by name, of equal names by id."""
    named = _members(spark, sf_dir).join(_parts(spark, sf_dir).select("id", "name"), "id")
    place = F.row_number().over(Window.partitionBy("community").orderBy("name", "id"))
    return named.select("community", "id", "name", place.alias("place"))


def community_edges(spark, sf_dir):
    return communities.belonging(_members(spark, sf_dir))


def _analysed(spark, sf_dir):
    members, nodes = _members(spark, sf_dir), _parts(spark, sf_dir)
    titles = communities.titles_of(nodes, members, communities.records(members, nodes))
    size = table(spark, sf_dir, "part", F.col("p_partkey").alias("id"), "p_type", "p_retailprice")
    full = nodes.join(size, "id").withColumns({"content": F.when(F.col("id") % 2 == 0, F.col("name")), "summary": F.when(F.col("id") % 3 == 0, F.concat(F.lit("reads "), "p_type", F.lit(" and checks a login"))), "confidence": F.col("p_retailprice") / 10000})
    edges, _ = T.stored(G.chain_calls(spark, sf_dir), "calls")  # made once for both ends
    return nodes, access.semantic_analysis(full, edges, titles)


def semantic_analysis(spark, sf_dir):
    """All that is known of each part."""
    return _analysed(spark, sf_dir)[1].drop("address")


def semantic_lookup(spark, sf_dir):
    """What is known of the part at each supplier's number, else of the first part of its name; or that nothing is."""
    nodes, known = _analysed(spark, sf_dir)
    s = table(spark, sf_dir, "supplier", "s_suppkey", "s_name")
    asked = s.select(F.col("s_suppkey").alias("ask"), (F.col("s_suppkey") * 37).alias("address"), F.col("s_name").alias("name"))
    found = access.looked_up(asked, nodes).join(known.drop("address", "name"), "id", "left").join(nodes.select("id", "name"), "id", "left")
    return found.select("ask", F.coalesce("name", F.lit("unknown")).alias("name"), F.coalesce("indexed", F.lit(False)).alias("indexed"), "category", "n_callers")


def answers_cleaned(spark, sf_dir):
    """Answers with JSON as models give it: in fences, in quotes, with escaped quotes, as a list."""
    m = _messages(spark, sf_dir).select("conv_id", "turn", F.to_json(F.struct(F.length("text").alias("size"), "role")).alias("j"))
    kind = F.col("turn") % 6
    answer = (
        F.when(kind == 0, F.concat(F.lit("```json\n"), "j", F.lit("\n```")))
        .when(kind == 1, F.concat(F.lit('"'), "j", F.lit('"')))
        .when(kind == 2, F.replace(F.col("j"), F.lit('"'), F.lit('\\"')))
        .when(kind == 3, F.concat(F.lit("'''"), "j", F.lit("'''")))
        .when(kind == 4, F.concat(F.lit("```\n["), "j", F.lit(","), "j", F.lit("]```")))
        .otherwise(F.concat(F.lit("  "), "j", F.lit("\\n  ")))
    )
    items = m.select("conv_id", "turn", texts.json_items(texts.clean_json(answer)).alias("items"))
    first = lambda path: F.get_json_object(F.get("items", 0), path)
    return items.select("conv_id", "turn", F.size("items").alias("n_items"), first("$.size").cast("int").alias("size"), first("$.role").alias("role"))


def function_security(spark, sf_dir):
    return access.function_security(_parts(spark, sf_dir), graph.calls(G.chain_calls(spark, sf_dir)))


def index_run(spark, sf_dir):
    """What indexing the parts makes: nodes, calls, flagged nodes, edges of vulnerable calls, communities; one row."""
    nodes, members = _parts(spark, sf_dir), _members(spark, sf_dir)
    edges, _ = T.stored(G.chain_calls(spark, sf_dir), "calls")  # made once for both counts
    counts = (
        nodes.agg(F.count("*").alias("n_functions"), F.count_if(F.size("flags") > 0).alias("n_flagged")),
        graph.calls(edges).agg(F.count("*").alias("n_calls")),
        paths.calls_vulnerable(edges, nodes).agg(F.count("*").alias("n_vulnerable_calls")),
        members.agg(F.count_distinct("community").alias("n_communities")),
    )
    out = counts[0]
    for one in counts[1:]:
        out = out.crossJoin(one)  # a row each
    return out


def flags_added(spark, sf_dir):
    """Flags as a person writes them, added to the flags of parts."""
    nodes = _parts(spark, sf_dir)
    wanted = nodes.filter("id % 4 < 2").select("id", F.when(F.col("id") % 4 == 0, " entry point").otherwise("reviewed by me").alias("flag"))
    wanted = wanted.union(nodes.filter("id % 8 = 0").select("id", F.lit("Entry Point").alias("flag")))
    return access.with_flag(nodes, wanted).select("id", F.array_join("flags", ",").alias("flags"))


def flags_refreshed(spark, sf_dir):
    nodes = _parts(spark, sf_dir).withColumn("address", F.when(F.col("id") % 5 > 0, F.col("address")).otherwise(F.lit(0)))
    fresh = nodes.filter("id % 2 = 0").select("id", F.array(F.lit("FRESH")).alias("flags"))
    return access.refreshed(nodes, fresh).select("id", F.array_join("flags", ",").alias("flags"))


def names_refreshed(spark, sf_dir):
    nodes = _parts(spark, sf_dir)
    fresh = nodes.select("address", F.when(F.col("id") % 3 == 0, F.concat("name", F.lit("_v2"))).when(F.col("id") % 3 == 1, F.col("name")).alias("name"))
    return access.renamed(nodes, fresh)


def stale_marked(spark, sf_dir):
    """Parts of two types go stale; some were so before."""
    p = table(spark, sf_dir, "part", "p_partkey", "p_type", "p_size").select(F.col("p_partkey").alias("id"), "p_type", (F.col("p_size") > 45).alias("is_stale"))
    scope = p.groupBy("p_type").agg(F.count("*").alias("n")).orderBy("p_type").limit(2)
    return access.marked_stale(p, scope, "p_type").select("id", "is_stale")


def _utc(time: Column) -> Column:
    """A time without a zone as one in UTC."""
    return F.concat(time.cast("string"), F.lit("Z")).cast("timestamp")


def analysis_saved(spark, sf_dir):
    """Answers by (program, address) kept once: later ones write over the text and leave the time of creation."""
    o = table(spark, sf_dir, "orders", "o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus", "o_orderpriority")
    first = o.groupBy(F.col("o_custkey").alias("program"), F.substring("o_orderpriority", 1, 1).alias("address")).agg(F.min("o_orderkey").alias("key"))
    rows = first.join(o.select(F.col("o_orderkey").alias("key"), F.col("o_orderdate").alias("created_at"), F.col("o_orderstatus").alias("answer")), "key")
    old = rows.filter("key % 3 > 0").select("program", "address", "created_at", "answer")
    new = rows.filter("key % 2 = 0").select("program", "address", F.timestamp_add("DAY", F.lit(9), "created_at").alias("created_at"), F.concat("answer", F.lit("+")).alias("answer"))
    saved = access.saved(old, new, ["program", "address"], "created_at", "answer")
    return saved.select("program", "address", F.unix_millis(_utc(F.col("created_at"))).alias("created_ms"), "answer")


def messages_saved(spark, sf_dir):
    """Every message of every other conversation saved anew with a mark, but for a user's first one."""
    old = _messages(spark, sf_dir).withColumn("turn", F.col("turn") - F.min("turn").over(Window.partitionBy("conv_id")))
    new = old.filter("conv_id % 2 = 0").withColumn("text", F.concat("text", F.lit("!")))
    return access.saved_messages(old, new).select("conv_id", "turn", "role", F.md5("text").alias("digest"))


def records_deleted(spark, sf_dir):
    """What deleting the parts with a flag leaves: nodes and calls with both ends."""
    nodes = _parts(spark, sf_dir)
    gone = nodes.filter(F.size("flags") > 0).select("id")
    return graph.without_nodes(G.chain_calls(spark, sf_dir), gone).select("source_id", "target_id").union(nodes.join(gone, "id", "left_anti").select(F.col("id"), F.lit(None).cast("long")))


def call_ids_complete(spark, sf_dir):
    """Assistants' turns as calls with two ids each; a user's next turn answers one or, if it is long, both."""
    m = _messages(spark, sf_dir)
    key = F.concat_ws("-", "conv_id", "turn")
    calls = m.filter("role = 'assistant'").select(key.alias("message"), F.array(F.concat(key, F.lit("a")), F.concat(key, F.lit("b"))).alias("call_ids"))
    answered = F.concat_ws("-", "conv_id", F.col("turn") - 1)
    results = m.filter("role = 'user'").select(F.explode(F.when(F.length("text") > 60, F.array(F.concat(answered, F.lit("a")), F.concat(answered, F.lit("b")))).otherwise(F.array(F.concat(answered, F.lit("a"))))).alias("call_id"))
    return sessions.complete_calls(calls, results).select("message")


def callers_updated(spark, sf_dir):
    """How many callers a propagated flag changes, and how many edges that makes are new."""
    edges, nodes = G.chain_calls(spark, sf_dir), _parts(spark, sf_dir)
    wanted = paths.calls_vulnerable(edges, nodes).select("source_id", "target_id")
    had = nodes.withColumns({"flag": F.lit("CALLS_VULNERABLE_FUNCTION"), "flags": F.when(F.col("id") % 2 == 0, F.array_append("flags", F.lit("CALLS_VULNERABLE_FUNCTION"))).otherwise(F.col("flags"))})
    return access.flag_counters(had, wanted, wanted.filter("source_id % 3 = 0"))


def sessions_ordered(spark, sf_dir):
    """Conversations, those with the latest turn first."""
    found = sessions.session_list(_messages(spark, sf_dir)).select("conv_id", "n_messages", "last_turn")
    return access.ranked(found, 25, F.desc("last_turn"), F.col("conv_id"))


def message_slices(spark, sf_dir):
    """Of each conversation the messages from the third to the sixth by place."""
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    return _messages(spark, sf_dir).withColumn("place", place).filter(F.col("place").between(3, 6)).select("conv_id", "turn", "place")


def _chunk_hits(spark, sf_dir):
    """The best chunk of each of the 5 best documents by BM25 over chunks, with a snippet of it."""
    chunks = retrieval.chunks(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text", "\n").withColumn("key", F.struct("doc_id", "chunk_id"))
    found = retrieval.bm25(chunks, "key", "content", QUERY).select("key.*", F.round("score", 6).alias("score"))
    best = retrieval.top(retrieval.best_per_file(retrieval.top(found, "score", 15, "doc_id", "chunk_id"), "doc_id", "score", "chunk_id"), "score", 5, "doc_id")
    return best.join(chunks.select("doc_id", "chunk_id", "content"), ["doc_id", "chunk_id"])


def chunk_hits(spark, sf_dir):
    return _chunk_hits(spark, sf_dir).select("doc_id", "chunk_id", "score", F.md5(texts.snippet(F.col("content"), QUERY, 60)).alias("snippet"))


def rag_context(spark, sf_dir):
    """The prompt with the results of a search before it: one row."""
    hits = _chunk_hits(spark, sf_dir)
    block = texts.result_block(F.concat(F.lit("doc "), F.col("doc_id").cast("string")), F.col("chunk_id"), F.col("score").cast("decimal(12,6)"), texts.snippet(F.col("content"), QUERY, 60))
    rows = hits.select((-F.col("score")).alias("by"), "doc_id", block.alias("block")).agg(F.transform(F.array_sort(F.collect_list(F.struct("by", "doc_id", "block"))), lambda x: x["block"]).alias("blocks"))  # 5 rows at most
    return rows.select(texts.context_block(F.col("blocks"), F.lit(QUERY)).alias("prompt"))


def edited_chats(spark, sf_dir):
    """Each conversation written as markdown, with empty messages and rules at the ends, and read again."""
    m = _messages(spark, sf_dir)
    part = F.concat(F.lit("<!-- CHUNK:"), F.concat_ws("-", "conv_id", "turn"), F.lit(" -->\n## "), texts.role_title(F.col("role")), F.lit("\n\n"), F.when(F.length("text") > 30, F.col("text")).otherwise(""), F.lit("\n\n---\n"))
    whole = m.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", part.alias("part")))), lambda x: x["part"]), "").alias("markdown"))  # one conversation a row
    return whole.select(F.explode(texts.edited_messages(F.concat(F.lit("# Title\n\n"), F.col("markdown")))).alias("m")).select("m.chunk_id", "m.role", F.md5("m.content").alias("digest"))


def answers_parsed(spark, sf_dir):
    """Models' answers made of names and sizes: sections, flags and JSON read from them."""
    p = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_size")
    answer = F.concat(
        F.lit("**Summary:** "), "p_name", F.lit("\n**Security Notes:** "), F.when(F.col("p_size") % 2 == 0, "None found").otherwise("overflow in loop"), F.lit("\n**Category:** "), F.when(F.col("p_size") % 3 == 0, "data parsing").otherwise(""),
        F.lit('\n```json\n{"size": '), F.col("p_size").cast("string"), F.lit("}\n```\n"),
    )
    p = p.withColumn("answer", answer)
    security, category = texts.section(F.col("answer"), "Security Notes"), F.when(F.col("p_size") % 3 == 0, F.lit("data parsing"))
    size = F.get_json_object(texts.json_of_answer(F.col("answer")), "$.size").cast("int")
    return p.select(F.col("p_partkey").alias("id"), texts.section(F.col("answer"), "Summary").alias("summary"), F.array_join(texts.answer_flags(security, category), ",").alias("flags"), size.alias("size"))


def qualified_names(spark, sf_dir):
    p = table(spark, sf_dir, "part", "p_partkey", "p_brand", "p_type", "p_name")
    scopes = F.array(F.col("p_brand"), F.concat(F.lit("<"), F.col("p_type"), F.lit(">")), F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).otherwise(""))
    return p.select(F.col("p_partkey").alias("id"), names.qualified(scopes, F.col("p_name")).alias("qualified"))


def epoch_times(spark, sf_dir):
    """Times as milliseconds and back."""
    ms = F.unix_millis(_utc(F.col("o_orderdate")))
    return table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate").select("o_orderkey", ms.alias("ms"), (F.timestamp_millis(ms) == _utc(F.col("o_orderdate"))).alias("back"))


def global_context(spark, sf_dir):
    """Each region as a binary in words: its customers are functions, its nations modules."""
    nations = table(spark, sf_dir, "nation", "n_nationkey", "n_regionkey")
    flagged = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n_nationkey"), G.customer_flags().alias("flags")).join(nations, "n_nationkey")
    per = flagged.groupBy("n_regionkey").agg(F.count("*").alias("n")).join(communities.flag_sets(flagged, "n_regionkey"), "n_regionkey", "left").withColumn("flags", F.coalesce("flags", F.array().cast("array<string>")))
    sizes = nations.groupBy("n_regionkey").agg(F.count("*").alias("n_modules"))
    region = table(spark, sf_dir, "region", "r_regionkey", "r_name").join(per, F.col("r_regionkey") == F.col("n_regionkey")).drop("n_regionkey").join(sizes, F.col("r_regionkey") == F.col("n_regionkey"))
    text = texts.global_context(F.when(F.col("r_regionkey") % 2 == 0, F.col("r_name")), F.lit(None).cast("string"), F.col("flags"), F.col("n"), F.col("n") + F.col("n_modules") + 1, F.col("n") + F.col("n_modules"))
    return region.select("r_regionkey", text.alias("context"))


def symbols_round_trip(spark, sf_dir):
    """Remote symbols as JSON lines, 500 to a file, read again; a column that some lack is null."""
    c = table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_acctbal")
    rows = c.select(F.col("c_custkey").alias("address"), F.lit("function").alias("symbol_type"), F.when(F.col("c_acctbal") > 0, F.col("c_name")).alias("name"), F.col("c_acctbal").alias("confidence"), F.create_map(F.lit("k"), F.col("c_name")).alias("metadata"))
    path = T.new_folder(spark, "symbols")
    T.write_json_chunks(rows, path)
    return T.read_symbols(spark, path).select("address", "symbol_type", "name", "data_type", "confidence", F.col("metadata")["k"].alias("k"))


def export_round_trip(spark, sf_dir):
    """The graph as it is sent out, in chunks of nodes and of edges, read again."""
    nodes = table(spark, sf_dir, "part", "p_partkey", "p_brand", "p_name").select(F.concat(F.lit("0x"), F.lower(F.hex("p_partkey"))).alias("address"), F.lit("function").alias("type"), F.col("p_name").alias("name"), F.create_map(F.lit("brand"), F.col("p_brand")).alias("properties"))
    edges = nodes.select(F.col("address").alias("source"), F.lit("0x0").alias("target"), F.lit("calls").alias("type"))
    name, path = records.register(spark), T.new_folder(spark, "export")
    found = []
    for kind, rows in (("nodes", nodes), ("edges", edges)):
        rows.write.format(name).option("path", f"{path}/{kind}").mode("append").save()
        found.append(spark.read.format(name).option("path", f"{path}/{kind}").schema(rows.schema).load())
    joined = found[0].join(found[1].select(F.col("source").alias("address"), "target"), "address")
    return joined.select("address", "type", "name", F.col("properties")["brand"].alias("brand"), "target")


def text_files(spark, sf_dir):
    """Documents with a line end, many to a file, read again by their places."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("name"), F.concat("text", F.lit("\n")).alias("text"))
    found = packed.unpack(*packed.pack(docs, "name", "text"))
    return found.select(F.col("key").alias("name"), F.col("size").alias("file_size"), F.md5("content").alias("digest"))


def tables_written(spark, sf_dir):
    """Feedback and chats as stored tables, by partition, read again."""
    chats = T.write_table(_messages(spark, sf_dir).select("conv_id", "turn", "text", "role"), T.new_folder(spark, "chats"), "role")
    marks = T.write_table(table(spark, sf_dir, "labels", "doc_id", "quality", "toxic"), T.new_folder(spark, "marks"))
    return chats.groupBy("role").agg(F.count("*").alias("n"), F.sum(F.length("text").cast("long")).alias("size")).unionByName(marks.agg(F.lit("feedback").alias("role"), F.count("*").alias("n"), F.sum(F.col("quality").cast("long")).alias("size")))


def tool_json(spark, sf_dir):
    """Similar functions and security overviews as the JSON that a tool returns."""
    nodes = _parts(spark, sf_dir)
    fields = F.struct(F.concat(F.lit("0x"), F.lower(F.hex("address"))).alias("address"), F.col("name").alias("name"), F.size("flags").alias("n_flags"), F.col("flags").alias("security_flags"))
    return nodes.select("id", F.to_json(fields).alias("json"))


def local_symbols(spark, sf_dir):
    """Functions, data, comments and variables of a program as one list; made-up names are none."""
    c = table(spark, sf_dir, "customer", "c_custkey", "c_name").select(F.col("c_custkey").alias("address"), F.when(F.col("c_custkey") % 3 == 0, "FUN_00401000").otherwise(F.col("c_name")).alias("name"), F.lit(None).cast("string").alias("content"))
    s = table(spark, sf_dir, "supplier", "s_suppkey", "s_name").select(F.col("s_suppkey").alias("address"), F.concat(F.lit("DAT_"), F.lower(F.hex("s_suppkey"))).alias("name"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).alias("content"))
    p = table(spark, sf_dir, "part", "p_partkey", "p_name").select(F.col("p_partkey").alias("address"), F.lit("local_8").alias("name"), F.col("p_name").alias("content"))
    return access.all_symbols(("function", c), ("data", s), ("comment", p)).select("symbol_type", "address", "name", "content")


def explanations_cleared(spark, sf_dir):
    """Explanations of lines (one for each line of an order) after those of some functions and single lines are cleared."""
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_shipdate").groupBy(F.col("l_orderkey").alias("function"), F.col("l_linenumber").alias("line")).agg(F.max("l_shipdate").alias("explained"))
    functions = lines.filter("function % 5 = 0").select("function").distinct()
    single = lines.filter("line = 1 and function % 3 = 0").select("function", "line")
    return lines.join(functions, "function", "left_anti").join(single, ["function", "line"], "left_anti").select("function", "line")


def has_graph(spark, sf_dir):
    """Whether each nation has a graph: suppliers in the red that anything was ordered from."""
    n = table(spark, sf_dir, "nation", "n_nationkey").withColumnRenamed("n_nationkey", "binary_id")
    nodes = table(spark, sf_dir, "supplier", "s_nationkey", "s_acctbal").filter("s_acctbal < 0").select(F.col("s_nationkey").alias("binary_id")).distinct().withColumn("found", F.lit(True))
    return n.join(nodes, "binary_id", "left").select("binary_id", F.coalesce("found", F.lit(False)).alias("has_graph"))


QUERIES = {f.__name__: f for f in (
    named_taint_sets, named_network_edges, taint_stats, paths_to_sink, address_lookup, node_edges, edge_tests, edges_between, node_tests, community_ranking, community_sizes, community_key_functions, community_of_nodes, community_insights, global_findings, reflections_parsed,
    community_edges, community_members_named, semantic_analysis, semantic_lookup, answers_cleaned, function_security, index_run, flags_added, flags_refreshed, names_refreshed, stale_marked, analysis_saved, messages_saved, records_deleted, call_ids_complete,
    callers_updated, sessions_ordered, message_slices, chunk_hits, rag_context, edited_chats, answers_parsed, qualified_names, epoch_times, global_context, symbols_round_trip,
    export_round_trip, text_files, tables_written, tool_json, local_symbols, explanations_cleared, has_graph,
)}

DENSE, SPARSE = chain_sql(G.DENSE), chain_sql(G.SPARSE)
NAMED = f"""named as (select id, flags, case when id % 3 = 0 then ['recv', 'WS2_32.dll::send', 'strcpy', 'main', '__imp__recv@16', 'system', 'fgets', '_WSASend@28', 'FUN_00401000', 'memcpy', 'DllMain', 'open',
  'getenv', 'SSL_read', 'write', 'plain_helper'][(id // 3) % 16 + 1] else name end as name from parts)"""
SETS = f"""{PARTS}, {DENSE}, {NAMED}, sources_ as (select id from named where list_has_any(flags, ['NETWORK_CAPABLE', 'HANDLES_USER_INPUT']) or name in ('recv', 'fgets', 'getenv')
  union select source_id from chain join named on target_id = id where name in ('recv', 'fgets', 'getenv')),
sinks_ as (select id from named where list_has_any(flags, ['BUFFER_OVERFLOW_RISK', 'COMMAND_INJECTION_RISK', 'PATH_TRAVERSAL_RISK']) or name in ('strcpy', 'system', 'memcpy', 'open')
  union select source_id from chain join named on target_id = id where name in ('strcpy', 'system', 'memcpy', 'open')),
entries_ as (select id from named where list_contains(flags, 'ENTRY_POINT') or name in ('main', 'DllMain')),
senders_ as (select id from named where name in ('WS2_32.dll::send', '_WSASend@28', 'write') union select source_id from chain join named on target_id = id where name in ('WS2_32.dll::send', '_WSASend@28', 'write')),
receivers_ as (select id from named where name in ('recv', '__imp__recv@16', 'SSL_read') union select source_id from chain join named on target_id = id where name in ('recv', '__imp__recv@16', 'SSL_read'))"""
LOOPS = f"""{PARTS}, {DENSE}, loops as (select source_id, target_id from chain union all select id, id from parts where id % 10 = 0)"""
RECORDS = "records_ as (select community, count(*) as members, sum(len(flags))::bigint as score, arg_min(name, (length(name), name)) || '_group (' || count(*) || ')' as title from members join parts using (id) group by 1)"
TERMS = QUERY.split()
TOKENS = r"list_filter(regexp_split_to_array(lower(content), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
HITS = CHUNKS.rstrip().removesuffix(")") + rf"""), k as (select doc_id, chunk_id, substr(text, a, b - a + 1) as content from c), w as (select *, {TOKENS} as words from k),
f as (select doc_id, chunk_id, content, len(words) as n, {", ".join(f"len(list_filter(words, lambda x: x = '{t}')) as t{j}" for j, t in enumerate(TERMS))} from w),
s as (select count(*)::double as docs, avg(n) as mean, {", ".join(f"count(*) filter (t{j} > 0) as d{j}" for j in range(len(TERMS)))} from f),
bm as (select doc_id, chunk_id, content, round({" + ".join(f"case when t{j} > 0 then 2.0::double * ln(1 + (docs - d{j} + 0.5::double) / (d{j} + 0.5::double)) * t{j} / (t{j} + 1.2::double * (0.25::double + 0.75::double * n / mean)) else 0 end" for j in range(len(TERMS)))}, 6) as score from f, s),
top15 as (select * from bm where score > 0 order by score desc, doc_id, chunk_id limit 15),
best as (select * from (select *, row_number() over (partition by doc_id order by score desc, chunk_id) as r from top15) where r = 1 order by score desc, doc_id limit 5),
p as (select *, coalesce(least({", ".join(f"nullif(strpos(lower(content), '{t}'), 0)" for t in TERMS)}) - 1, length(content)) as hit from best),
q as (select *, greatest(0, hit - 30) as x from p), r as (select *, least(length(content), x + 60) as y from q),
hits as (select doc_id, chunk_id, score, case when x > 0 then '...' else '' end || substr(content, x + 1, y - x) || case when y < length(content) then '...' else '' end as snippet from r)"""
CUSTOMER = "list_filter([case when c_mktsegment = 'MACHINERY' then 'HANDLES_USER_INPUT' end, case when c_acctbal < 0 then 'BUFFER_OVERFLOW_RISK' end], lambda x: x is not null)"

ANALYSED = f"""{PARTS}, {labels_sql(10, G.SPARSE)}, {RECORDS}, calls_ as (select * from ({DENSE.removeprefix("chain as (").removesuffix(")")})),
o as (select source_id as id, count(*) as n, string_agg(name, ',' order by name, target_id) as callees from calls_ join parts on target_id = parts.id group by 1),
i as (select target_id as id, count(*) as n, string_agg(name, ',' order by name, source_id) as callers from calls_ join parts on source_id = parts.id group by 1),
known as (select parts.id, name, parts.id % 2 = 0 or parts.id % 3 = 0 as indexed, case when parts.id % 3 = 0 then 'reads ' || p_type || ' and checks a login' end as summary, case when parts.id % 3 = 0 then 'authentication' end as category, p_retailprice / 10000 as confidence,
  flags, case when parts.id % 2 = 0 then name end as content, callers, callees, coalesce(i.n, 0) as n_callers, coalesce(o.n, 0) as n_callees, title as community
  from parts join part on p_partkey = parts.id left join o on o.id = parts.id left join i on i.id = parts.id left join members on members.id = parts.id left join records_ r on r.community = members.community)"""

ORACLE_SQL = {
    "named_taint_sets": f"""with {SETS}, ids as (select id from sources_ union select id from sinks_ union select id from entries_ union select id from senders_ union select id from receivers_)
select id, id in (from sources_) as is_source, id in (from sinks_) as is_sink, id in (from entries_) as is_entry, id in (from senders_) as sends, id in (from receivers_) as receives from ids""",
    "named_network_edges": f"""with {SETS}, {reach_sql(4, "select id from entries_")}, back as (select target_id as source_id, source_id as target_id from chain), {reach_sql(2, "select id from receivers_", "back", "up")}
select source_id, target_id, max(weight) as weight, 'NETWORK_SEND' as type from (select seed as source_id, node as target_id, 1.0::double as weight from reached where seed <> node and node in (from senders_)
  union all select source_id, target_id, 0.5 from chain where target_id in (from senders_)) group by 1, 2
union all select seed, node, case when hops = 1 then 1.0 else 0.5 end::double, 'NETWORK_RECV' from up where seed <> node""",
    "taint_stats": f"""with {SETS} select 'source' as kind, (select count(*) from sources_) as n, (select string_agg(name, ',' order by id) from (select id, name from sources_ join named using (id) order by id limit 10)) as sample
union all select 'sink', (select count(*) from sinks_), (select string_agg(name, ',' order by id) from (select id, name from sinks_ join named using (id) order by id limit 10))""",
    "paths_to_sink": f"""with {PARTS}, forward as (select * from ({DENSE.removeprefix("chain as (").removesuffix(")")})), chain as (select target_id as source_id, source_id as target_id from forward),
{paths_sql(4, "select id from parts where list_contains(flags, 'COMMAND_INJECTION_RISK')")} select sink as source, source as sink, hops, array_to_string(list_reverse(path), '>') as path from found""",
    "address_lookup": "select c_nationkey as binary_id, c_custkey as address, case when c_acctbal < 0 then c_name || '_pending' else c_name end as name from customer where c_mktsegment = 'BUILDING'",
    "node_edges": f"""with {LOOPS}, w as (select id from parts where len(flags) > 0)
select id, other, direction, count(*) as n from (select source_id as id, target_id as other, 'out' as direction from loops union all select target_id, source_id, 'in' from loops) join w using (id) group by 1, 2, 3""",
    "edge_tests": f"with {LOOPS} select id, id in (select source_id from loops) as has_out, id in (select target_id from loops) as has_in from parts",
    "edges_between": f"""with {LOOPS}, p as (select id as source_id, unnest([id, id + 1]) as target_id from parts) select source_id, target_id, exists (select 1 from loops l where l.source_id = p.source_id and l.target_id = p.target_id) as found from p""",
    "node_tests": """select p_partkey as id, p_size % 5 = 0 as has_flags, p_size in (1, 2, 3, 4) as network, p_size % 7 = 0 or p_size % 11 = 0 or p_size = 13 as files,
  not (p_size in (1, 2, 3, 4, 13, 17, 19, 23) or p_size % 7 = 0 or p_size % 11 = 0) as empty, p_size % 3 = 0 or p_size % 4 = 0 as indexed, p_size % 5 <> 0 and p_size % 2 = 0 and p_partkey <> 0 as needs_update,
  p_size % 4 in (0, 1) as vulnerability, p_size % 3 = 0 as severity, p_size % 4 = 2 as semantic from part""",
    "community_ranking": f"with {PARTS}, {labels_sql(10, G.SPARSE)}, {RECORDS} select (row_number() over (order by score desc, members desc, community))::int as rank, community, score, members, title from records_ qualify rank <= 15",
    "community_sizes": f"with {PARTS}, {labels_sql(10, G.SPARSE)}, {RECORDS} select community, members, title, (row_number() over (order by members desc, community))::int as rank from records_ qualify rank <= 20",
    "community_key_functions": f"""with {PARTS}, {labels_sql(10, G.SPARSE)} select community, id, name, (row_number() over (partition by community order by id))::int as place from members join parts using (id) where len(flags) > 0 qualify place <= 5""",
    "community_insights": f"""with {PARTS}, {labels_sql(10, G.SPARSE)}, k as (select community, id, name, flags, row_number() over (partition by community order by id) as r from members join parts using (id))
select community, id, name || case when len(flags) > 0 then ' @ 0x' || lower(to_hex(id)) else '' end as key_function from k where len(flags) > 0 or r <= 10""",
    "global_findings": f"""with {PARTS}, {labels_sql(10, G.SPARSE)}, {RECORDS}, f as (select community, unnest(flags) as flag from members join parts using (id)), g as (select flag, count(distinct community) as c, count(*) as n from f group by 1),
t as (select count(*) as n, sum(members)::bigint as m from records_)
select 0 as place, n || ' communities detected with ' || m || ' total functions' as finding from t union all select 1, 'Average community size: ' || (m // n) || ' functions' from t
union all select 1 + row_number() over (order by n desc, flag), n || ' functions with ' || flag || ' across ' || c || ' communities' from g
union all select 1073741824, 'Most security-relevant: ' || title || ' (' || score || ' flags)' from (select * from records_ where score > 0 order by score desc, members desc, community limit 1)""",
    "reflections_parsed": """select p_partkey as id, case when p_size % 5 = 0 then 'Ready to synthesize (legacy format)' when p_size % 5 = 1 then 'Continue investigation (legacy format)' else p_name end as assessment,
  case when p_size % 5 = 0 then 'READY' when p_size % 5 = 1 then 'CONTINUE' when p_size % 4 = 0 then 'READY' else 'CONTINUE' end as decision, case when p_size % 5 > 1 then 'size ' || p_size end as reason,
  case when p_size % 5 > 1 then 'look at ' || p_name else '' end as to_add, case when p_size % 5 > 1 and p_size % 2 = 0 then 'old task' else '' end as to_remove from part""",
    "community_of_nodes": f"with {PARTS}, {labels_sql(10, G.SPARSE)}, {RECORDS} select id, community, title from parts left join members using (id) left join records_ using (community)",
    "community_members_named": f"with {PARTS}, {labels_sql(10, G.SPARSE)} select community, id, name, (row_number() over (partition by community order by name, id))::int as place from members join parts using (id)",
    "community_edges": f"with {labels_sql(10, G.SPARSE)} select id as source_id, community as target_id, 'BELONGS_TO_COMMUNITY' as type, 1.0::double as score from members",
    "semantic_analysis": f"""with {ANALYSED} select id, name, indexed, summary, case when indexed then category end as category, case when indexed then confidence end as confidence, case when indexed then array_to_string(flags, ',') end as flags, content,
  case when indexed then coalesce(callers, '') end as callers, case when indexed then coalesce(callees, '') end as callees, case when indexed then n_callers end as n_callers, case when indexed then n_callees end as n_callees, case when indexed then community end as community from known""",
    "semantic_lookup": f"""with {ANALYSED}, asked as (select s_suppkey as ask, coalesce((select id from parts where id = s_suppkey * 37), (select min(id) from parts where name = s_name)) as id from supplier)
select ask, coalesce(name, 'unknown') as name, coalesce(indexed, false) as indexed, case when indexed then category end as category, case when indexed then n_callers end as n_callers from asked left join known using (id)""",
    "answers_cleaned": "select conv_id, turn, case when turn % 6 = 4 then 2 else 1 end as n_items, length(text)::int as size, role from conversations",
    "function_security": f"""with {PARTS}, {DENSE}, bad as (select id from parts where len(flags) > 0)
select id, array_to_string(flags, ',') as flags, len(flags) as n_flags, (select count(*) from chain where source_id = id and target_id in (from bad)) as vulnerable_callees, (select count(*) from chain where target_id = id and source_id in (from bad)) as vulnerable_callers from parts""",
    "index_run": f"""with {PARTS}, {labels_sql(10, G.SPARSE)}, calls_ as (select * from ({DENSE.removeprefix("chain as (").removesuffix(")")}))
select (select count(*) from parts) as n_functions, (select count(*) from parts where len(flags) > 0) as n_flagged, (select count(*) from calls_) as n_calls,
  (select count(*) from calls_ join parts on target_id = id where len(list_filter(flags, lambda f: f like '%\\_RISK' escape '\\')) > 0) as n_vulnerable_calls, (select count(distinct community) from members) as n_communities""",
    "flags_added": f"""with {PARTS} select id, array_to_string(case id % 4 when 0 then case when list_contains(flags, 'ENTRY_POINT') then flags else list_append(flags, 'ENTRY_POINT') end when 1 then list_append(flags, 'REVIEWED_BY_ME') else flags end, ',') as flags from parts""",
    "flags_refreshed": f"with {PARTS} select id, case when len(flags) = 0 and id % 5 > 0 and id % 2 = 0 then 'FRESH' else array_to_string(flags, ',') end as flags from parts",
    "names_refreshed": "select p_partkey as id, case when p_partkey % 3 = 0 then p_name || '_v2' else p_name end as name, p_partkey % 3 = 0 as changed from part",
    "stale_marked": "select p_partkey as id, p_size > 45 or p_type in (select distinct p_type from part order by 1 limit 2) as is_stale from part",
    "analysis_saved": """with f as (select o_custkey as program, o_orderpriority[1] as address, min(o_orderkey) as key from orders group by 1, 2), r as (select f.*, o_orderdate as d, o_orderstatus as s from f join orders on o_orderkey = key)
select program, address, epoch_ms(case when key % 3 > 0 then d else d + interval 9 day end) as created_ms, case when key % 2 = 0 then s || '+' else s end as answer from r where key % 3 > 0 or key % 2 = 0""",
    "messages_saved": """with m as (select conv_id, turn - min(turn) over (partition by conv_id) as turn, role, text from conversations)
select conv_id, turn, role, md5(case when conv_id % 2 = 0 and not (turn = 0 and role = 'user') then text || '!' else text end) as digest from m""",
    "records_deleted": f"""with {PARTS}, {DENSE}, gone as (select id from parts where len(flags) > 0)
select source_id, target_id from chain where source_id not in (from gone) and target_id not in (from gone) union all select id, null from parts where id not in (from gone)""",
    "call_ids_complete": "select conv_id || '-' || turn as message from conversations a where role = 'assistant' and exists (select 1 from conversations u where u.conv_id = a.conv_id and u.turn = a.turn + 1 and u.role = 'user' and length(u.text) > 60)",
    "callers_updated": f"""with {PARTS}, {DENSE}, w as (select source_id, target_id from chain join parts on target_id = id where len(list_filter(flags, lambda f: f like '%\\_RISK' escape '\\')) > 0)
select (select count(distinct source_id) from w where source_id % 2 = 1) as callers_updated, (select count(*) from w where source_id % 3 <> 0) as edges_new, (select count(*) from w where source_id % 3 = 0) as edges_existing""",
    "sessions_ordered": "select conv_id, n_messages, last_turn, (row_number() over (order by last_turn desc, conv_id))::int as rank from (select conv_id, count(*) as n_messages, max(turn) as last_turn from conversations group by 1) qualify rank <= 25",
    "message_slices": "select conv_id, turn, (row_number() over (partition by conv_id order by turn))::int as place from conversations qualify place between 3 and 6",
    "chunk_hits": HITS + " select doc_id, chunk_id, score, md5(snippet) as snippet from hits",
    "rag_context": HITS + rf""" select '<context>' || chr(10) || string_agg('<result>' || chr(10) || '</br><file>doc ' || doc_id || '</file>' || chr(10) || '</br><chunkid>' || chunk_id || '</chunkid>' || chr(10) || '</br><score>' || score::decimal(12, 6)
  || '</score>' || chr(10) || '</br><content>' || chr(10) || snippet || chr(10) || '</content>' || chr(10) || chr(10) || '</result>' || chr(10) || chr(10), '' order by score desc, doc_id) || chr(10) || '</context>' || chr(10) || '{QUERY}' as prompt from hits""",
    "edited_chats": r"select conv_id || '-' || turn as chunk_id, role, md5(regexp_replace(text, '^\s+|\s+$', '', 'g')) as digest from conversations where length(text) > 30",
    "answers_parsed": """select p_partkey as id, p_name as summary, array_to_string(list_filter([case when p_size % 2 = 1 then 'LLM_FLAGGED' end, case when p_size % 3 = 0 then 'CATEGORY_DATA_PARSING' end], lambda x: x is not null), ',') as flags, p_size as size from part""",
    "qualified_names": "select p_partkey as id, p_brand || '::' || case when p_partkey % 2 = 0 then p_type || '::' else '' end || p_name as qualified from part",
    "epoch_times": "select o_orderkey, epoch_ms(o_orderdate) as ms, true as back from orders",
    "global_context": f"""with c as (select n_regionkey, {CUSTOMER} as flags from customer join nation on c_nationkey = n_nationkey), g as (select n_regionkey, count(*) as n, list_sort(list_distinct(flatten(list(flags)))) as flags from c group by 1), s as (select n_regionkey, count(*) as m from nation group by 1)
select r_regionkey, '## Binary Context' || chr(10) || chr(10) || case when r_regionkey % 2 = 0 then '**Summary:** ' || r_name || chr(10) || chr(10) else '' end || case when len(flags) > 0 then '**Security Flags:** ' || array_to_string(flags, ', ') || chr(10) || chr(10) else '' end
  || '**Graph Statistics:**' || chr(10) || '- Functions: ' || n || chr(10) || '- Total nodes: ' || (n + m + 1) || chr(10) || '- Total edges: ' || (n + m) || chr(10) as context from region join g on n_regionkey = r_regionkey join s on s.n_regionkey = r_regionkey""",
    "symbols_round_trip": "select c_custkey as address, 'function' as symbol_type, case when c_acctbal > 0 then c_name end as name, null::varchar as data_type, c_acctbal as confidence, c_name as k from customer",
    "export_round_trip": "select '0x' || lower(to_hex(p_partkey)) as address, 'function' as type, p_name as name, p_brand as brand, '0x0' as target from part",
    "text_files": "select 'd' || doc_id as name, octet_length(encode(text))::bigint + 1 as file_size, md5(text || chr(10)) as digest from documents",
    "tables_written": "select role, count(*) as n, sum(length(text))::bigint as size from conversations group by 1 union all select 'feedback', count(*), sum(quality)::bigint from labels",
    "tool_json": f"""with {PARTS} select id, '{{"address":"0x' || lower(to_hex(id)) || '","name":"' || name || '","n_flags":' || len(flags) || ',"security_flags":[' || array_to_string(list_transform(flags, lambda f: '"' || f || '"'), ',') || ']}}' as json from parts""",
    "local_symbols": """select 'function' as symbol_type, c_custkey as address, c_name as name, null::varchar as content from customer where c_custkey % 3 <> 0
union all select 'data', s_suppkey, null, s_name from supplier where s_suppkey % 2 = 0 union all select 'comment', p_partkey, null, p_name from part""",
    "explanations_cleared": "select distinct l_orderkey as function, l_linenumber as line from lineitem where l_orderkey % 5 <> 0 and not (l_linenumber = 1 and l_orderkey % 3 = 0)",
    "has_graph": "select n_nationkey as binary_id, n_nationkey in (select s_nationkey from supplier where s_acctbal < 0) as has_graph from nation",
}
