"""Queries that build graphs from records of code and merge them, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinworks.functions import vectors
from skeinworks.operators import build, merge
from skeinworks.plans.graph_queries import LAYER_CALLS, PARTS, chain_sql
from skeinworks.sources import graph_tables as G
from skeinworks.sources.tables import table


def _functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as functions of 16 bytes; large ones are thunks of the part of half their number, small ones external."""
    p = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_size")
    return p.select((F.col("p_partkey") * 16).alias("address"), (F.col("p_partkey") * 16 + 15).alias("end_address"), F.concat(F.lit("__imp_"), "p_name").alias("name"), (F.col("p_size") > 40).alias("is_thunk"), (F.col("p_size") == 1).alias("is_external"), F.when(F.col("p_partkey") > 0, F.floor(F.col("p_partkey") / 2) * 16).alias("thunk_target"))


def _refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the part of each line to one of the parts up to its order's number."""
    lines = table(spark, sf_dir, "lineitem", "l_partkey", "l_linenumber", "l_orderkey", "l_quantity")
    return lines.filter("l_quantity >= 40").select((F.col("l_partkey") * 16 + F.col("l_linenumber")).alias("from_addr"), (F.col("l_orderkey") * 16 + F.col("l_quantity").cast("long") % 16).alias("to_addr"))


def call_edges(spark, sf_dir):
    return build.call_edges(_functions(spark, sf_dir), _refs(spark, sf_dir))


def reference_edges(spark, sf_dir):
    return build.reference_edges(_functions(spark, sf_dir), _refs(spark, sf_dir))


def contains_edges(spark, sf_dir):
    region = table(spark, sf_dir, "region", "r_regionkey").select(F.concat(F.lit("r:"), "r_regionkey").alias("id"), F.col("r_regionkey").alias("binary_id"))
    nations = table(spark, sf_dir, "nation", "n_nationkey", "n_regionkey")
    functions = table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("s:"), "s_suppkey").alias("id"), F.col("n_regionkey").alias("binary_id"))
    return build.contains_edges(region, functions)


def edge_categories(spark, sf_dir):
    """Edges of the layered graph by category of their type."""
    edges = G.layer_calls(spark, sf_dir).unionByName(G.layer_contains(spark, sf_dir))
    counted = edges.groupBy("type").agg(F.count("*").alias("n_edges"))
    return build.edge_types(spark).join(counted, "type", "left").select("type", "category", "directed", F.coalesce("n_edges", F.lit(0).cast("long")).alias("n_edges"))


def user_edges(spark, sf_dir):
    """Customers and suppliers of one nation and balance class as related; what is there already is left out."""
    c = table(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c_acctbal").select(F.col("c_custkey").alias("source_id"), F.col("c_nationkey").alias("nation"), F.floor(F.col("c_acctbal") / 100).alias("class"), (F.col("c_acctbal") / 5000).alias("confidence"))
    s = table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey", "s_acctbal").select(F.col("s_suppkey").alias("target_id"), F.col("s_nationkey").alias("nation"), F.floor(F.col("s_acctbal") / 100).alias("class"))
    wanted = merge.dealt_join(c, s, ["nation", "class"], "source_id").select("source_id", "target_id", F.when(F.col("class") > 90, "CALLS").otherwise("RELATED_TO").alias("type"), F.when(F.col("class") >= 5, F.col("confidence")).alias("confidence"))
    existing = wanted.filter("confidence > 1.2").select("source_id", "target_id", "type")
    return build.user_edges(wanted, existing)


def pending_first_wins(spark, sf_dir):
    """Lines as pending nodes by order: the first of each order counts, with the first flag that isn't `N`."""
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    seq = F.col("l_linenumber") * 10_000_000 + F.col("l_partkey")
    pending = lines.select(F.col("l_orderkey").alias("address"), F.lit(None).cast("string").alias("name"), seq.alias("seq"), F.col("l_returnflag").alias("flag")).groupBy("address", "name", "seq").agg(F.max("flag").alias("flag"))
    return build.first_wins(pending.withColumn("content", F.when(F.col("flag") != "N", F.col("flag")))).select("address", "seq", "content")


def pending_edge_ids(spark, sf_dir):
    """Calls of customers under pending ids, which stand for stored ones where the balance is positive."""
    c = table(spark, sf_dir, "customer", "c_custkey", "c_acctbal")
    pending = c.select(F.concat(F.lit("new:"), "c_custkey").alias("id"), F.col("c_custkey").alias("address"))
    stored = c.filter("c_acctbal > 0").select(F.concat(F.lit("c:"), "c_custkey").alias("id"), F.col("c_custkey").alias("address"))
    edges = table(spark, sf_dir, "orders", "o_custkey", "o_orderkey").select(F.concat(F.lit("new:"), "o_custkey").alias("source_id"), F.concat(F.lit("o:"), "o_orderkey").alias("target_id"))
    return build.stored_ids(edges, pending, stored)


def graph_merge(spark, sf_dir):
    """The dense chain graph as a remote one over parts that are partly known here; ends of over 40 in size are unknown."""
    p = table(spark, sf_dir, "part", "p_partkey", "p_size")
    local = p.filter("p_size < 20").select(F.concat(F.lit("l:"), "p_partkey").alias("id"), F.col("p_partkey").alias("address"))
    remote = p.filter("p_size between 10 and 40").select(F.concat(F.lit("r:"), "p_partkey").alias("id"), F.col("p_partkey").alias("address"))
    edges = G.chain_calls(spark, sf_dir).select(F.col("source_id").alias("source"), F.col("target_id").alias("target"), "type")
    return build.merged_graph(local, remote, edges)


def local_context(spark, sf_dir):
    """Every part of the sparse chain graph in words."""
    nodes = G.chain_nodes(spark, sf_dir).withColumn("summary", F.when(F.col("id") % 2 == 0, F.repeat(F.col("name"), 8)))
    return build.local_context(nodes, G.chain_calls(spark, sf_dir, G.SPARSE)).select("id", F.md5("context").alias("digest"), F.length("context").alias("n_chars"))


def todo_items(spark, sf_dir):
    """The lines of each document as a list of todos."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.concat(F.lit("- [ ] "), F.replace("text", F.lit("\n"), F.lit("\n2. "))).alias("list"))
    return build.todo_items(docs, "doc_id", "list").select("doc_id", "seq", "priority", F.md5("task").alias("digest"))


def vector_formats(spark, sf_dir):
    """Vectors to bytes and text and back: the sums of what returns."""
    v = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    back = v.select("vec_id", vectors.from_bytes(vectors.to_bytes(F.col("embedding"))).alias("b"), vectors.from_text(F.array_join(F.col("embedding").cast("array<string>"), ",")).alias("t"))
    total = lambda c: F.round(F.aggregate(F.col(c).cast("array<double>"), F.lit(0.0), lambda s, x: s + x), 4)
    return back.select("vec_id", total("b").alias("from_bytes"), total("t").alias("from_text"), F.size("b").alias("n"))


QUERIES = {f.__name__: f for f in (call_edges, reference_edges, contains_edges, edge_categories, user_edges, pending_first_wins, pending_edge_ids, graph_merge, local_context, todo_items, vector_formats)}

FUNCTIONS = """fn as (select p_partkey * 16 as address, '__imp_' || p_name as name, p_size > 40 as thunk, p_size = 1 as ext, case when p_partkey > 0 then p_partkey // 2 * 16 end as target from part),
refs as (select l_partkey * 16 as source, l_orderkey * 16 as hit from lineitem where l_quantity >= 40)"""
LINE = "'- ' || name || coalesce(': ' || case when length(summary) > 100 then substr(summary, 1, 100) || '...' else summary end, '')"

ORACLE_SQL = {
    "call_edges": f"""with recursive {FUNCTIONS}, r as (select address, name, thunk, ext, target, address as real from fn union all
  select r.address, f.name, f.thunk, f.ext, f.target, f.address from r join fn f on r.thunk and f.address = r.target)
select distinct source::varchar as source_id, case when ext or thunk then 'ext:' || replace(name, '__imp_', '') else real::varchar end as target_id, 'CALLS' as type
from refs join r on hit = r.address where (not thunk or target is null) and source in (select address from fn)""",
    "reference_edges": f"with {FUNCTIONS} select distinct source as source_id, hit as target_id, 'REFERENCES' as type from refs where hit in (select address from fn) and source <> hit",
    "contains_edges": "select 'r:' || n_regionkey as source_id, 's:' || s_suppkey as target_id, 'CONTAINS' as type from supplier join nation on s_nationkey = n_nationkey",
    "edge_categories": "with t(type, category, directed) as (values " + ", ".join(f"('{t}', '{c}', {str(d).lower()})" for t, c, _, d in build.EDGE_TYPES) + f"), {LAYER_CALLS} " + """
select type, category, directed, case type when 'CALLS' then (select count(*) from calls) when 'CONTAINS' then (select count(*) from nation) + (select count(*) from supplier) + (select count(*) from customer) else 0 end as n_edges from t""",
    "user_edges": """select c_custkey as source_id, s_suppkey as target_id, 'RELATED_TO' as type, least(1.0, greatest(0.0, coalesce(case when floor(c_acctbal / 100) >= 5 then c_acctbal / 5000 end, 0.8)))::double as weight
from customer join supplier on c_nationkey = s_nationkey and floor(c_acctbal / 100) = floor(s_acctbal / 100) where floor(c_acctbal / 100) <= 90 and not (floor(c_acctbal / 100) >= 5 and c_acctbal / 5000 > 1.2)""",
    "pending_first_wins": """with p as (select l_orderkey as address, l_linenumber::bigint * 10000000 + l_partkey as seq, max(l_returnflag) as flag from lineitem group by 1, 2)
select address, min(seq) as seq, arg_min(flag, seq) filter (flag <> 'N') as content from p group by 1""",
    "pending_edge_ids": "select case when c_acctbal > 0 and c_custkey <> 0 then 'c:' else 'new:' end || o_custkey as source_id, 'o:' || o_orderkey as target_id from orders join customer on o_custkey = c_custkey",
    "graph_merge": f"""with {chain_sql(G.DENSE)}, n as (select p_partkey as k, case when p_size < 20 then 'l:' else 'r:' end || p_partkey as id from part where p_size <= 40)
select a.id as source_id, b.id as target_id, 'CALLS' as type from chain join n a on source_id = a.k join n b on target_id = b.k""",
    "local_context": f"""with {PARTS}, {chain_sql(G.SPARSE)}, n as (select *, case when id % 2 = 0 then repeat(name, 8) end as summary from parts), l as (select id as other, {LINE} as line from n),
i as (select target_id as id, string_agg(line, chr(10) order by line) as callers from chain join l on source_id = other group by 1), o as (select source_id as id, string_agg(line, chr(10) order by line) as callees from chain join l on target_id = other group by 1),
t as (select n.id, '## Function Context' || chr(10) || chr(10) || '### ' || name || ' (0x' || lower(to_hex(n.id)) || ')' || chr(10) || chr(10) || coalesce('**Summary:** ' || summary || chr(10) || chr(10), '')
  || case when len(flags) > 0 then '**Security Flags:** ' || array_to_string(flags, ', ') || chr(10) || chr(10) else '' end || coalesce('**Called by:**' || chr(10) || callers || chr(10) || chr(10), '') || coalesce('**Calls:**' || chr(10) || callees || chr(10) || chr(10), '') as c
  from n left join i using (id) left join o using (id))
select id, md5(c) as digest, length(c)::int as n_chars from t""",
    "todo_items": """with x as (select doc_id, string_split(text, chr(10)) as l from documents), k as (select doc_id, generate_subscripts(l, 1) as i, trim(unnest(l)) as task from x), f as (select * from k where task <> ''),
s as (select doc_id, row_number() over (partition by doc_id order by i)::int as seq, task from f) select doc_id, seq, greatest(1, 11 - seq)::int as priority, md5(task) as digest from s""",
    "vector_formats": "select vec_id, round(list_sum(embedding::double[]), 4) as from_bytes, round(list_sum(embedding::double[]), 4) as from_text, len(embedding)::int as n from embeddings",
}
