"""Queries on snapshots, conversations, findings and feedback, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skeinworks.functions import texts
from skeinworks.operators import merge, sessions
from skeinworks.operators.snapshots import Snapshot
from skeinworks.sources.tables import table


def _local(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as an older snapshot: a name of a tool's own where the balance is low, none where it is lowest."""
    c = table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    name = F.when(F.col("c_acctbal") < -500, None).when(F.col("c_acctbal") < 500, F.concat(F.lit("FUN_"), F.lpad(F.hex("c_custkey"), 8, "0"))).otherwise(F.col("c_name"))
    return c.filter("c_mktsegment <> 'FURNITURE'").select(
        F.col("c_custkey").alias("address"), name.alias("name"), F.concat("c_mktsegment", F.lit("  x\n y")).alias("content"), (F.col("c_acctbal") > 9000).alias("user_edited"), (F.col("c_acctbal") * 2).alias("confidence")
    )


def _remote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as a newer snapshot: other names and contents where the balance says so."""
    c = table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    name = F.when(F.col("c_acctbal").between(2000, 4000), F.concat("c_name", F.lit("_new"))).when(F.col("c_acctbal") < -800, None).when(F.col("c_acctbal") < -700, F.lit("sub_1f")).otherwise(F.col("c_name"))
    content = F.concat("c_mktsegment", F.when(F.col("c_acctbal") > 6000, F.lit(" x z")).otherwise(F.lit(" x y ")))
    return c.filter("c_mktsegment <> 'MACHINERY'").select(
        F.col("c_custkey").alias("address"), name.alias("name"), content.alias("content"), F.when(F.col("c_acctbal") < -900, "comment").otherwise("function").alias("symbol_type"), F.col("c_acctbal").alias("confidence")
    )


def node_upsert(spark, sf_dir):
    return merge.upsert(_local(spark, sf_dir), _remote(spark, sf_dir), "address", ["name", "content"], ["confidence"])


def bucket_upsert(spark, sf_dir):
    """As node_upsert on a table in buckets, then rows deleted and inserted: what it holds after the third change."""
    local = _local(spark, sf_dir).select("address", "name", "content", "confidence").withColumn("change", F.lit("old"))
    snapshot = Snapshot.create(local, ["address"], 16)
    snapshot.upsert(_remote(spark, sf_dir).select("address", "name", "content", "confidence"), ["name", "content"], ["confidence"])
    snapshot.delete(table(spark, sf_dir, "orders", "o_custkey", "o_orderstatus").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("address")).distinct())
    snapshot.insert_or_ignore(table(spark, sf_dir, "supplier", "s_suppkey", "s_name", "s_acctbal").select((F.col("s_suppkey") * 3).alias("address"), F.col("s_name").alias("name"), F.lit("s").alias("content"), F.col("s_acctbal").alias("confidence"), F.lit("new").alias("change")))
    return snapshot.read()


def sessions_changed(spark, sf_dir):
    """Chats as a table of sessions: some are renamed, long ones touched, single messages deleted, new ones created."""
    chats = table(spark, sf_dir, "conversations", "conv_id", "turn").groupBy("conv_id").agg(F.count("*").alias("n"), F.max("turn").alias("touched"))
    made = chats.select("conv_id", F.concat(F.lit("Chat "), F.col("conv_id").cast("string")).alias("title"), "touched")
    sessions_ = Snapshot.create(made, ["conv_id"], 8)
    sessions_.upsert(chats.filter("conv_id % 5 = 0").select("conv_id", F.concat(F.lit("Renamed "), F.col("conv_id").cast("string")).alias("title"), F.lit(None).cast("long").alias("touched")), ["title", "touched"], [])
    sessions_.upsert(chats.filter("n >= 4").select("conv_id", F.lit(None).cast("string").alias("title"), (F.col("n") + 100).alias("touched")), ["title"], ["touched"])
    sessions_.delete(chats.filter("n = 1").select("conv_id"))
    toxic = table(spark, sf_dir, "labels", "doc_id", "toxic").filter("toxic = 1")
    sessions_.insert_or_ignore(toxic.select(F.col("doc_id").alias("conv_id"), F.concat(F.lit("About "), F.col("doc_id").cast("string")).alias("title"), F.lit(0).cast("long").alias("touched")))
    return sessions_.read()


def settings_kept(spark, sf_dir):
    """Settings by user and name, each with the value that was set last."""
    history = table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value")
    return merge.latest(history, ["user_id", "event_type"], "ts", F.desc("event_id")).select("user_id", F.col("event_type").alias("setting"), "value")


def merge_policies(spark, sf_dir):
    a, b = _local(spark, sf_dir), _remote(spark, sf_dir)
    out = None
    for policy in ("upsert", "prefer_local", "replace"):
        one = merge.merged(a, b, "address", ["name", "content"], policy).withColumn("policy", F.lit(policy))
        out = one if out is None else out.unionByName(one)
    return out


def insert_or_ignore(spark, sf_dir):
    return merge.insert_or_ignore(_local(spark, sf_dir).select("address", "name"), _remote(spark, sf_dir).select("address", "name"), "address")


def incremental_stale(spark, sf_dir):
    return merge.stale_after(_local(spark, sf_dir), _remote(spark, sf_dir), "address")


def symbol_conflicts(spark, sf_dir):
    return merge.conflicts(_local(spark, sf_dir), _remote(spark, sf_dir), -500.0)


def record_vulnerability(spark, sf_dir):
    """Findings on suppliers in the red, added to their flags and summaries."""
    s = table(spark, sf_dir, "supplier", "s_suppkey", "s_name", "s_acctbal")
    nodes = s.select(F.col("s_suppkey").alias("id"), F.when(F.col("s_acctbal") > 5000, F.array(F.lit("SEVERITY_HIGH"))).otherwise(F.array().cast("array<string>")).alias("flags"), F.when(F.col("s_acctbal") < -500, "pending").otherwise(F.col("s_name")).alias("summary"))
    found = s.filter("s_acctbal < 0 or s_acctbal > 8000").select(F.col("s_suppkey").alias("id"), F.lit("USE_AFTER_FREE").alias("kind"), F.lit("HIGH").alias("severity"), F.lit("freed twice").alias("description"), F.when(F.col("s_acctbal") < -200, "line 3").alias("evidence"))
    return merge.with_vulnerability(nodes, found).select("id", F.array_join("flags", ",").alias("flags"), "summary")


def latest_analysis(spark, sf_dir):
    """The last order of each customer: insert-or-replace by key."""
    o = table(spark, sf_dir, "orders", "o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus")
    return merge.latest(o, ["o_custkey"], "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", "o_orderstatus")


def _messages(spark, sf_dir):
    return table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")


def chat_last_n(spark, sf_dir):
    return sessions.last_messages(_messages(spark, sf_dir), 10).select("conv_id", "turn", "role")


def chat_compressed(spark, sf_dir):
    return sessions.compressed(_messages(spark, sf_dir), 4).select("conv_id", "turn", "role")


def token_estimate(spark, sf_dir):
    return sessions.token_estimates(_messages(spark, sf_dir))


def context_status(spark, sf_dir):
    return sessions.context_status(sessions.token_estimates(_messages(spark, sf_dir)), 1000)


def role_normalize(spark, sf_dir):
    forms = spark.createDataFrame([(r,) for r in ("user", " User", "Assistant ", "tool", "Tool Call", "TOOL_RESPONSE", "error", "edited", "", "critic", None)], "role string")
    roles = _messages(spark, sf_dir).select("role").union(forms).groupBy("role").agg(F.count("*").alias("n"))
    return roles.select("role", "n", texts.role(F.col("role")).alias("usual"), texts.role_title(F.col("role")).alias("title"))


def tool_pairs(spark, sf_dir):
    """Users' turns as results of the assistant's turn before them."""
    return sessions.paired(_messages(spark, sf_dir)).select("conv_id", "turn", "role", "call_turn", "n_results")


def orphans_dropped(spark, sf_dir):
    return sessions.without_orphans(_messages(spark, sf_dir)).select("conv_id", "turn", "role")


def message_separators(spark, sf_dir):
    return sessions.separators(_messages(spark, sf_dir)).select("conv_id", "turn", "separator")


def chat_edit_diff(spark, sf_dir):
    """Each conversation against an edited copy: short turns gone, system turns reworded, a note after each long one."""
    old = _messages(spark, sf_dir)
    kept = old.filter("length(text) >= 40").withColumn("text", F.when(F.col("role") == "system", F.upper("text")).otherwise(F.col("text")))
    notes = old.filter("length(text) > 300").withColumn("turn", F.col("turn") + 1000)
    return sessions.edit_diff(old, kept.unionByName(notes), ["conv_id", "turn"], "text")


def session_list(spark, sf_dir):
    return sessions.session_list(_messages(spark, sf_dir))


def findings_relevance(spark, sf_dir):
    """The lines of 20 to 300 signs that agents' messages and documents hold, with their relevance; the best 3 of each."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text").select(F.concat(F.lit("d"), "doc_id").alias("owner"), F.lit(0).cast("long").alias("turn"), "text")
    talk = _messages(spark, sf_dir).select(F.concat(F.lit("c"), "conv_id").alias("owner"), "turn", "text")
    lines = docs.union(talk).select("owner", "turn", F.posexplode(F.split("text", "\n")).alias("line", "fact")).withColumn("fact", F.trim("fact")).filter(F.length("fact").between(20, 300))
    rated = lines.withColumn("relevance", texts.relevance(F.col("fact")))
    rank = F.row_number().over(Window.partitionBy("owner").orderBy(F.desc("relevance"), "turn", "line"))
    return rated.withColumn("rank", rank).filter("rank <= 3").select("owner", "turn", "line", "relevance", F.md5("fact").alias("digest"))


def todo_similarity(spark, sf_dir):
    """Whether each message repeats the one before it in its conversation."""
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    m = _messages(spark, sf_dir).withColumn("before", before)
    return m.select("conv_id", "turn", texts.similar_tasks(F.col("text"), F.col("before")).alias("similar"))


def todo_next(spark, sf_dir):
    """Orders as todos: the most urgent open one of each customer."""
    o = table(spark, sf_dir, "orders", "o_custkey", "o_orderkey", "o_orderpriority", "o_orderstatus")
    todos = o.select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("seq"), (-F.substring("o_orderpriority", 1, 1).cast("int")).alias("priority"), F.when(F.col("o_orderstatus") == "O", "pending").otherwise("done").alias("status"))
    return sessions.next_todo(todos).select("owner", "seq", "priority")


def line_context(spark, sf_dir):
    """Lines with a number of three digits, with 5 lines on each side."""
    found = sessions.line_context(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text", "[0-9]{3}", 5)
    return found.select("doc_id", "line", F.md5("before").alias("before"), F.md5("text").alias("text"), F.md5("after").alias("after"))


def feedback_stats(spark, sf_dir):
    labels = table(spark, sf_dir, "labels", "doc_id", "quality", "toxic").join(table(spark, sf_dir, "documents", "doc_id", "lang"), "doc_id")
    return labels.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("quality") > 0).alias("n_up"), F.count_if(F.col("toxic") > 0).alias("n_toxic"))


QUERIES = {f.__name__: f for f in (
    node_upsert, bucket_upsert, sessions_changed, settings_kept, merge_policies, insert_or_ignore, incremental_stale, symbol_conflicts, record_vulnerability, latest_analysis, chat_last_n, chat_compressed, token_estimate, context_status,
    role_normalize, tool_pairs, orphans_dropped, message_separators, chat_edit_diff, session_list, findings_relevance, todo_similarity, todo_next, line_context, feedback_stats,
)}

LOCAL = """local_ as (select c_custkey as address, case when c_acctbal < -500 then null when c_acctbal < 500 then 'FUN_' || lpad(to_hex(c_custkey), 8, '0') else c_name end as name,
  c_mktsegment || '  x' || chr(10) || ' y' as content, c_acctbal > 9000 as user_edited, c_acctbal * 2 as confidence from customer where c_mktsegment <> 'FURNITURE')"""
REMOTE = """remote_ as (select c_custkey as address, case when c_acctbal between 2000 and 4000 then c_name || '_new' when c_acctbal < -800 then null when c_acctbal < -700 then 'sub_1f' else c_name end as name,
  c_mktsegment || case when c_acctbal > 6000 then ' x z' else ' x y ' end as content, case when c_acctbal < -900 then 'comment' else 'function' end as symbol_type, c_acctbal as confidence
  from customer where c_mktsegment <> 'MACHINERY')"""
SQUEEZE = r"trim(regexp_replace(coalesce({}, ''), '\s+', ' ', 'g'))"
MADE_UP = "(({0}) is null or regexp_matches({0}, '^(sub_[0-9a-fA-F]+|FUN_[0-9a-fA-F]+)$'))"
PAIRED = """p as (select *, case when role in ('assistant', 'user') then last_value(case when role = 'assistant' then turn end ignore nulls) over (partition by conv_id order by turn rows between unbounded preceding and current row) end as call_turn from conversations),
q as (select *, case when call_turn is not null then count(*) filter (role = 'user') over (partition by conv_id, call_turn) end as n_results from p)"""
ALNUM = r"trim(regexp_replace(lower({}), '[^a-z0-9\s]', '', 'g'))"
ROLE = """case when role is null or role = '' then 'unknown' when trim(lower(role)) = 'assistant' then 'assistant' when trim(lower(role)) in ('tool call', 'tool_call', 'tool') then 'tool_call'
  when trim(lower(role)) in ('tool response', 'tool_response') then 'tool_response' else trim(lower(role)) end"""


def _any(words) -> str:
    return "|".join(words)


ORACLE_SQL = {
    "node_upsert": f"""with {LOCAL}, {REMOTE} select address, coalesce(r.name, l.name) as name, coalesce(r.content, l.content) as content, case when r.content is not null then r.confidence else l.confidence end as confidence,
  case when l.content is null then 'insert' when r.content is null then 'keep' else 'update' end as change from local_ l full join remote_ r using (address)""",
    # the remote snapshot touches every bucket, so rows that it lacks count as kept in all of them
    "bucket_upsert": f"""with {LOCAL}, {REMOTE}, u as (select address, coalesce(r.name, l.name) as name, coalesce(r.content, l.content) as content, case when r.content is not null then r.confidence else l.confidence end as confidence,
  case when l.content is null then 'insert' when r.content is null then 'keep' else 'update' end as change from local_ l full join remote_ r using (address)),
d as (select * from u where address not in (select o_custkey from orders where o_orderstatus = 'P'))
select * from d union all select s_suppkey * 3, s_name, 's', s_acctbal, 'new' from supplier where s_suppkey * 3 not in (select address from d)""",
    "sessions_changed": """with c as (select conv_id, count(*) as n, max(turn) as turn from conversations group by 1),
k as (select conv_id, case when conv_id % 5 = 0 then 'Renamed ' else 'Chat ' end || conv_id as title, case when n >= 4 then n + 100 else turn end as touched from c where n > 1)
select * from k union all select doc_id, 'About ' || doc_id, 0 from labels where toxic = 1 and doc_id not in (select conv_id from k)""",
    "settings_kept": "select user_id, event_type as setting, value from events qualify row_number() over (partition by user_id, event_type order by ts desc, event_id desc) = 1",
    "merge_policies": f"""with {LOCAL}, {REMOTE} select address, coalesce(r.name, l.name) as name, coalesce(r.content, l.content) as content, 'upsert' as policy from local_ l full join remote_ r using (address)
union all select address, case when l.content is not null then l.name else r.name end, coalesce(l.content, r.content), 'prefer_local' from local_ l full join remote_ r using (address)
union all select address, name, content, 'replace' from remote_""",
    "insert_or_ignore": f"with {LOCAL}, {REMOTE} select address, name from local_ union all select address, name from remote_ where address not in (select address from local_)",
    "incremental_stale": f"""with {LOCAL}, {REMOTE}, s as (select address, case when user_edited is null then 'new' when user_edited then 'edited' when l.name is distinct from r.name then 'renamed'
  when {SQUEEZE.format("l.content")} <> {SQUEEZE.format("r.content")} then 'changed' else 'unchanged' end as reason from remote_ r left join local_ l using (address))
select address, reason in ('new', 'renamed', 'changed') as is_stale, reason from s""",
    "symbol_conflicts": f"""with {LOCAL}, {REMOTE} select address, l.name as local_name, r.name as remote_name, case when {MADE_UP.format("l.name")} then 'NEW' when l.name = r.name then 'SAME' else 'CONFLICT' end as status
from remote_ r left join local_ l using (address) where (symbol_type = 'comment' or not {MADE_UP.format("r.name")}) and r.confidence >= -500""",
    "record_vulnerability": """with n as (select s_suppkey as id, s_acctbal as b, case when s_acctbal > 5000 then ['SEVERITY_HIGH'] else []::varchar[] end as flags, case when s_acctbal < -500 then 'pending' else s_name end as summary from supplier),
f as (select *, b < 0 or b > 8000 as hit, '[VULNERABILITY] USE_AFTER_FREE (HIGH): freed twice' || case when b < -200 then chr(10) || 'Evidence: line 3' else '' end as note from n)
select id, array_to_string(case when not hit then flags when len(flags) > 0 then ['SEVERITY_HIGH', 'VULN_USE_AFTER_FREE', 'LLM_DISCOVERED_VULN'] else ['VULN_USE_AFTER_FREE', 'SEVERITY_HIGH', 'LLM_DISCOVERED_VULN'] end, ',') as flags,
  case when not hit then summary when summary = 'pending' then note else summary || chr(10) || chr(10) || note end as summary from f""",
    "latest_analysis": "select o_custkey, o_orderkey, o_orderstatus from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) as r from orders) where r = 1",
    "chat_last_n": "select conv_id, turn, role from (select *, row_number() over (partition by conv_id, role = 'system' order by turn desc) as r from conversations) where role = 'system' or r <= 10",
    "chat_compressed": "select conv_id, turn, role from (select *, row_number() over (partition by conv_id order by turn desc) as r, min(turn) filter (role = 'user') over (partition by conv_id) as f from conversations) where role = 'system' or turn = f or r <= 4",
    "token_estimate": "select conv_id, count(*) as n_messages, (sum(length(text)) // 4)::bigint as n_tokens from conversations group by 1",
    "context_status": """with t as (select conv_id, (sum(length(text)) // 4)::bigint as n_tokens from conversations group by 1)
select conv_id, n_tokens, n_tokens * 100 // 1000 as percent_used, n_tokens * 100 // 750 as percent_of_threshold, greatest(0, 1000 - n_tokens)::bigint as remaining, n_tokens >= 750 as compress from t""",
    "role_normalize": f"""with r as (select role, count(*) as n from (select role from conversations union all select unnest(['user', ' User', 'Assistant ', 'tool', 'Tool Call', 'TOOL_RESPONSE', 'error', 'edited', '', 'critic', null])) group by 1), u as (select *, {ROLE} as usual from r)
select role, n, usual, case usual when 'tool_call' then 'Tool Call' when 'tool_response' then 'Tool Response' else upper(usual[1]) || substr(usual, 2) end as title from u""",
    "tool_pairs": f"with {PAIRED} select conv_id, turn, role, call_turn, n_results from q",
    "orphans_dropped": f"with {PAIRED} select conv_id, turn, role from q where role <> 'assistant' or coalesce(n_results, 0) > 0",
    "message_separators": "select conv_id, turn, role = 'user' and count(*) filter (role = 'user') over (partition by conv_id order by turn rows between unbounded preceding and current row) > 1 as separator from conversations",
    "chat_edit_diff": """with n as (select conv_id, turn, case when role = 'system' then upper(text) else text end as text from conversations where length(text) >= 40 union all select conv_id, turn + 1000, text from conversations where length(text) > 300)
select conv_id, turn, case when n.text is null then 'deleted' when o.text is null then 'added' when o.text = n.text then 'same' else 'modified' end as status from conversations o full join n using (conv_id, turn)""",
    "session_list": "select conv_id, count(*) as n_messages, max(turn) as last_turn, arg_min(text, turn) filter (role = 'user') as first_user from conversations group by 1",
    "findings_relevance": f"""with t as (select 'd' || doc_id as owner, 0::bigint as turn, text from documents union all select 'c' || conv_id, turn, text from conversations),
l as (select owner, turn, generate_subscripts(x, 1) - 1 as line, trim(unnest(x)) as fact from (select owner, turn, string_split(text, chr(10)) as x from t)),
r as (select *, case when regexp_matches(lower(fact), '{_any(texts.HIGH)}') then 9 when regexp_matches(lower(fact), '{_any(texts.MEDIUM)}') then 6 else 3 end as relevance from l where length(fact) between 20 and 300)
select owner, turn, line::int as line, relevance, md5(fact) as digest from (select *, row_number() over (partition by owner order by relevance desc, turn, line) as k from r) where k <= 3""",
    "todo_similarity": rf"""with m as (select conv_id, turn, {ALNUM.format("text")} as x, {ALNUM.format("lag(text) over (partition by conv_id order by turn)")} as y from conversations),
w as (select *, regexp_split_to_array(x, '\s+') as u, regexp_split_to_array(y, '\s+') as v from m)
select conv_id, turn, coalesce(contains(x, y) or contains(y, x) or len(list_filter(u, lambda z: length(z) > 2 and list_contains(v, z))) / greatest(len(u), len(v)) >= 0.7, false) as similar from w""",
    "todo_next": "select o_custkey as owner, o_orderkey as seq, -o_orderpriority[1]::int as priority from (select *, row_number() over (partition by o_custkey order by -o_orderpriority[1]::int desc, o_orderkey) as r from orders where o_orderstatus = 'O') where r = 1",
    "line_context": """with x as (select doc_id, string_split(text, chr(10)) as l from documents), k as (select doc_id, l, generate_subscripts(l, 1)::int as i from x)
select doc_id, i - 1 as line, md5(coalesce(array_to_string(l[greatest(1, i - 5):i - 1], chr(10)), '')) as before, md5(l[i]) as text, md5(coalesce(array_to_string(l[i + 1:i + 5], chr(10)), '')) as after from k where regexp_matches(l[i], '[0-9]{3}')""",
    "feedback_stats": "select lang, count(*) as n, count(*) filter (quality > 0) as n_up, count(*) filter (toxic > 0) as n_toxic from labels join documents using (doc_id) group by 1",
}
