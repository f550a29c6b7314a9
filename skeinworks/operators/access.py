"""Access to stored records: look-ups, the edges of nodes, tests of nodes, and the small changes that are made to them.

Sets of ids and keys are tables and meet records by equi-joins. Null ids and keys find nothing. Repeated ids count once,
empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinworks.functions.names import flag_form, is_default
from skeinworks.functions.texts import summary_category
from skeinworks.operators.build import EDGE_TYPES, SEVERITIES, VULNERABILITIES
from skeinworks.operators.graph import calls, display_name


def by_keys(rows: DataFrame, wanted: DataFrame, *keys: str) -> DataFrame:
    """The records whose keys are wanted."""
    return rows.join(wanted.select(*keys).distinct(), list(keys), "left_semi").select(*rows.columns)


def pending_first(stored: DataFrame, pending: DataFrame, *keys: str) -> DataFrame:
    """A record for each key: the pending one if there is one, else the stored one."""
    return pending.unionByName(stored.join(pending.select(*keys), list(keys), "left_anti").select(*pending.columns))


def edges_of(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, other, type, direction): outgoing edges, then incoming ones; an edge of a node to itself comes twice."""
    own = ids.select("id").distinct()
    out = edges.select(F.col("source_id").alias("id"), F.col("target_id").alias("other"), "type", F.lit("out").alias("direction"))
    back = edges.select(F.col("target_id").alias("id"), F.col("source_id").alias("other"), "type", F.lit("in").alias("direction"))
    return out.join(own, "id", "left_semi").union(back.join(own, "id", "left_semi"))


def edge_tests(edges: DataFrame, ids: DataFrame, kind: str) -> DataFrame:
    """(id, has_out, has_in): whether each id has an edge of a type at either end."""
    found = edges_of(edges.filter(F.col("type") == kind), ids).groupBy("id").agg(F.bool_or(F.col("direction") == "out").alias("o"), F.bool_or(F.col("direction") == "in").alias("i"))
    no = F.lit(False)
    return ids.select("id").distinct().join(found, "id", "left").select("id", F.coalesce("o", no).alias("has_out"), F.coalesce("i", no).alias("has_in"))


def edges_between(edges: DataFrame, pairs: DataFrame, kind: str) -> DataFrame:
    """(source_id, target_id, found): whether an edge of a type leads from one to the other."""
    known = edges.filter(F.col("type") == kind).select("source_id", "target_id").distinct().withColumn("found", F.lit(True))
    return pairs.select("source_id", "target_id").distinct().join(known, ["source_id", "target_id"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def _some(*columns: str) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | (F.coalesce(F.size(c), F.lit(0)) > 0)
    return out


def has_flags() -> Column:
    return _some("flags")


def has_network_activity() -> Column:
    return _some("network_apis", "ip_addresses", "urls", "domains")


def has_file_activity() -> Column:
    return _some("file_io_apis", "file_paths", "registry_keys")


def features_empty() -> Column:
    """No feature of any kind."""
    return ~_some("network_apis", "file_io_apis", "crypto_apis", "process_apis", "dangerous_functions", "ip_addresses", "urls", "file_paths", "domains", "registry_keys")


def is_indexed(content: Column, summary: Column) -> Column:
    """Whether there is a content or a summary to show."""
    return (F.coalesce(F.length(content), F.lit(0)) > 0) | (F.coalesce(F.length(summary), F.lit(0)) > 0)


def needs_security_update(flags: Column, address: Column) -> Column:
    """No flags yet, and an address to look at."""
    return (F.coalesce(F.size(flags), F.lit(0)) == 0) & (F.coalesce(address, F.lit(0)) != 0)


def is_vulnerability(kind: Column) -> Column:
    return F.coalesce(F.upper(kind).isin(*VULNERABILITIES), F.lit(False))


def is_severity(name: Column) -> Column:
    return F.coalesce(F.upper(name).isin(*SEVERITIES), F.lit(False))


def is_semantic_edge(kind: Column) -> Column:
    return F.coalesce(F.upper(kind).isin(*[t for t, category, *_ in EDGE_TYPES if category == "semantic"]), F.lit(False))


def with_flag(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """Nodes with the flags of `wanted` (id, flag) added in their stored form, each once, in the order of their names."""
    new = wanted.filter("flag is not null").select("id", flag_form(F.col("flag")).alias("flag")).distinct().groupBy("id").agg(F.array_sort(F.collect_list("flag")).alias("__new"))
    flags = F.array_union(F.coalesce("flags", F.array().cast("array<string>")), F.coalesce("__new", F.array().cast("array<string>")))
    return nodes.join(new, "id", "left").withColumn("flags", flags).select(*nodes.columns)


def refreshed(nodes: DataFrame, fresh: DataFrame) -> DataFrame:
    """Nodes whose security data is still missing take the flags of `fresh` (id, flags); all others stay."""
    new = fresh.select("id", F.col("flags").alias("__new"))
    flags = F.when(needs_security_update(F.col("flags"), F.col("address")), F.coalesce("__new", "flags")).otherwise(F.col("flags"))
    return nodes.join(new, "id", "left").withColumn("flags", flags).select(*nodes.columns)


def renamed(nodes: DataFrame, fresh: DataFrame) -> DataFrame:
    """(id, name, changed): the name that a fresh listing (address, name) gives; none there leaves the old one."""
    new = fresh.select("address", F.col("name").alias("__new"))
    joined = nodes.join(new, "address", "left")
    changed = F.col("__new").isNotNull() & ~F.col("__new").eqNullSafe(F.col("name"))
    return joined.select("id", F.when(changed, F.col("__new")).otherwise(F.col("name")).alias("name"), changed.alias("changed"))


def marked_stale(nodes: DataFrame, scope: DataFrame | None = None, key: str = "id") -> DataFrame:
    """All nodes stale, or those whose key is in scope."""
    if scope is None:
        return nodes.withColumn("is_stale", F.lit(True))
    hit = scope.select(key).distinct().withColumn("__hit", F.lit(True))
    return nodes.join(hit, key, "left").withColumn("is_stale", F.col("is_stale") | F.coalesce("__hit", F.lit(False))).select(*nodes.columns)


def saved(old: DataFrame, new: DataFrame, keys: list[str], created: str, value: str) -> DataFrame:
    """Insert, or update where the key exists: the value changes, the time of creation stays that of the first."""
    o = old.select(*keys, F.col(created).alias("__created"), F.col(value).alias("__old"))
    n = new.select(*keys, F.col(created).alias("__now"), F.col(value).alias("__new"), F.lit(True).alias("__comes"))
    return o.join(n, keys, "full").select(*keys, F.coalesce("__created", "__now").alias(created), F.when(F.col("__comes"), F.col("__new")).otherwise(F.col("__old")).alias(value))


def saved_messages(old: DataFrame, new: DataFrame) -> DataFrame:
    """Messages (conv_id, turn, role, text) after saving `new`: a user's first message is never written over."""
    first = old.filter("turn = 0 and role = 'user'").select("conv_id", "turn")
    allowed = new.join(first, ["conv_id", "turn"], "left_anti")
    return allowed.unionByName(old.join(allowed.select("conv_id", "turn"), ["conv_id", "turn"], "left_anti").select(*allowed.columns))


def all_symbols(*parts: tuple[str, DataFrame]) -> DataFrame:
    """(symbol_type, address, name, content) of the kinds of symbols that a program has; made-up names are none."""
    out = None
    for kind, df in parts:
        one = df.select(F.lit(kind).alias("symbol_type"), "address", F.when(~is_default(F.col("name")), F.col("name")).alias("name"), "content")
        out = one if out is None else out.unionByName(one)
    return out.filter("name is not null or content is not null")


def flag_counters(nodes: DataFrame, wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """One row: callers that a propagated flag changes, edges that are new, edges that were there already.

    wanted, existing: (source_id, target_id); nodes: (id, flags) of the callers, with `flag` to be added.
    """
    there = wanted.distinct().join(existing.select("source_id", "target_id").distinct().withColumn("there", F.lit(True)), ["source_id", "target_id"], "left")
    edges = there.agg(F.count_if(F.col("there").isNull()).alias("edges_new"), F.count_if(F.col("there")).alias("edges_existing"))
    callers = wanted.select(F.col("source_id").alias("id")).distinct().join(nodes.select("id", "flags", "flag"), "id")
    return callers.agg(F.count_if(~F.array_contains("flags", F.col("flag"))).alias("callers_updated")).crossJoin(edges)  # a row each


def semantic_analysis(nodes: DataFrame, edges: DataFrame, communities: DataFrame, most: int = 1000) -> DataFrame:
    """What is known of each node: name, address, summary, category, confidence, flags, content, community, callers and callees.

    nodes: id, name, address, content, summary, confidence, flags. communities: (id, community, title). `indexed` tells whether there is
    a content or a summary; without either only name and address are given. callers and callees: display names in
    order, the first `most` of a hub, with n_callers and n_callees for all of them.
    """
    named = nodes.select("id", display_name(F.col("name"), F.col("address")).alias("near"))
    pairs = calls(edges)

    def near(own: str, other: str, name: str) -> DataFrame:
        """Names of the other ends; those of a hub are cut before they are gathered."""
        rows = pairs.select(F.col(own).alias("id"), F.col(other).alias("other")).join(named.select(F.col("id").alias("other"), "near"), "other")
        w = Window.partitionBy("id")
        ranked_ = rows.withColumn("__rank", F.row_number().over(w.orderBy("near", "other"))).withColumn("__n", F.count("*").over(w))
        kept = ranked_.filter(F.col("__rank") <= most).groupBy("id", F.col("__n").alias(f"n_{name}"))
        return kept.agg(F.transform(F.array_sort(F.collect_list(F.struct("__rank", "near"))), lambda x: x["near"]).alias(name))

    indexed = is_indexed(F.col("content"), F.col("summary"))
    joined = nodes.withColumn("indexed", indexed).join(near("target_id", "source_id", "callers"), "id", "left").join(near("source_id", "target_id", "callees"), "id", "left").join(communities.select("id", "title"), "id", "left")
    known = lambda c: F.when(F.col("indexed"), c)
    none, zero = F.array().cast("array<string>"), F.lit(0).cast("long")
    return joined.select(
        "id",
        display_name(F.col("name"), F.col("address")).alias("name"),
        "address",
        "indexed",
        known(F.col("summary")).alias("summary"),
        known(summary_category(F.col("summary"))).alias("category"),
        known(F.col("confidence")).alias("confidence"),
        known(F.array_join("flags", ",")).alias("flags"),
        known(F.col("content")).alias("content"),
        known(F.array_join(F.coalesce("callers", none), ",")).alias("callers"),
        known(F.array_join(F.coalesce("callees", none), ",")).alias("callees"),
        known(F.coalesce("n_callers", zero)).alias("n_callers"),
        known(F.coalesce("n_callees", zero)).alias("n_callees"),
        known(F.col("title")).alias("community"),
    )


def looked_up(asked: DataFrame, nodes: DataFrame) -> DataFrame:
    """(ask, id) for each request (ask, address, name): the node at the address, else the first one of the name; null where there is none."""
    by_address = asked.join(nodes.filter("address is not null").groupBy("address").agg(F.min("id").alias("at")), "address", "left")
    both = by_address.join(nodes.groupBy("name").agg(F.min("id").alias("first")), "name", "left")
    return both.select("ask", F.coalesce("at", "first").alias("id"))


def function_security(nodes: DataFrame, calls: DataFrame) -> DataFrame:
    """(id, flags, n_flags, vulnerable_callees, vulnerable_callers): a function's own flags and its neighbours that have any.

    calls: distinct (source_id, target_id).
    """
    flagged = nodes.filter(F.size("flags") > 0).select("id")
    count = lambda own, other, name: calls.join(flagged.select(F.col("id").alias(other)), other, "left_semi").groupBy(F.col(own).alias("id")).agg(F.count("*").alias(name))
    out = nodes.join(count("source_id", "target_id", "vulnerable_callees"), "id", "left").join(count("target_id", "source_id", "vulnerable_callers"), "id", "left")
    zero = F.lit(0).cast("long")
    return out.select("id", F.array_join("flags", ",").alias("flags"), F.size("flags").cast("long").alias("n_flags"), F.coalesce("vulnerable_callees", zero).alias("vulnerable_callees"), F.coalesce("vulnerable_callers", zero).alias("vulnerable_callers"))


def ranked(rows: DataFrame, limit: int, *order: Column) -> DataFrame:
    """With `rank`, the first rows in an order."""
    top = rows.orderBy(*order).limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)))  # over `limit` rows
