"""Taint search: shortest paths from sources to sinks, reachability edges and flags that spread along calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinworks.functions.catalog import ENTRY_NAMES, RECEIVERS, SENDERS, TAINT_SINKS, TAINT_SOURCES
from skeinworks.functions.names import library_name
from skeinworks.operators.graph import calls, display_name, reach
from skeinworks.sources.tables import stored

MAX_HOPS = 10
#: The flags that make a node a source, a sink or an entry point.
SOURCE_FLAGS = ("NETWORK_CAPABLE", "HANDLES_USER_INPUT", "PARSES_NETWORK_DATA", "FILE_READER", "ACCEPTS_CONNECTIONS")
SINK_FLAGS = ("BUFFER_OVERFLOW_RISK", "COMMAND_INJECTION_RISK", "FORMAT_STRING_RISK", "PATH_TRAVERSAL_RISK", "SQL_INJECTION_RISK", "CALLS_VULNERABLE_FUNCTION")
ENTRY_FLAGS = ("ENTRY_POINT", "EXPORTED")


def has_any(flags: Column, wanted: tuple[str, ...]) -> Column:
    return F.arrays_overlap(flags, F.array(*map(F.lit, wanted)))


def taint_set(nodes: DataFrame, edges: DataFrame, flags: tuple[str, ...], names: frozenset[str], plain=lambda name: name) -> DataFrame:
    """(id) of the functions that have one of the flags, or one of the names, or call a function of such a name.

    nodes: id, name, flags. plain: the form in which names are looked up.
    """
    known = F.coalesce(plain(F.col("name")).isin(*sorted(names)), F.lit(False))
    own = nodes.filter((has_any(F.col("flags"), flags) | known) if flags else known).select("id")
    called = nodes.filter(known).select(F.col("id").alias("target_id"))
    return own.union(calls(edges).join(called, "target_id", "left_semi").select("source_id")).distinct().join(nodes.select("id"), "id", "left_semi")


def sources(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Where untrusted data comes in: (id)."""
    return taint_set(nodes, edges, SOURCE_FLAGS, TAINT_SOURCES)


def sinks(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Where it does harm: (id)."""
    return taint_set(nodes, edges, SINK_FLAGS, TAINT_SINKS)


def senders(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Functions that send over a network, by the plain names of calls: (id)."""
    return taint_set(nodes, edges, (), SENDERS, library_name)


def receivers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return taint_set(nodes, edges, (), RECEIVERS, library_name)


def entries(nodes: DataFrame) -> DataFrame:
    """Entry points by flag or by name: (id)."""
    return nodes.filter(has_any(F.col("flags"), ENTRY_FLAGS) | F.coalesce(F.col("name").isin(*sorted(ENTRY_NAMES)), F.lit(False))).select("id")


def taint_stats(nodes: DataFrame, edges: DataFrame, samples: int = 10) -> DataFrame:
    """(kind, n, sample): how many sources and sinks there are, with the names of the first ones by id."""
    named = nodes.select("id", display_name(F.col("name"), F.col("address")).alias("name"))

    def one(kind: str, ids: DataFrame) -> DataFrame:
        first = ids.join(named, "id").orderBy("id").limit(samples).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "name"))), lambda x: x["name"]), ",").alias("sample"))
        return ids.agg(F.count("*").alias("n")).crossJoin(first).select(F.lit(kind).alias("kind"), "n", "sample")  # a row each

    return one("source", sources(nodes, edges)).unionByName(one("sink", sinks(nodes, edges)))


def is_vulnerable(flags: Column, strict: bool = False) -> Column:
    """Whether a flag starts with VULN_ or ends with _RISK; the level flags count too, unless strict."""
    level = ("HIGH_RISK", "MEDIUM_RISK", "NETWORK_WITH_VULN_RISK")
    return F.exists(flags, lambda f: f.startswith("VULN_") | (f.endswith("_RISK") & (~f.isin(*level) if strict else F.lit(True))))


def severity(flags: Column) -> Column:
    """By the gravest of a sink's flags."""
    return (
        F.when(F.size(flags) == 0, "MEDIUM")
        .when(has_any(flags, ("COMMAND_INJECTION_RISK", "VULN_COMMAND_INJECTION", "SQL_INJECTION_RISK")), "CRITICAL")
        .when(has_any(flags, ("BUFFER_OVERFLOW_RISK", "VULN_BUFFER_OVERFLOW", "FORMAT_STRING_RISK")), "HIGH")
        .when(has_any(flags, ("PATH_TRAVERSAL_RISK", "CALLS_VULNERABLE_FUNCTION")), "MEDIUM")
        .otherwise("LOW")
    )


def vulnerability_type(flags: Column) -> Column:
    """The first VULN_ flag without that beginning, else the first _RISK flag without that end, else UNKNOWN."""
    named = F.get(F.filter(flags, lambda f: f.startswith("VULN_")), 0)
    risk = F.get(F.filter(flags, lambda f: f.endswith("_RISK")), 0)
    return F.coalesce(F.substring(named, 6, 1 << 20), F.replace(risk, F.lit("_RISK"), F.lit("")), F.lit("UNKNOWN"))


def distances(pairs: DataFrame, seeds: DataFrame, hops: int, left: DataFrame | None = None) -> DataFrame:
    """(node, hops): least number of steps, from 0, in which any of the seeds (id) reaches a node; one row per node.

    left: (node, left) where given: the search enters only nodes in it, and those only where steps and `left` make `hops` at most.
    """
    allowed = lambda df, k: df if left is None else df.join(left.filter(F.col("left") <= hops - k).select("node"), "node", "left_semi")
    level, n = stored(allowed(seeds.select(F.col("id").alias("node")).distinct(), 0).withColumn("hops", F.lit(0)), "level")
    found = level
    for k in range(1, hops + 1):
        if not n:
            break
        steps = level.join(pairs, level["node"] == pairs["source_id"]).select(F.col("target_id").alias("node")).distinct()
        level, n = stored(allowed(steps, k).join(found, "node", "left_anti").withColumn("hops", F.lit(k)), "level")
        found = found.unionByName(level)
    return found


def _turned(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"))


def shortest_paths(pairs: DataFrame, sources: DataFrame, sinks: DataFrame | None = None, hops: int = MAX_HOPS, max_paths: int | None = None) -> DataFrame:
    """(source, sink, hops, path): of the shortest paths between each source and each other sink that it reaches, the least one.

    pairs: distinct (source_id, target_id) over the ids of `sources` and `sinks` (id; all nodes where it is None). max_paths: only so many, the first by
    source and sink. Null ids join nothing; without sources or sinks there are no paths.

    Three searches by levels, of ids alone: from the sinks against the calls (a row per node); from the sources, through nodes
    whose distance to a sink fits what is left of the hops; then from each sink against the calls through what both
    have seen, where each (node, sink) keeps the least next node on a shortest path. A least path is made of least
    next nodes, so paths are read off these rows at the end, and only for the pairs that are asked for.
    """
    pairs, _ = stored(pairs.select("source_id", "target_id"), "calls")
    sinks = pairs.select(F.col("target_id").alias("id")).distinct() if sinks is None else sinks
    to_sink = distances(_turned(pairs), sinks, hops).select("node", F.col("hops").alias("left"))
    from_source = distances(pairs, sources, hops, to_sink)
    live = from_source.join(to_sink, "node").filter(F.col("hops") + F.col("left") <= hops)
    live, _ = stored(live.select("node", F.col("hops").alias("before")), "live")
    begins = live.select(F.col("node").alias("source_id"), "before")
    within, _ = stored(pairs.join(begins, "source_id").join(live.select(F.col("node").alias("target_id")), "target_id", "left_semi"), "within")
    level, n = stored(live.join(sinks.select(F.col("id").alias("node")), "node", "left_semi").select("node", F.col("node").alias("sink"), F.lit(0).alias("hops"), F.col("node").alias("next")), "next")
    steps = level
    for k in range(1, hops + 1):
        if not n:
            break
        reached = level.select(F.col("node").alias("target_id"), "sink")
        new = within.filter(F.col("before") + k <= hops).join(reached, "target_id").groupBy(F.col("source_id").alias("node"), "sink").agg(F.min("target_id").alias("next"))
        level, n = stored(new.join(steps, ["node", "sink"], "left_anti").select("node", "sink", F.lit(k).alias("hops"), "next"), "next")
        steps = steps.unionByName(level)
    steps, _ = stored(steps, "steps")  # one table: it is read once for each step of the paths
    found = steps.filter("node != sink").join(sources.select(F.col("id").alias("node")).distinct(), "node", "left_semi")
    if max_paths is not None:
        found = found.orderBy("node", "sink").limit(max_paths)
    begun, n = stored(found.select(F.col("node").alias("source"), "sink", "hops", F.array("node", "next").alias("path"), F.col("next").alias("at")), "paths")
    most = (begun.agg(F.max("hops")).first()[0] or 1) if n else 1
    for k in range(2, most + 1):  # a path that has come to its sink finds no next node
        ahead = steps.filter((F.col("hops") > 0) & (F.col("hops") <= most - k + 1)).select(F.col("node").alias("at"), "sink", "next")
        longer = F.when(F.col("next").isNotNull(), F.concat("path", F.array("next"))).otherwise(F.col("path"))
        begun = begun.join(ahead, ["at", "sink"], "left").select("source", "sink", "hops", longer.alias("path"), F.col("next").alias("at"))
    return begun.select("source", "sink", "hops", "path")


def paths_to(pairs: DataFrame, sinks: DataFrame, hops: int = MAX_HOPS) -> DataFrame:
    """(source, sink, hops, path) from all that reach a sink; of shortest paths the one that is least read from the sink.

    The search goes against the calls from all sinks at once. All that it meets is part of the result, so nothing is pruned; a level
    keeps the least path of each (sink, node), which is exact, as paths of one length compare by their beginnings first.
    """
    pairs, _ = stored(_turned(pairs), "calls")
    level, n = stored(sinks.select(F.col("id").alias("sink"), F.col("id").alias("node"), F.array("id").alias("path")).distinct(), "level")
    seen, found = level.select("sink", "node"), None
    for k in range(1, hops + 1):
        if not n:
            break
        new = level.join(pairs, level["node"] == pairs["source_id"]).select("sink", F.col("target_id").alias("node"), F.concat("path", F.array("target_id")).alias("path"))
        level, n = stored(new.groupBy("sink", "node").agg(F.min("path").alias("path")).join(seen, ["sink", "node"], "left_anti"), "level")
        seen = seen.unionByName(level.select("sink", "node"))
        one = level.select(F.col("node").alias("source"), "sink", F.lit(k).alias("hops"), F.reverse("path").alias("path"))
        found = one if found is None else found.unionByName(one)
    return found if found is not None else level.select(F.col("node").alias("source"), "sink", F.lit(0).alias("hops"), "path").filter("false")


def path_records(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """(source, sink, severity, json) of paths: names and addresses of ends and of each step, as a tool returns them.

    nodes: id, name, address, flags. A step without a node is left out; a path without one of its ends has no record.
    """
    named = nodes.select("id", display_name(F.col("name"), F.col("address")).alias("name"), F.concat(F.lit("0x"), F.lower(F.hex("address"))).alias("address"), "flags")
    steps = paths.select("source", "sink", "hops", F.posexplode("path").alias("place", "id")).join(named, "id")
    step = F.struct("name", "address")
    whole = steps.groupBy("source", "sink", "hops").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", step.alias("step")))), lambda x: x["step"]).alias("path"),  # at most hops + 1
        F.first(F.when(F.col("id") == F.col("source"), step), True).alias("first"),
        F.first(F.when(F.col("id") == F.col("sink"), step), True).alias("last"),
        F.first(F.when(F.col("id") == F.col("sink"), severity(F.col("flags"))), True).alias("severity"),
    )
    record = F.struct(
        F.col("first.name").alias("source"), F.col("first.address").alias("source_address"), F.col("last.name").alias("sink"), F.col("last.address").alias("sink_address"),
        "severity", F.col("hops").alias("path_length"), "path",
    )
    return whole.filter("first is not null and last is not null").select("source", "sink", "severity", F.to_json(record).alias("json"))


def path_edges(paths: DataFrame, kind: str = "TAINT_FLOWS_TO") -> DataFrame:
    """(source_id, target_id, type, n_paths): the steps of all paths, each once."""
    steps = F.arrays_zip(F.slice("path", 1, F.size("path") - 1).alias("source_id"), F.slice("path", 2, F.size("path") - 1).alias("target_id"))
    return paths.select(F.inline(steps)).groupBy("source_id", "target_id").agg(F.count("*").alias("n_paths")).withColumn("type", F.lit(kind))


def vulnerable_via(pairs: DataFrame, nodes: DataFrame, entries: DataFrame, hops: int = MAX_HOPS) -> DataFrame:
    """(source_id, target_id, hops, vulnerability_type): entry points and the vulnerable nodes that they reach."""
    bad = nodes.filter(is_vulnerable(F.col("flags"))).select(F.col("id").alias("node"), vulnerability_type(F.col("flags")).alias("vulnerability_type"))
    found = reach(pairs, entries, hops).filter("seed != node").join(bad, "node")
    return found.select(F.col("seed").alias("source_id"), F.col("node").alias("target_id"), "hops", "vulnerability_type")


def calls_vulnerable(edges: DataFrame, nodes: DataFrame, unique: bool = False) -> DataFrame:
    """CALLS_VULNERABLE edges: calls of a node with a vulnerability flag. unique: no call comes twice."""
    bad = nodes.filter(is_vulnerable(F.col("flags"))).select(F.col("id").alias("target_id"), vulnerability_type(F.col("flags")).alias("vulnerability_type"))
    return calls(edges, unique=unique).join(bad, "target_id").select("source_id", "target_id", F.lit("CALLS_VULNERABLE").alias("type"), "vulnerability_type")


def propagate(edges: DataFrame, nodes: DataFrame, flag: str = "CALLS_VULNERABLE_FUNCTION", unique: bool = False) -> DataFrame:
    """`nodes` in which each direct caller of a vulnerable node has the flag, once."""
    hit = calls_vulnerable(edges, nodes, unique).select(F.col("source_id").alias("id")).distinct().withColumn("hit", F.lit(True))
    more = F.when(F.coalesce("hit", F.lit(False)), F.array_union("flags", F.array(F.lit(flag)))).otherwise(F.col("flags"))
    return nodes.join(hit, "id", "left").withColumn("flags", more).drop("hit")


def send_edges(edges: DataFrame, entries: DataFrame, senders: DataFrame, hops: int = MAX_HOPS) -> DataFrame:
    """NETWORK_SEND edges: entry points that reach a sender (weight 1), direct callers of one (0.5); the larger weight stays."""
    far = reach(calls(edges), entries, hops).filter("seed != node").join(senders.select(F.col("id").alias("node")), "node", "left_semi").select(F.col("seed").alias("source_id"), F.col("node").alias("target_id"), F.lit(1.0).alias("weight"))
    near = calls(edges).join(senders.select(F.col("id").alias("target_id")), "target_id", "left_semi").select("source_id", "target_id", F.lit(0.5).alias("weight"))
    return far.unionByName(near).groupBy("source_id", "target_id").agg(F.max("weight").alias("weight"))


def receive_edges(edges: DataFrame, receivers: DataFrame) -> DataFrame:
    """NETWORK_RECV edges: a receiver and its callers (weight 1), their callers (0.5); the larger weight stays."""
    back = calls(edges).select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"))
    found = reach(back, receivers, 2).filter("seed != node")
    return found.select(F.col("seed").alias("source_id"), F.col("node").alias("target_id"), F.when(F.col("hops") == 1, 1.0).otherwise(0.5).alias("weight"))
