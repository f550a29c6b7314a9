"""Builds graphs from records of code: calls, references, containment; merges graphs and pending records into stored ones.

Null addresses and ids meet nothing, so what hangs on them makes no edge. Repeated records make an edge once. Spans that
overlap each take what lies in both. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skeinworks.functions.names import external_name, thunk_name
from skeinworks.operators.merge import intervals_containing
from skeinworks.sources.tables import cut

#: Types of edges with category, words and whether they have a direction.
EDGE_TYPES = (
    ("CONTAINS", "structural", "Contains", True),
    ("CALLS", "structural", "Calls", True),
    ("FLOWS_TO", "structural", "Flows to", True),
    ("REFERENCES", "structural", "References", True),
    ("INHERITS", "structural", "Inherits from", True),
    ("SIMILAR_PURPOSE", "semantic", "Similar purpose to", False),
    ("DEPENDS_ON", "semantic", "Depends on", True),
    ("IMPLEMENTS", "semantic", "Implements", True),
    ("RELATED_TO", "semantic", "Related to", False),
    ("VULNERABLE_VIA", "security", "Vulnerable via", True),
    ("TAINT_FLOWS_TO", "security", "Taint flows to", True),
    ("CALLS_VULNERABLE", "security", "Calls vulnerable", True),
    ("NETWORK_SEND", "security", "Network send", True),
    ("NETWORK_RECV", "security", "Network recv", True),
    ("BELONGS_TO_COMMUNITY", "community", "Belongs to", True),
    ("SIBLING", "community", "Sibling of", False),
)

#: What a recorded vulnerability may be, and how grave.
VULNERABILITIES = (
    "BUFFER_OVERFLOW", "COMMAND_INJECTION", "FORMAT_STRING", "USE_AFTER_FREE", "INTEGER_OVERFLOW", "PATH_TRAVERSAL", "SQL_INJECTION",
    "RACE_CONDITION", "MEMORY_LEAK", "NULL_DEREF", "INFO_DISCLOSURE", "AUTH_BYPASS", "CRYPTO_WEAKNESS", "OTHER",
)
SEVERITIES = ("LOW", "MEDIUM", "HIGH", "CRITICAL")

#: Width of the narrowest blocks of addresses.
NARROWEST = 64


def edge_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(EDGE_TYPES), "type string, category string, display string, directed boolean")


def resolved_thunks(functions: DataFrame) -> DataFrame:
    """(address, real): where each function's chain of thunks ends; by pointer doubling, so long chains take few joins.

    The rounds grow with the number of thunks, so no chain is too long. What leads into a cycle has no end but itself.
    """
    step = functions.select("address", F.when(F.col("is_thunk"), F.coalesce("thunk_target", "address")).otherwise(F.col("address")).alias("real"))
    at = step
    for _ in range(functions.filter("is_thunk").count().bit_length()):
        on = at.select(F.col("address").alias("real"), F.col("real").alias("on"))
        at = cut(at.join(on, "real", "left").select("address", F.coalesce("on", "real").alias("real")))
    goes_on = step.filter("real != address").select(F.col("address").alias("real")).distinct().withColumn("goes_on", F.lit(True))
    return at.join(goes_on, "real", "left").select("address", F.when(F.col("goes_on"), F.col("address")).otherwise(F.col("real")).alias("real"))


def call_edges(functions: DataFrame, refs: DataFrame) -> DataFrame:
    """Distinct (source_id, target_id, type) of calls.

    functions: address, end_address, name, is_thunk, is_external, thunk_target. refs: from_addr, to_addr. A call belongs to
    the function whose body holds it and goes to the function that holds its target, past thunks. What is external, or a
    thunk without an end, is a node by its name (`ext:` and the plain name); calls into nowhere are left out.
    """
    caller = intervals_containing(refs, "from_addr", functions.select(F.col("address").alias("source"), F.col("address").alias("a"), F.col("end_address").alias("b")), "a", "b", NARROWEST).select("source", "to_addr").distinct()
    callee = intervals_containing(caller, "to_addr", functions.select(F.col("address").alias("hit"), F.col("address").alias("a"), F.col("end_address").alias("b")), "a", "b", NARROWEST).select("source", F.col("hit").alias("address")).distinct()
    ends = functions.select(F.col("address").alias("real"), "name", "is_thunk", "is_external")
    full = callee.join(resolved_thunks(functions), "address").join(ends, "real")
    target = F.when(F.col("is_external"), F.concat(F.lit("ext:"), external_name(F.col("name")))).when(F.col("is_thunk"), F.concat(F.lit("ext:"), thunk_name(F.col("name")))).otherwise(F.col("real").cast("string"))
    return full.select(F.col("source").cast("string").alias("source_id"), target.alias("target_id"), F.lit("CALLS").alias("type")).distinct()


def reference_edges(functions: DataFrame, refs: DataFrame) -> DataFrame:
    """Distinct REFERENCES edges between different functions, for references that are neither calls nor data."""
    span = lambda name: functions.select(F.col("address").alias(name), F.col("address").alias("a"), F.col("end_address").alias("b"))
    near = intervals_containing(refs, "from_addr", span("source_id"), "a", "b", NARROWEST).select("source_id", "to_addr").distinct()
    both = intervals_containing(near, "to_addr", span("target_id"), "a", "b", NARROWEST).filter("source_id <> target_id")
    return both.select("source_id", "target_id", F.lit("REFERENCES").alias("type")).distinct()


def contains_edges(binaries: DataFrame, functions: DataFrame) -> DataFrame:
    """CONTAINS edges from each binary (id, binary_id) to its functions (id, binary_id)."""
    return binaries.select(F.col("id").alias("source_id"), "binary_id").join(functions.select(F.col("id").alias("target_id"), "binary_id"), "binary_id").select("source_id", "target_id", F.lit("CONTAINS").alias("type"))


def user_edges(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """New semantic edges (source_id, target_id, type, confidence): known types, weights within 0 and 1 (0.8 for none), none twice.

    Wanted and existing edges meet in one grouping by their ends and type. A null end meets none that exists.
    """
    known, key = [t for t, category, *_ in EDGE_TYPES if category == "semantic"], ["source_id", "target_id", "type"]
    weight = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("confidence", F.lit(0.8))))
    new = wanted.filter(F.col("type").isin(*known)).select(*key, weight.alias("weight"), F.lit(False).alias("there"))
    old = existing.filter(F.col("type").isin(*known)).dropna(subset=key).select(*key, F.lit(None).cast("double").alias("weight"), F.lit(True).alias("there"))
    both = new.unionByName(old).groupBy(*key).agg(F.max("weight").alias("weight"), F.bool_or("there").alias("there"))
    return both.filter("not there").drop("there")


def first_wins(pending: DataFrame, by: str = "seq") -> DataFrame:
    """A batch of nodes without repeats: of each address (else name) the first by `seq`, with the first content there is.

    Nodes with neither stay each for itself; `seq` is different in every row.
    """
    key = F.coalesce(F.concat(F.lit("a"), F.col("address").cast("string")), F.concat(F.lit("n"), F.col("name")), F.concat(F.lit("s"), F.col(by).cast("string")))
    w = Window.partitionBy("__key").orderBy(by)
    all_ = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = pending.withColumn("__key", key).withColumn("content", F.first("content", ignorenulls=True).over(all_)).withColumn("__rank", F.row_number().over(w))
    return rows.filter("__rank = 1").drop("__rank", "__key")


def stored_ids(edges: DataFrame, pending: DataFrame, stored: DataFrame) -> DataFrame:
    """Edges with the ids of stored nodes in place of pending ones with the same address."""
    known = pending.filter("address <> 0").select(F.col("id").alias("old"), "address").join(stored.select("address", F.col("id").alias("new")), "address").select("old", "new")
    for end in ("source_id", "target_id"):
        edges = edges.join(known.select(F.col("old").alias(end), F.col("new").alias("__new")), end, "left").withColumn(end, F.coalesce("__new", end)).drop("__new")
    return edges.select("source_id", "target_id", *[c for c in edges.columns if c not in ("source_id", "target_id")])


def merged_graph(local: DataFrame, remote: DataFrame, remote_edges: DataFrame) -> DataFrame:
    """(source_id, target_id, type) of remote edges (by address) whose ends both exist here or there; local ids win."""
    ids = local.select("address", F.col("id").alias("__l")).join(remote.select("address", F.col("id").alias("__r")), "address", "full").select("address", F.coalesce("__l", "__r").alias("id"))
    at = lambda name, out: ids.select(F.col("address").alias(name), F.col("id").alias(out))
    return remote_edges.join(at("source", "source_id"), "source").join(at("target", "target_id"), "target").select("source_id", "target_id", "type").distinct()


def local_context(nodes: DataFrame, edges: DataFrame, most: int = 100, shown: int = 1000) -> DataFrame:
    """(id, context): a node in words, with its flags, callers and callees by name. nodes: id, name, address, flags, summary.

    Of a hub's callers or callees the first `shown` lines are gathered and the others counted in a last line.
    """
    line = F.concat(F.lit("- "), F.col("name"), F.coalesce(F.concat(F.lit(": "), F.when(F.length("summary") > most, F.concat(F.substring("summary", 1, most), F.lit("..."))).otherwise(F.col("summary"))), F.lit("")))
    lines = nodes.select(F.col("id").alias("other"), line.alias("line"))
    pairs = edges.filter("type = 'CALLS'").select("source_id", "target_id").distinct()

    def side(own: str, other: str, name: str) -> DataFrame:
        near = pairs.select(F.col(own).alias("id"), F.col(other).alias("other")).join(lines, "other").filter("line is not null")
        rank = F.row_number().over(Window.partitionBy("id").orderBy("line"))
        first = near.withColumn("__rank", rank).filter(F.col("__rank") <= shown).groupBy("id").agg(F.array_sort(F.collect_list("line")).alias(name))
        listed = first.join(near.groupBy("id").agg(F.count("*").alias("__n")), "id")
        more = F.when(F.col("__n") > shown, F.concat(F.lit("\n- (+"), (F.col("__n") - shown).cast("string"), F.lit(" more)"))).otherwise("")
        return listed.select("id", F.concat(F.array_join(name, "\n"), more).alias(name))

    out = nodes.join(side("target_id", "source_id", "callers"), "id", "left").join(side("source_id", "target_id", "callees"), "id", "left")
    part = lambda title, c: F.when(F.length(c) > 0, F.concat(F.lit(title), F.col(c), F.lit("\n\n")))
    flags = out.withColumn("__flags", F.array_join("flags", ", "))
    head = F.concat(F.lit("### "), F.col("name"), F.lit(" (0x"), F.lower(F.hex("address")), F.lit(")\n\n"))
    text = F.concat_ws("", F.lit("## Function Context\n\n"), head, part("**Summary:** ", "summary"), part("**Security Flags:** ", "__flags"), part("**Called by:**\n", "callers"), part("**Calls:**\n", "callees"))
    return flags.select("id", text.alias("context"))


def todo_items(df: DataFrame, owner: str, text_col: str) -> DataFrame:
    """(owner, seq, task, priority) of checklist, numbered and bullet lines; priorities fall from 10 to 1."""
    lines = df.select(owner, F.posexplode(F.split(text_col, "\n")).alias("line", "raw")).withColumn("raw", F.trim("raw"))
    mark = r"^(-\s*\[[ xX]\]|[0-9]+\.|[-*])\s+"
    found = lines.filter(F.col("raw").rlike(mark + r"\S")).withColumn("task", F.trim(F.regexp_replace("raw", mark, "")))
    seq = F.row_number().over(Window.partitionBy(owner).orderBy("line"))
    return found.select(owner, seq.alias("seq"), "task").withColumn("priority", F.greatest(F.lit(1), 11 - F.col("seq")))
