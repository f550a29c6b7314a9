"""Communities by label propagation, their records, statistics and summaries.

Rounds are synchronous and a node votes for its own label too, so that labels settle and do not depend on any order: the
most frequent label wins, of equals the least. A round is a join, a partial aggregate per (node, label) and an argmax.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinworks.operators.graph import display_name
from skeinworks.operators.paths import has_any
from skeinworks.sources.tables import stored

ROUNDS = 100
#: Of so many nodes one may have moved for a round to look around the moved ones alone.
FEW = 8
#: Flags that make a community part of the attack surface.
ATTACK_FLAGS = ("BUFFER_OVERFLOW_RISK", "COMMAND_INJECTION_RISK", "FORMAT_STRING_RISK", "PATH_TRAVERSAL_RISK", "SQL_INJECTION_RISK", "NETWORK_CAPABLE", "CALLS_VULNERABLE_FUNCTION")

#: Purposes in order, with the parts of names and the flags that tell them.
PURPOSES = (
    ("network I/O", ("recv", "send", "socket", "connect", "http", "network"), ("NETWORK_CAPABLE",)),
    ("file operations", ("file", "read", "write", "open", "fopen", "fclose"), ("FILE_READER", "FILE_WRITER")),
    ("cryptographic operations", ("crypt", "encrypt", "decrypt", "hash", "aes", "sha"), ("USES_CRYPTO",)),
    ("string processing", ("str", "string", "parse", "format"), ()),
    ("memory management", ("alloc", "malloc", "free", "memory", "heap"), ()),
    ("UI/graphics", ("window", "dialog", "button", "menu", "draw", "paint"), ()),
    ("process/thread management", ("thread", "process", "create", "spawn"), ("SPAWNS_PROCESSES",)),
    ("registry operations", ("reg", "registry", "hkey"), ()),
    ("initialization/entry", ("init", "setup", "start", "main"), ()),
)


def label_propagation(pairs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(id, label) of every node of `pairs` (distinct source_id, target_id; a pair in both directions counts twice).

    A node can change its label only if its own or a neighbour's has changed in the round before. Once few have, only the
    nodes around these vote; all others keep their labels, as they would if they voted.
    """
    ends = F.array(F.struct(F.col("source_id").alias("id"), F.col("target_id").alias("near")), F.struct(F.col("target_id").alias("id"), F.col("source_id").alias("near")))
    both, _ = stored(pairs.select(F.inline(ends)), "neighbours")  # the pairs are made once
    labels, n = stored(both.select("id").distinct().withColumn("label", F.col("id")).withColumn("moved", F.lit(True)), "labels")
    n_moved = n
    for _ in range(rounds):
        near, own, kept = both, labels.select("id", "label"), None
        if n_moved * FEW <= n:
            moved = labels.filter("moved").select("id")
            around = both.join(moved.select(F.col("id").alias("near")), "near", "left_semi").select("id").union(moved).distinct()
            around, _ = stored(around, "around")
            near, own = both.join(around, "id", "left_semi"), own.join(around, "id", "left_semi")
            kept = labels.join(around, "id", "left_anti").select("id", "label", F.lit(False).alias("moved"))
        votes = near.join(labels.select(F.col("id").alias("near"), "label"), "near").select("id", "label", F.lit(False).alias("own"))
        votes = votes.union(own.withColumn("own", F.lit(True)))
        counts = votes.groupBy("id", "label").agg(F.count("*").alias("n"), F.bool_or("own").alias("own"))
        best = counts.groupBy("id").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("label"), F.max(F.when(F.col("own"), F.col("label"))).alias("was"))
        new = best.select("id", "label", (~F.col("label").eqNullSafe(F.col("was"))).alias("moved"))
        labels, _ = stored(new if kept is None else new.unionByName(kept), "labels")
        n_moved = labels.filter("moved").count()
        if not n_moved:
            break
    return labels.select("id", "label")


def merge_small(labels: DataFrame, least: int = 2) -> DataFrame:
    """(id, community): groups below `least` nodes go to the largest group (of equals the least label); numbered by label."""
    sizes = labels.groupBy("label").agg(F.count("*").alias("n"))
    top = sizes.filter(F.col("n") >= least).agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("top"))  # one row
    joined = labels.join(sizes, "label").join(F.broadcast(top))
    return joined.select("id", F.when(F.col("n") >= least, F.col("label")).otherwise(F.coalesce("top", "label")).alias("community"))


def is_generic(name: Column) -> Column:
    """Whether a name was made up from an address."""
    return name.startswith("FUN_") | name.startswith("sub_")


def flag_sets(rows: DataFrame, key: str) -> DataFrame:
    """(key, flags): the different flags of a group in order; groups without any have no row. Flags, not lists of them, are gathered."""
    return rows.select(key, F.explode("flags").alias("flag")).distinct().groupBy(key).agg(F.array_sort(F.collect_list("flag")).alias("flags"))


def records(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """A row per community: size, title by the shortest name, flagged members, score (all their flags), flags.

    Key functions are those of key_functions, the purpose is that of summaries.
    """
    full = members.join(nodes.select("id", "name", "flags"), "id")
    named = F.when(F.col("name").isNotNull() & ~is_generic(F.col("name")), F.col("name"))
    basic = full.groupBy("community").agg(
        F.count("*").alias("members"),
        F.sum((F.size("flags") > 0).cast("long")).alias("flagged"),
        F.sum(F.size("flags").cast("long")).alias("score"),
        F.min_by(named, F.when(named.isNotNull(), F.struct(F.length(named), named))).alias("shortest"),
    ).join(flag_sets(full, "community"), "community", "left").withColumn("flags", F.coalesce("flags", F.array().cast("array<string>")))
    title = F.when(F.col("shortest").isNotNull(), F.concat("shortest", F.lit("_group ("), F.col("members").cast("string"), F.lit(")"))).otherwise(F.concat(F.lit("community_"), F.col("community").cast("string"), F.lit(" ("), F.col("members").cast("string"), F.lit(" functions)")))
    return basic.withColumn("title", title)


def _first(rows: DataFrame, key: str, value: str, shown: int, name: str) -> DataFrame:
    """(key, name: the first values by `value`, distinct, at most `shown`): ranks are cut before anything is gathered."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(value))
    some = rows.select(key, value).distinct().withColumn("__rank", rank).filter(F.col("__rank") <= shown)
    return some.groupBy(key).agg(F.array_sort(F.collect_list(value)).alias(name))


def purpose_tests(names: Column, flags: Column) -> list[tuple[str, Column]]:
    """For each purpose an aggregate of all names and flags of a group that tells whether it is hinted at."""
    out = []
    for label, parts, marks in PURPOSES:
        hit = F.coalesce(F.bool_or(F.lower(names).rlike("|".join(parts))), F.lit(False))
        out.append((label, hit | F.coalesce(F.bool_or(has_any(flags, marks)), F.lit(False)) if marks else hit))
    return out


def summaries(members: DataFrame, nodes: DataFrame, shown: int = 5) -> DataFrame:
    """(community, members, summary): size, the first named functions, flags and likely purpose in words.

    Of names only the first ones are gathered, all others counted; flags are a small set.
    """
    full = members.join(nodes.select("id", "name", "flags"), "id")
    full = full.withColumn("named", F.when(F.col("name").isNotNull() & ~is_generic(F.col("name")), F.col("name")))
    tests = purpose_tests(F.col("named"), F.col("flags"))
    parts = full.groupBy("community").agg(
        F.count("*").alias("members"),
        F.count_distinct("named").alias("n_names"),
        F.sum((F.size("flags") > 0).cast("long")).alias("flagged"),
        *[hit.alias(f"purpose{k}") for k, (_, hit) in enumerate(tests)],
    )
    parts = parts.join(flag_sets(full, "community"), "community", "left").withColumn("flags", F.coalesce("flags", F.array().cast("array<string>")))
    parts = parts.join(_first(full.filter("named is not null"), "community", "named", shown, "names"), "community", "left")
    number = lambda c: F.col(c).cast("string")
    n_flags, n_names = F.size("flags"), F.col("n_names")
    names = F.concat(F.lit("Key functions: "), F.array_join("names", ", "), F.when(n_names > shown, F.concat(F.lit(" (+"), (n_names - shown).cast("string"), F.lit(" more)"))).otherwise(""), F.lit(". "))
    flags = F.concat(F.lit("Security-relevant: "), number("flagged"), F.lit(" functions with flags ["), F.array_join(F.slice("flags", 1, shown), ", "), F.when(n_flags > shown, F.concat(F.lit(", +"), (n_flags - shown).cast("string"), F.lit(" more"))).otherwise(""), F.lit("]. "))
    likely = F.coalesce(*[F.when(F.col(f"purpose{k}"), label) for k, (label, _) in enumerate(tests)])
    text = F.concat(F.lit("Community of "), number("members"), F.lit(" functions. "), F.when(n_names > 0, names).otherwise(""), F.when(n_flags > 0, flags).otherwise(""), F.coalesce(F.concat(F.lit("Likely purpose: "), likely, F.lit(".")), F.lit("")))
    return parts.select("community", "members", text.alias("summary"))


def key_functions(members: DataFrame, nodes: DataFrame, shown: int = 5) -> DataFrame:
    """(community, id, name, place): the first flagged members of each community by id."""
    rank = F.row_number().over(Window.partitionBy("community").orderBy("id"))
    full = members.join(nodes.filter(F.size("flags") > 0).select("id", display_name(F.col("name"), F.col("address")).alias("name")), "id")
    return full.withColumn("place", rank).filter(F.col("place") <= shown).select("community", "id", "name", "place")


def insights(members: DataFrame, nodes: DataFrame, named: int = 10) -> DataFrame:
    """(community, id, key_function): all flagged members with their addresses, and named ones among the first `named` of both.

    Members go by id. What is named and not flagged counts while there are fewer than `named`; only so many are ranked.
    """
    full = members.join(nodes.select("id", "name", "address", "flags"), "id").withColumn("shown", display_name(F.col("name"), F.col("address")))
    flagged = F.size("flags") > 0
    some = full.filter(flagged | ~is_generic(F.col("shown")))
    rank = F.row_number().over(Window.partitionBy("community").orderBy("id"))
    first = some.withColumn("__rank", rank).filter(F.col("__rank") <= named).filter(~flagged)
    at = F.concat("shown", F.lit(" @ 0x"), F.lower(F.hex("address")))
    return full.filter(flagged).select("community", "id", at.alias("key_function")).unionByName(first.select("community", "id", F.col("shown").alias("key_function")))


def findings(found: DataFrame, spread: DataFrame) -> DataFrame:
    """(place, finding): the communities of `records` in words, with the flags of flag_spread, the most frequent first."""
    total = found.agg(F.count("*").alias("n"), F.sum("members").alias("members"), F.max_by(F.struct("title", "score"), F.struct("score", "members", -F.col("community"))).alias("top"))  # one row
    number = lambda c: F.col(c).cast("string")
    some = F.array_compact(F.array(
        F.struct(F.lit(0).alias("place"), F.concat(number("n"), F.lit(" communities detected with "), number("members"), F.lit(" total functions")).alias("finding")),
        F.when(F.col("n") > 0, F.struct(F.lit(1).alias("place"), F.concat(F.lit("Average community size: "), F.floor(F.col("members") / F.col("n")).cast("string"), F.lit(" functions")).alias("finding"))),
        F.when(F.col("top.score") > 0, F.struct(F.lit(1 << 30).alias("place"), F.concat(F.lit("Most security-relevant: "), F.col("top.title"), F.lit(" ("), F.col("top.score").cast("string"), F.lit(" flags)")).alias("finding"))),
    ))
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("n_functions"), "flag")) + 1  # a row for each flag there is
    text = F.concat(number("n_functions"), F.lit(" functions with "), F.col("flag"), F.lit(" across "), number("n_communities"), F.lit(" communities"))
    return total.select(F.inline(some)).unionByName(spread.select(place.alias("place"), text.alias("finding")))


def belonging(members: DataFrame) -> DataFrame:
    """(source_id, target_id, type, score): an edge from each node to its community, with its membership score."""
    return members.select(F.col("id").alias("source_id"), F.col("community").alias("target_id"), F.lit("BELONGS_TO_COMMUNITY").alias("type"), F.lit(1.0).alias("score"))


def titles_of(nodes: DataFrame, members: DataFrame, found: DataFrame) -> DataFrame:
    """(id, community, title) of every node; null where it is in no community."""
    return nodes.select("id").join(members, "id", "left").join(found.select("community", "title"), "community", "left").select("id", "community", "title")


def by_security(found: DataFrame, limit: int = 20) -> DataFrame:
    """The communities of `records` with the highest scores, of equals the largest, with `rank`."""
    order = (F.desc("score"), F.desc("members"), F.col("community"))
    top = found.orderBy(*order).limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)))  # over `limit` rows


def stats(members: DataFrame) -> DataFrame:
    """Communities, members, whole mean size, largest and smallest."""
    sizes = members.groupBy("community").agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("communities"), F.sum("n").alias("members"), F.floor(F.sum("n") / F.count("*")).cast("long").alias("mean_size"), F.max("n").alias("largest"), F.min("n").alias("smallest"))


def flag_spread(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """(flag, n_communities, n_functions): in how many communities and functions each flag occurs."""
    each = members.join(nodes.select("id", F.explode("flags").alias("flag")), "id")
    return each.groupBy("flag", "community").agg(F.count("*").alias("n")).groupBy("flag").agg(F.count("*").alias("n_communities"), F.sum("n").alias("n_functions"))
