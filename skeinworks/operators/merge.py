"""Snapshots in, snapshots out: upserts, policies, conflicts, staleness and flags.

A snapshot has a row for each key; a null key is no other's equal and stays as a row of its own. Null values count as
missing. Of rows that tie in `latest` the order given decides, else any. An empty snapshot leaves the other one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinworks.functions.names import is_default
from skeinworks.functions.texts import squeezed
from skeinworks.sources.tables import stored

#: Pairs that a join deals out together.
DEALT = 1 << 18


def upsert(old: DataFrame, new: DataFrame, key: str, filled: list[str], replaced: list[str]) -> DataFrame:
    """One row per key: `filled` columns keep the old value where the new one is null, `replaced` ones always change."""
    o = old.select(F.col(key), *[F.col(c).alias(f"o_{c}") for c in [*filled, *replaced]], F.lit(True).alias("was"))
    n = new.select(F.col(key), *[F.col(c).alias(f"n_{c}") for c in [*filled, *replaced]], F.lit(True).alias("comes"))
    pick = [F.coalesce(f"n_{c}", f"o_{c}").alias(c) for c in filled] + [F.when(F.col("comes"), F.col(f"n_{c}")).otherwise(F.col(f"o_{c}")).alias(c) for c in replaced]
    change = F.when(F.col("was").isNull(), "insert").when(F.col("comes").isNull(), "keep").otherwise("update")
    return o.join(n, key, "full").select(key, *pick, change.alias("change"))


def insert_or_ignore(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    return old.unionByName(new.join(old.select(*keys), list(keys), "left_anti").select(*old.columns))


def latest(rows: DataFrame, keys: list[str], by: str, *then: str) -> DataFrame:
    """The last row of each key: insert-or-replace over a history."""
    w = Window.partitionBy(*keys).orderBy(F.desc(by), *then)
    return rows.withColumn("__rank", F.row_number().over(w)).filter("__rank = 1").drop("__rank")


def merged(local: DataFrame, remote: DataFrame, key: str, columns: list[str], policy: str) -> DataFrame:
    """`upsert`: remote values where there are any; `prefer_local`: local rows stay; `replace`: remote rows alone."""
    if policy == "replace":
        return remote.select(key, *columns)
    a = local.select(key, *[F.col(c).alias(f"l_{c}") for c in columns], F.lit(True).alias("here"))
    b = remote.select(key, *[F.col(c).alias(f"r_{c}") for c in columns])
    pick = (lambda c: F.when(F.col("here"), F.col(f"l_{c}")).otherwise(F.col(f"r_{c}"))) if policy == "prefer_local" else (lambda c: F.coalesce(f"r_{c}", f"l_{c}"))
    return a.join(b, key, "full").select(key, *[pick(c).alias(c) for c in columns])


def conflicts(local: DataFrame, remote: DataFrame, least_confidence: float) -> DataFrame:
    """(address, local_name, remote_name, status) for remote symbols that count.

    Remote names that a tool made up and symbols below the confidence don't, but comments need no name. NEW where there
    is no local name of a person's, SAME where both agree, else CONFLICT.
    """
    counts = ((F.col("symbol_type") == "comment") | ~is_default(F.col("name"))) & (F.col("confidence") >= least_confidence)
    joined = remote.filter(counts).select("address", F.col("name").alias("remote_name")).join(local.select("address", F.col("name").alias("local_name")), "address", "left")
    status = F.when(is_default(F.col("local_name")), "NEW").when(F.col("local_name").eqNullSafe(F.col("remote_name")), "SAME").otherwise("CONFLICT")
    return joined.select("address", "local_name", "remote_name", status.alias("status"))


def stale_after(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, is_stale, reason) of each new row: new, renamed or changed in more than white space; never what a person edited."""
    o = old.select(F.col(key), F.col("name").alias("o_name"), F.col("content").alias("o_content"), F.col("user_edited"))
    reason = (
        F.when(F.col("user_edited").isNull(), "new")
        .when(F.col("user_edited"), "edited")
        .when(~F.col("o_name").eqNullSafe(F.col("name")), "renamed")
        .when(squeezed(F.col("o_content")) != squeezed(F.col("content")), "changed")
        .otherwise("unchanged")
    )
    out = new.join(o, key, "left").withColumn("reason", reason)
    return out.select(key, F.col("reason").isin("new", "renamed", "changed").alias("is_stale"), "reason")


def with_vulnerability(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """Nodes with what `found` (id, kind, severity, description, evidence) adds: three flags and a note in the summary."""
    new = F.array(F.concat(F.lit("VULN_"), F.col("kind")), F.concat(F.lit("SEVERITY_"), F.col("severity")), F.lit("LLM_DISCOVERED_VULN"))
    note = F.concat(F.lit("[VULNERABILITY] "), F.col("kind"), F.lit(" ("), F.col("severity"), F.lit("): "), F.col("description"), F.coalesce(F.concat(F.lit("\nEvidence: "), F.col("evidence")), F.lit("")))
    has = (F.length("summary") > 0) & (F.col("summary") != "pending")
    joined = nodes.join(found, "id", "left")
    hit = F.col("kind").isNotNull()
    return joined.select(
        *[c for c in nodes.columns if c not in ("flags", "summary")],
        F.when(hit, F.array_union("flags", new)).otherwise(F.col("flags")).alias("flags"),
        F.when(hit, F.when(has, F.concat(F.col("summary"), F.lit("\n\n"), note)).otherwise(note)).otherwise(F.col("summary")).alias("summary"),
    )


def dealt_join(left: DataFrame, right: DataFrame, keys: list[str], by: str, pairs: int = DEALT) -> DataFrame:
    """An inner join on `keys` dealt out by the number of its pairs, so that tasks grow in number with these and not in size.

    A key with more than `pairs` pairs is cut into chunks: its left rows go to one each by the hash of `by`, its right ones to all.
    """
    n = left.groupBy(*keys).agg(F.count("*").alias("__l")).join(right.groupBy(*keys).agg(F.count("*").alias("__r")), keys)
    n = n.select(*keys, (F.col("__l") * F.col("__r")).alias("__pairs"))
    n, _ = stored(n.withColumn("__chunks", F.ceil(F.col("__pairs") / pairs).cast("int")), "pairs")
    parts = (n.agg(F.sum("__pairs")).first()[0] or 0) // pairs + 1
    chunks = n.drop("__pairs")
    a = left.join(chunks, keys).withColumn("__chunk", F.pmod(F.xxhash64(by), F.col("__chunks")).cast("int")).drop("__chunks")
    b = right.join(chunks, keys).withColumn("__chunk", F.explode(F.sequence(F.lit(0), F.col("__chunks") - 1))).drop("__chunks")
    on = [*keys, "__chunk"]
    return a.repartition(parts, *on).join(b.repartition(parts, *on), on).drop("__chunk")


def intervals_containing(refs: DataFrame, at: str, spans: DataFrame, first: str, last: str, narrowest: int = 1) -> DataFrame:
    """Each ref with each span that contains it, both ends included, as an equi-join over whole numbers.

    A span whose ends differ by less than 2**w is dealt to the blocks of 2**w places that its ends lie in, two at most and
    side by side, so that no place of it lies in a third. w is the bit length of the difference, in integers; where the
    difference passes 63 bits, the two blocks are the negative and the other numbers. A ref goes to its block of each w
    that occurs. Blocks are no narrower than `narrowest`, so that short spans have one width. Spans that end before they
    begin and null ends or places join nothing.
    """
    apart = F.try_subtract(F.col(last).cast("long"), F.col(first).cast("long"))
    width = F.coalesce(F.length(F.bin(F.greatest(apart, F.lit(narrowest - 1).cast("long")))), F.lit(63)).cast("int")
    spans = spans.filter(F.col(first) <= F.col(last)).withColumn("__width", F.when(apart.isNull(), 63).otherwise(width))
    widths = [r[0] for r in spans.select("__width").distinct().collect()]  # 63 rows at most
    block = lambda c: F.call_function("shiftright", F.col(c).cast("long"), F.col("__width"))
    dealt = spans.withColumn("__block", F.explode(F.array_distinct(F.array(block(first), block(last)))))
    near = refs.withColumn("__width", F.explode(F.lit(widths).cast("array<int>"))).withColumn("__block", block(at))
    return near.join(dealt, ["__width", "__block"]).filter(F.col(at).between(F.col(first), F.col(last))).drop("__width", "__block")
