"""Mixing sources to target weights by systematic sampling, with DataFrame functions only.

Each source has a target, its share of the words of the mix. A document's expected number of copies is its source's
target by the source's size. The prefix sums of the expected copies run within the source; one random offset per
source is added, and a document is taken once for each integer that its interval crosses. Within a source documents go
by size class, then by stratum, then by size, so that words come close to the target as well as documents do.

The prefix sum of a source with a third of all rows runs in many tasks: rows are counted per (source, size class,
stratum), the counts are summed up over these few groups, and only ranks within a group need a window. Strata are as
many as the square root of an eighth of the rows, so that both the groups and their number stay far below the rows.

Nulls: a null text has size 0; the null source is a source of its own, the last one. A source of size 0 has target 0.
A null id is like any other value. Ties and repeated rows: each row counts for itself. Empty input, empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinworks.llm.common import n_words, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_COPIES = 2
SEED = 42


def _unit(*parts: Column) -> Column:
    """A number from 0 to 1 that depends on the parts alone."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("double") / 4294967296.0


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MAX_COPIES) -> DataFrame:
    """(source, place, source_size, target) of each source of `sized` (source, size).

    Targets are proportional to the weights up to `most` times the source's size; the excess goes to the others by
    weight. Sources in the order of caps by weight: the first of them are capped, as few as leave the others below their
    caps at the level that remains. Capping more leaves a lower level, so the right level is the highest that fits.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.partitionBy(F.lit(1)).orderBy(F.col("source").asc_nulls_last())
    place = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("place"), F.lit(len(weights))) + 1)
    ranked = totals.withColumn("place", place).withColumn("weight", weight).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    by_ratio = Window.partitionBy(F.lit(1)).orderBy(F.col("cap") / F.col("weight"), "place")
    before, every = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(1))
    total = F.lit(share) * F.sum("source_size").over(every)
    left = total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = ranked.withColumn("level", left / weight_left)
    level = level.withColumn("level", F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(every))
    return level.select("source", "place", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MAX_COPIES, seed: int = SEED) -> DataFrame:
    """A row per input row: id, source, size, source_size, target (the source's), copies, taken (words taken)."""
    text = F.col(text_col).cast("string")
    sized = written(df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(text).alias("size")), "sizes")
    n_rows = sized.count()
    strata = max(1, math.ceil(math.sqrt(n_rows / 8)))
    targets = source_targets(sized, weights, share, most)
    named = sized.withColumns({
        "known": F.col("source").isNotNull(),
        "source": F.coalesce("source", F.lit("")),
        "class": F.length(F.bin("size")),
        "stratum": F.pmod(F.conv(F.substring(F.md5(F.coalesce(F.col("id").cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long"), F.lit(strata)),
    })
    group = ["source", "known", "class", "stratum"]
    counts = named.groupBy(*group).agg(F.count("*").alias("n"))
    running = Window.partitionBy("source", "known").orderBy("class", "stratum")
    counts = counts.withColumn("before", F.sum("n").over(running.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    sources = targets.select(F.coalesce("source", F.lit("")).alias("source"), F.col("source").isNotNull().alias("known"), "source_size", "target")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    counts = counts.join(sources, ["source", "known"]).withColumns({"rate": rate, "offset": _unit(F.lit(str(seed)), F.col("known").cast("string"), F.col("source"))})
    rank = F.row_number().over(Window.partitionBy(*group).orderBy("size", "id"))
    placed = named.withColumn("rank", rank).join(counts, group)
    at = lambda k: F.floor(F.col("rate") * k + F.col("offset"))
    place = F.col("before") + F.col("rank")
    copies = (at(place) - at(place - 1)).cast("long")
    return placed.select(
        F.col("id").alias(id_col),
        F.when(F.col("known"), F.col("source")).alias("source"),
        "size",
        "source_size",
        "target",
        copies.alias("copies"),
        (copies * F.col("size")).alias("taken"),
    )


def mixed_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **settings) -> DataFrame:
    """The mix: each row of `df`, with all its columns, as often as it is taken.

    Rows that share an id and a size share out what is taken of them, in turn.
    """
    copies = mix(df.select(id_col, text_col, source_col), id_col, text_col, source_col, **settings)
    taken = copies.groupBy(F.col(id_col).alias("t_id"), F.col("size").alias("t_size"), F.col("source").alias("t_source")).agg(F.count("*").alias("n_rows"), F.sum("copies").alias("n_copies"))
    rows = df.select(F.struct(*df.columns).alias("row"), F.col(id_col).alias("id"), n_words(F.col(text_col).cast("string")).alias("size"), F.col(source_col).alias("source"), F.xxhash64(text_col).alias("hash"))
    match = rows["id"].eqNullSafe(taken["t_id"]) & (rows["size"] == taken["t_size"]) & rows["source"].eqNullSafe(taken["t_source"])
    found = rows.join(taken.filter("n_copies > 0"), match)
    out = found.filter("n_rows = 1").select("row", F.col("n_copies").alias("n"))
    if not taken.filter("n_rows > 1").isEmpty():
        turn = F.row_number().over(Window.partitionBy("id", "size", "source").orderBy("hash"))
        share = F.floor(F.col("n_copies") * turn / F.col("n_rows")) - F.floor(F.col("n_copies") * (turn - 1) / F.col("n_rows"))
        out = out.unionByName(found.filter("n_rows > 1").select("row", share.alias("n")))
    return out.select("row", F.explode(F.array_repeat(F.lit(0), F.col("n").cast("int")))).select("row.*")
