"""A keyword index in files: built once, searched by term, kept up to date by generations.

    gen=G/postings/part=P   blocks of BLOCK postings at most of one term, by falling weight: ids, counts, document lengths,
                            and the most count and least length in the block, which bound what a posting can score
    gen=G/ranges            first and last term of each part: a search reads the parts of its terms alone
    gen=G/forward           the terms of each document, for the day it changes or goes
    gen=G/terms, totals     document frequencies, number and length of documents, as differences that add up over generations
    gen=G/removed           ids that no earlier generation has any more (tombstones)
    manifest/v=V            the generations that count; written last, so that a change is there whole or not at all

Scores are those of retrieval.bm25 without file names. Parts are ranges of (term, weight), so a term that a third of
all documents has is spread over several.

A null or empty text has no terms but counts as a document. Ids are keys: rows of one id in one change count as documents of
their own and score together, and null ids are one id. Ties in a search go to the least id. An empty table gives an index that
finds nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from skeinworks.operators.retrieval import B, BOOST, K1, counted
from skeinworks.sources.tables import new_folder, stored

#: Postings of a block, blocks that a search looks at to find its threshold, and blocks that it names one by one.
BLOCK, FIRST, NAMED = 128, 64, 4000
#: Postings of a part, about, and how many parts there are at least.
PART, LEAST_PARTS = 1 << 20, 4
#: Ids that may be broadcast.
FEW = 1 << 20


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted postings (term, id, tf, n) to blocks; a block doesn't pass a batch, so that nothing is held."""
    part = TaskContext.get().partitionId()
    block = part << 33
    for batch in batches:
        term = batch.column(0)
        if not len(term):
            continue
        codes = term.dictionary_encode().indices.to_numpy()
        new = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
        begins = np.concatenate([np.arange(a, b, BLOCK) for a, b in zip(new, np.append(new[1:], len(codes)), strict=True)])
        offsets = pa.array(np.append(begins, len(codes)).astype(np.int32))
        tf, n = (batch.column(k).to_numpy() for k in (2, 3))
        lists = [pa.ListArray.from_arrays(offsets, batch.column(k)) for k in (1, 2, 3)]
        bounds = [pa.array(np.maximum.reduceat(tf, begins)), pa.array(np.minimum.reduceat(n, begins))]
        numbers = pa.array(block + np.arange(len(begins)))
        block += len(begins)
        yield pa.RecordBatch.from_arrays([term.take(pa.array(begins)), numbers, *bounds, *lists, pa.array([part] * len(begins), pa.int32())], names=["term", "block", "most_tf", "least_n", "ids", "tfs", "ns", "part"])


class KeywordIndex:
    """An index in a folder; `build` makes a new one."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    @classmethod
    def build(cls, df: DataFrame, id_col: str, text_col: str, folder: str | None = None) -> KeywordIndex:
        index = cls(df.sparkSession, folder or new_folder(df.sparkSession, "keywords"))
        index._generation(0, *index._forward(0, counted(df, id_col, text_col)))
        index._commit([0])
        return index

    # What is stored

    def _read(self, gen: int, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/gen={gen}/{name}").withColumn("gen", F.lit(gen))

    def _all(self, name: str) -> DataFrame:
        found = None
        for gen in self.generations():
            one = self._read(gen, name)
            found = one if found is None else found.unionByName(one)
        return found

    def generations(self) -> list[int]:
        """The generations that count, oldest first."""
        rows = self.spark.read.parquet(f"{self.folder}/manifest").orderBy(F.desc("v")).limit(1).collect()
        return list(rows[0].gens)

    def _commit(self, gens: list[int]) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/manifest")
        there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        last = self.spark.read.parquet(f"{self.folder}/manifest").agg(F.max("v")).first()[0] if there else -1
        self.spark.range(1).select(F.array(*map(F.lit, gens)).cast("array<int>").alias("gens")).write.parquet(f"{self.folder}/manifest/v={last + 1}")

    def _forward(self, gen: int, entries: DataFrame) -> tuple[DataFrame, int]:
        """Writes the forward rows (id, n, terms) of a generation; these, and how many postings they make."""
        seen, path = Observation(), f"{self.folder}/gen={gen}/forward"
        entries.observe(seen, F.sum(F.size("terms")).alias("n")).write.mode("overwrite").parquet(path)
        return self.spark.read.schema(entries.schema).parquet(path), seen.get["n"] or 0

    def _generation(self, gen: int, live: DataFrame, n_postings: int, gone: DataFrame | None = None, removed: DataFrame | None = None) -> None:
        """Writes what belongs to the forward rows `live` of a generation: postings, and differences for these coming and `gone` going."""
        path = f"{self.folder}/gen={gen}"
        kind = live.schema["id"].dataType.simpleString()
        postings = live.select("id", "n", F.inline("terms")).select("term", "id", "tf", "n")
        weight = -F.col("tf") / (F.col("tf") + K1 + F.col("n") / 100)  # any falling order is right, this one keeps bounds tight
        dealt = postings.repartitionByRange(max(LEAST_PARTS, n_postings // PART), F.col("term"), weight).sortWithinPartitions("term", weight, "id")
        schema = f"term string, block long, most_tf int, least_n int, ids array<{kind}>, tfs array<int>, ns array<int>, part int"
        dealt.mapInArrow(_blocks, schema).write.mode("overwrite").partitionBy("part").parquet(f"{path}/postings")
        written = self.spark.read.schema(schema).parquet(f"{path}/postings")
        written.groupBy("part").agg(F.min("term").alias("first"), F.max("term").alias("last")).coalesce(1).write.mode("overwrite").parquet(f"{path}/ranges")
        both = live.withColumn("sign", F.lit(1).cast("long"))
        if gone is not None:
            gone, _ = stored(gone.withColumn("sign", F.lit(-1).cast("long")), "gone")
            both = both.unionByName(gone)
        both.select("sign", F.inline("terms")).groupBy("term").agg(F.sum("sign").alias("df")).filter("df != 0").write.mode("overwrite").parquet(f"{path}/terms")
        both.agg(F.sum("sign").alias("docs"), F.sum(F.col("sign") * F.col("n")).alias("words")).write.mode("overwrite").parquet(f"{path}/totals")
        (removed if removed is not None else live.select("id").filter("false")).write.mode("overwrite").parquet(f"{path}/removed")

    def _live(self, rows: DataFrame) -> DataFrame:
        """Rows (id, gen) without those that a later generation has removed."""
        dead = self._all("removed")
        few = dead.count() <= FEW  # few ids go to where the rows are
        dead = dead.groupBy(F.col("id").alias("dead")).agg(F.max("gen").alias("until"))
        return rows.join(F.broadcast(dead) if few else dead, F.col("id").eqNullSafe(F.col("dead")) & (F.col("gen") < F.col("until")), "left_anti")

    # Upkeep

    def apply(self, changed: DataFrame | None, deleted: DataFrame | None = None, id_col: str = "id", text_col: str = "text") -> None:
        """New and edited documents (id, text), and ids of those that go, as one new generation."""
        gens = self.generations()
        gen = max(gens) + 1
        none = self._read(gens[0], "forward").drop("gen").filter("false")
        live, n_postings = self._forward(gen, counted(changed, id_col, text_col) if changed is not None else none)
        ids = live.select("id")
        if deleted is not None:
            ids = ids.unionByName(deleted.select(F.col(id_col).alias("id")))
        removed, n = stored(ids.distinct(), "removed")
        out = removed.select(F.col("id").alias("out"))
        old = self._all("forward").join(F.broadcast(out) if n <= FEW else out, F.col("id").eqNullSafe(F.col("out")), "left_semi")
        self._generation(gen, live, n_postings, self._live(old).drop("gen"), removed)
        self._commit([*gens, gen])

    def merge(self) -> None:
        """All generations as one: dead postings go, parts are made anew by ranges of terms."""
        gen = max(self.generations()) + 1
        self._generation(gen, *self._forward(gen, self._live(self._all("forward")).drop("gen")))
        self._commit([gen])

    # Search

    def terms(self) -> DataFrame:
        """(term, df)."""
        return self._all("terms").groupBy("term").agg(F.sum("df").alias("df")).filter("df != 0")

    def totals(self) -> tuple[int, int]:
        """Documents, and words in all."""
        row = self._all("totals").agg(F.sum("docs"), F.sum("words")).first()
        return row[0] or 0, row[1] or 0

    def parts(self, gen: int, terms: list[str]) -> list[int]:
        """The parts of a generation that may hold one of the terms."""
        within = F.lit(False)
        for t in terms:
            within = within | F.lit(t).between(F.col("first"), F.col("last"))
        return [r.part for r in self._read(gen, "ranges").filter(within).select("part").collect()]  # parts of a few terms

    def _postings(self, terms: list[str]) -> DataFrame | None:
        found = None
        for gen in self.generations():
            if parts := self.parts(gen, terms):
                one = self._read(gen, "postings").filter(F.col("part").isin(parts) & F.col("term").isin(terms))
                found = one if found is None else found.unionByName(one)
        return found

    def search(self, query: str, k: int, digits: int = 6) -> DataFrame:
        """(id, score, saturated) of the k best by score, rounded to `digits`, then by id: exact.

        The first blocks by bound give k documents' scores so far, hence a threshold that the k-th best reaches. A block whose
        bound, with the best of all other terms, doesn't reach it has no document among the best: it isn't read, and
        what its documents have in other blocks can't lift them over the threshold either.
        """
        terms = sorted({t for t in query.lower().split() if t})
        postings = self._postings(terms) if terms else None
        docs, words = self.totals()
        empty = self._read(self.generations()[0], "forward").select("id", F.lit(0.0).alias("score"), F.lit(0.0).alias("saturated")).filter("false")
        if postings is None or not docs or not words:
            return empty
        df = {r.term: r.df for r in self.terms().filter(F.col("term").isin(terms)).collect()}
        idf = F.create_map(*[F.lit(x) for t, n in df.items() for x in (t, math.log(1 + (docs - n + 0.5) / (n + 0.5)))]) if df else None
        if idf is None:
            return empty
        mean = words / docs
        part = lambda tf, n: BOOST * idf[F.col("term")] * tf / (tf + K1 * (1 - B + B * n / mean))
        heads, _ = stored(postings.select("gen", "term", "block", part(F.col("most_tf"), F.col("least_n")).alias("bound")).filter("bound is not null"), "heads")
        best = {r.term: r.bound for r in heads.groupBy("term").agg(F.max("bound").alias("bound")).collect()}
        first = [(r.gen, r.block) for r in heads.orderBy(F.desc("bound"), "gen", "block").limit(FIRST + k).collect()]
        so_far = self._scores(self._named(postings, first), part).orderBy(F.desc("score")).limit(k).agg(F.count("*").alias("n"), F.min("score").alias("least")).first()
        threshold = so_far.least - 10.0**-digits if so_far.n == k else 0.0
        others = F.create_map(*[F.lit(x) for t in best for x in (t, sum(best.values()) - best[t])])
        kept, n = stored(heads.filter(F.col("bound") + others[F.col("term")] >= threshold).select("gen", "block"), "kept")
        read = self._named(postings, [tuple(r) for r in kept.collect()]) if n <= NAMED else postings.join(kept, ["gen", "block"], "left_semi")
        whole = self._scores(read, part).withColumn("saturated", F.col("score") / (F.col("score") + 1))
        return whole.withColumn("score", F.round("score", digits)).orderBy(F.desc("score"), F.asc_nulls_last("id")).limit(k)

    @staticmethod
    def _named(postings: DataFrame, blocks: list[tuple[int, int]]) -> DataFrame:
        """Blocks by number, which the reader can skip others by."""
        of: dict[int, list[int]] = {}
        for gen, block in blocks:
            of.setdefault(gen, []).append(block)
        wanted = F.lit(False)
        for gen, numbers in of.items():
            wanted = wanted | ((F.col("gen") == gen) & F.col("block").isin(numbers))
        return postings.filter(F.col("block").isin([b for _, b in blocks]) & wanted)

    def _scores(self, postings: DataFrame, part: callable) -> DataFrame:
        each = postings.select("gen", "term", F.inline(F.arrays_zip(F.col("ids").alias("id"), F.col("tfs").alias("tf"), F.col("ns").alias("n"))))
        scored: Column = part(F.col("tf"), F.col("n"))
        return self._live(each.select("gen", "id", "n", scored.alias("part"))).groupBy("id").agg(F.sum("part").alias("score"))
