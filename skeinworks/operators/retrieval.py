"""Retrieval over documents: chunks, BM25, vectors, hybrid lists, full-text matching.

Queries are a few terms or one vector; documents are scanned once, JVM-side, and only what matches moves on.
A null or empty text has no tokens and no chunks and matches nothing; a null vector scores null and is left out. Repeated rows
count each. Ties in ranked lists go by the further columns given, else any comes first. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from skeinworks.sources.tables import cut, stored

#: BM25's usual parameters, the boost of contents, and limits of a vector search.
K1, B, BOOST = 1.2, 0.75, 2.0
FLOOR, RELATIVE, MOST = 0.50, 0.95, 5
CHUNK = 500
#: Bytes of text whose words are counted together.
HELD_BYTES = 4 << 20


def tokens(text: Column) -> Column:
    """Runs of letters and digits in lower case, repeats included."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def chunks(df: DataFrame, id_col: str, text_col: str, delimiter: str = "\n\n", least: int = CHUNK) -> DataFrame:
    """(id, chunk_id, content): a chunk ends with the first delimiter that begins `least` signs or more after its start.

    A fold over the lengths of the pieces between delimiters gives the ends; the rest is the last chunk. An empty or null
    text has none. Joined, the chunks are the text.
    """
    size = len(delimiter)
    lengths = F.transform(F.split(text_col, delimiter, -1), lambda p: F.length(p))
    zero = F.struct(F.lit(0).alias("start"), F.lit(0).alias("at"), F.array().cast("array<int>").alias("ends"))

    def step(s: Column, n: Column) -> Column:
        end = s["at"] + n
        close = (end - s["start"] >= least) & (end + size <= F.length(text_col))
        return F.struct(F.when(close, end + size).otherwise(s["start"]).alias("start"), (end + size).alias("at"), F.when(close, F.array_append(s["ends"], end + size)).otherwise(s["ends"]).alias("ends"))

    ends = F.aggregate(lengths, zero, step, lambda s: F.when(s["start"] < F.length(text_col), F.array_append(s["ends"], F.length(text_col))).otherwise(s["ends"]))
    cut = df.filter(F.length(text_col) > 0).select(F.col(id_col), F.col(text_col).alias("__text"), ends.alias("__ends"))
    cut = cut.select(id_col, "__text", F.posexplode(F.arrays_zip(F.concat(F.array(F.lit(0)), F.slice("__ends", 1, F.size("__ends") - 1)).alias("a"), F.col("__ends").alias("b"))).alias("chunk_id", "x"))
    return cut.select(id_col, "chunk_id", F.substring("__text", F.col("x.a") + 1, F.col("x.b") - F.col("x.a")).alias("content"))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, tokens with a blank between two) to (id, n, terms)."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            part = batch.slice(at, max(1, int(np.searchsorted(ends, before + HELD_BYTES, "right")) - at))
            at += part.num_rows
            split = pc.split_pattern(part.column(1), " ")
            words, owner = pc.list_flatten(split), pc.list_parent_indices(split)
            some = pc.not_equal(words, "")
            coded, owner = words.filter(some).dictionary_encode(), owner.filter(some).to_numpy().astype(np.int64)
            width = max(1, len(coded.dictionary))
            key, tf = np.unique(owner * width + coded.indices.to_numpy(), return_counts=True)
            terms = pa.StructArray.from_arrays([coded.dictionary.take(pa.array(key % width)), pa.array(tf, pa.int32())], ["term", "tf"])
            offsets = np.r_[0, np.cumsum(np.bincount(key // width, minlength=part.num_rows))]
            n = np.bincount(owner, minlength=part.num_rows)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), terms)], ["id", "n", "terms"])


def counted(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n, terms) of each row: how many tokens it has, and its terms with their counts; counted where the row is."""
    words = F.trim(F.regexp_replace(F.lower(F.coalesce(text_col, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    terms = StructType.fromDDL("n int, terms array<struct<term: string, tf: int>>")
    schema = StructType([StructField("id", df.schema[id_col].dataType), *terms.fields])
    return df.select(F.col(id_col).alias("id"), words.alias("words")).mapInArrow(_counted, schema)


def postings(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(term, id, tf) of all terms: the inverted index. Rows of one id are one document; only such rows are shuffled."""
    each = counted(df, id_col, text_col).select(F.col("id").alias(id_col), F.inline("terms")).select("term", id_col, F.col("tf").cast("long").alias("tf"))
    repeated, n = stored(df.groupBy(id_col).agg(F.count("*").alias("n")).filter("n > 1").select(F.col(id_col).alias("__id")), "repeated")
    if not n:
        return each
    same = F.col(id_col).eqNullSafe(F.col("__id"))
    summed = each.join(repeated, same, "left_semi").groupBy("term", id_col).agg(F.sum("tf").alias("tf"))
    return each.join(repeated, same, "left_anti").unionByName(summed)


def _is(term: str):
    return lambda word: word == term


def bm25(df: DataFrame, id_col: str, text_col: str, query: str, file_col: str | None = None) -> DataFrame:
    """(id, score, saturated) of the rows that match any term of the query.

    idf = ln(1 + (N - df + 0.5) / (df + 0.5)); tf parts without (k1 + 1); contents count BOOST times. A file name matches
    if it equals a term as a whole. saturated = score / (score + 1).
    """
    terms = sorted({t for t in query.lower().split() if t})
    split = df.select(id_col, *([file_col] if file_col else []), tokens(F.col(text_col)).alias("__words"))
    # a few numbers a row, which both the totals and the scores are made of: each text is split once
    counted = cut(split.select(*[c for c in split.columns if c != "__words"], F.size("__words").alias("n"), *[F.size(F.filter("__words", _is(t))).alias(f"tf{k}") for k, t in enumerate(terms)]))
    total = counted.agg(F.count("*").alias("docs"), F.avg("n").alias("mean"), *[F.count_if(F.col(f"tf{k}") > 0).alias(f"df{k}") for k in range(len(terms))])  # one row
    joined = counted.join(F.broadcast(total))
    score = F.lit(0.0)
    for k, t in enumerate(terms):
        tf, df_ = F.col(f"tf{k}"), F.col(f"df{k}")
        idf = F.ln(1 + (F.col("docs") - df_ + 0.5) / (df_ + 0.5))
        score = score + F.when(tf > 0, BOOST * idf * tf / (tf + K1 * (1 - B + B * F.col("n") / F.col("mean")))).otherwise(0.0)
        if file_col:
            score = score + F.when(F.col(file_col) == t, 1.0).otherwise(0.0)
    return joined.select(id_col, score.alias("score")).filter("score > 0").withColumn("saturated", F.col("score") / (F.col("score") + 1))


def top(df: DataFrame, by: str, limit: int, *then: str) -> DataFrame:
    return df.orderBy(F.desc(by), *then).limit(limit)


def best_per_file(df: DataFrame, file_col: str, by: str, *then: str) -> DataFrame:
    """The row of each file that scores best."""
    w = Window.partitionBy(file_col).orderBy(F.desc(by), *then)
    return df.withColumn("__rank", F.row_number().over(w)).filter("__rank = 1").drop("__rank")


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays of equal length; 0 where one has no length."""
    x, y = a.cast("array<double>"), b.cast("array<double>")
    dot = lambda u, v: F.aggregate(F.zip_with(u, v, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    norm = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when(norm > 0, dot(x, y) / norm).otherwise(0.0)


def vector_search(df: DataFrame, vector_col: str, query: DataFrame, k: int = MOST, *then: str) -> DataFrame:
    """The rows most similar to `query` (one row, column `query`, else it fails): FLOOR and RELATIVE times the best at least, min(k, MOST) rows."""
    vector = [r["query"] for r in query.select("query").limit(2).collect()]
    if len(vector) != 1:
        raise ValueError("a vector search takes one query vector")
    scored = df.withColumn("score", cosine(F.col(vector_col), F.lit(vector[0]))).filter(F.col("score") >= FLOOR)
    found = top(scored, "score", min(k, MOST), *then)
    best = F.max("score").over(Window.partitionBy(F.lit(1)))  # over min(k, MOST) rows
    return found.withColumn("__best", best).filter(F.col("score") >= RELATIVE * F.col("__best")).drop("__best")


def hybrid(by_vector: DataFrame, by_words: DataFrame, k: int, *then: str, dedupe: str | None = None) -> DataFrame:
    """Both lists (with `score`) as one, the best k; on request an id counts once, with its best score."""
    both = by_vector.unionByName(by_words)
    if dedupe:
        both = best_per_file(both, dedupe, "score", *then)
    return top(both, "score", k, *then)


def full_text(df: DataFrame, text_col: str, words: list[str]) -> DataFrame:
    """Rows with any of the words, each of which may be a phrase of several tokens."""
    text = F.concat(F.lit(" "), F.array_join(tokens(F.col(text_col)), " "), F.lit(" "))
    test = F.lit(False)
    for w in words:
        phrase = F.concat(F.lit(" "), F.array_join(tokens(F.lit(w)), " "), F.lit(" "))
        test = test | (text.contains(phrase) & (phrase != "  "))
    return df.filter(test)
