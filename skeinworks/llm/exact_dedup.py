"""Exact dedup with an extendible-hash index on shared files.

The hash of a normalised text is its pseudo-key. A directory over the leading key bits is doubled until no bucket
holds more than its capacity of bytes (or its entries all share the deepest prefix). Each owner task gets whole
buckets, hence key ranges: it walks them in key order, chains entries whose 64-bit keys collide, compares their bytes,
and writes the bucket's entries to files in the shared folder. Only the histogram of key prefixes (at most
2**MAX_DEPTH rows) reaches the driver. Equal texts are combined in the map tasks first, so that a text with a third of
all rows reaches its owner once per input partition.

Nulls: a null text counts as empty; a null id sorts after every other id, which may be of any type that sorts. Repeated rows (same id and text) are copies
like any other and exactly one of them stays. Empty input gives an empty result. Other columns are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinworks.llm.common import SPACES, row_hash, shuffle_partitions, written

#: The directory never has more than 2**MAX_DEPTH slots, which bounds what is collected and broadcast.
MAX_DEPTH = 20
#: Bytes of normalised text that a bucket holds before it splits, where the input isn't small.
CAPACITY = 64 << 20
#: Bytes of text that a map task combines before it hands them on.
PAGE_BYTES = 32 << 20

_ENTRY = "key long, norm string, n_rows long, best_chars long, best_id {}, ties long"
_INDEX = "bucket int, chain int, sha string, " + _ENTRY


def grow_directory(histogram: dict[int, int], depth: int, capacity: int) -> list[tuple[int, int, int]]:
    """(slot, bucket, local depth) for each slot of the smallest directory whose buckets hold `capacity` at most.

    histogram: bytes by key prefix of `depth` bits. A bucket of full depth may stay overfull: its pages chain.
    """
    loads = [[0] * (1 << d) for d in range(depth + 1)]
    for prefix, load in histogram.items():
        loads[depth][prefix] += load
    for d in range(depth, 0, -1):
        for prefix, load in enumerate(loads[d]):
            loads[d - 1][prefix >> 1] += load
    buckets, open_ = [], [(0, 0)]
    while open_:
        d, prefix = open_.pop()
        if loads[d][prefix] > capacity and d < depth:
            open_ += [(d + 1, prefix << 1 | 1), (d + 1, prefix << 1)]
        else:
            buckets.append((d, prefix))
    whole = max(d for d, _ in buckets)  # the directory has doubled this many times
    return [
        (slot, bucket, d)
        for bucket, (d, prefix) in enumerate(buckets)
        for slot in range(prefix << (whole - d), (prefix + 1) << (whole - d))
    ]


def _better(a: list, b: list) -> list:
    """Of two [n_rows, best_chars, best_id, ties], their union."""
    best = min(a, b, key=lambda x: (-x[1], x[2] is None, 0 if x[2] is None else x[2]))
    ties = a[3] + b[3] if a[1:3] == b[1:3] else best[3]
    return [a[0] + b[0], best[1], best[2], ties]


def _table(rows: list[tuple], names: str, id_type: pa.DataType) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    fields = [x.split() for x in names.split(", ")]
    columns = list(zip(*rows, strict=True)) or [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(k, id_type)) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal texts of a map task become one entry."""
    seen: dict[str, list] = {}
    keys: dict[str, int] = {}
    held = 0

    def page() -> pa.RecordBatch:
        return _table([(keys[norm], norm, *x) for norm, x in seen.items()], _ENTRY, kind)

    for batch in batches:
        kind = batch.column(3).type
        for key, norm, chars, id_ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            one = [1, chars, id_, 1]
            if norm in seen:
                seen[norm] = _better(seen[norm], one)
            else:
                seen[norm], keys[norm] = one, key
                held += len(norm) + 200
        if held > PAGE_BYTES:
            yield page()
            seen, keys, held = {}, {}, 0
    if seen:
        yield page()


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole buckets in key order: entries of a key are chained by their bytes."""
    key, bucket, chain = None, 0, {}
    out, held = [], 0

    def close() -> None:
        nonlocal held
        for place, (norm, x) in enumerate(chain.items()):
            out.append((bucket, place, hashlib.sha256(norm.encode()).hexdigest(), key, norm, *x))
            held += len(norm)

    for batch in batches:
        kind = batch.schema.field("best_id").type
        for b, k, norm, *x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if k != key and chain:
                close()
                chain = {}
            key, bucket = k, b
            chain[norm] = _better(chain[norm], x) if norm in chain else x
        if held > PAGE_BYTES:
            yield _table(out, _INDEX, kind)
            out, held = [], 0
    if chain:
        close()
    if out:
        yield _table(out, _INDEX, kind)


def build_index(df: DataFrame, id_col: str, text_col: str, capacity: int = CAPACITY) -> tuple[DataFrame, DataFrame]:
    """(rows, index): per input row its hashes; per distinct normalised text its entry, in files in the shared folder."""
    spark = df.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = df.select(
        F.col(id_col).alias("id"),
        F.char_length(text).cast("long").alias("chars"),
        F.regexp_replace(text, SPACES, "").alias("norm"),
    ).withColumn("key", F.xxhash64("norm"))
    rows = written(
        base.select("id", "chars", "key", F.sha2(F.col("norm").cast("binary"), 256).alias("sha"), F.octet_length("norm").cast("long").alias("bytes")),
        "rows",
    )
    total = rows.agg(F.sum(F.col("bytes") + 64)).first()[0] or 0
    parts = shuffle_partitions(spark)
    capacity = max(1 << 12, min(capacity, total // parts))
    depth = min(MAX_DEPTH, max(1, (total // capacity).bit_length() + 3))
    prefix = F.shiftrightunsigned("key", 64 - depth)
    # one row per text that occurs, so that copies weigh once: they are one entry
    sizes = rows.groupBy("key").agg(F.max(F.col("bytes") + 64).alias("bytes")).groupBy(prefix.alias("p")).agg(F.sum("bytes").alias("bytes"))
    directory = grow_directory({p: n for p, n in sizes.collect()}, depth, capacity)
    whole = max(d for *_, d in directory)
    slots = spark.createDataFrame([(s, b) for s, b, _ in directory], "slot long, bucket int")
    kind = df.schema[id_col].dataType.simpleString()
    entries = base.select("key", "norm", "chars", "id").mapInArrow(_combine, _ENTRY.format(kind))
    slot = F.shiftrightunsigned("key", 64 - whole) if whole else F.lit(0).cast("long")
    owned = (
        entries.withColumn("slot", slot)
        .join(F.broadcast(slots), "slot")  # at most 2**MAX_DEPTH rows
        .select("bucket", *[c.split()[0] for c in _ENTRY.split(", ")])
        .repartition(max(1, min(parts, len({b for _, b, _ in directory}))), "bucket")
        .sortWithinPartitions("bucket", "key")
    )
    return rows, written(owned.mapInArrow(_own, _INDEX.format(kind)), "index")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """A row per input row: id, keep_id (the id that stays), group_size, kept, text_sha256 of the normalised text.

    Texts are equal when they are identical without ASCII white space. The row with the most code points in its
    original text stays, of those the one with the smallest id.
    """
    rows, index = build_index(df, id_col, text_col, capacity)
    groups = index.select("key", "sha", "n_rows", "best_chars", "best_id", "ties")
    found = rows.join(groups, ["key", "sha"])
    best = (F.col("chars") == F.col("best_chars")) & F.col("id").eqNullSafe(F.col("best_id"))
    if not groups.filter("ties > 1").isEmpty():  # the same id and text more than once: the first of these rows stays
        found = written(found.withColumn("uid", F.monotonically_increasing_id()), "tied")
        first = found.filter(best & (F.col("ties") > 1)).groupBy("key", "sha").agg(F.min("uid").alias("first_uid"))
        found = found.join(first, ["key", "sha"], "left")
        best = best & ((F.col("ties") == 1) | (F.col("uid") == F.col("first_uid")))
    return found.select(
        F.col("id").alias(id_col),
        F.col("best_id").alias("keep_id"),
        F.col("n_rows").alias("group_size"),
        best.alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """The rows that exact_dedup keeps, with all their columns."""
    rows, index = build_index(df, id_col, text_col, capacity)
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = df.select(
        F.struct(*df.columns).alias("row"),
        row_hash(df).alias("hash"),
        F.sha2(F.regexp_replace(text, SPACES, "").cast("binary"), 256).alias("sha"),
        F.col(id_col).alias("id"),
        F.char_length(text).cast("long").alias("chars"),
    )
    best = index.select(F.col("sha").alias("best_sha"), "best_id", "best_chars", "ties")
    found = base.join(best, (F.col("sha") == F.col("best_sha")) & F.col("id").eqNullSafe(F.col("best_id")) & (F.col("chars") == F.col("best_chars")))
    out = found.filter("ties = 1").select("row")
    if not best.filter("ties > 1").isEmpty():  # of rows that tie the one with the least hash of all columns
        out = out.unionByName(found.filter("ties > 1").groupBy("best_id", "sha").agg(F.min_by("row", "hash").alias("row")).select("row"))
    return out.select("row.*")
