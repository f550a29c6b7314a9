"""SimHash near-dedup with a Gray-order hierarchical index.

Fingerprints within 3 bits agree on at least one of 4 blocks of 16 bits, or on c of 3 + c blocks. The top nodes of the
index are therefore (mask, value) pairs: a shared masked bit pattern with no difference so far, and the shuffle key, so
nothing is broadcast. Longer patterns are taken as fingerprints grow in number (blocks.masks_for), so that top nodes stay
small and the work follows the input. Below a top node fingerprints are sorted by Gray rank and
indexed by gray_index.GrayIndex, which prunes groups by accumulated differences. A top node with more than TILE
distinct fingerprints is dealt out as pairs of its chunks. A task hands on a spanning forest of the links that it
finds, never all pairs, and components.connected_components joins the forests.

near_duplicates links fingerprints alone. drop_similar is for texts at a given similarity: it verifies what it links,
and adds SimHashes of samples of a text's shingles, as those of whole texts at a Jaccard similarity of 0.8 differ in more
bits than any block search could bear.

Nulls: a null text is empty and gets fingerprint zero, like any text without words. A null id has no place in
component_id: the component takes its least non-null id. Repeated rows share a fingerprint. Empty input, empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinworks.llm.blocks import linked, masks_for, meetings, nodes, scattered, tiles
from skeinworks.llm.common import row_hash, shuffle_partitions, slices, written
from skeinworks.llm.components import connected_components
from skeinworks.llm.gray_index import GrayIndex, forest, gray_rank

RADIUS = 3
#: Random fingerprints that a top node may hold before longer patterns are taken.
FILL = 64
#: Distinct fingerprints of one top node that a task takes as a whole; beyond, two chunks at a time.
TILE = 1024
#: Near copies, as drop_similar takes them: words of a shingle, Jaccard similarity
WORDS = 5
SIMILAR = 0.8
#: Shingles of a sample, and in how many orders samples are taken.
SAMPLED = 3
ORDERS = 8


def fingerprint(text: str | None, shingle_words: int = 3) -> int:
    """The 64-bit SimHash of a text's word shingles (XXH64, seed 42); 0 without words."""
    words = (text or "").encode().lower().split()  # bytes.lower() maps A-Z alone, split() cuts at the six ASCII spaces
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle_words:
        return xxhash.xxh64_intdigest(joined, 42)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(sizes + 1) - sizes - 1
    ends = starts + sizes
    hash_ = xxhash.xxh64_intdigest
    hashes = np.array([hash_(joined[s:e], 42) for s, e in zip(starts[: 1 - shingle_words].tolist(), ends[shingle_words - 1 :].tolist(), strict=True)], np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (counts * 2 > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str, text_col: str, shingle_words: int = 3) -> DataFrame:
    """(id, fp): the fingerprint of each row as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle_words) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, fp long")


def _links(values: np.ndarray, groups: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, its forest's root) for the fingerprints that a link within these tiles joins to another."""
    order = np.lexsort((gray_rank(values), groups))
    values, groups = values[order], groups[order]
    _, groups = np.unique(groups, return_inverse=True)
    labels = np.arange(len(values))
    for q, found in GrayIndex(values, groups).pairs(values, groups, radius):
        keep = q < found
        labels = forest(len(values), q[keep], found[keep], labels)
    moved = np.flatnonzero(labels != np.arange(len(values)))
    return values[moved], values[labels[moved]]


def _search(radius: int, held: int = 1 << 18):
    """Searches the whole tiles of a partition sorted by tile, some at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, fp = [], []
        n = 0

        def flush(whole: bool) -> Iterator[pa.RecordBatch]:
            nonlocal tile, fp, n
            t, f = np.concatenate(tile), np.concatenate(fp)
            cut = len(t) if whole else int(np.flatnonzero(t != t[-1])[-1] + 1) if (t != t[-1]).any() else 0
            if cut:
                a, b = _links(f[:cut].view(np.uint64), t[:cut], radius)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])
            tile, fp = [t[cut:]], [f[cut:]]
            n = len(t) - cut

        for batch in batches:
            tile.append(batch.column(0).to_numpy())
            fp.append(batch.column(1).to_numpy())
            n += batch.num_rows
            if n >= held:
                yield from flush(False)
        if n:
            yield from flush(True)

    return run


def links(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(a, b): a spanning forest, per tile, of all links of at most `radius` bits between distinct fingerprints."""
    parts = shuffle_partitions(distinct.sparkSession)
    dealt = tiles(nodes(distinct, masks_for(distinct.count(), radius, FILL)), tile).select("tile", "fp").repartition(parts, "tile").sortWithinPartitions("tile")
    return dealt.mapInArrow(_search(radius), "a long, b long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle_words: int = 3) -> DataFrame:
    """(id, fingerprint as 16 hex digits, component_id: the smallest id reachable over links of at most `radius` bits)."""
    rows = written(fingerprints(df, id_col, text_col, shingle_words), "fingerprints")
    distinct = rows.groupBy("fp").agg(F.min("id").alias("least")).checkpoint()
    roots = connected_components(links(distinct.select("fp"), radius))
    grouped = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    named = grouped.select("fp", "root").join(least, "root").select("fp", "component_id")
    return rows.join(named, "fp").select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Hashes of a text's shingles in order, repeats included; of fewer words the whole sequence; none without words."""
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in (text or "").encode().lower().split()], np.uint64)
    n = max(len(hashes) - words + 1, min(len(hashes), 1))
    out = np.zeros(n, np.uint64)
    for k in range(min(words, len(hashes))):
        out = scattered(out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n])
    return out


def _majority(hashes: np.ndarray) -> int:
    """The SimHash of some shingles: a bit is set if more than half of them have it."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def samples(distinct: np.ndarray) -> np.ndarray:
    """The SimHashes of SAMPLED shingles each, those of the least hash in one of ORDERS orders."""
    out = set()
    for k in range(ORDERS if len(distinct) else 0):
        order = scattered(distinct ^ np.uint64(0xC4CEB9FE1A85EC53 * (k + 1) % (1 << 64)))
        least = distinct[np.argpartition(order, SAMPLED - 1)[:SAMPLED]] if len(distinct) > SAMPLED else distinct
        if len(least) == 3:
            a, b, c = map(int, least)
            out.add(a & b | b & c | a & c)
        else:
            out.add(_majority(least))
    return np.array(sorted(out), np.uint64)


def _prints(words: int):
    """(key, size, whole, parts) of the texts (key, text): distinct shingles, SimHash of all, SimHashes of samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1)):
            sizes, wholes, parts = [], [], []
            for text in batch.column(1):
                found = shingles(text.as_py(), words)
                distinct = np.unique(found)
                sizes.append(len(distinct))
                wholes.append(_majority(found))
                parts.append(samples(distinct).view(np.int64))
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(np.array(wholes, np.uint64).view(np.int64)), pa.array(parts, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["key", "size", "whole", "parts"])

    return run


def _sets(words: int):
    """(key, found) of the texts (key, text): distinct shingles, ascending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1)):
            found = [np.unique(shingles(t.as_py(), words)).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["key", "found"])

    return run


def _compare(least: float):
    """For blocks.linked: which pairs of sets of shingles may have a Jaccard similarity of `least`, and whether two have."""

    def prepare(sets: pa.ChunkedArray):
        found = [x.values.to_numpy().view(np.uint64) for x in sets]
        sizes = np.fromiter(map(len, found), np.int64, len(found))

        def may_be(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            return np.minimum(sizes[a], sizes[b]) >= least * np.maximum(sizes[a], sizes[b])

        def is_similar(x: int, y: int) -> bool:
            both = np.sort(np.concatenate([found[x], found[y]]))
            shared = int((both[1:] == both[:-1]).sum())
            return shared >= least * (len(both) - shared)

        return may_be, is_similar

    return prepare


def similar_texts(texts: DataFrame, words: int = WORDS, least: float = SIMILAR) -> DataFrame:
    """(node, root) of the keys of `texts` (key long, text; a row per key) that are linked to another.

    Texts link if their sets of shingles have a Jaccard similarity of `least`. Candidates are the texts whose SimHashes lie
    within RADIUS bits, and, as most similar texts don't, those of which two SimHashes of samples agree.
    """
    prints = written(texts.mapInArrow(_prints(words), "key long, size long, whole long, parts array<long>"), "prints")
    wholes, parts = prints.select(F.col("whole").alias("fp"), "key"), prints.select(F.explode("parts").alias("fp"), "key", "size")
    meets, bit_masks = meetings(wholes, parts, RADIUS, FILL, TILE, least)
    some = texts.join(meets.select("key").distinct(), "key", "left_semi").select("key", "text")
    sets = written(some.mapInArrow(_sets(words), "key long, found array<long>"), "sets")
    sets = sets.join(prints.select("key", "parts"), "key")
    return connected_components(linked(meets.join(sets, "key"), "found", bit_masks, RADIUS, TILE, _compare(least)))


def first_of_each(df: DataFrame, id_col: str, text_col: str, roots_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """One row of each group of texts, with all columns. roots_of: from (key, text) to (node, root), a group has one root.

    The row with the smallest id stays (a null id is the largest, ids are of any type that sorts), of these the one with the
    least hashes of text and row; of rows that are the same in all columns one. A null text is empty; texts without a
    word are a group. Repeated ids with different texts are rows like any others. Empty input, empty result.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # a row is known by its id and by 128 bits of its text, of its columns by 64 more
    known = {"__h1": F.xxhash64(text), "__h2": F.xxhash64(F.lit(1), text), "__row": row_hash(df), "__key_id": F.col(id_col)}
    base = df.select(F.struct(*df.columns).alias("__all"), text.alias("text"), *[v.alias(k) for k, v in known.items()])
    rows = written(base.select(F.col("__key_id").alias("id"), "__h1", "__h2", "__row"), "rows")
    distinct = written(rows.groupBy("__h1", "__h2").agg(F.count("*").alias("n")).withColumn("key", F.monotonically_increasing_id()), "texts")
    # of equal texts one is looked at: they are few where exact copies have gone before
    texts = base.select("__h1", "__h2", "text").join(distinct, ["__h1", "__h2"])
    texts = texts.filter("n = 1").select("key", "text").union(texts.filter("n > 1").dropDuplicates(["key"]).select("key", "text"))
    roots = roots_of(texts)
    named = distinct.join(roots.withColumnRenamed("node", "key"), "key", "left").filter("root is not null or n > 1")
    members = written(rows.join(named.select("__h1", "__h2", F.coalesce("root", "key").alias("root")), ["__h1", "__h2"]), "members")
    place = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("__h1").alias("h1"), F.col("__h2").alias("h2"), F.col("__row").alias("row"))
    firsts = members.groupBy("root").agg(F.min(place).alias("first"))
    placed = members.join(firsts, "root").withColumn("stays", place == F.col("first"))
    marks = placed.groupBy("id", "__h1", "__h2", "__row").agg(F.first("stays").alias("stays"), F.count("*").alias("n")).filter("not stays or n > 1")
    marks = written(marks.select(F.col("id").alias("m_id"), F.col("__h1").alias("m_h1"), F.col("__h2").alias("m_h2"), F.col("__row").alias("m_row"), "stays"), "marks")
    same = F.col("__key_id").eqNullSafe(F.col("m_id")) & (F.col("__h1") == F.col("m_h1")) & (F.col("__h2") == F.col("m_h2")) & (F.col("__row") == F.col("m_row"))
    out = base.join(marks, same, "left_anti").select("__all")
    repeated = marks.filter("stays")
    if not repeated.isEmpty():
        out = out.unionByName(base.join(repeated, same, "left_semi").dropDuplicates(["__key_id", "__h1", "__h2", "__row"]).select("__all"))
    return out.select("__all.*")


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle_words: int = 3) -> DataFrame:
    """One row of each component of near_duplicates, as first_of_each has it."""
    components = lambda texts: near_duplicates(texts, "key", "text", radius, shingle_words).select(F.col("key").alias("node"), F.col("component_id").alias("root"))
    return first_of_each(df, id_col, text_col, components)


def drop_similar(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, least: float = SIMILAR) -> DataFrame:
    """One row of each group that similar_texts links, as first_of_each has it."""
    return first_of_each(df, id_col, text_col, lambda texts: similar_texts(texts, words, least))
