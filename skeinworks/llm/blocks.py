"""Pigeonhole blocks over 64-bit fingerprints: which fingerprints share a block, dealt out in tiles of bounded size.

Fingerprints that differ in r bits at most, cut into r + c blocks, agree on c blocks at least. Each choice of c blocks is
a mask, and all fingerprints that share the masked bits form a bucket. c is the least number for which random fingerprints
fill a bucket with `fill` at most, so that buckets stay small as the input grows (r = 3: 4 masks of 16 bits, then 10 of 25,
20 of 31, 35 of 36). No link is lost for any c. A bucket with more than `tile` rows is dealt out as pairs of its chunks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinworks.llm.common import shuffle_partitions, written
from skeinworks.llm.gray_index import GrayIndex, gray_rank

MOST_CHOSEN = 4
#: Bytes that a task looks at together, if tiles are no larger.
HELD_BYTES = 32 << 20
#: Pairs that are looked at before those that have become connected are left out.
PIECE = 1 << 14


def masks(chosen: int, radius: int) -> list[int]:
    """The masks of all choices of `chosen` among radius + chosen blocks."""
    n = radius + chosen
    cuts = [round(64 * k / n) for k in range(n + 1)]
    blocks = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [sum(x) for x in combinations(blocks, chosen)]


def masks_for(n_rows: int, radius: int, fill: int) -> list[int]:
    """The masks of the least choice whose buckets hold `fill` random fingerprints at most."""
    for chosen in range(1, MOST_CHOSEN):
        found = masks(chosen, radius)
        if n_rows <= fill << min(m.bit_count() for m in found):
            return found
    return masks(MOST_CHOSEN, radius)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def nodes(rows: DataFrame, bit_masks: list[int]) -> DataFrame:
    """`rows` (fp and others) once per mask, with mask (its number) and value (the masked bits)."""
    choices = F.array(*[F.struct(F.lit(k).alias("mask"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("value")) for k, m in enumerate(bit_masks)])
    return rows.select(*rows.columns, F.inline(choices))


def tiles(at: DataFrame, tile: int) -> DataFrame:
    """Rows of nodes() with chunk, mixed (whether two chunks meet) and tile, without value.

    A row comes once, or once for each of a large bucket's chunks. Bucket sizes are counted by a partial aggregate; the
    large ones are few and a table of their own, so that the join takes the plan that their size allows and the rows need
    not be shuffled for it.
    """
    sizes = at.groupBy("mask", "value").count().filter(F.col("count") > tile)
    at = at.join(written(sizes, "buckets"), ["mask", "value"], "left")
    n_chunks = F.when(F.col("count").isNull(), 1).otherwise(F.ceil(F.col("count") / (tile // 2))).cast("int")
    others = [c for c in at.columns if c not in ("value", "count")]
    at = at.withColumn("k", n_chunks).withColumn("chunk", F.pmod(F.xxhash64("fp", "mask", *[c for c in others if c == "key"]), F.col("k")).cast("int"))
    at = at.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    key = F.xxhash64("mask", "value", F.least("chunk", "other"), F.greatest("chunk", "other"))
    return at.select(*others, "chunk", (F.col("chunk") != F.col("other")).alias("mixed"), key.alias("tile"))


def near_pairs(fp: np.ndarray, tile: np.ndarray, radius: int, small: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(a, b), a before b, of all rows of one tile within `radius` bits; rows are sorted by tile.

    The pigeonhole again, within tiles: bits on which a tile's rows differ are cut into radius + 1 parts, of which two near
    rows share one. Sorted by tile and part, rows with the same part are held against those that follow them; parts that
    more than `small` rows share go through a Gray index. A pair counts under the first part that it shares.
    """
    if not len(fp):
        return
    first = np.flatnonzero(np.r_[True, tile[1:] != tile[:-1]])
    group = np.repeat(np.arange(len(first), dtype=np.uint64), np.diff(np.r_[first, len(tile)]))
    cuts = [round(64 * k / (2 * radius + 2)) for k in range(2 * radius + 3)]
    # parts of two distant stretches each, as a tile's own mask is mostly one stretch, on which its rows don't differ
    stretch = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:], strict=False)]
    parts = np.array([stretch[k] | stretch[k + radius + 1] for k in range(radius + 1)], np.uint64)
    for k, part in enumerate(parts):
        key = scattered(fp & part) ^ scattered(group + np.uint64(1) << np.uint64(20))
        order = np.argsort(key, kind="stable")
        key = key[order]
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[start, len(key)])
        end, big = np.repeat(start + sizes, sizes), np.repeat(sizes > small, sizes)

        def kept(x: np.ndarray, y: np.ndarray, k: int = k, part: np.uint64 = part) -> tuple[np.ndarray, np.ndarray]:
            apart = fp[x] ^ fp[y]
            keep = (np.bitwise_count(apart) <= radius) & (group[x] == group[y]) & (apart & part == 0)
            for earlier in parts[:k]:
                keep &= (apart & earlier) != 0
            return np.minimum(x[keep], y[keep]), np.maximum(x[keep], y[keep])

        at, shift = np.flatnonzero(~big & (np.arange(len(key)) + 1 < end)), 1
        while len(at):
            yield kept(order[at], order[at + shift])
            shift += 1
            at = at[at + shift < end[at]]
        if big.any():
            some = order[big]
            some = some[np.lexsort((gray_rank(fp[some]), group[some]))]
            _, own = np.unique(group[some], return_inverse=True)
            for x, y in GrayIndex(fp[some], own).pairs(fp[some], own, radius):
                keep = x < y
                yield kept(some[x[keep]], some[y[keep]])


def scattered(x: np.ndarray) -> np.ndarray:
    """Numbers of 64 bits, scattered over these."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def first_shared(fp: np.ndarray, mask: np.ndarray, a: np.ndarray, b: np.ndarray, bit_masks: np.ndarray) -> np.ndarray:
    """Whether the mask under which two rows meet is the first that they share."""
    apart, out = fp[a] ^ fp[b], np.ones(len(a), bool)
    for k in range(len(bit_masks) - 1):
        out &= (mask[a] <= k) | ((apart & bit_masks[k]) != 0)
    return out


def whole_tiles(batches: Iterator[pa.RecordBatch], held: int = 1 << 17) -> Iterator[pa.Table]:
    """Tables of whole tiles from batches sorted by their column tile."""
    kept, n, size = [], 0, 0
    for batch in batches:
        kept.append(batch)
        n += batch.num_rows
        size += batch.nbytes
        if n >= held or size >= HELD_BYTES:
            table = pa.Table.from_batches(kept)
            t = table.column("tile").to_numpy()
            other = np.flatnonzero(t != t[-1])
            if len(other):
                cut = int(other[-1]) + 1
                yield table.slice(0, cut)
                kept, n = table.slice(cut).to_batches(), len(t) - cut
                size = sum(x.nbytes for x in kept)
    if n:
        yield pa.Table.from_batches(kept)


def dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition(shuffle_partitions(rows.sparkSession), "tile").sortWithinPartitions("tile")


def _partnered(bit_masks: list[int], radius: int):
    """Of the rows (fp, mask, tile), each fingerprint and mask under which it first meets another within `radius` bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_tiles(batches):
            fp, mask, tile = table.column("fp").to_numpy().view(np.uint64), table.column("mask").to_numpy(), table.column("tile").to_numpy()
            has = np.zeros(len(fp), bool)
            for a, b in near_pairs(fp, tile, radius):
                keep = first_shared(fp, mask, a, b, np.array(bit_masks, np.uint64))
                has[a[keep]] = has[b[keep]] = True
            yield pa.RecordBatch.from_arrays([pa.array(fp[has].view(np.int64)), pa.array(mask[has])], ["fp", "mask"])

    return run


def meetings(wholes: DataFrame, parts: DataFrame, radius: int, fill: int, tile: int, least: float) -> tuple[DataFrame, list[int]]:
    """(fp, key, mask, up, by_part, value) of the fingerprints that have a partner, to be dealt out by (mask, value); the masks.

    wholes: (fp, key), partners within `radius` bits. parts: (fp, key, size), partners where all blocks agree; with the same
    `fp` keys are dealt out by size, as one that is more than 1 / least times as large can't be similar.
    """
    distinct = written(wholes.groupBy("fp").agg((F.count("*") > 1).alias("shared")), "fingerprints")
    bit_masks = masks_for(distinct.count(), radius, fill)
    found = dealt(tiles(nodes(distinct.select("fp"), bit_masks), tile).select("fp", "mask", "tile")).mapInArrow(_partnered(bit_masks, radius), "fp long, mask int")
    # keys with the same fingerprint meet under the first mask
    near = found.union(distinct.filter("shared").select("fp", F.lit(0).alias("mask"))).distinct()
    value = F.col("fp").bitwiseAND(F.element_at(F.array(*[F.lit(signed(m)) for m in bit_masks]), F.col("mask") + 1))
    by_whole = wholes.join(near, "fp").select("fp", "key", "mask", F.lit(False).alias("up"), F.lit(False).alias("by_part"), value.alias("value"))
    # a written table, as its size decides whether the fingerprints must be shuffled again
    shared = written(parts.groupBy("fp").count().filter("count > 1").select("fp"), "shared")
    each = parts.join(shared, "fp")
    # similar ones are in the same class of size or in neighbouring ones: a key goes to its own and to the next
    class_ = F.floor(F.log(F.greatest("size", F.lit(1))) / F.lit(-float(np.log(least)))).cast("int")
    cells = each.select("fp", "key", class_.alias("class"), F.explode(F.array(F.lit(0), F.lit(1))).alias("next"))
    cells = cells.select("fp", "key", (F.col("next") == 1).alias("up"), F.xxhash64("fp", F.col("class") + F.col("next")).alias("value"))
    some = cells.groupBy("value").agg(F.count("*").alias("n"), F.bool_and("up").alias("only_up")).filter("n > 1 and not only_up").select("value")
    by_part = cells.join(some, "value").select("fp", "key", F.lit(0).alias("mask"), "up", F.lit(True).alias("by_part"), "value")
    return written(by_whole.union(by_part), "meets"), bit_masks


def pieces_of(pairs: Iterator[tuple[np.ndarray, np.ndarray]], size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs, no more than `size` at a time."""
    for a, b in pairs:
        for at in range(0, len(a), size):
            yield a[at : at + size], b[at : at + size]


def _matrix(lists: pa.ChunkedArray) -> np.ndarray:
    """Lists of longs as rows of equal length, filled up with their own last value; a list without any is a row of zeros."""
    rows = [x.values.to_numpy().view(np.uint64) for x in lists]
    width = max(map(len, rows), default=1) or 1
    return np.array([np.pad(r, (0, width - len(r)), "edge") if len(r) else np.zeros(width, np.uint64) for r in rows], np.uint64).reshape(len(rows), width)


def _least_shared(parts: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The least value that rows x and y share, or the greatest there is."""
    out = np.full(len(x), ~np.uint64(0))
    for at in range(0, len(x), 1 << 16):
        a, b = parts[x[at : at + (1 << 16)]], parts[y[at : at + (1 << 16)]]
        least = out[at : at + (1 << 16)]
        for k in range(parts.shape[1]):
            hit = (a == b[:, k : k + 1]).any(axis=1)
            np.minimum(least, b[:, k], out=least, where=hit)
    return out


def linked(meets: DataFrame, payload: str, bit_masks: list[int], radius: int, tile: int, prepare: Callable) -> DataFrame:
    """(a, b): the links between keys that join what is similar within a tile, a forest for each tile.

    meets: rows of meetings() with a column `payload` and `parts`, all fingerprints of the key's parts: two keys are looked at
    under the least part that they share, and under no other. prepare: takes the distinct payloads of some tiles and gives two functions
    of their places, one of two arrays (which pairs may be similar) and one of two numbers (whether these are).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_tiles(batches):
            fp, key, mask, up, chunk, mixed, at = (table.column(k).to_numpy() for k in ("fp", "key", "mask", "up", "chunk", "mixed", "tile"))
            fp, mixed, up = fp.view(np.uint64), mixed.astype(bool), up.astype(bool)
            keys, own, entry = np.unique(key, return_index=True, return_inverse=True)  # a key comes with many rows
            may_be, is_similar = prepare(table.column(payload).take(pa.array(own)))
            parts = _matrix(table.column("parts").take(pa.array(own)))
            by_part = table.column("by_part").to_numpy().astype(bool)
            root = np.arange(len(keys))

            def top(k: int, root: np.ndarray = root) -> int:
                while root[k] != k:
                    k = root[k]
                return k

            out, apart = [], set()
            for a, b in pieces_of(near_pairs(fp, at, radius), PIECE):
                while not np.array_equal(root[root], root):
                    root[:] = root[root]
                # what is connected already need not be looked at: in a group of copies that is all but the first pieces
                keep = (root[entry[a]] != root[entry[b]]) & (~mixed[a] | (chunk[a] != chunk[b])) & ~(up[a] & up[b])
                a, b = a[keep], b[keep]
                keep = first_shared(fp, mask, a, b, np.array(bit_masks, np.uint64))
                a, b = a[keep], b[keep]
                x, y = entry[a], entry[b]
                told = ~(by_part[a] & by_part[b])
                told[~told] = _least_shared(parts, x[~told], y[~told]) == fp[a[~told]]
                x, y = x[told], y[told]
                x, y = np.divmod(np.unique(np.minimum(x, y) * len(keys) + np.maximum(x, y)), len(keys))
                keep = may_be(x, y)
                for x, y in zip(x[keep].tolist(), y[keep].tolist(), strict=True):
                    p, q = top(x), top(y)
                    if p != q and (x, y) not in apart:
                        if is_similar(x, y):
                            root[max(p, q)] = min(p, q)
                            out.append((x, y))
                        else:
                            apart.add((x, y))
            pair = keys[np.array(out, np.int64).reshape(-1, 2)]
            yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["a", "b"])

    full = tiles(meets, tile).select("fp", "key", "mask", "up", "by_part", "chunk", "mixed", "tile", "parts", payload)
    return dealt(full).mapInArrow(run, "a long, b long")
