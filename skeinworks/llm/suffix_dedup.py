"""Repeated passages by a depth-limited radix sort of suffixes.

Suffixes are ordered only through the first `threshold` bytes, their window, by passes over digits, most significant first. A group
that is left with one suffix is dropped after each pass; those that are equal through all digits are exactly the windows that
start at more than one place. Bytes that such a window covers are removed.

The first digit is the window's minimizer: its least-hashed K-gram and where in the window it lies. Equal windows have equal
minimizers, and neighbouring windows mostly share one, so a run of windows ("segment") costs one row of one shuffle rather than
one per suffix. Segments with equal bytes are told apart by 128-bit digests: one that occurs twice is repeated whole and needs no
further digit. The remaining digits, eight bytes each, are sorted for one copy of each different segment of a minimizer that has
several. Texts lie in compressed blocks in the shared folder, written once; the sort reads the segments it needs by range, so
texts are never shuffled.

Hot groups: copies within a task's reach are told at once and leave one row. What a bounded sample of texts shows to be hot (at most
HOT rows a list; results don't depend on them) is dealt otherwise: segments known to repeat are marked where they are read;
minimizers with many different segments get longer first digits, by blocks of STEP offsets with the bytes that all windows of the
block share, then by whole windows. A minimizer that still has more than GROUP different segments has its windows dealt one by one
through a shuffle instead of to one task.

Nulls: a null text is empty; a null id is an id. Repeated rows are documents of their own, so a long enough text that occurs twice
is removed from both. Texts shorter than the threshold stay. Long texts are read in pieces. Empty input, empty result.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from skeinworks.llm.common import make_dir, new_path, shuffle_partitions, slices, written
from skeinworks.llm.files import Reader, filesystem

#: Bytes of a repeated string.
THRESHOLD = 200
#: Bytes of a minimizer.
K = 32
#: Raw bytes of a block of the stored texts, and of what a task takes at a time.
BLOCK, CHUNK = 1 << 16, 1 << 20
#: Texts of one unit of dealing lie within so many bytes (a power of two) of a file.
UNIT_BITS = 22
#: Offsets that a longer first digit stands for.
STEP = 16
#: Different segments of a minimizer that one task sorts.
GROUP = 1 << 15
#: Bytes of texts in the sample that finds hot groups, rows of each list of them, and different segments that make one hot.
SAMPLE, HOT, LEAST_HOT = 16 << 20, 2048, 64

_PLACE = "file long, doc long, rel long, n int"
_ASK = f"deal long, key long, d1 long, d2 long, known boolean, {_PLACE}"


@dataclass
class Hot:
    """Segments known to repeat, and keys that are cut once and twice more."""

    known: set[tuple[int, int, int]] = field(default_factory=set)
    blocks: set[int] = field(default_factory=set)
    windows: set[int] = field(default_factory=set)


# Texts in blocks


def store(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    """(rows, folder): per document its id and place (file, doc: first byte, n_bytes); the files hold the texts in blocks."""
    spark = df.sparkSession
    folder = make_dir(spark, new_path(spark, "texts"))
    kind = df.schema[id_col].dataType

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for whole in batches:
            for batch in slices(whole, 1):
                if out is None:
                    out = _Out(folder)
                texts = [t.encode() for t in batch.column(1).to_pylist()]
                starts = [out.add(t) for t in texts]
                n = len(texts)
                columns = [batch.column(0), pa.array([out.file] * n, pa.int64()), pa.array(starts, pa.int64()), pa.array(map(len, texts), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "file", "doc", "n_bytes"])
        if out is not None:
            out.close()

    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return written(rows.mapInArrow(part, f"id {kind.simpleString()}, file long, doc long, n_bytes long"), "places"), folder


class _Out:
    """A file of compressed blocks, followed by their ends, the raw size and the number of blocks."""

    def __init__(self, folder: str) -> None:
        self.file = uuid.uuid4().int >> 65
        store, path = filesystem(folder)
        self.out = store.open_output_stream(f"{path}/{self.file:016x}", compression=None)
        self.raw, self.held, self.ends, self.at = 0, bytearray(), [0], 0
        self.packer = zstandard.ZstdCompressor(3)

    def add(self, text: bytes) -> int:
        start = self.raw
        self.raw += len(text)
        self.held += text
        while len(self.held) >= BLOCK:
            self._block(bytes(self.held[:BLOCK]))
            del self.held[:BLOCK]
        return start

    def _block(self, raw: bytes) -> None:
        packed = self.packer.compress(raw)
        self.out.write(packed)
        self.at += len(packed)
        self.ends.append(self.at)

    def close(self) -> None:
        if self.held:
            self._block(bytes(self.held))
        self.out.write(np.array([*self.ends, len(self.ends)], np.int64).tobytes())
        self.out.close()


class Texts:
    """Byte ranges of stored texts; a few blocks stay unpacked."""

    def __init__(self, folder: str, blocks: int = 64) -> None:
        self.reader, self.path, self.most = Reader(folder), filesystem(folder)[1], blocks
        self.ends: OrderedDict[int, np.ndarray] = OrderedDict()
        self.blocks: OrderedDict[tuple[int, int], bytes] = OrderedDict()
        self.unpacker = zstandard.ZstdDecompressor()

    def _block(self, file: int, k: int) -> bytes:
        if (file, k) not in self.blocks:
            path = f"{self.path}/{file:016x}"
            if file not in self.ends:
                size = self.reader.size(path)
                n = int.from_bytes(self.reader.read(path, size - 8, 8), "little")
                self.ends[file] = np.frombuffer(self.reader.read(path, size - 8 - 8 * n, 8 * n), np.int64)
                if len(self.ends) > 16:
                    self.ends.popitem(last=False)
            a, b = self.ends[file][k : k + 2].tolist()
            self.blocks[file, k] = self.unpacker.decompress(self.reader.read(path, a, b - a), BLOCK)
            if len(self.blocks) > self.most:
                self.blocks.popitem(last=False)
        return self.blocks[file, k]

    def read(self, file: int, start: int, size: int) -> bytes:
        if not size:
            return b""
        first, last = start // BLOCK, (start + size - 1) // BLOCK
        raw = b"".join(self._block(file, k) for k in range(first, last + 1)) if last > first else self._block(file, first)
        return raw[start - first * BLOCK : start - first * BLOCK + size]


# The first digit


class Minimizers:
    """Segments of a buffer: runs of windows with one minimizer."""

    def __init__(self, threshold: int, most: int = 0) -> None:
        self.size, self.k = threshold, min(K, threshold)
        base = 0x9E3779B97F4A7C15  # odd, so that it has an inverse
        steps = max(most, CHUNK) + threshold + 1
        self.powers, self.inverse = (np.full(steps, x, np.uint64) for x in (base, pow(base, -1, 1 << 64)))
        self.powers[0] = self.inverse[0] = 1
        self.powers, self.inverse = np.cumprod(self.powers, dtype=np.uint64), np.cumprod(self.inverse, dtype=np.uint64)
        #: Places in a buffer take so many bits, the same for all buffers, as they cut what the hashes are compared by.
        self.bits = np.uint64(steps.bit_length())

    def hashes(self, buf: np.ndarray) -> np.ndarray:
        """A 64-bit hash of the K-gram at each place."""
        n = len(buf)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * self.powers[:n], out=sums[1:])
        h = (sums[self.k :] - sums[: -self.k]) * self.inverse[: n - self.k + 1]
        for shift, factor in ((32, 0xD6E8FEB86659FD93), (32, 0xD6E8FEB86659FD93)):
            h ^= h >> np.uint64(shift)
            h *= np.uint64(factor)
        return h ^ (h >> np.uint64(32))

    def segments(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first window, number of windows, minimizer's place, its hash) for texts at [starts, ends) of the buffer."""
        none = np.zeros(0, np.int64)
        if len(buf) < self.size:
            return none, none, none, none
        h = self.hashes(buf)
        width = self.size - self.k + 1
        bits = self.bits
        # least hash, leftmost of equal ones: the place is in the low bits
        v = (h >> bits << bits) | np.arange(len(h), dtype=np.uint64)
        padded = np.full(-(-len(v) // width) * width, np.iinfo(np.uint64).max)
        padded[: len(v)] = v
        rows = padded.reshape(-1, width)
        before = np.minimum.accumulate(rows, axis=1).ravel()
        after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        n = len(v) - width + 1
        place = (np.minimum(after[:n], before[width - 1 : width - 1 + n]) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        inside = np.zeros(n + 1, np.int8)
        has = ends - starts >= self.size
        np.add.at(inside, starts[has], 1)
        np.add.at(inside, ends[has] - self.size + 1, -1)
        at = np.flatnonzero(np.cumsum(inside[:n]))
        if not len(at):
            return none, none, none, none
        new = np.ones(len(at), bool)
        new[1:] = (place[at[1:]] != place[at[:-1]]) | (at[1:] != at[:-1] + 1)
        first = np.flatnonzero(new)
        windows = np.diff(np.append(first, len(at)))
        s = at[first]
        return s, windows, place[s], h[place[s]].view(np.int64)


def _digest(view: memoryview) -> tuple[int, int]:
    d = xxhash.xxh3_128_intdigest(view)
    return (d >> 64) - (1 << 63), (d & ((1 << 64) - 1)) - (1 << 63)


def _pieces(view: memoryview, key: int, s: int, n: int, place: int, size: int, hot: Hot) -> Iterator[tuple[int, int, int]]:
    """(key, first window, windows) of a segment: itself, or its parts where its key is hot."""
    if key not in hot.blocks:
        yield key, s, n
        return
    low, high = place - s - n + 1, place - s  # offsets of the minimizer in its windows
    for b in range(low // STEP, high // STEP + 1):
        a, z = max(low, b * STEP), min(high, b * STEP + STEP - 1)
        shared = view[place - b * STEP : place - b * STEP - STEP + 1 + size]  # in every window of the block
        part = xxhash.xxh3_64_intdigest(shared, b + 1) - (1 << 63)
        if part not in hot.windows:
            yield part, place - z, z - a + 1
        else:
            for w in range(place - z, place - a + 1):
                yield xxhash.xxh3_64_intdigest(view[w : w + size], 0) - (1 << 63), w, 1


def _chunks(places: Iterator[pa.RecordBatch], texts: Texts, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int, int]]]]:
    """(buffer, starts, ends, (file, doc, first byte) per piece): documents together up to CHUNK bytes, long ones in pieces."""
    held: list[bytes] = []
    of: list[tuple[int, int, int]] = []
    total = 0

    def chunk():
        sizes = np.array(list(map(len, held)), np.int64)
        ends = np.cumsum(sizes)
        return np.frombuffer(b"".join(held), np.uint8), ends - sizes, ends, list(of)

    for batch in places:
        for file, doc, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            at = 0
            while n - at >= size:
                take = min(n - at, CHUNK)
                if held and total + take > CHUNK:
                    yield chunk()
                    held, of, total = [], [], 0
                held.append(texts.read(file, doc + at, take))
                of.append((file, doc, at))
                total += take
                if at + take >= n:
                    break
                at += take - size + 1  # the next piece begins with the next window
    if held:
        yield chunk()


def _ask(folder: str, size: int, hot: Hot, combine: bool):
    """Places to rows that ask whether a segment is repeated (key), and rows of windows known to be (no key)."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minimizers, texts, shown = Minimizers(size), Texts(folder), set()
        hot_keys = np.array(sorted({k for k, _, _ in hot.known} | hot.blocks), np.int64)
        for buf, starts, ends, of in _chunks(batches, texts, size):
            s, n, place, key = minimizers.segments(buf, starts, ends)
            view = memoryview(buf)
            rows: list[tuple[int, int, int, int, int]] = []  # key, d1, d2, first window, windows
            known: list[bool] = []
            told: list[tuple[int, int]] = []
            is_hot = np.isin(key, hot_keys).tolist() if len(hot_keys) else [False] * len(s)
            first: dict[tuple[int, int, int], int] = {}
            for k, a, m, p, warm in zip(key.tolist(), s.tolist(), n.tolist(), place.tolist(), is_hot, strict=True):
                parts, is_known = [(k, a, m)], False
                if warm:
                    whole = (k, *_digest(view[a : a + m + size - 1]))
                    if is_known := whole in hot.known:
                        told.append((a, m))
                        if whole in shown or not combine:
                            continue
                        shown.add(whole)  # one copy of it asks, for the sake of others under its keys
                    parts = _pieces(view, k, a, m, p, size, hot)
                for k2, a2, m2 in parts:
                    row = (k2, *_digest(view[a2 : a2 + m2 + size - 1]))
                    if combine:
                        if row in first:  # a second place: both are repeated, one row asks for all
                            known[first[row]] = True
                            told.append((a2, m2))
                            continue
                        if warm and not is_known and row in hot.known:
                            told.append((a2, m2))
                            if row in shown:
                                continue
                            shown.add(row)
                        first[row] = len(rows)
                    rows.append((*row, a2, m2))
                    known.append(is_known or warm and row in hot.known)
            yield from _rows(rows, known, _joined(told) if combine else [], starts, of)

    return part


def _joined(told: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of windows, those that touch as one."""
    out: list[list[int]] = []
    for a, n in sorted(told):
        if out and a <= out[-1][0] + out[-1][1]:
            out[-1][1] = max(out[-1][1], a + n - out[-1][0])
        else:
            out.append([a, n])
    return [(a, n) for a, n in out]


def _rows(rows: list, known: list[bool], told: list[tuple[int, int]], starts: np.ndarray, of: list) -> Iterator[pa.RecordBatch]:
    asked = np.array(rows, np.int64).reshape(-1, 5)
    runs = np.array(told, np.int64).reshape(-1, 2)
    at, n = np.concatenate((asked[:, 3], runs[:, 0])), np.concatenate((asked[:, 4], runs[:, 1]))
    if not len(at):
        return
    piece = np.searchsorted(starts, at, "right") - 1
    where = np.array(of, np.int64)[piece]
    rel = at - starts[piece] + where[:, 2]
    absent = np.arange(len(at)) >= len(asked)
    fill = np.zeros((len(runs), 3), np.int64)
    key, d1, d2 = np.concatenate((asked[:, :3], fill)).T
    spread = np.array([xxhash.xxh3_64_intdigest(x.tobytes()) - (1 << 63) for x in np.stack((where[:, 0], where[:, 1], rel), 1)[len(asked) :]], np.int64)
    columns = [
        pa.array(np.concatenate((asked[:, 0], spread))),
        *(pa.array(c, mask=absent) for c in (key, d1, d2)),
        pa.array([*known, *[True] * len(runs)]),
        *(pa.array(c) for c in (where[:, 0], where[:, 1], rel)),
        pa.array(n.astype(np.int32)),
    ]
    batch = pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _ASK.split(", ")])
    for k in range(0, batch.num_rows, 16_384):
        yield batch.slice(k, 16_384)


def find_hot(places: DataFrame, folder: str, size: int, total: int) -> Hot:
    """What a sample of at most about SAMPLE bytes shows: it changes how rows are dealt, never the result."""
    hot = Hot()
    some = places.filter(F.pmod(F.xxhash64("file", "doc"), F.lit(-(-total // SAMPLE))) == 0) if total > SAMPLE else places
    for level in ("blocks", "windows", None):
        rows = some.mapInArrow(_ask(folder, size, hot, False), _ASK).groupBy("key", "d1", "d2").agg(F.count("*").alias("n"))
        rows = written(rows, "sample")
        least = max(2, -(-(rows.agg(F.sum("n")).first()[0] or 0) // HOT))
        # at most HOT rows have so large a share, and at most HOT keys so many rows
        found = {tuple(r) for r in rows.filter(F.col("n") >= max(least, 8)).select("key", "d1", "d2").collect()}
        keys = {r[0] for r in rows.filter(F.col("n") < max(least, 8)).groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") >= max(least, LEAST_HOT)).collect()} if level else set()
        hot.known |= found
        if not keys:
            break
        getattr(hot, level).update(keys)
    return hot


# The remaining digits


def _fetch(folder: str, size: int):
    """Places of segments to their bytes."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = Texts(folder)
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                file, doc, rel, n = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("file", "doc", "rel", "n"))
                raw = [texts.read(f, d + r, m + size - 1) for f, d, r, m in zip(file, doc, rel, n, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(raw, pa.binary())], names=[*batch.schema.names, "raw"])

    return part


def radix_groups(buf: np.ndarray, group: np.ndarray, at: np.ndarray, known: np.ndarray, size: int) -> np.ndarray:
    """Indices of the windows (at, of a group) that are equal to another one of their group.

    Passes over digits of eight bytes, most significant first. Groups of one window, and such in which all are known, go.
    """
    if not len(at):
        return np.zeros(0, np.int64)
    wide = np.concatenate((buf, np.zeros(8, np.uint8)))
    digits = np.zeros(len(buf), np.uint64)
    for k in range(8):
        digits |= wide[k : k + len(buf)].astype(np.uint64) << np.uint64(56 - 8 * k)
    index = np.argsort(group, kind="stable")
    group = group[index]
    for depth in range(0, size, 8):
        digit = digits[at[index] + depth]
        if depth + 8 > size:
            digit = digit >> np.uint64(8 * (depth + 8 - size))
        same = group[1:] == group[:-1]
        unlike = same & (digit[1:] != digit[:-1])
        if unlike.any():
            bounds = np.flatnonzero(np.concatenate(([True], ~same)))
            label = np.cumsum(np.concatenate(([True], ~same))) - 1
            mixed = np.add.reduceat(np.concatenate((unlike, [False])), bounds) > 0
            rows = np.flatnonzero(mixed[label])  # only groups that this digit splits are sorted
            order = rows[np.lexsort((digit[rows], label[rows]))]
            index[rows], digit[rows] = index[order], digit[order]
            new = np.concatenate(([True], ~same | (digit[1:] != digit[:-1])))
        else:
            new = np.concatenate(([True], ~same))
        bounds = np.flatnonzero(new)
        sizes = np.diff(np.append(bounds, len(index)))
        unknown = np.add.reduceat((~known[index]).astype(np.int64), bounds)
        keep = np.repeat((sizes > 1) & (unknown > 0), sizes)
        group = np.repeat(np.arange(len(bounds)), sizes)[keep]
        index = index[keep]
        if not len(index):
            break
    return index


def _sort(size: int):
    """Segments in the order of their keys to runs of repeated windows of those that aren't known."""

    def solve(rows: list[tuple]) -> pa.RecordBatch | None:
        raw = [r[-1] for r in rows]
        buf = np.frombuffer(b"".join(raw), np.uint8)
        starts = np.cumsum([0, *map(len, raw[:-1])])
        n = np.array([r[5] for r in rows], np.int64)
        of = np.repeat(np.arange(len(rows)), n)
        inner = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        key = np.array([r[0] for r in rows], np.int64)
        known = np.array([r[1] for r in rows], bool)
        hit = radix_groups(buf, np.unique(key, return_inverse=True)[1][of], starts[of] + inner, known[of], size)
        hit = np.sort(hit[~known[of[hit]]])
        if not len(hit):
            return None
        new = np.ones(len(hit), bool)
        new[1:] = (hit[1:] != hit[:-1] + 1) | (of[hit[1:]] != of[hit[:-1]])
        first = np.flatnonzero(new)
        runs = np.diff(np.append(first, len(hit)))
        places = np.array([r[2:5] for r in rows], np.int64)[of[hit[first]]]
        columns = [places[:, 0], places[:, 1], places[:, 2] + inner[hit[first]], runs.astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["file", "doc", "rel", "n"])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        windows = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if windows > CHUNK and row[0] != held[-1][0]:
                    if (out := solve(held)) is not None:
                        yield out
                    held, windows = [], 0
                held.append(row)
                windows += row[5]
        if held and (out := solve(held)) is not None:
            yield out

    return part


def _windows(size: int):
    """Segments to their windows, one by one, each with the digest of all its digits."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, known, file, doc, rel, n, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                view = memoryview(raw)
                d = np.array([_digest(view[k : k + size]) for k in range(n)], np.int64)
                columns = [pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array([known] * n), *(pa.array([x] * n, pa.int64()) for x in (file, doc)), pa.array(rel + np.arange(n))]
                yield pa.RecordBatch.from_arrays(columns, names=["d1", "d2", "known", "file", "doc", "rel"])

    return part


def _unit() -> list[Column]:
    return [F.col("file"), F.shiftright("doc", UNIT_BITS)]


def repeated_windows(places: DataFrame, folder: str, size: int = THRESHOLD) -> DataFrame:
    """Runs of repeated windows: file, doc, rel (first window, from the document's start), n. A window may be in several runs."""
    spark = places.sparkSession
    total = places.agg(F.sum("n_bytes")).first()[0] or 0
    tasks = max(shuffle_partitions(spark), total // (4 * CHUNK))
    dealt = places.filter(F.col("n_bytes") >= size).repartition(tasks, *_unit()).sortWithinPartitions("file", "doc").select("file", "doc", "n_bytes")
    hot = find_hot(dealt, folder, size, total)
    asked = dealt.mapInArrow(_ask(folder, size, hot, True), _ASK).repartition("deal")
    same, key = Window.partitionBy("deal", "key", "d1", "d2"), Window.partitionBy("deal", "key")
    first = F.row_number().over(same.orderBy(F.desc("known"), "file", "doc", "rel")) == 1
    judged = (
        asked.withColumn("copies", F.sum(F.when(F.col("known"), 2).otherwise(1)).over(same))
        .withColumn("first", first)
        .withColumn("kinds", F.sum(F.col("first").cast("long")).over(key))
        .withColumn("repeated", F.col("copies") > 1)
        .withColumn("sort", F.col("first") & (F.col("kinds") > 1) & F.col("key").isNotNull())
        .filter("repeated or sort")
        .select("file", "doc", "rel", "n", "repeated", "sort", *[F.when(F.col("sort"), F.col(c)).alias(c) for c in ("key", "kinds")])
    )
    judged = written(judged, "judged")
    whole = judged.filter("repeated").select("file", "doc", "rel", "n")
    unsorted = judged.filter("sort").select("key", F.col("repeated").alias("known"), "file", "doc", "rel", "n", "kinds")
    fetched = unsorted.repartition(tasks, *_unit()).sortWithinPartitions("file", "doc", "rel")
    with_raw = f"key long, known boolean, {_PLACE}, raw binary"
    few = fetched.filter(F.col("kinds") <= GROUP).drop("kinds").mapInArrow(_fetch(folder, size), with_raw)
    sorted_ = few.repartition("key").sortWithinPartitions("key").mapInArrow(_sort(size), _PLACE)
    out = whole.unionByName(sorted_)
    if not unsorted.filter(F.col("kinds") > GROUP).isEmpty():
        many = fetched.filter(F.col("kinds") > GROUP).drop("kinds").mapInArrow(_fetch(folder, size), with_raw)
        single = written(many.mapInArrow(_windows(size), "d1 long, d2 long, known boolean, file long, doc long, rel long"), "windows")
        twice = single.groupBy("d1", "d2").agg(F.count("*").alias("copies")).filter("copies > 1").select("d1", "d2")
        out = out.unionByName(single.filter("not known").join(twice, ["d1", "d2"]).select("file", "doc", "rel", F.lit(1).cast("int").alias("n")))
    return out


# What is left


def _cut(folder: str, size: int, kind: pa.DataType):
    """Documents, each followed by its runs, to what is left of them."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = Texts(folder)
        out: list[tuple] = []
        held = 0
        doc: tuple | None = None
        runs: list[np.ndarray] = []

        def close() -> None:
            nonlocal held
            if doc is None:
                return
            raw, spans = texts.read(*doc[1:4]), []
            if runs:
                rel, n = np.concatenate(runs, axis=1)
                last = np.maximum.accumulate(rel + n + size - 1)
                new = np.flatnonzero(np.concatenate(([True], rel[1:] > last[:-1])))
                spans = list(zip(rel[new].tolist(), last[np.append(new[1:], len(rel)) - 1].tolist(), strict=True))
                edges = [0, *[x for span in spans for x in span], len(raw)]
                raw = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            out.append((doc[0], doc[3], doc[3] - len(raw), len(spans), [{"start": a, "end": b} for a, b in spans], raw))
            held += len(raw) + 64

        def table() -> pa.RecordBatch:
            nonlocal held
            held = 0
            columns = list(zip(*out, strict=True))
            out.clear()
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (kind, pa.int64(), pa.int64(), pa.int64(), span, pa.binary()), strict=True)], names=["id", "n_bytes", "n_removed", "n_spans", "spans", "kept"])

        for batch in batches:
            file, start, rel, n = (batch.column(k).to_numpy() for k in range(1, 5))
            heads = np.flatnonzero(rel < 0)
            lead = int(heads[0]) if len(heads) else batch.num_rows
            if lead:
                runs.append(np.stack((rel[:lead], n[:lead])))
            for a, b in zip(heads.tolist(), [*heads[1:].tolist(), batch.num_rows], strict=True):
                close()
                if held > CHUNK << 3:
                    yield table()
                doc, runs = (batch.column(0)[a].as_py(), int(file[a]), int(start[a]), int(n[a])), []
                if b > a + 1:
                    runs.append(np.stack((rel[a + 1 : b], n[a + 1 : b])))
        close()
        if out:
            yield table()

    return part


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """Per row: the id, n_bytes, n_removed, n_spans, spans (removed byte ranges, [start, end)) and kept (the remaining bytes)."""
    places, folder = store(df, id_col, text_col)
    runs = repeated_windows(places, folder, threshold)
    kind = df.schema[id_col].dataType
    # a document stands before its runs: rel is -1, n its size
    rows = places.select("id", "file", "doc", F.lit(-1).cast("long").alias("rel"), F.col("n_bytes").alias("n"))
    rows = rows.unionByName(runs.select(F.lit(None).cast(kind).alias("id"), "file", "doc", "rel", F.col("n").cast("long").alias("n")))
    total = places.agg(F.sum("n_bytes")).first()[0] or 0
    tasks = max(shuffle_partitions(df.sparkSession), total // (4 * CHUNK))
    dealt = rows.repartition(tasks, *_unit()).sortWithinPartitions("file", "doc", "rel", "n")
    schema = f"id {kind.simpleString()}, n_bytes long, n_removed long, n_spans long, spans array<struct<start: long, end: long>>, kept binary"
    return dealt.mapInArrow(_cut(folder, threshold, to_arrow_type(kind)), schema).withColumnRenamed("id", id_col)
