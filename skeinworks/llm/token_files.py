"""Token ids in files of fixed-width packed bits.

An id takes the least number of bits that the vocabulary needs. Ids are packed in blocks of BLOCK ids, each starting at
a byte; the footer has the offset of every block and, per document, its id and its first position, so that any run of
ids is unpacked by numpy from the blocks it lies in. Layout of a file, numbers little-endian:

    "SKTOK1\\0\\0"  blocks...  doc ids i64[n_docs]  null flags u8[n_docs]  first positions u64[n_docs + 1]
    block offsets u64[n_blocks + 1]  n_docs u64  n_ids u64  block u32  width u32  "SKTOK1\\0\\0"

Documents are dealt out by ranges of their ids and sorted, so the files, by number, hold them in ascending order. Nulls:
a null text is empty and gets the end id alone; a null id comes first. Equal ids are ordered by their texts. Empty
input: no files.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skeinworks.llm.common import make_dir, new_path, shuffle_partitions, slices, whole_number_id, written
from skeinworks.llm.files import Reader, filesystem, new_name
from skeinworks.llm.pretokens import pieces

MAGIC = b"SKTOK1\0\0"
BLOCK = 1 << 13
TAIL = struct.Struct("<QQII8s")
KEPT_PIECES = 500_000
LONGEST_KEPT = 64
JOINED = 2000


def width_of(n_ids: int) -> int:
    """Bits that ids below n_ids need."""
    return max(1, (n_ids - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    if width in (8, 16, 32):
        return ids.astype(f">u{width // 8}").tobytes()
    bits = np.unpackbits(ids.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)[:, 32 - width :]
    return np.packbits(bits).tobytes()


def unpack(data: bytes, n: int, width: int) -> np.ndarray:
    if width in (8, 16, 32):
        return np.frombuffer(data, f">u{width // 8}", n).astype(np.uint32)
    bits = np.zeros((n, 32), np.uint8)
    bits[:, 32 - width :] = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width).reshape(n, width)
    return np.packbits(bits, axis=1).view(">u4")[:, 0].astype(np.uint32)


class Writer:
    def __init__(self, folder: str, part: int, width: int) -> None:
        self.fs, at = filesystem(folder)
        self.path, self.width = new_name(at, part, ".sktok"), width
        self.out = self.fs.open_output_stream(self.path)
        self.out.write(MAGIC)
        self.at, self.n = len(MAGIC), 0
        self.docs, self.nulls, self.firsts, self.blocks = array("q"), bytearray(), array("Q"), array("Q")
        self.rest = np.empty(0, np.uint32)

    def add(self, docs: list[int | None], ids: list[np.ndarray]) -> None:
        for doc, x in zip(docs, ids, strict=True):
            self.docs.append(doc or 0)
            self.nulls.append(doc is None)
            self.firsts.append(self.n)
            self.n += len(x)
        self.rest = np.concatenate([self.rest, *ids])
        whole = len(self.rest) // BLOCK * BLOCK
        for k in range(0, whole, BLOCK):
            self._block(self.rest[k : k + BLOCK])
        self.rest = self.rest[whole:]

    def _block(self, ids: np.ndarray) -> None:
        self.blocks.append(self.at)
        data = pack(ids, self.width)
        self.out.write(data)
        self.at += len(data)

    def close(self) -> tuple[str, int, int]:
        if len(self.rest):
            self._block(self.rest)
        self.blocks.append(self.at)
        self.out.write(np.array(self.docs, "<i8").tobytes() + bytes(self.nulls))
        self.firsts.append(self.n)
        self.out.write(np.array(self.firsts, "<u8").tobytes() + np.array(self.blocks, "<u8").tobytes())
        self.out.write(TAIL.pack(len(self.docs), self.n, BLOCK, self.width, MAGIC))
        self.out.close()
        return self.path, len(self.docs), self.n


class TokenFile:
    """Random access to one file."""

    def __init__(self, reader: Reader, path: str) -> None:
        self.reader, self.path = reader, path
        size = reader.size(path)
        n_docs, self.n_ids, self.block, self.width, magic = TAIL.unpack(reader.read(path, size - TAIL.size, TAIL.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is no token file")
        n_blocks = -(-self.n_ids // self.block)
        sizes = [8 * n_docs, n_docs, 8 * (n_docs + 1), 8 * (n_blocks + 1)]
        data = reader.read(path, size - TAIL.size - sum(sizes), sum(sizes))
        cut = np.cumsum([0, *sizes]).tolist()
        part = [data[a:b] for a, b in zip(cut, cut[1:], strict=False)]
        self.docs, self.nulls = np.frombuffer(part[0], "<i8"), np.frombuffer(part[1], bool)
        self.firsts, self.blocks = np.frombuffer(part[2], "<u8").astype(np.int64), np.frombuffer(part[3], "<u8").astype(np.int64)

    def ids(self, first: int, n: int) -> np.ndarray:
        """The n ids from a position on: reads and unpacks the blocks they lie in."""
        if n <= 0:
            return np.empty(0, np.uint32)
        a, b = first // self.block, -(-(first + n) // self.block)
        data = self.reader.read(self.path, int(self.blocks[a]), int(self.blocks[b] - self.blocks[a]))
        parts = []
        for k in range(a, b):
            size = min(self.block, self.n_ids - k * self.block)
            parts.append(unpack(data[self.blocks[k] - self.blocks[a] : self.blocks[k + 1] - self.blocks[a]], size, self.width))
        return np.concatenate(parts)[first - a * self.block :][:n]

    def document(self, place: int) -> np.ndarray:
        return self.ids(int(self.firsts[place]), int(self.firsts[place + 1] - self.firsts[place]))


class Encoder:
    """The tokenizers library's ids, asked for once per piece; pieces met lately are kept, in two generations."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.n_ids = self.library.get_vocab_size(with_added_tokens=True)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _ask(self, new: list[str]) -> dict[str, bytes]:
        """The library's ids of pieces. Words with a blank before them go as one text, which falls into the same pieces."""
        found, words = {}, [p for p in new if p[0] == " " and p[1:].isalpha()]
        for at in range(0, len(words), JOINED):
            part = words[at : at + JOINED]
            e = self.library.encode("".join(part), add_special_tokens=False)
            ids, owner = np.array(e.ids, "<u4"), np.array(e.word_ids, np.int64)
            ends = np.searchsorted(owner, np.arange(len(part)), "right")
            if len(owner) and owner[-1] == len(part) - 1:
                data = ids.tobytes()
                cuts = [0, *(4 * ends).tolist()]
                found.update((p, data[x:y]) for p, x, y in zip(part, cuts, cuts[1:], strict=False))
        rest = [p for p in new if p not in found]
        found.update((p, np.array(e.ids, "<u4").tobytes()) for p, e in zip(rest, self.library.encode_batch_fast(rest, add_special_tokens=False), strict=True))
        return found

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        """The ids of pieces that aren't among the latest; short ones are kept from now on."""
        found = {p: i for p in new if (i := self.older.get(p)) is not None}
        found |= self._ask([p for p in new if p not in found])
        if len(self.known) + len(found) > KEPT_PIECES:
            self.older, self.known = self.known, {}
        self.known.update((p, i) for p, i in found.items() if len(p) <= LONGEST_KEPT)
        return found

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """As encode_batch(texts, add_special_tokens=False); a text with a special token goes to the library whole."""
        whole = {k for k, t in enumerate(texts) if any(s in t for s in self.special)}
        cut = [[] if k in whole else pieces(t) for k, t in enumerate(texts)]
        get = self.known.get
        ids = [list(map(get, c)) for c in cut]
        new = dict.fromkeys(p for c, v in zip(cut, ids, strict=True) if None in v for p, i in zip(c, v, strict=True) if i is None)
        found = self._learn(list(new)) if new else {}
        out = []
        for k, (c, v) in enumerate(zip(cut, ids, strict=True)):
            if k in whole:
                out.append(np.array(self.library.encode(texts[k], add_special_tokens=False).ids, np.uint32))
            else:
                out.append(np.frombuffer(b"".join([found[p] if i is None else i for p, i in zip(c, v, strict=True)] if None in v else v), "<u4"))
        return out


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def write_tokens(df: DataFrame, vocabulary: str, folder: str | None = None, end_id: int | None = 0, id_col: str = "doc_id", text_col: str = "text", files: int | None = None) -> DataFrame:
    """Writes the files; a row per file: shard (ascending with the ids), path, n_docs, n_ids, and start, the ids before it."""
    spark = df.sparkSession
    folder = make_dir(spark, folder or new_path(spark, "tokens"))
    end = np.array([] if end_id is None else [end_id], np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, enc, out = TaskContext.get().partitionId(), encoder(vocabulary), None
        width = width_of(max(enc.n_ids, (end_id or 0) + 1))
        for batch in batches:
            for rows in slices(batch, 1):
                docs, texts = (c.to_pylist() for c in rows.columns)
                out = out or Writer(folder, part, width)
                out.add(docs, [np.concatenate([ids, end]) for ids in enc.encode([t or "" for t in texts])])
        if out:
            path, n_docs, n_ids = out.close()
            uri = f"{folder.rstrip('/')}/{path.rpartition('/')[2]}"
            yield pa.RecordBatch.from_pydict({"shard": pa.array([part], pa.int32()), "path": [uri], "n_docs": [n_docs], "n_ids": [n_ids]})

    rows = df.select(whole_number_id(df, id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    n = files or shuffle_partitions(spark)
    dealt = rows.repartitionByRange(n, F.col("id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("id").asc_nulls_first(), F.xxhash64("text"), "text")
    shards = written(dealt.mapInArrow(run, "shard int, path string, n_docs long, n_ids long"), "shards")
    before = Window.partitionBy(F.lit(1)).orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return shards.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long"))  # a row per file


def read_tokens(shards: DataFrame, with_ids: bool = False) -> DataFrame:
    """(id, start, n_tokens, ids_crc32, ids on request) of each document, read from the files of write_tokens()."""
    schema = "id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                file = TokenFile(Reader(path), filesystem(path)[1])
                step = max(1, 4_000_000 // max(1, file.n_ids // max(1, len(file.docs))))
                for a in range(0, len(file.docs), step):
                    b = min(len(file.docs), a + step)
                    ids, low = file.ids(int(file.firsts[a]), int(file.firsts[b] - file.firsts[a])).astype("<u4"), file.firsts[a]
                    each = [ids[file.firsts[k] - low : file.firsts[k + 1] - low] for k in range(a, b)]
                    columns = [
                        pa.array(file.docs[a:b], pa.int64(), mask=file.nulls[a:b]),
                        pa.array(start + file.firsts[a:b]),
                        pa.array(np.diff(file.firsts[a : b + 1])),
                        pa.array([zlib.crc32(x.tobytes()) for x in each], pa.int64()),
                    ]
                    yield pa.RecordBatch.from_arrays([*columns, *([pa.array([x.view("<i4") for x in each], pa.list_(pa.int32()))] if with_ids else [])], [f.split()[0] for f in schema.split(", ")])

    n = shuffle_partitions(shards.sparkSession)
    return shards.select("path", "start").repartition(n).mapInArrow(run, schema)
