"""WARC archives with a two-level capture index.

Writing: every map task writes one archive, a gzip member per record. Records with equal payloads (SHA-1 and length) are
stored once: the one with the largest id is the `response`, the others are `revisit` records that refer to it. The groups
are counted with a partial aggregate and joined back, so a payload shared by a third of all rows is split like any
skewed join.

Index: captures are sorted by (reversed-host URL key, id) over range partitions, so that one host with a third of all
rows spans many of them. Each partition writes one shard: compressed blocks of BLOCK captures, then a sparse directory
with the first capture of every block. The top level has the first capture of each shard, one row per partition. A
lookup binary-searches the shards, the shard's directory and the block, and then reads the record's byte range alone.

Nulls: a null payload is empty; a null URL has the empty key; a null id sorts before every other id and its record
says so. Of repeated rows (same id and payload) exactly one is the response. Payloads below `least` bytes are all
responses. Long payloads are stored whole. Empty input gives no archives and an empty result.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skeinworks.llm.common import make_dir, new_path, shuffle_partitions, whole_number_id, written
from skeinworks.llm.files import Reader, filesystem, new_name

BLOCK = 512
LEVEL = 2
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MAGIC = b"SKCDX1\0\0"
TAIL = "<QQ8s"
_NO_ID = -(1 << 63)

_CAPTURE = "key string, id long, file string, offset long, length long"
_SHARD = "shard int, file string, key string, id long, captures long, blocks long"
_RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def url_key(url: str | None) -> str:
    """The host's labels reversed and joined by commas, then `)` and the rest; the scheme and a user name go."""
    text = (url or "").strip()
    try:
        parts = urlsplit(text)
        host, port = (parts.hostname or "").rstrip("."), parts.port
    except ValueError:
        return quote(text, safe="/?&=:;,.~!*'()@+$#[]%")
    if not host:
        return quote(text, safe="/?&=:;,.~!*'()@+$#[]%")
    rest = parts.path or "/"
    if parts.query:
        rest += f"?{parts.query}"
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + rest
    return quote(key, safe="/?&=:;,.~!*'()@+$#[]%")


def record_id(page_id: int | None, digest: str, place: str = "") -> str:
    """A response that others refer to is named by page and digest; where it stands tells all other records apart."""
    return f"<urn:x-page:{'' if page_id is None else page_id}:{digest}{place and ':' + place}>"


def page_of(urn: str) -> int | None:
    number = urn.removeprefix("<urn:x-page:").partition(":")[0]
    return int(number) if number else None


def record(kind: str, page_id: int | None, url: str, payload: bytes, n_bytes: int, digest: str, refers_to: int | None, place: str) -> bytes:
    """One record; a revisit has the HTTP head alone, whose Content-Length tells the full payload's size."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    block = head + payload if kind == "response" else head
    fields = [("WARC-Type", kind), ("WARC-Record-ID", record_id(page_id, digest, place)), ("WARC-Date", DATE), ("WARC-Target-URI", quote(url, safe=":/?#[]@!$&'()*+,;=%")), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if kind == "revisit":
        fields += [("WARC-Refers-To", record_id(refers_to, digest)), ("WARC-Profile", PROFILE)]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Fields and block of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("no WARC record here")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    return fields, rest[: int(fields["Content-Length"])]


def http_payload(block: bytes) -> tuple[int, bytes]:
    """The size that the HTTP head announces and the bytes after it."""
    head, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    return size, payload


def _base32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def decisions(df: DataFrame, id_col: str, url_col: str, payload_col: str, least: int = 0) -> DataFrame:
    """(id, url, payload, sha, bytes, best, first): best is the id that the payload's group keeps, first whether this row is it."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    base = df.select(
        whole_number_id(df, id_col).alias("id"),
        F.col(url_col).cast("string").alias("url"),
        payload.alias("payload"),
        F.sha1(payload).alias("sha"),
        F.octet_length(payload).cast("long").alias("bytes"),
    )
    seen = base.select("sha", "bytes", "id").filter(F.col("bytes") >= least)
    groups = seen.groupBy("sha", "bytes").agg(F.count("*").alias("n"), F.max("id").alias("best"))  # null where no id is known
    groups = written(groups.filter("n > 1"), "payload-groups")
    found = base.join(groups, ["sha", "bytes"], "left")
    first = F.col("n").isNull() | F.col("id").eqNullSafe(F.col("best"))
    # the same id with the same payload more than once: one of these rows stays
    tied = seen.groupBy("sha", "bytes", "id").count().filter("count > 1")
    tied = written(tied.select(F.col("sha").alias("t_sha"), F.col("bytes").alias("t_bytes"), F.col("id").alias("t_id")), "payload-ties")
    if tied.isEmpty():
        return found.withColumn("first", first)
    same = (F.col("sha") == F.col("t_sha")) & (F.col("bytes") == F.col("t_bytes")) & F.col("id").eqNullSafe(F.col("t_id"))
    plain = found.join(tied, same, "left_anti").withColumn("first", first)
    turn = F.row_number().over(Window.partitionBy("sha", "bytes", "id").orderBy("url"))
    more = found.join(tied, same, "left_semi").withColumn("first", first & (turn == 1))
    return plain.unionByName(more)


def write_archives(df: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0) -> tuple[str, DataFrame]:
    """Writes the archives; (folder, a row per record: key, id, file, offset, length)."""
    spark = df.sparkSession
    folder = make_dir(spark, folder or new_path(spark, "warc"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = filesystem(folder)
        out, path, offset = None, "", 0

        def put(data: bytes) -> tuple[int, int]:
            nonlocal offset
            z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
            member = z.compress(data) + z.flush()
            out.write(member)
            offset += len(member)
            return offset - len(member), len(member)

        for batch in batches:
            if out is None:
                path = new_name(at, TaskContext.get().partitionId(), ".warc.gz")
                out = store.open_output_stream(path, compression=None)
                text = b"format: WARC File Format 1.1\r\n"
                put(f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Date: {DATE}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(text)}\r\n\r\n".encode() + text + b"\r\n\r\n")
            rows = []
            for id_, url, payload, sha, n_bytes, best, first, shared in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                kind = "response" if first else "revisit"
                own = "" if first and shared else f"{path.rpartition('/')[2]}:{offset}"
                place = put(record(kind, id_, url or "", payload if first else b"", n_bytes, _base32(sha), None if first else best, own))
                rows.append((url_key(url), _NO_ID if id_ is None else id_, path.rpartition("/")[2], *place))
            yield _batch(rows, _CAPTURE)
        if out is not None:
            out.close()

    rows = decisions(df, id_col, url_col, payload_col, least).select("id", "url", F.when(F.col("first"), F.col("payload")).alias("payload"), "sha", "bytes", "best", "first", F.col("n").isNotNull().alias("shared"))
    return folder, written(rows.mapInArrow(run, _CAPTURE), "captures")


def _batch(rows: list[tuple], names: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    fields = [x.split() for x in names.split(", ")]
    columns = list(zip(*rows, strict=True)) or [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


@dataclass
class CaptureIndex:
    """folder: of the archives and the shards. shards: (first key, first id, file) in order, one per range partition."""

    folder: str
    shards: list[tuple[str, int, str]]
    captures: int


def build_index(captures: DataFrame, folder: str, block: int = BLOCK) -> CaptureIndex:
    """Sorts the captures into shards of compressed blocks; see the module's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = filesystem(folder)
        part, out, path, offset, n = TaskContext.get().partitionId(), None, "", 0, 0
        directory, rows = [], []

        def flush() -> None:
            nonlocal offset, rows
            data = gzip.compress("".join(f"{k} {i} {f} {o} {s}\n" for k, i, f, o, s in rows).encode(), LEVEL, mtime=0)
            directory.append([rows[0][0], rows[0][1], offset, len(data)])
            out.write(data)
            offset += len(data)
            rows = []

        for batch in batches:
            if out is None:
                path = new_name(at, part, ".cdx")
                out = store.open_output_stream(path, compression=None)
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows.append(row)
                n += 1
                if len(rows) == block:
                    flush()
        if out is None:
            return
        if rows:
            flush()
        data = gzip.compress(json.dumps(directory).encode(), LEVEL, mtime=0)
        out.write(data + struct.pack(TAIL, offset, len(data), MAGIC))
        out.close()
        yield _batch([(part, path.rpartition("/")[2], directory[0][0], directory[0][1], n, len(directory))], _SHARD)

    parts = shuffle_partitions(captures.sparkSession)
    dealt = captures.repartitionByRange(parts, "key", "id").sortWithinPartitions("key", "id", "file", "offset")
    shards = written(dealt.mapInArrow(run, _SHARD), "cdx-shards").orderBy("shard").collect()  # one row per partition
    return CaptureIndex(folder, [(s.key, s.id, s.file) for s in shards], sum(s.captures for s in shards))


class IndexReader:
    """Lookups in an index, for one task: a few directories and blocks are kept."""

    def __init__(self, index: CaptureIndex) -> None:
        self.index, self.reader = index, Reader(index.folder)
        self.at = filesystem(index.folder)[1].rstrip("/")
        self.firsts = [(k, i) for k, i, _ in index.shards]
        self.directory = lru_cache(4)(self._directory)
        self.block = lru_cache(4)(self._block)

    def _directory(self, shard: int) -> list[tuple[str, int, int, int]]:
        path = f"{self.at}/{self.index.shards[shard][2]}"
        size = self.reader.size(path)
        tail = struct.calcsize(TAIL)
        offset, length, magic = struct.unpack(TAIL, self.reader.read(path, size - tail, tail))
        if magic != MAGIC:
            raise ValueError(f"{path} is no index shard")
        return [tuple(x) for x in json.loads(gzip.decompress(self.reader.read(path, offset, length)))]

    def _block(self, shard: int, block: int) -> list[tuple[str, int, str, int, int]]:
        _, _, offset, length = self.directory(shard)[block]
        lines = gzip.decompress(self.reader.read(f"{self.at}/{self.index.shards[shard][2]}", offset, length)).decode().splitlines()
        rows = (line.split(" ") for line in lines)
        return [(k, int(i), f, int(o), int(s)) for k, i, f, o, s in rows]

    def captures(self, key: str, id_: int | None = None) -> Iterator[tuple[str, int, str, int, int]]:
        """All captures of a key, or of a key and an id, in order."""
        low = (key, _NO_ID if id_ is None else id_)
        shard = max(0, bisect_left(self.firsts, low) - 1)
        if not self.firsts:
            return
        block = max(0, bisect_left(self.directory(shard), low) - 1)
        while shard < len(self.firsts):
            while block < len(self.directory(shard)):
                rows = self.block(shard, block)
                for row in rows[bisect_left(rows, low) :]:
                    if row[0] != key or (id_ is not None and row[1] != id_):
                        return
                    yield row
                block += 1
            shard, block = shard + 1, 0

    def read(self, file: str, offset: int, length: int) -> tuple[dict[str, str], bytes]:
        return parse(zlib.decompress(self.reader.read(f"{self.at}/{file}", offset, length), 31))


def read_records(index: CaptureIndex, queries: DataFrame, with_payload: bool = False) -> DataFrame:
    """The records of all captures of `queries` (key, id), found by binary search and read by their byte ranges.

    A response's size and digest are computed from the payload that was read and must agree with the record's fields.
    """
    schema = _RECORD + ", payload binary" * with_payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = IndexReader(index)
        for batch in batches:
            rows, payloads = [], []
            for key, id_ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for _, _, file, offset, length in reader.captures(key, id_):
                    fields, block = reader.read(file, offset, length)
                    size, payload = http_payload(block)
                    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and (size != len(payload) or digest != base64.b32encode(hashlib.sha1(payload).digest()).decode()):
                        raise ValueError(f"{file} at {offset}: the payload doesn't match its digest")
                    refers_to = page_of(fields["WARC-Refers-To"]) if kind == "revisit" else None
                    rows.append((page_of(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], size, digest, kind, refers_to))
                    payloads.append(payload if kind == "response" else None)
            out = _batch(rows, _RECORD)
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(payloads, pa.binary())], [*out.schema.names, "payload"]) if with_payload else out

    parts = shuffle_partitions(queries.sparkSession)
    dealt = queries.select("key", "id").distinct().repartitionByRange(parts, "key", "id").sortWithinPartitions("key", "id")
    return dealt.mapInArrow(run, schema)


def lookup(index: CaptureIndex, url: str) -> list[tuple[str, int, str, int, int]]:
    """The captures of one URL, on the driver: three binary searches and as many range reads."""
    return list(IndexReader(index).captures(url_key(url)))


def archive(df: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0, with_payload: bool = False) -> DataFrame:
    """Writes archives and index for `df` and reads every record back through the index."""
    folder, captures = write_archives(df, None, id_col, url_col, payload_col, least)
    return read_records(build_index(captures, folder), captures, with_payload)
