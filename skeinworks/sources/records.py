"""Records in chunks, as a data source of Spark's own: format("skein_records").

    df.write.format("skein_records").option("path", p).option("records", 500).mode("append" or "overwrite").save()
    spark.read.format("skein_records").option("path", p).schema(...).load()

A chunk is a file of JSON lines, `records` at most, sent again after an error, `retries` times. A chunk's name is its attempt's own, and
only the manifest that the driver writes at the end names it: a job that fails leaves nothing that a reader sees, and its
chunks are deleted as far as they are known. A reader's partition is one chunk.

Values are numbers, texts, booleans, nulls, lists and maps of these, and structs, which are objects by name; timestamps are refused by
the JSON writer. A missing field reads as null. Without a manifest there are no records.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import ArrayType, DataType, MapType, Row, StructType

NAME = "skein_records"
RECORDS, RETRIES = 500, 5


def register(spark: SparkSession) -> str:
    """Makes the format known to a session and returns its name."""
    spark.dataSource.register(RecordSource)
    return NAME


def _store(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:/") and not path.startswith("file:///"):
        path = "file:///" + path[len("file:/") :].lstrip("/")
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def send(store: fs.FileSystem, path: str, lines: list[str]) -> None:
    """One chunk, whole."""
    with store.open_output_stream(path, compression=None) as out:
        out.write("".join(f"{x}\n" for x in lines).encode())


@dataclass
class Sent(WriterCommitMessage):
    chunks: list[str]


@dataclass
class Chunk(InputPartition):
    path: str


class RecordSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "value string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return RecordReader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return RecordWriter(self.options["path"], int(self.options.get("records", RECORDS)), int(self.options.get("retries", RETRIES)), overwrite)


class RecordWriter(DataSourceWriter):
    def __init__(self, path: str, records: int, retries: int, overwrite: bool) -> None:
        self.path, self.records, self.retries, self.overwrite = path, records, retries, overwrite
        self.job = uuid.uuid4().hex
        store, base = _store(path)
        store.create_dir(f"{base}/chunks/{self.job}", recursive=True)
        store.create_dir(f"{base}/manifest", recursive=True)

    def _sent(self, store: fs.FileSystem, base: str, lines: list[str]) -> str:
        name = f"{self.job}/{uuid.uuid4().hex}"
        for attempt in range(self.retries + 1):
            try:
                send(store, f"{base}/chunks/{name}", lines)
                return name
            except OSError:
                if attempt == self.retries:
                    raise
                time.sleep(min(0.01 * 2**attempt, 30))
        return name

    def write(self, iterator: Iterator[Row]) -> Sent:
        store, base = _store(self.path)
        chunks, lines = [], []
        for row in iterator:
            lines.append(json.dumps(row.asDict(recursive=True), ensure_ascii=False))
            if len(lines) == self.records:
                chunks.append(self._sent(store, base, lines))
                lines = []
        if lines:
            chunks.append(self._sent(store, base, lines))
        return Sent(chunks)

    def commit(self, messages: list[Sent | None]) -> None:
        store, base = _store(self.path)
        names = [c for m in messages if m for c in m.chunks]
        if not self.overwrite:
            names = [*manifest(store, base), *names]
        last = max((int(f.base_name) for f in store.get_file_info(fs.FileSelector(f"{base}/manifest")) if f.base_name.isdigit()), default=-1)
        with store.open_output_stream(f"{base}/manifest/.{self.job}", compression=None) as out:
            out.write("\n".join(names).encode())
        store.move(f"{base}/manifest/.{self.job}", f"{base}/manifest/{last + 1}")

    def abort(self, messages: list[Sent | None]) -> None:
        store, base = _store(self.path)
        store.delete_dir(f"{base}/chunks/{self.job}")


def manifest(store: fs.FileSystem, base: str) -> list[str]:
    """The chunks that count."""
    found = [f for f in store.get_file_info(fs.FileSelector(f"{base}/manifest", allow_not_found=True)) if f.base_name.isdigit()]
    if not found:
        return []
    with store.open_input_file(max(found, key=lambda f: int(f.base_name)).path) as f:
        return [x for x in f.read().decode().split("\n") if x]


class RecordReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType) -> None:
        self.path, self.kind = path, schema

    def partitions(self) -> list[Chunk]:
        store, base = _store(self.path)
        return [Chunk(name) for name in manifest(store, base)]

    def read(self, partition: Chunk) -> Iterator[tuple]:
        if partition is None or not getattr(partition, "path", None):
            return
        store, base = _store(self.path)
        with store.open_input_stream(f"{base}/chunks/{partition.path}", compression=None) as f:
            for line in f.read().decode().split("\n"):
                if line:
                    yield _value(json.loads(line), self.kind)


def _value(x: object, kind: DataType) -> object:
    """A JSON value as Spark takes it: objects of a struct as tuples in its order."""
    if x is None:
        return None
    if isinstance(kind, StructType):
        return tuple(_value(x.get(f.name), f.dataType) for f in kind)
    if isinstance(kind, ArrayType):
        return [_value(v, kind.elementType) for v in x]
    if isinstance(kind, MapType):
        return {k: _value(v, kind.valueType) for k, v in x.items()}
    return x
