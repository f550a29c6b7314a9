"""Many texts to a file, with a table of their places, read by ranges.

Tasks write files of their own in the shared folder, one after the other, and the places are a table: (key, file, start,
size). Only places that were committed name a file, so a repeated task leaves nothing that is read. A reader goes through the places
in the order of files, so that each is opened once and read forward.

A null text is an empty one; keys may repeat and be null. Empty input, empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinworks.sources.tables import new_folder

#: Bytes of a file, about, and of what a task hands on at a time.
FILE, BATCH = 64 << 20, 8 << 20


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    if folder.startswith("file:/") and not folder.startswith("file:///"):
        folder = "file:///" + folder[len("file:/") :].lstrip("/")
    return fs.FileSystem.from_uri(folder)


def pack(df: DataFrame, key_col: str, text_col: str, folder: str | None = None) -> tuple[DataFrame, str]:
    """(places, folder): key, file, start, size of each text's UTF-8 bytes."""
    spark = df.sparkSession
    base = folder or new_folder(spark, "packed")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/texts")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, to = _store(f"{base}/texts")
        out, name, at = None, "", 0
        for whole in batches:
            for k in range(0, whole.num_rows, 64):
                batch = whole.slice(k, 64)
                rows = []
                for text in batch.column(1).to_pylist():
                    if out is None or at >= FILE:
                        if out is not None:
                            out.close()
                        name, at = uuid.uuid4().hex, 0
                        out = store.open_output_stream(f"{to}/{name}", compression=None)
                    raw = (text or "").encode()
                    out.write(raw)
                    rows.append((name, at, len(raw)))
                    at += len(raw)
                names, starts, sizes = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())], names=["key", "file", "start", "size"])
        if out is not None:
            out.close()

    kind = df.schema[key_col].dataType.simpleString()
    places = df.select(F.col(key_col).alias("key"), text_col).mapInArrow(part, f"key {kind}, file string, start long, size long")
    places.write.mode("overwrite").parquet(f"{base}/places")
    return spark.read.schema(places.schema).parquet(f"{base}/places"), base


def unpack(places: DataFrame, folder: str) -> DataFrame:
    """(key, size, content) of the texts at the places, which may be any part of the table."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = _store(f"{folder}/texts")
        opened, name = None, None
        for batch in batches:
            rows, held = [], 0
            for key, file, start, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if file != name:
                    if opened is not None:
                        opened.close()
                    opened, name = store.open_input_file(f"{at}/{file}"), file
                rows.append((key, size, opened.read_at(size, start).decode() if size else ""))
                held += size
                if held >= BATCH:
                    yield _batch(rows, batch.column(0).type)
                    rows, held = [], 0
            if rows:
                yield _batch(rows, batch.column(0).type)
        if opened is not None:
            opened.close()

    kind = places.schema["key"].dataType.simpleString()
    sorted_ = places.select("key", "file", "start", "size").repartition("file").sortWithinPartitions("file", "start")
    return sorted_.mapInArrow(part, f"key {kind}, size long, content string")


def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    key, size, content = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(key, kind), pa.array(size, pa.int64()), pa.array(content, pa.string())], names=["key", "size", "content"])
