"""Vectors as they are stored elsewhere: big-endian 4-byte floats, or numbers joined by commas."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def _decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        yield pa.array([None if b is None else np.frombuffer(b, ">f4").astype("<f4") for b in batch.to_pylist()], pa.list_(pa.float32()))


def _encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        yield pa.array([None if v is None else np.asarray(v, ">f4").tobytes() for v in batch.to_pylist()], pa.binary())


def from_bytes(data: Column) -> Column:
    """The floats in a binary; null stays null, an empty one is an empty array."""
    return F.arrow_udf(_decode, "array<float>")(data)


def to_bytes(vector: Column) -> Column:
    return F.arrow_udf(_encode, "binary")(vector.cast("array<float>"))


def from_text(text: Column) -> Column:
    """Numbers between commas; what is no number is null."""
    return F.transform(F.split(text, ","), lambda x: F.trim(x).try_cast("double"))
