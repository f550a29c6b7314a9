"""Media columns: ISO base media containers in a binary column, and what their boxes say.

`mux` puts bytes into containers as raw 8-bit grey frames of SIDE x SIDE samples, losslessly: the last frame is filled up
with PAD. `probe` walks the nested boxes of any container, decodes the sample tables of each track and gives codec,
times and the byte range of every keyframe; no sample is decoded or even looked at. `samples` reads a track's samples
back by those tables. Tracks in movie fragments are not sample tables and are left out.

Every row is handled by itself, without a shuffle, some rows of a batch at a time. Nulls: a null text is empty, and an
empty text becomes one frame of PAD; a null container has no tracks and a null error. A container that can't be read
keeps its row and says so in `error`. Equal bytes give equal containers. Empty input, empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinworks.llm.common import slices, written

SIDE = 24
FRAME = SIDE * SIDE
PAD = b"\xff"
RATE = 25
CHUNK = 16
#: One frame in so many is marked as a keyframe.
KEY_EVERY = 12
#: Rows of a batch that are turned at once, if they are no larger than common.slices takes.
ROWS = 256

#: Boxes that hold boxes, and how many bytes of their own come first.
CONTAINERS = {"moov": 0, "trak": 0, "mdia": 0, "minf": 0, "stbl": 0, "edts": 0, "dinf": 0, "udta": 0, "mvex": 0}

_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
_RANGE = pa.struct([("offset", pa.int64()), ("size", pa.int64())])
_TRACK = pa.struct([
    ("track_id", pa.int64()), ("handler", pa.string()), ("codec", pa.string()), ("width", pa.int32()), ("height", pa.int32()),
    ("timescale", pa.int64()), ("duration", pa.int64()), ("samples", pa.int64()), ("bytes", pa.int64()), ("keyframes", pa.list_(_RANGE)),
])
TRACKS = (
    "array<struct<track_id:bigint,handler:string,codec:string,width:int,height:int,timescale:bigint,duration:bigint,"
    "samples:bigint,bytes:bigint,keyframes:array<struct<offset:bigint,size:bigint>>>>"
)


def box(kind: str, *parts: bytes) -> bytes:
    data = b"".join(parts)
    return struct.pack(">I4s", len(data) + 8, kind.encode("latin-1")) + data


def full_box(kind: str, *parts: bytes, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", flags), *parts)


def mux_bytes(data: bytes) -> bytes:
    """A container with one track of raw grey frames that hold `data` and the padding."""
    n = max(1, -(-len(data) // FRAME))
    payload = data + PAD * (n * FRAME - len(data))
    chunks = -(-n // CHUNK)
    last = n - (chunks - 1) * CHUNK
    runs = [(1, CHUNK, 1), (chunks, last, 1)] if chunks > 1 and last != CHUNK else [(1, min(n, CHUNK), 1)]
    keys = np.arange(1, n + 1, KEY_EVERY, dtype=">u4")
    ftyp = box("ftyp", b"qt  ", struct.pack(">I", 0x200), b"qt  isom")
    entry = box("raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">2H", SIDE, SIDE), struct.pack(">2I", 0x480000, 0x480000), bytes(4), struct.pack(">H", 1), bytes(32), struct.pack(">Hh", 40, -1))

    def moov(start: int) -> bytes:
        offsets = start + np.arange(chunks, dtype=np.int64) * (CHUNK * FRAME)
        small = start + n * FRAME < 1 << 32
        stbl = box(
            "stbl",
            full_box("stsd", struct.pack(">I", 1), entry),
            full_box("stts", struct.pack(">3I", 1, n, 1)),
            full_box("stss", struct.pack(">I", len(keys)), keys.tobytes()),
            full_box("stsc", struct.pack(">I", len(runs)), *(struct.pack(">3I", *r) for r in runs)),
            full_box("stsz", struct.pack(">2I", FRAME, n)),
            full_box("stco" if small else "co64", struct.pack(">I", chunks), offsets.astype(">u4" if small else ">u8").tobytes()),
        )
        dref = full_box("dref", struct.pack(">I", 1), full_box("url ", flags=1))
        minf = box("minf", full_box("vmhd", bytes(8), flags=1), box("dinf", dref), stbl)
        mdia = box("mdia", full_box("mdhd", struct.pack(">4I2H", 0, 0, RATE, n, 0x55C4, 0)), full_box("hdlr", bytes(4), b"vide", bytes(12), b"\0"), minf)
        tkhd = full_box("tkhd", struct.pack(">5I", 0, 0, 1, 0, n), bytes(8), struct.pack(">4H", 0, 0, 0, 0), _MATRIX, struct.pack(">2I", SIDE << 16, SIDE << 16), flags=7)
        mvhd = full_box("mvhd", struct.pack(">4IIH", 0, 0, RATE, n, 0x10000, 0x100), bytes(10), _MATRIX, bytes(24), struct.pack(">I", 2))
        return box("moov", mvhd, box("trak", tkhd, mdia))

    size = n * FRAME
    head = struct.pack(">I4s", size + 8, b"mdat") if size + 8 < 1 << 32 else struct.pack(">I4sQ", 1, b"mdat", size + 16)
    start = len(ftyp) + len(moov(0)) + len(head)
    return ftyp + moov(start) + head + payload


def walk(data: memoryview, start: int, end: int) -> Iterator[tuple[str, int, int]]:
    """(type, first, last) of the boxes in a range, each with the place of what is in it."""
    while end - start >= 8:
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            if end - start < 16:
                raise ValueError("a box ends inside its head")
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        elif size == 0:
            size = end - start  # to the end of what it is in
        if size < head or start + size > end:
            raise ValueError(f"box {kind!r} at {start} doesn't fit")
        yield kind.decode("latin-1"), start + head, start + size
        start += size


@dataclass
class Track:
    track_id: int = 0
    handler: str = ""
    codec: str = ""
    width: int = 0
    height: int = 0
    timescale: int = 0
    duration: int = 0
    tables: dict[str, tuple[int, int]] = field(default_factory=dict)
    offsets: np.ndarray | None = None
    sizes: np.ndarray | None = None
    keys: np.ndarray | None = None


def _numbers(data: memoryview, at: int, end: int, n: int, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    if n * size > end - at:
        raise ValueError("a table ends too early")
    return np.frombuffer(data, kind, n, at).astype(np.int64)


def _decode(data: memoryview, t: Track) -> None:
    """Offset and size of each sample, and the places of keyframes, from the track's tables."""
    if not {"stsz", "stz2"} & t.tables.keys() or not {"stco", "co64"} & t.tables.keys() or "stsc" not in t.tables:
        t.offsets, t.sizes, t.keys = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        return
    if "stsz" in t.tables:
        at, end = t.tables["stsz"]
        same, n = struct.unpack_from(">2I", data, at + 4)
        if same and n * same > len(data):
            raise ValueError("more samples than bytes")
        t.sizes = np.full(n, same, np.int64) if same else _numbers(data, at + 12, end, n, ">u4")
    else:
        at, end = t.tables["stz2"]
        bits, n = struct.unpack_from(">BI", data, at + 7)
        if bits == 4:
            pairs = _numbers(data, at + 12, end, (n + 1) // 2, ">u1")
            t.sizes = np.stack([pairs >> 4, pairs & 15], 1).ravel()[:n]
        else:
            t.sizes = _numbers(data, at + 12, end, n, f">u{bits // 8}")
    kind = "stco" if "stco" in t.tables else "co64"
    at, end = t.tables[kind]
    chunks = _numbers(data, at + 8, end, struct.unpack_from(">I", data, at + 4)[0], ">u4" if kind == "stco" else ">u8")
    at, end = t.tables["stsc"]
    runs = _numbers(data, at + 8, end, 3 * struct.unpack_from(">I", data, at + 4)[0], ">u4").reshape(-1, 3)
    per_chunk = np.repeat(runs[:, 1], np.diff(np.r_[runs[:, 0] - 1, len(chunks)]).clip(0)) if len(runs) else np.empty(0, np.int64)
    per_chunk = per_chunk[: len(chunks)]
    if per_chunk.sum() < len(t.sizes):
        raise ValueError("fewer places than samples")
    chunk = np.repeat(np.arange(len(per_chunk)), per_chunk)[: len(t.sizes)]
    before = np.cumsum(t.sizes) - t.sizes
    first = np.r_[True, chunk[1:] != chunk[:-1]] if len(chunk) else np.empty(0, bool)
    start = np.flatnonzero(first)
    in_chunk = before - np.repeat(before[start], np.diff(np.r_[start, len(chunk)]))
    t.offsets = chunks[chunk] + in_chunk
    if "stss" in t.tables:
        at, end = t.tables["stss"]
        keys = _numbers(data, at + 8, end, struct.unpack_from(">I", data, at + 4)[0], ">u4") - 1
        if len(keys) and (keys.min() < 0 or keys.max() >= len(t.sizes)):
            raise ValueError("a keyframe that is no sample")
        t.keys = keys
    else:
        t.keys = np.arange(len(t.sizes))  # without the table every sample is one
    if len(t.offsets) and (t.offsets + t.sizes).max() > len(data):
        raise ValueError("samples lie beyond the end")


def tracks(data: bytes | memoryview) -> list[Track]:
    """The tracks of a container. Raises ValueError for what is none."""
    data = memoryview(data)
    found: list[Track] = []
    try:
        todo = [(0, len(data), 0, None)]
        while todo:
            start, end, depth, track = todo.pop(0)
            if depth > 16:
                raise ValueError("boxes nest too deep")
            for kind, first, last in walk(data, start, end):
                if kind == "trak":
                    track = Track()
                    found.append(track)
                if kind in CONTAINERS:
                    todo.append((first + CONTAINERS[kind], last, depth + 1, track))
                elif track is None:
                    continue
                elif kind == "tkhd":
                    wide = data[first] == 1
                    track.track_id = struct.unpack_from(">I", data, first + (20 if wide else 12))[0]
                elif kind == "mdhd":
                    track.timescale, track.duration = struct.unpack_from(">IQ", data, first + 20) if data[first] == 1 else struct.unpack_from(">II", data, first + 12)
                elif kind == "hdlr":
                    track.handler = bytes(data[first + 8 : first + 12]).decode("latin-1")
                elif kind == "stsd":
                    if struct.unpack_from(">I", data, first + 4)[0]:
                        track.codec, at, until = next(walk(data, first + 8, last), ("", 0, 0))
                        if track.handler == "vide" and until - at >= 28:
                            track.width, track.height = struct.unpack_from(">2H", data, at + 24)
                elif kind in ("stsz", "stz2", "stco", "co64", "stsc", "stss", "stts"):
                    track.tables[kind] = (first, last)
        if not found and not any(kind in ("ftyp", "moov", "mdat") for kind, *_ in walk(data, 0, len(data))):
            raise ValueError("no such container")
        for t in found:
            _decode(data, t)
            if not t.duration and "stts" in t.tables:
                at, end = t.tables["stts"]
                runs = _numbers(data, at + 8, end, 2 * struct.unpack_from(">I", data, at + 4)[0], ">u4").reshape(-1, 2)
                t.duration = int((runs[:, 0] * runs[:, 1]).sum())
    except struct.error as e:
        raise ValueError(f"a box ends too early: {e}") from None
    return found


def samples(data: bytes | memoryview, track: Track) -> bytes:
    """The track's samples in order; runs of samples that lie side by side are read at once."""
    if not len(track.offsets):
        return b""
    data, ends = memoryview(data), track.offsets + track.sizes
    start = np.flatnonzero(np.r_[True, track.offsets[1:] != ends[:-1]])
    last = np.r_[start[1:], len(ends)] - 1
    return b"".join(data[a:b] for a, b in zip(track.offsets[start].tolist(), ends[last].tolist(), strict=True))


def _row(t: Track) -> dict:
    ranges = [{"offset": o, "size": s} for o, s in zip(t.offsets[t.keys].tolist(), t.sizes[t.keys].tolist(), strict=True)]
    return {"track_id": t.track_id, "handler": t.handler, "codec": t.codec.strip(), "width": t.width, "height": t.height, "timescale": t.timescale, "duration": t.duration, "samples": len(t.sizes), "bytes": int(t.sizes.sum()), "keyframes": ranges}


def _probed(media: bytes | None) -> tuple[list[Track], str | None]:
    if media is None:
        return [], None
    try:
        return tracks(media), None
    except ValueError as e:
        return [], str(e)


def mux(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes of the text in UTF-8, media: its container)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, ROWS):
                texts = [(t.as_py() or "").encode() for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, texts), pa.int64()), pa.array(map(mux_bytes, texts), pa.binary())], ["id", "n_bytes", "media"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, n_bytes long, media binary")


def probe(df: DataFrame, media_col: str = "media") -> DataFrame:
    """`df` with `tracks` (codec, times, sizes and keyframe byte ranges of each track) and `error`."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = [_probed(m.as_py()) for m in batch]
            yield pa.StructArray.from_arrays([pa.array([[_row(t) for t in ts] for ts, _ in found], pa.list_(_TRACK)), pa.array([e for _, e in found], pa.string())], ["tracks", "error"])

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    read = F.arrow_udf(run, f"struct<tracks:{TRACKS},error:string>")
    return df.withColumn("__probe", read(media_col)).withColumns({"tracks": F.col("__probe.tracks"), "error": F.col("__probe.error")}).drop("__probe")


def feature(t: Track) -> str:
    ranges = np.stack([t.offsets[t.keys], t.sizes[t.keys]], 1).astype("<i8").tobytes()
    return f"codec={t.codec.strip()};size={t.width}x{t.height};timescale={t.timescale};duration={t.duration};samples={len(t.sizes)};keyframes={len(t.keys)};ranges={zlib.crc32(ranges):08x}"


def round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores each text in a container in the shared folder and reads it back.

    id, n_bytes, payload_bytes, payload_sha256, tail_crc32 (of the payload's last 32 bytes), media_bytes, media_sha256,
    feature, codec, seconds, keyframe_offsets, keyframe_sizes.
    """
    schema = "id {}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, codec string, seconds double, keyframe_offsets array<long>, keyframe_sizes array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2, ROWS):
                rows = []
                for n_bytes, media in zip(part.column(1).to_pylist(), part.column(2), strict=True):
                    data = memoryview(media.as_buffer())
                    t = tracks(data)[0]
                    payload = samples(data, t)
                    rows.append((n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature(t), t.codec.strip(), t.duration / t.timescale, t.offsets[t.keys], t.sizes[t.keys]))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
                names = [x.strip().split()[0] for x in schema.split(", ")]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names)

    kind = df.schema[id_col].dataType.simpleString()
    return written(mux(df, id_col, text_col), "media").mapInArrow(run, schema.format(kind)).withColumnRenamed("id", id_col)
