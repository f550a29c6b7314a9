"""Exact byte-level BPE by dynamic programming over prefixes.

For each prefix of a piece the last token of its encoding is unique. An automaton over the vocabulary gives, at each
byte, every token that is a suffix of the prefix, longest first; the one that is compatible with the last token of the
prefix before it is stored. Two adjacent tokens are compatible if no merge ever crosses the border between them, which
is tested by undoing their merges, latest first. Following the stored tokens back from the end gives the ids. The time
is linear in the text, whatever the piece. Ids decode by their bytes.

The vocabulary file's path is a parameter. Each Python worker loads it once and keeps the ids of the pieces it has met,
within a bound. Nulls count as empty texts, whose ids are none; special tokens that occur in a text become their ids.
Ids of documents are handed on as they are, null ones too; repeated rows give a row each; an empty table an empty result.
Very long texts are cut into pieces as any others, and a piece of any length takes time in proportion.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinworks.llm.common import slices
from skeinworks.llm.pretokens import pieces

#: Pieces and pairs of tokens that a worker remembers; beyond, it starts anew.
KEPT_PIECES = 100_000
KEPT_PAIRS = 150_000
LONGEST_KEPT = 64
#: Rows and bytes of text whose ids and decoded texts a worker holds at a time; a longer text by itself.
ROWS, HELD_BYTES = 256, 4 << 20


def byte_signs() -> dict[str, int]:
    """The byte that each sign of a byte-level vocabulary stands for: visible Latin-1 for itself, the rest from 256 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(rest)}


class _Pieces(dict):
    """Ids of pieces as little-endian 32-bit bytes, encoded at the first meeting; what has not been met for long goes."""

    def __init__(self, encode) -> None:
        self.encode, self.older = encode, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = array("I", self.encode(piece.encode())).tobytes()
        if len(piece) <= LONGEST_KEPT:
            if len(self) >= KEPT_PIECES:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class BytePairs:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, signs = spec["model"]["vocab"], byte_signs()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes = {i: bytes(map(signs.__getitem__, t)) for t, i in vocab.items() if t not in self.special}
        self.bytes |= {i: t.encode() for t, i in self.special.items()}
        self.n_ids = max(self.bytes) + 1
        self.rank, self.parts, self.merged = {}, {}, {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            token = vocab[a + b]
            self.rank[token], self.parts[token] = rank, (vocab[a], vocab[b])
            self.merged[vocab[a] << 32 | vocab[b]] = rank
        self.automaton = ahocorasick.Automaton()
        for t, i in vocab.items():
            if t not in self.special:
                word = self.bytes[i].decode("latin-1")
                self.automaton.add_word(word, (i, len(word)))
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.known = _Pieces(self.encode_piece)
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two tokens stay apart side by side: no merge over their border comes before they are whole."""
        key = left << 32 | right
        rank, until, answer = self.rank, len(self.rank) + 1, True
        while True:
            over = self.merged.get(left << 32 | right)
            if over is not None and over < until:
                answer = False
                break
            a, b = rank.get(left, -1), rank.get(right, -1)
            if a < 0 and b < 0:
                break
            if b >= a:  # of equal merges the left one comes first, so the right one is undone first
                until, right = b + 1, self.parts[right][0]
            else:
                until, left = a, self.parts[left][1]
        if len(self.pairs) >= KEPT_PAIRS:
            self.pairs.clear()
        self.pairs[key] = answer
        return answer

    def encode_piece(self, piece: bytes) -> list[int]:
        last, sizes, have = [], [], -1  # by prefix: its last token and that token's length
        known = self.pairs.get
        for end, (token, size) in self.automaton.iter(piece.decode("latin-1")):
            if end == have:
                continue  # this prefix has its token already
            if end >= size:
                left = last[end - size]
                fits = known(left << 32 | token)
                if fits is None:
                    fits = self.compatible(left, token)
                if not fits:
                    continue
            last.append(token)
            sizes.append(size)
            have = end
        ids, at = [], len(piece)
        while at:
            ids.append(last[at - 1])
            at -= sizes[at - 1]
        ids.reverse()
        return ids

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        get = self.known.__getitem__
        if self.cut is None or not any(s in text for s in self.special):
            return b"".join(map(get, pieces(text)))
        parts = self.cut.split(text)
        return b"".join(np.array([self.special[p]], "<u4").tobytes() if k % 2 else b"".join(map(get, pieces(p))) for k, p in enumerate(parts))

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@cache
def load(path: str) -> BytePairs:
    return BytePairs(path)


def encode_documents(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, with_text: bool = False) -> DataFrame:
    """id, n_tokens, ids_sha256 (of little-endian unsigned 32-bit ids), decoded_sha256; on request the ids and the decoded text."""
    kind = df.schema[id_col].dataType.simpleString()
    schema = "id {}, n_tokens long, ids_sha256 string, decoded_sha256 string{}{}".format(kind, ", ids array<int>" * with_ids, ", decoded string" * with_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        names = [f.split()[0] for f in schema.split(", ")]
        for batch in (part for whole in batches for part in slices(whole, 1, ROWS, HELD_BYTES)):
            ids = [bpe.encode(t.as_py() or "") for t in batch.column(1)]
            back = [bpe.decode(i) for i in ids]
            columns = [
                batch.column(0),
                pa.array([len(i) // 4 for i in ids], pa.int64()),
                pa.array([hashlib.sha256(i).hexdigest() for i in ids], pa.string()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in back], pa.string()),
            ]
            if with_ids:
                columns.append(pa.array([np.frombuffer(i, "<i4") for i in ids], pa.list_(pa.int32())))
            if with_text:
                columns.append(pa.array(back, pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names)

    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)
