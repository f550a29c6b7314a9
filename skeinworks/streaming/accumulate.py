"""Growing texts as keyed state: each chunk holds all so far or only what is new, and leaves its delta.

State of a text is its size and a hash of it, not the text, so it stays small however long a text grows: a chunk is
cumulative where its beginning of that size has that hash. The hash of a text and a delta follows from both hashes. A chunk that
comes before its turn waits in the state until the gap closes; one that comes again (its number was taken already)
changes nothing. A text ends with its last chunk or, by a timer, once the watermark has passed its latest event by
`idle`; then what waits is taken in order, and the state goes.

Nulls: a null chunk is empty; chunks with a null key are one text; those without a number or a time are left out.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: A row per chunk; where `ended` is idle, a row without a chunk of its own. seq counts from 0.
OUT = "key string, seq long, delta string, size long, cumulative boolean, ended string"
_STATE = "next long, octets long, signs long, hash string, latest long, waiting string"
#: A prime of 128 bits, by which the bytes of a text, as one number, are reduced.
PRIME = 2**128 - 159


def number(text: bytes) -> int:
    return int.from_bytes(text, "big") % PRIME


class Growing:
    """What is known of a text: number of the next chunk, its size in bytes and signs, its hash, and what waits."""

    def __init__(self, next_: int = 0, octets: int = 0, signs: int = 0, hash_: int = 0, waiting: dict[int, tuple[str, bool]] | None = None) -> None:
        self.next, self.octets, self.signs, self.hash, self.waiting, self.ended = next_, octets, signs, hash_, waiting or {}, False

    def add(self, chunk: str) -> tuple[str, bool]:
        """(delta, whether the chunk held all so far) of one more chunk."""
        raw = chunk.encode()
        so_far = self.octets
        whole = 0 < so_far <= len(raw) and number(raw[:so_far]) == self.hash
        new = raw[so_far:] if whole else raw
        self.hash = (self.hash * pow(256, len(new), PRIME) + number(new)) % PRIME
        self.octets += len(new)
        delta = new.decode()
        self.signs += len(delta)
        return delta, whole

    def take(self, gaps: bool = False) -> Iterator[tuple[int, str, int, bool, str | None]]:
        """(seq, delta, size, cumulative, ended) of all that waits and whose turn it is; with `gaps` of all that waits."""
        for seq in sorted(self.waiting):
            if self.ended or seq != self.next and not gaps:
                return
            chunk, last = self.waiting.pop(seq)
            delta, whole = self.add(chunk)
            self.next, self.ended = seq + 1, last
            yield seq, delta, self.signs, whole, "last" if last else None


def _fold(idle: int):
    """One key's chunks of a micro-batch, or its timer."""

    def one(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        next_, octets, signs, hash_, latest, waiting = state.get if state.exists else (0, 0, 0, "0", 0, "[]")
        text = Growing(next_, octets, signs, int(hash_), {s: (c, last) for s, c, last in json.loads(waiting)})
        if state.hasTimedOut:
            out = [*text.take(gaps=True)]
            if not text.ended:
                out.append((text.next, "", text.signs, None, "idle"))
            state.remove()
        else:
            for batch in batches:  # one batch of a key at a time
                for seq, chunk, last, at in zip(batch["seq"], batch["chunk"], batch["last"], batch["at"], strict=True):
                    latest = max(latest, int(at))
                    if seq >= text.next:
                        text.waiting.setdefault(int(seq), (chunk or "", bool(last)))
            out = [*text.take()]
            if text.ended:
                state.remove()
            else:
                state.update((text.next, text.octets, text.signs, str(text.hash), latest, json.dumps([(s, *c) for s, c in text.waiting.items()])))
                state.setTimeoutTimestamp(max(latest + idle, state.getCurrentWatermarkMs() + 1))
        for k in range(0, len(out), 4096):
            yield pd.DataFrame([(key[0], *row) for row in out[k : k + 4096]], columns=["key", "seq", "delta", "size", "cumulative", "ended"])

    return one


def deltas(chunks: DataFrame, delay: str, idle_seconds: int) -> DataFrame:
    """Each chunk's delta, as a stream. chunks: key string, seq long, chunk string, last boolean, ts timestamp.

    `delay`: how late a chunk may come; later ones are lost to the watermark. An ended key that comes again begins anew.
    """
    rows = chunks.filter("seq is not null and ts is not null").withWatermark("ts", delay)
    rows = rows.select("key", "seq", "chunk", F.coalesce("last", F.lit(False)).alias("last"), F.unix_millis("ts").alias("at"), "ts")
    return rows.groupBy("key").applyInPandasWithState(_fold(1000 * idle_seconds), OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
