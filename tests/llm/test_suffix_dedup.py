"""op12 against plain counting of windows."""

import hashlib
import os
import random
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

sys.path[:0] = [str(Path(__file__).parent.parent.parent), str(Path(__file__).parent.parent)]

from oracle import DATA  # noqa: E402

from skeinworks.llm import queries, suffix_dedup  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, file long, doc long, rel long, n int, id long, kept string"


def frame(spark, texts):
    return spark.createDataFrame([(k, t, "en", 1, 2, 3, 4, 5, "x") for k, t in enumerate(texts)], SCHEMA).repartition(3)


def plain(rows, size):
    seen = Counter()
    raw = [(i, (t or "").encode()) for i, t in rows]
    for _, b in raw:
        seen.update(b[k : k + size] for k in range(len(b) - size + 1))
    out = []
    for i, b in raw:
        gone = np.zeros(len(b) + 2, bool)
        for k in range(len(b) - size + 1):
            if seen[b[k : k + size]] > 1:
                gone[k + 1 : k + 1 + size] = True
        spans = int((gone[1:] & ~gone[:-1]).sum())
        kept = bytes(c for c, g in zip(b, gone[1:], strict=False) if not g)
        out.append((i, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(df, size):
    rows = suffix_dedup.remove_repeats(df, threshold=size).collect()
    for r in rows:
        assert sum(e - s for s, e in r.spans) == r.n_removed and len(r.spans) == r.n_spans
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in rows), key=str)


def texts(seed=1, n=60):
    """Texts that share passages, with edits, copies, runs of one letter and of short periods."""
    rng = random.Random(seed)
    passages = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(30, 160))) for _ in range(8)]
    out = []
    for _ in range(n):
        t = ""
        for _ in range(rng.randint(0, 6)):
            p = rng.choice(passages)
            a, b = sorted(rng.sample(range(len(p)), 2))
            t += rng.choice([p, p[a:b], "".join(rng.choice("xyz") for _ in range(rng.randint(0, 90)))])
        out.append(t)
    return [*out, out[3], out[3], None, "", "a" * 500, "b" * 39, "b" * 39, "c" * 40, "c" * 41, "abc" * 100, "zabc" * 90, "x" * 20 + "abc" * 30]


def test_query(spark):
    df = queries.op12_suffix_dedup(spark, DATA)
    assert df.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    rows = [tuple(r) for r in spark.read.parquet(os.path.join(DATA, "documents.parquet")).select("doc_id", "text").collect()]
    expected = plain(rows, 200)
    assert sorted((tuple(r) for r in df.collect()), key=str) == expected
    assert 0 < sum(r[2] > 0 for r in expected) < len(expected)


@pytest.mark.parametrize("size", [40, 33, 7])
def test_against_plain(spark, size):
    given = texts()
    assert found(frame(spark, given), size) == plain(list(enumerate(given)), size)


@pytest.mark.parametrize("limits", [{"GROUP": 1}, {"CHUNK": 150, "BLOCK": 64}, {"HOT": 10**9, "LEAST_HOT": 2}, {"HOT": 10**9, "LEAST_HOT": 2, "SAMPLE": 3000, "STEP": 3}])
def test_however_groups_are_dealt(spark, monkeypatch, limits):
    for k, v in limits.items():
        monkeypatch.setattr(suffix_dedup, k, v)
    given = texts(7)
    assert found(frame(spark, given), 40) == plain(list(enumerate(given)), 40)


def test_empty(spark):
    assert found(frame(spark, []), 40) == []
    assert found(frame(spark, [None, "", "short"]), 40) == plain([(0, None), (1, ""), (2, "short")], 40)


def test_null_and_repeated_ids(spark):
    t = texts(9)[5] + "y" * 60
    rows = [(None, t), (None, t), (4, "unlike anything"), (4, "unlike anything")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(df, 40) == plain(rows, 40)


def test_radix_groups():
    rng = np.random.default_rng(5)
    buf = rng.integers(0, 2, 3000, np.uint8)
    at = np.arange(0, 2900)
    for size in (5, 8, 11, 24):
        group, known = rng.integers(0, 3, len(at)), rng.random(len(at)) < 0.3
        hit = set(suffix_dedup.radix_groups(buf, group, at, known, size).tolist())
        seen, unknown = Counter(), Counter()
        for k in range(len(at)):
            w = (group[k], buf[at[k] : at[k] + size].tobytes())
            seen[w] += 1
            unknown[w] += not known[k]
        assert hit == {k for k in range(len(at)) if seen[w := (group[k], buf[at[k] : at[k] + size].tobytes())] > 1 and unknown[w]}
