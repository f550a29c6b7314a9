"""op13 against its SQL and against plain counting."""

import random
import re
import sys
from collections import Counter, defaultdict
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).parent.parent.parent), str(Path(__file__).parent.parent)]

from oracle import DATA, connection, rows_of, rows_of_sql  # noqa: E402

from skeinworks.llm import collocations, queries  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, n long, a long, w1 string, phrase string, p string, hot long"
COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def frame(spark, rows):
    return spark.createDataFrame([(k, t, lang, 1, 2, "w", "p", "q", 5) for k, (t, lang) in enumerate(rows)], SCHEMA).repartition(3)


def plain(rows, top=2000):
    f, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = [w for w in re.split("[ \t]", piece) if w]
            total[lang] += len(words)
            for s in (1, 2, 3):
                f.update((lang, *words[k : k + s]) for k in range(len(words) - s + 1))
    found = defaultdict(list)
    for (lang, *p), a in f.items():
        if len(p) < 2 or a < 10:
            continue
        if any(q[0] == lang and len(q) == len(p) + 2 and b >= 10 and 100 * b >= 50 * a and tuple(p) in (q[1:-1], q[2:]) for q, b in f.items() if len(p) == 2):
            continue
        cuts = [(10**6 * a * a // (f[(lang, *p[:k])] * f[(lang, *p[k:])]), k, f[(lang, *p[:k])], f[(lang, *p[k:])]) for k in range(1, len(p))]
        score, _, left, right = min(cuts)
        found[lang].append((-score, -a, " ".join(p).encode(), left, right))
    return sorted((lang, k + 1, p.decode(), -a, left, right, total[lang], -s) for lang, rows in found.items() for k, (s, a, p, left, right) in enumerate(sorted(rows)[:top]))


def rows(df):
    assert df.columns == COLUMNS
    return sorted(tuple(r) for r in df.collect())


def texts(n=500, seed=2):
    rng = random.Random(seed)
    vocabulary = [*"abcdefgh", "Été", "été", "x y", "New York City", "x\x1fy", "x\xa0z"]
    made = [("".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\r\n"]) for _ in range(rng.randint(0, 60))), rng.choice(["en", "fr", None, "und", ""])) for _ in range(n)]
    return [*made, (None, "en"), ("", None), (" \t ", "en"), ("...", "fr"), *[made[0]] * 5, ("the cat " * 5000, "en")]


def test_query_equals_its_sql(spark):
    df = queries.op13_collocations(spark, DATA)
    columns = sorted(df.columns)
    expected = rows_of_sql(connection(), queries.ORACLE_SQL["op13_collocations"], columns)
    assert rows_of(df, columns) == expected and len(expected) > 50


@pytest.mark.parametrize("limits", [{}, {"LEAST_PART": 1, "CHUNK": 100, "CODED": 5}, {"LEAST_PART": 40, "CODED": 0, "UNPACKED": 3, "LISTED": 0}])
def test_against_plain(spark, monkeypatch, limits):
    """However prefixes are dealt (whole, by their pointers, some of them), chunks are cut and words are coded."""
    for k, v in limits.items():
        monkeypatch.setattr(collocations, k, v)
    given = texts()
    expected = plain(given)
    assert len(expected) > 60
    assert rows(collocations.collocations(frame(spark, given))) == expected


def test_codes():
    words = [f"w{k}" for k in range(10_000)]
    made = collocations.codes(words)
    assert len(set(made.values())) == 10_000 and max(map(len, made.values())) == 3 and not any(set(c) & set(" \n\x01") for c in made.values())


def test_top_and_ties(spark):
    given = texts(60, 4)
    assert rows(collocations.collocations(frame(spark, given), top=3)) == plain(given, 3)


def test_empty(spark):
    assert rows(collocations.collocations(frame(spark, []))) == []
    assert rows(collocations.collocations(frame(spark, [(None, None), ("one two", "en")]))) == []


def test_large_counts(spark, monkeypatch):
    """Products pass 64 bits."""
    a = 3 * 10**9
    counts = {("x", "y"): a, ("x",): a + 1, ("y",): a + 7}
    found = spark.createDataFrame([("en", list(p), f) for p, f in counts.items()], "lang string, p array<string>, f long")
    totals = spark.createDataFrame([("en", 3 * a)], "lang string, n long")
    monkeypatch.setattr(collocations, "patterns", lambda *_: (found, totals))
    assert rows(collocations.collocations(frame(spark, []))) == [("en", 1, "x y", a, a + 1, a + 7, 3 * a, 10**6 * a * a // ((a + 1) * (a + 7)))]
