"""Collocations by contiguous pattern growth in the manner of PrefixSpan.

Every word occurrence points at what follows it in its piece, at most MOST_WORDS - 1 words: the projection of its prefix.
Tasks combine equal pointers of some megabytes of text at a time, so that a pointer has a weight, and hand on one row per
prefix, a word of a language, with all its pointers; a shuffle brings the rows of a prefix to one task. There patterns
grow to the right by recursion: the pointers of a prefix are counted by their next word, and those of each frequent next word
are the projection of the longer prefix, with which it goes one word deeper. A task does so for some prefixes at a time, from a
word to its longest patterns, before it takes the next ones.

A prefix with more than PART pointers, or 1 / SHARE of all, is dealt to several tasks by its pointers: the longest
patterns are still complete in a task, shorter ones are partial counts that the tasks hand on unpruned and a shuffle
adds up. So no task holds more than a part of a prefix.

The most frequent words, CODED at most, travel as codes of one to three signs and all others spelled out, which
changes the size of what is shuffled and nothing else. Scores come from joins of the frequent patterns alone, in exact decimals of
38 digits (counts up to 10**16).

Nulls: a null text is empty, a null language is `und`. Repeated rows count as often as they occur; ids play no part.
Ties: score, then count, then the phrase's bytes. Long texts are cut where pieces end. Empty input, empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skeinworks.llm.common import slices, written

#: Fixed values of the text rule: signs at which pieces end, and those at which words end.
PIECE_ENDS, WORD_ENDS = b".,;:!?\x0a\x0b\x0c\x0d", b" \x09"
#: Words of a phrase, its least count, how much of a phrase's count a longer one takes to replace it (per cent), rows per language.
MOST_WORDS, LEAST_COUNT, REPLACED, TOP = 3, 10, 50, 2000
#: Bytes of text whose pointers a task combines at a time.
CHUNK = 2 << 20
#: Bytes of the sample whose most frequent words have codes.
SAMPLE = 16 << 20
#: Pointers of a prefix that a task takes: PART, or a SHARE-th of all where that is less, but LEAST_PART at least.
PART, SHARE, LEAST_PART = 200_000, 1024, 10_000
#: Words that have a code, and the prefixes dealt in parts up to which their list is broadcast.
CODED, LISTED = 1 << 16, 10_000
#: Pointers of whole prefixes that a task unpacks at a time.
UNPACKED = 150_000

_END, _GAP = b"\n", b" "
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + PIECE_ENDS + WORD_ENDS, b"abcdefghijklmnopqrstuvwxyz" + _END * len(PIECE_ENDS) + _GAP * len(WORD_ENDS))
#: Signs of a code; a word that is spelled out begins with SPELLED.
_DIGITS, _SPELLED = [chr(c) for c in range(33, 123)], "\x01"


def codes(words: list[str]) -> dict[str, str]:
    """A short code for each word, the shortest for the first."""
    out, n = {}, len(_DIGITS)
    for k, word in enumerate(words):
        code = _DIGITS[k % n]
        while k >= n:
            k = k // n - 1
            code = _DIGITS[k % n] + code
        out[word] = code
    return out


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], list[bytes]]]:
    """(languages, folded texts) of about CHUNK bytes; a longer text in parts that end where a piece does."""
    langs: list[str] = []
    texts: list[bytes] = []
    held = 0
    for whole in batches:
        for batch in slices(whole, 1):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = text.encode().translate(_FOLD)
                while raw:
                    cut = len(raw)
                    if cut > CHUNK:
                        at = raw.rfind(_END, 0, CHUNK)
                        at = raw.find(_END, CHUNK) if at <= 0 else at
                        cut = at if at > 0 else cut
                    langs.append(lang)
                    texts.append(raw[:cut])
                    held += cut
                    raw = raw[cut:]
                    if held >= CHUNK:
                        yield langs, texts
                        langs, texts, held = [], [], 0
    if texts:
        yield langs, texts


def _words(langs: list[str], texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str], list[str]]:
    """Per word of the texts its number, piece and language; the different words and languages that the numbers mean."""
    blob = np.frombuffer(_END.join(texts), np.uint8)
    ends = blob == _END[0]
    inside = ~(ends | (blob == _GAP[0]))
    edge = np.diff(inside.view(np.int8), prepend=0, append=0)
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return start, start, start, [], []
    offsets = np.zeros(len(start) + 1, np.int32)
    np.cumsum(stop - start, out=offsets[1:])
    found = pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(blob[inside].tobytes())).dictionary_encode()
    piece = np.cumsum(ends, dtype=np.int32)[start]
    names = sorted(set(langs))
    place = {lang: k for k, lang in enumerate(names)}
    text = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), start, "right")
    lang = np.array([place[x] for x in langs], np.int32)[text]
    return found.indices.to_numpy(), piece, lang, found.dictionary.to_pylist(), names


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each word of a language occurs in each chunk."""
    for chunk in _chunks(batches):
        word, _, lang, words, langs = _words(*chunk)
        if words:
            keys, n = np.unique(lang.astype(np.int64) * len(words) + word, return_counts=True)
            columns = [pa.array(langs).take(pa.array(keys // len(words))), pa.array(words).take(pa.array(keys % len(words))), pa.array(n)]
            yield from _sliced(pa.RecordBatch.from_arrays(columns, names=["lang", "word", "n"]))


def _sliced(batch: pa.RecordBatch, rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    for k in range(0, batch.num_rows, rows):
        yield batch.slice(k, rows)


#: A row has the pointers of a prefix: a line of words each, and its weight.
_ROW = "lang string, word string, tails string, weights array<int>"


def _project(words: int, code: dict[str, str]):
    """Texts to the pointers of each prefix."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches):
            first, piece, lang, known, langs = _words(*chunk)
            if not known:
                continue
            none = len(known)
            columns = [lang, first]
            for k in range(1, words):
                after = np.full(len(first), none, np.int32)
                same = piece[k:] == piece[:-k]
                after[:-k][same] = first[k:][same]
                columns.append(after)
            packed, size = lang.astype(np.int64), len(langs)
            for column in columns[1:]:
                if size >= (1 << 62) // (none + 1):
                    packed = np.unique(packed, return_inverse=True)[1]
                    size = int(packed.max()) + 1
                packed, size = packed * (none + 1) + column, size * (none + 1)
            del piece
            _, at, n = np.unique(packed, return_index=True, return_counts=True)
            del packed
            spelled = pa.array([*(code.get(w) or _SPELLED + w for w in known), ""])
            tails = pc.binary_join_element_wise(*(spelled.take(pa.array(c[at])) for c in columns[2:]), " ")
            prefix = lang[at].astype(np.int64) * none + first[at]
            begins = np.flatnonzero(np.concatenate(([True], prefix[1:] != prefix[:-1])))
            # a row has UNPACKED pointers at most
            begins = np.union1d(begins, np.arange(0, len(at), UNPACKED)) if len(at) > UNPACKED else begins
            offsets = pa.array(np.append(begins, len(at)).astype(np.int32))
            rows = [
                pa.array(langs).take(pa.array(lang[at[begins]])),
                spelled.take(pa.array(first[at[begins]])),
                pc.binary_join(pa.ListArray.from_arrays(offsets, tails), "\n"),
                pa.ListArray.from_arrays(offsets, pa.array(n.astype(np.int32))),
            ]
            yield from _sliced(pa.RecordBatch.from_arrays(rows, names=["lang", "word", "tails", "weights"]), 4096)

    return part


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pointers of a prefix by the part, from 1, that they are dealt to."""
    for batch in batches:
        for lang, word, tails, weights, parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            lines = tails.split("\n")
            to = np.array([zlib.crc32(t.encode()) % parts + 1 for t in lines])
            order = np.argsort(to, kind="stable")
            number, begins = np.unique(to[order], return_index=True)
            offsets = pa.array(np.append(begins, len(to)).astype(np.int32))
            rows = [
                pa.array([lang] * len(number)),
                pa.array([word] * len(number)),
                pc.binary_join(pa.ListArray.from_arrays(offsets, pa.array(lines).take(pa.array(order))), "\n"),
                pa.ListArray.from_arrays(offsets, pa.array(np.array(weights, np.int32)[order])),
                pa.array(number, pa.int32()),
            ]
            yield pa.RecordBatch.from_arrays(rows, names=["lang", "word", "tails", "weights", "part"])


def grown(prefix: np.ndarray, following: np.ndarray, weights: np.ndarray, partial: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(prefix, next word, count) of the frequent patterns that are one word longer than the prefixes, then those of one more.

    prefix: a number per pointer; following: its next words, -1 after the last. Prefixes are numbered anew as they grow, in the
    order in which they come out. The recursion goes on with the pointers of what is frequent alone. A `partial` prefix has
    pointers elsewhere, so that counts below `least` may be parts of more, but for the longest patterns.
    """
    if not following.shape[1]:
        return
    word = following[:, 0].astype(np.int64)
    here = np.flatnonzero(word >= 0)
    prefix, word = prefix[here].astype(np.int64), word[here]
    if not len(here):
        return
    key = prefix * (int(word.max()) + 1) + word
    order = np.argsort(key, kind="stable")
    key, here = key[order], here[order]
    begins = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    counts = np.add.reduceat(weights[here], begins)
    last = following.shape[1] == 1
    keep = counts >= least if last else (counts >= least) | partial[here[begins]]
    at = order[begins[keep]]
    yield prefix[at], word[at], counts[keep]
    if not last:
        sizes = np.diff(np.append(begins, len(here)))
        here = here[np.repeat(keep, sizes)]
        yield from grown(np.repeat(np.arange(int(keep.sum())), sizes[keep]), following[here, 1:], weights[here], partial[here], least)


class _Plain:
    """Words by number, decoded when asked for: few are part of a pattern."""

    def __init__(self, known: list[str], decode: dict[str, str]) -> None:
        self.known, self.decode = known, decode

    def __getitem__(self, k: int) -> str:
        return self.decode.get(self.known[k]) or self.known[k][1:]


def _grow(words: int, least: int, decode: dict[str, str]):
    """Rows in the order of prefixes and parts to their frequent patterns (lang, p, f)."""

    def solved(rows: pa.Table, begins: np.ndarray, end: int) -> Iterator[pa.RecordBatch]:
        """The prefixes whose rows begin at `begins`, up to the row `end`."""
        rows = rows.slice(0, end)
        n = rows["weights"].combine_chunks().value_lengths().to_numpy().astype(np.int64)
        weights = rows["weights"].combine_chunks().flatten().to_numpy().astype(np.int64)
        at = np.cumsum(n) - n
        number = rows["part"].to_numpy()[begins]
        counts = np.add.reduceat(weights, at[begins])
        wanted = (counts >= least) | (number > 0)  # the others aren't frequent themselves
        row = np.repeat(wanted, np.diff(np.append(begins, end)))
        if not wanted.any():
            return
        flat = pc.split_pattern(rows["tails"].combine_chunks().take(pa.array(np.flatnonzero(row))), "\n").flatten()
        found = pc.split_pattern(flat, " ").flatten().dictionary_encode()
        weights = weights[np.repeat(row, n)]
        known = found.dictionary.to_pylist()
        plain = _Plain(known, decode)
        following = found.indices.to_numpy().reshape(-1, words - 1).astype(np.int32)
        if "" in known:
            following[following == known.index("")] = -1
        first = pa.array(begins[wanted])
        sizes = np.add.reduceat(n, begins)[wanted]
        langs = rows["lang"].take(first).to_pylist()
        open_ = [(lang, (decode.get(w) or w[1:],)) for lang, w in zip(langs, rows["word"].take(first).to_pylist(), strict=True)]
        out = [(lang, p, f) for (lang, p), f in zip(open_, counts[wanted].tolist(), strict=True)]
        prefix = np.repeat(np.arange(len(sizes)), sizes)
        for up, word, f in grown(prefix, following, weights, np.repeat(number[wanted] > 0, sizes), least):
            open_ = [(open_[u][0], (*open_[u][1], plain[w])) for u, w in zip(up.tolist(), word.tolist(), strict=True)]
            out += [(lang, p, k) for (lang, p), k in zip(open_, f.tolist(), strict=True)]
        for k in range(0, len(out), 20_000):
            lang, p, f = zip(*out[k : k + 20_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(p, pa.list_(pa.string())), pa.array(f, pa.int64())], names=["lang", "p", "f"])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0

        def close(last: bool) -> Iterator[pa.RecordBatch]:
            """All prefixes whose rows are there; the one that the rows end with may have more to come."""
            rows = pa.Table.from_batches(held).combine_chunks()
            keys = [rows[c].combine_chunks().dictionary_encode().indices.to_numpy() for c in ("lang", "word")] + [rows["part"].to_numpy()]
            new = np.ones(rows.num_rows, bool)
            new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
            begins = np.flatnonzero(new)
            end = rows.num_rows if last else int(begins[-1])
            if end:
                yield from solved(rows, begins if last else begins[:-1], end)
            held[:] = rows.slice(end).to_batches()

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += len(batch.column(4).flatten())
            if n >= UNPACKED:
                yield from close(False)
                n = sum(len(b.column(4).flatten()) for b in held)
                n = n if n < UNPACKED else 0  # a prefix of many pointers: it is looked at again after as many more
        if held:
            yield from close(True)

    return part


def frequent_words(rows: DataFrame) -> list[str]:
    """The most frequent words of a sample of about SAMPLE bytes, CODED at most: those of a count of at least some power of two.

    Which words have codes decides how much is shuffled, not what is found.
    """
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    some = rows.filter(F.pmod(F.xxhash64("text"), F.lit(-(-total // SAMPLE))) == 0) if total > SAMPLE else rows
    sums = written(some.mapInArrow(_count, "lang string, word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    steps = sorted(sums.groupBy(F.length(F.bin("n")).alias("step")).agg(F.count("*").alias("words")).collect(), key=lambda r: -r.step)  # 64 rows at most
    least, words = None, 0
    for r in steps:
        words += r.words
        if words > CODED:
            break
        least = r.step
    if least is None:
        return []
    return [r.word for r in sorted(sums.filter(F.length(F.bin("n")) >= least).collect(), key=lambda r: (-r.n, r.word))]


def patterns(df: DataFrame, lang_col: str = "lang", text_col: str = "text", words: int = MOST_WORDS, least: int = LEAST_COUNT) -> tuple[DataFrame, DataFrame]:
    """(frequent contiguous patterns `p` with their count `f` per language, words in all per language `n`), of written tables."""
    rows = df.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    code = codes(frequent_words(rows))
    projected = written(rows.mapInArrow(_project(words, code), _ROW), "pointers")
    totals = projected.groupBy("lang").agg(F.sum(F.aggregate("weights", F.lit(0).cast("long"), lambda x, y: x + y)).alias("n"))
    sizes = projected.groupBy("lang", "word").agg(F.sum(F.size("weights")).alias("pointers"))
    part = max(LEAST_PART, min(PART, (projected.agg(F.sum(F.size("weights"))).first()[0] or 0) // SHARE))
    large = written(sizes.filter(F.col("pointers") > part).select("lang", "word", F.ceil(F.col("pointers") / part).cast("int").alias("parts")), "large")
    # few where PART isn't reached (SHARE at most); the check is for when it is
    dealt = projected.join(F.broadcast(large) if large.count() <= LISTED else large, ["lang", "word"], "left")
    whole = dealt.filter("parts is null").select("lang", "word", F.lit(0).cast("int").alias("part"), "tails", "weights")
    split = dealt.filter("parts is not null").select("lang", "word", "tails", "weights", "parts").mapInArrow(_split, f"{_ROW}, part int")
    by_prefix = whole.unionByName(split).repartition("lang", "word", "part").sortWithinPartitions("lang", "word", "part")
    found = by_prefix.select("lang", "word", "part", "tails", "weights").mapInArrow(_grow(words, least, {c: w for w, c in code.items()}), "lang string, p array<string>, f long")
    found = found.groupBy("lang", "p").agg(F.sum("f").alias("f")).filter(F.col("f") >= least)
    return written(found, "patterns"), totals


def collocations(df: DataFrame, lang_col: str = "lang", text_col: str = "text", words: int = MOST_WORDS, least: int = LEAST_COUNT, replaced: int = REPLACED, top: int = TOP) -> DataFrame:
    """Per language its best phrases: lang, rank, phrase, a, l, r, n, score.

    a is the phrase's count; of its cuts into two parts with counts l and r the one with the least floor(10**6 * a * a / (l * r))
    counts, of equal ones the first. Phrases of which a longer one takes `replaced` per cent or more are left out.
    """
    found, totals = patterns(df, lang_col, text_col, words, least)
    sized = found.select("lang", "p", F.col("f").alias("a")).withColumn("size", F.size("p"))
    candidates = sized.filter("size >= 2")
    # each cut of a phrase asks for the counts of its two parts, which are frequent as the phrase is
    cuts = candidates.select("lang", "p", "a", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    counts = sized.select("lang", F.col("p").alias("part"), F.col("a").alias("count"))
    left, right = (counts.withColumnRenamed("count", c) for c in "lr")
    cuts = cuts.withColumn("part", F.expr("slice(p, 1, k)")).join(left, ["lang", "part"]).drop("part")
    cuts = cuts.withColumn("part", F.expr("slice(p, k + 1, size(p) - k)")).join(right, ["lang", "part"]).drop("part")
    exact = "decimal(19,0)"
    score = F.expr(f"(cast(a as {exact}) * cast(a as {exact}) * cast(1000000 as decimal(7,0))) div (cast(l as {exact}) * cast(r as {exact}))")
    scored = cuts.withColumn("score", score).groupBy("lang", "p", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # what lies inside a longer candidate, with the count of the greatest such
    inside = candidates.filter("size > 2").select("lang", "a", "p", F.explode(F.expr("sequence(2, size - 1)")).alias("s"))
    inside = inside.select("lang", F.col("a").alias("longer"), F.explode(F.expr("transform(sequence(1, size(p) - s + 1), i -> slice(p, i, s))")).alias("p"))
    inside = inside.groupBy("lang", "p").agg(F.max("longer").alias("longer"))
    kept = scored.join(inside, ["lang", "p"], "left").filter(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * replaced))
    ranked = kept.select("lang", F.array_join("p", " ").alias("phrase"), "a", "cut.l", "cut.r", "cut.score")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    best = ranked.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
