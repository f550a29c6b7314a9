"""Each corpus operator against a brute-force version, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import os
import random
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path[:0] = [str(Path(__file__).parent.parent.parent), str(Path(__file__).parent.parent)]

from oracle import DATA  # noqa: E402

from skeinworks.llm import blocks, bpe, exact_dedup, language_id, line_dedup, lm_score, media, mixing, queries, simhash_dedup, token_files, warc  # noqa: E402
from skeinworks.llm.components import connected_components  # noqa: E402

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, id long, tile long, `__id` long, key string, word string"
VOCABULARY = queries.vocabulary_path()
LONG = " ".join(f"word{k} of a very long text{k % 7}." for k in range(20_000))

TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog.\nSecond line here, with some words in it.", "en", "a"),
    (2, "The  quick brown fox\tjumps over the lazy dog.\nSecond line here, with some words in it.", "en", "a"),
    (3, "the quick brown fox jumps over the lazy dog.\nSecond line here, with some wordz in it.", "en", "b"),
    (4, None, "en", "a"),
    (5, "", None, None),
    (6, " \n\t ", "fr", "b"),
    (7, "Été à la plage: l'eau est très bleue — n'est-ce pas? 12345", "fr", None),
    (8, LONG, "en", "a"),
    (9, "日本語のテキスト\nと 改行 <|endoftext|> x", None, "c"),
    (10, "1234 5678 !!!", "en", "c"),
    (11, "The quick brown fox jumps over the lazy dog.\nSecond line here, with some words in it.", "en", "a"),
    (11, "The quick brown fox jumps over the lazy dog.\nSecond line here, with some words in it.", "en", "a"),
    (None, "A text without an id, which has words of its own and more of them.", "en", "d"),
    (12, "x" * 700, "de", "a"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, lang, s, None if t is None else len(t), 7, 8, 9, "k", "w") for i, t, lang, s in TEXTS]
    return spark.createDataFrame(rows, DOCUMENTS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCUMENTS)


def corpus(spark, n=300, seed=5):
    """Documents of a few words that share lines and differ little from each other."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    lines = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(3, 30))) for _ in range(80)]
    rows = []
    for k in range(n):
        text = "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 8)))
        if rng.random() < 0.5 and text:
            words = text.split(" ")
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
            text = " ".join(words)
        rows.append((k, text, rng.choice(["en", "fr"]), rng.choice(["a", "a", "b", "c"])))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), rows


class Groups:
    def __init__(self, n):
        self.up = list(range(n))

    def top(self, k):
        while self.up[k] != k:
            k = self.up[k]
        return k

    def join(self, a, b):
        a, b = self.top(a), self.top(b)
        self.up[max(a, b)] = min(a, b)


# op1


def test_containers():
    for n in (0, 1, 575, 576, 577, 576 * 16, 576 * 17, 576 * 40 + 3):
        data = os.urandom(n)
        held = media.mux_bytes(data)
        track = media.tracks(held)[0]
        payload = media.samples(held, track)
        assert payload[:n] == data and set(payload[n:]) <= {255} and len(payload) % 576 == 0 and 0 < len(payload) <= n + 576
        assert (track.codec, track.timescale, track.duration) == ("raw ", 25, len(payload) // 576)
        key = int(track.offsets[track.keys[-1]])
        assert held[key : key + 576] == payload[576 * int(track.keys[-1]) :][:576]


def test_odd_containers():
    held = media.mux_bytes(b"x" * 2000)
    assert media.tracks(held.replace(b"stss", b"free"))[0].keys.tolist() == [0, 1, 2, 3]  # no table: all are keyframes
    at = held.index(b"mdat") - 4
    to_end = held[:at] + b"\0\0\0\0" + held[at + 4 :]  # size 0: to the end
    assert media.samples(to_end, media.tracks(to_end)[0])[:2000] == b"x" * 2000
    for broken in (b"", b"abc", held[:300], b"\xff" * 64, held[:-600]):
        with pytest.raises(ValueError):
            media.tracks(broken)


def test_media_rows(spark, docs, none):
    found = media.round_trip(docs).collect()
    assert len(found) == len(TEXTS)
    by_id = {r.doc_id: r for r in found if r.doc_id is not None}
    for i, text, *_ in TEXTS:
        if i is not None:
            data = (text or "").encode()
            payload = data + b"\xff" * (-len(data) % 576 or (576 if not data else 0))
            r = by_id[i]
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    assert by_id[4].media_sha256 == by_id[5].media_sha256
    assert media.round_trip(none).count() == 0
    probed = media.probe(media.mux(docs).union(spark.createDataFrame([(99, 0, None), (98, 0, bytearray(b"no"))], "id long, n_bytes long, media binary"))).collect()
    assert {r.id: (len(r.tracks), r.error is None) for r in probed}[99] == (0, True)
    assert {r.id: (len(r.tracks), r.error is None) for r in probed}[98] == (0, False)


# op2


def test_simhash(spark, docs, none):
    df, rows = corpus(spark)
    fps = np.array([simhash_dedup.fingerprint(t) for _, t, *_ in rows], np.uint64)
    groups = Groups(len(rows))
    for a in range(len(rows)):
        for b in np.flatnonzero(np.bitwise_count(fps[a + 1 :] ^ fps[a]) <= 3) + a + 1:
            groups.join(a, int(b))
    found = {r.doc_id: r for r in simhash_dedup.near_duplicates(df).collect()}
    assert all((found[k].component_id, found[k].fingerprint) == (groups.top(k), f"{int(fps[k]):016x}") for k in range(len(rows)))
    assert simhash_dedup.drop_near_copies(df).count() == len({groups.top(k) for k in range(len(rows))})
    odd = simhash_dedup.near_duplicates(docs).collect()
    assert len(odd) == len(TEXTS)
    assert {r.component_id for r in odd if r.doc_id in (4, 5, 6)} == {4}
    assert simhash_dedup.near_duplicates(none).count() == 0 and simhash_dedup.drop_near_copies(none).count() == 0


@pytest.mark.parametrize("chosen", [1, 2, 3])
def test_blocks_lose_no_pair(spark, chosen):
    rng = np.random.default_rng(chosen)
    base = rng.integers(0, 1 << 63, 40, np.uint64)
    near = np.concatenate([base, base ^ np.uint64(1 << 5), base ^ np.uint64(1 << 63 | 1 << 20 | 1 << 41), base ^ np.uint64(0xF)])
    near = np.unique(near)
    df = spark.createDataFrame([(int(x),) for x in near.view(np.int64)], "fp long")
    tiled = blocks.tiles(blocks.nodes(df, blocks.masks(chosen, 3)), 4).collect()
    by_tile = defaultdict(set)
    for r in tiled:
        by_tile[r.tile].add(r.fp)
    together = {(a, b) for v in by_tile.values() for a in v for b in v}
    for a in near:
        for b in near[np.bitwise_count(near ^ a) <= 3]:
            assert (int(a.view(np.int64)), int(b.view(np.int64))) in together
    assert blocks.masks_for(10**12, 3, 64) == blocks.masks(4, 3)


def test_near_pairs():
    rng = np.random.default_rng(8)
    fp = rng.integers(0, 1 << 12, 900, np.uint64)
    tile = np.sort(rng.integers(0, 5, 900))
    for small in (4, 1000):
        found = sorted((int(x), int(y)) for a, b in blocks.near_pairs(fp, tile, 3, small) for x, y in zip(a, b, strict=True))
        assert found == [(x, y) for x in range(900) for y in range(x + 1, 900) if tile[x] == tile[y] and int(fp[x] ^ fp[y]).bit_count() <= 3]


def test_components(spark):
    chain = [(k, k + 1) for k in range(50)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    found = {r.node: r.root for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert found == {k: 0 for k in range(51)} | {100: 100, 101: 100}


# op3


def slow_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def test_edit_distance():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randint(0, 40))) for _ in range(2))
        b = a[:9] + "x" + a[12:] if rng.random() < 0.5 else b
        assert line_dedup.edit_distance(a, b) == slow_distance(a, b)


def line_groups(texts):
    """The groups of all pairs of distinct normal forms with similar edit distance, and the pairs."""
    forms = sorted({f for t in texts for f in line_dedup.normal_lines(t or "") if f}, key=lambda f: (len(f.decode()), f))
    strings = [f.decode() for f in forms]
    sizes, counts = np.array([len(x) for x in strings]), line_dedup._counts(strings)
    groups, pairs = Groups(len(forms)), []
    for a in range(len(forms)):
        b = np.arange(a + 1, np.searchsorted(sizes, sizes[a] / line_dedup.SIMILAR + 1e-9, "right"))
        b = b[line_dedup._may_be_similar(np.full(len(b), a), b, sizes, counts, line_dedup.SIMILAR)]
        for k in b.tolist():
            if line_dedup.similar(strings[a], strings[k]):
                groups.join(a, k)
                pairs.append((forms[a], forms[k]))
    return {f: groups.top(k) for k, f in enumerate(forms)}, pairs


def check_lines(df, rows, least):
    """Every group that is dropped lies within a group of all pairs, keeps one occurrence, and at least `least` of the pairs meet."""
    text = {d: t for d, t in rows}
    true, pairs = line_groups(text.values())
    root, places = {}, defaultdict(list)
    for r in line_dedup.groups(df.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"), "text")).collect():
        form = line_dedup.normal_lines(text[r.id])[r.line]
        assert root.setdefault(form, r.root) == r.root
        places[r.root].append((r.id, r.line))
    assert all(len({true[f] for f, x in root.items() if x == g}) == 1 for g in places)
    assert sum(root.get(a, a) == root.get(b, b) for a, b in pairs) >= least * len(pairs) and pairs
    n = Counter(f for t in text.values() for f in line_dedup.normal_lines(t or "") if f)
    assert all(f in root for f, k in n.items() if k > 1)
    gone = {(d, k) for d, k in (x for v in places.values() for x in sorted(v)[1:])}
    for r in line_dedup.dedup_lines(df).collect():
        lines = (text[r.doc_id] or "").split("\n")
        assert list(r.dropped) == [k for k in range(len(lines)) if (r.doc_id, k) in gone]
        assert r.text == "\n".join(x for k, x in enumerate(lines) if (r.doc_id, k) not in gone) and r.n_lines == len(lines)
    return len(gone)


def test_line_dedup_against_all_pairs(spark):
    df, rows = corpus(spark)
    assert check_lines(df, [(d, t) for d, t, *_ in rows], 0.9) > 100
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    assert check_lines(docs, [tuple(r) for r in docs.collect()], 0.9) > 0


def test_line_dedup(spark, docs, none):
    found = line_dedup.dedup_lines(docs).collect()
    assert len(found) == len(TEXTS)
    by_id = defaultdict(list)
    for r in found:
        by_id[r.doc_id].append(r)
    assert by_id[4][0].text is None and by_id[4][0].n_lines == 0 and by_id[5][0].text == "" and by_id[6][0].text == " \n\t "
    groups, _ = line_groups([t for _, t, *_ in TEXTS])
    form = lambda d, k: line_dedup.normal_lines(TEXTS[d - 1][1])[k]
    assert groups[form(1, 1)] == groups[form(3, 1)]  # one sign of 38, found among all pairs
    assert [list(by_id[k][0].dropped) for k in (1, 2, 3)] == [[], [0, 1], [0, 1]]
    assert line_dedup.dedup_lines(none).count() == 0


def test_repeated_rows_keep_one_occurrence(spark):
    lines = "a line of some words that is long enough\n\nand another line which nothing else has"
    rows = [(1, lines), (1, lines), (1, lines), (None, lines), (None, "of nobody and of nothing else"), (None, "of nobody and of nothing else")]
    found = sorted(tuple(r.dropped) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert found == [(), (), (0,), (0, 2), (0, 2), (0, 2)]


@pytest.mark.parametrize("kind,ids", [("long", [(1 << 63) - 1, -(1 << 63), None]), ("string", ["b", "a", None]), ("int", [2, -1, None])])
def test_lines_by_any_id(spark, kind, ids):
    """The least id is the first, a null id the last, whatever the type."""
    df = spark.createDataFrame([(i, "the same line of some words here") for i in ids], f"doc_id {kind}, text string")
    found = {r.doc_id: list(r.dropped) for r in line_dedup.dedup_lines(df).collect()}
    assert found == {ids[0]: [0], ids[1]: [], None: [0]}


def test_windows_are_simhashes_of_pairs_of_words():
    rng = random.Random(6)
    forms = [" ".join(rng.choice(["one", "two", "three", "four", "five", "a" * 40]) for _ in range(n)).encode() for n in (1, 3, 4, 8, 9, 14, 15, 26, 60)]
    owner, fps = line_dedup.windows(forms)
    for k, form in enumerate(forms):
        words, possible = form.split(), set()
        for size in line_dedup.LADDER:
            for at in range(len(words) - size + 1):
                one = line_dedup.word_hashes(words[at : at + size])[1].tolist()
                hashes = line_dedup.scattered(np.array([(a * line_dedup._FACTOR + b) % (1 << 64) for a, b in zip(one, one[1:])], np.uint64)).tolist()
                possible.add(sum((2 * sum(h >> b & 1 for h in hashes) > size - 1) << b for b in range(64)))
        mine = set(fps[owner == k].tolist())
        assert mine <= possible and bool(mine) == (len(words) > line_dedup.LADDER[0])
    assert line_dedup.windows(forms[3:4])[1].tolist() == fps[owner == 3].tolist()  # whatever other lines there are


# op4


def test_language_id(spark, docs, none):
    en, fr = "the cat and the dog of this house were with them".split(), "le chat et les chiens de cette maison sont avec eux".split()
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choice(en if k % 2 else fr) for _ in range(12)), "en" if k % 2 else "fr") for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r.doc_id: r for r in language_id.identify(df).collect()}
    assert all(found[k].lang_pred == lang for k, _, lang in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in found.values())
    odd = {r.doc_id: r for r in language_id.identify(docs).collect()}
    assert {k: odd[k].lang_pred for k in (4, 5, 6, 10)} == dict.fromkeys((4, 5, 6, 10), "und")
    assert language_id.identify(none).count() == 0
    assert sorted(r.doc_id or 0 for r in language_id.keep_identified(docs).collect()) == sorted([1, 2, 3, 7, 8, 9, 11, 11, 0, 12])
    unlabelled = language_id.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in unlabelled} == {"und"}


# op5


def test_mixing(spark, docs, none):
    df, rows = corpus(spark, 600)
    found = mixing.mix(df).collect()
    size = {s: sum(r.size for r in found if r.source == s) for s in "abc"}
    weight = dict(zip("abc", (5, 2, 1), strict=True))
    target, left, total = {}, set("abc"), 1.5 * sum(size.values())
    while left:
        level = (total - sum(target.values())) / sum(weight[s] for s in left)
        over = {s for s in left if level * weight[s] > 2 * size[s]}
        target |= {s: 2.0 * size[s] if s in over else level * weight[s] for s in (over or left)}
        left -= over or left
    for s in "abc":
        mine = [r for r in found if r.source == s]
        assert all(abs(r.target - target[s]) < 1e-6 * target[s] and 0 <= r.taken <= 2 * r.size and r.source_size == size[s] for r in mine)
        assert abs(sum(r.taken for r in mine) - target[s]) <= max(r.size for r in mine)
    assert sorted(map(tuple, mixing.mix(df.repartition(5)).collect())) == sorted(map(tuple, found))
    odd = mixing.mix(docs).collect()
    assert len(odd) == len(TEXTS) and {r.size for r in odd if r.doc_id in (4, 5, 6)} == {0}
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and {r["__id"] for r in mixed.collect()} == {9}
    took = Counter({i: 0 for i, *_ in TEXTS})
    for r in odd:
        took[r.doc_id] += r.copies
    assert +Counter(r.doc_id for r in mixed.collect()) == +took
    assert mixing.mix(none).count() == 0 and mixing.mixed_documents(none).count() == 0


# op6


def test_lm_score(spark, docs, none):
    df, rows = corpus(spark, 400)
    tokens = {d: (t or "").encode().lower().split() + [b"\n"] for d, t, *_ in rows}
    out = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in tokens}
    counts = Counter(w for d, ws in tokens.items() if not out[d] for w in ws)
    n, v = sum(counts.values()), len(counts)
    for head in (lm_score.HEAD, 50):  # all words at hand, or most looked up
        found = {r.doc_id: r for r in lm_score.score(df, words=30, head=head).collect()}
        for d, ws in tokens.items():
            r = found[d]
            base = sum(np.log10((counts[w] + 1) / (n + v + 1)) for w in ws)
            assert abs(r.base_score - base) < 1e-6 * (1 - base) and r.score < 0
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[d], len(ws), sum(counts[w] > 0 for w in ws), n)
    assert len(lm_score.score(docs).collect()) == len(TEXTS)
    assert lm_score.score(none).count() == 0


def test_lm_is_normalised():
    rng = np.random.default_rng(0)
    model = lm_score.Model(12, 4)
    flat = model.first(np.arange(1, 13.0)) + rng.normal(0, 0.3, sum(int(np.prod(s)) for s in model.shapes)).astype(np.float32)
    r, q, c1, c2, bias = model.parts(flat)
    z = np.empty((13, 13), np.float32)
    for a in range(13):
        logits = (r[a] @ c1 + r @ c2) @ q.T + bias
        z[a] = np.log(np.exp(logits).sum(1))
    scorer = lm_score.Scorer(model, flat, z)
    before = [3, 5]
    p = [10 ** scorer.log10(np.array([*before, w], np.int16), np.array([0]))[2] for w in range(12)]
    assert abs(sum(p) - 1) < 1e-4


def test_nce_learns():
    model = lm_score.Model(6, 4)
    mass = np.ones(6)
    nce = lm_score.Nce(model, model.first(mass), mass, [1])
    w = np.array([0, 1, 2, 3, 4, 5] * 400, np.int16)  # each class follows the one before
    a, b = lm_score.contexts(w, np.array([0]), model.n)
    for k in range(0, len(w), 100):
        nce.learn(a[k : k + 100], b[k : k + 100], w[k : k + 100])
    r, q, c1, c2, bias = model.parts(nce.flat)
    logits = (r[a[-6:]] @ c1 + r[b[-6:]] @ c2) @ q.T + bias
    assert logits.argmax(1).tolist() == w[-6:].tolist()


# op7, op8


def test_bpe_and_token_files(spark, docs, none):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(VOCABULARY)
    df, rows = corpus(spark, 60)
    for frame, texts in ((df, [(d, t) for d, t, *_ in rows]), (docs, [(i, t) for i, t, *_ in TEXTS])):
        want = Counter()
        for i, t in texts:
            ids = library.encode(t or "", add_special_tokens=False).ids
            data = np.array(ids, "<u4").tobytes()
            want[i, len(ids), hashlib.sha256(data).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
        assert Counter(map(tuple, bpe.encode_documents(frame, VOCABULARY).collect())) == want
        shards = token_files.write_tokens(frame, VOCABULARY, files=3)
        read = token_files.read_tokens(shards, with_ids=True).orderBy("start").collect()
        start = 0
        for r in read:
            assert r.start == start and r.n_tokens == len(r.ids) and r.ids[-1] == 0
            assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
            start += r.n_tokens
        assert [r.id for r in read] == sorted((i for i, _ in texts), key=lambda i: (i is not None, i))
        by_id = {r.id: list(r.ids) for r in read}
        assert all(by_id[i] == [*library.encode(t or "", add_special_tokens=False).ids, 0] for i, t in texts)
    assert bpe.encode_documents(none, VOCABULARY).count() == 0
    assert token_files.read_tokens(token_files.write_tokens(none, VOCABULARY)).count() == 0


@pytest.mark.parametrize("width", [1, 5, 8, 13, 16, 17, 32])
def test_bit_packing(width):
    ids = np.random.default_rng(width).integers(0, 1 << width, 1000).astype(np.uint32)
    data = token_files.pack(ids, width)
    assert len(data) == -(-1000 * width // 8)
    assert token_files.unpack(data, 1000, width).tolist() == ids.tolist()


# op9


def test_exact_dedup(spark, docs, none):
    df, rows = corpus(spark)
    rows = [(d, t) for d, t, *_ in rows]
    for frame, texts in ((df, rows), (docs, [(i, t) for i, t, *_ in TEXTS])):
        groups = defaultdict(list)
        for i, t in texts:
            groups["".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")].append((-len(t or ""), i is None, i or 0))
        want = Counter()
        for norm, members in groups.items():
            best = min(members)
            keep = None if best[1] else best[2]
            for k, m in enumerate(sorted(members)):
                want[None if m[1] else m[2], keep, len(members), k == 0, hashlib.sha256(norm.encode()).hexdigest()] += 1
        assert Counter(map(tuple, exact_dedup.exact_dedup(frame, capacity=200).collect())) == want
        assert exact_dedup.drop_copies(frame).count() == len(groups)
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns and {r["__id"] for r in kept.collect()} == {9}
    assert exact_dedup.exact_dedup(none).count() == 0 and exact_dedup.drop_copies(none).count() == 0


def test_directory():
    loads = {p: 10 for p in range(16)} | {3: 500}
    slots = exact_dedup.grow_directory(loads, 4, 40)
    assert [s for s, *_ in slots] == list(range(len(slots)))
    held = defaultdict(int)
    for prefix, n in loads.items():
        held[slots[prefix * len(slots) // 16][1]] += n
    assert all(n <= 40 or n >= 500 for n in held.values())


# op10


def test_url_keys():
    assert warc.url_key("http://www.Example.ORG/a b?x=1") == "org,example,www)/a%20b?x=1"
    assert warc.url_key("https://u@h.net:8080") == "net,h:8080)/"
    assert warc.url_key(None) == "" and " " not in warc.url_key("http://[bad/ x")


def test_warc(spark):
    rng = random.Random(4)
    rows = [(k, rng.choice(["http://a.org/x", "http://a.org/y z", "http://b.com/", None]), rng.choice(["one", "two", "", None, f"own {k}"])) for k in range(400)]
    rows += [(7, "http://a.org/x", "one"), (None, "http://c.net/é", "two"), (900, "http://c.net/long", LONG)]
    df = spark.createDataFrame([(*r, "k", "f") for r in rows], "page_id long, url string, html string, key string, file string")
    best = {}
    for i, _, h in rows:
        best[h or ""] = max(best.get(h or "", -1), -1 if i is None else i)
    found = warc.archive(df, with_payload=True).collect()
    assert len(found) == len(rows)
    import base64

    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    want = Counter()
    for i, _, h in rows:
        first = i == best[h or ""]
        want[i, len((h or "").encode()), digest(h), "response" if first else "revisit", None if first else best[h or ""]] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found) == want
    assert {bytes(r.payload).decode() for r in found if r.record_type == "response"} == {h or "" for *_, h in rows}
    folder, captures = warc.write_archives(df)
    index = warc.build_index(captures, folder, block=7)
    assert len(warc.lookup(index, "http://a.org/y z")) == sum(u == "http://a.org/y z" for _, u, _ in rows)
    assert warc.lookup(index, "http://nowhere.org/") == []
    assert warc.archive(df.filter("false")).count() == 0
    all_ = warc.archive(df, least=10).collect()
    assert {r.record_type for r in all_ if r.payload_bytes < 10} == {"response"}


def test_repeated_pages(spark):
    df = spark.createDataFrame([(5, "http://a/", "same")] * 3 + [(4, "http://a/", "same")], "page_id long, url string, html string")
    found = sorted((r.page_id, r.record_type, r.refers_to or 0) for r in warc.archive(df).collect())
    assert found == [(4, "revisit", 5), (5, "response", 0), (5, "revisit", 5), (5, "revisit", 5)]


def test_line_parts_meet_across_lengths(spark):
    words = "keeper harbour seven lantern quiet meadow copper thistle window gravel orchard".split()
    eleven = " ".join(words)
    longer = " ".join([*words[:5], "sun", *words[5:]])
    sign = " ".join([*words[:3], "lanteen", *words[4:]])
    other = "nothing of this kind was ever said about any lantern or meadow here"
    assert all(line_dedup.similar(eleven, x) for x in (longer, sign))
    rows = [(1, f"{eleven}\n{other}"), (2, longer), (3, sign)]
    found = {r.doc_id: r.dropped for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1: [], 2: [0], 3: [0]}


def test_counts_keep_similar_lines():
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcé ") for _ in range(rng.randint(1, 24))) for _ in range(300)]
    texts += ["".join(rng.choice([c, c, c, c, "b", "", "cc"]) for c in t) or "a" for t in texts]
    a, b = (x.ravel() for x in np.triu_indices(len(texts), 1))
    may = line_dedup._may_be_similar(a, b, np.array([len(t) for t in texts]), line_dedup._counts(texts), 0.8)
    assert not may.all()
    assert all(m or not line_dedup.similar(texts[x], texts[y]) for x, y, m in zip(a.tolist(), b.tolist(), may.tolist(), strict=True))


def test_edit_distance_stops_early():
    rng = random.Random(4)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 12))) for _ in range(2))
        true = slow_distance(a, b)
        for most in range(8):
            assert (line_dedup.edit_distance(a, b, most) <= most) == (true <= most)


# near copies of the pipeline


def jaccard_groups(texts):
    """The groups of texts whose sets of five-word shingles have a Jaccard similarity of 0.8, over all pairs, and the pairs."""
    split = [(t or "").encode().lower().split() for t in texts]
    sets = [{tuple(w[k : k + 5]) for k in range(max(len(w) - 4, min(len(w), 1)))} for w in split]
    groups, pairs = Groups(len(sets)), []
    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            small, large = sorted((len(sets[a]), len(sets[b])))
            if small >= 0.8 * large and (both := len(sets[a] & sets[b])) >= 0.8 * (small + large - both):
                groups.join(a, b)
                pairs.append((a, b))
    return groups, pairs


def test_drop_similar(spark, docs, none):
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(900)]
    rows = []
    for k in range(60):  # groups of texts with some words changed, some far, some near
        base = [rng.choice(words) for _ in range(rng.choice([3, 5, 20, 120, 400]))]
        for _ in range(rng.choice([1, 2, 5])):
            text = [rng.choice(words) if rng.random() < rng.choice([0, 0.01, 0.02, 0.1]) else w for w in base]
            rows.append((len(rows), " ".join(text)))
    rng.shuffle(rows)
    groups, pairs = jaccard_groups([t for _, t in rows])
    best = {}
    for k, (i, _) in enumerate(rows):
        best[groups.top(k)] = min(best.get(groups.top(k), i), i)
    assert len(pairs) > 30 and len(best) > 60
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash_dedup.drop_similar(df).collect()) == sorted(best.values())
    kept = simhash_dedup.drop_similar(docs)
    assert kept.columns == docs.columns and {r["__id"] for r in kept.collect()} == {9}
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 3, 4, 7, 8, 9, 10, 12]
    assert simhash_dedup.drop_similar(none).count() == 0


@pytest.mark.parametrize("drop", [simhash_dedup.drop_similar, simhash_dedup.drop_near_copies])
def test_near_copies_by_any_id(spark, drop):
    """Rows without an id are compared, repeated ids with different texts are rows of their own, full ties leave one row."""
    text, other = "some words that are here more than once in this table", "nothing at all of that kind is said in this other one"
    rows = [(None, text, 1), (None, text, 2), (5, text, 3), (5, other, 4), (5, other, 4), (None, other, 5), (6, "a third text that is like no other one in here", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, more int")
    assert sorted(tuple(r) for r in drop(df).collect()) == sorted([rows[2], rows[3], rows[6]])
    strings = df.withColumn("doc_id", F.col("doc_id").cast("string"))
    assert sorted(r.more for r in drop(strings).collect()) == [3, 4, 6]


def test_long_edit_distances_stop_early():
    rng = random.Random(5)
    for k in range(6):
        a = "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(600, 900)))
        b = "".join(rng.choice([c, c, c, c, "x", "", "yz"][: 4 + k // 2]) for c in a) if k < 4 else a[:300] + a[::-1]
        true = slow_distance(a, b)
        for most in (true - 30, true - 1, true, true + 1, true + 30):
            assert (line_dedup.edit_distance(a, b, most) <= most) == (true <= most)


def test_few_words_apart_bounds_the_distance():
    rng = random.Random(6)
    words = ["a", "bb", "ccc", "dddd", "eeeee", "of"]
    seen = Counter()
    for _ in range(400):
        a = [rng.choice(words) for _ in range(rng.randint(1, 25))]
        b = [w for w in a for w in ([rng.choice(words)] if rng.random() < 0.1 else [w, rng.choice(words)] if rng.random() < 0.05 else [] if rng.random() < 0.05 else [w])] or ["a"]
        a, b = " ".join(a), " ".join(b)
        true = slow_distance(a, b)
        for most in (0, 3, 8, 15):
            found = line_dedup.few_words_apart(a, b, most)
            assert not found or true <= most
            seen[found] += 1
    assert seen[True] > 300


def plain_lm(df, words):
    """The model's score of each text, without Spark: the same parameters, then a plain sum over tokens and classes."""
    training = df.filter(~lm_score.held_out(F.col("doc_id")))
    vocab = lm_score.vocabulary(lm_score.count_words(training, "text"), words)
    model, flat = lm_score.train(training, "doc_id", "text", vocab)
    r, q, c1, c2, bias = (x.astype(np.float64) for x in model.parts(flat))
    counts = Counter(w for row in training.collect() for w in (row.text or "").encode().lower().split() + [b"\n"])
    top = [w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:words]]
    class_of = lambda w: top.index(w) if w in top else len(top) + zlib.crc32(w[-2:]) % lm_score.RARE
    inside = Counter()
    for w, n in counts.items():
        inside[class_of(w)] += n + 1
    out = {}
    for row in df.collect():
        tokens, total, before = (row.text or "").encode().lower().split() + [b"\n"], 0.0, [model.n, model.n]
        for w in tokens:
            k = class_of(w)
            logits = (r[before[1]] @ c1 + r[before[0]] @ c2) @ q.T + bias
            total += (logits[k] - np.log(np.exp(logits).sum())) / np.log(10)
            if k >= len(top):  # unknown words of a class are one more
                total += np.log10((counts[w] + 1) / (inside[k] + 1))
            before = [before[1], k]
        out[row.doc_id] = total
    return out


def test_lm_score_against_a_plain_version(spark):
    df, rows = corpus(spark, 120)
    found = {r.doc_id: r.score for r in lm_score.score(df, words=30).collect()}
    want = plain_lm(df, 30)
    assert all(abs(found[k] - want[k]) < 1e-3 * (1 + abs(want[k])) for k in want)


def test_lm_score_is_the_same_however_rows_are_dealt(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    one, other = ({r.doc_id: r for r in lm_score.score(x).collect()} for x in (docs.repartition(1), docs.repartition(7, F.length("text"))))
    assert all(abs(one[k].score - other[k].score) <= 1e-9 * abs(one[k].score) for k in one)
    # held-out texts are the more probable for the model; a model of single words comes to base_score
    out = [r for r in one.values() if r.held_out]
    assert sum(r.score - r.base_score for r in out) > 0.01 * sum(r.n_tokens for r in out)  # 0.019 as measured


# op4 against a plain version


def plain_grams(text):
    """Counts of the character n-grams, as strings: letters in lower case, a blank for each run of other signs and at both ends."""
    words = "".join(c if c.isalpha() else " " for c in (text or "").lower())
    kept = "".join(c for k, c in enumerate(words) if c != " " or (k and words[k - 1] != " "))
    padded = f" {kept} "
    return Counter(padded[k : k + n] for n in (1, 2, 3) for k in range(len(padded) - n + 1)) if any(map(str.isalpha, kept)) else Counter()


def plain_ftrl(rows, classes, epochs):
    """FTRL-proximal with a dictionary a class, a feature at a time. rows: (label, {feature: value})."""
    alpha, beta, l1, l2 = 0.5, 1.0, 0.002, 0.01
    z, n = ([defaultdict(float) for _ in range(classes)] for _ in range(2))

    def weight(c, f):
        if abs(z[c][f]) <= l1:
            return 0.0
        return (np.sign(z[c][f]) * l1 - z[c][f]) / ((beta + np.sqrt(n[c][f])) / alpha + l2)

    for epoch in range(epochs):
        for k in np.random.default_rng(epoch).permutation(len(rows)):
            label, x = rows[k]
            w = [{f: weight(c, f) for f in x} for c in range(classes)]
            logits = np.array([sum(w[c][f] * v for f, v in x.items()) for c in range(classes)])
            p = np.exp(logits - logits.max())
            p /= p.sum()
            for c in range(classes):
                for f, v in x.items():
                    g = v * (p[c] - (c == label))
                    z[c][f] += g - (np.sqrt(n[c][f] + g * g) - np.sqrt(n[c][f])) / alpha * w[c][f]
                    n[c][f] += g * g
    return weight


def test_language_id_against_a_plain_version(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang")
    rows = docs.collect()
    train = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5]
    languages, grams = sorted({r.lang for r in train}), {r.doc_id: plain_grams(r.text) for r in rows}
    df = Counter(g for r in train for g in grams[r.doc_id])
    idf = {g: np.log((1 + len(train)) / (1 + k)) + 1 for g, k in df.items()}

    def vector(i):
        x = {g: (1 + np.log(k)) * idf.get(g, 0.0) for g, k in grams[i].items()}
        norm = np.sqrt(sum(v * v for v in x.values()))
        return {g: v / norm for g, v in x.items()}

    order = docs.select("doc_id", (F.abs(F.xxhash64(F.col("doc_id").cast("string"))) % F.lit(1 << 32)).alias("at")).collect()
    place = {r.doc_id: r["at"] for r in order}
    drawn = sorted((r for r in train if grams[r.doc_id]), key=lambda r: (place[r.doc_id], r.lang))
    fit = [(languages.index(r.lang), vector(r.doc_id)) for k, r in enumerate(drawn) if k % 5]
    weight = plain_ftrl(fit, len(languages), 3)
    found = {r.doc_id: r for r in language_id.identify(docs).collect()}
    same = right = held = 0
    for r in rows:
        x = vector(r.doc_id)
        logits = [sum(weight(c, g) * v for g, v in x.items()) for c in range(len(languages))]
        same += found[r.doc_id].lang_pred == languages[int(np.argmax(logits))]
        if found[r.doc_id].held_out:
            held += 1
            right += found[r.doc_id].lang_pred == r.lang
    # n-grams share hashed features in the operator alone
    assert same >= 0.99 * len(rows) and right >= 0.95 * held > 0


def test_too_many_languages_are_refused(spark):
    df = spark.createDataFrame([(k, "some words", f"l{k}") for k in range(20)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError):
        language_id.identify(df, sample_rows=5).collect()


# ids of other types, ties, sizes


@pytest.mark.parametrize("kind,ids", [("long", [(1 << 63) - 1, -(1 << 63), None]), ("string", ["b", "a", None])])
def test_exact_dedup_by_any_id(spark, kind, ids):
    df = spark.createDataFrame([(i, f"same{' ' * k}text", k) for k, i in enumerate([*ids, *ids])], f"doc_id {kind}, text string, more int")
    found = exact_dedup.exact_dedup(df).collect()
    assert {r.keep_id for r in found} == {None} and sorted(r.kept for r in found) == [False] * 5 + [True]  # the longest text has no id
    alike = df.withColumn("text", F.lit("same"))
    found = exact_dedup.exact_dedup(alike).collect()
    assert {r.keep_id for r in found} == {ids[1]} and sum(r.kept for r in found) == 1
    once = [tuple(r) for r in exact_dedup.drop_copies(alike).collect()]
    assert len(once) == 1 and once[0][0] == ids[1]
    assert all([tuple(r) for r in exact_dedup.drop_copies(alike.repartition(n, "more")).collect()] == once for n in (1, 3))


def test_ids_that_a_format_cannot_hold_are_refused(spark):
    df = spark.createDataFrame([("a", "http://a.org/", "x")], "page_id string, url string, html string")
    with pytest.raises(TypeError):
        warc.archive(df)
    with pytest.raises(TypeError):
        token_files.write_tokens(df, VOCABULARY, id_col="page_id", text_col="html")


def test_record_ids_differ(spark):
    rows = [(5, "http://a.org/", "same")] * 3 + [(5, "http://a.org/", "other")] * 2 + [(-(1 << 63), "http://a.org/", "same"), (None, "http://a.org/", "same"), (7, "http://a.org/", "own")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder, captures = warc.write_archives(df)
    reader = warc.IndexReader(warc.build_index(captures, folder))
    fields = [reader.read(f, o, n)[0] for _, _, f, o, n in reader.captures(warc.url_key("http://a.org/"))]
    ids = [x["WARC-Record-ID"] for x in fields]
    assert len(ids) == len(set(ids)) == len(rows)
    assert all(x["WARC-Refers-To"] in ids for x in fields if x["WARC-Type"] == "revisit")
    found = Counter((r.page_id, r.record_type, r.refers_to) for r in warc.archive(df).collect())
    assert found == Counter({(5, "response", None): 2, (5, "revisit", 5): 3, (-(1 << 63), "revisit", 5): 1, (None, "revisit", 5): 1, (7, "response", None): 1})


def test_slices_by_size():
    import pyarrow as pa

    from skeinworks.llm import common

    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(["a" * 10, None, "b" * 100, "c", "", "d" * 30])], ["k", "t"])
    assert [x.column(0).to_pylist() for x in common.slices(batch, 1, 4, 32)] == [[0, 1], [2], [3, 4, 5]]
    assert [x.num_rows for x in common.slices(batch, 1, 2, 1 << 20)] == [2, 2, 2]


def test_large_groups_of_near_copies(spark):
    """Thousands of lines and texts that are all alike: one group, by few tests of pairs."""
    rng = random.Random(12)
    base = [f"word{k}" for k in range(60)]
    rows = []
    for k in range(2500):
        words = list(base)
        words[rng.randrange(60)] = f"own{k}"
        rows.append((k, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = {r.doc_id: list(r.dropped) for r in line_dedup.dedup_lines(df).collect()}
    assert found.pop(0) == [] and all(v == [0] for v in found.values())
    kept = [r.doc_id for r in simhash_dedup.drop_similar(df).collect()]
    assert len(kept) == 1
