"""LM scoring by a log-bilinear neural model that is trained in numpy with noise-contrastive estimation.

Tokens: a text's words in lower case, then one end token. The model predicts a token's class from the two tokens before
it: the class's score is the product of its vector with a linear map of their vectors, plus a bias. The WORDS most
frequent training tokens are classes of their own; each other word belongs to one of RARE classes by its last two bytes,
within which words have their add-one unigram probability, unknown words together that of one word. All add up to 1.

Counts cover every training text: they are combined in the map tasks and summed in a shuffle, at no point as a whole on
the driver or in one task. Training passes over every training text once, in ROUNDS rounds of a growing share. A round's
texts are dealt out to shards of about SHARD_TOKENS tokens by the hash of id and text, which also orders them, so that the
model is the same however the input is partitioned. Each shard is trained from the same parameters, and a shuffle averages
the results, weighted by tokens, in whole numbers, so that their order makes no difference. The
model has a fixed number of parameters. Batched matrix products give the log normaliser of every pair of context
classes once; scoring a token then takes three look-ups.

A text's base score needs the count of every word. The most frequent ones (HEAD at most) are at hand in the tasks; all other words
of a text are joined with the counts by word and summed up by text.

Nulls: a null text is empty and has the end token alone; a null id counts as the empty text for held_out. Repeated rows
are scored each. Without training texts all bases are log10(1/1). Empty input, empty result. Texts are used whole.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinworks.llm.common import id_bucket, written

END = b"\n"  # no word has white space
WORDS, RARE, DIM = 960, 64, 16
#: At most so many words are at hand in the tasks: those of the upper steps of frequency, 32 to a factor of e.
HEAD = 1 << 17
STEPS = 32
NOISE = 32
BATCH = 1024
RATE = 0.3
#: Shares of the training texts, in 64ths, that the rounds pass over.
ROUNDS = (4, 20, 40)
#: Tokens of a shard, unless there would be more than SHARDS of them.
SHARD_TOKENS, SHARDS = 1 << 20, 4096
#: Averages are sums of whole numbers, in units of 1 / FIXED for each SHARD_TOKENS tokens.
FIXED = 1 << 30
#: Distinct words that a map task counts before it hands them on.
COUNTED = 400_000
ROWS = 256
SEED = 42


def words_of(text: str | None) -> list[bytes]:
    """Words in lower case (A-Z alone), then the end token."""
    out = (text or "").encode().lower().split()
    out.append(END)
    return out


def rare_class(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % RARE


def held_out(id_col: Column) -> Column:
    return id_bucket(id_col, 7) == 2


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()

    def page() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], ["word", "n"])

    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            for text in batch.column(0).slice(at, ROWS):
                seen.update(words_of(text.as_py()))
            if len(seen) > COUNTED:
                yield page()
                seen = Counter()
    if seen:
        yield page()


@dataclass
class Vocabulary:
    """head: place of the most frequent words, in that order. counts: theirs. class_mass: of each class, with add-one."""

    head: dict[bytes, int]
    counts: np.ndarray
    n_words: int
    class_mass: np.ndarray
    tokens: int
    distinct: int
    least: int  # the words of this step of frequency and above are in the head, all others are not

    def __post_init__(self) -> None:
        self.classes = np.arange(len(self.head), dtype=np.int16)
        for word, place in self.head.items():
            if place >= self.n_words:
                self.classes[place] = self.n_words + rare_class(word)

    @property
    def n_classes(self) -> int:
        return self.n_words + RARE

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
        """(places in head or -1, classes, first token of each text, the words that have no place, in order)."""
        get, places, sizes, rest = self.head.get, [], [], []
        for text in texts:
            words = words_of(text)
            found = [get(w, -1) for w in words]
            if -1 in found:
                rest += [w for w, p in zip(words, found, strict=True) if p < 0]
            places += found
            sizes.append(len(words))
        at = np.array(places, np.int32)
        classes = self.classes[at] if len(self.classes) else np.zeros(len(at), np.int16)
        if rest:
            classes = classes.copy()
            classes[at < 0] = np.fromiter((self.n_words + zlib.crc32(w[-2:]) % RARE for w in rest), np.int16, len(rest))
        sizes = np.array(sizes)
        return at, classes, np.cumsum(sizes) - sizes, rest


def count_words(training: DataFrame, text_col: str) -> DataFrame:
    """(word binary, n) of all tokens, in the shared folder."""
    pairs = training.select(F.col(text_col).cast("string")).mapInArrow(_counted, "word binary, n long")
    return written(pairs.groupBy("word").agg(F.sum("n").alias("n")), "counts")


def _step() -> Column:
    """The step of a word's frequency on a logarithmic scale."""
    return F.floor(F.log("n") * STEPS).cast("int")


def vocabulary(counts: DataFrame, words: int = WORDS, head: int = HEAD) -> Vocabulary:
    totals = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    sizes = {r.step: r["count"] for r in counts.groupBy(_step().alias("step")).count().collect()}  # a few hundred rows
    least, held = max(sizes, default=0) + 1, 0
    for step in sorted(sizes, reverse=True):
        held += sizes[step]
        if held > head:
            break
        least = step
    found = counts.filter(_step() >= least).toPandas()  # at most `head` rows
    top = sorted(zip(found["n"].tolist(), map(bytes, found["word"]), strict=True), key=lambda x: (-x[0], x[1]))
    place = {w: k for k, (_, w) in enumerate(top)}
    n = np.array([x for x, _ in top], np.int64)
    own = min(words, len(n))
    rare = F.pmod(F.crc32(F.substring("word", -2, 2)), F.lit(RARE))
    mass = np.ones(own + RARE)
    mass[:own] = n[:own] + 1
    for r in counts.groupBy(rare.alias("k")).agg(F.sum(F.col("n") + 1).alias("mass")).collect():  # RARE rows
        mass[own + r.k] += r.mass
    for word, k in place.items():
        if k < own:
            mass[own + rare_class(word)] -= n[k] + 1
    return Vocabulary(place, n, own, mass, int(totals.n or 0), int(totals.v), least)


class Model:
    """Vectors of contexts and targets, a map for each context place, biases. Contexts have one class more: before the text."""

    def __init__(self, n_classes: int, dim: int = DIM) -> None:
        self.n, self.dim = n_classes, dim
        self.shapes = [(n_classes + 1, dim), (n_classes, dim), (dim, dim), (dim, dim), (n_classes,)]

    def first(self, mass: np.ndarray) -> np.ndarray:
        """Parameters at the start: small vectors, identity maps, the logarithms of the classes' shares."""
        rng = np.random.default_rng(SEED)
        r, q = (rng.normal(0, 0.1, s).astype(np.float32) for s in self.shapes[:2])
        eye = np.eye(self.dim, dtype=np.float32)
        return np.concatenate([r.ravel(), q.ravel(), eye.ravel(), eye.ravel() / 2, np.log(mass / mass.sum()).astype(np.float32)])

    def parts(self, flat: np.ndarray) -> list[np.ndarray]:
        cut = np.cumsum([0, *(int(np.prod(s)) for s in self.shapes)])
        return [flat[a:b].reshape(s) for a, b, s in zip(cut, cut[1:], self.shapes, strict=False)]


def _summed(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """The rows added up by place."""
    order = np.argsort(at, kind="stable")
    at = at[order]
    start = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    out = np.zeros((n, rows.shape[1]), rows.dtype)
    out[at[start]] = np.add.reduceat(rows[order], start)
    return out


class Nce:
    """Noise-contrastive estimation with Adagrad; a batch shares its noise."""

    def __init__(self, model: Model, flat: np.ndarray, noise: np.ndarray, seed: list[int]) -> None:
        self.model, self.flat = model, flat.copy()
        self.parts = model.parts(self.flat)
        self.past = np.full(len(flat), 1e-2, np.float32)
        self.noise = noise / noise.sum()
        self.upto, self.least = np.cumsum(self.noise), (np.log(self.noise) + np.log(NOISE)).astype(np.float32)
        self.rng = np.random.default_rng(seed)

    def learn(self, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> None:
        """A step on targets w after contexts a (next to it) and b."""
        r, q, c1, c2, bias = self.parts
        ra, rb = r[a], r[b]
        h = ra @ c1 + rb @ c2
        drawn = np.minimum(np.searchsorted(self.upto, self.rng.random(NOISE)), len(self.upto) - 1).astype(np.int16)
        qw, qn = q[w], q[drawn]
        gt = 1 / (1 + np.exp(-np.clip((h * qw).sum(1) + bias[w] - self.least[w], -30, 30))) - 1
        gn = 1 / (1 + np.exp(-np.clip(h @ qn.T + bias[drawn] - self.least[drawn], -30, 30)))
        dh = gt[:, None] * qw + gn @ qn
        dq = _summed(np.r_[w, drawn], np.concatenate([np.c_[gt[:, None] * h, gt], np.c_[gn.T @ h, gn.sum(0)]]), len(q))
        dr = _summed(np.r_[a, b], np.concatenate([dh @ c1.T, dh @ c2.T]), len(r))
        g = np.concatenate([dr.ravel(), dq[:, :-1].ravel(), (ra.T @ dh).ravel(), (rb.T @ dh).ravel(), dq[:, -1]]).astype(np.float32) / np.float32(len(w))
        self.past += g * g
        self.flat -= np.float32(RATE) * g / np.sqrt(self.past)


def contexts(classes: np.ndarray, first: np.ndarray, before: int) -> tuple[np.ndarray, np.ndarray]:
    """The classes one and two places before each token; `before` where the text begins."""
    a, b = np.roll(classes, 1), np.roll(classes, 2)
    a[first] = before
    b[first] = before
    later = first[np.diff(np.r_[first, len(classes)]) > 1] + 1
    b[later] = before
    return a, b


def _trained(model: Model, flat: np.ndarray, words: Vocabulary, round_: int):
    """Each shard's share of a round, from rows (shard, text) sorted by shard: (place, its parameter by its tokens, its tokens)."""

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str | None]]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                yield from zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in groupby(texts(batches), key=lambda row: row[0]):
            nce, n = Nce(model, flat, words.class_mass, [SEED, round_, shard]), 0
            while some := [text for _, text in islice(rows, ROWS)]:
                _, classes, first, _ = words.encode(some)
                a, b = contexts(classes, first, model.n)
                for k in range(0, len(classes), BATCH):
                    nce.learn(a[k : k + BATCH], b[k : k + BATCH], classes[k : k + BATCH])
                n += len(classes)
            value = np.rint(nce.flat.astype(np.float64) * (n / SHARD_TOKENS * FIXED)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(value), pa.array(np.full(len(flat), n, np.int64))], ["place", "value", "tokens"])

    return run


def train(training: DataFrame, id_col: str, text_col: str, words: Vocabulary, dim: int = DIM) -> tuple[Model, np.ndarray]:
    """The model's parameters after a pass over all training texts."""
    model = Model(words.n_classes, dim)
    flat = model.first(words.class_mass)
    text = F.col(text_col).cast("string")
    id_ = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    turn = F.pmod(F.xxhash64(id_), F.lit(sum(ROUNDS)))
    order = F.xxhash64(F.lit(SEED), id_, text)
    done = 0
    for k, share in enumerate(ROUNDS):
        n_shards = min(SHARDS, max(1, -(-words.tokens * share // (sum(ROUNDS) * SHARD_TOKENS))))
        some = training.filter((turn >= done) & (turn < done + share)).select(F.pmod(order, F.lit(n_shards)).alias("shard"), text.alias("text"), order.alias("order"))
        dealt = some.repartition(n_shards, "shard").sortWithinPartitions("shard", "order").select("shard", "text")
        sums = dealt.mapInArrow(_trained(model, flat, words, k), "place int, value long, tokens long").groupBy("place").agg(F.sum("value").alias("value"), F.sum("tokens").alias("tokens"))
        mean = sums.toPandas()  # a row per parameter
        if len(mean):
            flat = flat.copy()
            flat[mean["place"].to_numpy()] = (mean["value"].to_numpy() / mean["tokens"].to_numpy() * (SHARD_TOKENS / FIXED)).astype(np.float32)
        done += share
    return model, flat


def normalisers(spark, model: Model, flat: np.ndarray) -> np.ndarray:
    """The log normaliser after each pair of context classes: a row per class that stands next to the token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, q, c1, c2, bias = model.parts(flat)
        far = (r @ c2) @ q.T
        for batch in batches:
            places = batch.column(0).to_pylist()
            rows = []
            for a in places:
                logits = far + ((r[a] @ c1) @ q.T + bias)
                top = logits.max(1)
                rows.append(np.log(np.exp(logits - top[:, None]).sum(1)) + top)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float32()))], ["a", "z"])

    rows = spark.range(model.n + 1).withColumnRenamed("id", "a").mapInArrow(run, "a long, z array<float>").collect()  # (classes + 1) squared numbers
    out = np.empty((model.n + 1, model.n + 1), np.float32)
    for row in rows:
        out[row.a] = row.z
    return out


class Scorer:
    """Normalised log10 probabilities of classes, by table."""

    def __init__(self, model: Model, flat: np.ndarray, z: np.ndarray) -> None:
        r, q, c1, c2, bias = model.parts(flat)
        self.near, self.far, self.z, self.before = (r @ c1) @ q.T + bias, (r @ c2) @ q.T, z, model.n

    def log10(self, classes: np.ndarray, first: np.ndarray) -> np.ndarray:
        a, b = contexts(classes, first, self.before)
        return (self.near[a, classes] + self.far[b, classes] - self.z[a, b]).astype(np.float64) / np.log(10)


_SCORED = "uid long, n_tokens long, known long, base double, model double, words array<binary>, counts array<int>"


def _scored(model: Model, flat: np.ndarray, z: np.ndarray, words: Vocabulary):
    """Per text: what the head's words give, the classes' log probabilities, and the words that must be looked up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model, flat, z)
        own = np.log10(words.counts + 1.0)
        inside = np.where(np.arange(len(own)) < words.n_words, 0.0, own)
        below = np.r_[np.zeros(words.n_words), np.log10(words.class_mass[words.n_words :])]
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                at, classes, first, rest = words.encode(part.column(part.num_columns - 1).to_pylist())
                known = at >= 0
                here = lambda x: np.where(known, x[at], 0.0) if len(x) else np.zeros(len(at))
                base = np.add.reduceat(here(own), first)
                score = np.add.reduceat(scorer.log10(classes, first) + here(inside) - below[classes], first)
                ends = np.r_[first[1:], len(at)]
                each, upto = np.diff(np.r_[0, np.cumsum(~known)[ends - 1]]).tolist(), 0
                looked_up = []
                for n in each:
                    looked_up.append(Counter(rest[upto : upto + n]))
                    upto += n
                columns = [
                    pa.array(np.arange(uid, uid + part.num_rows)),
                    pa.array(ends - first),
                    pa.array(np.add.reduceat(known.astype(np.int64), first)),
                    pa.array(base),
                    pa.array(score),
                    pa.array([list(c.keys()) for c in looked_up], pa.list_(pa.binary())),
                    pa.array([list(c.values()) for c in looked_up], pa.list_(pa.int32())),
                ]
                uid += part.num_rows
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *columns], ["id", "held_out", *(x.split()[0] for x in _SCORED.split(", "))])

    return run


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, head: int = HEAD, dim: int = DIM) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row; learns from the rows not held out."""
    spark = df.sparkSession
    training = df.filter(~held_out(F.col(id_col)))
    counts = count_words(training, text_col)
    vocab = vocabulary(counts, words, head)
    model, flat = train(training, id_col, text_col, vocab, dim)
    z = normalisers(spark, model, flat)
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    scored = written(rows.mapInArrow(_scored(model, flat, z, vocab), f"id {kind}, held_out boolean, {_SCORED}"), "scored")
    rest = scored.select("uid", F.explode(F.arrays_zip("words", "counts")).alias("x")).select("uid", F.col("x.words").alias("word"), F.col("x.counts").alias("times"))
    found = rest.join(counts.filter(_step() < vocab.least), "word").groupBy("uid").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + F.lit(1.0))).alias("gain"))
    total = float(np.log10(vocab.tokens + vocab.distinct + 1))
    gain = F.coalesce("gain", F.lit(0.0))
    return scored.drop("words", "counts").join(found, "uid", "left").select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(vocab.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + gain - F.col("n_tokens") * F.lit(total)).alias("base_score"),
        (F.col("model") + gain).alias("score"),
    )
