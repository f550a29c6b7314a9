"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Each text becomes counts of hashed character n-grams (orders 1 to 3 within and across words; letters only, other signs
are one blank). Document frequencies are counted over all training documents in Spark. The regression is trained with
FTRL-proximal, whose elastic-net penalties leave few weights, on a sample of labelled documents: at most SAMPLE_ROWS in
all, equally many per language, chosen by a hash of the id; that bound is the operator's documented parameter. A part of
the sample is set aside to fit the temperature of the softmax. Weights travel to the tasks inside the function: at most
n_features x languages numbers, whatever the input.

Nulls: a null text, or one without a letter, is `und` with score 0. A null label trains nothing. Without any labelled
text everything is `und`. Long texts are used whole. Ties between languages go to the first by name. Repeated rows are
rows like any other. Empty input, empty result.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinworks.llm.common import id_bucket

FEATURES = 1 << 15
ORDERS = 3
SAMPLE_ROWS = 2000
CALIBRATION = 5  # one in so many sampled rows fits the temperature
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    """The code points that are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool)


def features(text: str | None, n_features: int = FEATURES) -> tuple[np.ndarray, np.ndarray]:
    """(features, counts) of a text's character n-grams; empty without a letter."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le"), np.uint32)
    letter = _letters()[points]
    if not letter.any():
        return np.empty(0, np.int32), np.empty(0, np.int32)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # of other signs the first after a letter stays, as a blank
    signs = np.where(letter, points, np.uint32(32))[keep]
    signs = np.concatenate(([np.uint32(32)], signs, [np.uint32(32)]))
    shift = np.uint32(32 - n_features.bit_length() + 1)
    grams, rolled = [], np.zeros(len(signs), np.uint32)
    for order in range(1, ORDERS + 1):
        rolled = (rolled[: len(signs) - order + 1] if order > 1 else rolled) * np.uint32(0x01000193)
        rolled = rolled + signs[order - 1 :]
        grams.append((rolled + np.uint32(order)) * np.uint32(0x9E3779B1) >> shift)
    grams = np.concatenate(grams)
    if len(grams) > n_features // 4:
        counts = np.bincount(grams, minlength=n_features)
        found = np.flatnonzero(counts)
        return found.astype(np.int32), counts[found].astype(np.int32)
    found, counts = np.unique(grams, return_counts=True)
    return found.astype(np.int32), counts.astype(np.int32)


def vector(found: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF of unit length; the term frequency is 1 + log."""
    x = (1 + np.log(counts)) * idf[found]
    norm = np.sqrt(x @ x)
    return x / norm if norm else x


class Ftrl:
    """Multinomial logistic regression by FTRL-proximal, a document at a time."""

    def __init__(self, n_features: int, n_classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.002, l2: float = 0.01) -> None:
        self.z, self.n = np.zeros((n_features, n_classes)), np.zeros((n_features, n_classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: slice | np.ndarray = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.sign(z) * self.l1 - z
        return np.where(np.abs(z) <= self.l1, 0.0, shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        p = softmax(x @ w)
        p[label] -= 1
        g = np.outer(x, p)
        n = self.n[at]
        more = n + g * g
        self.z[at] += g - (np.sqrt(more) - np.sqrt(n)) / self.alpha * w
        self.n[at] = more


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, by golden section over its logarithm.

    As in Platt's scaling, a label counts for a little less than 1, so that few documents without a miss don't make every
    score 1.
    """
    if not len(labels) or logits.shape[1] < 2:
        return 1.0
    spare = 1 / (len(labels) + 2)
    wanted = np.full(logits.shape, spare / (logits.shape[1] - 1))
    wanted[np.arange(len(labels)), labels] = 1 - spare

    def loss(t: float) -> float:
        scaled = logits / np.exp(t)
        top = scaled.max(axis=1, keepdims=True)
        log_p = scaled - top - np.log(np.exp(scaled - top).sum(axis=1, keepdims=True))
        return float(-(wanted * log_p).sum(axis=1).mean())

    low, high, ratio = np.log(0.02), np.log(10.0), (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


class Model:
    def __init__(self, languages: list[str], idf: np.ndarray, weights: np.ndarray, heat: float) -> None:
        self.languages, self.idf, self.weights, self.heat = languages, idf.astype(np.float32), weights.astype(np.float32), heat

    def predict(self, text: str | None) -> tuple[str, float]:
        found, counts = features(text, len(self.idf))
        if not len(found) or not self.languages:
            return UNKNOWN, 0.0
        p = softmax((vector(found, counts, self.idf) @ self.weights[found]).astype(np.float64) / self.heat)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def _counted(n_features: int):
    """Documents per feature of a partition: one row per feature that occurs, and their number under -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(n_features, np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                found, _ = features(text.as_py(), n_features)
                seen[found] += 1
                n += 1
        at = np.flatnonzero(seen)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, at], pa.int32()), pa.array(np.r_[n, seen[at]])], ["feature", "n"])

    return run


def _sampled(n_features: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t.as_py(), n_features) for t in batch.column(2)]
            columns = [batch.column(0), batch.column(1), pa.array([r[0] for r in rows], pa.list_(pa.int32())), pa.array([r[1] for r in rows], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["at", "lang", "found", "counts"])

    return run


def train(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, n_features: int = FEATURES, sample_rows: int = SAMPLE_ROWS, epochs: int = 3) -> Model:
    """Document frequencies over all of `labelled`, weights from at most `sample_rows` of its rows.

    Every language has its share of the sample; more languages than `sample_rows` are refused.
    """
    rows = labelled.filter(F.col(lang_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    stats = rows.select("text").mapInArrow(_counted(n_features), "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    per_lang = {r.lang: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(sample_rows + 1).collect()}
    if len(per_lang) > sample_rows:
        raise ValueError(f"there are more than {sample_rows} languages; sample_rows must be larger")
    languages = sorted(per_lang)
    idf = np.zeros(n_features)
    if not languages:
        return Model([], idf, np.zeros((n_features, 0)), 1.0)
    df = stats.toPandas()  # n_features + 1 rows at most
    at, n = df["feature"].to_numpy(), df["n"].to_numpy()
    total = int(n[at == -1].sum())
    idf[at[at >= 0]] = np.log((1 + total) / (1 + n[at >= 0])) + 1
    share = max(1, sample_rows // len(languages))
    place = F.abs(F.xxhash64(F.coalesce("id", F.lit("")))) % F.lit(1 << 32)
    limit = F.create_map(*[F.lit(x) for k, v in per_lang.items() for x in (k, float(min(1.0, share / v)) * (1 << 32))])
    sample = rows.withColumn("at", place).filter(F.col("at") < F.element_at(limit, F.col("lang"))).orderBy("at", "id").limit(sample_rows)
    drawn = sorted(sample.select("at", "lang", "text").mapInArrow(_sampled(n_features), "at long, lang string, found array<int>, counts array<int>").toPandas().itertuples(), key=lambda r: (r.at, r.lang))
    code = {lang: k for k, lang in enumerate(languages)}
    data = [(np.asarray(r.found), np.asarray(r.counts), code[r.lang]) for r in drawn if len(r.found)]
    vectors = [(f, vector(f, c, idf), y) for f, c, y in data]
    fit = [v for k, v in enumerate(vectors) if k % CALIBRATION]
    aside = [v for k, v in enumerate(vectors) if not k % CALIBRATION]
    model = Ftrl(n_features, len(languages))
    for epoch in range(epochs):
        for k in np.random.default_rng(epoch).permutation(len(fit)):
            model.learn(*fit[k])
    weights = model.weights()
    logits = np.array([x @ weights[f] for f, x, _ in aside]).reshape(len(aside), len(languages))
    return Model(languages, idf, weights, temperature(logits, np.array([y for *_, y in aside], int)))


def predict(df: DataFrame, model: Model, text_col: str) -> DataFrame:
    """`df` with lang_pred and score: one Arrow pass over (place, text), other columns go along untouched."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found = [model.predict(t.as_py()) for t in texts]
            yield pa.StructArray.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["lang_pred", "score"])

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    guess = F.arrow_udf(run, "lang_pred string, score double")
    return df.withColumn("__guess", guess(F.col(text_col).cast("string"))).withColumns({"lang_pred": F.col("__guess.lang_pred"), "score": F.col("__guess.score")}).drop("__guess")


def held_out(id_col: Column) -> Column:
    """Whether a document takes no part in learning."""
    return id_bucket(id_col, 5) == 0


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **settings) -> DataFrame:
    """id, held_out, lang_pred, score for each row; learns from the rows that are not held out."""
    model = train(df.filter(~held_out(F.col(id_col))), id_col, text_col, lang_col, **settings)
    rows = df.select(F.col(id_col).alias("__id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("__text"))
    return predict(rows, model, "__text").select(F.col("__id").alias(id_col), "held_out", "lang_pred", "score")


def keep_identified(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **settings) -> DataFrame:
    """The rows whose text has a language, with their columns: those that are `und` go."""
    model = train(df.filter(~held_out(F.col(id_col))), id_col, text_col, lang_col, **settings)
    columns = [F.col(c).alias(f"__{k}") for k, c in enumerate(df.columns)]
    found = predict(df.select(*columns), model, f"__{df.columns.index(text_col)}").filter(F.col("lang_pred") != UNKNOWN)
    return found.select(*[F.col(f"__{k}").alias(c) for k, c in enumerate(df.columns)])
