"""op11 against plain numpy over exact integers."""

import math
import os
import sys
from fractions import Fraction
from pathlib import Path

import numpy as np

sys.path[:0] = [str(Path(__file__).parent.parent.parent), str(Path(__file__).parent.parent)]

from oracle import DATA  # noqa: E402

from skeinworks.llm import queries, whitening  # noqa: E402

SCHEMA = "vec_id long, embedding array<float>, label int, n long, component int, x string, id long, state binary"


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, 1, 5, 6, "x", 7, b"") for i, v in vectors], SCHEMA).repartition(3)


def plain(vectors, components=16):
    """{id: [(component, n, deviation, whitened, explained)]} by exact covariance."""
    kept = [(i, [math.floor(64.0 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, d = len(fit), len(fit[0])
    s = [sum(x[k] for x in fit) for k in range(d)]
    y = np.array([[n * x[k] - s[k] for k in range(d)] for x in fit], object)
    v = np.array([[float(Fraction(int(c), n**3)) for c in row] for row in y.T.dot(y)])
    values, vectors_ = np.linalg.eigh(v)
    order = np.argsort(-values)[:components]
    out = []
    for i, x in kept:
        dev = [n * x[k] - s[k] for k in range(d)]
        z = np.array([float(Fraction(c, n)) for c in dev]) @ vectors_[:, order] / np.sqrt(values[order])
        out += [(i, k + 1, n, sum(c * c for c in dev), z[k], values[order][k] / values.sum()) for k in range(len(order))]
    return out


def same(found, expected):
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], r[3], abs(r[4]))
    found, expected = sorted(found, key=key), sorted(expected, key=key)
    assert [r[:4] for r in found] == [r[:4] for r in expected]
    assert np.allclose([abs(r[4]) for r in found], [abs(r[4]) for r in expected], rtol=1e-6, atol=1e-8)
    assert np.allclose([r[5] for r in found], [r[5] for r in expected], rtol=1e-6)


def test_query(spark):
    df = queries.op11_whitening(spark, DATA)
    assert df.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    found = [tuple(r) for r in df.collect()]
    rows = [tuple(r) for r in spark.read.parquet(os.path.join(DATA, "embeddings.parquet")).select("vec_id", "embedding").collect()]
    same(found, plain(rows))
    signs = {}
    for i, k, _, _, z, _ in plain(rows):
        signs[i, k] = z
    for k in range(1, 17):  # one sign for all rows of a component
        assert len({(r[4] > 0) == (signs[r[0], k] > 0) for r in found if r[1] == k and abs(r[4]) > 1e-9}) == 1
    errors = {r[6] for r in found}
    assert len(errors) == 1 and errors.pop() < 1e-9


def test_nulls_repeats_and_lengths(spark):
    rng = np.random.default_rng(3)
    good = [(k, [float(np.float32(c)) for c in rng.normal(size=5)]) for k in range(60)]
    good += [good[0], (None, good[1][1]), (61, good[1][1])] + [(100 + k, good[2][1]) for k in range(200)]
    bad = [(200, None), (201, [1.0, None, 1.0, 1.0, 1.0]), (202, [float("nan")] * 5), (203, [float("inf")] * 5), (204, [])]
    found = [tuple(r) for r in whitening.whiten(frame(spark, good + bad)).collect()]
    same([r[:6] for r in found], plain(good))
    assert {r[2] for r in found} == {60} and len(found) == len(good) * 5
    other = whitening.whiten(frame(spark, [*good, (300, [1.0, 2.0]), (301, [2.0, 1.5])]))
    assert {(r.vec_id, r.n) for r in other.collect() if r.vec_id in (300, 301)} == {(300, 2), (301, 2)}
    assert other.filter("vec_id < 60").count() == 61 * 5


def test_flat_and_empty(spark):
    assert whitening.whiten(frame(spark, [])).count() == 0
    rows = whitening.whiten(frame(spark, [(1, [0.5, 1.0]), (2, [0.5, 1.0])])).collect()
    assert [(r.vec_id, r.component, r.n, r.deviation, r.whitened) for r in sorted(rows)] == [(i, c, 1, 0, None) for i in (1, 2) for c in (1, 2)]
    flat = whitening.whiten(frame(spark, [(k, [float(k), 1.0]) for k in range(9)])).collect()
    assert all((r.whitened is None) == (r.component == 2) for r in flat) and all(r.identity_error < 1e-9 for r in flat)


def test_merge_is_exact_for_large_means():
    rng = np.random.default_rng(1)
    x = rng.integers(10**12, 10**12 + 50, size=(999, 4))
    state = {}
    for part in np.array_split(x, 7):
        state = whitening.merged(state, {4: whitening.moments(part)})
    n, sums, _, scatter = state[4]
    assert n == 999 and sums == [int(c) for c in x.sum(axis=0)]
    centred = x - 10**12
    centred = centred - centred.mean(axis=0)
    assert np.allclose(scatter, centred.T @ centred, rtol=1e-12)


def test_deviation_beyond_a_long():
    m = whitening.Model(1 << 40, [1_000_000 << 40] * 2, np.eye(2), 2)
    assert m.deviation(np.array([[1_000_000, 1_000_003], [1_000_000, 1_000_000]])) == [None, 0]
