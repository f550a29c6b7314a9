"""Whitening of embeddings by their covariance, merged pairwise from partitions.

Each partition holds (count, sums, centred scatter) of its vectors, batch by batch, and Chan's formula merges two of them:
the scatters add up, plus the outer product of the means' difference times n_a * n_b / (n_a + n_b). treeReduce merges those of
all partitions, so the driver gets one d x d matrix, whatever the number of rows, and takes its eigenvectors. A second
pass whitens the fit list and measures how far its covariance is from the identity, by the same merge.

Vectors are whole numbers x = floor(scale * c) + shift, so sums are exact and the fit list, each distinct x vector once, is well
defined. It is written to the shared folder: both passes read it there. Sums are kept as Python integers once they pass 62 bits.

Nulls: vectors that are null or hold null, NaN or infinite entries are left out, and so are those with an entry whose x passes
2**53, which a double can't hold exactly. A null id is an id. Repeated rows count once in the fit and are all returned.
Vectors of another length are a space of their own, with a fit of its own; an empty vector has no component and no row.
A component without variance has a null `whitened`. A deviation that passes 63 bits is null. Empty input, empty result.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinworks.llm.common import written

SCALE, SHIFT = 64.0, 1_000_000
#: Components that are returned.
COMPONENTS = 16
#: Share of the largest eigenvalue below which a component has no variance, per dimension.
FLAT = 1e-14

#: Per length of vectors: count, exact sums, mean and centred scatter.
State = dict[int, tuple[int, list[int], np.ndarray, np.ndarray]]


def moments(x: np.ndarray) -> tuple[int, list[int], np.ndarray, np.ndarray]:
    """Count, sums, mean and centred scatter of the rows of x (whole numbers)."""
    n = len(x)
    sums = _sums(x)
    mean = np.array([s / n for s in sums])
    centred = _centred(x, n, sums)
    return n, sums, mean, centred.T @ centred


def _sums(x: np.ndarray) -> list[int]:
    # two halves, so that neither sum passes 63 bits for any batch that fits in memory
    high, low = x >> 26, x & ((1 << 26) - 1)
    return [(int(h) << 26) + int(v) for h, v in zip(high.sum(axis=0), low.sum(axis=0), strict=True)]


def _scaled(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact: as longs where they fit, else as Python integers."""
    most = max([0, *map(abs, sums)])
    if x.size == 0 or n * max(int(x.max()), -int(x.min()), 1) + most < 1 << 62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return (_scaled(x, n, sums) / n).astype(np.float64)


def merged(a: State, b: State) -> State:
    """Chan's pairwise merge."""
    out = dict(a)
    for d, (n, sums, mean, scatter) in b.items():
        if d in out:
            m, sums_m, mean_m, scatter_m = out[d]
            # from exact sums: the difference of two means near a large number would lose digits
            delta = np.array([(s * m - t * n) / (n * m) for s, t in zip(sums, sums_m, strict=True)])
            both = n + m
            sums = [s + t for s, t in zip(sums, sums_m, strict=True)]
            scatter = scatter + scatter_m + np.outer(delta, delta) * (n * m / both)
            n, mean = both, np.array([s / both for s in sums])
        out[d] = (n, sums, mean, scatter)
    return out


def merged_real(a: State, b: State) -> State:
    """The same merge for real vectors, whose means are what they are."""
    out = dict(a)
    for d, (n, _, mean, scatter) in b.items():
        if d in out:
            m, _, mean_m, scatter_m = out[d]
            delta, both = mean - mean_m, n + m
            scatter = scatter + scatter_m + np.outer(delta, delta) * (n * m / both)
            n, mean = both, mean_m + delta * (n / both)
        out[d] = (n, [], mean, scatter)
    return out


def _by_length(x: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, their matrix) for each length of the lists."""
    ends = x.offsets.to_numpy()
    flat = x.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(ends)
    for d in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == d)
        yield d, rows, flat[ends[:-1][rows][:, None] + np.arange(d)]


class Model:
    """What whitening needs of one length: n, sums, eigenvectors by falling eigenvalue, eigenvalues, trace."""

    def __init__(self, n: int, sums: list[int], scatter: np.ndarray, components: int):
        cov = scatter / n
        values, vectors = np.linalg.eigh((cov + cov.T) / 2)
        order = np.argsort(-values, kind="stable")[:components]
        self.n, self.sums, self.trace = n, sums, float(np.trace(cov))
        self.values, self.vectors = np.maximum(values[order], 0.0), vectors[:, order]
        self.flat = self.values <= FLAT * len(cov) * max(float(values.max(initial=0.0)), 0.0)
        self.error = 0.0

    def whiten(self, x: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.flat, np.nan, _centred(x, self.n, self.sums) @ self.vectors / np.sqrt(self.values))

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - S)^2, exact."""
        y = _scaled(x, self.n, self.sums)
        if y.dtype == object or y.size and max(int(y.max()), -int(y.min())) ** 2 * x.shape[1] >= 1 << 63:
            return [None if v >= 1 << 63 else v for v in (sum(int(v) ** 2 for v in row) for row in y)]
        return (y * y).sum(axis=1).tolist()


def _reduced(fit: DataFrame, of: Callable[[int, np.ndarray], tuple], merge: Callable[[State, State], State]) -> State:
    """The merged state of all partitions; a partition without rows has none."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: State = {}
        for batch in batches:
            state = merge(state, {d: of(d, x) for d, _, x in _by_length(batch.column(0)) if d})
        if state:
            yield pa.RecordBatch.from_pydict({"state": [pickle.dumps(state)]})

    def joined(a: bytes, b: bytes) -> bytes:
        return pickle.dumps(merge(pickle.loads(a), pickle.loads(b)))

    states = fit.select("x").mapInArrow(part, "state binary").rdd.map(lambda r: bytes(r[0]))
    # an empty state stands for no partition at all
    return pickle.loads(states.union(fit.sparkSession.sparkContext.parallelize([pickle.dumps({})], 1)).treeReduce(joined, 3))


def whole_numbers(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """`id`, `x`: the vectors that remain, as arrays of longs."""
    c = F.col(vector_col)
    ok = c.isNotNull() & F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(F.lit(SCALE) * v.cast("double")) < float(2**53 - SHIFT)))
    return df.filter(ok).select(F.col(id_col).alias("id"), F.transform(c, lambda v: F.floor(F.lit(SCALE) * v.cast("double")).cast("long") + F.lit(SHIFT).cast("long")).alias("x"))


def fit(df: DataFrame, components: int = COMPONENTS) -> dict[int, Model]:
    """The model of each length; df has the fit list's distinct vectors in `x`."""
    models = {d: Model(n, sums, scatter, components) for d, (n, sums, _, scatter) in _reduced(df, lambda d, x: moments(x), merged).items()}

    def whitened(d: int, x: np.ndarray) -> tuple[int, list[int], np.ndarray, np.ndarray]:
        z = models[d].whiten(x)[:, ~models[d].flat]
        mean = z.mean(axis=0)
        return len(z), [], mean, (z - mean).T @ (z - mean)

    for d, (n, _, _, scatter) in _reduced(df, whitened, merged_real).items() if models else ():
        models[d].error = float(np.abs(scatter / n - np.eye(len(scatter))).max(initial=0.0))
    return models


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Per remaining row and component: the id, component from 1, n, deviation, whitened, explained, identity_error."""
    rows = whole_numbers(df, id_col, vector_col)
    models = fit(written(rows.select("x").distinct(), "vectors"), components)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 1024):
                batch = whole.slice(k, 1024)
                ids = batch.column(0)
                for d, at, x in _by_length(batch.column(1)):
                    if not d or not len(at):
                        continue
                    m = models[d]
                    wide = m.whiten(x)
                    n_rows, c = wide.shape
                    yield pa.RecordBatch.from_arrays(
                        [
                            ids.take(pa.array(np.repeat(at, c))),
                            pa.array(np.tile(np.arange(1, c + 1, dtype=np.int32), n_rows)),
                            pa.array(np.full(n_rows * c, m.n, np.int64)),
                            pa.array(m.deviation(x), pa.int64()).take(pa.array(np.repeat(np.arange(n_rows), c))),
                            pa.array(wide.ravel(), from_pandas=True),
                            pa.array(np.tile(m.values / m.trace if m.trace > 0 else np.zeros(c), n_rows)),
                            pa.array(np.full(n_rows * c, m.error)),
                        ],
                        names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"],
                    )

    kind = df.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(apply, f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
