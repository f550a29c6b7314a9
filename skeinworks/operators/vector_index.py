"""Vector search that prunes by the triangle inequality, exact.

Unit vectors are dealt to the nearest of some centroids; a cell knows its centroid, its radius and how many vectors it has.
For a query at an angle a from a centroid of radius r (angles on the sphere are a metric) no vector of the cell is nearer than
a - r, so a cell whose cos(a - r) is below what a result must have is not read. Cells are folders, so that the reader leaves out their
files. What is read is scored as retrieval.cosine does: results equal a scan's.

The vectors of a cell and the queries that read it meet in chunks of bounded size. A matrix product tells which pairs of a chunk
may be among the best of a query; only these get their exact cosine, added up in the order of a scan.

The centroids are a sample of at most CENTROIDS different vectors, taken by hash: they decide how much is pruned and never what is found.
Vectors that are null, of length zero, not finite or of another length than the centroids are in a cell of their own, read by every
search, as their cosine follows no geometry here (0 where a length is zero; null vectors are left out).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from skeinworks.operators.retrieval import FLOOR, MOST, RELATIVE
from skeinworks.sources.tables import new_folder, stored

#: Centroids at most; an index has about one to PER vectors.
CENTROIDS, PER = 256, 200
#: What rounding may add to an angle or a cosine, and the least product of lengths for which that holds.
SLACK, TINY = 1e-6, 1e-280
#: Vectors and queries that meet in one chunk, about; pairs that a task looks at together; queries that meet all cells together.
VECTORS, QUERIES, PAIRS, TOGETHER = 4096, 2048, 1 << 20, 128


def unit(vector: Column) -> Column:
    """The vector at length 1; null where it has none or isn't finite."""
    x = vector.cast("array<double>")
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v))
    return F.when((norm > 0) & (norm < float("inf")), F.transform(x, lambda v: v / norm))


def _matrices(vectors: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each length the places of the vectors that have it and no nulls, and these vectors as rows of doubles."""
    sizes = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat, owner = pc.list_flatten(vectors), pc.list_parent_indices(vectors).to_numpy(zero_copy_only=False)
    sizes[owner[flat.is_null().to_numpy(zero_copy_only=False)]] = -1
    out = {}
    for n in np.unique(sizes[sizes > 0]).tolist():
        values = flat.filter(pa.array(sizes[owner] == n)).cast(pa.float64())
        out[n] = np.flatnonzero(sizes == n), values.to_numpy(zero_copy_only=False).reshape(-1, n)
    return out


def _dots(x: np.ndarray, y: np.ndarray, a: np.ndarray | slice = slice(None), b: np.ndarray | slice = slice(None)) -> np.ndarray:
    """The products of rows a of x and b of y, added up from the first entry on as a scan does."""
    total = np.zeros(len(x[a, 0]))
    for k in range(x.shape[1]):
        total += x[a, k] * y[b, k]
    return total


def _nearest(centroids: list[list[float]]) -> Callable[[Column], Column]:
    """The cell of the nearest centroid and the angle to it; -1 and null for vectors that follow no geometry."""
    middles = np.array(centroids)

    @F.arrow_udf("struct<cell: int, angle: double>")
    def nearest(vectors: pa.Array) -> pa.Array:
        cell, angle = np.full(len(vectors), -1, np.int32), np.zeros(len(vectors))
        if len(middles) and middles.shape[1] in (found := _matrices(vectors)):
            places, x = found[middles.shape[1]]
            norm = np.sqrt(_dots(x, x))
            fit = np.flatnonzero((norm > np.sqrt(TINY)) & (norm < np.inf))
            near = (x[fit] / norm[fit, None]) @ middles.T
            cell[places[fit]] = near.argmax(axis=1)
            angle[places[fit]] = np.arccos(np.clip(near.max(axis=1, initial=-1.0), -1, 1))
        return pa.StructArray.from_arrays([pa.array(cell), pa.array(angle, mask=cell < 0)], ["cell", "angle"])

    return nearest


def _bounds(cells: list[tuple[int, int, float | None, list[float] | None]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(id, vector) to (id, vector, cell, n, bound, first) of the cells (cell, n, radius, centroid) that can reach the floor."""
    number, size = np.array([c[0] for c in cells], np.int32), np.array([c[1] for c in cells], np.int64)
    lengths = np.array([len(c[3]) if c[2] is not None and c[3] else 0 for c in cells])

    def page(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for n, (places, x) in _matrices(part.column(1)).items():
            norm = np.sqrt(_dots(x, x))
            bound = np.ones((len(x), len(cells)))
            some, fit = np.flatnonzero(lengths == n), np.flatnonzero((norm > np.sqrt(TINY)) & (norm < np.inf))
            if len(some) and len(fit):
                middles, radius = np.array([cells[k][3] for k in some]), np.array([cells[k][2] for k in some])
                apart = np.arccos(np.clip((x[fit] / norm[fit, None]) @ middles.T, -1, 1)) - radius - SLACK
                bound[np.ix_(fit, some)] = np.where(apart > 0, np.cos(np.minimum(apart, np.pi)), 1.0)
            first = np.zeros(bound.shape, bool)
            np.put_along_axis(first, np.argsort(-bound, axis=1, kind="stable")[:, :2], True, axis=1)
            q, c = np.nonzero((bound >= FLOOR - SLACK) & ~(norm == 0)[:, None])
            at = pa.array(places[q])
            yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), pa.array(number[c]), pa.array(size[c]), pa.array(bound[q, c]), pa.array(first[q, c])], [*part.schema.names, "cell", "n", "bound", "first"])

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                yield from page(batch.slice(at, TOGETHER))

    return bounds


def _best_of_chunk(names: tuple[str, str, str], columns: list[str], then: tuple[str, ...], most: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """For queries and rows of a chunk: the `most` best rows of each query by score and `then`, at `__least` or more."""
    id_col, query_col, vector_col = names

    def best(queries: pa.Table, rows: pa.Table) -> pa.Table:
        asked, held = (_matrices(t.column(c).combine_chunks()) if t.num_rows else {} for t, c in ((queries, query_col), (rows, vector_col)))
        out = []
        for n in asked.keys() & held.keys():
            (places, x), (at, y) = asked[n], held[n]
            long_x, long_y = np.sqrt(_dots(x, x)), np.sqrt(_dots(y, y))
            least = queries.column("__least").to_numpy()[places]
            step = max(1, PAIRS // len(y))
            for k in range(0, len(x), step):
                with np.errstate(all="ignore"):
                    norm = long_x[k : k + step, None] * long_y
                    near = x[k : k + step] @ y.T / norm
                    near[norm < TINY] = np.nan  # looked at exactly, as what isn't finite
                    near[norm == 0] = -2
                    enough = least[k : k + step, None]
                    if len(y) > most:
                        enough = np.maximum(enough, np.partition(near, len(y) - most, axis=1)[:, [len(y) - most]])
                    q, r = np.nonzero(~(near < enough - SLACK) & (norm != 0))
                    score = _dots(x, y, k + q, r) / norm[q, r]
                kept = np.flatnonzero(~(score < FLOOR))
                q, r, score = k + q[kept], r[kept], score[kept]
                order = pa.table({"q": q, "s": np.where(np.isnan(score), -np.inf, -score), **{f"t{j}": rows.column(c).take(pa.array(at[r])) for j, c in enumerate(then)}})
                sorted_ = pc.sort_indices(order, [(c, "ascending") for c in order.column_names], null_placement="at_start").to_numpy()
                q, r, score = q[sorted_], r[sorted_], score[sorted_]
                top = np.arange(len(q)) - np.searchsorted(q, q) < most
                out.append((places[q[top]], at[r[top]], score[top]))
        q, r, score = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
        q, r = pa.array(q), pa.array(r)
        return pa.table([queries.column(id_col).take(q), *[rows.column(c).take(r) for c in columns], pa.array(score)], names=[id_col, *columns, "score"])

    return best


class VectorIndex:
    """An index in a folder: `cell=C` with the rows, and `cells` with centroid, radius (as an angle) and size of each."""

    def __init__(self, spark: SparkSession, folder: str, schema: StructType, vector_col: str) -> None:
        self.vector_col = vector_col
        self.rows = spark.read.schema(schema).parquet(f"{folder}/rows")
        self.cells = spark.read.parquet(f"{folder}/cells")

    @classmethod
    def build(cls, df: DataFrame, vector_col: str, folder: str | None = None) -> VectorIndex:
        spark, path = df.sparkSession, folder or new_folder(df.sparkSession, "vectors")
        wanted = max(1, min(CENTROIDS, df.count() // PER))
        sample = df.select(vector_col).distinct().select(unit(F.col(vector_col)).alias("__unit")).filter("__unit is not null")
        centroids = [r[0] for r in sample.orderBy(F.xxhash64("__unit")).limit(wanted).collect()]
        centroids = [c for c in centroids if len(c) == len(centroids[0])]
        dealt = df.filter(F.col(vector_col).isNotNull()).withColumn("__near", _nearest(centroids)(F.col(vector_col)))
        kept = dealt.select(*df.columns, F.col("__near.cell").alias("cell"), F.col("__near.angle").alias("__angle"))
        # rows of a large cell go to several tasks, all of which write to its folder
        kept.repartition("cell", F.pmod(F.xxhash64(vector_col), F.lit(8))).write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
        written = spark.read.schema(kept.schema).parquet(f"{path}/rows").groupBy("cell").agg(F.count("*").alias("n"), F.max("__angle").alias("radius"))
        named = spark.createDataFrame([(k, c) for k, c in enumerate(centroids)] or [(-2, [])], "cell int, centroid array<double>")
        written.join(named, "cell", "left").coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")
        return cls(spark, path, kept.schema, vector_col)

    def _pairs(self, queries: DataFrame, id_col: str, query_col: str) -> DataFrame:
        """(id, vector, cell, n, bound, first): the largest cosine that a vector of each cell can have with each query.

        Cells out of reach of the floor are left out; `first` are the two with the best bounds.
        """
        cells = [tuple(r) for r in self.cells.select("cell", "n", "radius", "centroid").orderBy("cell").collect()]  # CENTROIDS + 1 rows at most
        asked = queries.select(id_col, query_col)
        schema = StructType(list(asked.schema.fields)).add("cell", "integer").add("n", "long").add("bound", "double").add("first", "boolean")
        return asked.mapInArrow(_bounds(cells), schema)

    def _scored(self, pairs: DataFrame, id_col: str, query_col: str, then: tuple[str, ...], most: int) -> DataFrame:
        """(id, rows' columns, score) of the `most` best of each query in each chunk that it meets. pairs: id, vector, cell, n, __least."""
        columns = [c for c in self.rows.columns if c not in ("cell", "__angle")]
        parts = lambda n, size: F.ceil(n / size).cast("int")
        cells = pairs.groupBy("cell").agg(parts(F.max("n"), VECTORS).alias("__v_parts"), parts(F.count("*"), QUERIES).alias("__q_parts"))
        cells = F.broadcast(cells)  # CENTROIDS + 1 rows at most
        hashed = [f.name for f in self.rows.schema.fields if f.name in columns and "map<" not in f.dataType.simpleString()]
        chunk = lambda parts, *of: F.pmod(F.xxhash64(*of), F.col(parts)).cast("int")
        each = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
        left = pairs.join(cells, "cell").select("cell", chunk("__q_parts", id_col).alias("__q"), each("__v_parts").alias("__v"), id_col, query_col, "__least")
        right = self.rows.join(cells, "cell").select("cell", each("__q_parts").alias("__q"), chunk("__v_parts", *hashed).alias("__v"), *columns)
        schema = StructType([pairs.schema[id_col], *[self.rows.schema[c] for c in columns]]).add("score", DoubleType())
        best = _best_of_chunk((id_col, query_col, self.vector_col), columns, then, most)
        key = ("cell", "__q", "__v")
        return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(best, schema)

    def _wanted(self, queries: DataFrame, id_col: str, query_col: str, most: int) -> DataFrame:
        """The pairs of queries and cells that are read, with `__least`, which a result has at least.

        The cells with the best two bounds give each query a best score and a `most`-th score so far; a cell is read if it can
        reach the floor, RELATIVE times that best and that `most`-th score.
        """
        pairs, _ = stored(self._pairs(queries, id_col, query_col), "cells")
        first = pairs.filter("first").withColumn("__least", F.lit(FLOOR))
        best = self._scored(first, id_col, query_col, (), most).select(id_col, "score")
        rank = F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc("score")))
        so_far = best.withColumn("__rank", rank).filter(F.col("__rank") <= most).groupBy(id_col)
        so_far = so_far.agg((RELATIVE * F.max("score")).alias("__best"), F.when(F.count("*") == most, F.min("score")).alias("__last"))
        least = F.greatest(F.lit(FLOOR), F.col("__best"), F.col("__last")) - SLACK  # nulls don't count
        return pairs.join(so_far, id_col, "left").withColumn("__least", least).filter(F.col("bound") >= F.col("__least")).drop("__best", "__last", "first")

    def search(self, queries: DataFrame, id_col: str, query_col: str, k: int = MOST, *then: str) -> DataFrame:
        """What retrieval.vector_search gives for each of the queries (id, vector): its id, the rows' columns and `score`.

        The queries are a stated set, ids are keys; a null or zero query finds nothing. Columns of rows and queries must differ.
        """
        most = min(k, MOST)
        wanted, _ = stored(self._wanted(queries, id_col, query_col, most), "wanted")
        scored = self._scored(wanted, id_col, query_col, then, most)
        by_query = Window.partitionBy(id_col)
        ranked = scored.withColumn("__rank", F.row_number().over(by_query.orderBy(F.desc("score"), *then))).withColumn("__best", F.max("score").over(by_query))
        return ranked.filter((F.col("__rank") <= most) & (F.col("score") >= RELATIVE * F.col("__best"))).select(id_col, *[c for c in self.rows.columns if c not in ("cell", "__angle")], "score")

    def share_read(self, queries: DataFrame, id_col: str, query_col: str, k: int = MOST) -> float:
        """The share of all pairs of queries and vectors that a search looks at."""
        read = self._wanted(queries, id_col, query_col, min(k, MOST)).agg(F.sum("n")).first()[0] or 0
        return read / max(1, queries.count() * (self.cells.agg(F.sum("n")).first()[0] or 0))
