"""Snapshots in buckets of the key: a change rewrites the buckets that it touches, all other files stay.

    rows/v=V/bucket=B   a bucket as version V left it
    manifest/v=V        (bucket, version) of all buckets; written last, so that a version is there whole or not at all

Operators of merge.py do the work, on the touched buckets alone: a key is in the same bucket in either snapshot. Null keys share a
bucket. A reader sees the version that was last when it began.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinworks.operators import merge
from skeinworks.sources.tables import new_folder

#: Buckets of a table: as many as leave a bucket some hundred MB at the size that the table will have.
BUCKETS = 64


class Snapshot:
    def __init__(self, spark: SparkSession, folder: str, keys: list[str], buckets: int) -> None:
        self.spark, self.folder, self.keys, self.buckets = spark, folder, keys, buckets

    @classmethod
    def create(cls, df: DataFrame, keys: list[str], buckets: int = BUCKETS, folder: str | None = None) -> Snapshot:
        made = cls(df.sparkSession, folder or new_folder(df.sparkSession, "snapshot"), keys, buckets)
        made.schema = df.schema
        made._write(df, 0)
        made._commit(0, {b: 0 for b in made._written(0)})
        return made

    def _bucket(self) -> F.Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, version: int) -> None:
        dealt = rows.select(*self.schema.names).withColumn("bucket", self._bucket())
        dealt.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/rows/v={version}")

    def _written(self, version: int) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/rows/v={version}")
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(path)
        return [int(f.getPath().getName()[7:]) for f in found if f.getPath().getName().startswith("bucket=")]

    def _commit(self, version: int, where: dict[int, int]) -> None:
        rows = self.spark.createDataFrame(sorted(where.items()), "bucket int, version int")
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifest/v={version}")

    def _last(self) -> tuple[int, dict[int, int]]:
        rows = self.spark.read.parquet(f"{self.folder}/manifest")
        last = rows.agg(F.max("v")).first()[0]
        # `buckets` rows at most; a version of an empty table has none
        return (last, {r.bucket: r.version for r in rows.filter(F.col("v") == last).collect()}) if last is not None else (0, {})

    def _paths(self, where: dict[int, int]) -> DataFrame:
        if not where:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.folder}/rows/v={v}/bucket={b}" for b, v in sorted(where.items())])

    def read(self) -> DataFrame:
        return self._paths(self._last()[1])

    def change(self, batch: DataFrame, how: Callable[[DataFrame, DataFrame], DataFrame]) -> int:
        """Replaces the touched buckets by how(their rows, batch); returns how many those are."""
        version, where = self._last()
        touched = {r[0] for r in batch.select(self._bucket()).distinct().collect()}  # `buckets` rows at most
        if touched:
            self._write(how(self._paths({b: v for b, v in where.items() if b in touched}), batch), version + 1)
            new = {b: version + 1 for b in self._written(version + 1)}
            self._commit(version + 1, {b: v for b, v in where.items() if b not in touched} | new)
        return len(touched)

    def upsert(self, batch: DataFrame, filled: list[str], replaced: list[str]) -> int:
        """merge.upsert by the one key: new values where there are any in `filled`, always in `replaced`."""
        return self.change(batch, lambda old, new: merge.upsert(old, new, self.keys[0], filled, replaced))

    def insert_or_ignore(self, batch: DataFrame) -> int:
        return self.change(batch, lambda old, new: merge.insert_or_ignore(old, new, *self.keys))

    def replace(self, batch: DataFrame) -> int:
        """Rows of the batch in place of all rows with their keys."""
        return self.change(batch, lambda old, new: old.join(new.select(*self.keys).distinct(), self.keys, "left_anti").select(*self.schema.names).unionByName(new.select(*self.schema.names)))

    def delete(self, keys: DataFrame) -> int:
        return self.change(keys, lambda old, gone: old.join(gone.select(*self.keys).distinct(), self.keys, "left_anti").select(*self.schema.names))
