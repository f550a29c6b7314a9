"""What the corpus operators share: the shared folder, written tables and word rules."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"
#: Rows with whole texts that go to a Python worker at a time.
BATCH_ROWS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a local master takes a temporary one; on a cluster that fails, as executors couldn't read it. Tables
    there are called skein-*; whoever has consumed a result may delete them.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jvm_dir.isDefined():
            return str(jvm_dir.get())
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='skein-')}"
        spark.sparkContext.setCheckpointDir(found)
        return shared_dir(spark)
    return found


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark).rstrip('/')}/skein-{name}-{uuid.uuid4().hex}"


def make_dir(spark: SparkSession, folder: str) -> str:
    """The folder, which exists from now on."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    return folder


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """The rows as a table in the shared folder, which cuts lineage and outlives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def whole_number_id(df: DataFrame, id_col: str) -> Column:
    """The id as a long; an operator whose format has whole numbers for ids refuses others."""
    kind = df.schema[id_col].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{id_col} must be a whole number, not {kind}")
    return F.col(id_col).cast("long")


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns of a row."""
    return F.xxhash64(*[F.to_json(F.struct(f"`{f.name}`")) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in df.schema])


def slices(batch: pa.RecordBatch, column: int, rows: int = 256, size: int = 32 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in slices of `rows` rows at most and about `size` bytes of a column, a single longer value apart."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        n = max(1, min(rows, int(np.searchsorted(ends, before + size, "right")) - at))
        yield batch.slice(at, n)
        at += n


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """From now on the session hands Python `rows` rows at a time at most: whole texts are long, and a worker holds a batch several times over."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, rows)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def n_words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def id_bucket(id_col: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus` (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % modulus
