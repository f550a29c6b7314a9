"""Readers and writers: tables by name, the shared folder, JSON in files of bounded size."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table; only the named columns are read, or all without names."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir.

    Where none is named, a local master takes a temporary one; on a cluster that fails, as executors couldn't read it.
    """
    named, found = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext._jsc.sc().getCheckpointDir()
    if not named and not found.isDefined():
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='skein-')}")
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
    return (named or str(found.get())).rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/skein-{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The rows as a checkpoint in the shared folder.

    Spark deletes checkpoints that are no longer used if spark.cleaner.referenceTracking.cleanCheckpoints is true.
    """
    shared_folder(df.sparkSession)  # fails where there is none
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """The rows as a table in the shared folder, written by one job, and how many they are."""
    seen = Observation()
    path = new_folder(df.sparkSession, name)
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), seen.get["n"]


def write_json_chunks(df: DataFrame, path: str, records: int = 500) -> None:
    """JSON lines, at most `records` to a file."""
    df.write.option("maxRecordsPerFile", records).json(path)


def read_symbols(spark: SparkSession, path: str) -> DataFrame:
    """Remote symbols from JSON lines; a column that is missing is null."""
    return spark.read.schema("address long, symbol_type string, name string, data_type string, confidence double, provenance string, source string, content string, metadata map<string,string>").json(path)


def write_table(df: DataFrame, path: str, partition: str | None = None) -> DataFrame:
    """The rows as Parquet in one job, and the table read back."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition) if partition else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)
