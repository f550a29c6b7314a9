"""A work queue over a stream: no repeats, items in small batches, retries, tables that a repeated batch leaves as they are.

    folder/attempts/batch=B/attempt=K    what became of each item: key columns, result, error
    folder/index/batch=B                 what `index` makes of the batch's results
    folder/ledger/batch=B                written last: the batch is done

Each of these is written by one job that commits whole or not at all. A micro-batch that runs again finds what it has
committed before it died: a batch in the ledger does nothing, an attempt that is there isn't made again, and what was
not committed is made anew from the same input. Items that fail are tried `retries` times more; then they are in the table of
those given up.

Repeats are dropped within the watermark, so that the state holds the keys of that time and not of all.
Nulls: key columns may be null, a null time leaves an item out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinworks.sources.tables import new_folder

#: Items that a call of the work gets: of a remote one, of a local one.
REMOTE, LOCAL = 3, 10
RETRIES = 3


def without_repeats(events: DataFrame, keys: list[str], time: str, within: str) -> DataFrame:
    """Items by key, each once while its first event is no older than `within` of the latest."""
    return events.filter(F.col(time).isNotNull()).withWatermark(time, within).dropDuplicatesWithinWatermark(keys).select(*keys)


class WorkQueue:
    """work: a function of a list of items (dicts with `attempt`, from 1) that returns a string for each, or raises."""

    def __init__(self, spark: SparkSession, keys: list[str], work: Callable[[list[dict]], list[str]], size: int = REMOTE, retries: int = RETRIES, index: Callable[[DataFrame], DataFrame] | None = None, folder: str | None = None) -> None:
        self.spark, self.keys, self.work, self.size, self.retries, self.index = spark, keys, work, size, retries, index
        self.folder = folder or new_folder(spark, "work")

    def _there(self, *parts: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.folder, *parts, "_SUCCESS")))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _tried(self, items: DataFrame, attempt: int) -> DataFrame:
        work, size, keys = self.work, self.size, self.keys

        def call(rows: list[dict]) -> Iterator[tuple[str | None, str | None]]:
            try:
                yield from ((str(x), None) for x in work(rows))
            except Exception as e:  # noqa: BLE001  it is the item's result
                if len(rows) == 1:
                    yield None, f"{type(e).__name__}: {e}"
                else:  # the others of the batch have done nothing wrong
                    for row in rows:
                        yield from call([row])

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = batch.to_pylist()
                found = [x for k in range(0, len(rows), size) for x in call([r | {"attempt": attempt} for r in rows[k : k + size]])]
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.string()) for c in zip(*found, strict=True))], names=[*keys, "result", "error"])

        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema)
        return items.mapInArrow(part, f"{kinds}, result string, error string")

    def process(self, items: DataFrame, number: int) -> None:
        """One micro-batch, for foreachBatch."""
        batch = f"batch={number}"
        items = items.select(*self.keys)
        if self._there("ledger", batch) or self._there("attempts", batch, "attempt=1"):
            items.write.format("noop").mode("overwrite").save()  # read all the same, as that commits the stream's state
        if self._there("ledger", batch):
            return
        for attempt in range(1, self.retries + 2):
            path = f"{self.folder}/attempts/{batch}/attempt={attempt}"
            if not self._there("attempts", batch, f"attempt={attempt}"):
                self._tried(items, attempt).write.mode("overwrite").parquet(path)
            failed = self.spark.read.parquet(path).filter(F.col("error").isNotNull())
            if failed.isEmpty():
                break
            items = failed.select(*self.keys)
        if self.index is not None:
            done = self._attempts(batch).filter("error is null").drop("error")
            made = self.index(done) if not done.isEmpty() else self.index(done).filter("false")  # an empty batch has no totals
            made.write.mode("overwrite").parquet(f"{self.folder}/index/{batch}")
        self.spark.range(1).select(F.lit(number).alias("number")).write.mode("overwrite").parquet(f"{self.folder}/ledger/{batch}")

    def _attempts(self, batch: str) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.folder}/attempts").parquet(f"{self.folder}/attempts/{batch}")

    def run(self, items: DataFrame, once: bool = True):
        """Starts the queue over a stream of items; `once` takes what is there and ends, else a batch begins every five seconds."""
        writer = items.writeStream.foreachBatch(self.process).option("checkpointLocation", f"{self.folder}/checkpoint")
        query = (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="5 seconds")).start()
        if once:
            query.awaitTermination()
        return query

    def outcomes(self) -> DataFrame:
        """Per item: keys, batch, attempts made, result, error; status is done or given_up. Batches not in the ledger don't count."""
        done = self.spark.read.parquet(f"{self.folder}/ledger").select("batch")
        rows = self.spark.read.parquet(f"{self.folder}/attempts").join(done, "batch", "left_semi")
        last = rows.filter(F.col("error").isNull() | (F.col("attempt") > self.retries))
        return last.select(*self.keys, "batch", F.col("attempt").alias("attempts"), "result", "error", F.when(F.col("error").isNull(), "done").otherwise("given_up").alias("status"))

    def indexed(self) -> DataFrame:
        """What `index` made of the batches in the ledger."""
        return self.spark.read.parquet(f"{self.folder}/index").join(self.spark.read.parquet(f"{self.folder}/ledger").select("batch"), "batch", "left_semi")
