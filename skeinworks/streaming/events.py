"""Streams of events: windows with watermarks, blocks of markdown as they become stable.

A source is a folder of Parquet files; a run with availableNow takes all that is there and ends. Each query writes to a
table in the shared folder, with its checkpoint beside it, so that it goes on where it was after a loss.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from skeinworks.sources.tables import new_folder

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
MESSAGES = "conv_id long, turn long, role string, text string"

#: What begins a block of markdown, and what is a row of a table.
HEADING, RULE, FENCE = re.compile(r"^#{1,6}\s"), re.compile(r"^(\*{3,}|-{3,}|_{3,})\s*$"), re.compile(r"^(`{3,}|~{3,})")
ITEM, QUOTE, ROW = re.compile(r"^(\s*([-*+]|\d+[.)]))\s"), re.compile(r"^>\s?"), re.compile(r"^\|.*\|\s*$")


def in_files(df: DataFrame, name: str, *parts: str) -> str:
    """A folder in which rows arrive as files, one after the other: those of the first condition first."""
    path = new_folder(df.sparkSession, name)
    for part in parts:
        df.filter(part).coalesce(1).write.mode("append").parquet(path)
    return path


def stream(spark: SparkSession, sf_dir: str, name: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(f"{sf_dir}/{name}.parquet*")


def run(df: DataFrame, name: str, mode: str = "append", folder: str | None = None) -> DataFrame:
    """Runs the stream over all that is there and returns what it wrote; in a `folder` of an earlier run it goes on where that ended."""
    spark = df.sparkSession
    path = folder or new_folder(spark, f"stream-{name}")
    if mode == "append":
        query = df.writeStream.format("parquet").option("checkpointLocation", f"{path}/checkpoint").outputMode(mode).trigger(availableNow=True).start(f"{path}/rows")
    else:  # each batch replaces what it updates

        def write(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

        query = df.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.schema(df.schema if mode == "append" else df.schema.add("batch", "long")).parquet(f"{path}/rows")
    return rows if mode == "append" else rows.filter(F.col("batch") == F.lit(rows.agg(F.max("batch")).first()[0])).drop("batch")


def tumbling(events: DataFrame, size: str = "1 day") -> DataFrame:
    """(start, event_type, n, total) of windows side by side."""
    return events.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str = "2 days", step: str = "1 day") -> DataFrame:
    return events.groupBy(F.window("ts", size, step)).agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.col("window.start").alias("start"), "n", "total")


def sessions(events: DataFrame, gap: str = "12 hours") -> DataFrame:
    """(user_id, start, n) of runs of a user's events without a pause as long as `gap`."""
    return events.groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("s.start").alias("start"), "n")


def stable_end(text: str) -> int:
    """How much of a growing markdown text won't be read anew: up to the last line that ends or begins a block.

    A line without its end, a fence that is still open and a table's rows are not stable.
    """
    stable, at, fence = 0, 0, ""
    lines = text.split("\n")
    for line in lines[:-1]:  # the last one has no end yet
        end = at + len(line) + 1
        if fence:
            mark = line.strip()
            if mark and set(mark) == {fence[0]} and len(mark) >= len(fence):
                fence, stable = "", end
        elif opened := FENCE.match(line):
            fence = opened.group(1)
        elif not ROW.match(line) and (not line.strip() or any(p.match(line) for p in (HEADING, RULE, ITEM, QUOTE))):
            stable = end
        at = end
    return stable


def _blocks(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    pending, done = state.get if state.exists else ("", 0)
    rows = pd.concat(list(batches)).sort_values("turn")
    out = []
    for turn, text in zip(rows["turn"], rows["text"], strict=True):
        pending += (text or "") + "\n\n"
        end = stable_end(pending)
        if end:
            done += end
            out.append((key[0], turn, end, done))
            pending = pending[end:]
    state.update((pending, done))
    yield pd.DataFrame(out, columns=["conv_id", "turn", "committed", "total"])


def stable_blocks(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, committed, total): how many signs of each conversation become stable with each turn.

    Turns are paragraphs: an empty line follows each. What isn't stable yet is kept as state by conversation.
    """
    return messages.select("conv_id", "turn", "text").groupBy("conv_id").applyInPandasWithState(_blocks, "conv_id long, turn long, committed long, total long", "pending string, done long", "append", GroupStateTimeout.NoTimeout)
