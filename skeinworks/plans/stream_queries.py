"""Queries over streams, which run over all events that are there; with the SQL of the same batch where there is one."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skeinworks.sources.tables import table
from skeinworks.streaming import events as S
from skeinworks.streaming.accumulate import deltas
from skeinworks.streaming.work_queue import WorkQueue, without_repeats


def events_tumbling(spark, sf_dir):
    """Events and values by day and type, as a stream that updates its totals."""
    return S.run(S.tumbling(S.stream(spark, sf_dir, "events", S.EVENTS)), "tumbling", "complete")


def events_sliding(spark, sf_dir):
    return S.run(S.sliding(S.stream(spark, sf_dir, "events", S.EVENTS)), "sliding", "complete")


def events_session(spark, sf_dir):
    """Runs of a user's events without a pause of twelve hours, as a stream that updates them."""
    return S.run(S.sessions(S.stream(spark, sf_dir, "events", S.EVENTS)), "session", "complete")


def stream_dedup_queue(spark, sf_dir):
    """Pairs of user and type, each once within sixty days of events."""
    return S.run(without_repeats(S.stream(spark, sf_dir, "events", S.EVENTS), ["user_id", "event_type"], "ts", "60 days"), "queue")


def _worked(spark, sf_dir):
    """A queue whose items are a user's types by day; events come in four files that end at noon of some day."""
    noon = "dayofmonth(ts - interval 12 hours)"
    events = table(spark, sf_dir, "events", "ts", "user_id", "event_type").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("day", F.to_date("ts"))
    path = S.in_files(events, "events", f"{noon} < 8 or {noon} = 31", f"{noon} between 8 and 14", f"{noon} between 15 and 22", f"{noon} between 23 and 30")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)

    def work(items: list[dict]) -> list[str]:
        """Fails for an item as often as its user's number says; a batch that holds such an item fails whole."""
        if any((x["user_id"] or 0) % 6 >= x["attempt"] for x in items):
            raise OSError("not yet")
        return [f"{x['user_id']}:{x['event_type']}" for x in items]

    keys = ["user_id", "event_type", "day"]
    queue = WorkQueue(spark, keys, work, index=lambda done: done.groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("result").alias("n_results")))
    queue.run(without_repeats(stream, keys, "ts", "2 days"))
    return queue


def work_queue(spark, sf_dir):
    """What became of each item: attempts made, whether it is done or given up after three more."""
    return _worked(spark, sf_dir).outcomes().select("user_id", "event_type", "day", "attempts", "result", "status")


def work_queue_index(spark, sf_dir):
    """The index that is refreshed after each batch: results by type."""
    return _worked(spark, sf_dir).indexed().groupBy("event_type").agg(F.sum("n").alias("n"))


def text_accumulated(spark, sf_dir):
    """Each conversation as a growing text: what its chunks add to it, as they come in from four files, the second one first.

    A turn is a chunk of what is new, but for turn 1, which holds all so far, and turn 3, which begins as the text does and yet
    is new. A third of the conversations never tells its end; a timer closes them.
    """
    m = table(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    w = Window.partitionBy("conv_id").orderBy("turn")
    piece = F.concat(F.lit("["), F.col("turn").cast("string"), F.lit("]"), F.col("text"))
    m = m.select("conv_id", "turn", piece.alias("piece")).withColumn("before", F.when(F.col("turn") == 1, F.lag("piece").over(w)).when(F.col("turn") == 3, F.first("piece").over(w)).otherwise(""))
    last = (F.col("turn") == F.max("turn").over(Window.partitionBy("conv_id"))) & (F.col("conv_id") % 3 != 0)
    at = F.timestamp_seconds(F.lit(1704067200) + 3600 * F.col("turn"))
    chunks = m.select(F.col("conv_id").cast("string").alias("key"), F.col("turn").alias("seq"), F.concat("before", "piece").alias("chunk"), last.alias("last"), at.alias("ts"))
    path = S.in_files(chunks, "chunks", "seq in (2, 3)", "seq < 2", "seq in (4, 5)", "seq > 5")
    stream = spark.readStream.schema(chunks.schema).option("maxFilesPerTrigger", 1).parquet(path)
    found = S.run(deltas(stream, "210 minutes", 3600), "deltas")
    return found.select(F.col("key").cast("long").alias("conv_id"), F.col("seq").alias("turn"), F.md5("delta").alias("digest"), "size", "cumulative", "ended")


def stream_block_boundary(spark, sf_dir):
    """Signs of each conversation that become stable as its turns come in; what is left is in no row."""
    return S.run(S.stable_blocks(S.stream(spark, sf_dir, "conversations", S.MESSAGES)), "blocks")


def stream_fenced_blocks(spark, sf_dir):
    """As stream_block_boundary where every second of three turns opens a fence that the third closes: it waits for that one."""
    m = S.stream(spark, sf_dir, "conversations", S.MESSAGES)
    text = F.when(F.col("turn") % 3 == 1, F.concat(F.lit("```\n"), "text")).when(F.col("turn") % 3 == 2, F.concat("text", F.lit("\n```"))).otherwise(F.col("text"))
    return S.run(S.stable_blocks(m.withColumn("text", text)), "fenced")


def events_watermark(spark, sf_dir):
    """Events by hour, each window once it is past the watermark of two hours; the last ones stay open."""
    events = S.stream(spark, sf_dir, "events", S.EVENTS).withWatermark("ts", "2 hours")
    found = events.groupBy(F.window("ts", "1 hour")).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")
    return S.run(found, "watermark")


QUERIES = {f.__name__: f for f in (events_tumbling, events_sliding, events_session, stream_dedup_queue, stream_block_boundary, stream_fenced_blocks, events_watermark, work_queue, work_queue_index, text_accumulated)}

ORACLE_SQL = {
    "events_tumbling": "select date_trunc('day', ts)::timestamp as start, event_type, count(*) as n, round(sum(value), 6) as total from events group by 1, 2",
    "events_sliding": "select start::timestamp as start, count(*) as n, round(sum(value), 6) as total from (select unnest([date_trunc('day', ts), date_trunc('day', ts) - interval 1 day]) as start, value from events) group by 1",
    "events_session": """with m as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 12 hours then 0 else 1 end as new from events),
s as (select user_id, ts, sum(new) over (partition by user_id order by ts, new desc rows between unbounded preceding and current row) as k from m)
select user_id, min(ts)::timestamp as start, count(*) as n from s group by user_id, k""",
    # no text has a fence, so each turn is stable as soon as it has ended
    "stream_block_boundary": "select conv_id, turn, length(text) + 2 as committed, (sum(length(text) + 2) over (partition by conv_id order by turn))::bigint as total from conversations",
    "stream_fenced_blocks": """with m as (select conv_id, turn, length(text) + case when turn % 3 = 0 then 2 else 6 end as size from conversations),
c as (select conv_id, turn, size + case when turn % 3 = 2 then lag(size) over w else 0 end as committed, (sum(size) over w)::bigint as total from m window w as (partition by conv_id order by turn))
select conv_id, turn, committed, total from c where turn % 3 <> 1""",
    "events_watermark": "select date_trunc('hour', ts)::timestamp as start, count(*) as n from events group by 1 having date_trunc('hour', min(ts)) + interval 1 hour <= (select max(ts) - interval 2 hours from events)",
    "work_queue": """select user_id, event_type, ts::date as day, least(user_id % 6, 3)::int + 1 as attempts, case when user_id % 6 <= 3 then user_id || ':' || event_type end as result,
case when user_id % 6 <= 3 then 'done' else 'given_up' end as status from events group by 1, 2, 3""",
    "work_queue_index": "select event_type, count(*) as n from (select distinct user_id, event_type, ts::date from events where user_id % 6 <= 3) group by 1",
    "text_accumulated": """with m as (select conv_id, turn, '[' || turn || ']' || text as piece, max(turn) over (partition by conv_id) as final from conversations),
d as (select conv_id, turn, final, case when turn = 3 then first_value(piece) over (partition by conv_id order by turn) || piece else piece end as delta from m),
r as (select conv_id, turn, md5(delta) as digest, (sum(length(delta)) over (partition by conv_id order by turn))::bigint as size, turn = 1 as cumulative, final, conv_id % 3 <> 0 as tells from d)
select conv_id, turn, digest, size, cumulative, case when turn = final and tells then 'last' end as ended from r
union all
select conv_id, turn + 1, md5(''), size, null, 'idle' from r where turn = final and not tells and 60 * turn + 60 < (select 60 * max(turn) - 210 from conversations)""",
    "stream_dedup_queue": "select distinct user_id, event_type from events",
}
