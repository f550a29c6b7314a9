"""Conversations and agents: windows over messages (conv_id, turn, role, text), token budgets, diffs of edits.

A null text has no tokens and no lines; a null role is no system, user or assistant; messages without a conv_id are one
conversation. (conv_id, turn) tells messages apart: of equal ones any comes first, and each counts. Empty tables give
empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The usual context window and the share of it at which it is compressed.
CONTEXT_TOKENS, THRESHOLD = 200_000, 75


def last_messages(messages: DataFrame, n: int = 10) -> DataFrame:
    """System messages and the last n others of each conversation."""
    w = Window.partitionBy("conv_id", F.col("role") == "system").orderBy(F.desc("turn"))
    return messages.withColumn("__rank", F.row_number().over(w)).filter((F.col("role") == "system") | (F.col("__rank") <= n)).drop("__rank")


def compressed(messages: DataFrame, tail: int = 20) -> DataFrame:
    """System messages, the first of a user and the last `tail` of each conversation."""
    all_ = Window.partitionBy("conv_id")
    first = F.min(F.when(F.col("role") == "user", F.col("turn"))).over(all_)
    place = F.row_number().over(all_.orderBy(F.desc("turn")))
    marked = messages.withColumn("__first", first).withColumn("__place", place)
    return marked.filter((F.col("role") == "system") | (F.col("turn") == F.col("__first")) | (F.col("__place") <= tail)).drop("__first", "__place")


def token_estimates(messages: DataFrame) -> DataFrame:
    """(conv_id, n_messages, n_tokens): a token for each 4 signs of a whole conversation."""
    n = F.coalesce(F.length("text").cast("long"), F.lit(0))
    return messages.groupBy("conv_id").agg(F.count("*").alias("n_messages"), F.floor(F.sum(n) / 4).cast("long").alias("n_tokens"))


def context_status(estimates: DataFrame, most: int = CONTEXT_TOKENS, threshold: int = THRESHOLD) -> DataFrame:
    """Percent of the window used, percent of the threshold reached, tokens that remain."""
    limit = most * threshold // 100
    percent = lambda of: F.floor(F.col("n_tokens") * 100 / of).cast("long")
    return estimates.select("conv_id", "n_tokens", percent(most).alias("percent_used"), percent(limit).alias("percent_of_threshold"), F.greatest(F.lit(0).cast("long"), F.lit(most) - F.col("n_tokens")).alias("remaining"), (F.col("n_tokens") >= limit).alias("compress"))


def paired(messages: DataFrame, call: str = "assistant", result: str = "user") -> DataFrame:
    """Each result with `call_turn`, the turn of the latest call before it, and each call with its number of results."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("role") == call, F.col("turn")), ignorenulls=True).over(w)
    marked = messages.withColumn("call_turn", F.when(F.col("role").isin(call, result), last))
    n = F.count_if(F.col("role") == result).over(Window.partitionBy("conv_id", "call_turn"))
    return marked.withColumn("n_results", F.when(F.col("call_turn").isNotNull(), n))


def without_orphans(messages: DataFrame, call: str = "assistant", result: str = "user") -> DataFrame:
    """Without calls that have no result; results without a call stay, as do other roles."""
    found = paired(messages, call, result)
    return found.filter((F.col("role") != call) | (F.coalesce("n_results", F.lit(0)) > 0)).drop("call_turn", "n_results")


def complete_calls(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Calls (message, call_ids) of which every id has a result (call_id)."""
    each = calls.select("message", F.explode_outer("call_ids").alias("call_id"))
    missing = each.join(results.select("call_id").distinct(), "call_id", "left_anti").filter("call_id is not null").select("message").distinct()
    return calls.join(missing, "message", "left_anti")


def edit_diff(old: DataFrame, new: DataFrame, key: list[str], value: str) -> DataFrame:
    """(key, status): deleted, added, modified or same, by a full join."""
    a = old.select(*key, F.col(value).alias("__old"), F.lit(True).alias("__was"))
    b = new.select(*key, F.col(value).alias("__new"), F.lit(True).alias("__is"))
    status = F.when(F.col("__is").isNull(), "deleted").when(F.col("__was").isNull(), "added").when(F.col("__old").eqNullSafe(F.col("__new")), "same").otherwise("modified")
    return a.join(b, key, "full").select(*key, status.alias("status"))


def separators(messages: DataFrame) -> DataFrame:
    """With `separator`: whether a rule stands before a message, which is so for each user's after the first."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    n = F.sum((F.col("role") == "user").cast("int")).over(w)
    return messages.withColumn("separator", (F.col("role") == "user") & (n > 1))


def line_context(df: DataFrame, id_col: str, text_col: str, pattern: str, around: int = 5) -> DataFrame:
    """(id, line, text, before, after) of each line that matches: up to `around` lines on each side.

    All is taken from the text's own array of lines, so nothing is shuffled.
    """
    lines = F.split(text_col, "\n", -1)
    hit = df.withColumn("__lines", lines).select(id_col, "__lines", F.posexplode("__lines").alias("line", "text")).filter(F.col("text").rlike(pattern))
    before = F.slice("__lines", F.greatest(F.lit(1), F.col("line") - around + 1), F.least(F.col("line"), F.lit(around)))
    after = F.slice("__lines", F.col("line") + 2, F.lit(around))
    return hit.select(id_col, "line", "text", F.array_join(before, "\n").alias("before"), F.array_join(after, "\n").alias("after"))


def session_list(messages: DataFrame) -> DataFrame:
    """(conv_id, n_messages, last_turn, first_user): the last ones first."""
    return messages.groupBy("conv_id").agg(F.count("*").alias("n_messages"), F.max("turn").alias("last_turn"), F.min_by("text", F.when(F.col("role") == "user", F.col("turn"))).alias("first_user"))


def next_todo(todos: DataFrame) -> DataFrame:
    """The pending todo of highest priority of each owner, the earliest of equals."""
    w = Window.partitionBy("owner").orderBy(F.desc("priority"), "seq")
    return todos.filter("status = 'pending'").withColumn("__rank", F.row_number().over(w)).filter("__rank = 1").drop("__rank")
