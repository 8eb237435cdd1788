"""Compression of sessions with two thresholds.

Over the first threshold a session's summary is prepared while its turns stay; over the second one it is applied, or made
at once where none is ready. One pass does so for all sessions: what a client keeps in a thread's future is a row of a table.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scoring
from ..functions.text import token_estimate
from ..sources.shared import stored
from . import sessions


class Compacted(NamedTuple):
    turns: DataFrame  # as given; those that a summary now stands for are marked deleted
    summaries: DataFrame  # session_id, boundary_index, content, token_count
    prepared: DataFrame  # session_id, boundary_index, content: a row a session at most
    decisions: DataFrame  # session_id, tokens, action, origin, boundary_index


def latest(summaries: DataFrame) -> DataFrame:
    """session_id, boundary_index, content of each session's furthest summary; of equal ones the greatest text."""
    far = F.max(F.struct("boundary_index", "content"))
    return summaries.groupBy("session_id").agg(far.alias("s")).select("session_id", "s.boundary_index", "s.content")


def history(todo: DataFrame, turns: DataFrame, summaries: DataFrame) -> DataFrame:
    """session_id, place, line: what each session of todo(session_id, boundary_index) has to sum up, its latest summary first."""
    before = latest(summaries).join(todo.select("session_id"), "session_id", "left_semi").select("session_id", F.lit(-1).alias("place"), F.concat(F.lit("[Previous Historical Summary]\n"), "content").alias("line"))
    live = turns.filter(~F.col("deleted")).join(todo.select("session_id", "boundary_index"), "session_id").filter(F.col("turn_index") < F.col("boundary_index"))
    return before.unionByName(live.select("session_id", F.col("turn_index").alias("place"), F.concat("role", F.lit(": "), "content").alias("line")))


def extract(lines: DataFrame, most: int = 6, chars: int = 80) -> DataFrame:
    """session_id, content: the default summary, the beginnings of the first lines. A model's summaries may stand for it."""
    first = Window.partitionBy("session_id").orderBy("place", "line")
    few = lines.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= most).select("session_id", F.struct("n", F.substring("line", 1, chars).alias("line")).alias("x"))
    return few.groupBy("session_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["line"]), "\n").alias("content"))


def compact(turns: DataFrame, summaries: DataFrame, prepared: DataFrame, summarize: Callable[[DataFrame], DataFrame] = extract, budget: int = 128_000, warn: float = 0.70, block: float = 0.90, min_recent: int = 2) -> Compacted:
    """One pass over all sessions.

    Over the block threshold a session takes its prepared summary, if that has a text and a boundary, else one made now; what was
    prepared goes. Over the warn threshold alone one is prepared, unless there is one. Sessions with too few live turns stay. A
    pass over its own result makes no further summary of what it has summed up. summarize gets the lines of `history`; sessions that it
    leaves out, or gives no text, stay as they are, and their decision is taken anew by the next pass.
    """
    ready = prepared.select("session_id", F.col("boundary_index").alias("ready_boundary"), F.col("content").alias("ready"))
    b = sessions.boundaries(turns, min_recent).join(ready, "session_id", "left")
    action = scoring.compression(F.col("tokens"), budget, warn, block)
    usable = (F.col("ready_boundary") > 0) & (F.trim("ready") != "")
    origin = F.when((F.col("action") == "sync") & usable, "prepared").when((F.col("action") == "sync") & (F.col("boundary") > 0), "fresh")
    origin = origin.when((F.col("action") == "async") & F.col("ready_boundary").isNull() & (F.col("boundary") > 0), "background").otherwise("none")
    d = b.withColumn("action", action).withColumn("origin", origin)
    d = stored(d.select("session_id", "tokens", "action", "origin", F.when(F.col("origin") == "prepared", F.col("ready_boundary")).otherwise(F.col("boundary")).cast("int").alias("boundary_index"), "ready"), "compaction")
    made = summarize(history(d.filter("origin in ('fresh', 'background')"), turns, summaries)).filter(F.trim("content") != "")
    given = d.filter("origin = 'prepared'").select("session_id", "boundary_index", "origin", F.col("ready").alias("content"))
    new = stored(given.unionByName(made.join(d.filter("origin in ('fresh', 'background')"), "session_id").select("session_id", "boundary_index", "origin", "content")), "summed")
    applied = new.filter("origin <> 'background'").select("session_id", "boundary_index", "content", (token_estimate(F.col("content")) + 4).alias("token_count"))
    marked = turns.join(applied.select("session_id", F.col("boundary_index").alias("_to")), "session_id", "left")
    marked = marked.withColumn("deleted", F.col("deleted") | F.coalesce(F.col("turn_index") < F.col("_to"), F.lit(False))).drop("_to")
    waiting = prepared.join(d.filter("action = 'sync'"), "session_id", "left_anti").select("session_id", "boundary_index", "content")
    waiting = waiting.unionByName(new.filter("origin = 'background'").select("session_id", "boundary_index", "content"))
    return Compacted(marked, summaries.unionByName(applied), waiting, d.drop("ready"))


def context_usage(turns: DataFrame, summaries: DataFrame) -> DataFrame:
    """session_id, tokens of each session's rendered context: its latest summary, and its live turns from there."""
    s = latest(summaries)
    live = turns.filter(~F.col("deleted")).join(s.select("session_id", F.col("boundary_index").alias("_from")), "session_id", "left").filter(F.col("turn_index") >= F.coalesce("_from", F.lit(0)))
    parts = live.select("session_id", (token_estimate(F.col("content")) + 4).alias("n"))
    parts = parts.unionByName(s.select("session_id", (token_estimate(F.concat(F.lit("[Historical Summary]\n"), "content")) + 4).alias("n")))
    return parts.groupBy("session_id").agg(F.sum("n").alias("tokens"))
