"""Dialogue sessions: listing, windows around anchors, as-of lookups, exchanges, compression.

Turns are rows (session_id, turn_index, role, content, deleted); every step partitions by session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import token_estimate


def _by_turn():
    return Window.partitionBy("session_id").orderBy("turn_index")


def turns_of(conversations: DataFrame) -> DataFrame:
    return conversations.select(F.col("conv_id").alias("session_id"), F.col("turn").cast("int").alias("turn_index"), "role", F.coalesce("text", F.lit("")).alias("content"), F.lit(False).alias("deleted"))


def positional(log: DataFrame, order: str = "id") -> DataFrame:
    """turn_index from insertion order."""
    return log.withColumn("turn_index", F.row_number().over(Window.partitionBy("session_id").orderBy(order)) - 1)


def soft_delete(turns: DataFrame, session_id, boundary: int) -> DataFrame:
    """Mark the first turns of a session deleted."""
    return turns.withColumn("deleted", F.col("deleted") | ((F.col("session_id") == session_id) & (F.col("turn_index") < boundary)))


def active(turns: DataFrame) -> DataFrame:
    return turns.filter(~F.col("deleted") & (F.trim("content") != ""))


def summaries(turns: DataFrame) -> DataFrame:
    """One row a session, fully deleted ones too: live turns, first and last user message."""
    live, user = ~F.col("deleted"), F.col("role") == "user"
    at = lambda pick: pick(F.when(live & user, F.col("content")), F.when(live & user, F.col("turn_index")))
    t = turns.groupBy("session_id").agg(
        F.sum(F.when(live, 1).otherwise(0)).alias("turn_count"), F.max("turn_index").alias("last_turn"),
        at(F.min_by).alias("first_user"), at(F.max_by).alias("last_user"),
    )
    return t.select("session_id", "turn_count", "last_turn", F.substring("first_user", 1, 40).alias("title"), F.substring("last_user", 1, 120).alias("last_message"))


def window_around(turns: DataFrame, anchors: DataFrame, width: int) -> DataFrame:
    """The turns within width of each anchor (session_id, lo, hi, anchor_id): equi-join on session, range residual."""
    a, t = anchors.alias("a"), turns.alias("t")
    near = (F.col("a.session_id") == F.col("t.session_id")) & F.col("t.turn_index").between(F.col("a.lo") - width, F.col("a.hi") + width)
    return a.join(t, near).select("a.anchor_id", "t.session_id", "t.turn_index", "t.role", "t.content")


def previous_user(turns: DataFrame) -> DataFrame:
    """The last user turn strictly before each assistant turn."""
    before = _by_turn().rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("role") == "user", F.struct("turn_index", "content")), ignorenulls=True).over(before)
    return turns.withColumn("user", last).filter("role = 'assistant'").select("session_id", "turn_index", F.col("user.turn_index").alias("user_turn"), F.col("user.content").alias("user_content"))


def next_answers(turns: DataFrame, n: int = 2) -> DataFrame:
    """The first n assistant turns after each user turn, up to the session's end."""
    # answers are numbered from the end, so the next one after a turn is the number it has seen from there
    back = Window.partitionBy("session_id").orderBy(F.desc("turn_index"))
    seen = F.sum((F.col("role") == "assistant").cast("int")).over(back.rowsBetween(Window.unboundedPreceding, 0))
    t = turns.select("session_id", "turn_index", "role", seen.alias("seen"))
    users = t.filter("role = 'user'").select("session_id", F.col("turn_index").alias("user_turn"), "seen", F.posexplode(F.sequence(F.lit(0), F.lit(n - 1))).alias("nth", "step"))
    users = users.select("session_id", "user_turn", "nth", (F.col("seen") - F.col("step")).alias("seen"))
    answers = t.filter("role = 'assistant'").select("session_id", "seen", F.col("turn_index").alias("answer_turn"))
    return users.join(answers, ["session_id", "seen"]).select("session_id", "user_turn", "nth", "answer_turn")


def exchanges(turns: DataFrame) -> DataFrame:
    """Exchanges: each user turn opens one; turns before the first are exchange 0."""
    opened = F.sum((F.col("role") == "user").cast("int")).over(_by_turn())
    t = turns.withColumn("exchange", opened).groupBy("session_id", "exchange")
    return t.agg(F.min("turn_index").alias("start_turn"), F.max("turn_index").alias("end_turn"), F.count(F.lit(1)).alias("n_turns"), F.sum(token_estimate(F.col("content")) + 4).alias("tokens"))


def boundaries(turns: DataFrame, min_recent: int = 2) -> DataFrame:
    """Compression boundary: the first of the last 2 * min_recent live turns, 0 if there are not more."""
    keep = 2 * min_recent
    live = turns.filter(~F.col("deleted"))
    back = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("turn_index")))
    t = live.withColumn("back", back).groupBy("session_id").agg(F.count(F.lit(1)).alias("n_live"), F.max(F.when(F.col("back") == keep, F.col("turn_index"))).alias("edge"), F.sum(token_estimate(F.col("content")) + 4).alias("tokens"))
    return t.select("session_id", "n_live", "tokens", F.when(F.col("n_live") > keep, F.col("edge")).otherwise(F.lit(0)).alias("boundary"))


def render(turns: DataFrame, session_summaries: DataFrame) -> DataFrame:
    """Context of each session: its latest summary (session_id, boundary_index, content), then live turns from there."""
    latest = session_summaries.groupBy("session_id").agg(F.max("boundary_index").alias("boundary"), F.max_by("content", "boundary_index").alias("summary"))
    t = active(turns).join(latest, "session_id", "left").filter(F.col("turn_index") >= F.coalesce("boundary", F.lit(0)))
    line = F.concat("role", F.lit(": "), "content")
    t = t.groupBy("session_id").agg(F.first("summary").alias("summary"), F.sort_array(F.collect_list(F.struct("turn_index", line.alias("line")))).alias("lines"))
    body = F.array_join(F.transform("lines", lambda x: x["line"]), "\n")
    return t.select("session_id", F.concat_ws("\n", "summary", body).alias("context"))


def islands(windows: DataFrame, gap: int) -> DataFrame:
    """Merge windows (session_id, lo, hi, score) that overlap or lie within gap.

    n windows merged in order of lo add 0.03 to the score at each merge and cap at 1; in closed form that is the largest
    score_i + 0.03 * (n - max(i, 2) + 1) with i the window's place from 1, and the plain score of a single one.
    """
    w = Window.partitionBy("session_id").orderBy("lo", "hi", "score")
    reach = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    t = windows.withColumn("new", (reach.isNull() | (F.col("lo") > reach + gap + 1)).cast("int"))
    t = t.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy("session_id", "island")
    t = t.withColumn("i", F.row_number().over(inside.orderBy("lo", "hi", "score"))).withColumn("n", F.count(F.lit(1)).over(inside))
    one = F.when(F.col("n") == 1, F.col("score")).otherwise(F.col("score") + 0.03 * (F.col("n") - F.greatest("i", F.lit(2)) + 1))
    return t.groupBy("session_id", "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("n").alias("n_windows"), F.round(F.least(F.lit(1.0), F.max(one)), 6).alias("score"))


def new_turns(turns: DataFrame, offsets: DataFrame) -> DataFrame:
    """Turns after each session's watermark (session_id, watermark); sessions without one start at 0."""
    return turns.join(offsets, "session_id", "left").filter(F.col("turn_index") >= F.coalesce("watermark", F.lit(0))).drop("watermark")


def advanced(offsets: DataFrame, consumed: DataFrame) -> DataFrame:
    """The watermark after a batch: never backwards."""
    ends = consumed.groupBy("session_id").agg((F.max("turn_index") + 1).alias("end"))
    return offsets.join(ends, "session_id", "full").select("session_id", F.greatest(F.coalesce("watermark", F.lit(0)), F.coalesce("end", F.lit(0))).alias("watermark"))
