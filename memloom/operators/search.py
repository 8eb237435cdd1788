"""Retrieval: hits to candidates, boosts, dialogue windows, scoring, fusion, context.

A request is a row (request, query, question_type, since, until, k); its routes are rows (request, route, route_no, goal). Hits
are rows (request, route, query, id, distance) of one channel. Candidates are rows keyed by (request, route, id) with the
payload below, so every step runs for all requests at once and partitions by request or session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import loose_json as loose
from ..functions import scoring, temporal, text
from ..sources.shared import stored
from . import plans_io, ranking, sessions

PAYLOAD = ("source", "memory_type", "text", "session", "lo", "hi", "role", "entities", "t_start", "t_end", "created_at")
#: What stands for a candidate's text while the text stays in its table: its hash and its date spans.
REFERENCE = ("text_key", "spans")
KEYS = ("request", "route", "id")
LISTS = ("queries", "channels", "nodes")


def _empty(kind: str = "array<string>") -> Column:
    return F.array().cast(kind)


def of_records(records: DataFrame) -> DataFrame:
    """Payload of records that are not expired."""
    first = lambda *names: F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in names], F.lit(""))
    return records.filter("not expired").select(
        F.col("record_id").cast("string").alias("id"), F.lit("record").alias("source"), "memory_type", first("display_text", "semantic_text", "normalized_text").alias("text"),
        F.col("session_id").cast("string").alias("session"), "lo", "hi", "role", "entities", "t_start", "t_end", "created_at",
    )


def of_turns(turns: DataFrame, session: str | None = None) -> DataFrame:
    """Payload of live turns with text, of one session if asked."""
    live = sessions.active(turns)
    live = live if session is None else live.filter(F.col("session_id").cast("string") == session)
    role = F.lower(F.trim(F.coalesce("role", F.lit("unknown"))))
    return live.select(
        F.concat_ws(":", F.col("session_id").cast("string"), "turn_index").alias("id"), F.lit("episode").alias("source"), F.lit("raw_turn").alias("memory_type"),
        F.concat(F.lit("["), role, F.lit("]: "), F.trim("content")).alias("text"), F.col("session_id").cast("string").alias("session"), F.col("turn_index").alias("lo"), F.col("turn_index").alias("hi"),
        role.alias("role"), _empty().alias("entities"), F.lit(None).cast("string").alias("t_start"), F.lit(None).cast("string").alias("t_end"), "created_at",
    )


def referenced(rows: DataFrame) -> DataFrame:
    """rows with REFERENCE; where it is not asked for, Spark leaves it out."""
    return rows.withColumns({"text_key": F.xxhash64("text"), "spans": event_spans()})


def texts_of(records: DataFrame, turns: DataFrame) -> DataFrame:
    """id, text of all records and turns that candidates come from."""
    return of_records(records).select("id", "text").unionByName(of_turns(turns).select("id", "text"))


def with_texts(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """rows, which are few and stored, with the texts(id, text) that their text_key stands for, and without REFERENCE.

    Texts that share an id are told apart by text_key. Only the texts of these ids move.
    """
    wanted = rows.filter("text_key is not null").select("id")
    own = texts.join(wanted, "id", "left_semi").select("id", F.xxhash64("text").alias("text_key"), F.col("text").alias("own")).distinct()
    found = rows.join(own, ["id", "text_key"], "left").withColumn("text", F.coalesce("text", "own"))
    return found.select(*[c for c in rows.columns if c not in REFERENCE])


def record_hits(hits: DataFrame, records: DataFrame) -> DataFrame:
    """Direct record hits: a missing or expired record is no candidate."""
    score = scoring.retrieval_score(F.col("distance"))
    found = referenced(hits.join(of_records(records), "id"))
    return found.withColumns({"retrieval": score, "field": scoring.direct_hit(score), "channel": F.lit("record_normalized_ann"), "node": F.lit(None).cast("string")})


def node_hits(hits: DataFrame, nodes: DataFrame, index: DataFrame, records: DataFrame, per_type: int) -> DataFrame:
    """Records of evidence-node hits: per_type nodes of each type, the best score of a node, its weight.

    nodes(id, node_type), index(id, record_id). Such candidates carry no distance of their own (1.0).
    """
    typed = hits.join(nodes.select("id", "node_type"), "id").withColumn("kept", F.row_number().over(Window.partitionBy("request", "route", "query", "node_type").orderBy("distance", "id"))).filter(F.col("kept") <= per_type)
    score = scoring.clamp(scoring.retrieval_score(F.col("distance")) * scoring.node_weight(F.col("node_type")))
    found = typed.select("request", "route", "query", F.col("id").alias("node"), F.concat(F.col("node_type"), F.lit("_ann")).alias("channel"), score.alias("field"))
    found = found.join(index.select(F.col("id").alias("node"), F.col("record_id").cast("string").alias("id")), "node").join(referenced(of_records(records)), "id")
    return found.withColumns({"distance": F.lit(1.0), "retrieval": F.lit(0.0)})


def turn_hits(hits: DataFrame, turns: DataFrame, requests: DataFrame) -> DataFrame:
    """Raw-turn hits with the strategy's multiplier and role bonus."""
    score = scoring.retrieval_score(F.col("distance"))
    found = referenced(hits.join(of_turns(turns), "id")).join(requests.select("request", "raw_mult", "assistant_bonus", "user_bonus"), "request")
    field = scoring.raw_turn(score, F.col("raw_mult"), F.col("role"), F.col("assistant_bonus"), F.col("user_bonus"))
    found = found.withColumns({"retrieval": score, "field": field, "channel": F.lit("raw_turn_direct"), "node": F.lit(None).cast("string")})
    return found.drop("raw_mult", "assistant_bonus", "user_bonus")


def temporal_hits(found: DataFrame, records: DataFrame, routes: DataFrame) -> DataFrame:
    """Candidates of temporal recall (request, id, key, score, label), in every route of the request."""
    rows = found.join(routes.select("request", "route"), "request").join(referenced(of_records(records)), "id")
    return rows.withColumns({"field": F.col("score"), "query": F.col("label"), "distance": F.lit(1.0), "retrieval": F.lit(0.0), "channel": F.lit("temporal_range"), "node": F.col("key")})


def merged(*channels: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """One row a candidate: best field and retrieval score, least distance, distinct queries, channels, nodes.

    Lists are distinct and in order of their values. more names further columns of the payload.
    """
    columns = ["request", "route", "id", *PAYLOAD, *more, "field", "retrieval", "distance", "query", "channel", "node"]
    rows = channels[0].select(*columns)
    for c in channels[1:]:
        rows = rows.unionByName(c.select(*columns))
    some = lambda c: F.sort_array(F.collect_set(F.nullif(c, F.lit(""))))
    t = rows.groupBy(*KEYS).agg(
        F.max_by(F.struct(*PAYLOAD, *more), "field").alias("p"), F.max("field").alias("field"), F.max("retrieval").alias("retrieval"), F.min("distance").alias("distance"),
        some("query").alias("queries"), some("channel").alias("channels"), some("node").alias("nodes"),
    )
    return t.select(*KEYS, "p.*", "field", "retrieval", "distance", *LISTS)


def united(*lists: DataFrame) -> DataFrame:
    """Candidate lists as one: the payload with the higher field score (earlier lists on ties), distinct lists.

    REFERENCE, where the first list has it, belongs to the payload; it is null in lists without it.
    """
    rows = lists[0].withColumn("at", F.lit(0))
    for i, c in enumerate(lists[1:], 1):
        rows = rows.unionByName(c.withColumn("at", F.lit(i)), allowMissingColumns=True)
    payload = [*PAYLOAD, *[c for c in REFERENCE if c in lists[0].columns]]
    best = F.struct(F.col("field").alias("o1"), (-F.col("at")).alias("o2"))
    scores = ("field", "retrieval", "distance")
    t = rows.groupBy(*KEYS).agg(F.max_by(F.struct(*payload, *scores), best).alias("p"), *[F.sort_array(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in LISTS])
    return t.select(*KEYS, "p.*", *LISTS)


def event_spans() -> Column:
    """Distinct date spans of a candidate: its own times, in order, and every date in its text."""
    kind = "array<struct<start:string,end:string>>"
    start, end = temporal.date_key(F.col("t_start")), temporal.date_key(F.col("t_end"))
    a, b = F.coalesce(start, end), F.coalesce(end, start)
    own = F.when(a.isNull(), _empty(kind)).otherwise(F.array(F.struct(F.least(a, b).alias("start"), F.greatest(a, b).alias("end"))))
    return F.array_distinct(F.concat(own, F.transform(temporal.date_keys(F.col("text")), lambda d: F.struct(d.alias("start"), d.alias("end"))).cast(kind)))


def boosted(candidates: DataFrame, requests: DataFrame) -> DataFrame:
    """Strategy and temporal boosts (X5, X6, X7). requests has the strategy's columns, since and until.

    Dialogue turns get the raw-turn score if it is higher, records the bonus of the question type. An overlap of an event
    date with the request's range adds .08, else of a dialogue's own date .04; nothing is filtered. Candidates may bring spans.
    """
    t = candidates.join(requests.select("request", "strategy", "raw_mult", "assistant_bonus", "user_bonus", "since", "until"), "request")
    raw = scoring.raw_turn(scoring.clamp(F.col("retrieval")), F.col("raw_mult"), F.col("role"), F.col("assistant_bonus"), F.col("user_bonus"))
    has_time = F.coalesce("t_start", "t_end").isNotNull()
    bonus = scoring.record_bonus(F.col("strategy"), F.col("role"), F.col("memory_type"), has_time)
    episode = F.col("source") == "episode"
    t = t.withColumn("field", scoring.clamp(F.when(episode, F.greatest("field", raw)).otherwise(F.col("field") + bonus)))
    since, until = temporal.date_key(F.col("since")), temporal.date_key(F.col("until"))
    asked = since.isNotNull() | until.isNotNull()
    t = t.withColumns({"spans": F.col("spans") if "spans" in candidates.columns else event_spans(), "s": since, "u": until, "own": F.when(episode, temporal.date_key(F.col("created_at")))})
    event = F.exists("spans", lambda x: temporal.overlaps(x["start"], x["end"], F.col("s"), F.col("u")))
    source = (F.size("spans") == 0) & F.col("own").isNotNull() & temporal.in_range(F.col("own"), F.col("s"), F.col("u"))
    boost = F.when(~asked, F.lit(0.0)).when(event, F.lit(0.08)).when(source, F.lit(0.04)).otherwise(F.lit(0.0))
    t = t.withColumn("boost", boost).withColumn("field", F.least(F.lit(1.0), F.col("field") + F.col("boost")))
    name = F.when(F.col("boost") > 0.05, F.lit("temporal_boost")).otherwise(F.lit("source_time_boost"))
    t = t.withColumn("channels", F.when(F.col("boost") > 0, F.sort_array(F.array_union("channels", F.array(name)))).otherwise(F.col("channels")))
    return t.select(*candidates.columns)


def anchor_score(rerank: Column | None = None) -> Column:
    """The best of a candidate's signals (A24); a reranker's score is the fourth, where there is one."""
    more = [] if rerank is None else [F.coalesce(rerank, F.lit(0.0))]
    return F.greatest("field", "retrieval", scoring.retrieval_score(F.col("distance")), *more)


def answer_windows(candidates: DataFrame, turns: DataFrame, requests: DataFrame) -> DataFrame:
    """Question and answer windows around dialogue anchors, for questions about what the assistant said.

    An anchor of an assistant leads to its own turn, one of a user to the first two answers after it, another to the answers
    inside it, all within the strategy's window; the last user turn before the answer and within the window goes in front.
    """
    r = requests.filter("strategy = 'prior_assistant_response'").select("request", "exp_window", "exp_limit", "assistant_bonus")
    score = F.greatest("field", "retrieval")
    a = candidates.filter("source = 'episode' and memory_type <> 'assistant_answer_window' and session is not null and lo is not null").join(r, "request")
    a = a.withColumn("score", score).withColumn("nth", F.row_number().over(Window.partitionBy("request", "route").orderBy(F.desc("score"), F.desc("retrieval"), "id")))
    a = a.filter(F.col("nth") <= F.greatest(F.lit(8), 2 * F.col("exp_limit"))).select("request", "route", F.col("id").alias("anchor"), "nth", "session", "lo", "hi", "role", "score", "retrieval", *LISTS, F.greatest(F.lit(1), "exp_window").alias("w"), "assistant_bonus")
    live = sessions.active(turns).select(F.col("session_id").cast("string").alias("session"), "turn_index", F.lower(F.trim("role")).alias("t_role"), F.trim("content").alias("content"), "created_at")
    near = a.join(live, "session").filter(F.col("turn_index").between(F.col("lo") - F.col("w"), F.col("hi") + F.col("w")))
    own = Window.partitionBy("request", "route", "anchor").orderBy("turn_index")
    user = F.last(F.when(F.col("t_role") == "user", F.struct("turn_index", "content")), ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, -1))
    late = F.sum(((F.col("t_role") == "assistant") & (F.col("turn_index") > F.col("hi"))).cast("int")).over(own)
    near = near.withColumn("user", user).withColumn("late", late).filter("t_role = 'assistant'")
    inside = F.when(F.col("role") == "assistant", F.col("turn_index") == F.col("lo")).when(F.col("role") == "user", (F.col("turn_index") > F.col("hi")) & (F.col("late") <= 2)).otherwise(F.col("turn_index").between(F.col("lo"), F.col("hi")))
    w = near.filter(inside).withColumn("id", F.concat_ws(":", F.lit("episode_window"), "session", "turn_index"))
    first = Window.partitionBy("request", "route", "id").orderBy("nth")
    w = w.withColumn("r", F.row_number().over(first)).filter("r = 1")
    total = F.least(F.lit(1.0), F.greatest(F.lit(0.0), "score") + 0.04 + F.greatest(F.lit(0.0), "assistant_bonus"))
    body = F.concat(F.coalesce(F.concat(F.lit("[user]: "), F.col("user.content"), F.lit("\n")), F.lit("")), F.lit("[assistant]: "), "content")
    return w.select(
        "request", "route", "id", F.lit("episode").alias("source"), F.lit("assistant_answer_window").alias("memory_type"), body.alias("text"), "session", F.coalesce("user.turn_index", "turn_index").alias("lo"), F.col("turn_index").alias("hi"),
        F.lit("assistant").alias("role"), _empty().alias("entities"), F.lit(None).cast("string").alias("t_start"), F.lit(None).cast("string").alias("t_end"), "created_at",
        total.alias("field"), F.greatest(total, F.col("retrieval")).alias("retrieval"), scoring.clamp(1 - total).alias("distance"),
        "queries", F.sort_array(F.array_union("channels", F.array(F.lit("assistant_answer_window")))).alias("channels"), "nodes",
    )


def excerpt(lines: DataFrame, keys: list[str], best: int = 12) -> DataFrame:
    """keys, text: the lines of each window that fit max_chars, else an excerpt.

    lines(keys..., turn_pos, line_pos, prefix, line, terms array, max_chars): terms are the query's. All lines stay if they
    fit. Else the best lines by shared terms stay with their neighbours of the same turn, and lines that tell a session's
    date; without any, the first four of each turn. "[...]" stands for what is left out between; the excerpt ends before the
    line that would exceed max_chars.
    """
    whole, order = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("turn_pos", "line_pos")
    t = lines.withColumn("shown", F.concat("prefix", F.lit(": "), "line"))
    t = t.withColumn("fits", (F.sum(F.length("shown") + 1).over(whole) - 1) <= F.col("max_chars"))
    own = text.query_terms(F.col("line"))
    both = F.size(F.array_intersect(own, F.col("terms")))
    t = t.withColumn("dated", text.casefold(F.col("line")).contains("session date"))
    t = t.withColumn("score", F.when(~F.col("dated") & (both > 0), both + F.least(F.lit(2.0), F.size(own) / 80.0)).otherwise(F.lit(0.0)))
    t = t.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), F.desc("turn_pos"), F.desc("line_pos"))))
    t = t.withColumn("top", (F.col("score") > 0) & (F.col("place") <= best))
    turn = Window.partitionBy(*keys, "turn_pos").orderBy("line_pos").rowsBetween(-1, 1)
    t = t.withColumn("taken", F.col("dated") | F.max("top").over(turn))
    t = t.withColumn("taken", F.when(F.max("taken").over(whole), F.col("taken")).otherwise(F.col("line_pos") < 4))
    t = t.filter(F.col("fits") | F.col("taken"))
    gap = ~F.col("fits") & F.lag("turn_pos").over(order).isNotNull() & ((F.lag("turn_pos").over(order) != F.col("turn_pos")) | (F.col("line_pos") > F.lag("line_pos").over(order) + 1))
    t = t.withColumn("gap", gap)
    mark = F.lit("[...]")
    upto = F.sum(F.length("shown") + 1 + F.when(F.col("gap"), F.lit(6)).otherwise(F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    t = t.withColumn("upto", upto)
    t = t.withColumn("line_in", F.col("fits") | (F.col("upto") <= F.col("max_chars"))).withColumn("gap_in", F.col("gap") & (F.col("upto") - F.length("shown") - 1 <= F.col("max_chars")))
    t = t.withColumn("none", ~F.max("line_in").over(whole)).withColumn("line_in", F.col("line_in") | (F.col("none") & (F.row_number().over(order) == 1)))
    t = t.withColumn("gap_in", F.col("gap_in") & ~F.col("none"))
    piece = F.concat(F.when(F.col("gap_in"), F.concat(mark, F.lit("\n"))).otherwise(F.lit("")), F.when(F.col("line_in"), F.col("shown")).otherwise(F.lit("")))
    t = t.filter("line_in or gap_in").withColumn("piece", F.rtrim(piece))
    rows = t.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("turn_pos", "line_pos", "piece"))).alias("rows"))  # bounded by the window
    return rows.select(*keys, F.array_join(F.transform("rows", lambda x: x["piece"]), "\n").alias("text"))


def source_windows(candidates: DataFrame, turns: DataFrame, requests: DataFrame, routes: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """Original dialogue around each route's best anchors, merged where windows touch.

    requests has k and the strategy's win_size, win_anchors, gap, chars; routes the goal. A merged window's score is that of
    its parts with .03 for each merge; its text has up to four anchors in front and an excerpt of its turns. With texts(id,
    text), candidates have REFERENCE and the anchors' texts are looked up.
    """
    r = requests.select("request", "k", "win_size", "win_anchors", "gap", "chars")
    # the limit counts all candidates, those without a session too
    order = Window.partitionBy("request", "route").orderBy(F.desc("score"), F.desc("retrieval"), "id")
    a = candidates.withColumn("score", anchor_score()).withColumn("nth", F.row_number().over(order)).join(r, "request")
    a = a.filter(F.col("nth") <= F.greatest(F.lit(1), F.least(F.greatest(F.lit(1), "k"), "win_anchors"))).filter("session is not null and session <> '' and lo is not null")
    a = stored(a, "best", release=True)  # so few that the turns need not move to them
    live = sessions.active(turns).select(F.col("session_id").cast("string").alias("session"), "turn_index", F.lower(F.trim("role")).alias("t_role"), F.trim("content").alias("content"), F.col("created_at").alias("t_created"))
    near = a.join(live, "session").filter(F.col("turn_index").between(F.col("lo") - F.col("win_size"), F.col("hi") + F.col("win_size")))
    found = near.groupBy(*KEYS).agg(F.min("turn_index").alias("w_lo"), F.max("turn_index").alias("w_hi"))
    a = (a if texts is None else with_texts(a, texts)).join(found, list(KEYS)).withColumnRenamed("id", "anchor")
    own = ["request", "route", "session"]
    by = Window.partitionBy(*own).orderBy("w_lo", "w_hi", "anchor")
    reach = F.max("w_hi").over(by.rowsBetween(Window.unboundedPreceding, -1))
    a = a.withColumn("new", (reach.isNull() | (F.col("w_lo") > reach + F.col("gap") + 1)).cast("int")).withColumn("island", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(*own, "island")
    a = a.withColumn("i", F.row_number().over(inside.orderBy("w_lo", "w_hi", "anchor"))).withColumn("n", F.count(F.lit(1)).over(inside))
    base = scoring.clamp(F.col("score"))
    one = F.when(F.col("n") == 1, base).otherwise(base + 0.03 * (F.col("n") - F.greatest("i", F.lit(2)) + 1))
    keys = [*own, "island"]
    lists = [F.sort_array(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in (*LISTS, "entities")]
    w = a.groupBy(*keys).agg(
        F.min("w_lo").alias("lo"), F.max("w_hi").alias("hi"), F.least(F.lit(1.0), F.max(one)).alias("field"), F.max("retrieval").alias("retrieval"), F.min("distance").alias("distance"), F.max("n").alias("n"), F.max("chars").alias("chars"),
        F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda x: x["text"]).alias("anchors"), F.min_by("created_at", "i").alias("created_at"), *lists,
    )
    w = w.withColumn("distance", F.when(F.col("n") > 1, scoring.clamp(1 - F.col("retrieval"))).otherwise(F.col("distance"))).join(routes.select("request", "route", "goal"), ["request", "route"], "left")
    w = w.withColumn("anchors", F.filter(F.array_distinct("anchors"), lambda x: x != ""))
    terms = text.query_terms(F.concat_ws(" ", F.coalesce("goal", F.lit("")), F.array_join("queries", " "), F.array_join("anchors", " ")))
    w = stored(w.withColumn("terms", terms), "windows", release=True)
    rows = w.select(*keys, "lo", "hi", "terms", F.greatest(F.lit(800), "chars").alias("max_chars")).join(live, "session").filter(F.col("turn_index").between(F.col("lo"), F.col("hi")))
    split = F.filter(F.transform(F.split("content", r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"), lambda x: F.trim(x)), lambda x: x != "")
    prefix = F.concat(F.lit("["), F.col("turn_index").cast("string"), F.lit(" role="), "t_role", F.lit("]"))
    lines = rows.select(*keys, F.col("turn_index").alias("turn_pos"), prefix.alias("prefix"), "terms", "max_chars", F.posexplode(split).alias("line_pos", "line"))
    body = excerpt(lines, keys)
    w = w.join(body.withColumnRenamed("text", "body"), keys)
    head = F.when(F.size("anchors") > 0, F.concat(F.lit("Anchor: "), F.array_join(F.slice("anchors", 1, 4), " | "), F.lit("\n"))).otherwise(F.lit(""))
    return w.select(
        "request", "route", F.concat(F.lit("source_window:"), "session", F.lit(":"), F.col("lo").cast("string"), F.lit("-"), F.col("hi").cast("string")).alias("id"), F.lit("episode").alias("source"), F.lit("source_window").alias("memory_type"),
        F.concat(head, F.lit("Original conversation:\n"), "body").alias("text"), "session", "lo", "hi", F.lit("both").alias("role"), "entities", F.lit(None).cast("string").alias("t_start"), F.lit(None).cast("string").alias("t_end"), "created_at",
        "field", "retrieval", "distance", "queries", F.sort_array(F.array_union("channels", F.array(F.lit("source_window")))).alias("channels"), "nodes",
    )


def neighbourhood(candidates: DataFrame, turns: DataFrame, requests: DataFrame, roles: tuple[str, ...] = ()) -> DataFrame:
    """Turns of the same session around each route's best candidates, as candidates of their own.

    requests has the strategy's exp_window, exp_limit and exp_score; roles narrows the turns. A turn near several anchors
    counts for the first; at most exp_limit turns a route stay.
    """
    r = requests.filter("exp_window > 0 and exp_limit > 0").select("request", "exp_window", "exp_limit", "exp_score", "assistant_bonus", "user_bonus")
    a = candidates.join(r, "request").withColumn("nth", F.row_number().over(Window.partitionBy("request", "route").orderBy(F.desc("field"), F.desc("retrieval"), "id")))
    a = a.filter("nth <= exp_limit and session is not null and lo is not null").select("request", "route", F.col("id").alias("anchor"), "nth", "session", "lo", "hi", F.greatest("field", "retrieval").alias("best"), "queries", "exp_window", "exp_limit", "exp_score", "assistant_bonus", "user_bonus")
    live = sessions.active(turns).select(F.col("session_id").cast("string").alias("session"), "turn_index", F.lower(F.trim("role")).alias("role"), F.trim("content").alias("content"), "created_at")
    live = live.filter(F.col("role").isin(*roles)) if roles else live
    near = a.join(live, "session").filter(F.col("turn_index").between(F.col("lo") - F.col("exp_window"), F.col("hi") + F.col("exp_window")))
    near = near.withColumn("id", F.concat_ws(":", "session", "turn_index"))
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("request", "route", "id").orderBy("nth"))).filter("r = 1")
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("request", "route").orderBy("nth", "turn_index"))).filter("r <= exp_limit")
    bonus = F.when(F.col("role") == "assistant", F.col("assistant_bonus")).when(F.col("role") == "user", F.col("user_bonus")).otherwise(F.lit(0.0))
    score = F.least(F.lit(1.0), F.col("exp_score") + 0.10 * scoring.clamp(F.col("best")) + bonus)
    return near.select(
        "request", "route", "id", F.lit("episode").alias("source"), F.lit("raw_turn").alias("memory_type"), F.concat(F.lit("["), "role", F.lit("]: "), "content").alias("text"), "session", F.col("turn_index").alias("lo"), F.col("turn_index").alias("hi"),
        "role", _empty().alias("entities"), F.lit(None).cast("string").alias("t_start"), F.lit(None).cast("string").alias("t_end"), "created_at", score.alias("field"), score.alias("retrieval"), scoring.clamp(1 - score).alias("distance"),
        "queries", F.array(F.lit("same_session_window")).alias("channels"), _empty().alias("nodes"),
    )


def scored(candidates: DataFrame, rerank: DataFrame | None = None) -> DataFrame:
    """Candidates with final score and rank in their route.

    rerank(request, route, id, rerank), a row a candidate at most. A column source_weight of the candidates, where it is there
    and not null, stands for the weight of their source.
    """
    bonus = scoring.signal_bonus(F.col("distance"), F.size("queries"))
    t = candidates if rerank is None else candidates.join(rerank, list(KEYS), "left")
    weight = scoring.source_weight(F.col("source"), F.col("source_weight") if "source_weight" in candidates.columns else None)
    final = scoring.final_score(F.col("field"), weight, bonus, None if rerank is None else F.col("rerank"))
    t = t.withColumn("final", F.round(final, 9))
    return t.withColumn("rank", F.row_number().over(Window.partitionBy("request", "route").orderBy(F.desc("final"), "id")))


def rerank_pool(candidates: DataFrame, limit: int) -> DataFrame:
    """request, route, n, id: the candidates of each route that a reranker gets, numbered from 0, best first."""
    best = Window.partitionBy("request", "route").orderBy(F.desc("field"), "id")
    return candidates.select("request", "route", "id", (F.row_number().over(best) - 1).alias("n")).filter(F.col("n") < limit)


def reranked(pool: DataFrame, answers: DataFrame) -> DataFrame:
    """request, route, id, rerank: what rerankers' answers (request, route, answer) say of their pools.

    Results whose index is outside of the pool go; of two for one candidate the later counts; candidates without a result
    have no row, and so keep their field score in `scored`. Both sides are bounded by the pool's limit a route.
    """
    given = answers.select("request", "route", F.posexplode(loose.rerank_items(F.col("answer"))).alias("place", "r"))
    last = given.groupBy("request", "route", F.col("r.index").alias("n")).agg(F.max_by("r.score", "place").alias("raw"))
    return pool.join(last, ["request", "route", "n"]).select("request", "route", "id", scoring.rerank_score(F.col("raw")).alias("rerank"))


def requests_of(plans: DataFrame, k: int) -> DataFrame:
    """Requests with their strategy: plans(plan_id, query, question_type, since, until)."""
    t = plans_io.with_strategy(plans).withColumn("k", F.lit(k))
    return t.withColumnRenamed("plan_id", "request")


def route_search(requests: DataFrame, routes: DataFrame, channels: list[DataFrame], turns: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """Scored candidates of every route, from the channels' hits.

    With texts(id, text) the channels' text is left where it is: such candidates have REFERENCE instead, for `with_texts`.
    """
    if texts is not None:
        channels = [c.withColumn("text", F.lit(None).cast("string")) for c in channels]
    found = stored(boosted(merged(*channels, more=REFERENCE if texts is not None else ()), requests), "found", release=True)
    anchors = stored(united(found, answer_windows(found, turns, requests)), "anchors", release=True)
    return scored(united(anchors, source_windows(anchors, turns, requests, routes, texts)))


def search(requests: DataFrame, routes: DataFrame, channels: list[DataFrame], turns: DataFrame, k: int, texts: DataFrame | None = None) -> DataFrame:
    """The k best candidates of each request over its routes, in order (K22): fusion, diversity, dialogue budget.

    Candidates are as many as the evidence leads to, so their texts stay in texts(id, text) (see `texts_of`; else in the
    channels), and only the rows that are compared or returned get theirs.
    """
    if texts is None:
        texts = channels[0].select("id", "text")
        for c in channels[1:]:
            texts = texts.unionByName(c.select("id", "text"))
    requests, routes = stored(requests, "requests"), stored(routes, "routes")
    ranked = stored(route_search(requests, routes, channels, turns, texts).join(routes.select("request", "route", "route_no", "goal"), ["request", "route"]), "ranked", release=True)
    hits = ranked.select("request", "route", "route_no", "id", F.col("final").alias("score"))
    fused = stored(ranking.rrf(hits, k), "fused", release=True)
    matches = F.sort_array(F.collect_set(F.struct("rank", "route", "goal")))  # a row a route (A16, P31)
    order = F.struct(F.col("final"), -F.col("route_no"))  # of equal ones the first route's

    def best(ids: DataFrame) -> DataFrame:
        rows = ranked.join(ids.select("request", "id"), ["request", "id"], "left_semi")
        return rows.groupBy("request", "id").agg(F.max_by(F.struct(*PAYLOAD, *REFERENCE, "distance", *LISTS), order).alias("p"), matches.alias("matched"))

    chosen = stored(fused.join(best(fused), ["request", "id"]).select("request", "id", "score", "p.*", F.transform("matched", lambda m: m["route"]).alias("routes")), "chosen", release=True)
    turns_of = F.when(F.col("lo").isNull(), _empty("array<int>")).otherwise(F.sequence("lo", "hi"))
    varied = ranking.mmr(with_texts(chosen, texts).select("request", "id", "score", "text", "session", "entities", "queries", "nodes", turns_of.alias("turns")), k)
    selected = stored(varied.join(chosen.select("request", "id", "source", "routes"), ["request", "id"]), "selected", release=True)
    top = ranked.groupBy("request", "id").agg(F.max("final").alias("score"), F.max_by("source", order).alias("source"))
    budgeted = selected.join(requests.select("request", "episode_ratio", "min_ratio"), "request")
    out = stored(ranking.episode_budget(budgeted, top, k, F.col("episode_ratio"), F.col("min_ratio")).drop("source"), "out", release=True)
    return with_texts(stored(out.join(best(out).select("request", "id", "p.*", "matched"), ["request", "id"]), "results", release=True), texts)


def debug_payload(candidates: DataFrame, most: int = 500) -> DataFrame:
    """Candidates as a trace shows them, texts over most characters cut."""
    shown = F.trim(F.coalesce("text", F.lit("")))
    shown = F.when(F.length(shown) > most, F.concat(F.substring(shown, 1, most), F.lit("..."))).otherwise(shown)
    own = lambda c, kind: F.col(c) if c in candidates.columns else F.lit(None).cast(kind)
    return candidates.select(
        "request", "route", F.coalesce("id", F.lit("")).alias("id"), "source", "memory_type", F.col("role").alias("source_role"), F.col("field").alias("field_score"), F.col("distance").alias("semantic_distance"), F.col("retrieval").alias("retrieval_score"),
        own("rerank", "double").alias("rerank_score"), own("final", "double").alias("final_score"), F.col("queries").alias("matched_queries"), F.col("channels").alias("matched_channels"), F.col("nodes").alias("matched_evidence_nodes"),
        "created_at", F.when(F.col("source") == "episode", F.col("created_at")).alias("source_dialogue_time"), F.col("session").alias("source_session"), F.when(F.col("lo").isNotNull(), F.sequence("lo", "hi")).alias("evidence_turn_range"),
        F.coalesce(F.col("hi") - F.col("lo") + 1, F.lit(0)).alias("source_turn_count"), "entities", F.struct(F.col("t_start").alias("start"), F.col("t_end").alias("end")).alias("temporal"), shown.alias("text"),
    )


def context_document(results: DataFrame) -> DataFrame:
    """request, context: the numbered document of a request's results(request, place, text, source, t_start, t_end, created_at)."""
    labels = F.array_distinct(F.filter(F.array(temporal.time_label(F.col("t_start")), temporal.time_label(F.col("t_end"))), lambda x: F.coalesce(x, F.lit("")) != ""))
    times = F.when(F.size(labels) > 0, F.concat(F.lit("Time: "), F.array_join(labels, " | ")))
    said = F.when((F.col("source") == "episode") & (F.coalesce("created_at", F.lit("")) != ""), F.concat(F.lit("Conversation time: "), temporal.time_label(F.col("created_at"))))
    part = F.concat_ws("\n", F.concat(F.lit("["), F.col("place").cast("string"), F.lit("]")), times, said, F.nullif(F.trim("text"), F.lit("")))
    rows = results.groupBy("request").agg(F.sort_array(F.collect_list(F.struct("place", part.alias("part")))).alias("rows"))  # k rows
    return rows.select("request", F.array_join(F.transform("rows", lambda x: x["part"]), "\n\n").alias("context"))


def provenance(results: DataFrame) -> DataFrame:
    """A row a result with what it rests on."""
    first = F.get("matched", F.lit(0))
    return results.select(
        "request", "place", F.col("id").alias("record_id"), "source", "memory_type", F.col("source").alias("semantic_source_type"), F.round("score", 6).alias("score"), F.col("text").alias("display_text"), "created_at",
        F.when(F.col("source") == "episode", F.col("created_at")).alias("source_dialogue_time"), F.struct(F.col("t_start").alias("start"), F.col("t_end").alias("end")).alias("temporal"), "entities", F.col("queries").alias("matched_queries"),
        F.col("nodes").alias("matched_evidence_nodes"), F.col("matched").alias("matched_routes"), first["route"].alias("primary_route_id"), first["goal"].alias("primary_route_goal"), first["rank"].alias("route_rank"),
        F.col("session").alias("source_session"), F.col("role").alias("source_role"), F.when(F.col("lo").isNotNull(), F.sequence("lo", "hi")).alias("evidence_turn_range"),
    )
