"""Payloads and texts made of rows: prompts, encoder and reranker inputs, action states, graph nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import casefold, clean_terms, distinct_folded
from . import sessions


def _of(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.trim(F.coalesce(c, F.lit("")))


def short_list(c: Column, limit: int = 12) -> Column:
    """Trimmed, non-empty texts, distinct without regard to case, at most limit."""
    return F.slice(distinct_folded(clean_terms(c)), F.lit(1), F.lit(limit))


def truncated(c: Column, limit: int) -> Column:
    """A text cut to limit characters, with dots where it was cut."""
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("..."))).otherwise(c)


def turn_markers(turns: DataFrame) -> DataFrame:
    """session_id, section: a session's turns between markers, a leading speaker's name taken off.

    turns(session_id, turn_index, role, speaker, content).
    """
    speaker, content = _of("speaker"), _of("content")
    named = (speaker != "") & F.startswith(casefold(content), casefold(F.concat(speaker, F.lit(":"))))
    body = F.when(named, F.ltrim(F.substring(content, F.length(speaker) + 2, F.length(content)))).otherwise(content)
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    at = F.row_number().over(Window.partitionBy("session_id").orderBy("turn_index")) - 1
    role = F.when(_of("role") == "", F.lit("unknown")).otherwise(_of("role"))
    head = F.concat(F.lit("<TURN index="), F.col("at").cast("string"), F.lit(" role="), quoted(role), F.when(speaker != "", F.concat(F.lit(" speaker="), quoted(speaker))).otherwise(F.lit("")), F.lit(">"))
    t = turns.withColumn("at", at).select("session_id", "at", F.concat(head, F.lit("\n"), body, F.lit("\n</TURN>")).alias("line"))
    t = t.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("at", "line"))).alias("lines"))
    return t.select("session_id", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("section"))


def recent_context(turns: DataFrame, summaries: DataFrame, limit: int = 2000) -> DataFrame:
    """session_id, context: the last two summaries and the last six turns, the last limit characters of them.

    turns(session_id, turn_index, role, content), summaries(session_id, boundary_index, content).
    """
    last = lambda t, order, n: t.withColumn("back", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc(order)))).filter(F.col("back") <= n)
    s = last(summaries, "boundary_index", 2).select("session_id", F.lit(0).alias("kind"), "back", F.concat(F.lit("Summary: "), _of("content")).alias("line"), _of("content").alias("c"))
    t = last(turns, "turn_index", 6).select("session_id", F.lit(1).alias("kind"), "back", F.concat(F.coalesce(F.nullif(_of("role"), F.lit("")), F.lit("unknown")), F.lit(": "), _of("content")).alias("line"), _of("content").alias("c"))
    rows = s.unionByName(t).filter("c <> ''").groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("kind", (-F.col("back")).alias("o"), "line"))).alias("lines"))
    return rows.select("session_id", F.right(F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), F.lit(limit)).alias("context"))


def action_state(rows: DataFrame) -> DataFrame:
    """The action state of each request, every part cut to its length.

    rows(request, query, recent_context, token_usage, tool_calls array<struct<name, result>>, tentative_action,
    known_constraints, available_tools, failure_signal).
    """
    tool = F.get("tool_calls", F.size("tool_calls") - 1)
    name, result = _of(tool["name"]), _of(tool["result"])
    tools = F.coalesce("available_tools", F.array().cast("array<string>"))
    tools = F.when((name != "") & ~F.array_contains(tools, name), F.array_append(tools, name)).otherwise(tools)
    return rows.select(
        "request", _of("query").alias("current_subgoal"), _of("tentative_action").alias("tentative_action"), name.alias("last_tool_name"), F.substring(result, 1, 500).alias("last_tool_result"),
        F.slice(F.coalesce("known_constraints", F.array().cast("array<string>")), 1, 6).alias("known_constraints"), F.slice(tools, 1, 8).alias("available_tools"), F.substring(_of("failure_signal"), 1, 160).alias("failure_signal"),
        F.greatest(F.lit(0), "token_usage").alias("token_budget"), F.substring(F.coalesce("recent_context", F.lit("")), 1, 1000).alias("recent_context_excerpt"),
    )


def skill_query(query: Column, action: Column, mode: Column, pragmatic: Column) -> Column:
    """Query, tentative action and, unless only an answer is wanted, pragmatic queries, each once."""
    none = F.array().cast("array<string>")
    more = F.when(F.lower(F.trim(mode)).isin("action", "mixed"), F.transform(F.coalesce(pragmatic, none), lambda x: F.trim(x))).otherwise(none)
    rest = F.filter(F.concat(F.array(_of(action)), more), lambda x: x != "")
    return F.array_join(F.array_distinct(F.concat(F.array(_of(query)), rest)), "；")


def turn_bounds(turns: Column) -> Column:
    """First and last of a list of turns, null for an empty or missing one."""
    return F.struct(F.array_min(turns).alias("first"), F.array_max(turns).alias("last"))


def skill_gate(mode: Column, procedural: Column, k: Column) -> Column:
    """How many skills to fetch; 0: none."""
    m = F.coalesce(F.nullif(F.lower(F.trim(mode)), F.lit("")), F.lit("answer"))
    return F.when((m == "answer") & ~F.coalesce(procedural, F.lit(False)), F.lit(0)).when(m == "mixed", F.greatest(F.lit(1), k - 1)).when(m == "answer", F.lit(1)).otherwise(k)


def reusable(score: Column, mode: Column, threshold: float = 0.85) -> Column:
    """Whether a skill is near enough to be used again; actions ask for less."""
    return score >= F.when(mode == "action", F.lit(threshold - 0.05)).otherwise(F.lit(threshold))


def top_skills(skills: DataFrame, k: int = 2) -> DataFrame:
    """The k best skills of each request, from the reusable ones if there are any (T7, W14). skills(request, skill_id, score, reusable)."""
    any_ = F.max(F.col("reusable").cast("int")).over(Window.partitionBy("request"))
    t = skills.withColumn("any", any_).filter("reusable or any = 0")
    return t.withColumn("place", F.row_number().over(Window.partitionBy("request").orderBy(F.desc("score"), "skill_id"))).filter(F.col("place") <= k).drop("any")


def rerank_query(query: Column, question_type: Column, queries: Column, target: Column, constraints: Column) -> Column:
    """What a cross-encoder is asked (P25)."""
    line = lambda head, c: F.when(c != "", F.concat(F.lit(head), c))
    joined = lambda c, n=12: F.array_join(short_list(c, n), " | ")
    return F.concat_ws("\n", F.concat(F.lit("User query: "), _of(query)), line("Question traits: question_type=", _of(question_type)), line("Semantic queries: ", joined(queries)), line("Evidence target: ", _of(target)), line("Constraints: ", joined(constraints, 8)))


def rerank_text(text: Column, source: Column, memory_type: Column, session: Column, time: Column, channels: Column, entities: Column, tags: Column, nodes: Column, score: Column) -> Column:
    """A candidate as a cross-encoder reads it (P25)."""
    line = lambda head, c: F.when(c != "", F.concat(F.lit(head), c))
    joined = lambda c, sep, n=12: F.array_join(short_list(c, n), sep)
    return F.concat_ws(
        "\n", line("Text: ", _of(text)), F.concat(F.lit("Source: "), source), line("Memory type: ", _of(memory_type)), line("Source session: ", _of(session)), line("Source dialogue time: ", _of(time)), line("Matched channels: ", joined(channels, " | ")),
        line("Entities: ", joined(entities, ", ")), line("Tags: ", joined(tags, ", ")), line("Matched evidence nodes: ", joined(nodes, " | ", 8)), F.concat(F.lit("Retrieval score: "), F.format_string("%.4f", score)),
    )


def rerank_scores(response: Column) -> Column:
    """index and score of each result in a reranker's JSON answer, whatever names it uses; malformed answers give none."""
    item = "struct<index:int,document_index:int,doc_index:int,relevance_score:double,relevance:double,score:double,rerank_score:double>"
    lists = F.from_json(response, f"data array<{item}>, results array<{item}>, rerank_results array<{item}>")
    bare = F.from_json(response, f"array<{item}>")
    items = F.coalesce(F.when(F.startswith(F.trim(response), F.lit("[")), bare), lists["data"], lists["results"], lists["rerank_results"], F.array().cast(f"array<{item}>"))
    first = lambda x, *names: F.coalesce(*[x[n] for n in names])
    return F.transform(items, lambda x: F.struct(F.coalesce(first(x, "index", "document_index", "doc_index"), F.lit(-1)).alias("index"), F.coalesce(first(x, "relevance_score", "relevance", "score", "rerank_score"), F.lit(0.0)).alias("score")))


def hit_text(context: Column, provenance: Column, name: Column) -> Column:
    """A memory hit's text: its context, else the first 20 lines of its provenance, else its name."""
    lines = F.filter(F.transform(F.slice(provenance, 1, 20), lambda x: _of(x)), lambda x: x != "")
    body = F.array_join(F.transform(lines, lambda x: F.concat(F.lit("- "), x)), "\n")
    return F.coalesce(F.nullif(_of(context), F.lit("")), F.nullif(body, F.lit("")), _of(name))


def background(visual: Column, texts: Column) -> Column:
    """The distinct parts of a background context, the visual one in front."""
    return F.array_join(F.filter(F.concat(F.array(_of(visual)), F.array_distinct(texts)), lambda x: x != ""), "\n\n")


def result_total(provenance_sizes: Column, n_skills: Column) -> Column:
    """Rows behind a result: those of each memory, one at least, and the skills."""
    return F.aggregate(provenance_sizes, F.lit(0), lambda a, x: a + F.greatest(x, F.lit(1))) + n_skills


def last_message(messages: Column) -> Column:
    """struct(message, history): the last user message of a chat, and the turns before it as text (P22). messages: array<struct<role, content>>."""
    place = F.size(messages) - F.array_position(F.reverse(F.transform(messages, lambda m: m["role"])), F.lit("user")).cast("int")
    before = F.filter(messages, lambda m, i: (i < place) & (_of(m["content"]) != ""))
    said = F.array_join(F.transform(before, lambda m: F.concat(m["role"], F.lit(": "), _of(m["content"]))), "\n")
    return F.struct(_of(F.get(messages, place)["content"]).alias("message"), said.alias("history"))


def auto_consolidate(consolidate: Column, store: Column) -> Column:
    """The first flag that is set, else true (F16)."""
    return F.coalesce(consolidate, store, F.lit(True))


def normalized_turn(role: Column, content: Column) -> Column:
    """A turn's trimmed content; null for empty turns and users' commands."""
    c = F.trim(content)
    return F.when((c != "") & ~((role == "user") & F.startswith(c, F.lit("/"))), c)


def evidence_turns(turns: Column, offset: Column, count: Column) -> Column:
    """Absolute turn indices of those within the section, distinct and sorted."""
    return F.sort_array(F.array_distinct(F.transform(F.filter(turns, lambda x: (x >= 0) & (x < count)), lambda x: x + F.greatest(F.lit(0), offset))))


def session_alias(key: Column, session: Column, channel: Column, conversation: Column) -> Column:
    """The state key of a session: its key, else session, conversation or channel."""
    has = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(has(key), F.concat(F.lit("session:"), has(session)), F.concat(F.lit("conversation:"), has(channel), F.lit(":"), has(conversation)), F.concat(F.lit("channel:"), has(channel)))


def disambiguation(note: Column, limit: int = 1200) -> Column:
    """A note's non-empty lines, trimmed, and cut to its length."""
    lines = F.filter(F.transform(F.split(F.coalesce(note, F.lit("")), r"\r\n|\n|\r"), lambda x: F.trim(x)), lambda x: x != "")
    return F.rtrim(F.substring(F.array_join(lines, "\n"), 1, limit))


def reference_context(notes: Column, texts: Column, most: int = 12, limit: int = 2400) -> Column:
    """A session's reference: its note and its last distinct record texts."""
    kept = F.filter(F.array_distinct(F.transform(texts, lambda x: F.trim(x))), lambda x: x != "")
    kept = F.when(F.size(kept) > most, F.slice(kept, F.size(kept) - most + 1, F.lit(most))).otherwise(kept)
    part = lambda head, c: F.when(c != "", F.concat(F.lit(head), c))
    body = F.array_join(F.transform(kept, lambda x: F.concat(F.lit("- "), x)), "\n")
    return F.rtrim(F.substring(F.concat_ws("\n", part("Resolved references: ", _of(notes)), part("Recent same-session records:\n", body)), 1, limit))


def last_texts(rows: DataFrame, key: str, most: int = 12) -> DataFrame:
    """key, texts: the last distinct trimmed texts of rows(key, at, text), in the order in which each first came.

    Equal texts of a key meet before they are ranked, and only most of them are collected. Keys without a text have none.
    """
    first = rows.groupBy(key, F.trim(F.coalesce("text", F.lit(""))).alias("text")).agg(F.min("at").alias("at"))
    last = F.row_number().over(Window.partitionBy(key).orderBy((F.col("text") == "").cast("int"), F.desc("at"), F.desc("text")))
    few = first.withColumn("n", last).filter(F.col("n") <= most)
    texts = F.sort_array(F.collect_list(F.when(F.col("text") != "", F.struct((-F.col("n")).alias("o"), "text"))))
    return few.groupBy(key).agg(texts.alias("x")).select(key, F.transform("x", lambda x: x["text"]).alias("texts"))


def repaired_json(c: Column, schema: str) -> Column:
    """A model's JSON: in a fence, bare, between the outermost braces, or with Python's literals."""
    block = F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    plain = F.when(block != "", block).otherwise(F.trim(c))
    outer = F.regexp_extract(plain, r"(?s)(\{.*\})", 1)
    fixed = plain
    for a, b in (("'", '"'), ("True", "true"), ("False", "false"), ("None", "null")):
        fixed = F.replace(fixed, F.lit(a), F.lit(b))
    text = None
    for x in (plain, outer, fixed):
        good = F.when(F.coalesce(F.json_array_length(F.concat(F.lit("["), x, F.lit("]"))), F.lit(0)) == 1, x)
        text = good if text is None else F.coalesce(text, good)
    return F.from_json(text, schema)


#: Kinds of scenes.
SCENES = ("screenshot", "chart", "photo", "document", "ui", "code", "other")


def checked_extraction(c: Column) -> Column:
    """A vision model's answer with defaults for what is missing or out of range."""
    found = repaired_json(c, "caption string, scene_type string, entities array<string>, importance_score double")
    failed = found.isNull() | (found["caption"].isNull() & found["scene_type"].isNull() & found["importance_score"].isNull())
    score = F.when(failed, F.lit(0.3)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(found["importance_score"], F.lit(0.5)))))
    return F.struct(
        F.coalesce(found["caption"], F.lit("")).alias("caption"), F.when(found["scene_type"].isin(*SCENES), found["scene_type"]).otherwise(F.lit("other")).alias("scene_type"),
        F.coalesce(found["entities"], F.array().cast("array<string>")).alias("entities"), score.alias("importance_score"),
    )


def grounding(records: DataFrame, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges record -> turn, turns with their records): the canonical record of a turn is the earliest, then the smallest id.

    records(record_id, session_id, lo, hi, created_at); turns(session_id, turn_index, role, content).
    """
    rank = F.row_number().over(Window.partitionBy("session_id", "turn_index").orderBy("created_at", "record_id"))
    met = records.select("record_id", "session_id", "lo", "hi", "created_at").join(turns.select("session_id", "turn_index", "role", "content"), "session_id").filter(F.col("turn_index").between(F.col("lo"), F.col("hi")))
    edges = met.select("record_id", F.concat_ws(":", F.col("session_id").cast("string"), "turn_index").alias("episode_id"), "session_id", "turn_index", "role", "content", rank.alias("rank"))
    nodes = edges.groupBy("episode_id").agg(
        F.count(F.lit(1)).alias("grounded_record_count"), F.max(F.when(F.col("rank") == 1, F.col("record_id"))).alias("canonical_record_id"), F.first(truncated(F.concat("role", F.lit(": "), "content"), 120)).alias("name"),
    )
    return edges.select("record_id", "episode_id", "rank"), nodes


def listing(turns: DataFrame, meta: DataFrame) -> DataFrame:
    """Session listing with each session's topic and tags, if it has any (J12, P17). meta(session_id, topic, tags)."""
    t = sessions.summaries(turns).join(meta, "session_id", "left")
    return t.withColumn("title", F.coalesce(F.nullif(F.trim("topic"), F.lit("")), "title")).drop("topic")


def normalized_plan(plan: Column, query: Column) -> Column:
    """A planner's answer in the coordinator's form, with the older names for aggregates."""
    texts = "array<string>"
    p = F.from_json(plan, f"mode string, question_type string, reason string, reasoning string, is_aggregate_query boolean, semantic_queries {texts}, pragmatic_queries {texts}, evidence_target string, aggregate_target string, evidence_constraints {texts}, aggregate_constraints {texts}")
    clean = lambda c: F.filter(F.coalesce(c, F.array().cast(texts)), lambda x: _of(x) != "")
    some = lambda a, b: F.when(F.size(a) > 0, a).otherwise(b)
    has = lambda c: F.nullif(c, F.lit(""))
    aggregate = F.coalesce(p["is_aggregate_query"], F.lit(False)) | (F.lower(F.trim(F.coalesce(p["question_type"], F.lit("")))) == "aggregate")
    queries = clean(p["semantic_queries"])
    return F.struct(
        F.coalesce(has(p["mode"]), F.lit("answer")).alias("mode"), F.coalesce(has(p["reason"]), p["reasoning"], F.lit("")).alias("reason"), F.coalesce(has(p["question_type"]), F.when(aggregate, "aggregate").otherwise("single")).alias("question_type"), aggregate.alias("is_aggregate_query"),
        F.when(aggregate, some(queries, F.array(_of(query)))).otherwise(queries).alias("semantic_queries"), clean(p["pragmatic_queries"]).alias("pragmatic_queries"), F.coalesce(has(p["evidence_target"]), has(p["aggregate_target"]), query, F.lit("")).alias("evidence_target"),
        some(clean(p["evidence_constraints"]), clean(p["aggregate_constraints"])).alias("evidence_constraints"), F.when(aggregate, _of(p["aggregate_target"])).otherwise(F.lit("")).alias("aggregate_target"),
    )


def trimmed_response(rows: DataFrame, level: Column) -> DataFrame:
    """A search response by level: minimal keeps the context, compact the counts too, full all of it.

    rows(request, context, provenance array, skills array).
    """
    lists = lambda c: F.when(level == "full", F.col(c)).otherwise(F.slice(F.col(c), 1, 0))
    counts = F.when(level == "minimal", F.lit(None)).otherwise(F.greatest(F.lit(1), F.size("provenance")) + F.size("skills"))
    return rows.select("request", level.alias("level"), "context", lists("provenance").alias("provenance"), lists("skills").alias("skills"), counts.alias("total"))


def visual_context(hits: DataFrame, k: int = 3) -> DataFrame:
    """request, context: the k best images of each request as lines (P26). hits(request, id, score, caption, scene_type)."""
    t = hits.withColumn("place", F.row_number().over(Window.partitionBy("request").orderBy(F.desc("score"), "id"))).filter(F.col("place") <= k)
    line = F.concat(F.lit("["), F.col("place").cast("string"), F.lit("] ("), "scene_type", F.lit(") "), "caption")
    t = t.groupBy("request").agg(F.sort_array(F.collect_list(F.struct("place", line.alias("line")))).alias("lines"))
    return t.select("request", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("context"))


def token_usage(prompt: Column, answer: Column) -> Column:
    """Token counts as a compatible chat interface tells them."""
    p, a = F.coalesce(prompt, F.lit(0)), F.coalesce(answer, F.lit(0))
    return F.struct(p.alias("prompt_tokens"), a.alias("completion_tokens"), (p + a).alias("total_tokens"))
