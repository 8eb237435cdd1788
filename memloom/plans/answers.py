"""The driver's queries for models' answers of any shape, reranked scores and visual rows, with equivalent SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import loose_json as loose
from ..operators import compaction, plans_io, query_cache, search, stores
from ..sources import tables
from ..sources.shared import stored
from .catalog import _TURNS, _tokens, query
from .retrieval import _BOOSTED, _S, _SHOWN, _channels, _requests, _shown

# ---- planners -------------------------------------------------------------------------------------------------

_PLANNED = "d AS (SELECT doc_id, doc_id % 5 AS kind, coalesce(source, 'none') AS s, coalesce(lang, 'xx') AS l FROM documents)"


def _joined(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _planned(spark, d) -> DataFrame:
    """Answers about every document: a full one in a fence, no JSON, values of odd kinds, the older names, and more of all than is kept."""
    i, s, lang = F.col("doc_id") % 5, F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("xx"))
    full = _joined('```json\n{"mode": " Mixed ", "question_type": "Prior-Assistant Response", "semantic_queries": ["', F.upper(s), '", "of ', lang, '", " ", 7, null], "pragmatic_queries": ["do ', lang, '"], "temporal_filter": {"since": "2024-03-01", "until": "soon"}, ')
    full = _joined(full, '"constraints": [{"type": "lang", "text": " ', lang, '"}, "bare", {"kind": "x"}], "evidence_routes": [{"objective": "goal ', lang, '"}, "no route", {"route_id": "b", "queries": ["Move", "MOVE"]}, {"route_id": "c"}]}\n```')
    odd = _joined('{"semantic_queries": "only ', lang, '", "mode": 5, "question_type": ["x"], "constraints": "none", "evidence_routes": {"goal": "g"}, "is_aggregate_query": true}')
    older = _joined('{"kind": "comparison", "is_aggregate_query": false, "aggregate_target": "T ', lang, '", "aggregate_constraints": ["c", "", 0, true], "evidence_constraints": [], "temporal_filter": {"until": "2024-05-06"}}')
    many = '{"semantic_queries": [' + ", ".join(f'"q{n}"' for n in range(1, 30)) + '], "constraints": [' + ", ".join(f'"n{n}"' for n in range(20)) + '], "evidence_routes": [' + ", ".join(f'{{"goal": "g{n}", "constraints": [{{"kind": "k", "value": "{n}"}}]}}' for n in range(11)) + "]}"
    answer = F.when(i == 0, full).when(i == 1, _joined("{oops ", s)).when(i == 2, odd).when(i == 3, older).otherwise(F.lit(many))
    return plans_io.planner_answers(tables.read(spark, d, "documents").select(F.col("doc_id").alias("plan_id"), s.alias("query"), answer.alias("answer")))


@query(f"""WITH {_PLANNED}, a AS (SELECT *, CASE kind WHEN 0 THEN [s, 'of ' || l, '7', 'do ' || l] WHEN 2 THEN [s, 'only ' || l] WHEN 3 THEN [s, 'T ' || l, 'c', 'true'] WHEN 4 THEN list_prepend(s, list_transform(range(1, 17), lambda i: 'q' || i)) ELSE [s] END AS asked FROM d)
    SELECT doc_id AS plan_id, CASE kind WHEN 0 THEN 'mixed' ELSE 'answer' END AS mode, CASE kind WHEN 0 THEN 'prior_assistant_response' WHEN 3 THEN 'comparison' ELSE 'single' END AS question_type,
    CASE kind WHEN 0 THEN [upper(s), 'of ' || l, '7'] WHEN 2 THEN ['only ' || l] WHEN 4 THEN list_transform(range(1, 17), lambda i: 'q' || i) ELSE [s] END AS semantic_queries, CASE kind WHEN 3 THEN 'T ' || l ELSE s END AS evidence_target,
    CASE kind WHEN 3 THEN ['c', 'true'] ELSE []::VARCHAR[] END AS evidence_constraints, CASE kind WHEN 0 THEN ['lang: ' || l, 'other: bare'] WHEN 4 THEN list_transform(range(12), lambda i: 'other: n' || i) ELSE []::VARCHAR[] END AS constraints,
    CASE kind WHEN 0 THEN ['r1', 'b'] WHEN 4 THEN list_transform(range(1, 9), lambda i: 'r' || i) ELSE ['r1'] END AS route_ids, asked AS first_queries, CASE kind WHEN 0 THEN '2024-03-01' END AS since FROM a""")
def planner_plans(spark, d):
    """Executable plans from planners' answers."""
    p = _planned(spark, d)
    return p.select(
        "plan_id", "mode", "question_type", "semantic_queries", "evidence_target", "evidence_constraints", plans_io.constraint_texts(F.col("constraints")).alias("constraints"),
        F.transform("evidence_routes", lambda r: r["route_id"]).alias("route_ids"), F.get("evidence_routes", F.lit(0))["queries"].alias("first_queries"), F.col("temporal_filter.since").alias("since"),
    )


@query(f"""WITH {_PLANNED}, r AS (SELECT *, unnest(CASE kind WHEN 0 THEN [1, 2] WHEN 4 THEN range(1, 9)::INTEGER[] ELSE [1] END) AS n FROM d),
    g AS (SELECT *, CASE kind WHEN 0 THEN CASE n WHEN 1 THEN 'goal ' || l ELSE s END WHEN 3 THEN 'T ' || l WHEN 4 THEN 'g' || (n - 1) ELSE s END AS goal FROM r)
    SELECT doc_id AS plan_id, n AS route_no, CASE WHEN kind = 0 AND n = 2 THEN 'b' ELSE 'r' || n END AS route_id,
    CASE kind WHEN 0 THEN CASE n WHEN 1 THEN [goal, s, 'of ' || l, '7', 'do ' || l] ELSE [s, 'Move'] END WHEN 2 THEN [s, 'only ' || l] WHEN 3 THEN [goal, s, 'c', 'true'] WHEN 4 THEN [goal, s, 'q1', 'q2', 'q3', 'q4', 'q5', 'q6'] ELSE [s] END AS semantic_queries,
    CASE kind WHEN 0 THEN '2024-03-01' END AS since, CASE kind WHEN 3 THEN '2024-05-06' END AS until, CASE kind WHEN 3 THEN ['c', 'true'] WHEN 4 THEN ['k: ' || (n - 1)] ELSE []::VARCHAR[] END AS evidence_constraints,
    'Question: ' || s || chr(10) || 'Evidence goal: ' || goal || CASE kind WHEN 4 THEN chr(10) || 'Required constraints: k: ' || (n - 1) ELSE '' END AS rerank_query FROM g""")
def route_searches(spark, d):
    """What each route of the plans asks, and what a reranker reads of it."""
    return plans_io.route_plans(_planned(spark, d)).select("plan_id", "route_no", "route_id", "semantic_queries", "since", "until", "evidence_constraints", "rerank_query")


@query("""SELECT doc_id, ['{"lang":"' || coalesce(lang, 'xx') || '","n":{"b":2,"a":' || doc_id || '}}', '"' || coalesce(lang, 'xx') || '"', '[1,2]', '[2,1]', '{oops'] AS kept FROM documents""")
def distinct_values(spark, d):
    """Values of any kind, each once whatever the order of its keys and its blanks."""
    lang, i = F.coalesce("lang", F.lit("xx")), F.col("doc_id").cast("string")
    given = F.array(
        _joined('{"lang":"', lang, '","n":{"b":2,"a":', i, "}}"), F.lit(""), _joined('{"n": {"a": ', i, ', "b": 2}, "lang": "', lang, '"}'), F.lit("null"), F.lit(None).cast("string"), _joined('"', lang, '"'), _joined(' "', lang, '" '),
        F.lit("[1,2]"), F.lit("[2,1]"), F.lit("[1, 2]"), F.lit("{oops"), F.lit("{oops"), F.lit('""'),
    )
    return tables.read(spark, d, "documents").select("doc_id", loose.distinct_json(given).alias("kept"))


# ---- rerankers ------------------------------------------------------------------------------------------------


@query("""WITH e AS (SELECT event_id AS id, event_id % 6 AS kind, (event_id % 7)::INTEGER AS n, (event_id % 10) / 10.0::DOUBLE AS x FROM events)
    SELECT id, n AS "index", x AS score FROM e WHERE kind = 0 UNION ALL SELECT id, -1, 0.0 FROM e WHERE kind = 0 UNION ALL SELECT id, n, 0.0 FROM e WHERE kind = 1 UNION ALL SELECT id, -1, x FROM e WHERE kind = 1
    UNION ALL SELECT id, 2, x FROM e WHERE kind = 2 UNION ALL SELECT id, -1, 1.0 FROM e WHERE kind = 3""")
def rerank_results(spark, d):
    """Rerankers' answers for every event: numbers as texts, a null name before a full one, bare scores, lists, other kinds, no JSON."""
    i, n, x = F.col("event_id") % 6, (F.col("event_id") % 7).cast("string"), ((F.col("event_id") % 10) / 10.0).cast("string")
    answer = F.when(i == 0, _joined('```\n{"data": [{"index": " ', n, '", "score": "', x, '"}, {"index": "2.5", "relevance_score": null, "score": 3}]}\n```')).when(i == 1, _joined('{"data": null, "results": [{"doc_index": ', n, ', "score": "high"}, ', x, "]}"))
    answer = answer.when(i == 2, _joined('[{"document_index": 2.9, "relevance": [0.1, ', x, "]}]")).when(i == 3, F.lit('{"rerank_results": [{"index": null, "doc_index": 4, "score": true}]}')).when(i == 4, F.lit('{"data": 5, "results": [{"index": 1}]}')).otherwise(_joined("{oops ", n))
    return tables.read(spark, d, "events").select(F.col("event_id").alias("id"), F.inline(loose.rerank_items(answer)))


POOL = 20


@query(f"""WITH {_BOOSTED}, po AS (SELECT *, row_number() OVER (PARTITION BY request, route ORDER BY field DESC, id) - 1 AS n FROM bo),
    ra AS (SELECT *, ((n * 7) % 11) / 4.0 - 0.5 AS raw, CASE source WHEN 'episode' THEN 0.9 ELSE 1.0 END AS weight, 0.03 * {_S} + least(0.03, 0.01 * len(queries)) AS bonus FROM po),
    fi AS (SELECT *, n < {POOL} AND n % 3 < 2 AS has, CASE WHEN raw BETWEEN 0 AND 1 THEN raw ELSE 1 / (1 + exp(-raw)) END AS score FROM ra),
    fo AS (SELECT *, least(1, greatest(0, CASE WHEN has THEN score * weight + bonus + 0.01 ELSE field * weight + bonus END)) AS final FROM fi)
    SELECT {_SHOWN}, CASE WHEN has THEN round(score, 6)::DOUBLE END AS rerank, round(final, 6)::DOUBLE AS final, row_number() OVER (PARTITION BY request, route ORDER BY round(final, 9) DESC, id)::INTEGER AS rank FROM fo""")
def reranked_candidates(spark, d):
    """Final scores with rerankers' answers: two of three candidates of each pool have a score, one twice, one is out of the pool; dialogue rows bring their own weight."""
    found = search.boosted(search.merged(*_channels(spark, d)), _requests(spark)).withColumn("source_weight", F.when(F.col("source") == "episode", F.lit(0.9)))
    found = stored(found.drop("text"), "found")  # pool, answers and scores read it
    pool = search.rerank_pool(found, POOL)
    shapes = F.transform(F.filter(F.sequence(F.lit(0), F.lit(POOL + 9)), lambda n: n % 3 < 2), lambda n: F.struct(n.alias("index"), ((n * 7) % 11 / 4.0 - 0.5).cast("double").alias("relevance_score")))
    first = F.array(F.struct(F.lit(0).alias("index"), F.lit(0.9).cast("double").alias("relevance_score")))
    answers = pool.select("request", "route").distinct().select("*", F.to_json(F.struct(F.concat(first, shapes).alias("results"))).alias("answer"))
    rerank = search.reranked(pool, answers)
    return _shown(search.scored(found, rerank), F.round("rerank", 6).alias("rerank"), F.round("final", 6).alias("final"), "rank")


_TEXTS = "tx AS (SELECT record_id::VARCHAR AS id, text FROM rec UNION ALL SELECT session_id || ':' || turn_index, '[' || role || ']: ' || content FROM turn)"


@query(f"""WITH {_BOOSTED}, {_TEXTS} SELECT request, route, id, source, memory_type, role AS source_role, round(field, 6)::DOUBLE AS field_score, CASE WHEN source = 'episode' THEN created_at END AS source_dialogue_time,
    CASE WHEN length(trim(text)) > 500 THEN substr(trim(text), 1, 500) || '...' ELSE trim(text) END AS text FROM bo JOIN tx USING (id)""")
def candidate_payloads(spark, d):
    """Candidates as a trace shows them."""
    t = search.debug_payload(search.boosted(search.merged(*_channels(spark, d)), _requests(spark)))
    return t.select("request", "route", "id", "source", "memory_type", "source_role", F.round("field_score", 6).alias("field_score"), "source_dialogue_time", "text")


# ---- visual rows ----------------------------------------------------------------------------------------------


def _visuals(spark, d) -> DataFrame:
    """pages as stored visual rows, with nulls, malformed lists and zeros among them."""
    i = F.col("page_id")
    lists = F.when(i % 3 == 0, _joined('["', F.col("page_id").cast("string"), '", "e"]')).when(i % 3 == 1, F.lit("[oops"))
    return tables.read(spark, d, "pages").select(
        i.cast("string").alias("record_id"), (i % 10).cast("string").alias("session_id"), F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (i % 97).cast("int")), "yyyy-MM-dd").alias("timestamp"), F.col("url").alias("image_url"),
        F.when(i % 4 != 0, F.concat(F.lit("page "), F.col("page_id").cast("string"))).alias("caption"), lists.alias("entities"), F.when(i % 5 == 0, F.lit("[0.5, 1]")).alias("caption_embedding"),
        F.when(i % 2 == 0, ((i % 4) / 4.0).cast("double")).alias("importance_score"), F.when(i % 7 == 0, F.lit(1)).when(i % 7 < 4, F.lit(0)).alias("expired"), F.when(i % 2 == 0, i).alias("retrieval_count"),
    )


_VISUAL = """v AS (SELECT page_id::VARCHAR AS record_id, (page_id % 10)::VARCHAR AS session_id, strftime(DATE '2024-01-01' + (page_id % 97)::INTEGER, '%Y-%m-%d') AS timestamp, coalesce(url, '') AS image_url, CASE WHEN page_id % 4 <> 0 THEN 'page ' || page_id ELSE '' END AS caption,
    CASE WHEN page_id % 3 = 0 THEN [page_id::VARCHAR, 'e'] ELSE []::VARCHAR[] END AS entities, CASE WHEN page_id % 5 = 0 THEN [0.5::DOUBLE, 1.0] ELSE []::DOUBLE[] END AS caption_embedding, CASE WHEN page_id % 4 = 2 THEN 0.5::DOUBLE ELSE 1.0 END AS importance_score,
    page_id % 7 = 0 AS expired, CASE WHEN page_id % 2 = 0 THEN page_id ELSE 0 END AS retrieval_count FROM pages)"""


@query(f"WITH {_VISUAL} SELECT * FROM v")
def visual_records(spark, d):
    """Stored visual rows as records."""
    return stores.visual_records(_visuals(spark, d))


@query(f"WITH {_VISUAL} SELECT record_id, timestamp, caption FROM v WHERE NOT expired AND session_id = '3' ORDER BY timestamp DESC, record_id LIMIT 10 OFFSET 5")
def visual_page(spark, d):
    """The second page of a session's visual records."""
    return stores.visual_page(stores.visual_records(_visuals(spark, d)), 10, 5, "3").select("record_id", "timestamp", "caption")


@query(f"WITH {_VISUAL} SELECT session_id, place, record_id, timestamp, entities FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY timestamp DESC, record_id)::INTEGER AS place FROM v WHERE NOT expired) WHERE place <= 20")
def session_visuals(spark, d):
    """Every session's newest visual records."""
    return stores.session_visuals(stores.visual_records(_visuals(spark, d))).select("session_id", "place", "record_id", "timestamp", "entities")


# ---- compression of sessions ----------------------------------------------------------------------------------

_ACTION = "CASE WHEN {0} > 540 THEN 'sync' WHEN {0} > 420 THEN 'async' ELSE 'none' END"
_COMPACT = f"""WITH t AS (SELECT *, {_tokens('content')} + 4 AS n, role || ': ' || content AS line FROM ({_TURNS})),
    x1 AS (SELECT session_id, count(*) AS live, sum(n) AS tokens FROM t WHERE turn_index <= 5 GROUP BY 1), b1 AS (SELECT session_id, {_ACTION.format('tokens')} AS action, CASE WHEN live > 4 THEN live - 4 ELSE 0 END AS b FROM x1),
    o1 AS (SELECT session_id, b, CASE WHEN b = 0 OR action = 'none' THEN 'none' WHEN action = 'sync' THEN 'fresh' ELSE 'background' END AS origin FROM b1),
    c1 AS (SELECT session_id, string_agg(substr(line, 1, 80), chr(10) ORDER BY turn_index) AS content FROM t JOIN o1 USING (session_id) WHERE turn_index < b AND origin <> 'none' GROUP BY 1),
    s1 AS (SELECT session_id, b, origin, content FROM o1 LEFT JOIN c1 USING (session_id)), l AS (SELECT t.*, s1.origin AS o, s1.content AS c, s1.b AS pb FROM t LEFT JOIN s1 USING (session_id) WHERE NOT (coalesce(s1.origin, 'none') = 'fresh' AND turn_index < s1.b)),
    x2 AS (SELECT session_id, any_value(o) AS o, any_value(c) AS c, any_value(pb) AS pb, count(*) AS live, sum(n) AS tokens, min(turn_index) AS lowest FROM l GROUP BY 1),
    b2 AS (SELECT *, {_ACTION.format('tokens')} AS action, CASE WHEN live > 4 THEN lowest + live - 4 ELSE 0 END AS b FROM x2),
    o2 AS (SELECT *, CASE WHEN action = 'sync' AND o = 'background' THEN 'prepared' WHEN action = 'sync' AND b > 0 THEN 'fresh' WHEN action = 'async' AND coalesce(o, 'none') <> 'background' AND b > 0 THEN 'background' ELSE 'none' END AS origin FROM b2),
    li AS (SELECT session_id, -1 AS place, '[Previous Historical Summary]' || chr(10) || c AS line FROM o2 WHERE o = 'fresh' UNION ALL SELECT l.session_id, turn_index, line FROM l JOIN o2 USING (session_id) WHERE turn_index < o2.b),
    c2 AS (SELECT session_id, string_agg(substr(line, 1, 80), chr(10) ORDER BY place) AS content FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY place) AS k FROM li) WHERE k <= 6 GROUP BY 1),
    f AS (SELECT o2.*, CASE o2.origin WHEN 'prepared' THEN pb ELSE b END AS to_, CASE o2.origin WHEN 'prepared' THEN c WHEN 'none' THEN NULL ELSE c2.content END AS made FROM o2 LEFT JOIN c2 USING (session_id)),
    g AS (SELECT f.*, CASE WHEN origin IN ('fresh', 'prepared') THEN made WHEN o = 'fresh' THEN c END AS shown, greatest(CASE WHEN origin IN ('fresh', 'prepared') THEN to_ ELSE 0 END, CASE WHEN o = 'fresh' THEN pb ELSE 0 END) AS start FROM f)"""


def _passes(spark, d) -> tuple[compaction.Compacted, compaction.Compacted]:
    """Two passes: over each session's first six turns, then over all, with what the first has marked and prepared."""
    t = tables.turns(spark, d)
    none = spark.createDataFrame([], "session_id long, boundary_index int, content string")
    first = compaction.compact(t.filter("turn_index <= 5"), none.withColumn("token_count", F.lit(0).cast("long")), none, budget=600)
    return first, compaction.compact(first.turns.unionByName(t.filter("turn_index > 5")), first.summaries, first.prepared, budget=600)


@query(f"{_COMPACT} SELECT session_id, action, origin, to_::INTEGER AS boundary_index, tokens::BIGINT AS tokens FROM g")
def compaction_decisions(spark, d):
    """What the second pass decides for each session: nothing, prepare, take what is ready, sum up now."""
    return _passes(spark, d)[1].decisions


@query(f"{_COMPACT} SELECT session_id, pb::INTEGER AS boundary_index, c AS content, 'summary' AS kind FROM g WHERE o = 'fresh' UNION ALL SELECT session_id, to_, made, 'summary' FROM g WHERE origin IN ('fresh', 'prepared') UNION ALL SELECT session_id, to_, made, 'prepared' FROM g WHERE origin = 'background' UNION ALL SELECT session_id, pb, c, 'prepared' FROM g WHERE o = 'background' AND action <> 'sync'")
def compaction_summaries(spark, d):
    """Summaries of both passes, and those that wait."""
    second = _passes(spark, d)[1]
    shown = lambda t, kind: t.select("session_id", "boundary_index", "content", F.lit(kind).alias("kind"))
    return shown(second.summaries, "summary").unionByName(shown(second.prepared, "prepared"))


@query(f"""{_COMPACT}, u AS (SELECT g.session_id, sum(n) AS n FROM t JOIN g USING (session_id) WHERE turn_index >= start GROUP BY 1)
    SELECT session_id, start::BIGINT AS n_deleted, (u.n + CASE WHEN shown IS NULL THEN 0 ELSE {_tokens("('[Historical Summary]' || chr(10) || shown)")} + 4 END)::BIGINT AS tokens FROM g JOIN u USING (session_id)""")
def compaction_usage(spark, d):
    """Deleted turns and tokens of each session's context after the second pass."""
    second = _passes(spark, d)[1]
    gone = second.turns.groupBy("session_id").agg(F.count_if("deleted").alias("n_deleted"))
    return gone.join(compaction.context_usage(second.turns, second.summaries), "session_id").select("session_id", "n_deleted", "tokens")


# ---- vectors of queries ---------------------------------------------------------------------------------------


@query("""WITH q AS (SELECT doc_id AS place, CASE doc_id % 3 WHEN 0 THEN ' ' || upper(coalesce(source, '')) WHEN 1 THEN coalesce(source, '') || '  ' ELSE coalesce(source, '') || '-' || coalesce(lang, '') END AS query, doc_id % 4 = 0 AS early FROM documents),
    k AS (SELECT place, trim(query) AS text, lower(trim(query)) AS key, early FROM q WHERE trim(query) <> ''), f AS (SELECT key, arg_min(text, place) AS text FROM k WHERE early GROUP BY key), a AS (SELECT key, arg_min(text, place) AS text FROM k GROUP BY key)
    SELECT a.key, [length(coalesce(f.text, a.text))::DOUBLE, ascii(coalesce(f.text, a.text))::DOUBLE] AS vector, (f.key IS NULL)::INTEGER AS fresh FROM a LEFT JOIN f ON f.key = a.key""")
def query_vectors_kept(spark, d):
    """Queries of a second batch: those of the first one are not embedded again, whatever their spelling."""
    i, s = F.col("doc_id") % 3, F.coalesce("source", F.lit(""))
    spelled = F.when(i == 0, F.concat(F.lit(" "), F.upper(s))).when(i == 1, F.concat(s, F.lit("  "))).otherwise(F.concat(s, F.lit("-"), F.coalesce("lang", F.lit(""))))
    q = tables.read(spark, d, "documents").select(F.col("doc_id").alias("place"), spelled.alias("query"))
    embed = lambda t: t.select("key", F.array(F.length("text").cast("double"), F.ascii("text").cast("double")).alias("vector"))
    one = query_cache.embedded(query_cache.empty(spark), q.filter("place % 4 = 0"), embed, 1)
    return query_cache.embedded(one.cache, q, embed, 2).vectors
