"""The driver's queries for retrieval, step by step and end to end, with equivalent SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import temporal, text
from ..operators import evidence, search, vectors
from ..sources import tables
from ..sources.shared import stored
from .catalog import _L2QE, query

#: Requests, and the vectors that stand for the queries of their routes.
REQUESTS = [(1, "which records mention the license", "single", None, None), (2, "when did we meet in spring", "temporal", "2024-03-01", "2024-05-31"), (3, "what did the assistant say", "prior_assistant_response", None, "2024-02-10")]
ROUTES = [(1, "a", 1, "license terms", 60), (1, "b", 2, "released version", 61), (2, "a", 1, "meetings in spring", 62), (3, "a", 1, "answers of the assistant", 63), (3, "b", 2, "what was asked", 64)]
K = 8
LIMIT = 30

_ROUTES = "routes AS (SELECT * FROM (VALUES " + ", ".join(f"({r}, '{t}', {n}, '{g}', {v})" for r, t, n, g, v in ROUTES) + ") v(request, route, route_no, goal, vec_id))"
_NEAR = f"""{_ROUTES}, near AS (SELECT request, route, goal AS query, id, distance / 4 AS distance FROM (SELECT r.*, e.vec_id AS id, {_L2QE} AS distance,
    row_number() OVER (PARTITION BY r.vec_id ORDER BY {_L2QE}, e.vec_id) AS rank FROM routes r JOIN embeddings q ON q.vec_id = r.vec_id JOIN embeddings e ON len(q.embedding) = len(e.embedding)) WHERE rank <= {LIMIT})"""
_REC = """rec AS (SELECT doc_id AS record_id, ['fact', 'event', 'preference', 'constraint'][doc_id % 4 + 1] AS memory_type, coalesce(text, '') AS text, doc_id % 100 AS session_id, (doc_id % 4)::INTEGER AS lo,
    (doc_id % 4 + doc_id % 2)::INTEGER AS hi, ['user', 'assistant', 'both'][doc_id % 3 + 1] AS role, CASE WHEN doc_id % 3 = 0 THEN strftime(DATE '2024-01-01' + (doc_id % 366)::INTEGER, '%Y-%m-%d') END AS t_start,
    strftime(DATE '2024-01-01' + (doc_id % 366)::INTEGER, '%Y-%m-%d') || 'T10:00:00.250Z' AS created_at, doc_id % 17 = 0 AS expired FROM documents)"""
_TURN = """turn AS (SELECT conv_id AS session_id, turn::INTEGER AS turn_index, role, trim(coalesce(text, '')) AS content, strftime(DATE '2024-01-01' + (conv_id % 366)::INTEGER, '%Y-%m-%d') || 'T09:00:00Z' AS created_at FROM conversations WHERE trim(coalesce(text, '')) <> '')"""
_S = "greatest(0, least(1, 1 - distance))"
_RH = f"rh AS (SELECT request, route, query, record_id::VARCHAR AS id, 'record' AS source, memory_type, role, t_start, created_at, distance, {_S} AS retrieval, 0.3 + 0.3 * {_S} AS field, 'record_normalized_ann' AS channel, NULL AS node FROM near JOIN rec ON record_id = id WHERE NOT expired)"
_NH = f"""ty AS (SELECT *, ['entity', 'tag', 'entity_tag'][id % 3 + 1] AS node_type FROM near), nk AS (SELECT *, row_number() OVER (PARTITION BY request, route, query, node_type ORDER BY distance, id) AS kept FROM ty),
    nh AS (SELECT request, route, query, record_id::VARCHAR AS id, 'record' AS source, memory_type, role, t_start, created_at, 1.0 AS distance, 0.0 AS retrieval, {_S} * CASE node_type WHEN 'entity' THEN 0.34 WHEN 'tag' THEN 0.32 ELSE 0.38 END AS field,
    node_type || '_ann' AS channel, id::VARCHAR AS node FROM nk JOIN rec ON record_id % 50 = id % 50 WHERE kept <= 6 AND NOT expired)"""
_TH = f"""th AS (SELECT request, route, query, t.session_id || ':' || t.turn_index AS id, 'episode' AS source, 'raw_turn' AS memory_type, role, NULL AS t_start, created_at, distance, {_S} AS retrieval,
    least(1, greatest(0, (0.34 + 0.42 * {_S}) * CASE WHEN request = 3 THEN 1.22 ELSE 1 END + CASE WHEN request = 3 AND role = 'assistant' THEN 0.18 WHEN request = 3 AND role = 'user' THEN 0.04 ELSE 0 END)) AS field, 'raw_turn_direct' AS channel, NULL AS node
    FROM near JOIN turn t ON t.session_id = id % 100 AND t.turn_index = id % 4)"""
_TX = """tx AS (SELECT record_id::VARCHAR AS id, text FROM rec UNION ALL SELECT session_id || ':' || turn_index, '[' || role || ']: ' || content FROM turn)"""
_MERGED = f"""{_NEAR}, {_REC}, {_TURN}, {_RH}, {_NH}, {_TH}, al AS (SELECT * FROM rh UNION ALL SELECT * FROM nh UNION ALL SELECT * FROM th),
    me AS (SELECT request, route, id, any_value(source) AS source, any_value(memory_type) AS memory_type, any_value(role) AS role, any_value(t_start) AS t_start, any_value(created_at) AS created_at, max(field)::DOUBLE AS field, max(retrieval)::DOUBLE AS retrieval,
    min(distance)::DOUBLE AS distance, list_sort(list(DISTINCT query)) AS queries, list_sort(list(DISTINCT channel)) AS channels, coalesce(list_sort(list(DISTINCT node) FILTER (node IS NOT NULL)), []) AS nodes FROM al GROUP BY request, route, id)"""
_BOOSTED = f"""{_MERGED}, b1 AS (SELECT *, least(1, greatest(0, CASE WHEN source = 'episode' THEN greatest(field, least(1, greatest(0, (0.34 + 0.42 * retrieval) * CASE WHEN request = 3 THEN 1.22 ELSE 1 END + CASE WHEN request = 3 AND role = 'assistant' THEN 0.18 WHEN request = 3 AND role = 'user' THEN 0.04 ELSE 0 END)))
    WHEN request = 3 AND role IN ('assistant', 'both') THEN field + 0.08 WHEN request = 2 AND t_start IS NOT NULL THEN field + 0.04 ELSE field END)) AS f1, CASE request WHEN 2 THEN '2024-03-01' END AS since, CASE request WHEN 2 THEN '2024-05-31' WHEN 3 THEN '2024-02-10' END AS until FROM me),
    b2 AS (SELECT *, CASE WHEN request = 1 THEN 0 WHEN t_start IS NOT NULL AND (since IS NULL OR t_start >= since) AND t_start <= until THEN 0.08
    WHEN t_start IS NULL AND source = 'episode' AND (since IS NULL OR created_at[1:10] >= since) AND created_at[1:10] <= until THEN 0.04 ELSE 0 END AS boost FROM b1),
    bo AS (SELECT * EXCLUDE (field, channels), least(1, f1 + boost)::DOUBLE AS field, CASE WHEN boost = 0 THEN channels ELSE list_sort(list_append(channels, CASE WHEN boost > 0.05 THEN 'temporal_boost' ELSE 'source_time_boost' END)) END AS channels FROM b2)"""


def _requests(spark) -> DataFrame:
    return search.requests_of(spark.createDataFrame(REQUESTS, "plan_id int, query string, question_type string, since string, until string"), K)


def _routes(spark) -> DataFrame:
    return spark.createDataFrame(ROUTES, "request int, route string, route_no int, goal string, vec_id long")


def _near(spark, d) -> DataFrame:
    """Hits (request, route, query, vec, distance) of every route's vector; the distance scaled to [0, 1]."""
    e, r = tables.read(spark, d, "embeddings"), _routes(spark)
    q = e.join(F.broadcast(r), "vec_id").select(F.concat_ws("/", F.col("request").cast("string"), "route").alias("query_id"), F.col("embedding").alias("q"))
    hits = vectors.nearest(e, q, LIMIT).withColumn("distance", F.col("distance") / 4)
    return hits.join(F.broadcast(r.select(F.concat_ws("/", F.col("request").cast("string"), "route").alias("query_id"), "request", "route", F.col("goal").alias("query"))), "query_id").select("request", "route", "query", F.col("id").alias("vec"), "distance")


def _evidence_of(spark, d, near: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, index) of the evidence that was hit: LIMIT nodes a route at most, however many nodes and records there are."""
    hit = F.broadcast(near.select(F.col("vec").alias("vec_id")).distinct())
    kind = F.get(F.array(*[F.lit(x) for x in ("entity", "tag", "entity_tag")]), (F.col("vec_id") % 3).cast("int"))
    nodes = stored(tables.read(spark, d, "embeddings").join(hit, "vec_id", "left_semi").select(F.col("vec_id").cast("string").alias("id"), kind.alias("node_type"), (F.col("vec_id") % 50).alias("bucket")), "nodes")
    return nodes, records.select("record_id", (F.col("record_id") % 50).alias("bucket")).join(F.broadcast(nodes), "bucket").select("id", "record_id")


def _channels(spark, d) -> list[DataFrame]:
    near, records, turns = stored(_near(spark, d), "near"), tables.records(spark, d), tables.dated_turns(spark, d)
    as_id = lambda c: near.select("request", "route", "query", c.cast("string").alias("id"), "distance")
    nodes, index = _evidence_of(spark, d, near, records)
    turn_id = F.concat_ws(":", (F.col("vec") % 100).cast("string"), (F.col("vec") % 4).cast("string"))
    return [search.record_hits(as_id(F.col("vec")), records), search.node_hits(as_id(F.col("vec")), nodes, index, records, 6), search.turn_hits(as_id(turn_id), turns, _requests(spark))]


def _shown(t: DataFrame, *more: str) -> DataFrame:
    return t.select("request", "route", "id", "source", F.round("field", 6).alias("field"), F.round("retrieval", 6).alias("retrieval"), F.round("distance", 6).alias("distance"), *more)


_SHOWN = "request, route, id, source, round(field, 6)::DOUBLE AS field, round(retrieval, 6)::DOUBLE AS retrieval, round(distance, 6)::DOUBLE AS distance"


@query(f"WITH {_NEAR}, {_REC}, {_RH} SELECT {_SHOWN}, memory_type, query FROM rh")
def direct_record_hits(spark, d):
    return _shown(_channels(spark, d)[0], "memory_type", "query")


@query(f"WITH {_NEAR}, {_REC}, {_NH} SELECT {_SHOWN}, channel, node FROM nh")
def evidence_record_hits(spark, d):
    return _shown(_channels(spark, d)[1], "channel", "node")


@query(f"WITH {_NEAR}, {_TURN}, {_TH} SELECT {_SHOWN}, role FROM th")
def raw_turn_hits(spark, d):
    return _shown(_channels(spark, d)[2], "role")


@query(f"WITH {_TURN} SELECT session_id || ':' || turn_index AS id, '[' || role || ']: ' || content AS text, created_at FROM turn WHERE session_id = 7")
def session_turn_candidates(spark, d):
    """The turns of one session as candidates."""
    return search.of_turns(tables.dated_turns(spark, d), "7").select("id", "text", "created_at")


@query(f"WITH {_REC} SELECT record_id::VARCHAR AS id, memory_type, trim(text, ' ') AS text, session_id::VARCHAR AS session FROM rec WHERE NOT expired")
def live_record_candidates(spark, d):
    return search.of_records(tables.records(spark, d)).select("id", "memory_type", "text", "session")


@query(f"WITH {_MERGED} SELECT {_SHOWN}, queries, channels, nodes FROM me")
def candidate_merge(spark, d):
    return _shown(search.merged(*_channels(spark, d)), "queries", "channels", "nodes")


@query(f"WITH {_BOOSTED} SELECT {_SHOWN}, channels FROM bo")
def strategy_boosts(spark, d):
    return _shown(search.boosted(search.merged(*_channels(spark, d)), _requests(spark)), "channels")


@query(f"""WITH {_BOOSTED}, fi AS (SELECT *, least(1, greatest(0, field + 0.03 * {_S} + least(0.03, 0.01 * len(queries)))) AS final FROM bo)
    SELECT {_SHOWN}, round(final, 6)::DOUBLE AS final, row_number() OVER (PARTITION BY request, route ORDER BY round(final, 9) DESC, id)::INTEGER AS rank FROM fi""")
def scored_candidates(spark, d):
    t = search.scored(search.boosted(search.merged(*_channels(spark, d)), _requests(spark)))
    return _shown(t, F.round("final", 6).alias("final"), "rank")


@query(f"""WITH {_MERGED}, l AS (SELECT request, route, id, field, 0 AS pos, channels FROM me WHERE source = 'record' UNION ALL SELECT request, route, id, least(1, field + CASE WHEN retrieval > 0 THEN 0.1 ELSE -0.1 END), 1, ['second'] FROM me)
    SELECT request, route, id, round(max(field), 6)::DOUBLE AS field, arg_max(pos, field - pos / 1e9)::INTEGER AS kept_from, list_sort(list_distinct(flatten(list(channels)))) AS channels FROM l GROUP BY request, route, id""")
def candidate_list_union(spark, d):
    """Two lists as one: the higher payload, distinct lists."""
    t = search.merged(*_channels(spark, d))
    first = t.filter("source = 'record'").withColumn("memory_type", F.lit("0"))
    second = t.withColumn("field", F.least(F.lit(1.0), F.col("field") + F.when(F.col("retrieval") > 0, F.lit(0.1)).otherwise(F.lit(-0.1)))).withColumn("channels", F.array(F.lit("second"))).withColumn("memory_type", F.lit("1"))
    return search.united(first, second).select("request", "route", "id", F.round("field", 6).alias("field"), F.col("memory_type").cast("int").alias("kept_from"), "channels")


def _anchors(spark, d) -> DataFrame:
    """A candidate a turn of users and assistants."""
    t = search.of_turns(tables.dated_turns(spark, d)).filter("role <> 'system'")
    score = 0.5 + (F.col("lo") % 5) / 100.0
    return t.withColumns({"request": F.lit(3), "route": F.lit("a"), "field": score, "retrieval": F.lit(0.0), "distance": F.lit(1.0), "queries": F.array(F.lit("q")), "channels": F.array(F.lit("raw_turn_direct")), "nodes": F.array().cast("array<string>")})


@query(f"""WITH {_TURN}, an AS (SELECT *, row_number() OVER (ORDER BY 0.5 + (turn_index % 5) / 100.0 DESC, session_id || ':' || turn_index) AS nth FROM turn WHERE role <> 'system'),
    ne AS (SELECT a.session_id, a.turn_index AS lo, a.role, a.nth, 0.5 + (a.turn_index % 5) / 100.0 AS score, t.turn_index, t.role AS t_role, t.content, sum((t.role = 'assistant' AND t.turn_index > a.turn_index)::INTEGER) OVER w AS late,
      max(CASE WHEN t.role = 'user' THEN t.turn_index END) OVER (PARTITION BY a.nth ORDER BY t.turn_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS u
      FROM an a JOIN turn t ON t.session_id = a.session_id AND t.turn_index BETWEEN a.turn_index - 4 AND a.turn_index + 4 WHERE a.nth <= 20 WINDOW w AS (PARTITION BY a.nth ORDER BY t.turn_index)),
    wi AS (SELECT *, row_number() OVER (PARTITION BY session_id, turn_index ORDER BY nth) AS r FROM ne WHERE t_role = 'assistant' AND CASE role WHEN 'assistant' THEN turn_index = lo ELSE turn_index > lo AND late <= 2 END)
    SELECT 'episode_window:' || w.session_id || ':' || w.turn_index AS id, coalesce(w.u, w.turn_index)::INTEGER AS lo, w.turn_index AS hi, round(least(1, w.score + 0.04 + 0.18), 6)::DOUBLE AS field,
      coalesce('[user]: ' || p.content || chr(10), '') || '[assistant]: ' || w.content AS text FROM wi w LEFT JOIN turn p ON p.session_id = w.session_id AND p.turn_index = w.u WHERE w.r = 1""")
def answer_windows(spark, d):
    """Question and answer windows around the best dialogue turns."""
    w = search.answer_windows(_anchors(spark, d), tables.dated_turns(spark, d), _requests(spark))
    return w.select("id", "lo", "hi", F.round("field", 6).alias("field"), "text")


@query(f"""WITH {_TURN}, an AS (SELECT session_id || ':' || turn_index AS id, session_id, turn_index AS lo, '[' || role || ']: ' || content AS said, 0.5 + (turn_index % 5) / 100.0 AS score, row_number() OVER (ORDER BY 0.5 + (turn_index % 5) / 100.0 DESC, session_id || ':' || turn_index) AS nth FROM turn WHERE role <> 'system'),
    wi AS (SELECT a.id, a.session_id, any_value(a.score) AS score, any_value(a.said) AS said, min(t.turn_index) AS lo, max(t.turn_index) AS hi FROM an a JOIN turn t ON t.session_id = a.session_id AND t.turn_index BETWEEN a.lo - 4 AND a.lo + 4 WHERE a.nth <= {K} GROUP BY a.id, a.session_id),
    n AS (SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY session_id ORDER BY lo, hi, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 3 THEN 0 ELSE 1 END AS new FROM wi),
    i AS (SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY lo, hi, id ROWS UNBOUNDED PRECEDING) AS island FROM n), p AS (SELECT *, row_number() OVER (PARTITION BY session_id, island ORDER BY lo, hi, id) AS i, count(*) OVER (PARTITION BY session_id, island) AS n FROM i),
    m AS (SELECT session_id, island, round(least(1, max(CASE WHEN n = 1 THEN score ELSE score + 0.03 * (n - greatest(i, 2) + 1) END)), 6)::DOUBLE AS field, min(lo)::INTEGER AS lo, max(hi)::INTEGER AS hi, list(said ORDER BY i) AS said FROM p GROUP BY session_id, island),
    y AS (SELECT m.session_id, island, t.turn_index, role, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS at_line FROM m JOIN turn t ON t.session_id = m.session_id AND t.turn_index BETWEEN m.lo AND m.hi),
    z AS (SELECT session_id, island, string_agg('[' || turn_index || ' role=' || role || ']: ' || trim(line), chr(10) ORDER BY turn_index, at_line) AS body FROM y WHERE trim(line) <> '' GROUP BY session_id, island)
    SELECT 'source_window:' || session_id || ':' || lo || '-' || hi AS id, field, lo, hi, 'Anchor: ' || array_to_string(list_filter(said, lambda x, j: list_position(said, x) = j)[1:4], ' | ') || chr(10) || 'Original conversation:' || chr(10) || body AS text FROM m JOIN z USING (session_id, island)""")
def source_windows(spark, d):
    """Original dialogue around the best turns, merged where it touches, with their texts."""
    w = search.source_windows(_anchors(spark, d), tables.dated_turns(spark, d), _requests(spark), _routes(spark))
    return w.select("id", F.round("field", 6).alias("field"), "lo", "hi", "text")


@query(f"""WITH {_TURN}, an AS (SELECT session_id || ':' || turn_index AS id, session_id, turn_index, row_number() OVER (ORDER BY 0.5 + (turn_index % 5) / 100.0 DESC, session_id || ':' || turn_index) AS nth, 0.5 + (turn_index % 5) / 100.0 AS score FROM turn WHERE role <> 'system'),
    ne AS (SELECT a.nth, a.score, t.*, row_number() OVER (PARTITION BY t.session_id, t.turn_index ORDER BY a.nth) AS r FROM an a JOIN turn t ON t.session_id = a.session_id AND t.turn_index BETWEEN a.turn_index - 4 AND a.turn_index + 4 WHERE a.nth <= 10),
    k AS (SELECT *, row_number() OVER (ORDER BY nth, turn_index) AS n FROM ne WHERE r = 1)
    SELECT session_id || ':' || turn_index AS id, role, round(least(1, 0.68 + 0.1 * score + CASE role WHEN 'assistant' THEN 0.18 WHEN 'user' THEN 0.04 ELSE 0 END), 6)::DOUBLE AS field FROM k WHERE n <= 10""")
def session_neighbourhood(spark, d):
    """Turns around the best dialogue turns, as candidates."""
    n = search.neighbourhood(_anchors(spark, d), tables.dated_turns(spark, d), _requests(spark))
    return n.select("id", "role", F.round("field", 6).alias("field"))


_STOP = "['" + "', '".join(text.STOP_WORDS) + "']"
_TERMS = "list_filter(list_distinct(regexp_extract_all(lower({c}), '[a-z0-9_]{{3,}}')), lambda w: NOT list_contains(" + _STOP + ", w))"


@query(f"""WITH l AS (SELECT doc_id, i - 1 AS line_pos, trim(x) AS line FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents) WHERE trim(x) <> ''),
    t AS (SELECT *, 'd: ' || line AS shown, {_TERMS.format(c='line')} AS own, ['license', 'version', 'software', 'terms', 'released', 'question'] AS terms FROM l),
    a AS (SELECT *, sum(length(shown) + 1) OVER (PARTITION BY doc_id) - 1 <= 800 AS fits, len(list_intersect(own, terms)) AS shared, contains(lower(line), 'session date') AS dated FROM t),
    s AS (SELECT *, CASE WHEN shared > 0 AND NOT dated THEN shared + least(2.0, len(own) / 80.0) ELSE 0.0 END::DOUBLE AS score FROM a),
    p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, line_pos DESC) AS place FROM s),
    n AS (SELECT *, dated OR max((score > 0 AND place <= 12)::INTEGER) OVER (PARTITION BY doc_id ORDER BY line_pos ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) = 1 AS near FROM p),
    k AS (SELECT * FROM (SELECT *, CASE WHEN bool_or(near) OVER (PARTITION BY doc_id) THEN near ELSE line_rank <= 4 END AS taken FROM (SELECT *, CASE WHEN line_pos < 4 THEN 1 ELSE 5 END AS line_rank FROM n)) WHERE fits OR taken),
    g AS (SELECT *, NOT fits AND lag(line_pos) OVER w IS NOT NULL AND line_pos > lag(line_pos) OVER w + 1 AS gap FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY line_pos)),
    u AS (SELECT *, sum(length(shown) + 1 + CASE WHEN gap THEN 6 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_pos ROWS UNBOUNDED PRECEDING) AS upto FROM g),
    f AS (SELECT *, fits OR upto <= 800 AS line_in, gap AND upto - length(shown) - 1 <= 800 AS gap_in FROM u),
    h AS (SELECT *, NOT bool_or(line_in) OVER (PARTITION BY doc_id) AS none, row_number() OVER (PARTITION BY doc_id ORDER BY line_pos) AS r FROM f),
    o AS (SELECT doc_id, line_pos, rtrim(CASE WHEN gap_in AND NOT none THEN '[...]' || chr(10) ELSE '' END || CASE WHEN line_in OR (none AND r = 1) THEN shown ELSE '' END, chr(10)) AS piece FROM h WHERE line_in OR (none AND r = 1) OR (gap_in AND NOT none))
    SELECT doc_id, string_agg(piece, chr(10) ORDER BY line_pos) AS text FROM o GROUP BY doc_id""")
def line_excerpt(spark, d):
    """The lines of a text that share the most words with a query, with their neighbours."""
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x))
    t = tables.read(spark, d, "documents").select("doc_id", F.posexplode(lines).alias("line_pos", "line")).filter("line <> ''")
    terms = F.array(*[F.lit(w) for w in ("license", "version", "software", "terms", "released", "question")])
    return search.excerpt(t.withColumns({"turn_pos": F.lit(0), "prefix": F.lit("d"), "terms": terms, "max_chars": F.lit(800)}), ["doc_id"])


@query(f"""WITH {_REC}, m AS (SELECT record_id, text, t_start, created_at, expired, row_number() OVER (PARTITION BY session_id ORDER BY record_id)::INTEGER AS place, session_id FROM rec WHERE NOT expired), r AS (SELECT * FROM m WHERE place <= 3)
    SELECT session_id AS request, string_agg(concat_ws(chr(10), '[' || place || ']', 'Time: ' || t_start, CASE WHEN place % 2 = 0 THEN 'Conversation time: ' || created_at[1:10] END, nullif(trim(text), '')), chr(10) || chr(10) ORDER BY place) AS context FROM r GROUP BY session_id""")
def context_document(spark, d):
    """The numbered context of each session's first three records, every second as a dialogue."""
    from pyspark.sql.window import Window

    r = tables.records(spark, d).filter("not expired").withColumn("place", F.row_number().over(Window.partitionBy("session_id").orderBy("record_id"))).filter("place <= 3")
    r = r.select(F.col("session_id").alias("request"), "place", F.col("semantic_text").alias("text"), F.when(F.col("place") % 2 == 0, "episode").otherwise("record").alias("source"), "t_start", "t_end", "created_at")
    return search.context_document(r)


@query("""SELECT plan_id, CASE WHEN s = u THEN 'time = ' || s WHEN s IS NOT NULL AND u IS NOT NULL THEN 'time between ' || s || ' and ' || u WHEN s IS NOT NULL THEN 'time >= ' || s ELSE 'time <= ' || u END AS label
    FROM (SELECT o_orderkey AS plan_id, CASE WHEN o_orderkey % 4 <> 1 THEN strftime(o_orderdate, '%Y-%m-%d') END AS s, CASE WHEN o_orderkey % 4 = 3 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN o_orderkey % 4 <> 2 THEN strftime(o_orderdate + INTERVAL 7 DAY, '%Y-%m-%d') END AS u FROM orders)""")
def temporal_labels(spark, d):
    o = tables.read(spark, d, "orders")
    day = lambda n: F.date_format(F.date_add("o_orderdate", n), "yyyy-MM-dd")
    k = F.col("o_orderkey") % 4
    return o.select(F.col("o_orderkey").alias("plan_id"), temporal.query_label(F.when(k != 1, day(0)), F.when(k == 3, day(0)).when(k != 2, day(7))).alias("label"))


_DAYS_INDEX = "SELECT 'day:' || strftime(o_orderdate, '%Y-%m-%d') AS key, o_orderkey AS record_id FROM orders UNION ALL SELECT 'month:' || strftime(o_orderdate, '%Y-%m'), o_orderkey FROM orders UNION ALL SELECT 'span:' || o_custkey, o_orderkey FROM orders"
_DAY_NODES = """SELECT key, CASE WHEN key LIKE 'day:%' THEN key[5:14] WHEN key LIKE 'month:%' THEN key[7:13] || '-01' ELSE strftime(min(o_orderdate), '%Y-%m-%d') END AS start,
    CASE WHEN key LIKE 'day:%' THEN key[5:14] WHEN key LIKE 'month:%' THEN strftime(last_day((key[7:13] || '-01')::DATE), '%Y-%m-%d') ELSE strftime(max(o_orderdate), '%Y-%m-%d') END AS "end", count(DISTINCT record_id)::BIGINT AS n_records FROM ix JOIN orders ON o_orderkey = record_id GROUP BY key"""
PLANS = [(1, "1995-03-10", "1995-03-20"), (2, "1996-12-30", "1997-01-02"), (3, "2050-01-01", "2050-02-01"), (4, "1998-07-01", None), (5, None, "1992-02-10"), (6, "1996-05-01", "1996-04-01"), (7, None, None), (8, "1995-01-01", ""), (9, "1993-01-15", "1994-02-15")]
_PLANS = "p AS (SELECT plan_id, nullif(since, '') AS since, nullif(until, '') AS until FROM (VALUES " + ", ".join("(" + ", ".join("NULL" if x is None else repr(x) for x in p) + ")" for p in PLANS) + ") v(plan_id, since, until))"
_RECALL = f"""ix AS ({_DAYS_INDEX}), n AS ({_DAY_NODES}), {_PLANS}, h AS (SELECT plan_id, key, n_records, CASE WHEN key LIKE 'day:%' THEN 0.42 WHEN key LIKE 'month:%' THEN 0.28 ELSE 0.34 END::DOUBLE AS score
    FROM n JOIN p ON (since IS NULL OR n."end" >= since) AND (until IS NULL OR n.start <= until) AND (since IS NOT NULL OR until IS NOT NULL) AND (since IS NULL OR until IS NULL OR since <= until)),
    r AS (SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY score DESC, key)::INTEGER AS rank FROM h)"""


def _recall(spark, d, limit: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    o = tables.read(spark, d, "orders").select(F.col("o_orderkey").alias("record_id"), "o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    index = o.select("record_id", F.explode(temporal.temporal_keys(F.col("day"))).alias("key"))
    spans = o.select("record_id", F.concat(F.lit("span:"), F.col("o_custkey").cast("string")).alias("key"), "day")
    nodes = evidence.temporal_nodes(o).unionByName(spans.groupBy("key").agg(F.min("day").alias("start"), F.max("day").alias("end"), F.countDistinct("record_id").alias("n_records")))
    plans = spark.createDataFrame(PLANS, "plan_id int, since string, until string")
    return evidence.temporal_recall(stored(nodes, "nodes"), plans, limit), index.unionByName(spans.select("record_id", "key")), o.select("record_id", (F.col("record_id") % 5 == 0).alias("expired"))


@query(f"WITH {_RECALL} SELECT plan_id, key, n_records, score, rank FROM r WHERE rank <= 40")
def temporal_overlap_recall(spark, d):
    """Closed, open, empty and reversed ranges, and nodes that span several months."""
    return _recall(spark, d, 40)[0]


@query(f"WITH {_RECALL} SELECT plan_id, i.record_id, max(score) AS field_score, count(*)::BIGINT AS n_nodes FROM r JOIN ix i ON i.key = r.key WHERE rank <= 40 AND i.record_id % 5 <> 0 GROUP BY plan_id, i.record_id")
def temporal_record_recall(spark, d):
    hits, index, records = _recall(spark, d, 40)
    return evidence.temporal_records(hits, index, records)


@query()
def search_end_to_end(spark, d):
    """Every request's k best candidates over its routes (K21, K22); tests/test_search.py computes order, scores and rows again in plain Python."""
    turns = tables.dated_turns(spark, d)
    found = search.search(_requests(spark), _routes(spark), _channels(spark, d), turns, K, search.texts_of(tables.records(spark, d), turns))
    return search.provenance(found)
