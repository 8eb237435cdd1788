"""The driver's queries for the engine's own operators, with equivalent SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scoring, temporal, text
from ..operators import cells, evidence, plans_io, postings, ranking, sessions, stores, vectors
from ..sources import tables
from ..sources.shared import shared_place, stored
from ..streaming import chunker, lifecycle, throttle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _some(e: DataFrame, *ids: int) -> DataFrame:
    """The request's query vectors, taken from the store by id."""
    return e.filter(F.col("vec_id").isin(list(ids))).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


_L2 = "round(list_sum(list_transform(list_zip({a}, {b}), lambda p: power(p[1]::DOUBLE - p[2]::DOUBLE, 2))), 6)"
_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))"
_L2QE = _L2.format(a="e.embedding", b="q.embedding")
_HITS = f"SELECT q.vec_id AS query_id, e.vec_id AS id, e.label, {_L2QE} AS distance FROM embeddings e JOIN embeddings q ON q.vec_id IN ({{ids}}) AND len(q.embedding) = len(e.embedding)"
_SCORE = "greatest(0, least(1, 1 - distance))"
_TURNS = "SELECT conv_id AS session_id, turn::INTEGER AS turn_index, role, coalesce(text, '') AS content FROM conversations"


def _tokens(c: str) -> str:
    plain = f"regexp_replace({c}, '[A-Za-z0-9_]+', '', 'g')"
    return f"greatest(1, length({c}) - length(regexp_replace({c}, '[\\x{{4e00}}-\\x{{9fff}}]', '', 'g')) + len(regexp_extract_all({c}, '[A-Za-z0-9_]+')) + floor((length({plain}) - (length({c}) - length(regexp_replace({c}, '[\\x{{4e00}}-\\x{{9fff}}]', '', 'g')))) / 4))::BIGINT"


def _fold(c: str) -> str:
    c = f"lower({c})"
    for a, b in text.FOLDINGS:
        c = f"replace({c}, '{a}', '{b}')"
    return c


def _key(c: str) -> str:
    x = f"regexp_replace({_fold(f'trim({c})')}, '[\\s\\-_:/\\\\|,;\\x{{ff0c}}\\x{{ff1b}}\\x{{ff1a}}]+', ' ', 'g')"
    return f"trim(regexp_replace(regexp_replace({x}, '[^\\p{{L}}\\p{{N}}_ ]+', '', 'g'), '\\s+', ' ', 'g'))"


# ---- vectors -------------------------------------------------------------------------------------------------


@query(f"""WITH h AS ({_HITS.format(ids='0')}), r AS (SELECT *, row_number() OVER (ORDER BY distance, id)::INTEGER AS rank FROM h)
    SELECT query_id, id, distance, rank, {_SCORE} AS score FROM r WHERE rank <= 15""")
def knn_l2_topk(spark, d):
    e = tables.read(spark, d, "embeddings")
    return vectors.nearest(e, _some(e, 0), 15).withColumn("score", scoring.retrieval_score(F.col("distance")))


@query(f"""WITH h AS (SELECT q.vec_id AS query_id, e.vec_id AS id, round(1 - greatest(-1, least(1, {_DOT.format(a='e.embedding', b='q.embedding')} / (sqrt({_DOT.format(a='e.embedding', b='e.embedding')}) * sqrt({_DOT.format(a='q.embedding', b='q.embedding')})))), 6) AS distance
    FROM embeddings e, embeddings q WHERE q.vec_id IN (1, 2)), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id)::INTEGER AS rank FROM h)
    SELECT query_id, id, distance, rank FROM r WHERE rank <= 15""")
def knn_cosine_topk(spark, d):
    e = tables.read(spark, d, "embeddings")
    return vectors.nearest(e, _some(e, 1, 2), 15, metric="cosine")


@query(f"""WITH h AS (SELECT q.vec_id AS query_id, e.vec_id AS vec_id, round(1 - greatest(-1, least(1, {_DOT.format(a='e.embedding', b='q.embedding')} / (sqrt({_DOT.format(a='e.embedding', b='e.embedding')}) * sqrt({_DOT.format(a='q.embedding', b='q.embedding')})))), 6) AS distance
    FROM embeddings e, embeddings q WHERE q.vec_id IN (6, 7, 8)), r AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) <= 15)
    SELECT query_id, vec_id, source AS intent, greatest(0, 1 - distance) AS score, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id)::INTEGER AS place FROM r JOIN documents ON doc_id = vec_id WHERE doc_id % 3 <> 1 QUALIFY place <= 5""")
def skill_search(spark, d):
    """Skills by cosine, three times as many fetched as wanted, as some were deleted."""
    e = tables.read(spark, d, "embeddings")
    skills = tables.read(spark, d, "documents").filter("doc_id % 3 <> 1").select(F.col("doc_id").alias("vec_id"), F.col("source").alias("intent"))
    return vectors.search_rows(skills, e, _some(e, 6, 7, 8), 5).select("query_id", "vec_id", "intent", "score", "place")


@query(f"""WITH h AS ({_HITS.format(ids='3, 4, 5')}), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id)::INTEGER AS rank FROM h),
    g AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY distance, id)::INTEGER AS group_rank FROM r WHERE rank <= 40)
    SELECT query_id, id, label, distance, rank, group_rank FROM g WHERE group_rank <= 4""")
def knn_batch_per_label_cap(spark, d):
    e = tables.read(spark, d, "embeddings")
    hits = vectors.nearest(e, _some(e, 3, 4, 5), 40).join(e.select(F.col("vec_id").alias("id"), "label"), "id")
    return vectors.cap_per_group(hits, "label", 40, 4).select("query_id", "id", "label", "distance", "rank", "group_rank")


@query(f"""WITH h AS ({_HITS.format(ids='7')}), r AS (SELECT *, row_number() OVER (ORDER BY distance, id)::INTEGER AS rank FROM h),
    f AS (SELECT * FROM r WHERE rank <= 95 AND label = (SELECT min(label) FROM embeddings))
    SELECT query_id, id, distance, rank FROM f ORDER BY rank LIMIT 15""")
def knn_post_filter_parity(spark, d):
    e = tables.read(spark, d, "embeddings")
    low = e.agg(F.min("label").alias("low"))
    hits = vectors.nearest(e, _some(e, 7), vectors.headroom(15, True)).join(e.select(F.col("vec_id").alias("id"), "label"), "id")
    return hits.join(F.broadcast(low), F.col("label") == F.col("low")).select("query_id", "id", "distance", "rank").orderBy("rank").limit(15)


@query(f"""WITH h AS ({_HITS.format(ids='0, 3, 4')}), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id)::INTEGER AS rank FROM h)
    SELECT query_id, id, distance, rank FROM r WHERE rank <= 15""")
def knn_cells(spark, d):
    """The nearest rows from a stored inverted file, cells in order of their bound (K3)."""
    e, place = tables.read(spark, d, "embeddings"), shared_place(spark)
    cells.build(e, place)
    return cells.nearest(spark, place, _some(e, 0, 3, 4), 15)[0]


@query(f"""WITH h AS ({_HITS.format(ids='0, 3, 4')}), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id)::INTEGER AS rank FROM h WHERE id % 11 <> 2)
    SELECT query_id, id, distance, rank FROM r WHERE rank <= 15""")
def knn_cells_changed(spark, d):
    """The same after rows were added, replaced and removed."""
    e, place = tables.read(spark, d, "embeddings"), shared_place(spark)
    wrong = e.filter("vec_id % 5 = 1").withColumn("embedding", F.transform("embedding", lambda x: -x))
    cells.build(e.filter("vec_id % 5 > 1").unionByName(wrong), place)
    cells.add(e.filter("vec_id % 5 < 2"), place)
    cells.remove(e.filter("vec_id % 11 = 2"), place)
    return cells.nearest(spark, place, _some(e, 0, 3, 4), 15)[0]


@query("SELECT count(*) AS n_rows, count(*) FILTER (coalesce(len(embedding), 0) <> 64)::BIGINT AS n_wrong, min(len(embedding))::INTEGER AS min_width, max(len(embedding))::INTEGER AS max_width FROM embeddings")
def vector_width_contract(spark, d):
    return vectors.width_report(tables.read(spark, d, "embeddings"), 64)


@query(f"""WITH h AS ({_HITS.format(ids='10, 11')}), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM h),
    a AS (SELECT id, 1 - distance AS score FROM r WHERE query_id = 10 AND rank <= 30), b AS (SELECT id, 1 - distance AS score FROM r WHERE query_id = 11 AND rank <= 30)
    SELECT coalesce(a.id, b.id) AS id, round((0.6 * coalesce(a.score, 0) + 0.4 * coalesce(b.score, 0)) * (0.5 + 0.5 * coalesce(n_chars % 100 / 100.0, 0.5)), 6)::DOUBLE AS score FROM a FULL JOIN b ON a.id = b.id LEFT JOIN documents ON doc_id = coalesce(a.id, b.id)""")
def dual_channel_full_outer_fusion(spark, d):
    e = tables.read(spark, d, "embeddings")
    hits = vectors.nearest(e, _some(e, 10, 11), 30).withColumn("score", 1 - F.col("distance"))
    importance = tables.read(spark, d, "documents").select(F.col("doc_id").alias("id"), ((F.col("n_chars") % 100) / 100.0).alias("importance"))
    fused = vectors.fuse_channels(hits.filter("query_id = 10"), hits.filter("query_id = 11"), importance=importance)
    return fused.select("id", F.round("score", 6).alias("score"))


@query(f"""WITH p AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
    m AS (SELECT label, i, avg(x) AS m FROM p GROUP BY label, i), n AS (SELECT label, sqrt(sum(m * m)) AS n FROM m GROUP BY label)
    SELECT m.label, (i - 1)::INTEGER AS i, round(m / n, 6) AS x FROM m JOIN n ON m.label = n.label""")
def label_centroids(spark, d):
    c = vectors.centroid(tables.read(spark, d, "embeddings"), "label")
    return c.select("label", F.posexplode("centroid").alias("i", "x")).withColumn("x", F.round("x", 6))


@query(f"""WITH fresh AS (SELECT * FROM embeddings WHERE vec_id % 10 = 0), old AS (SELECT * FROM embeddings WHERE vec_id % 10 <> 0),
    c AS (SELECT f.vec_id AS new_id, o.vec_id AS old_id, round({_DOT.format(a='f.embedding', b='o.embedding')} / (sqrt({_DOT.format(a='f.embedding', b='f.embedding')}) * sqrt({_DOT.format(a='o.embedding', b='o.embedding')})), 6) AS sim FROM fresh f, old o),
    r AS (SELECT *, row_number() OVER (PARTITION BY new_id ORDER BY sim DESC, old_id) AS r FROM c)
    SELECT new_id, CASE WHEN sim >= 0.85 THEN old_id ELSE new_id END AS skill_id, sim FROM r WHERE r = 1""")
def skill_upsert_nn(spark, d):
    """Each new skill takes the id of the old one it is nearest to, from .85 on (H8)."""
    e = tables.read(spark, d, "embeddings")
    new, old = e.filter("vec_id % 10 = 0").select(F.col("vec_id").alias("new_id"), F.col("embedding").alias("a")), e.filter("vec_id % 10 <> 0").select(F.col("vec_id").alias("old_id"), F.col("embedding").alias("b"))
    best = vectors.best_match(new, old)
    return best.select("new_id", F.when(F.col("sim") >= 0.85, F.col("old_id")).otherwise(F.col("new_id")).alias("skill_id"), "sim")


# ---- sessions ------------------------------------------------------------------------------------------------


@query("""SELECT conv_id AS session_id, count(*)::BIGINT AS turn_count, max(turn)::INTEGER AS last_turn,
    substr(min_by(text, turn) FILTER (role = 'user'), 1, 40) AS title, substr(max_by(text, turn) FILTER (role = 'user'), 1, 120) AS last_message
    FROM conversations GROUP BY conv_id""")
def session_summary(spark, d):
    return sessions.summaries(tables.turns(spark, d))


@query(f"""WITH t AS ({_TURNS}), a AS (SELECT session_id, turn_index FROM t WHERE role = 'user')
    SELECT a.session_id || ':' || a.turn_index AS anchor_id, t.session_id, t.turn_index, t.role, t.content
    FROM a JOIN t ON a.session_id = t.session_id AND t.turn_index BETWEEN a.turn_index - 2 AND a.turn_index + 2""")
def turn_window_range_join(spark, d):
    t = tables.turns(spark, d)
    anchors = t.filter("role = 'user'").select("session_id", F.col("turn_index").alias("lo"), F.col("turn_index").alias("hi"), F.concat_ws(":", "session_id", "turn_index").alias("anchor_id"))
    return sessions.window_around(t, anchors, 2)


@query(f"""WITH t AS ({_TURNS}) SELECT a.session_id, a.turn_index, max(u.turn_index)::INTEGER AS user_turn, max_by(u.content, u.turn_index) AS user_content
    FROM t a LEFT JOIN t u ON u.session_id = a.session_id AND u.role = 'user' AND u.turn_index < a.turn_index WHERE a.role = 'assistant' GROUP BY a.session_id, a.turn_index""")
def prev_user_asof(spark, d):
    return sessions.previous_user(tables.turns(spark, d))


@query(f"""WITH t AS ({_TURNS}), p AS (SELECT u.session_id, u.turn_index AS user_turn, a.turn_index AS answer_turn,
    row_number() OVER (PARTITION BY u.session_id, u.turn_index ORDER BY a.turn_index) - 1 AS nth
    FROM t u JOIN t a ON a.session_id = u.session_id AND a.role = 'assistant' AND a.turn_index > u.turn_index WHERE u.role = 'user')
    SELECT session_id, user_turn, nth::INTEGER AS nth, answer_turn FROM p WHERE nth < 2""")
def next_answers_two(spark, d):
    return sessions.next_answers(tables.turns(spark, d))


@query(f"""WITH t AS ({_TURNS}), x AS (SELECT *, sum((role = 'user')::INTEGER) OVER (PARTITION BY session_id ORDER BY turn_index)::BIGINT AS exchange FROM t)
    SELECT session_id, exchange, min(turn_index)::INTEGER AS start_turn, max(turn_index)::INTEGER AS end_turn, count(*)::BIGINT AS n_turns, sum({_tokens('content')} + 4)::BIGINT AS tokens
    FROM x GROUP BY session_id, exchange""")
def exchange_segments(spark, d):
    return sessions.exchanges(tables.turns(spark, d))


@query(f"""WITH t AS ({_TURNS}), b AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn_index DESC) AS back FROM t),
    g AS (SELECT session_id, count(*)::BIGINT AS n_live, max(turn_index) FILTER (back = 4) AS edge, sum({_tokens('content')} + 4)::BIGINT AS tokens FROM b GROUP BY session_id)
    SELECT session_id, n_live, tokens, CASE WHEN n_live > 4 THEN edge ELSE 0 END::INTEGER AS boundary, CASE WHEN tokens > 900 THEN 'sync' WHEN tokens > 700 THEN 'async' ELSE 'none' END AS action FROM g""")
def compression_boundary(spark, d):
    b = sessions.boundaries(tables.turns(spark, d))
    return b.withColumn("action", scoring.compression(F.col("tokens"), budget=1000))


@query(f"""WITH t AS ({_TURNS}), s AS (SELECT session_id, 2 AS boundary, 'summary of ' || session_id AS summary FROM t WHERE turn_index = 0),
    g AS (SELECT t.session_id, any_value(summary) AS summary, string_agg(role || ': ' || content, chr(10) ORDER BY turn_index) AS body
          FROM t LEFT JOIN s ON s.session_id = t.session_id WHERE turn_index >= coalesce(boundary, 0) AND trim(content) <> '' GROUP BY t.session_id)
    SELECT session_id, concat_ws(chr(10), summary, body) AS context FROM g""")
def render_context(spark, d):
    t = tables.turns(spark, d)
    s = t.filter("turn_index = 0").select("session_id", F.lit(2).alias("boundary_index"), F.concat(F.lit("summary of "), F.col("session_id").cast("string")).alias("content"))
    return sessions.render(t, s)


@query(f"""WITH t AS ({_TURNS}), w AS (SELECT session_id, greatest(turn_index - 1, 0) AS lo, turn_index + 1 AS hi, 0.5 + (turn_index % 5) / 100.0::DOUBLE AS score FROM t WHERE role = 'user'),
    n AS (SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY session_id ORDER BY lo, hi, score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS new FROM w),
    i AS (SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY lo, hi, score ROWS UNBOUNDED PRECEDING) AS island FROM n),
    p AS (SELECT *, row_number() OVER (PARTITION BY session_id, island ORDER BY lo, hi, score) AS i, count(*) OVER (PARTITION BY session_id, island) AS n FROM i)
    SELECT session_id, island::BIGINT AS island, min(lo)::INTEGER AS lo, max(hi)::INTEGER AS hi, max(n)::BIGINT AS n_windows,
           round(least(1, max(CASE WHEN n = 1 THEN score ELSE score + 0.03 * (n - greatest(i, 2) + 1) END)), 6)::DOUBLE AS score FROM p GROUP BY session_id, island""")
def window_islands(spark, d):
    t = tables.turns(spark, d).filter("role = 'user'")
    w = t.select("session_id", F.greatest(F.col("turn_index") - 1, F.lit(0)).alias("lo"), (F.col("turn_index") + 1).alias("hi"), (0.5 + (F.col("turn_index") % 5) / 100.0).alias("score"))
    return sessions.islands(w, 0)


@query(f"""WITH t AS ({_TURNS}), o AS (SELECT DISTINCT session_id, 3 AS watermark FROM t WHERE session_id % 2 = 0),
    n AS (SELECT t.session_id, max(turn_index) + 1 AS e FROM t LEFT JOIN o ON o.session_id = t.session_id WHERE turn_index >= coalesce(watermark, 0) GROUP BY t.session_id)
    SELECT coalesce(o.session_id, n.session_id) AS session_id, greatest(coalesce(watermark, 0), coalesce(e, 0))::INTEGER AS watermark FROM o FULL JOIN n ON o.session_id = n.session_id""")
def watermark_increment(spark, d):
    t = tables.turns(spark, d)
    offsets = t.filter("session_id % 2 = 0").select("session_id", F.lit(3).alias("watermark")).distinct()
    return sessions.advanced(offsets, sessions.new_turns(t, offsets))


# ---- text, time and content addresses ------------------------------------------------------------------------


@query(f"SELECT doc_id, {_tokens('text')} AS tokens FROM documents")
def token_estimate(spark, d):
    return tables.read(spark, d, "documents").select("doc_id", text.token_estimate(F.col("text")).alias("tokens"))


@query(f"SELECT doc_id, {_key('text')} AS key FROM documents")
def normalize_key(spark, d):
    return tables.read(spark, d, "documents").select("doc_id", text.normalize_key(F.col("text")).alias("key"))


@query("SELECT sha256(coalesce(text, '')) AS record_id, max(doc_id) AS doc_id, count(*) AS n_copies FROM documents GROUP BY 1")
def content_hash_dedup(spark, d):
    return stores.content_dedup(tables.read(spark, d, "documents"), "text", "doc_id")


@query("SELECT DISTINCT 'ev_entity_' || substr(sha256('entity:' || source), 1, 24) AS node_id, source FROM documents WHERE source IS NOT NULL")
def node_ids(spark, d):
    s = tables.read(spark, d, "documents").filter("source is not null").select("source").distinct()
    return s.select(text.node_id(F.lit("entity"), F.col("source")).alias("node_id"), "source")


@query("""WITH t AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS a, strftime(o_orderdate + INTERVAL 40 DAY, '%Y-%m-%d') AS b, strftime(o_orderdate + INTERVAL 90 DAY, '%Y-%m-%d') AS c FROM orders)
    SELECT o_orderkey, [a, b, c] AS days, 'day:' || a AS day_key, 'month:' || substr(a, 1, 7) AS month_key, strftime(last_day(a::DATE), '%Y-%m-%d') AS month_end FROM t""")
def date_keys(spark, d):
    """Dates written out in three forms, one of them twice, and found again, with one that no calendar has."""
    day = lambda n, form: F.date_format(F.date_add("o_orderdate", n), form)
    body = F.concat(F.lit("on "), day(90, "d MMM yyyy"), F.lit(", after "), day(40, "MMMM d, yyyy"), F.lit(" and "), day(0, "yyyy/M/d"), F.lit(", not 2023-02-30; again "), day(0, "yyyy-MM-dd"))
    o = tables.read(spark, d, "orders").select("o_orderkey", temporal.date_keys(body).alias("days"))
    keys = temporal.temporal_keys(F.get("days", F.lit(0)))
    return o.select("o_orderkey", "days", F.get(keys, F.lit(0)).alias("day_key"), F.get(keys, F.lit(1)).alias("month_key"), temporal.month_end(temporal.month_key(F.get("days", F.lit(0)))).alias("month_end"))


@query("""WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM documents), s AS (SELECT avg(len(w)) AS a, count(*) AS n FROM w),
    x AS (SELECT doc_id, len(w) AS l, unnest(w) AS term FROM w), h AS (SELECT doc_id, l, term, count(*) AS tf FROM x WHERE term IN ('license', 'apache', 'version', 'released') GROUP BY ALL),
    f AS (SELECT term, count(*) AS df FROM h GROUP BY term),
    b AS (SELECT doc_id AS id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / a))), 6) AS score FROM h JOIN f ON h.term = f.term, s GROUP BY doc_id)
    SELECT id, score FROM b ORDER BY score DESC, id LIMIT 20""")
def bm25_topk(spark, d):
    return ranking.bm25(tables.read(spark, d, "documents"), ["license", "apache", "version", "released"], 20)


_INDEXED = """WITH t AS ({docs}), w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM t), s AS (SELECT avg(len(w)) AS a, count(*) AS n FROM w),
    x AS (SELECT doc_id, len(w) AS l, unnest(w) AS word FROM w), q AS (SELECT * FROM (VALUES {terms}) v(t, p)),
    h AS (SELECT doc_id, l, t || CASE WHEN p THEN '*' ELSE '' END AS term, count(*) AS tf FROM x JOIN q ON CASE WHEN p THEN starts_with(word, t) ELSE word = t END GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM h GROUP BY term),
    b AS (SELECT doc_id AS id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / a))), 6) AS score FROM h JOIN f ON h.term = f.term, s GROUP BY doc_id)
    SELECT id, score FROM b ORDER BY score DESC, id LIMIT 20"""


@query(_INDEXED.format(docs="SELECT * FROM documents", terms="('license', false), ('apache', false), ('version', false), ('released', false)"))
def bm25_indexed(spark, d):
    """Full text from stored postings; the search reads the folders of its terms."""
    place = shared_place(spark)
    postings.add(tables.read(spark, d, "documents"), place)
    return postings.search(spark, place, ["license", "apache", "version", "released"], 20)


@query(_INDEXED.format(docs="SELECT doc_id, CASE WHEN doc_id % 7 = 1 THEN 'version of ' || text ELSE text END AS text FROM documents WHERE doc_id % 11 <> 2", terms="('licen', false), ('licen', true), ('version', false), ('version', true), ('v', false), ('v', true)"))
def bm25_indexed_changed(spark, d):
    """The same after documents were added, replaced and removed, with prefixes, also of one letter."""
    docs, place = tables.read(spark, d, "documents").select("doc_id", "text"), shared_place(spark)
    postings.add(docs.filter("doc_id % 5 > 0"), place)
    postings.add(docs.filter("doc_id % 5 = 0"), place)
    postings.add(docs.filter("doc_id % 7 = 1").withColumn("text", F.concat(F.lit("version of "), "text")), place)
    postings.remove(docs.filter("doc_id % 11 = 2"), place)
    return postings.search(spark, place, ["licen", "version", "v"], 20, prefixes=True)


@query("SELECT page_id, url FROM pages WHERE html LIKE '%tion%' OR url LIKE '%blog%' ORDER BY page_id DESC LIMIT 20 OFFSET 5")
def like_search(spark, d):
    p = tables.read(spark, d, "pages").filter(F.col("html").contains("tion") | F.col("url").contains("blog"))
    return p.select("page_id", "url").orderBy(F.desc("page_id")).offset(5).limit(20)


@query(f"""WITH q AS (SELECT item_id, list_distinct(regexp_extract_all({_fold('text')}, '[\\p{{L}}\\p{{N}}_]+')) AS a FROM benchmark), o AS (SELECT doc_id, list_distinct(regexp_extract_all({_fold("coalesce(text, '')")}, '[\\p{{L}}\\p{{N}}_]+')) AS b FROM documents),
    x AS (SELECT item_id, unnest(a) AS t, len(a) AS n FROM q), y AS (SELECT doc_id, unnest(b) AS t, len(b) AS n FROM o),
    s AS (SELECT item_id, doc_id, count(*) AS shared, any_value(x.n) AS nx, any_value(y.n) AS ny FROM x JOIN y ON x.t = y.t GROUP BY item_id, doc_id)
    SELECT item_id, doc_id, round(shared / (nx + ny - shared), 6) AS similarity FROM s WHERE shared * 5 >= nx + ny - shared""")
def jaccard_similarity(spark, d):
    """Question and document term sets that share a fifth or more.

    Such a pair shares a fifth of the question's terms, so one of its rarest n - ceil(n / 5) + 1; only on these do the sides
    meet. What they share there and the few frequent terms that are left bound the overlap; only then are sets compared.
    """
    sets = lambda t, i, s: tables.read(spark, d, t).select(i, text.token_set(F.col("text")).alias(s))
    x, y = stored(sets("benchmark", "item_id", "a"), "questions"), stored(sets("documents", "doc_id", "b"), "terms")
    terms = x.select("item_id", F.size("a").alias("nx"), F.explode("a").alias("t"))
    postings = y.select("doc_id", F.size("b").alias("ny"), F.explode("b").alias("t"))
    sizes = terms.agg(F.min("nx").alias("least"), F.max("nx").alias("most"))  # one row
    postings = postings.crossJoin(F.broadcast(sizes)).filter("5 * most >= ny and 5 * ny >= least").drop("least", "most")
    often = postings.join(terms.select("t").distinct(), "t", "left_semi").groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    rare = terms.join(often, "t").withColumn("r", F.row_number().over(Window.partitionBy("item_id").orderBy("df", "t")))
    gone = F.col("nx") - F.count(F.lit(1)).over(Window.partitionBy("item_id"))  # terms that no document has are the rarest
    rare = rare.withColumn("gone", gone).filter(F.col("r") + F.col("gone") <= F.col("nx") - F.ceil(F.col("nx") / 5) + 1)
    met = rare.join(postings, "t").filter("5 * nx >= ny and 5 * ny >= nx").groupBy("item_id", "doc_id").agg(F.count(F.lit(1)).alias("some"), F.first("nx").alias("nx"), F.first("ny").alias("ny"))
    met = met.filter("6 * (some + ceil(nx / 5) - 1) >= nx + ny").select("item_id", "doc_id")
    both = F.size(F.array_intersect("a", "b"))
    s = met.join(x, "item_id").join(y, "doc_id").select("item_id", "doc_id", both.alias("both"), (F.size("a") + F.size("b") - both).alias("all"))
    return s.filter("5 * both >= all").select("item_id", "doc_id", F.round(F.col("both") / F.col("all"), 6).alias("similarity"))


# ---- evidence ------------------------------------------------------------------------------------------------


def _records(spark, d) -> DataFrame:
    docs = tables.read(spark, d, "documents")
    return docs.select(F.col("doc_id").alias("record_id"), F.array_compact(F.array("source")).alias("entities"), F.array_compact(F.array("lang", F.lit("fact"))).alias("tags"))


_INDEX = """SELECT 'entity' AS node_type, source AS key, doc_id AS record_id FROM documents WHERE source IS NOT NULL
    UNION ALL SELECT 'tag', lang, doc_id FROM documents WHERE lang IS NOT NULL UNION ALL SELECT 'tag', 'fact', doc_id FROM documents"""


@query(f"""WITH i AS ({_INDEX} UNION ALL SELECT 'entity_tag', source || '::' || lang, doc_id FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL
    UNION ALL SELECT 'entity_tag', source || '::fact', doc_id FROM documents WHERE source IS NOT NULL)
    SELECT 'ev_' || node_type || '_' || substr(sha256(node_type || ':' || key), 1, 24) AS node_id, node_type, key, list_sort(list(DISTINCT record_id)) AS record_ids FROM i GROUP BY node_type, key""")
def evidence_entity_tag_nodes(spark, d):
    return evidence.term_nodes(_records(spark, d))


@query(f"""WITH t AS ({_TURNS}) SELECT session_id, (turn_index // 4)::INTEGER AS frame, min(turn_index)::INTEGER AS start_turn, max(turn_index)::INTEGER AS end_turn,
    list_sort(list(DISTINCT role)) AS roles, count(*)::BIGINT AS n_turns FROM t GROUP BY 1, 2""")
def event_frames(spark, d):
    return evidence.event_frames(tables.turns(spark, d))


def _days(spark, d) -> DataFrame:
    return tables.read(spark, d, "orders").select(F.col("o_orderkey").alias("record_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


_NODES = """SELECT 'day:' || day AS key, day AS start, day AS "end", count(*)::BIGINT AS n_records FROM (SELECT strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders) GROUP BY day
    UNION ALL SELECT 'month:' || m, m || '-01', strftime(last_day((m || '-01')::DATE), '%Y-%m-%d'), count(*)::BIGINT FROM (SELECT strftime(o_orderdate, '%Y-%m') AS m FROM orders) GROUP BY m"""


@query(_NODES)
def temporal_nodes(spark, d):
    return evidence.temporal_nodes(_days(spark, d))



@query(f"""WITH i AS (SELECT DISTINCT * FROM ({_INDEX})), n AS (SELECT * FROM (VALUES ('entity', 'src1', 0.9), ('entity', 'src2', 0.5), ('tag', 'fr', 0.8)) v(node_type, key, score))
    SELECT record_id, round(max(score * CASE WHEN i.node_type = 'entity' THEN 0.34 ELSE 0.32 END), 6)::DOUBLE AS field_score, count(*)::BIGINT AS n_nodes FROM n JOIN i ON n.node_type = i.node_type AND n.key = i.key GROUP BY record_id""")
def node_to_record_expansion(spark, d):
    hits = spark.createDataFrame([("entity", "src1", 0.9), ("entity", "src2", 0.5), ("tag", "fr", 0.8)], "node_type string, key string, score double")
    return evidence.expand(hits, evidence.postings(_records(spark, d)))


@query("""WITH s AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS i FROM lineitem WHERE l_orderkey IS NOT NULL), n AS (SELECT o, count(*) AS n FROM s GROUP BY o),
    b AS (SELECT a.o AS child, c.o AS parent, count(*) AS shared FROM s a JOIN s c ON a.i = c.i AND a.o <> c.o GROUP BY 1, 2),
    x AS (SELECT child, parent, nc.n AS n_child, np.n AS n_parent, row_number() OVER (PARTITION BY child ORDER BY np.n, parent) AS r FROM b JOIN n nc ON nc.o = child JOIN n np ON np.o = parent WHERE shared = nc.n AND np.n > nc.n)
    SELECT child, parent, n_child, n_parent FROM x WHERE r = 1""")
def containment_tree(spark, d):
    return evidence.containment_tree(tables.read(spark, d, "lineitem").filter("l_orderkey is not null").select(F.col("l_orderkey").alias("set_id"), F.col("l_partkey").alias("item")))


@query("""WITH e AS (SELECT DISTINCT 'entity:' || source AS node, d.doc_id FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE l.quality = 1 AND source IS NOT NULL)
    SELECT node AS id FROM e GROUP BY node UNION ALL SELECT doc_id::VARCHAR FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM e)""")
def bipartite_roots(spark, d):
    docs, good = tables.read(spark, d, "documents"), tables.read(spark, d, "labels").filter("quality = 1")
    index = docs.filter("source is not null").join(good.select("doc_id").distinct(), "doc_id", "left_semi").select(F.lit("entity").alias("node_type"), F.col("source").alias("key"), F.col("doc_id").alias("record_id"))
    return evidence.graph(index, docs.select(F.col("doc_id").alias("record_id")))[1]


# ---- stores --------------------------------------------------------------------------------------------------


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_join_backfill(spark, d):
    return stores.missing(tables.read(spark, d, "documents"), tables.read(spark, d, "labels"), "doc_id").select("doc_id", "source")


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def semi_join_lookup(spark, d):
    return stores.lookup(tables.read(spark, d, "documents"), tables.read(spark, d, "labels"), "doc_id").select("doc_id", "source")


@query("""SELECT user_id, max_by(event_type, event_id) AS event_type, max_by(value, event_id) AS value, min_by(ts, event_id) AS created_at FROM events GROUP BY user_id""")
def upsert_first_created(spark, d):
    e = tables.read(spark, d, "events").select("user_id", "event_id", "event_type", "value", F.col("ts").alias("created_at"))
    old, new = e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1")
    return stores.upsert(old, new, "user_id", "event_id", ["created_at"]).select("user_id", "event_type", "value", "created_at")


@query("SELECT event_type AS scene_type, count(*) AS n, count(DISTINCT user_id) AS n_users FROM events GROUP BY event_type")
def scene_stats(spark, d):
    return tables.read(spark, d, "events").groupBy(F.col("event_type").alias("scene_type")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("n_users"))


@query("SELECT event_type AS source, count(*) AS calls, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, max(value) AS most FROM events GROUP BY event_type")
def usage_stats(spark, d):
    e = tables.read(spark, d, "events").groupBy(F.col("event_type").alias("source"))
    return e.agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("most"))


@query("""WITH x AS (SELECT *, concat_ws('|', event_type, floor(value / 10)::BIGINT) AS mark FROM events), y AS (SELECT *, lag(mark) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM x)
    SELECT event_id, user_id FROM y WHERE b IS NULL OR b <> mark""")
def pair_dedup_lag(spark, d):
    e = tables.read(spark, d, "events").withColumn("bin", F.floor(F.col("value") / 10).cast("bigint"))
    return stores.pair_dedup(e, ["event_type", "bin"]).select("event_id", "user_id")


#: Each boundary against the last accepted one, event by event.
_BOUNDARIES = """WITH RECURSIVE e AS (SELECT event_id, user_id, event_type, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    r AS (SELECT user_id, 0::BIGINT AS n, NULL::BIGINT AS event_id, NULL::VARCHAR AS kind, NULL::TIMESTAMP AS mo, false AS accepted, 0::BIGINT AS generation FROM e WHERE n = 1
    UNION ALL SELECT user_id, n, event_id, CASE WHEN takes THEN event_type ELSE kind END, CASE WHEN takes THEN ts ELSE mo END, takes, generation + takes::BIGINT
    FROM (SELECT e.*, r.kind, r.mo, r.generation, r.kind IS NULL OR r.kind <> e.event_type OR epoch_us(e.ts) - epoch_us(r.mo) >= {gap} AS takes FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1))"""


@query(_BOUNDARIES.format(gap=36_000_000_000) + " SELECT event_id, user_id FROM r WHERE accepted")
def debounce_gap(spark, d):
    """Boundaries that are accepted: of another kind than the last accepted one, or long enough after it."""
    return throttle.boundaries(tables.read(spark, d, "events"), 36_000).filter("accepted").select("event_id", "user_id")


@query("""WITH x AS (SELECT event_id, least(1, greatest(0, value / 100)) AS imp, (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) / 3.6e9 AS h FROM events), y AS (SELECT event_id,
    round(least(1, power(0.5::DOUBLE, h / (168 * (1 + imp * (720.0::DOUBLE / 168 - 1)))) + least(0.3, 0.05 * (event_id % 4))), 4)::DOUBLE AS decay FROM x) SELECT event_id, decay, decay < 0.1 AS forget FROM y""")
def forgetting_curve(spark, d):
    e = tables.read(spark, d, "events")
    hours = F.timestamp_diff("MICROSECOND", F.col("ts"), F.expr("timestamp_ntz'2024-02-01 00:00:00'")) / 3.6e9
    t = e.select("event_id", scoring.decay(hours, scoring.clamp(F.col("value") / 100), F.col("event_id") % 4).alias("decay"))
    return t.withColumn("forget", F.col("decay") < 0.1)


@query("SELECT event_id, CASE WHEN value / 100 >= 0.8 THEN 90 WHEN value / 100 >= 0.5 THEN 30 WHEN value / 100 >= 0.3 THEN 14 ELSE 7 END AS days FROM events")
def ttl_tiers(spark, d):
    return tables.read(spark, d, "events").select("event_id", scoring.ttl_days(F.col("value") / 100).alias("days"))


# ---- ranking -------------------------------------------------------------------------------------------------


@query(f"""WITH h AS ({_HITS.format(ids='20, 21, 22')}), s AS (SELECT query_id AS route, id, 1 - distance / 4 AS score FROM h), r AS (SELECT *, row_number() OVER (PARTITION BY route ORDER BY score DESC, id) AS rank FROM s),
    f AS (SELECT id, sum(1.0::DOUBLE / (60 + rank)) AS rrf, max(score) AS best, min(rank) AS best_rank FROM r WHERE rank <= 60 GROUP BY id),
    g AS (SELECT id, best_rank, round(0.82 * best + 0.18 * (rrf / (SELECT max(rrf) FROM f)), 6) AS score FROM f),
    c1 AS (SELECT id, rank AS n FROM r WHERE route = 20 AND rank <= 4),
    c2 AS (SELECT id, 4 + row_number() OVER (ORDER BY rank) AS n FROM r WHERE route = 21 AND id NOT IN (SELECT id FROM c1) QUALIFY row_number() OVER (ORDER BY rank) <= 4),
    c3 AS (SELECT id, 8 + row_number() OVER (ORDER BY rank) AS n FROM r WHERE route = 22 AND id NOT IN (SELECT id FROM c1 UNION SELECT id FROM c2) QUALIFY row_number() OVER (ORDER BY rank) <= 4),
    c4 AS (SELECT id, 12 + row_number() OVER (ORDER BY score DESC, id) AS n FROM g WHERE id NOT IN (SELECT id FROM c1 UNION SELECT id FROM c2 UNION SELECT id FROM c3)),
    o AS (SELECT * FROM c1 UNION ALL SELECT * FROM c2 UNION ALL SELECT * FROM c3 UNION ALL SELECT * FROM c4)
    SELECT id, best_rank::INTEGER AS best_rank, score, n::INTEGER AS place FROM o JOIN g USING (id) WHERE n <= 15""")
def rrf_fusion(spark, d):
    e = tables.read(spark, d, "embeddings")
    hits = vectors.nearest(e, _some(e, 20, 21, 22), 60).select(F.lit(1).alias("request"), F.col("query_id").alias("route"), F.col("query_id").alias("route_no"), "id", (1 - F.col("distance") / 4).alias("score"))
    return ranking.rrf(hits, 15).drop("request")


@query(f"""WITH h AS ({_HITS.format(ids='30')}), c AS (SELECT id, label::VARCHAR AS bucket, 1 - distance / 4 AS score, row_number() OVER (ORDER BY 1 - distance / 4 DESC, id) AS place FROM h),
    f AS (SELECT id, 0 AS turn, NULL AS spot, score, place FROM c WHERE place <= 40),
    r AS (SELECT id, row_number() OVER (PARTITION BY bucket ORDER BY score DESC, id) AS turn, bucket AS spot, score, 0 AS place FROM c WHERE place > 40),
    p AS (SELECT *, row_number() OVER (ORDER BY turn, place, spot NULLS FIRST)::INTEGER AS n FROM (SELECT * FROM f UNION ALL SELECT * FROM r))
    SELECT n, id, turn::INTEGER AS turn, score FROM p WHERE n <= 60""")
def rerank_pool_round_robin(spark, d):
    """All vectors as candidates, a channel a label: each label has its turn, however low its best one ranks."""
    e = tables.read(spark, d, "embeddings")
    hits = vectors.distances(e, _some(e, 30)).join(e.select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("bucket")), "id")
    c = hits.select(F.lit(1).alias("request"), "id", F.lit("record").alias("source"), F.array("bucket").alias("channels"), (1 - F.col("distance") / 4).alias("score"))
    return ranking.rerank_pool(c, 60).select("n", "id", "turn", "score")


@query()
def mmr_select(spark, d):
    docs = tables.read(spark, d, "documents").filter("lang is not null")
    c = docs.select(F.col("lang").alias("request"), F.col("doc_id").alias("id"), (1 / (1 + F.col("n_chars") / 1000)).alias("score"), "text", F.col("source").alias("session"), F.array("source").alias("entities"))
    return ranking.mmr(c, 10)


@query(f"""WITH h AS ({_HITS.format(ids='40, 41')}), c AS (SELECT query_id AS request, id, CASE WHEN id % 2 = 0 THEN 'episode' ELSE 'record' END AS source, 1 - distance / 4 AS score, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS place FROM h QUALIFY place <= 40),
    s AS (SELECT *, id % 3 AS route FROM c WHERE place <= 15), b AS (SELECT request, max(score) AS best FROM c WHERE source = 'record' GROUP BY request),
    rr AS (SELECT DISTINCT request, route FROM s WHERE source = 'record'), er AS (SELECT request, count(DISTINCT route) AS n FROM s WHERE source = 'episode' GROUP BY request),
    m AS (SELECT s.*, b.best, er.n AS n_routes, source = 'episode' AND NOT EXISTS (SELECT 1 FROM rr WHERE rr.request = s.request AND rr.route = s.route) AS needed FROM s JOIN b USING (request) JOIN er USING (request)),
    t AS (SELECT *, source = 'episode' AND NOT needed AND score >= greatest(0.35, best * 0.72) AS fit FROM m),
    a AS (SELECT *, coalesce(sum((needed OR fit)::INTEGER) OVER (PARTITION BY request ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM t),
    k AS (SELECT request, id, source, score, 0 AS late FROM a WHERE source = 'record' OR needed OR (fit AND ahead < greatest(1, least(15, greatest(2, 6, n_routes))))),
    f AS (SELECT c.request, c.id, c.source, c.score, 1 AS late FROM c JOIN (SELECT request, 15 - count(*) AS room FROM k GROUP BY request) USING (request) WHERE source = 'record' AND id NOT IN (SELECT id FROM k WHERE k.request = c.request)
          QUALIFY row_number() OVER (PARTITION BY c.request ORDER BY c.score DESC, c.id) <= any_value(room) OVER (PARTITION BY c.request))
    SELECT request, id, source, score, row_number() OVER (PARTITION BY request ORDER BY score DESC, late, id)::INTEGER AS place FROM (SELECT * FROM k UNION ALL SELECT * FROM f)""")
def episode_budget(spark, d):
    """Fifteen selected of forty candidates, even ids as dialogue, in three routes (T4)."""
    e = tables.read(spark, d, "embeddings")
    c = vectors.nearest(e, _some(e, 40, 41), 40).select(F.col("query_id").alias("request"), "id", F.when(F.col("id") % 2 == 0, "episode").otherwise("record").alias("source"), (1 - F.col("distance") / 4).alias("score"), F.col("rank").alias("place"), F.array((F.col("id") % 3).cast("string")).alias("routes"))
    return ranking.episode_budget(c.filter("place <= 15"), c, 15)


# ---- streams -------------------------------------------------------------------------------------------------


@query()
def chunker_batch(spark, d):
    return chunker.chunks(tables.turns(spark, d))


@query()
def chunk_decisions(spark, d):
    """What the chunker decided before and after each exchange, with all signals."""
    return chunker.decisions(tables.turns(spark, d))


@query()
def pending_chunks(spark, d):
    """What a stopped stream has open, read from its state: no turn is marked as its session's last."""
    place = shared_place(spark)
    turns = chunker.turn_stream(spark, f"{d}/conversations.parquet").withColumn("last", F.lit(False))
    chunker.log_stream(turns, idle=None).writeStream.format("noop").option("checkpointLocation", f"{place}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return chunker.open_chunks(spark, f"{place}/state")


@query()
def chunker_stream_equals_batch(spark, d):
    """Turns fed as a stream, session by session: the same chunks as in one batch."""
    return chunker.stream_chunks(spark, f"{d}/conversations.parquet")


@query("""WITH RECURSIVE e AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    r AS (SELECT user_id, 0::BIGINT AS n, NULL::BIGINT AS event_id, NULL::TIMESTAMP AS mo, false AS runs FROM e WHERE n = 1 UNION ALL SELECT user_id, n, event_id, CASE WHEN runs THEN ts ELSE mo END, runs
    FROM (SELECT e.*, r.mo, r.mo IS NULL OR epoch_us(e.ts) - epoch_us(r.mo) >= 3600000000 AS runs FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)) SELECT event_id, user_id FROM r WHERE runs""")
def cooldown_throttle(spark, d):
    """Events that run: long enough after the last of their user that ran."""
    return throttle.cooldown(tables.read(spark, d, "events"), 3600)


#: Seconds that suit the gaps between a user's events.
_POLICY = lifecycle.Policy(debounce=20_000, boundary=40_000, hook=60_000, proactive=80_000, idle=200_000)
_LIVES = """WITH RECURSIVE e AS (SELECT event_id, user_id AS session_id, epoch_us(ts) AS mo, event_id % 3 = 0 AS signal, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n,
      CASE event_type WHEN 'view' THEN 'user' WHEN 'signup' THEN 'assistant' WHEN 'click' THEN 'before_reset' WHEN 'error' THEN 'hook' ELSE CASE WHEN event_id % 4 > 0 THEN 'session_end' ELSE 'command_stop' END END AS kind FROM events),
    r AS (SELECT session_id, 0::BIGINT AS n, NULL::BIGINT AS event_id, NULL::BIGINT AS mo, NULL::VARCHAR AS kind, false AS live, NULL::VARCHAR AS b_kind, NULL::BIGINT AS b_at, NULL::BIGINT AS c_at, false AS pending, 0 AS dirty, 0 AS generation,
        false AS accepted, false AS consolidated, NULL::VARCHAR AS reason, false AS idle, NULL::BIGINT AS idle_at, 0 AS idle_dirty, 0 AS idle_generation FROM e WHERE n = 1
      UNION ALL SELECT session_id, n, event_id, mo, kind, known AND NOT (accepted AND kind IN ('session_end', 'command_stop')), CASE WHEN accepted AND ends THEN kind ELSE b_kind END, CASE WHEN accepted AND ends THEN mo ELSE b_at END,
        CASE WHEN done THEN mo ELSE c_at END, pending AND NOT done, CASE WHEN done THEN 0 ELSE dirty END, generation + (accepted AND kind = 'before_reset')::INTEGER, accepted, done,
        CASE WHEN NOT known THEN 'no_session' WHEN NOT accepted THEN 'debounced' WHEN done THEN CASE kind WHEN 'assistant' THEN 'proactive' WHEN 'hook' THEN 'hook' ELSE 'boundary' END
          WHEN kind = 'user' OR kind = 'assistant' AND NOT pending THEN 'turn' WHEN kind = 'hook' AND dirty = 0 THEN 'clean' ELSE 'cooldown' END, idle, idle_at, idle_dirty, idle_generation
      FROM (SELECT *, known AND accepted_if AND CASE kind WHEN 'user' THEN false WHEN 'assistant' THEN pending AND coalesce(mo - c_at >= 80000000000, true) WHEN 'hook' THEN dirty > 0 AND coalesce(mo - c_at >= 60000000000, true)
          ELSE pending OR coalesce(mo - c_at >= 40000000000, true) END AS done, known AND accepted_if AS accepted
        FROM (SELECT * EXCLUDE (dirty, pending), dirty + turn::INTEGER AS dirty, pending OR (kind = 'user' AND signal) AS pending, turn OR was_live AS known, kind NOT IN ('user', 'assistant', 'hook') AS ends,
            kind IN ('user', 'assistant', 'hook') OR NOT coalesce(mo - b_at < 20000000000 AND (b_kind = kind OR (kind = 'session_end' AND b_kind = 'before_reset')), false) AS accepted_if
          FROM (SELECT *, live AND NOT idle AS was_live, kind IN ('user', 'assistant') AS turn, CASE WHEN live AND NOT idle THEN o_kind END AS b_kind, CASE WHEN live AND NOT idle THEN o_at END AS b_at,
              CASE WHEN live AND NOT idle THEN o_c END AS c_at, live AND NOT idle AND o_pending AS pending, CASE WHEN live AND NOT idle THEN o_dirty ELSE 0 END AS dirty, CASE WHEN live AND NOT idle THEN o_generation ELSE 0 END AS generation
            FROM (SELECT e.*, r.live, r.live AND e.mo >= r.mo + 200000000000 AS idle, r.mo + 200000000000 AS idle_at, r.dirty AS idle_dirty, r.generation AS idle_generation, r.b_kind AS o_kind, r.b_at AS o_at, r.c_at AS o_c, r.pending AS o_pending, r.dirty AS o_dirty, r.generation AS o_generation
              FROM r JOIN e ON e.session_id = r.session_id AND e.n = r.n + 1))))),
    last AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY n DESC) = 1)
    SELECT session_id, event_id, mo AS "at", kind, accepted, consolidated, reason, generation, dirty FROM r WHERE n > 0
    UNION ALL SELECT session_id, NULL, idle_at, 'idle', true, idle_dirty > 0, CASE WHEN idle_dirty > 0 THEN 'idle' ELSE 'clean' END, idle_generation, 0 FROM r WHERE idle
    UNION ALL SELECT session_id, NULL, mo + 200000000000, 'idle', true, dirty > 0, CASE WHEN dirty > 0 THEN 'idle' ELSE 'clean' END, generation, 0 FROM last WHERE live AND (mo + 200000000000) // 1000 <= (SELECT max(mo) // 1000 FROM e)"""


def _host_events(events):
    """The events table as what a host tells of its sessions."""
    kind = F.when(F.col("event_type") == "view", "user").when(F.col("event_type") == "signup", "assistant").when(F.col("event_type") == "click", "before_reset").when(F.col("event_type") == "error", "hook")
    kind = kind.otherwise(F.when(F.col("event_id") % 4 > 0, "session_end").otherwise("command_stop"))
    return events.select("event_id", F.col("user_id").alias("session_id"), throttle.micros().alias("at"), kind.alias("kind"), (F.col("event_id") % 3 == 0).alias("signal"))


@query(_LIVES)
def lifecycle_decisions(spark, d):
    """What each turn, hook and boundary of a session does: debounce, cooldowns of three tiers, rotation, idle sessions."""
    return lifecycle.decisions(_host_events(tables.read(spark, d, "events")), _POLICY)


@query(_LIVES)
def lifecycle_stream(spark, d):
    """The same as keyed state of a stream, with timers."""
    return lifecycle.stream_over(spark, _host_events(tables.stream(spark, f"{d}/events.parquet")), _POLICY)


# ---- more of the stores, plans and scores ------------------------------------------------------------------------


@query("""WITH e AS (SELECT *, event_id % 7 AS part FROM events), n AS (SELECT event_type, part, max(event_id) AS seq, event_type || ' ' || CASE WHEN part % 3 = 0 THEN '' ELSE part::VARCHAR END AS search_text FROM e GROUP BY event_type, part),
    o AS (SELECT event_type, trim(string_agg(trim(search_text), chr(10) ORDER BY seq)) AS all_texts, list(trim(search_text) ORDER BY seq) AS texts FROM n GROUP BY event_type),
    t AS (SELECT event_type, list_reduce(list_prepend('', texts), lambda a, x: CASE WHEN contains(a, x) THEN a WHEN a = '' THEN x ELSE a || chr(10) || x END) AS search_text FROM o)
    SELECT 'n' || event_type AS node_id, max(event_id) AS seq, list_sort(list(DISTINCT user_id)) AS record_ids, any_value(t.search_text) AS search_text, strftime(min(ts), '%Y-%m-%d') AS start, strftime(max(ts), '%Y-%m-%d') AS "end" FROM events JOIN t USING (event_type) GROUP BY event_type""")
def node_merge(spark, d):
    e = tables.read(spark, d, "events").groupBy("event_type", (F.col("event_id") % 7).alias("part"))
    nodes = e.agg(F.max("event_id").alias("seq"), F.collect_set("user_id").alias("record_ids"), F.date_format(F.min("ts"), "yyyy-MM-dd").alias("start"), F.date_format(F.max("ts"), "yyyy-MM-dd").alias("end"))
    part = F.when(F.col("part") % 3 == 0, F.lit("")).otherwise(F.col("part").cast("string"))
    nodes = nodes.select(F.concat(F.lit("n"), "event_type").alias("node_id"), "part", "seq", "record_ids", F.trim(F.concat("event_type", F.lit(" "), part)).alias("search_text"), "start", "end")
    merged = stores.merge_nodes(nodes.filter("part < 4").drop("part"), nodes.filter("part >= 4").drop("part"))
    return merged.select("node_id", "seq", "record_ids", "search_text", "start", "end")


@query("SELECT user_id, event_type FROM events WHERE event_id % 2 = 1 EXCEPT SELECT user_id, event_type FROM events WHERE event_id % 2 = 0 AND value >= 10")
def insert_missing(spark, d):
    e = tables.read(spark, d, "events")
    return stores.insert_missing(e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1").select("user_id", "event_type").distinct(), ["user_id", "event_type"], "value >= 10")


@query("SELECT c_custkey AS user_id, count(event_id) AS retrieval_count FROM customer LEFT JOIN events ON user_id = c_custkey GROUP BY c_custkey")
def counter_updates(spark, d):
    rows = tables.read(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.lit(0).cast("bigint").alias("retrieval_count"))
    return stores.add_counts(rows, tables.read(spark, d, "events"), "user_id", "retrieval_count").select("user_id", "retrieval_count")


@query("""SELECT conv_id AS session_id, count(*) FILTER (NOT (conv_id = 1 AND turn < 3))::BIGINT AS turn_count FROM conversations GROUP BY conv_id""")
def soft_delete_listing(spark, d):
    return sessions.summaries(sessions.soft_delete(tables.turns(spark, d), 1, 3)).select("session_id", "turn_count")


@query("""SELECT vec_id, label, embedding FROM embeddings WHERE vec_id % 20 <> 0 UNION ALL SELECT vec_id, label + 100 AS label, embedding FROM embeddings WHERE vec_id % 20 = 0""")
def vector_replace(spark, d):
    e = tables.read(spark, d, "embeddings").select("vec_id", "label", "embedding")
    new = e.filter("vec_id % 20 = 0").withColumn("label", F.col("label") + 100)
    return stores.replace_by_key(e, vectors.checked(new, 64), "vec_id")


@query("""SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS k FROM events""")
def json_columns(spark, d):
    e = tables.read(spark, d, "events")
    return e.select("event_id", F.coalesce(F.from_json("props", "k bigint")["k"], F.lit(0).cast("bigint")).alias("k"))


@query("""SELECT doc_id, CASE WHEN length(text) <= 400 THEN text ELSE substr(text, 1, 197) || chr(10) || '...' || chr(10) || right(text, 197) END AS text,
    'user: ' || CASE WHEN starts_with(text, source || ':') THEN text ELSE source || ': ' || text END AS line FROM documents WHERE text IS NOT NULL AND source IS NOT NULL""")
def embedding_text(spark, d):
    t = tables.read(spark, d, "documents").filter("text is not null and source is not null")
    return t.select("doc_id", text.head_and_tail(F.col("text"), 400).alias("text"), text.turn_line(F.lit("user"), F.col("text"), F.col("source")).alias("line"))


@query("""SELECT event_id, round(CASE WHEN value / 50 BETWEEN 0 AND 1 THEN value / 50 ELSE 1 / (1 + exp(-least(50, greatest(-50, value / 50)))) END, 6) AS score FROM events""")
def rerank_normalization(spark, d):
    return tables.read(spark, d, "events").select("event_id", F.round(scoring.rerank_score(F.col("value") / 50), 6).alias("score"))


@query(f"""SELECT session_id, n_live, tokens, CASE WHEN tokens < 700 THEN -1.3 WHEN tokens < 1000 THEN -0.8 + 0.8 * ((tokens - 700) / 300.0)
    WHEN tokens < 1500 THEN 0.45 + 1.45 * ((tokens - 1000) / 500.0) WHEN tokens < 2000 THEN 1.9 + 0.9 * ((tokens - 1500) / 500.0) ELSE 3.0 END::DOUBLE AS hazard
    FROM (SELECT conv_id AS session_id, count(*)::BIGINT AS n_live, sum({_tokens("coalesce(text, '')")} + 4)::BIGINT AS tokens FROM conversations GROUP BY conv_id)""")
def length_hazards(spark, d):
    b = sessions.boundaries(tables.turns(spark, d)).select("session_id", "n_live", "tokens")
    return b.withColumn("hazard", scoring.length_hazard(F.col("tokens")))


@query("""WITH i AS (SELECT DISTINCT source AS k, doc_id FROM documents WHERE source IS NOT NULL) SELECT 'entity:' || k AS source, doc_id::VARCHAR AS target FROM i""")
def graph_edges(spark, d):
    docs = tables.read(spark, d, "documents")
    index = docs.filter("source is not null").select(F.lit("entity").alias("node_type"), F.col("source").alias("key"), F.col("doc_id").alias("record_id")).distinct()
    return evidence.graph(index, docs.select(F.col("doc_id").alias("record_id")))[0]


@query("""SELECT doc_id AS plan_id, CASE doc_id % 4 WHEN 0 THEN 'temporal' ELSE 'default' END AS strategy, CASE doc_id % 4 WHEN 0 THEN [source, 'of ' || lang] WHEN 3 THEN list_prepend(source, list_transform(range(1, 16), lambda i: 'q' || i)) ELSE [source] END AS semantic_queries,
    CASE doc_id % 4 WHEN 0 THEN ['lang: ' || lang] WHEN 3 THEN list_transform(range(12), lambda i: 'k: ' || i) ELSE []::VARCHAR[] END AS constraints, CASE doc_id % 4 WHEN 0 THEN 2 WHEN 3 THEN 8 ELSE 1 END AS n_routes,
    CASE doc_id % 4 WHEN 0 THEN [source, 'Move ' || lang] ELSE [source] END AS first_queries FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL""")
def plan_parsing(spark, d):
    """Plans about every document: a full one, malformed JSON, an unknown question type, and one with more of all than is kept."""
    i, s, lang = F.col("doc_id") % 4, F.col("source"), F.col("lang")
    full = F.concat(F.lit('{"question_type": " Temporal ", "semantic_queries": ["'), F.upper(s), F.lit('", "of '), lang, F.lit('", ""], "constraints": [{"kind": "lang", "value": "'), lang, F.lit('"}], "routes": [{"goal": "g", "queries": ["Move '), lang, F.lit('", "MOVE '), lang, F.lit('"]}, {"route_id": "b"}]}'))
    many = '{"semantic_queries": [' + ", ".join(f'"q{n}"' for n in range(1, 30)) + '], "constraints": [' + ", ".join(f'{{"kind": "k", "value": "{n}"}}' for n in range(20)) + '], "routes": [' + ", ".join(f'{{"route_id": "r{n}"}}' for n in range(11)) + "]}"
    plan = F.when(i == 0, full).when(i == 1, F.concat(F.lit("{oops "), s)).when(i == 2, F.lit('{"question_type": "riddle"}')).otherwise(F.lit(many))
    rows = tables.read(spark, d, "documents").filter("source is not null and lang is not null").select(F.col("doc_id").alias("plan_id"), s.alias("query"), plan.alias("plan"))
    p = plans_io.with_strategy(plans_io.parse_plans(rows))
    return p.select("plan_id", "strategy", "semantic_queries", "constraints", F.size("routes").alias("n_routes"), F.get("routes", F.lit(0))["queries"].alias("first_queries"))


@query("""WITH s AS (SELECT * FROM (VALUES (0, 'default', 1.0::DOUBLE, 1.0::DOUBLE, 1.0::DOUBLE), (1, 'prior_assistant_response', 0.95, 0.95, 3.0), (2, 'personalized_advice', 1.25, 1.2, 1.8), (3, 'aggregate', 1.55, 1.45, 1.0), (4, 'temporal', 1.35, 1.3, 1.45), (5, 'comparison', 1.35, 1.3, 1.3)) v(n, strategy, e, r, t)),
    d AS (SELECT doc_id, doc_id % 6 AS n, (n_chars % 40 + 1)::INTEGER AS k FROM documents WHERE n_chars IS NOT NULL)
    SELECT doc_id AS plan_id, strategy, floor(greatest(3 * k, 30) * e)::INTEGER AS evidence, floor(greatest(3 * k, 30) * r)::INTEGER AS records, floor(greatest(k, 20) * t)::INTEGER AS turns, greatest(10 * k, 100)::INTEGER AS temporal FROM d JOIN s USING (n)""")
def channel_limits(spark, d):
    """How many hits each channel gives, by strategy and depth (T5)."""
    kind = F.get(F.array(*[F.lit(x) for x in ("default", "prior_assistant_response", "personalized_advice", "aggregate", "temporal", "comparison")]), (F.col("doc_id") % 6).cast("int"))
    rows = tables.read(spark, d, "documents").filter("n_chars is not null").select(F.col("doc_id").alias("plan_id"), kind.alias("question_type"), (F.col("n_chars") % 40 + 1).cast("int").alias("k"))
    t = plans_io.with_strategy(rows)
    return t.select("plan_id", "strategy", plans_io.depths(F.col("k"), F.col("evidence_mult"), F.col("record_mult"), F.col("turn_mult")).alias("x")).select("plan_id", "strategy", "x.*")
