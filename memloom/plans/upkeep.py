"""The driver's queries for stores, sessions, payloads and jobs, with equivalent SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scoring, temporal, text
from ..operators import evidence, ingest, projections, ranking, sessions, statistics, stores, vector_store, vectors
from ..sources import images, tables
from ..sources.batches import read_batches
from ..sources.shared import shared_place
from ..streaming import chunker, throttle
from .catalog import _BOUNDARIES, _L2QE, _TURNS, query
from .retrieval import _REC, _STOP


def _docs(spark, d) -> DataFrame:
    return tables.read(spark, d, "documents")


def _events(spark, d) -> DataFrame:
    return tables.read(spark, d, "events")


# ---- stores --------------------------------------------------------------------------------------------------


@query("""SELECT doc_id::VARCHAR AS record_id, 'record_id memory_type semantic_text normalized_text entities tags source_session source_role evidence_turn_range created_at expired' AS columns, 8 + (text IS NULL)::INTEGER AS n_null FROM documents""")
def store_schemas(spark, d):
    """Documents as records of an older schema: what the store's columns have beyond theirs is null."""
    old = _docs(spark, d).select(F.col("doc_id").cast("string").alias("record_id"), F.lit("fact").alias("memory_type"), F.col("text").alias("semantic_text"))
    t = stores.migrated(old, stores.SCHEMAS["records"])
    nulls = sum(F.col(c).isNull().cast("int") for c in t.columns)
    return t.select("record_id", F.lit(" ".join(t.columns)).alias("columns"), nulls.alias("n_null"))


@query("SELECT doc_id, text, lang, source FROM documents WHERE doc_id = 17")
def point_lookup(spark, d):
    return stores.point(_docs(spark, d), "doc_id", 17).select("doc_id", "text", "lang", "source")


@query("SELECT doc_id, source FROM documents WHERE lang = 'en' ORDER BY doc_id LIMIT 100000")
def scan_by_type(spark, d):
    return stores.scan(_docs(spark, d), "lang", "en", "doc_id", 100_000).select("doc_id", "source")


@query("""SELECT 'labels' AS "table", '{"doc_id":' || doc_id || ',"quality":' || quality || ',"toxic":' || toxic || '}' AS row FROM labels UNION ALL SELECT 'region', '{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}' FROM region""")
def export_all(spark, d):
    return stores.export({"labels": tables.read(spark, d, "labels").select("doc_id", "quality", "toxic"), "region": tables.read(spark, d, "region").select("r_regionkey", "r_name")})


@query("""SELECT 'labels' AS "table", count(*) AS deleted, 0::BIGINT AS left_over FROM labels UNION ALL SELECT 'pages', count(*), 0 FROM pages""")
def truncate_counts(spark, d):
    left, counts = stores.truncated({n: tables.read(spark, d, n) for n in ("labels", "pages")})
    rest = left["labels"].select(F.lit("labels").alias("table")).unionByName(left["pages"].select(F.lit("pages").alias("table"))).groupBy("table").agg(F.count(F.lit(1)).alias("left_over"))
    return counts.join(rest, "table", "left").select("table", "deleted", F.coalesce("left_over", F.lit(0)).alias("left_over"))


@query("SELECT DISTINCT conv_id || ':' || turn AS episode_id FROM conversations")
def episode_ids(spark, d):
    return tables.turns(spark, d).select(F.concat_ws(":", F.col("session_id").cast("string"), "turn_index").alias("episode_id")).distinct()


@query("""WITH s AS (SELECT user_id AS session_id, max(ts) FILTER (event_id % 3 <> 0) AS a, max(ts) FILTER (event_id % 3 = 0) AS b, count(*) AS n FROM events GROUP BY user_id)
    SELECT session_id, n, greatest(coalesce(a, b), coalesce(b, a)) AS updated_at FROM s""")
def append_turn_touch(spark, d):
    """A log of events grows by a third of them; each session's time moves on."""
    e = _events(spark, d).select("event_id", F.col("user_id").alias("session_id"), F.col("ts").alias("created_at"))
    old, new = e.filter("event_id % 3 <> 0"), e.filter("event_id % 3 = 0")
    log, meta = stores.append_turns(old, old.groupBy("session_id").agg(F.max("created_at").alias("updated_at")), new)
    return log.groupBy("session_id").agg(F.count(F.lit(1)).alias("n")).join(meta, "session_id").select("session_id", "n", "updated_at")


@query(f"WITH t AS ({_TURNS}) SELECT session_id, turn_index, role, content FROM t WHERE session_id = 5 ORDER BY turn_index")
def session_log(spark, d):
    return stores.point(tables.turns(spark, d), "session_id", 5).orderBy("turn_index").select("session_id", "turn_index", "role", "content")


@query(f"WITH t AS ({_TURNS}) SELECT session_id, max(turn_index)::INTEGER AS boundary_index, 'summary of ' || count(*) AS content FROM t GROUP BY session_id UNION ALL SELECT session_id, 1, 'first' FROM t WHERE turn_index = 0")
def summary_append(spark, d):
    """Summary rows appended to those that are there."""
    t = tables.turns(spark, d)
    old = t.filter("turn_index = 0").select("session_id", F.lit(1).alias("boundary_index"), F.lit("first").alias("content"))
    new = t.groupBy("session_id").agg(F.max("turn_index").alias("boundary_index"), F.concat(F.lit("summary of "), F.count(F.lit(1)).cast("string")).alias("content"))
    return old.unionByName(new)


@query("SELECT conv_id AS session_id, count(*) AS n FROM conversations WHERE conv_id NOT IN (3, 5) GROUP BY conv_id")
def session_delete(spark, d):
    """A session's rows go from the log."""
    t = tables.turns(spark, d)
    return stores.without(t, t.filter("session_id in (3, 5)"), "session_id").groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH t AS (SELECT 'turns' AS "table", conv_id FROM conversations UNION ALL SELECT DISTINCT 'session_meta', conv_id FROM conversations UNION ALL SELECT 'summaries', conv_id FROM conversations WHERE turn % 2 = 0)
    SELECT "table", count(*) FILTER (conv_id % 3 = 0) AS deleted, count(*) FILTER (conv_id % 3 <> 0) AS left_over, coalesce(sum(conv_id) FILTER (conv_id % 3 <> 0), 0)::BIGINT AS sessions FROM t GROUP BY 1""")
def session_delete_everywhere(spark, d):
    """Sessions go from the log, their meta rows and their summaries."""
    t = tables.turns(spark, d)
    every = {"turns": t, "session_meta": t.select("session_id").distinct(), "summaries": t.filter("turn_index % 2 = 0").select("session_id", "content")}
    left, counts = stores.delete_sessions(every, t.filter("session_id % 3 = 0"))
    rest = None
    for name, rows in left.items():
        part = rows.agg(F.count(F.lit(1)).alias("left_over"), F.coalesce(F.sum("session_id"), F.lit(0)).alias("sessions")).withColumn("table", F.lit(name))
        rest = part if rest is None else rest.unionByName(part)
    return counts.join(rest, "table").select("table", "deleted", "left_over", "sessions")


@query("""SELECT c_custkey AS session_id, CASE WHEN c_custkey % 3 = 0 THEN 'topic ' || c_nationkey ELSE c_name END AS topic, CASE WHEN c_custkey % 2 = 0 THEN [c_mktsegment, 'new'] ELSE [c_mktsegment] END AS tags FROM customer""")
def session_meta_update(spark, d):
    """Topics and tags change where a value is given."""
    c = tables.read(spark, d, "customer")
    meta = c.select(F.col("c_custkey").alias("session_id"), F.col("c_name").alias("topic"), F.array("c_mktsegment").alias("tags"))
    changes = c.filter("c_custkey % 2 = 0 or c_custkey % 3 = 0").select(F.col("c_custkey").alias("session_id"), F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("topic "), F.col("c_nationkey").cast("string"))).alias("topic"), F.when(F.col("c_custkey") % 2 == 0, F.array("c_mktsegment", F.lit("new"))).alias("tags"))
    return stores.update_meta(meta, changes)


@query("SELECT o_orderkey AS skill_id, o_orderdate AS created_at FROM orders WHERE o_orderstatus <> 'F' ORDER BY created_at DESC, skill_id LIMIT 50")
def skill_listing(spark, d):
    """Skills newest first, after some were deleted."""
    o = tables.read(spark, d, "orders").select(F.col("o_orderkey").alias("skill_id"), "o_orderstatus", F.col("o_orderdate").alias("created_at"))
    return stores.without(o, o.filter("o_orderstatus = 'F'"), "skill_id").orderBy(F.desc("created_at"), "skill_id").limit(50).select("skill_id", "created_at")


@query("""SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'my_session_1' ELSE 's-' || page_id END || '/' || substr(sha256(coalesce(html, '')), 1, 16) || '.' || ['png', 'jpg', 'webp', 'jpg'][page_id % 4 + 1] AS path FROM pages""")
def image_paths(spark, d):
    """Session folder, content hash and ending of each image."""
    i = F.col("page_id")
    mime = F.get(F.array(*[F.lit(m) for m in ("image/png", "image/jpeg", "IMAGE/WEBP", "image/unknown")]), (i % 4).cast("int"))
    session = F.when(i % 4 == 0, F.lit(" my session#1 ")).otherwise(F.concat(F.lit("s-"), i.cast("string")))
    return tables.read(spark, d, "pages").select("page_id", stores.image_path(session, text.image_hash(F.coalesce("html", F.lit(""))), mime).alias("path"))


@query("SELECT user_id, flush, count(*) AS n, min(event_id) AS first_id FROM (SELECT *, ((row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 10)::INTEGER AS flush FROM events) GROUP BY user_id, flush")
def buffered_flushes(spark, d):
    """Ten rows a buffer (S30), as with retrieval counts of twenty ids."""
    return stores.flushes(_events(spark, d), "user_id", "event_id", 10).groupBy("user_id", "flush").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))


@query("SELECT vec_id, label, vec_id IN (1, 2, 3) AS expired, CASE WHEN vec_id IN (1, 2, 3) THEN 'stale' END AS expired_reason FROM embeddings WHERE vec_id <> 4")
def visual_expiry(spark, d):
    """Rows expire with a reason; one is deleted."""
    e = tables.read(spark, d, "embeddings").select("vec_id", "label", F.lit(False).alias("expired"), F.lit(None).cast("string").alias("expired_reason"))
    return stores.without(stores.expire(e, "vec_id", [1, 2, 3], "stale"), e.filter("vec_id = 4"), "vec_id")


@query("SELECT event_type AS source, count(*) AS calls, sum(event_id % 100)::BIGINT AS tokens, round(sum(value), 4) AS latency, round(sum(value) / count(*), 6) AS mean_latency FROM events GROUP BY event_type")
def statistics_resume(spark, d):
    """Calls, tokens and latency by source, resumed from what was saved."""
    totals = lambda t: t.groupBy(F.col("event_type").alias("source")).agg(F.count(F.lit(1)).alias("calls"), F.sum(F.col("event_id") % 100).alias("tokens"), F.sum("value").alias("latency"))
    e = _events(spark, d)
    t = stores.merged_statistics(totals(e.filter("event_id % 2 = 0")), totals(e.filter("event_id % 2 = 1")), "source")
    return t.select("source", "calls", "tokens", F.round("latency", 4).alias("latency"), F.round("mean_latency", 6).alias("mean_latency"))


@query("SELECT event_id, user_id, event_type, round(value, 2) AS value FROM events WHERE event_type = 'error'")
def trace_sink(spark, d):
    """Trace rows written as JSON lines and read again."""
    place = f"{shared_place(spark)}/trace"
    _events(spark, d).filter("event_type = 'error'").select("event_id", "user_id", "event_type", F.round("value", 2).alias("value")).write.mode("append").json(place)
    return spark.read.schema("event_id long, user_id long, event_type string, value double").json(place)


@query("SELECT user_id, map_from_entries(list_sort(list((event_type, last)))) AS metadata FROM (SELECT user_id, event_type, arg_max(event_id, event_id)::VARCHAR AS last FROM events GROUP BY user_id, event_type) GROUP BY user_id")
def metadata_merge(spark, d):
    """Maps merged, the later value wins."""
    e = _events(spark, d).select("user_id", "event_id", F.create_map("event_type", F.col("event_id").cast("string")).alias("metadata"))
    return stores.merged_metadata(e, "user_id", "event_id", "metadata")


@query("""WITH j AS (SELECT user_id AS session_id, event_id // 10 AS job_id, event_type FROM events), l AS (SELECT session_id, max(job_id) AS job_id FROM j GROUP BY session_id),
    g AS (SELECT session_id, job_id, bool_or(event_type <> 'view') AS ended, max(CASE WHEN event_type = 'click' THEN 'nothing new' END) AS skipped, max(CASE WHEN event_type = 'error' THEN 'failed' END) AS error FROM j JOIN l USING (session_id, job_id) GROUP BY session_id, job_id)
    SELECT session_id, job_id, CASE WHEN NOT ended THEN 'pending' WHEN error IS NULL AND skipped IS NOT NULL THEN 'skipped' ELSE 'done' END AS status, CASE WHEN error IS NULL THEN skipped END AS skipped_reason, error FROM g""")
def consolidation_jobs(spark, d):
    e = _events(spark, d)
    t = e.select(F.col("user_id").alias("session_id"), F.floor(F.col("event_id") / 10).cast("bigint").alias("job_id"), (F.col("event_type") != "view").alias("ended"), F.when(F.col("event_type") == "click", "nothing new").alias("skipped_reason"), F.when(F.col("event_type") == "error", "failed").alias("error"))
    return stores.jobs(t)


@query(_BOUNDARIES.format(gap=36_000_000_000) + " SELECT event_id, user_id, generation FROM r WHERE n > 0")
def session_generations(spark, d):
    """Sessions rotate at accepted boundaries."""
    return throttle.boundaries(_events(spark, d), 36_000).select("event_id", "user_id", "generation")


@query("""SELECT session_id, turn_index FROM (SELECT conv_id AS session_id, turn::INTEGER AS turn_index, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations) WHERE CASE WHEN session_id % 2 = 0 THEN turn_index > last - 2 ELSE true END""")
def forced_ingest(spark, d):
    """Even sessions go on from their watermark, odd ones are ingested again from 0."""
    t = tables.turns(spark, d)
    offsets = t.groupBy("session_id").agg((F.max("turn_index") - 1).alias("watermark")).withColumn("watermark", F.when(F.col("session_id") % 2 == 0, F.col("watermark")).otherwise(F.lit(0)))
    return sessions.new_turns(t, offsets).select("session_id", "turn_index")


@query("""SELECT event_id, round(least(1, power(0.5::DOUBLE, (epoch_us(TIMESTAMP '2024-03-01') - epoch_us(ts)) / 3.6e9 / (168 * (1 + least(1, greatest(0, value / 100)) * (720.0::DOUBLE / 168 - 1))))), 4)::DOUBLE AS decay,
    row_number() OVER (ORDER BY ts, event_id)::INTEGER AS place FROM events WHERE event_id % 3 <> 0 AND round(least(1, power(0.5::DOUBLE, (epoch_us(TIMESTAMP '2024-03-01') - epoch_us(ts)) / 3.6e9 / (168 * (1 + least(1, greatest(0, value / 100)) * (720.0::DOUBLE / 168 - 1))))), 4) < 0.1""")
def forgetting_sweep(spark, d):
    """Every live row whose memory has faded, in the order in which the sweep forgets them."""
    rows = _events(spark, d).select("event_id", "ts", scoring.clamp(F.col("value") / 100).alias("importance"), F.lit(0).alias("retrievals"), (F.col("event_id") % 3 == 0).alias("expired"))
    return stores.faded(rows, "timestamp_ntz'2024-03-01 00:00:00'", "event_id", "ts").select("event_id", "decay", "place")


# ---- search beside the vectors -------------------------------------------------------------------------------


@query("""WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM documents), s AS (SELECT avg(len(w)) AS a, count(*) AS n FROM w),
    x AS (SELECT doc_id, len(w) AS l, unnest(w) AS word FROM w), q AS (SELECT * FROM (VALUES ('licen', false), ('licen', true), ('version', false), ('version', true)) v(t, p)),
    h AS (SELECT doc_id, l, t || CASE WHEN p THEN '*' ELSE '' END AS term, count(*) AS tf FROM x JOIN q ON CASE WHEN p THEN starts_with(word, t) ELSE word = t END GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM h GROUP BY term),
    b AS (SELECT doc_id AS id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / a))), 6) AS score FROM h JOIN f ON h.term = f.term, s GROUP BY doc_id)
    SELECT id, score FROM b ORDER BY score DESC, id LIMIT 20""")
def bm25_prefix(spark, d):
    """Full text with terms and their prefixes, from a query with quotes and stars."""
    return ranking.bm25(_docs(spark, d), ranking.query_terms('"Licen" version*'), 20, prefixes=True)


_FTS = """WITH w AS (SELECT {id} AS id, regexp_extract_all(lower({text}), '[a-z0-9]+') AS w FROM {table}), s AS (SELECT avg(len(w)) AS a, count(*) AS n FROM w), x AS (SELECT id, len(w) AS l, unnest(w) AS term FROM w),
    h AS (SELECT id, l, term, count(*) AS tf FROM x WHERE term IN ({terms}) GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM h GROUP BY term),
    b AS (SELECT id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / a))), 6) AS score FROM h JOIN f ON h.term = f.term, s GROUP BY id), t AS (SELECT * FROM b ORDER BY score DESC, id LIMIT {limit})"""


@query(_FTS.format(id="doc_id", text="coalesce(text, '')", table="documents", terms="'license', 'version'", limit=60) + ", k AS (SELECT id, score, source, lang FROM t JOIN documents ON doc_id = id WHERE lang IN ('en', 'fr') AND doc_id % 17 <> 0) SELECT * FROM k ORDER BY score DESC, id LIMIT 12")
def fulltext_records(spark, d):
    """Full-text hits with headroom, joined to their rows, of some types and not expired."""
    docs = _docs(spark, d)
    hits = ranking.bm25(docs, ["license", "version"], 60)
    rows = docs.filter(F.col("lang").isin("en", "fr") & (F.col("doc_id") % 17 != 0)).select(F.col("doc_id").alias("id"), "source", "lang")
    return hits.join(rows, "id").orderBy(F.desc("score"), "id").limit(12)


@query("SELECT item_id AS skill_id, 1.0::DOUBLE AS score FROM benchmark WHERE len(list_intersect(regexp_extract_all(lower(text), '[a-z0-9]+'), ['the', 'of'])) > 0 ORDER BY skill_id LIMIT 10")
def fulltext_skills(spark, d):
    """Skills that hold a term, all with the same score."""
    b = tables.read(spark, d, "benchmark")
    return ranking.holding(b, ["the", "of"]).select(F.col("item_id").alias("skill_id"), F.lit(1.0).alias("score")).orderBy("skill_id").limit(10)


@query(_FTS.format(id="'entity:' || source || ':' || doc_id", text="source || ' ' || coalesce(text, '')", table="documents", terms="'src3', 'license'", limit=10) + " SELECT id AS node_id, score FROM t")
def fulltext_nodes(spark, d):
    """Full text over evidence nodes' search texts."""
    n = _docs(spark, d).select(F.concat(F.lit("entity:"), "source", F.lit(":"), F.col("doc_id").cast("string")).alias("node_id"), F.concat("source", F.lit(" "), F.coalesce("text", F.lit(""))).alias("text"))
    return ranking.bm25(n, ["src3", "license"], 10, id_col="node_id").withColumnRenamed("id", "node_id")


@query(f"""WITH q AS (SELECT vec_id, min(vec_id) OVER (PARTITION BY lower(trim(word))) AS first_id, lower(trim(word)) AS key FROM (VALUES (3, ' When '), (4, 'when'), (5, 'Where'), (6, 'WHERE ')) v(vec_id, word)),
    h AS (SELECT DISTINCT q.key, e.vec_id AS id, {_L2QE.replace('q.embedding', 'v.embedding')} AS distance FROM q JOIN embeddings v ON v.vec_id = q.first_id JOIN embeddings e ON len(e.embedding) = len(v.embedding))
    SELECT key, id, distance FROM h QUALIFY row_number() OVER (PARTITION BY key ORDER BY distance, id) <= 5""")
def query_cache(spark, d):
    """Queries that differ in case and blanks alone are embedded and searched once."""
    e = tables.read(spark, d, "embeddings")
    q = spark.createDataFrame([(3, " When "), (4, "when"), (5, "Where"), (6, "WHERE ")], "vec_id long, word string").withColumn("query_id", text.casefold(F.trim("word")))
    first = q.groupBy("query_id").agg(F.min("vec_id").alias("vec_id"))
    hits = vectors.nearest(e, e.join(F.broadcast(first), "vec_id").select("query_id", F.col("embedding").alias("q")), 5)
    return hits.select(F.col("query_id").alias("key"), "id", "distance")


@query(f"""WITH h AS (SELECT e.vec_id AS id, {_L2QE} / 4 AS distance FROM embeddings e JOIN embeddings q ON q.vec_id = 9 AND len(q.embedding) = len(e.embedding)), r AS (SELECT *, row_number() OVER (ORDER BY distance, id) AS rank FROM h),
    v AS (SELECT doc_id, source, n_chars, doc_id % 7 = 0 AS expired FROM documents) SELECT id, round(distance, 6)::DOUBLE AS distance, source, rank::INTEGER AS rank FROM r JOIN v ON doc_id = id WHERE rank <= 30 AND NOT expired""")
def visual_hits(spark, d):
    """Hits with their rows, expired ones left out, in order."""
    e = tables.read(spark, d, "embeddings")
    q = e.filter("vec_id = 9").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    rows = _docs(spark, d).select(F.col("doc_id").alias("id"), "source", (F.col("doc_id") % 7 == 0).alias("expired"))
    return vectors.nearest(e, q, 30).join(rows, "id").filter("not expired").select("id", F.round(F.col("distance") / 4, 6).alias("distance"), "source", "rank")


@query(f"""WITH h AS (SELECT q.vec_id AS request, e.vec_id AS skill_id, {_L2QE} / 4 AS distance FROM embeddings e JOIN embeddings q ON q.vec_id IN (50, 51, 52) AND len(q.embedding) = len(e.embedding)), r AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY distance, skill_id) AS n FROM h),
    m AS (SELECT *, CASE request WHEN 50 THEN 'action' WHEN 51 THEN 'mixed' ELSE 'answer' END AS mode, 1 - distance AS score FROM r), g AS (SELECT *, score >= CASE WHEN mode = 'action' THEN 0.80 ELSE 0.85 END AS reusable FROM m WHERE n <= CASE mode WHEN 'action' THEN 3 WHEN 'mixed' THEN 2 ELSE 1 END),
    t AS (SELECT *, max(reusable::INTEGER) OVER (PARTITION BY request) AS any_one FROM g)
    SELECT request, mode, skill_id, round(score, 6)::DOUBLE AS score, reusable, row_number() OVER (PARTITION BY request ORDER BY score DESC, skill_id)::INTEGER AS place FROM t WHERE (reusable OR any_one = 0) QUALIFY place <= 2""")
def skill_selection(spark, d):
    """Skills by mode: how many, which may be used again, the two best."""
    e = tables.read(spark, d, "embeddings")
    q = e.filter("vec_id in (50, 51, 52)").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    mode = F.when(F.col("query_id") == 50, "action").when(F.col("query_id") == 51, "mixed").otherwise("answer")
    hits = vectors.nearest(e, q, 9).withColumn("mode", mode).filter(F.col("rank") <= projections.skill_gate(F.col("mode"), F.lit(True), F.lit(3)))
    hits = hits.select(F.col("query_id").alias("request"), "mode", F.col("id").alias("skill_id"), (1 - F.col("distance") / 4).alias("score"))
    t = projections.top_skills(hits.withColumn("reusable", projections.reusable(F.col("score"), F.col("mode"))))
    return t.select("request", "mode", "skill_id", F.round("score", 6).alias("score"), "reusable", "place")


@query("""SELECT doc_id AS request, CASE WHEN m IN ('answer', '') AND doc_id % 2 = 1 THEN 0 WHEN m IN ('answer', '') THEN 1 WHEN m = 'mixed' THEN greatest(1, k - 1) ELSE k END::INTEGER AS k FROM (SELECT doc_id, (n_chars % 5 + 1)::INTEGER AS k, ['answer', 'mixed', 'action', '', ''][doc_id % 5 + 1] AS m FROM documents WHERE n_chars IS NOT NULL)""")
def skill_gates(spark, d):
    """How many skills are fetched by mode; none for plain answers that ask for no procedure."""
    i = (F.col("doc_id") % 5).cast("int")
    mode = F.get(F.array(F.lit(" Answer "), F.lit("mixed"), F.lit("action"), F.lit(""), F.lit(None)), i)
    return _docs(spark, d).filter("n_chars is not null").select(F.col("doc_id").alias("request"), projections.skill_gate(mode, F.col("doc_id") % 2 == 0, (F.col("n_chars") % 5 + 1).cast("int")).alias("k"))


@query(f"""WITH {_REC} SELECT record_id, CASE record_id % 6 WHEN 1 THEN CASE WHEN role IN ('assistant', 'both') THEN 0.08 ELSE 0 END WHEN 2 THEN CASE WHEN memory_type IN ('preference', 'constraint', 'event') THEN 0.05 ELSE 0 END
    WHEN 4 THEN CASE WHEN t_start IS NOT NULL THEN 0.04 ELSE 0 END WHEN 3 THEN CASE WHEN memory_type = 'event' THEN 0.03 ELSE 0 END WHEN 5 THEN CASE WHEN memory_type = 'event' THEN 0.03 ELSE 0 END ELSE 0 END::DOUBLE AS bonus FROM rec""")
def record_bonuses(spark, d):
    """What each record gains by each type of question."""
    kind = F.get(F.array(*[F.lit(x) for x in ("default", "prior_assistant_response", "personalized_advice", "aggregate", "temporal", "comparison")]), (F.col("record_id") % 6).cast("int"))
    return tables.records(spark, d).select("record_id", scoring.record_bonus(kind, F.col("role"), F.col("memory_type"), F.col("t_start").isNotNull()).alias("bonus"))


@query(f"""WITH {_REC}, r AS (SELECT record_id, session_id, lo, hi, memory_type, source, lang, rec.text, created_at, lo // 4 AS frame FROM rec JOIN documents ON doc_id = record_id),
    n AS (SELECT *, row_number() OVER (PARTITION BY session_id, frame ORDER BY created_at, record_id) AS n FROM r)
    SELECT session_id || ':' || frame || ':' || min(lo) || '-' || max(hi) AS key, session_id, frame::INTEGER AS frame, min(lo) AS start_turn, max(hi) AS end_turn, count(*) AS n_records, list_sort(list_distinct(list(source) FILTER (source <> ''))) AS entities,
      list_sort(list_distinct(list_concat(list_concat(list(lang) FILTER (lang <> ''), ['fact']), list(memory_type)))) AS tags, list(text ORDER BY n) FILTER (n <= 12) AS texts FROM n GROUP BY session_id, frame""")
def record_frames(spark, d):
    """Records of a session whose first turns lie together, as event frames (A10)."""
    r = tables.records(spark, d).withColumns({"turns": F.sequence("lo", "hi"), "text": F.col("semantic_text")})
    return evidence.record_frames(r)


@query(f"""WITH {_REC} SELECT record_id, CASE WHEN record_id % 5 > 0 THEN lo END AS first, CASE WHEN record_id % 5 > 0 THEN hi END AS last FROM rec""")
def turn_bounds(spark, d):
    """First and last of records' turns, in any order; none for empty and missing lists."""
    i = F.col("record_id") % 5
    turns = F.when(i == 0, F.when(i % 2 == 0, F.array().cast("array<int>"))).otherwise(F.reverse(F.sequence("lo", "hi")))
    return tables.records(spark, d).select("record_id", projections.turn_bounds(turns).alias("x")).select("record_id", "x.*")


# ---- payloads and texts --------------------------------------------------------------------------------------


@query("""SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS k, CASE WHEN event_id % 3 = 0 THEN ['a', event_type] ELSE []::VARCHAR[] END AS tags, CASE WHEN event_id % 3 = 1 THEN 'x' ELSE '' END AS start FROM events""")
def json_lists(spark, d):
    """Lists and dicts from JSON columns; malformed ones are empty."""
    e = _events(spark, d)
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('["a", "'), "event_type", F.lit('"]'))).when(F.col("event_id") % 3 == 1, F.lit("{oops")).otherwise(F.lit(None))
    span = F.when(F.col("event_id") % 3 == 1, F.lit('{"start": "x"}')).otherwise(F.lit("[1]"))
    return e.select("event_id", F.coalesce(F.from_json("props", "k bigint")["k"], F.lit(0).cast("bigint")).alias("k"), F.coalesce(F.filter(F.from_json(raw, "array<string>"), lambda x: x.isNotNull()), F.array().cast("array<string>")).alias("tags"), F.coalesce(F.from_json(span, "start string")["start"], F.lit("")).alias("start"))


@query("SELECT doc_id, CASE WHEN length(text) > 260 THEN substr(text, 1, 260) || '...' ELSE text END AS preview FROM documents WHERE text IS NOT NULL")
def text_previews(spark, d):
    return _docs(spark, d).filter("text is not null").select("doc_id", projections.truncated(F.col("text"), 260).alias("preview"))


@query(f"""WITH t AS ({_TURNS}), s AS (SELECT *, CASE WHEN role = 'user' THEN 'Ann' ELSE '' END AS speaker, CASE WHEN turn_index = 0 AND role = 'user' THEN 'ANN:  ' || content ELSE content END AS c, row_number() OVER (PARTITION BY session_id ORDER BY turn_index) - 1 AS pos FROM t)
    SELECT session_id, string_agg('<TURN index=' || pos || ' role="' || role || '"' || CASE WHEN speaker <> '' THEN ' speaker="Ann"' ELSE '' END || '>' || chr(10) || trim(content, ' ') || chr(10) || '</TURN>', chr(10) ORDER BY pos) AS section FROM s GROUP BY session_id""")
def encoder_input(spark, d):
    """Sessions between turn markers; a leading name that the speaker has is taken off."""
    t = tables.turns(spark, d).withColumn("speaker", F.when(F.col("role") == "user", "Ann").otherwise(""))
    t = t.withColumn("content", F.when((F.col("turn_index") == 0) & (F.col("role") == "user"), F.concat(F.lit("ANN:  "), "content")).otherwise(F.col("content")))
    return projections.turn_markers(t)


@query(f"""WITH t AS ({_TURNS}), b AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn_index DESC) AS back FROM t),
    l AS (SELECT session_id, 0 AS kind, -i AS o, 'Summary: about ' || i AS line FROM (SELECT DISTINCT session_id FROM t), (SELECT unnest([1, 2]) AS i) UNION ALL SELECT session_id, 1, -back, role || ': ' || trim(content, ' ') FROM b WHERE back <= 6 AND trim(content, ' ') <> '')
    SELECT session_id, right(string_agg(line, chr(10) ORDER BY kind, o), 2000) AS context FROM l GROUP BY session_id""")
def recent_context(spark, d):
    """The last two of three summaries and the last six turns."""
    t = tables.turns(spark, d)
    s = t.select("session_id").distinct().withColumn("i", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).select("session_id", (4 - F.col("i")).alias("boundary_index"), F.concat(F.lit("about "), F.col("i").cast("string")).alias("content"))
    return projections.recent_context(t, s)


@query("""SELECT doc_id AS request, 'what next' AS current_subgoal, CASE WHEN doc_id % 2 = 0 THEN source ELSE '' END AS last_tool_name, CASE WHEN doc_id % 2 = 0 THEN substr(trim(coalesce(text, ''), ' '), 1, 500) ELSE '' END AS last_tool_result,
    ['a', 'b', 'c', 'd', 'e', 'f'] AS known_constraints, CASE WHEN doc_id % 2 = 0 THEN ['t1', 't2', 't3', source] ELSE ['t1', 't2', 't3'] END AS available_tools, (doc_id - 5) * (doc_id > 5)::INTEGER AS token_budget, substr(coalesce(text, ''), 1, 1000) AS recent_context_excerpt FROM documents""")
def action_states(spark, d):
    texts = lambda *x: F.array(*[F.lit(v) for v in x])
    calls = F.when(F.col("doc_id") % 2 == 0, F.array(F.struct(F.lit("first").alias("name"), F.lit("r").alias("result")), F.struct(F.col("source").alias("name"), F.col("text").alias("result")))).otherwise(F.array().cast("array<struct<name:string,result:string>>"))
    t = _docs(spark, d).select(F.col("doc_id").alias("request"), F.lit(" what next ").alias("query"), F.coalesce("text", F.lit("")).alias("recent_context"), (F.col("doc_id") - 5).alias("token_usage"), calls.alias("tool_calls"), F.lit("").alias("tentative_action"), texts(*"abcdefgh").alias("known_constraints"), texts("t1", "t2", "t3").alias("available_tools"), F.lit("").alias("failure_signal"))
    return projections.action_state(t).drop("tentative_action", "failure_signal")


@query("""SELECT doc_id AS request, CASE doc_id % 3 WHEN 0 THEN source || '；' || lang || '；first；second' WHEN 1 THEN source || '；' || lang ELSE source || '；first' END AS skill_query FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL""")
def skill_queries(spark, d):
    """Query, action and, unless only an answer is asked for, pragmatic queries as one text, each once."""
    i = F.col("doc_id") % 3
    rows = _docs(spark, d).filter("source is not null and lang is not null").select(
        F.col("doc_id").alias("request"), F.concat(F.lit(" "), "source", F.lit(" ")).alias("query"), F.when(i == 2, F.col("source")).otherwise(F.col("lang")).alias("action"), F.when(i == 0, "Action").when(i == 1, "answer").otherwise("mixed").alias("mode"),
        F.when(i == 2, F.array(F.lit(""), F.lit("first"))).otherwise(F.array(F.lit("first"), F.col("source"), F.lit(" second "), F.lit("first"))).alias("pragmatic"),
    )
    return rows.select("request", projections.skill_query(F.col("query"), F.col("action"), F.col("mode"), F.col("pragmatic")).alias("skill_query"))


@query(f"""WITH {_REC} SELECT record_id, concat_ws(chr(10), CASE WHEN trim(rec.text, ' ') <> '' THEN 'Text: ' || trim(rec.text, ' ') END, 'Source: record', 'Memory type: ' || memory_type, 'Source session: ' || session_id, 'Source dialogue time: ' || created_at, 'Matched channels: a | b',
    'Entities: ' || source, 'Tags: ' || lang || ', fact', 'Retrieval score: 0.5000') AS text FROM rec JOIN documents ON doc_id = record_id""")
def rerank_inputs(spark, d):
    """Records as a cross-encoder reads them (P25)."""
    r = tables.records(spark, d)
    shown = projections.rerank_text(F.col("semantic_text"), F.lit("record"), F.col("memory_type"), F.col("session_id").cast("string"), F.col("created_at"), F.array(F.lit("a"), F.lit(" b "), F.lit("A")), F.col("entities"), F.col("tags"), F.array().cast("array<string>"), F.lit(0.5))
    return r.select("record_id", shown.alias("text"))


@query("""WITH e AS (SELECT event_id AS id, event_id % 4 AS kind, (event_id % 7)::INTEGER AS n, (event_id % 10) / 10.0::DOUBLE AS x FROM events)
    SELECT id, n AS "index", x AS score FROM e WHERE kind = 0 UNION ALL SELECT id, 9, 0.5 FROM e WHERE kind = 0 UNION ALL SELECT id, n, x FROM e WHERE kind = 1 UNION ALL SELECT id, n, 7.0 FROM e WHERE kind = 2 UNION ALL SELECT id, -1, 0.0 FROM e WHERE kind = 2""")
def rerank_responses(spark, d):
    """Rerankers' answers for every event, under each of the names that they use, and malformed ones."""
    i, n, x = F.col("event_id") % 4, (F.col("event_id") % 7).cast("string"), ((F.col("event_id") % 10) / 10.0).cast("string")
    kinds = F.when(i == 0, F.concat(F.lit('{"data": [{"index": '), n, F.lit(', "relevance_score": '), x, F.lit('}, {"index": 9, "score": 0.5}]}'))).when(i == 1, F.concat(F.lit('[{"document_index": '), n, F.lit(', "relevance": '), x, F.lit("}]")))
    kinds = kinds.when(i == 2, F.concat(F.lit('{"rerank_results": [{"doc_index": '), n, F.lit(', "rerank_score": 7}, {}]}'))).otherwise(F.concat(F.lit("{oops "), n))
    return _events(spark, d).select(F.col("event_id").alias("id"), F.inline(projections.rerank_scores(kinds)))


@query("""SELECT doc_id AS id, CASE doc_id % 4 WHEN 0 THEN trim(text) WHEN 1 THEN '- ' || source || chr(10) || '- ' || lang WHEN 2 THEN source ELSE '' END AS text FROM documents WHERE trim(text) <> '' AND text NOT SIMILAR TO '[\\s].*|.*[\\s]' AND source IS NOT NULL AND lang IS NOT NULL""")
def memory_hit_texts(spark, d):
    """A hit's context, else its provenance, else its name, else nothing."""
    t = _docs(spark, d).filter(r"trim(text) <> '' and not text rlike '^\\s|\\s$' and source is not null and lang is not null")
    i = F.col("doc_id") % 4
    lines = F.when(i == 1, F.array(F.concat(F.lit(" "), "source"), F.lit(""), F.col("lang"))).otherwise(F.array().cast("array<string>"))
    return t.select(F.col("doc_id").alias("id"), projections.hit_text(F.when(i == 0, F.col("text")).when(i == 1, F.lit("")), lines, F.when(i < 3, F.col("source"))).alias("text"))


@query("""SELECT source AS request, string_agg(lang, chr(10) || chr(10) ORDER BY lang) AS context, (sum(n) + 2)::INTEGER AS total FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang) GROUP BY source""")
def background_parts(spark, d):
    """Distinct parts of a context, and the rows behind it."""
    t = _docs(spark, d).groupBy("source").agg(F.sort_array(F.collect_list("lang")).alias("texts"), F.count(F.lit(1)).cast("int").alias("n"))
    return t.select(F.col("source").alias("request"), projections.background(F.lit(""), F.col("texts")).alias("context"), projections.result_total(F.array(F.col("n")), F.lit(2)).alias("total"))


@query(f"""WITH t AS ({_TURNS}), u AS (SELECT session_id, max(turn_index) FILTER (role = 'user') AS last FROM t GROUP BY session_id)
    SELECT t.session_id, any_value(trim(CASE WHEN turn_index = last THEN content END, ' ')) AS message, coalesce(string_agg(role || ': ' || trim(content, ' '), chr(10) ORDER BY turn_index) FILTER (turn_index < last AND trim(content, ' ') <> ''), '') AS history FROM t JOIN u ON u.session_id = t.session_id WHERE last IS NOT NULL GROUP BY t.session_id""")
def chat_flattening(spark, d):
    """Chats as the last user message and the turns before it."""
    t = tables.turns(spark, d).groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("turn_index", "role", "content"))).alias("m"), F.max((F.col("role") == "user").cast("int")).alias("any")).filter("any = 1")
    return t.select("session_id", projections.last_message(F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))).alias("x")).select("session_id", "x.*")


@query("""SELECT conv_id AS session_id, turn::INTEGER AS turn_index, CASE WHEN turn % 3 = 0 THEN '/' || text ELSE trim(text, ' ') END AS content FROM conversations WHERE trim(coalesce(text, ''), ' ') <> '' AND NOT (turn % 3 = 0 AND role = 'user')""")
def normalized_turns(spark, d):
    """Turns without empty ones and users' commands."""
    t = tables.turns(spark, d).withColumn("content", F.when((F.col("turn_index") % 3 == 0) & (F.trim("content") != ""), F.concat(F.lit("/"), "content")).otherwise(F.col("content")))
    return t.select("session_id", "turn_index", projections.normalized_turn(F.col("role"), F.col("content")).alias("content")).filter("content is not null")


@query("SELECT event_id, list_sort(list_distinct(list_filter([event_id % 5, 3, event_id % 5, 9], lambda x: x < 6))) AS turns, CASE event_id % 3 WHEN 0 THEN false WHEN 1 THEN true ELSE true END AS consolidate FROM events".replace("list_distinct(list_filter([event_id % 5, 3, event_id % 5, 9], lambda x: x < 6))", "list_distinct(list_transform(list_filter([event_id % 5, 3, event_id % 5, 9], lambda x: x < 6), lambda x: x + 2))"))
def evidence_turn_bounds(spark, d):
    """Turn indices inside their section, made absolute (F15), and the flags' precedence (F16)."""
    e, k = _events(spark, d), F.col("event_id")
    turns = F.array(k % 5, F.lit(3).cast("bigint"), k % 5, F.lit(9).cast("bigint"), F.lit(-1).cast("bigint"))
    flag = projections.auto_consolidate(F.when(k % 3 == 0, F.lit(False)), F.when(k % 3 != 2, F.lit(True)))
    return e.select("event_id", projections.evidence_turns(turns, F.lit(2).cast("bigint"), F.lit(6).cast("bigint")).alias("turns"), flag.alias("consolidate"))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'key' WHEN 1 THEN 'session:s' || user_id WHEN 2 THEN 'conversation:' || event_type || ':c' WHEN 3 THEN 'channel:' || event_type END AS alias FROM events""")
def session_aliases(spark, d):
    k = F.col("event_id") % 5
    at = lambda n, c: F.when(k == n, c)
    alias = projections.session_alias(at(0, F.lit("key")), F.when(k <= 1, F.concat(F.lit("s"), F.col("user_id").cast("string"))), F.when((k == 2) | (k == 3), F.col("event_type")), at(2, F.lit("c")))
    return _events(spark, d).select("event_id", alias.alias("alias"))


@query("""WITH d AS (SELECT source, list(trim(coalesce(text, ''), ' ') ORDER BY doc_id) AS t FROM documents GROUP BY source), u AS (SELECT source, list_filter(t, lambda x, i: x <> '' AND list_position(t, x) = i) AS t FROM d)
    SELECT source, rtrim(substr(concat_ws(chr(10), 'Resolved references: ' || source, 'Recent same-session records:' || chr(10) || array_to_string(list_transform(t[-12:], lambda x: '- ' || x), chr(10))), 1, 2400), ' ') AS context FROM u""")
def reference_contexts(spark, d):
    """A source's last twelve distinct texts as reference for what follows."""
    t = projections.last_texts(_docs(spark, d).select("source", F.col("doc_id").alias("at"), "text"), "source")
    return t.select("source", projections.reference_context(F.col("source"), F.col("texts")).alias("context"))


@query("""SELECT doc_id AS id, CASE doc_id % 5 WHEN 2 THEN '' WHEN 4 THEN '' ELSE source END AS caption, CASE doc_id % 5 WHEN 0 THEN 'photo' WHEN 3 THEN 'chart' ELSE 'other' END AS scene_type, CASE doc_id % 5 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.5 WHEN 3 THEN (doc_id % 10) / 10.0 ELSE 0.3 END AS importance_score,
    CASE doc_id % 5 WHEN 0 THEN [lang] ELSE []::VARCHAR[] END AS entities FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL""")
def repaired_extractions(spark, d):
    """Models' JSON about every document: in a fence, between words, beyond repair, with Python's quotes, and empty."""
    i, s, lang = F.col("doc_id") % 5, F.col("source"), F.col("lang")
    answer = F.when(i == 0, F.concat(F.lit('Here:\n```json\n{"caption": "'), s, F.lit('", "scene_type": "photo", "importance_score": 3, "entities": ["'), lang, F.lit('"]}\n```'))).when(i == 1, F.concat(F.lit('I see {"caption": "'), s, F.lit('", "scene_type": "painting"} there')))
    answer = answer.when(i == 2, F.concat(F.lit("nothing about "), s)).when(i == 3, F.concat(F.lit("{'caption': '"), s, F.lit("', 'scene_type': 'chart', 'importance_score': "), ((F.col("doc_id") % 10) / 10.0).cast("string"), F.lit(", 'entities': None}"))).otherwise(F.lit(""))
    return _docs(spark, d).filter("source is not null and lang is not null").select(F.col("doc_id").alias("id"), projections.checked_extraction(answer).alias("x")).select("id", "x.*")


_TREE = f"""WITH RECURSIVE {_REC}, t AS ({_TURNS}), x AS (SELECT doc_id::VARCHAR AS item, lang, source, n_chars FROM documents WHERE coalesce(lang, '') <> 'fr'),
    s AS (SELECT DISTINCT set_id, item FROM (SELECT 'lang:' || lang AS set_id, item FROM x UNION ALL SELECT 'source:' || source, item FROM x UNION ALL SELECT 'both:' || lang || ':' || source, item FROM x UNION ALL SELECT 'long:' || lang || ':' || source, item FROM x WHERE n_chars > 2000) WHERE set_id IS NOT NULL),
    n AS (SELECT set_id, count(*) AS n FROM s GROUP BY 1), b AS (SELECT a.set_id AS child, c.set_id AS parent, count(*) AS shared FROM s a JOIN s c ON a.item = c.item AND a.set_id <> c.set_id GROUP BY 1, 2),
    p AS (SELECT child, parent FROM b JOIN n nc ON nc.set_id = child JOIN n np ON np.set_id = parent WHERE shared = nc.n AND np.n > nc.n QUALIFY row_number() OVER (PARTITION BY child ORDER BY np.n, parent) = 1),
    tree AS (SELECT set_id AS id, NULL::VARCHAR AS parent, 0 AS depth, set_id AS path FROM n WHERE set_id NOT IN (SELECT child FROM p) UNION ALL SELECT p.child, p.parent, depth + 1, path || '/' || p.child FROM tree JOIN p ON p.parent = tree.id),
    cov AS (SELECT DISTINCT p.parent AS set_id, item FROM p JOIN s ON s.set_id = p.child), d AS (SELECT set_id, item FROM s WHERE (set_id, item) NOT IN (SELECT (set_id, item) FROM cov)),
    held AS (SELECT item AS id, d.set_id AS parent, depth + 1 AS depth, path || '/' || item AS path FROM d JOIN tree ON tree.id = d.set_id UNION ALL SELECT record_id::VARCHAR, NULL, 0, record_id::VARCHAR FROM rec WHERE record_id::VARCHAR NOT IN (SELECT item FROM s)),
    e AS (SELECT record_id::VARCHAR AS record_id, 'episode:' || t.session_id || ':' || t.turn_index AS episode_id, t.role || ': ' || content AS name FROM rec r JOIN t ON t.session_id = r.session_id AND t.turn_index BETWEEN lo AND hi QUALIFY row_number() OVER (PARTITION BY t.session_id, t.turn_index ORDER BY r.created_at, record_id) = 1)
    SELECT id, 'composite' AS kind, parent, depth, path, id AS name FROM tree UNION ALL SELECT held.id, 'record', parent, depth, path, substr(text, 1, 120) FROM held JOIN rec ON record_id::VARCHAR = held.id
    UNION ALL SELECT episode_id, 'episode', held.id, depth + 1, path || '/' || episode_id, CASE WHEN length(name) > 120 THEN substr(name, 1, 120) || '...' ELSE name END FROM e JOIN held ON held.id = e.record_id"""


@query(_TREE)
def memory_tree(spark, d):
    """Composites, records and turns with depth and path: languages, sources, both, and their long texts as composites."""
    x = _docs(spark, d).filter("coalesce(lang, '') <> 'fr'")
    both = F.concat(F.col("lang"), F.lit(":"), F.col("source"))
    ids = F.array(F.concat(F.lit("lang:"), "lang"), F.concat(F.lit("source:"), "source"), F.concat(F.lit("both:"), both), F.when(F.col("n_chars") > 2000, F.concat(F.lit("long:"), both)))
    sets = x.select(F.explode(ids).alias("set_id"), F.col("doc_id").alias("item")).filter("set_id is not null").withColumn("name", F.col("set_id"))
    records = tables.records(spark, d).withColumn("name", F.substring("semantic_text", 1, 120))
    return evidence.memory_tree(sets, records, tables.turns(spark, d))


@query(f"""WITH {_REC}, t AS ({_TURNS}), e AS (SELECT record_id, t.session_id || ':' || t.turn_index AS episode_id, row_number() OVER (PARTITION BY t.session_id, t.turn_index ORDER BY r.created_at, record_id) AS rank, t.role || ': ' || content AS name FROM rec r JOIN t ON t.session_id = r.session_id AND t.turn_index BETWEEN lo AND hi)
    SELECT episode_id, count(*) AS grounded_record_count, max(record_id) FILTER (rank = 1) AS canonical_record_id, CASE WHEN length(any_value(name)) > 120 THEN substr(any_value(name), 1, 120) || '...' ELSE any_value(name) END AS name FROM e GROUP BY episode_id""")
def turn_grounding(spark, d):
    """Turns with the records that rest on them."""
    return projections.grounding(tables.records(spark, d), tables.turns(spark, d))[1]


@query("""SELECT conv_id AS session_id, count(*)::BIGINT AS turn_count, coalesce(CASE WHEN conv_id % 2 = 0 THEN 'topic ' || conv_id END, substr(min_by(text, turn) FILTER (role = 'user'), 1, 40)) AS title, CASE WHEN conv_id % 2 = 0 THEN ['x'] END AS tags FROM conversations GROUP BY conv_id""")
def session_listing(spark, d):
    """Sessions with their topic, where they have one."""
    t = tables.turns(spark, d)
    meta = t.select("session_id").distinct().filter("session_id % 2 = 0").select("session_id", F.concat(F.lit("topic "), F.col("session_id").cast("string")).alias("topic"), F.array(F.lit("x")).alias("tags"))
    return projections.listing(t, meta).select("session_id", "turn_count", "title", "tags")


_WORDS = "|".join(text.SIGNAL_WORDS)
_TERMS = "|".join(text.SIGNAL_TERMS)


@query(f"""WITH t AS (SELECT doc_id, coalesce(text, '') || CASE doc_id % 6 WHEN 0 THEN ' Keep in MIND' WHEN 1 THEN ' premust' WHEN 2 THEN '必须' WHEN 3 THEN ' workflows' ELSE '' END AS t FROM documents)
    SELECT doc_id, regexp_matches(t, '(^|[^A-Za-z0-9_])(?i:{_WORDS})([^A-Za-z0-9_]|$)') OR regexp_matches(t, '{_TERMS}') AS signal, list_sort(list_filter(list_distinct(regexp_extract_all(lower(t), '[a-z0-9_]{{3,}}')), lambda w: NOT list_contains({_STOP}, w))) AS terms FROM t""")
def signals_and_terms(spark, d):
    """Long-term signals (F12) and query terms (G12) of whole texts."""
    k = F.col("doc_id") % 6
    t = F.concat(F.coalesce("text", F.lit("")), F.when(k == 0, " Keep in MIND").when(k == 1, " premust").when(k == 2, "必须").when(k == 3, " workflows").otherwise(""))
    return _docs(spark, d).select("doc_id", text.long_term_signal(t).alias("signal"), F.sort_array(text.query_terms(t)).alias("terms"))


@query("""SELECT event_id, strftime(ts, '%Y-%m-%d') AS label, strftime(ts, '%H:%M') || '+05' AS clock, event_id % 4 <> 0 AS in_range FROM (SELECT event_id, ts FROM events)""")
def time_labels(spark, d):
    """Labels of times (P8), reference times (G21), and points in ranges with open ends."""
    e, k = _events(spark, d), F.col("event_id") % 4
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS")
    day = F.date_format("ts", "yyyy-MM-dd")
    inside = temporal.in_range(day, F.when(k == 0, F.lit("2099-01-01")).when(k == 1, day), F.when(k == 2, F.lit("2099-01-01")).otherwise(F.lit("")))
    clock = temporal.time_label(F.concat(F.date_format("ts", "HH:mm"), F.lit(".123+05")))
    return e.select("event_id", temporal.time_label(stamp).alias("label"), F.regexp_replace(clock, r"\.123", "").alias("clock"), inside.alias("in_range"))


@query("""SELECT event_id AS id, CASE event_id % 5 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('minute', ts) WHEN 2 THEN date_trunc('day', ts) WHEN 3 THEN date_trunc('second', ts) - INTERVAL 2 HOUR END AS moment FROM events""")
def reference_times(spark, d):
    """Events' times in each form that is read, with an offset too, and one that is not."""
    i = F.col("event_id") % 5
    form = lambda f: F.date_format("ts", f)
    t = F.when(i == 0, form("yyyy-MM-dd'T'HH:mm:ss")).when(i == 1, form("yyyy/MM/dd HH:mm")).when(i == 2, form("yyyy-MM-dd")).when(i == 3, F.concat(form("yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00"))).otherwise(F.concat(F.lit("soon "), form("yyyy")))
    moment = temporal.reference_time(t)
    return _events(spark, d).select(F.col("event_id").alias("id"), F.to_timestamp_ntz(F.date_format(F.to_utc_timestamp(moment, F.current_timezone()), "yyyy-MM-dd HH:mm:ss"), F.lit("yyyy-MM-dd HH:mm:ss")).alias("moment"))


@query("""SELECT event_id, 'Current time basis (for resolving relative time expressions):' || chr(10) || '- Current local date: ' || strftime(ts, '%Y-%m-%d') || chr(10) || '- Current UTC time: ' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' || chr(10) AS basis FROM events""")
def time_basis(spark, d):
    """What relative dates are reckoned from."""
    return _events(spark, d).select("event_id", temporal.time_basis(F.col("ts")).alias("basis"))


@query("""SELECT page_id AS id, CASE WHEN page_id % 3 < 2 THEN CASE page_id % 3 WHEN 0 THEN 'image/png' ELSE 'image/webp' END END AS mime, CASE WHEN page_id % 3 < 2 THEN sha256(coalesce(html, '')) END AS base64 FROM pages""")
def data_urls(spark, d):
    """Pages' hashes in data URLs of two kinds, and plain URLs."""
    i, body = F.col("page_id") % 3, F.sha2(F.coalesce("html", F.lit("")), 256)
    url = F.when(i == 0, F.concat(F.lit("data:image/png;base64,"), body)).when(i == 1, F.concat(F.lit("data:image/webp;base64,"), body)).otherwise(F.col("url"))
    return tables.read(spark, d, "pages").select(F.col("page_id").alias("id"), text.data_url(url).alias("x")).select("id", "x.*")


@query("""SELECT doc_id, 'type: entity' || chr(10) || 'entity: ' || source || CASE WHEN text <> '' THEN chr(10) || 'text: ' || text ELSE '' END AS search_text FROM (SELECT doc_id, source, coalesce(text, '') AS text FROM documents)""")
def node_search_texts(spark, d):
    return _docs(spark, d).select("doc_id", text.search_text("entity", entity=F.col("source"), text=F.col("text")).alias("search_text"))


@query("""SELECT 'memories' AS what, count(*) AS n FROM documents UNION ALL SELECT 'turns', count(*) FROM conversations UNION ALL SELECT 'vectors', count(*) FROM embeddings UNION ALL SELECT 'sessions', count(DISTINCT conv_id) FROM conversations""")
def pipeline_status(spark, d):
    """Counts of what the stores hold."""
    count = lambda t, what: t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "n")
    turns = tables.turns(spark, d)
    return count(_docs(spark, d), "memories").unionByName(count(turns, "turns")).unionByName(count(tables.read(spark, d, "embeddings"), "vectors")).unionByName(count(turns.select("session_id").distinct(), "sessions"))


# ---- ingest --------------------------------------------------------------------------------------------------

_NEW = "t AS (SELECT conv_id AS session_id, turn::INTEGER AS turn_index, role, trim(coalesce(text, ''), ' ') AS content FROM conversations WHERE turn >= CASE WHEN conv_id % 2 = 0 THEN 2 ELSE 0 END)"
_MADE = f"{_NEW}, m AS (SELECT sha256(content) AS record_id, content, session_id, turn_index, role, row_number() OVER (PARTITION BY content ORDER BY session_id DESC, turn_index DESC) AS r FROM t WHERE role <> 'system' AND content <> '' AND NOT (role = 'user' AND content LIKE '/%')), o AS (SELECT * FROM m WHERE r = 1)"
_KIND = f"CASE WHEN regexp_matches(content, '(^|[^A-Za-z0-9_])(?i:{_WORDS})([^A-Za-z0-9_]|$)') OR regexp_matches(content, '{_TERMS}') THEN 'preference' ELSE 'fact' END"


def _ingested(spark, d) -> ingest.Ingested:
    t = tables.turns(spark, d)
    return ingest.ingest(t, t.filter("session_id % 2 = 0").select("session_id", F.lit(2).alias("watermark")).distinct())


@query(f"WITH {_MADE} SELECT record_id, {_KIND} AS memory_type, {_KIND} || ': ' || content AS normalized_text, session_id, [turn_index] AS evidence_turns FROM o")
def ingest_records(spark, d):
    """Records of the turns after each session's watermark: checked, one a text."""
    return _ingested(spark, d).records.select("record_id", "memory_type", "normalized_text", "session_id", "evidence_turns")


@query(f"WITH {_MADE} SELECT 'entity' AS node_type, 'session ' || session_id AS key, record_id FROM o UNION ALL SELECT 'tag', role, record_id FROM o UNION ALL SELECT 'tag', {_KIND}, record_id FROM o")
def ingest_evidence(spark, d):
    return _ingested(spark, d).nodes


@query(f"WITH {_NEW} SELECT session_id, max(turn_index + 1)::INTEGER AS watermark FROM (SELECT session_id, turn_index FROM t UNION ALL SELECT conv_id, 1 FROM conversations WHERE conv_id % 2 = 0) GROUP BY session_id")
def ingest_watermarks(spark, d):
    return _ingested(spark, d).watermarks


_ALL = f"t AS (SELECT conv_id AS session_id, turn::INTEGER AS turn_index, role, trim(coalesce(text, ''), ' ') AS content FROM conversations), m AS (SELECT sha256(content) AS record_id, content, session_id, turn_index, role, row_number() OVER (PARTITION BY content ORDER BY session_id DESC, turn_index DESC) AS r FROM t WHERE role <> 'system' AND content <> '' AND NOT (role = 'user' AND content LIKE '/%')), o AS (SELECT * FROM m WHERE r = 1)"


def _stream_ingested(spark, d) -> tuple[ingest.Ingested, str]:
    place = shared_place(spark)
    ingest.ingest_stream(chunker.turn_stream(spark, f"{d}/conversations.parquet"), place, idle=None)
    return ingest.ingested(spark, place), place


@query("""SELECT DISTINCT 's-' || page_id % 40 || '/' || substr(sha256(coalesce(html, '')), 1, 16) || '.png' AS image_path, strlen(coalesce(html, ''))::BIGINT AS length, sha256(coalesce(html, '')) AS sha FROM pages WHERE html <> ''""")
def image_files(spark, d):
    """Pages' bytes written as image files, twice, and read back."""
    place, content = shared_place(spark), F.coalesce("html", F.lit(""))
    path = stores.image_path(F.concat(F.lit("s-"), (F.col("page_id") % 40).cast("string")), text.image_hash(content), F.lit("image/png"))
    found = tables.read(spark, d, "pages").select(path.alias("image_path"), content.cast("binary").alias("content"))
    images.write_images(found, place)
    images.write_images(found, place)
    return images.read_images(spark, place).select("image_path", "length", F.sha2("content", 256).alias("sha"))


@query("SELECT vec_id AS id, 64 AS width, round((CASE WHEN vec_id % 2 = 0 THEN -embedding[1] ELSE embedding[1] END)::DOUBLE, 5) AS first FROM embeddings WHERE vec_id % 3 <> 0 OR vec_id % 2 = 0")
def vector_upserts(spark, d):
    """Vectors replaced in the folders that they fall into, in a table that was rebuilt for their width."""
    e, place = tables.read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), shared_place(spark)
    vector_store.opened(spark, place, 32)
    vector_store.opened(spark, place, 64)
    vector_store.upsert(e.filter("id % 3 <> 0"), place)
    vector_store.upsert(e.filter("id % 2 = 0").withColumn("vector", F.transform("vector", lambda x: -x)), place)
    return vector_store.rows(spark, place).select("id", F.size("vector").alias("width"), F.round(F.get("vector", F.lit(0)).cast("double"), 5).alias("first"))


@query("SELECT event_type AS source, count(*) AS calls, sum(event_id % 100)::BIGINT AS tokens, round(sum(value), 4) AS latency, round(sum(value) / count(*), 6) AS mean_latency FROM events GROUP BY event_type")
def statistics_observed(spark, d):
    """The same totals, counted on the way of two writes and resumed from a file."""
    place, kinds = shared_place(spark), ("view", "click", "signup", "error", "purchase")
    for half in (0, 1):
        rows, seen = statistics.observed(_events(spark, d).filter(F.col("event_id") % 2 == half), kinds, F.col("event_type"), F.col("event_id") % 100, F.col("value"))
        rows.write.parquet(f"{place}/trace-{half}")
        statistics.save(spark, f"{place}/usage.json", statistics.totals(seen, kinds))
    return statistics.table(spark, f"{place}/usage.json").select("source", "calls", "tokens", F.round("latency", 4).alias("latency"), F.round("mean_latency", 6).alias("mean_latency"))


@query(f"WITH {_ALL} SELECT record_id, {_KIND} AS memory_type, {_KIND} || ': ' || content AS normalized_text, session_id, [turn_index] AS evidence_turns, 64 AS width, 64 AS normalized_width FROM o")
def ingest_stream_records(spark, d):
    """Records and their vectors from a stream of turns, written by batches."""
    found, place = _stream_ingested(spark, d)
    width = read_batches(spark, place, "vectors", "record_id string, memory_type string, vector array<double>, normalized_vector array<double>", "watermarks")
    width = width.select("record_id", F.size("vector").alias("width"), F.size("normalized_vector").alias("normalized_width"))
    return found.records.join(width, "record_id").select("record_id", "memory_type", "normalized_text", "session_id", "evidence_turns", "width", "normalized_width")


@query(f"WITH {_ALL}, n AS (SELECT session_id, max(turn_index + 1)::INTEGER AS watermark, min(turn_index)::INTEGER AS first_turn FROM t WHERE trim(content) <> '' GROUP BY session_id), e AS (SELECT key, count(DISTINCT record_id)::BIGINT AS n_records FROM (SELECT 'session ' || session_id AS key, record_id FROM o) GROUP BY key) SELECT session_id, watermark, first_turn, watermark - 1 AS last_turn, coalesce(n_records, 0)::BIGINT AS n_records FROM n LEFT JOIN e ON key = 'session ' || session_id")
def ingest_stream_sessions(spark, d):
    """Watermarks, the turns that stored chunks reach from and to, and evidence of each session."""
    found, _ = _stream_ingested(spark, d)
    reach = found.chunks.groupBy("session_id").agg(F.min("start_turn").alias("first_turn"), F.max("end_turn").alias("last_turn"))
    own = found.nodes.filter("node_type = 'entity'").groupBy("key").agg(F.count(F.lit(1)).alias("n_records"))
    t = found.watermarks.join(reach, "session_id").withColumn("key", F.concat(F.lit("session "), F.col("session_id").cast("string"))).join(own, "key", "left")
    return t.select("session_id", "watermark", "first_turn", "last_turn", F.coalesce("n_records", F.lit(0)).alias("n_records"))


@query("""WITH i AS (SELECT page_id % 40 AS session_id, substr(sha256(coalesce(html, '')), 1, 16) AS image_hash, min(CASE WHEN page_id % 3 = 0 THEN 'image/png' ELSE 'image/webp' END) AS mime FROM pages GROUP BY 1, 2), o AS (SELECT DISTINCT page_id % 40 AS session_id, substr(sha256(coalesce(html, '')), 1, 16) AS image_hash FROM pages WHERE page_id % 5 = 1)
    SELECT substr(sha256(session_id || ':' || image_hash), 1, 32) AS record_id, session_id, session_id || '/' || image_hash || CASE mime WHEN 'image/png' THEN '.png' ELSE '.webp' END AS image_path, 'other' AS scene_type, 0.3::DOUBLE AS importance_score FROM i WHERE (session_id, image_hash) NOT IN (SELECT (session_id, image_hash) FROM o)""")
def image_ingest(spark, d):
    """Pages stand for images: hashed, placed, with defaults for what no model told; known ones are skipped."""
    p = tables.read(spark, d, "pages").select((F.col("page_id") % 40).alias("session_id"), "page_id", F.coalesce("html", F.lit("")).alias("content"), F.when(F.col("page_id") % 3 == 0, "image/png").otherwise("image/webp").alias("mime"), F.lit("no answer").alias("answer"))
    old = p.filter("page_id % 5 = 1").select("session_id", text.image_hash(F.col("content")).alias("image_hash"), F.lit(False).alias("expired"))
    return ingest.ingest_images(p, old).select("record_id", "session_id", "image_path", "scene_type", "importance_score")


@query("""SELECT doc_id AS id, CASE doc_id % 3 WHEN 0 THEN 'action' ELSE 'answer' END AS mode, CASE doc_id % 3 WHEN 0 THEN 'aggregate' WHEN 1 THEN 'single' ELSE 'temporal' END AS question_type, doc_id % 3 = 0 AS is_aggregate_query, CASE doc_id % 3 WHEN 0 THEN [source] WHEN 1 THEN []::VARCHAR[] ELSE ['q ' || lang] END AS semantic_queries,
    CASE doc_id % 3 WHEN 1 THEN source ELSE lang END AS evidence_target, CASE doc_id % 3 WHEN 0 THEN ['alive'] WHEN 1 THEN []::VARCHAR[] ELSE ['c' || lang] END AS evidence_constraints FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL""")
def plan_normalization(spark, d):
    """Planners' answers with the older names, beyond repair, and with the newer ones."""
    i, s, lang = F.col("doc_id") % 3, F.col("source"), F.col("lang")
    plan = F.when(i == 0, F.concat(F.lit('{"mode": "action", "question_type": "aggregate", "aggregate_target": "'), lang, F.lit('", "aggregate_constraints": ["alive", " "]}'))).when(i == 1, F.concat(F.lit("{oops "), s))
    plan = plan.otherwise(F.concat(F.lit('{"question_type": "temporal", "semantic_queries": ["q '), lang, F.lit('", ""], "evidence_target": "'), lang, F.lit('", "evidence_constraints": ["c'), lang, F.lit('"]}')))
    x = _docs(spark, d).filter("source is not null and lang is not null").select(F.col("doc_id").alias("id"), projections.normalized_plan(plan, s).alias("x"))
    return x.select("id", *[F.col(f"x.{c}").alias(c) for c in ("mode", "question_type", "is_aggregate_query", "semantic_queries", "evidence_target", "evidence_constraints")])


@query("""SELECT source AS request, CASE WHEN source < 'src1' THEN 'minimal' WHEN source < 'src2' THEN 'compact' ELSE 'full' END AS level, source AS context, CASE WHEN source >= 'src2' THEN list_sort(list(doc_id)) ELSE [] END AS provenance, CASE WHEN source >= 'src2' THEN ['s'] ELSE [] END AS skills,
    CASE WHEN source >= 'src1' THEN (count(*) + 1)::INTEGER END AS total FROM documents GROUP BY source""")
def response_trimming(spark, d):
    t = _docs(spark, d).groupBy(F.col("source").alias("request")).agg(F.sort_array(F.collect_list("doc_id")).alias("provenance")).withColumns({"context": F.col("request"), "skills": F.array(F.lit("s"))})
    return projections.trimmed_response(t, F.when(F.col("request") < "src1", "minimal").when(F.col("request") < "src2", "compact").otherwise("full"))


@query("""WITH h AS (SELECT source AS request, doc_id AS id, n_chars AS score, lang, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS place FROM documents) SELECT request, string_agg('[' || place || '] (' || lang || ') doc ' || id, chr(10) ORDER BY place) AS context FROM h WHERE place <= 3 GROUP BY request""")
def visual_contexts(spark, d):
    t = _docs(spark, d).select(F.col("source").alias("request"), F.col("doc_id").alias("id"), F.col("n_chars").alias("score"), F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("caption"), F.col("lang").alias("scene_type"))
    return projections.visual_context(t)


@query("SELECT conv_id AS session_id, count(*) AS prompt_tokens, count(*) FILTER (role = 'assistant') AS completion_tokens, count(*) + count(*) FILTER (role = 'assistant') AS total_tokens FROM conversations GROUP BY conv_id")
def chat_usage(spark, d):
    t = tables.turns(spark, d).groupBy("session_id").agg(F.count(F.lit(1)).alias("p"), F.count_if(F.col("role") == "assistant").alias("a"))
    return t.select("session_id", projections.token_usage(F.col("p"), F.col("a")).alias("u")).select("session_id", "u.*")
