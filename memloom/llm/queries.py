"""Driver queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, collocations, html, jaccard, linededup, mixing, negatives, packing, quality, secrets, substring, topk, warc


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "labels")).drop("row")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_runs(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.dedup_substrings(_read(spark, sf_dir, "documents"), with_text=False)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_read(spark, sf_dir, "pages"))


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents arrive as two batches; the second is scanned against the ledger that the first has left."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    late = F.pmod(F.xxhash64("doc_id", "text"), F.lit(2)) == 1
    first, ledger = secrets.scan(docs.filter(~late))
    second, _ = secrets.scan(docs.filter(late), ledger=ledger)
    return secrets.digest_columns(first.unionByName(second))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.with_first_position(mixing.document_plan(_read(spark, sf_dir, "documents")))
    plan = plan.select("doc_id", "size", "source_size", "target", "taken", "position")
    return plan.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(_read(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write_archives(_read(spark, sf_dir, "pages"))
    return warc.read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = _read(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), "embedding")
    return negatives.mine(rows, F.col("vec_id") % 50 == 0)


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe.decode(bpe.encode(_read(spark, sf_dir, "documents")))
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collocations.top(collocations.collocations(_read(spark, sf_dir, "documents")))
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_line_dedup": op2_line_dedup,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_html_extraction": op4_html_extraction,
    "op5_secret_scans": op5_secret_scans,
    "op6_packing": op6_packing,
    "op7_mixing": op7_mixing,
    "op8_exact_top_k": op8_exact_top_k,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_warc": op10_warc,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_collocations": op13_collocations,
}

def _secret_sql() -> str:
    """One query a rule: matches placed by the lengths of the texts between them."""
    each = []
    for rank, r in enumerate(secrets.RULES):
        p = r.pattern.replace("'", "''")
        size = f"length(regexp_extract(m[i], '{p}', {r.group}))" if r.group else "length(m[i])"
        each.append(f"""
            SELECT doc_id, {rank} AS rank, '{r.kind}' AS kind, start, start + n AS stop FROM (
                SELECT doc_id, {size} AS gauge, length(m[i]) AS n,
                       list_sum(list_transform(gaps[1:i], lambda g: length(g)))::BIGINT
                       + coalesce(list_sum(list_transform(m[1:i-1], lambda g: length(g))), 0)::BIGINT AS start
                FROM (SELECT doc_id, m, gaps, unnest(range(1, len(m) + 1)) AS i FROM (
                    SELECT doc_id, regexp_extract_all(text, '{p}', 0) AS m, string_split_regex(text, '{p}') AS gaps
                    FROM documents WHERE text IS NOT NULL)))
            WHERE gauge >= {r.least}""")
    shown = "kind || ':' || start || ':' || stop"
    return f"""
        WITH found AS ({" UNION ALL ".join(each)}),
        grouped AS (
            SELECT doc_id, string_agg({shown}, ',' ORDER BY start, rank) AS spans,
                   string_agg({shown}, ',' ORDER BY start, rank) FILTER (rank < 3) AS base,
                   count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
                   count(*) FILTER (kind = 'hex') AS n_hex
            FROM found GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access,
               coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM documents d LEFT JOIN grouped g ON d.doc_id = g.doc_id"""


_MIX_SQL = """
    WITH sized AS (
        SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
               md5(coalesce(doc_id::VARCHAR, '') || chr(10) || coalesce(text, '')) AS spot FROM documents),
    by_source AS (
        SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place
        FROM sized GROUP BY source),
    weighed AS (
        SELECT source, source_size, [5, 2, 1][place % 3 + 1] AS weight, [0.5::DOUBLE, 0, -0.5][place % 3 + 1] AS slope,
               3 * source_size AS most, (3 * source_size)::DOUBLE / [5, 2, 1][place % 3 + 1] AS ratio FROM by_source),
    levels AS (
        SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY ratio, source NULLS LAST
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
                  / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
        FROM weighed),
    targets AS (
        SELECT source, source_size, slope, least(most::DOUBLE, (SELECT level FROM levels WHERE level <= ratio
               ORDER BY ratio, source NULLS LAST LIMIT 1) * weight) AS target FROM levels),
    placed AS (
        SELECT d.*, t.source_size, t.target, t.slope,
               coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY spot, doc_id, size
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead,
               CASE WHEN source_size > 0 THEN floor(round(target)::BIGINT / source_size)::BIGINT ELSE 0 END AS passes
        FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
    ended AS (
        SELECT *, greatest(0, least(size, round(target)::BIGINT - passes * source_size - ahead))::BIGINT AS last FROM placed),
    middles AS (
        SELECT *, (passes * size + last)::BIGINT AS taken,
               least(1.0::DOUBLE, (ahead + CASE WHEN passes > 0 THEN size ELSE last END / 2.0::DOUBLE) / target) AS share FROM ended)
    SELECT doc_id, size, source_size, target, taken,
           CASE WHEN taken > 0 THEN round(CASE WHEN slope = 0 THEN share
                ELSE (sqrt((1 - slope) * (1 - slope) + 4 * slope * share) - (1 - slope)) / (2 * slope) END, 9) END AS position
    FROM middles"""

_TOP_SQL = """
    WITH v AS (
        SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
    scored AS (
        SELECT q.vec_id AS query_id, x.vec_id,
               list_sum(list_transform(list_zip(q.v, x.v), lambda p: p[1] * p[2]))::BIGINT AS score
        FROM v q JOIN v x ON q.vec_id <> x.vec_id AND len(q.v) = len(x.v) WHERE q.vec_id % 50 = 0),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
    SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5"""

_WARC_SQL = """
    WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
    d AS (SELECT page_id, html, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS hex,
                 max(page_id) OVER (PARTITION BY html) AS top FROM p)
    SELECT page_id, payload_bytes,
           array_to_string(list_transform(range(32), lambda i:
               substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, 1 + 5 * (i // 4), 5))::BIGINT
                      >> (15 - 5 * (i % 4))::INTEGER) & 31)::INTEGER, 1)), '') AS payload_digest,
           CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
    FROM d"""

_NEGATIVES_SQL = """
    WITH v AS (
        SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
               list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
        FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
              AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
    scored AS (
        SELECT q.vec_id AS anchor_id, x.vec_id, q.label = x.label AS same,
               list_sum(list_transform(list_zip(q.v, x.v), lambda p: p[1] * p[2]))::BIGINT AS score
        FROM v q JOIN v x ON q.vec_id <> x.vec_id AND len(q.v) = len(x.v) WHERE q.vec_id % 50 = 0),
    positives AS (
        SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
    SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
           vec_id AS negative_id, positive_score, score AS negative_score
    FROM positives JOIN scored USING (anchor_id)
    WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
    QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 3"""

_PHRASES_SQL = r"""
    WITH pieces AS (
        SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents),
    words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
    totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
    grams AS (
        SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
        FROM words, (SELECT unnest([1, 2, 3, 4]) AS k)),
    counted AS (SELECT lang, k, phrase, count(*)::BIGINT AS f FROM grams GROUP BY ALL HAVING count(*) >= 30),
    cuts AS (
        SELECT lang, phrase, k, f, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS cut FROM counted WHERE k > 1),
    best AS (
        SELECT c.lang, c.phrase, c.f AS a, h.f AS l, t.f AS r, (2000000::HUGEINT * c.f // (h.f + t.f))::BIGINT AS score
        FROM cuts c JOIN counted h ON h.lang = c.lang AND h.phrase = array_to_string(w[1:cut], ' ')
             JOIN counted t ON t.lang = c.lang AND t.phrase = array_to_string(w[cut + 1:], ' ')
        QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, cut) = 1),
    held AS (
        SELECT lang, array_to_string(w[start:start + size - 1], ' ') AS phrase, max(f) AS held FROM (
            SELECT lang, w, k, f, size, unnest(range(1, k - size + 2)) AS start FROM (
                SELECT lang, string_split(phrase, ' ') AS w, k, f, unnest(range(2, k)) AS size FROM counted WHERE k > 2))
        GROUP BY 1, 2)
    SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, n, score
    FROM best b JOIN totals USING (lang) LEFT JOIN held h ON h.lang = b.lang AND h.phrase = b.phrase
    WHERE coalesce(held, 0) = 0 OR 100::HUGEINT * held < 80::HUGEINT * a
    QUALIFY row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) <= 2000"""

ORACLE_SQL: dict[str, str] = {
    "op5_secret_scans": _secret_sql(),
    "op7_mixing": _MIX_SQL,
    "op8_exact_top_k": _TOP_SQL,
    "op10_warc": _WARC_SQL,
    "op11_hard_negatives": _NEGATIVES_SQL,
    "op13_collocations": _PHRASES_SQL,
}
