"""Upserts, soft deletes, counters and lookups over table snapshots.

Parquet has no merge, so an upsert is an expression: old and new rows are united and one row a key is kept; the result
is written as a new version. All of these shuffle once, by key.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scoring
from ..functions.text import session_segment
from ..sources.shared import stored


def upsert(old: DataFrame, new: DataFrame, key: str, seq: str, keep_first: Iterable[str] = ()) -> DataFrame:
    """Latest row a key by seq; the keep_first columns stay as they were first written."""
    every = old.unionByName(new, allowMissingColumns=True)
    rest = [c for c in every.columns if c != key and c not in keep_first]
    latest = F.max_by(F.struct(*rest), seq).alias("latest")
    return every.groupBy(key).agg(latest, *[F.min_by(c, seq).alias(c) for c in keep_first]).select(key, "latest.*", *keep_first)


def replace_by_key(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Delete and insert."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str], live: str | None = None) -> DataFrame:
    """New rows whose keys no live old row has."""
    present = (old.filter(live) if live else old).select(*keys).distinct()
    return new.join(present, keys, "left_anti")


def lookup(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows by a list of ids, cleaned and distinct."""
    return rows.join(ids.select(key).filter(F.col(key).isNotNull()).distinct(), key, "left_semi")


def missing(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows not yet indexed."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def expire(rows: DataFrame, key: str, ids: list, reason: str) -> DataFrame:
    hit = F.col(key).isin(ids)
    return rows.withColumn("expired", F.col("expired") | hit).withColumn("expired_reason", F.when(hit, F.lit(reason)).otherwise(F.col("expired_reason")))


def add_counts(rows: DataFrame, events: DataFrame, key: str, counter: str) -> DataFrame:
    """Counters plus the number of events of each key."""
    more = events.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return rows.join(more, key, "left").withColumn(counter, F.coalesce(counter, F.lit(0)) + F.coalesce("_n", F.lit(0))).drop("_n")


def content_dedup(rows: DataFrame, content: str, seq: str) -> DataFrame:
    """One row a content hash: the last written."""
    hashed = rows.withColumn("record_id", F.sha2(F.coalesce(content, F.lit("")), 256))
    return hashed.groupBy("record_id").agg(F.max(seq).alias(seq), F.count(F.lit(1)).alias("n_copies"))


def merge_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Evidence nodes (node_id, seq, record_ids, search_text, start, end) merged: united lists, joined texts, widest span.

    Texts are appended in order unless already contained; the last 8000 characters stay.
    """
    every = old.unionByName(new).groupBy("node_id").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("record_ids")))).alias("record_ids"),
        F.transform(F.array_sort(F.collect_list(F.struct("seq", "search_text"))), lambda x: x["search_text"]).alias("texts"),  # a node's versions
        F.min("start").alias("start"), F.max("end").alias("end"), F.max("seq").alias("seq"),
    )
    grow = lambda a, x: F.when(F.contains(a, x), a).when(F.length(a) == 0, x).otherwise(F.concat_ws("\n", a, x))
    return every.select("node_id", "seq", "record_ids", F.right(F.aggregate("texts", F.lit(""), grow), F.lit(8000)).alias("search_text"), "start", "end")


def pair_dedup(events: DataFrame, fingerprint: list[str]) -> DataFrame:
    """Events whose fingerprint differs from that of the user's event before."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    mark = F.concat_ws("|", *[F.col(c).cast("string") for c in fingerprint])
    t = events.withColumn("mark", mark).withColumn("before", F.lag("mark").over(w))
    return t.filter(F.col("before").isNull() | (F.col("before") != F.col("mark"))).drop("mark", "before")


#: Columns of the stores' tables (S1, S39, S40); vectors are arrays whose width the table's property tells.
SCHEMAS = {
    "records": "record_id string, memory_type string, semantic_text string, normalized_text string, entities array<string>, tags array<string>, source_session string, source_role string, evidence_turn_range array<int>, created_at timestamp, expired boolean",
    "evidence_nodes": "node_id string, node_type string, key string, label string, record_ids array<string>, search_text string, temporal struct<start:string,end:string>, metadata map<string,string>",
    "record_vectors": "record_id string, memory_type string, vector array<float>, normalized_vector array<float>, expired boolean",
    "turns": "id bigint, session_id string, role string, content string, token_count int, deleted boolean, created_at timestamp, speaker string",
    "session_meta": "session_id string, topic string, tags array<string>, updated_at timestamp, last_consolidated_turn_index int",
    "summaries": "session_id string, boundary_index int, content string, token_count int",
    "skills": "skill_id string, intent string, doc_markdown string, conditions string, success_count int, last_used timestamp, created_at timestamp",
    "visual": "record_id string, session_id string, image_hash string, image_path string, caption string, scene_type string, importance_score double, retrieval_count int, expired boolean, expired_reason string, created_at timestamp",
    "chunks": "session_id string, chunk int, start_turn int, end_turn int, tokens int, reason string",
}
#: File endings by kind of image.
IMAGE_ENDINGS = {"image/jpeg": "jpg", "image/jpg": "jpg", "image/png": "png", "image/gif": "gif", "image/webp": "webp"}


def create_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Empty tables of every store in a folder that driver and executors share."""
    for name, schema in SCHEMAS.items():
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{folder}/{name}")
    return {name: spark.read.schema(schema).parquet(f"{folder}/{name}") for name, schema in SCHEMAS.items()}


def migrated(rows: DataFrame, schema: str) -> DataFrame:
    """rows with the columns of a newer schema: missing ones are null, others stay."""
    wanted = rows.sparkSession.createDataFrame([], schema).schema
    return rows.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in wanted if f.name not in rows.columns])


def point(rows: DataFrame, key: str, value) -> DataFrame:
    """The rows of one key (S3, S6, S31, S45); the filter reaches the scan."""
    return rows.filter(F.col(key) == value)


def scan(rows: DataFrame, kind: str, value: str, key: str, limit: int) -> DataFrame:
    """Rows of one kind by key, at most limit."""
    return rows.filter(F.col(kind) == value).orderBy(key).limit(limit)


def export(tables: dict[str, DataFrame]) -> DataFrame:
    """table, row: every row of every table as JSON."""
    out = None
    for name, rows in tables.items():
        part = rows.select(F.lit(name).alias("table"), F.to_json(F.struct("*")).alias("row"))
        out = part if out is None else out.unionByName(part)
    return out


def truncated(tables: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
    """(empty tables, deleted rows of each)."""
    counts = None
    for name, rows in tables.items():
        part = rows.agg(F.count(F.lit(1)).alias("deleted")).select(F.lit(name).alias("table"), "deleted")
        counts = part if counts is None else counts.unionByName(part)
    return {name: rows.filter(F.lit(False)) for name, rows in tables.items()}, counts


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """rows less the keys that are gone."""
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def delete_sessions(tables: dict[str, DataFrame], gone: DataFrame, key: str = "session_id") -> tuple[dict[str, DataFrame], DataFrame]:
    """(every table of a session without the sessions that are gone, deleted rows of each)."""
    ids, counts = gone.select(key).distinct(), None
    for name, rows in tables.items():
        part = rows.join(ids, key, "left_semi").agg(F.count(F.lit(1)).alias("deleted")).select(F.lit(name).alias("table"), "deleted")
        counts = part if counts is None else counts.unionByName(part)
    return {name: without(rows, ids, key) for name, rows in tables.items()}, counts


def append_turns(turns: DataFrame, meta: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(log, meta) after new turns(session_id, id, role, content, created_at): the sessions' times move on."""
    touched = new.groupBy("session_id").agg(F.max("created_at").alias("_at"))
    meta = meta.join(touched, "session_id", "full").withColumn("updated_at", F.coalesce(F.greatest("updated_at", "_at"), "updated_at", "_at")).drop("_at")
    return turns.unionByName(new, allowMissingColumns=True), meta


def update_meta(meta: DataFrame, changes: DataFrame) -> DataFrame:
    """meta with changed topic and tags; what a change leaves null stays."""
    c = changes.select("session_id", F.col("topic").alias("_topic"), F.col("tags").alias("_tags"))
    t = meta.join(c, "session_id", "full")
    return t.withColumns({"topic": F.coalesce("_topic", "topic"), "tags": F.coalesce("_tags", "tags")}).drop("_topic", "_tags")


def image_path(session: Column, image_hash: Column, mime: Column) -> Column:
    """Where an image is kept: a folder a session, its hash, the ending of its kind."""
    ending = F.lit("jpg")
    for kind, name in IMAGE_ENDINGS.items():
        ending = F.when(F.lower(mime) == kind, F.lit(name)).otherwise(ending)
    return F.concat(session_segment(session), F.lit("/"), image_hash, F.lit("."), ending)


def flushes(rows: DataFrame, key: str, order: str, size: int) -> DataFrame:
    """The buffer that each row is written with: every size rows of a key in order, the last one what is left."""
    at = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    return rows.withColumn("flush", F.floor(at / size).cast("int"))


def faded(rows: DataFrame, now: str, key: str, ts: str, below: float = 0.1) -> DataFrame:
    """Live rows whose decay is below a limit, and place, their order by age (R16); rows(key, ts, importance, retrievals, expired).

    now is an SQL time. Places are counted over ranges of time, so that no task numbers all rows.
    """
    hours = F.timestamp_diff("MICROSECOND", F.col(ts), F.expr(now)) / 3.6e9
    t = rows.filter("not expired").withColumn("decay", scoring.decay(hours, F.col("importance"), F.col("retrievals"))).filter(F.col("decay") < below)
    return numbered(t, [ts, key])


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with place, from 1, by order: ranges of the order are sorted apart, and each starts after those before it."""
    part = stored(rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "ranges")
    sizes = part.groupBy("range").agg(F.count(F.lit(1)).alias("size"))  # a row a partition
    starts = sizes.select("range", (F.sum("size").over(Window.orderBy("range")) - F.col("size")).alias("start"))
    own = F.row_number().over(Window.partitionBy("range").orderBy(*order))
    return part.join(F.broadcast(starts), "range").withColumn("place", (own + F.col("start")).cast("int")).drop("range", "start")


def merged_metadata(rows: DataFrame, key: str, seq: str, column: str) -> DataFrame:
    """key, column: maps merged in order of seq, the later value of a name wins."""
    each = rows.select(key, seq, F.explode(column).alias("name", "value")).groupBy(key, "name").agg(F.max_by("value", seq).alias("value"))
    return each.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "value")))).alias(column))


def merged_statistics(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Running totals resumed from what was saved: calls, tokens, latency and the mean latency."""
    every = old.unionByName(new).groupBy(key).agg(*[F.sum(c).alias(c) for c in ("calls", "tokens", "latency")])
    return every.withColumn("mean_latency", F.when(F.col("calls") > 0, F.col("latency") / F.col("calls")))


def jobs(events: DataFrame) -> DataFrame:
    """State of each session's last job: pending, skipped or done; ends of older jobs are ignored.

    events(session_id, job_id, ended boolean, skipped_reason, error).
    """
    last = events.groupBy("session_id").agg(F.max("job_id").alias("job_id"))
    own = events.join(last, ["session_id", "job_id"]).groupBy("session_id", "job_id").agg(F.max("ended").alias("ended"), F.max("skipped_reason").alias("skipped_reason"), F.max("error").alias("error"))
    status = F.when(~F.col("ended"), "pending").when(F.col("error").isNull() & F.col("skipped_reason").isNotNull(), "skipped").otherwise("done")
    return own.select("session_id", "job_id", status.alias("status"), F.when(F.col("error").isNull(), F.col("skipped_reason")).alias("skipped_reason"), "error")


def is_empty(rows: DataFrame) -> bool:
    """Whether a table has rows, the gate before a search."""
    return rows.isEmpty()


# ---- visual rows ----------------------------------------------------------------------------------------------

VISUAL_TEXTS = ("image_url", "image_mime_type", "caption", "scene_type", "source_role", "last_retrieved_at", "expired_at")


def visual_records(rows: DataFrame) -> DataFrame:
    """Stored visual rows as typed records (P26): JSON columns as lists, empty where they are null or malformed; empty texts,
    and 1 for a confidence or importance that is null or 0, 0 for counts, not expired where nothing says so."""
    lists = lambda c, kind: F.coalesce(F.from_json(c, kind), F.array().cast(kind))
    some = lambda c: F.when(F.coalesce(F.col(c), F.lit(0.0)) == 0, F.lit(1.0)).otherwise(F.col(c))
    changed = {c: F.coalesce(c, F.lit("")) for c in VISUAL_TEXTS} | {"entities": lists("entities", "array<string>"), "related_memory_record_ids": lists("related_memory_record_ids", "array<string>")}
    changed |= {c: lists(c, "array<double>") for c in ("caption_embedding", "visual_embedding")} | {c: some(c) for c in ("confidence", "importance_score")}
    changed |= {c: F.coalesce(c, F.lit(0)) for c in ("image_size", "retrieval_count")} | {"expired": F.coalesce("expired", F.lit(0)) != 0}
    return rows.withColumns({c: v for c, v in changed.items() if c in rows.columns})


def visual_page(records: DataFrame, limit: int = 50, offset: int = 0, session: str | None = None, include_expired: bool = False) -> DataFrame:
    """A page of visual records, newest first, then by id; of one session, without expired ones unless asked for."""
    some = records if session is None else records.filter(F.col("session_id") == session)
    live = some if include_expired else some.filter(~F.col("expired"))
    return live.orderBy(F.desc_nulls_last("timestamp"), "record_id").offset(offset).limit(limit)


def session_visuals(records: DataFrame, k: int = 20) -> DataFrame:
    """The k newest live visual records of every session, with their place."""
    newest = Window.partitionBy("session_id").orderBy(F.desc_nulls_last("timestamp"), "record_id")
    return records.filter(~F.col("expired")).withColumn("place", F.row_number().over(newest)).filter(F.col("place") <= k)
