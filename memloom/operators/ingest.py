"""Ingest: turns to chunks, records, evidence and watermarks, and images to rows."""

from __future__ import annotations

from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..sources.batches import read_batches, write_batch
from ..sources.shared import stored
from ..streaming import chunker
from . import evidence, projections, sessions, stores

#: Kinds of records (fixed values); others become facts.
MEMORY_TYPES = ("fact", "preference", "event", "constraint", "procedure", "failure_pattern", "tool_affordance")


#: Rows that a Python worker of the stream holds at once: a batch of records is texts and two vectors each.
BATCH_ROWS = 1_000
_ARROW = "spark.sql.execution.arrow.maxRecordsPerBatch"

#: Columns of stored records.
RECORD = "record_id string, memory_type string, semantic_text string, normalized_text string, entities array<string>, tags array<string>, session_id long, evidence_turns array<int>"


class Ingested(NamedTuple):
    chunks: DataFrame
    records: DataFrame
    nodes: DataFrame
    watermarks: DataFrame


def default_records(turns: DataFrame) -> DataFrame:
    """A record a turn, by rule: what stands in for a model's extraction (H3). Long-term signals make a preference."""
    content = projections.normalized_turn(F.col("role"), F.col("content"))
    t = turns.filter("role <> 'system'").select("session_id", "turn_index", "role", content.alias("semantic_text")).filter("semantic_text is not null")
    kind = F.when(text.long_term_signal(F.col("semantic_text")), F.lit("preference")).otherwise(F.lit("fact"))
    return t.select(
        text.record_id(F.col("semantic_text")).alias("record_id"), kind.alias("memory_type"), "semantic_text", F.array(F.concat(F.lit("session "), F.col("session_id").cast("string"))).alias("entities"), F.array("role").alias("tags"), "session_id", F.array("turn_index").alias("evidence_turns"),
        F.col("turn_index").alias("seq"),
    )


def checked_records(records: DataFrame, counts: DataFrame) -> DataFrame:
    """Records with a known type and evidence turns inside their session (H3, F15). counts(session_id, n)."""
    kind = F.lower(F.trim("memory_type"))
    t = records.join(counts, "session_id").withColumn("memory_type", F.when(kind.isin(*MEMORY_TYPES), kind).otherwise(F.lit("fact")))
    t = t.withColumn("normalized_text", F.concat("memory_type", F.lit(": "), "semantic_text"))
    return t.withColumn("evidence_turns", projections.evidence_turns(F.col("evidence_turns"), F.lit(0), F.col("n"))).drop("n").filter("trim(semantic_text) <> ''")


def _last_of_each(made: DataFrame) -> DataFrame:
    """Of records with equal texts the last."""
    rest = F.struct("memory_type", "semantic_text", "normalized_text", "entities", "tags", "session_id", "evidence_turns")
    return made.groupBy("record_id").agg(F.max_by(rest, F.struct("session_id", "seq")).alias("r")).select("record_id", "r.*")


def ingest(turns: DataFrame, offsets: DataFrame, records: DataFrame | None = None) -> Ingested:
    """Chunks, records and evidence nodes of the turns after each session's watermark, and the watermarks after them.

    records: what a model made of the turns; by default a record a turn. Records with equal texts are one, the last.
    """
    new = sessions.new_turns(turns, offsets)
    made = default_records(new) if records is None else records
    ends = turns.groupBy("session_id").agg((F.max("turn_index") + 1).alias("n"))
    made = checked_records(made, ends)
    once = _last_of_each(made)
    nodes = evidence.postings(once.select("record_id", "entities", F.array_append("tags", F.col("memory_type")).alias("tags")))
    return Ingested(chunker.chunks(new), once, nodes, sessions.advanced(offsets, new))


def write_ingested(log: DataFrame, batch: int, folder: str) -> None:
    """One batch of a chunk log (streaming.chunker.LOG) as chunks, decisions, records, vectors, evidence and watermarks.

    The watermarks end the batch; what a batch without them has written is not read. A batch that is written again, as a
    stream does after a failure, replaces itself, so it changes nothing.
    """
    rows = stored(log, "log")
    turns = chunker.of_kind(rows, "turn")
    made = checked_records(default_records(turns), turns.groupBy("session_id").agg((F.max("turn_index") + 1).alias("n")))
    once = stored(_last_of_each(made), "records")
    write_batch(chunker.of_kind(rows, "chunk"), folder, "chunks", batch)
    write_batch(chunker.of_kind(rows, "decision"), folder, "decisions", batch)
    write_batch(once, folder, "records", batch)
    write_batch(once.select("record_id", "memory_type", embedded("semantic_text").alias("vector"), embedded("normalized_text").alias("normalized_vector")), folder, "vectors", batch)
    write_batch(evidence.postings(once.select("record_id", "entities", F.array_append("tags", F.col("memory_type")).alias("tags"))), folder, "nodes", batch)
    write_batch(turns.groupBy("session_id").agg((F.max("turn_index") + 1).alias("watermark")), folder, "watermarks", batch)


def ingest_stream(turns: DataFrame, folder: str, idle: str | None = None, write=write_ingested) -> None:
    """Ingest a stream of turns (session_id, turn_index, role, content, last) until what is there now is read.

    Sessions' open chunks are keyed state; each micro-batch's log goes to the tables below folder under the stream's batch
    number. Called again, it goes on where it, or a killed run, stopped.
    """
    out = chunker.log_stream(turns, idle=idle).writeStream.foreachBatch(lambda rows, batch: write(rows, batch, folder))
    conf = turns.sparkSession.conf
    before = conf.get(_ARROW)
    try:
        conf.set(_ARROW, BATCH_ROWS)  # the stream and its batches keep the settings of its start
        query = out.option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    finally:
        conf.set(_ARROW, before)
    query.awaitTermination()


def ingested(spark: SparkSession, folder: str) -> Ingested:
    """What the batches so far amount to: of records with equal texts the last, of each session the highest watermark."""
    read = lambda table, schema: read_batches(spark, folder, table, schema, "watermarks")
    records = read("records", RECORD)
    latest = records.groupBy("record_id").agg(F.max_by(F.struct(*[c for c in records.columns if c not in ("record_id", "batch")]), "batch").alias("r"))
    marks = read("watermarks", "session_id long, watermark int").groupBy("session_id").agg(F.max("watermark").alias("watermark"))
    nodes = read("nodes", "node_type string, key string, record_id string").drop("batch").distinct()
    return Ingested(read("chunks", chunker.OUTPUT).drop("batch"), latest.select("record_id", "r.*"), nodes, marks)


def embedded(column: str) -> Column:
    """The default embedding of a column of texts."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: chunker.embed(t or ""))  # arrays of doubles, not lists of objects

    return F.pandas_udf(run, "array<double>")(column)


def ingest_images(images: DataFrame, old: DataFrame) -> DataFrame:
    """Rows of new images(session_id, content, mime, answer): hash, path, checked extraction; an image's fault stays in its row.

    Images that a live row of their session has are skipped; of equal ones in the batch one stays.
    """
    t = images.select("session_id", "mime", text.image_hash(F.coalesce("content", F.lit(""))).alias("image_hash"), projections.checked_extraction(F.coalesce("answer", F.lit(""))).alias("x"), F.when(F.coalesce("content", F.lit("")) == "", F.lit("no image")).alias("error"))
    t = t.groupBy("session_id", "image_hash").agg(F.min(F.struct(F.col("error"), F.col("mime"), F.col("x"))).alias("r")).select("session_id", "image_hash", "r.*")
    t = stores.insert_missing(old, t, ["session_id", "image_hash"], "not expired")
    ident = F.substring(F.sha2(F.concat_ws(":", F.col("session_id").cast("string"), "image_hash"), 256), 1, 32)
    return t.select(ident.alias("record_id"), "session_id", "image_hash", stores.image_path(F.col("session_id").cast("string"), F.col("image_hash"), F.col("mime")).alias("image_path"), "x.*", "error")
