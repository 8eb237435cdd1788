"""Loaders for the tables of a scale-factor folder and their roles in the memory model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sessions


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as dialogue turns."""
    return sessions.turns_of(read(spark, sf_dir, "conversations"))


def dated_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dialogue turns with the time of their conversation."""
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("session_id") % 366).cast("int")), "yyyy-MM-dd")
    return turns(spark, sf_dir).withColumn("created_at", F.concat(day, F.lit("T09:00:00Z")))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as memory records: type, session, turn range, role, times and expiry follow from the id."""
    i = F.col("doc_id")
    pick = lambda *names: F.get(F.array(*[F.lit(n) for n in names]), (i % len(names)).cast("int"))
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (i % 366).cast("int")), "yyyy-MM-dd")
    return read(spark, sf_dir, "documents").select(
        i.alias("record_id"), pick("fact", "event", "preference", "constraint").alias("memory_type"), F.lit("").alias("display_text"), F.coalesce("text", F.lit("")).alias("semantic_text"), F.col("text").alias("normalized_text"),
        (i % 100).alias("session_id"), (i % 4).cast("int").alias("lo"), (i % 4 + i % 2).cast("int").alias("hi"), pick("user", "assistant", "both").alias("role"), F.array_compact(F.array("source")).alias("entities"),
        F.array_compact(F.array("lang", F.lit("fact"))).alias("tags"), F.when(i % 3 == 0, day).alias("t_start"), F.lit(None).cast("string").alias("t_end"), F.concat(day, F.lit("T10:00:00.250Z")).alias("created_at"), (i % 17 == 0).alias("expired"),
    )


def stream(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a stored Parquet table, one file or a folder of files, as a stream."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory()
    top, _, name = path.rpartition("/")
    return spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", "*.parquet" if folder else name).parquet(path if folder else top)
