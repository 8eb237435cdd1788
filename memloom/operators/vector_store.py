"""Stored vectors of one width, replaced by parts.

Rows (id, vector) lie in PARTS folders by a hash of the id. An upsert reads and writes only the folders that its ids fall
into, by dynamic partition overwrite. The table knows its width. To open it with another one rebuilds it while it is empty, and
raises before anything is written once it holds rows; so does a batch with a vector of another width, or none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import stored
from . import stores, vectors

PARTS = 64


def _schema(kind: str) -> str:
    return f"id {kind}, vector array<float>, part int"


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def rows(spark: SparkSession, folder: str, kind: str = "long") -> DataFrame:
    if not _exists(spark, f"{folder}/rows"):
        return spark.createDataFrame([], _schema(kind))
    return spark.read.schema(_schema(kind)).parquet(f"{folder}/rows")


def width(spark: SparkSession, folder: str) -> int | None:
    """The width of a table, None where there is none."""
    return spark.read.parquet(f"{folder}/width").first()[0] if _exists(spark, f"{folder}/width") else None


def opened(spark: SparkSession, folder: str, wanted: int) -> str:
    """Open a table for vectors of a width: created, opened, or rebuilt if it had another width and no rows; else ValueError."""
    if wanted <= 0:
        raise ValueError("a width is positive")
    now = width(spark, folder)
    if now == wanted:
        return "opened"
    if now is not None and not rows(spark, folder).isEmpty():
        raise ValueError(f"the table holds vectors of {now} components, not {wanted}")
    spark.createDataFrame([(wanted,)], "width int").coalesce(1).write.mode("overwrite").parquet(f"{folder}/width")
    return "created" if now is None else "rebuilt"


def upsert(new: DataFrame, folder: str, kind: str = "long") -> None:
    """Replace or add new(id, vector), whose ids differ, after all of them were checked."""
    spark = new.sparkSession
    if (now := width(spark, folder)) is None:
        raise ValueError("the table was not opened")
    part = F.pmod(F.xxhash64("id"), F.lit(PARTS)).cast("int")
    new = stored(new.select("id", F.col("vector").cast("array<float>").alias("vector"), part.alias("part")), "new")
    vectors.checked(new, now, "vector")
    touched = [r[0] for r in new.select("part").distinct().collect()]  # at most PARTS
    old = rows(spark, folder, kind).filter(F.col("part").isin(touched))
    result = stored(stores.replace_by_key(old, new, "id"), "parts")  # the folders are read before they are written
    result.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{folder}/rows")
