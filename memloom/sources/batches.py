"""Stored tables that grow by numbered batches: a batch written twice is there once, and rows of a batch may be removed later.

A batch of several tables ends with one of them, its mark; batches without it, as a lost driver leaves them, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_batch(rows: DataFrame, folder: str, table: str, batch: int, by: list[str] | None = None) -> None:
    """One batch of a table; writing it again replaces it, so a replayed batch changes nothing."""
    out = rows.write.mode("overwrite")
    (out.partitionBy(*by) if by else out).parquet(f"{folder}/{table}/batch={batch}")


def read_batches(spark: SparkSession, folder: str, table: str, schema: str, mark: str) -> DataFrame:
    """The ended batches of a table, with their numbers; none where nothing was written yet. Partition columns belong to schema."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{table}")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], f"{schema}, batch int")
    return spark.read.schema(f"{schema}, batch int").parquet(f"{folder}/{table}").filter(F.col("batch") <= last_batch(spark, folder, mark))


def last_batch(spark: SparkSession, folder: str, table: str) -> int:
    """The highest number of a batch whose writing ended, -1 without one."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{table}/batch=*/_SUCCESS")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return max((int(f.getPath().getParent().getName().split("=")[1]) for f in found or ()), default=-1)


def live(rows: DataFrame, removed: DataFrame, key: str = "id") -> DataFrame:
    """rows(key, batch) less those that removed(key, batch) took away in a later batch."""
    gone = removed.groupBy(F.col(key).alias("_id")).agg(F.max("batch").alias("_until"))
    dead: Column = (F.col(key) == F.col("_id")) & (F.col("batch") < F.col("_until"))
    return rows.join(gone, dead, "left_anti")
