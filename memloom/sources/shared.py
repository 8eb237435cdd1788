"""Tables that are written on the way: they cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Whether a query's shuffle files go as soon as it ends, instead of when the driver collects garbage.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_place(spark: SparkSession) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir, or an own one where all runs in one process."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="memloom-")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def stored(rows: DataFrame, tag: str, release: bool = False) -> DataFrame:
    """rows, written once and read back; the files go when the driver's JVM ends, with release rows' shuffle files once it is written."""
    spark = rows.sparkSession
    place = shared_place(spark)
    before = spark.conf.get(SHUFFLES_GO)
    try:
        spark.conf.set(SHUFFLES_GO, "true" if release else before)
        rows.write.parquet(f"{place}/{tag}")
    finally:
        spark.conf.set(SHUFFLES_GO, before)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(rows.schema).parquet(f"{place}/{tag}")
