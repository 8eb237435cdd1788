"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The word separators of every contract: ASCII white space only.
WS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: Whether a query's shuffle files go as soon as it ends, instead of when the driver collects garbage.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_own_dir: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or an own one where that is unset and all runs in one process (tests)."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        _own_dir[app] = "file://" + tempfile.mkdtemp(prefix="memloom-")
    return _own_dir[app]


def materialize(df: DataFrame, tag: str, codec: str = "snappy", release: bool = False) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts lineage and survives lost executors.

    The files are deleted when the driver's JVM ends; with release, df's shuffle files once it is written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/memloom-{uuid.uuid4().hex}/{tag}"
    before = spark.conf.get(SHUFFLES_GO)
    try:
        spark.conf.set(SHUFFLES_GO, "true" if release else before)
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.set(SHUFFLES_GO, before)
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hpath.getParent())
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def words(text: Column) -> Column:
    """The words of a text in order; an empty array where it has none."""
    plain = F.replace(text, F.lit("\n"), F.lit(" "))
    rare = [F.lit(c) for c in "\t\x0b\x0c\r"]
    any_rare = rare[0].isNull()
    cleaned = plain
    for c in rare:
        any_rare = any_rare | plain.contains(c)
        cleaned = F.replace(cleaned, c, F.lit(" "))
    return F.array_remove(F.split(F.when(any_rare, cleaned).otherwise(plain), " ", -1), "")


def let(value: Column, body) -> Column:
    """Evaluate value once per row and hand it to body, also where body uses it inside other lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def only(df: DataFrame, *names: str) -> DataFrame:
    """Project to the named columns before any derived column is added, so extra columns never clash."""
    return df.select(*[F.col(f"`{n}`") for n in names])
