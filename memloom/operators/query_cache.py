"""Vectors of queries kept between batches: a table that holds those used last.

A cache is rows (key, vector, at, fresh, place): the batch that used a key last, whether it was embedded then, and its place there.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import casefold
from ..sources.shared import stored

SCHEMA = "key string, vector array<double>, at long, fresh int, place long"


class Embedded(NamedTuple):
    vectors: DataFrame  # key, vector, fresh: a row for each distinct key of the batch that has a vector
    cache: DataFrame


def query_key(query: Column) -> Column:
    """Queries that differ in case and outer blanks alone are one."""
    return casefold(F.trim(F.coalesce(query, F.lit(""))))


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def embedded(cache: DataFrame, queries: DataFrame, embed: Callable[[DataFrame], DataFrame], at: int, most: int = 4096) -> Embedded:
    """Vectors of a batch of queries(place, query), and the cache after it.

    embed gets (key, text), the first spelling of each key that the cache does not hold, and gives (key, vector); keys that it gives
    no vector are not kept. Blank and null queries have none. The cache keeps the most keys used last: later batches first,
    in one batch those embedded before those found, then the later place. Batches are numbered upwards by at.
    """
    first = queries.select(query_key(F.col("query")).alias("key"), "place", F.trim("query").alias("text")).filter("key <> ''")
    first = stored(first.groupBy("key").agg(F.min(F.struct("place", "text")).alias("q")).select("key", F.col("q.place").cast("long").alias("place"), "q.text"), "queries")
    new = embed(first.join(cache, "key", "left_anti").select("key", "text")).filter("vector is not null").select("key", F.col("vector").cast("array<double>").alias("vector"))
    found = cache.select("key", "vector").join(first.select("key", "place"), "key").select("key", "vector", F.lit(0).alias("fresh"), "place")
    used = stored(found.unionByName(new.join(first.select("key", "place"), "key").select("key", "vector", F.lit(1).alias("fresh"), "place")), "vectors")
    after = cache.join(used.select("key"), "key", "left_anti").select("key", "vector", "at", "fresh", "place").unionByName(used.select("key", "vector", F.lit(at).cast("long").alias("at"), "fresh", "place"))
    kept = after.orderBy(F.desc("at"), F.desc("fresh"), F.desc("place"), "key").limit(most)  # most bounds what the last task holds
    return Embedded(used.select("key", "vector", "fresh"), stored(kept, "cache"))
