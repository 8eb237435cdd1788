"""Vector search over a stored inverted file: rows in cells, cells in the order of their bound, exact results.

Each row lies in the cell of its nearest centroid, and rows are stored by cell. A cell knows its radius, the largest distance
of a row from the centroid, so no row of it is nearer to a query than the query's distance to the centroid less the radius.
A search reads the nearest cells that hold k rows, takes the k-th distance, and then reads only cells whose bound is
not above it. The result equals that of `vectors.nearest` on all rows; how much was read is told beside it.

Tables below a folder, each in batches: centroids(cell, centroid), rows(id, vector, cell) by cell, cells(cell, n, radius),
removed(id). New rows go to the cells that are there, and radii only grow, so bounds stay right. Centroids come from a
sample of at most SAMPLE rows (by hash of the id): which they are decides how much is read, and nothing else.

Edge cases: vectors must have the width of the index, else ValueError before anything is written; null vectors count as wrong;
queries of another width find nothing; ties go to the smaller id; a row added again in a later batch replaces the
one before; a search in an index without rows gives none; of a batch whose writing was cut off nothing is seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.batches import last_batch, live, read_batches, write_batch
from . import vectors

#: Most cells, rows that centroids are found in, components of the centroids in all, rounds of moving them.
CELLS, SAMPLE, COMPONENTS, ROUNDS = 1024, 8192, 1 << 22, 5
#: Parts that a cell's rows are written in, so that a cell with a third of all rows is no single task.
SPREAD = 16
#: Distances are compared after rounding to six digits.
SLACK = 1e-6


def centroids_of(sample: np.ndarray, n: int) -> np.ndarray:
    """n centroids: rows of the sample, moved a few times to the mean of those nearest to them."""
    centers = np.unique(sample, axis=0)
    centers = centers[np.linspace(0, len(centers) - 1, min(n, len(centers))).astype(int)]
    for _ in range(ROUNDS):
        near = _nearest(sample, centers)[0]
        sums, counts = np.zeros_like(centers), np.bincount(near, minlength=len(centers))
        np.add.at(sums, near, sample)
        centers = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centers)
    return centers


def _nearest(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest center of each row and the distance to it."""
    square = (x * x).sum(1)[:, None] + (centers * centers).sum(1)[None, :] - 2 * x @ centers.T
    near = square.argmin(1)
    return near, np.sqrt(((x - centers[near]) ** 2).sum(1))


def build(rows: DataFrame, folder: str, n_cells: int | None = None, id_col: str = "vec_id", vector: str = "embedding") -> None:
    """A new index in a folder; rows may be empty no longer than width is known from them."""
    size = F.size(vector)
    sample = rows.filter(size > 0).orderBy(F.xxhash64(id_col), id_col).select(vector).limit(SAMPLE).collect()
    if not sample:
        raise ValueError("an index needs rows to tell its width")
    x = np.array([r[0] for r in sample if len(r[0]) == len(sample[0][0])], np.float64)
    n = n_cells or min(CELLS, max(1, round(rows.count() ** 0.5)))
    centers = centroids_of(x, max(1, min(n, COMPONENTS // x.shape[1])))
    table = rows.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(centers)], "cell int, centroid array<double>")
    vectors.checked(rows, x.shape[1], vector)
    write_batch(table, folder, "centroids", 0)
    add(rows, folder, id_col, vector, batch=0)


def _centers(spark: SparkSession, folder: str) -> np.ndarray:
    found = read_batches(spark, folder, "centroids", "cell int, centroid array<double>", "centroids").orderBy("cell").collect()  # at most CELLS
    return np.array([r["centroid"] for r in found], np.float64)


def add(rows: DataFrame, folder: str, id_col: str = "vec_id", vector: str = "embedding", batch: int | None = None) -> int:
    """Write rows as a batch; those whose ids are there already replace them. Writing a batch again changes nothing."""
    spark = rows.sparkSession
    centers = _centers(spark, folder)
    vectors.checked(rows, centers.shape[1], vector)
    batch = last_batch(spark, folder, "cells") + 1 if batch is None else batch

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            near, distance = _nearest(np.array(f["vector"].tolist(), np.float64).reshape(len(f), -1), centers)
            yield f.assign(cell=near.astype("int32"), distance=distance)

    kind = rows.schema[id_col].dataType.simpleString()
    assigned = rows.select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("vector")).mapInPandas(assign, f"id {kind}, vector array<double>, cell int, distance double")
    parts = assigned.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(SPREAD)))
    write_batch(rows.select(F.col(id_col).alias("id")).distinct(), folder, "removed", batch)  # of earlier batches
    write_batch(parts, folder, "rows", batch, ["cell"])
    stored = spark.read.parquet(f"{folder}/rows/batch={batch}") if not rows.isEmpty() else assigned
    write_batch(stored.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("radius")), folder, "cells", batch)
    return batch


def remove(ids: DataFrame, folder: str, id_col: str = "vec_id", batch: int | None = None) -> int:
    spark = ids.sparkSession
    batch = last_batch(spark, folder, "cells") + 1 if batch is None else batch
    write_batch(ids.select(F.col(id_col).alias("id")).distinct(), folder, "removed", batch)
    write_batch(spark.createDataFrame([], "cell int, n long, radius double"), folder, "cells", batch)
    return batch


def nearest(spark: SparkSession, folder: str, queries: DataFrame, k: int, id_type: str = "long") -> tuple[DataFrame, DataFrame]:
    """(hits, reads): query_id, id, distance, rank of the k nearest live rows; and query_id, cells, rows read, rows in all."""
    kind = queries.schema["query_id"].dataType.simpleString()
    centers = read_batches(spark, folder, "centroids", "cell int, centroid array<double>", "centroids").drop("batch")
    sizes = read_batches(spark, folder, "cells", "cell int, n long, radius double", "cells").groupBy("cell").agg(F.sum("n").alias("n"), F.max("radius").alias("radius"))
    cells = centers.join(F.broadcast(sizes), "cell")  # at most CELLS rows
    rows = read_batches(spark, folder, "rows", f"id {id_type}, vector array<double>, cell int", "cells")
    removed = read_batches(spark, folder, "removed", f"id {id_type}", "cells")
    far = F.sqrt(vectors.squared_l2(F.col("q"), F.col("centroid")))
    probes = queries.select("query_id", "q").join(F.broadcast(cells), F.size("q") == F.size("centroid")).withColumn("far", far)
    probes = probes.withColumn("bound", F.greatest(F.lit(0.0), F.col("far") - F.col("radius"))).drop("centroid", "radius")
    by = Window.partitionBy("query_id").orderBy("far", "cell").rowsBetween(Window.unboundedPreceding, -1)
    probes = probes.withColumn("first", F.coalesce(F.sum("n").over(by), F.lit(0)) < k)

    def scored(some: DataFrame) -> DataFrame:
        wanted = [r[0] for r in some.select("cell").distinct().collect()]  # at most CELLS: prunes the folders that are listed
        part = live(rows.filter(F.col("cell").isin(wanted)), removed)
        d = F.round(vectors.squared_l2(F.col("vector"), F.col("q")), 6)
        return part.join(some.select("query_id", "q", "cell"), "cell").select("query_id", "id", d.alias("distance"))

    best = Window.partitionBy("query_id").orderBy("distance", "id")
    top = lambda hits: hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    near = top(scored(probes.filter("first")))
    edge = near.filter(F.col("rank") == k).select("query_id", F.col("distance").alias("edge"))
    rest = probes.filter("not first").join(edge, "query_id", "left").filter(F.col("edge").isNull() | (F.pow("bound", F.lit(2.0)) <= F.col("edge") + SLACK))
    hits = top(near.drop("rank").unionByName(scored(rest)))
    read = probes.filter("first").select("query_id", "n").unionByName(rest.select("query_id", "n")).groupBy("query_id").agg(F.count(F.lit(1)).alias("cells"), F.sum("n").alias("rows_read"))
    whole = probes.groupBy("query_id").agg(F.sum("n").alias("rows_in_all"))
    return hits.withColumn("query_id", F.col("query_id").cast(kind)), read.join(whole, "query_id")
