"""Vector distances, nearest neighbours, width contract and hit fusion."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Queries that are broadcast together, and parts that the rows are dealt to where there are more.
BROADCAST_QUERIES, SPREAD = 128, 16
#: Average rows a side of a cell where two large sets of vectors meet.
CELL = 2048


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in [-1, 1]; 0 where a vector has no length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / norm))).otherwise(F.lit(0.0))


def unit(v: Column) -> Column:
    """The vector at length 1; vectors without length stay."""
    n = F.sqrt(dot(v, v))
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(F.transform(v, lambda x: x.cast("double")))


def distances(rows: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector: str = "embedding", metric: str = "l2") -> DataFrame:
    """query_id, id, distance of every row to each of queries(query_id, q).

    Queries are counted: up to BROADCAST_QUERIES (a request has 8 routes of 16 queries) they are broadcast; more are dealt to
    blocks of that many, and each row meets every block in one of SPREAD parts. Vectors of another width than the
    query's are no match.
    """
    d = F.round(squared_l2(F.col(vector), F.col("q")) if metric == "l2" else 1 - cosine(F.col(vector), F.col("q")), 6)
    queries = queries.select("query_id", "q")
    if queries.limit(BROADCAST_QUERIES + 1).count() <= BROADCAST_QUERIES:
        pairs = rows.join(F.broadcast(queries), F.size(vector) == F.size("q"))
    else:
        blocks = -(-queries.count() // BROADCAST_QUERIES)
        spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        left = queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("part", spread(SPREAD))
        right = rows.select(F.col(id_col), F.col(vector), F.pmod(F.xxhash64(id_col), F.lit(SPREAD)).cast("int").alias("part")).withColumn("block", spread(blocks))
        pairs = right.join(left.hint("shuffle_hash"), ["block", "part"]).filter(F.size(vector) == F.size("q"))
    return pairs.select("query_id", F.col(id_col).alias("id"), d.alias("distance"))


def nearest(rows: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector: str = "embedding", metric: str = "l2") -> DataFrame:
    """query_id, id, distance, rank: the k nearest rows of each query.

    The distance is computed once, below the ranking, whose group limit is applied before the shuffle.
    """
    scored = distances(rows, queries, id_col, vector, metric)
    w = Window.partitionBy("query_id").orderBy("distance", "id")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def search_rows(rows: DataFrame, vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", fetch: int = 3) -> DataFrame:
    """query_id, score, place and the rows of the k most alike vectors by cosine.

    fetch * k vectors are taken first, as some may have no row any more; rows of the vectors that are beyond them are out.
    """
    hits = nearest(vectors, queries, fetch * k, key, vector, "cosine")
    found = hits.join(rows, hits["id"] == rows[key]).drop("id").withColumn("score", F.greatest(F.lit(0.0), 1 - F.col("distance")))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return found.drop("distance", "rank").withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def headroom(limit: int, filtered: bool) -> int:
    """How many hits to fetch when a filter follows the search (K7)."""
    return max(5 * limit, min(limit + 80, 200)) if filtered else limit


def cap_per_group(hits: DataFrame, group: str, limit: int, n: int) -> DataFrame:
    """The n best of each group among the limit best of each query."""
    first = Window.partitionBy("query_id").orderBy("distance", "id")
    kept = hits.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= limit)
    each = Window.partitionBy("query_id", group).orderBy("distance", "id")
    return kept.withColumn("group_rank", F.row_number().over(each)).filter(F.col("group_rank") <= n)


def width_report(rows: DataFrame, width: int, vector: str = "embedding") -> DataFrame:
    """rows, wrong, min_width, max_width against a store's width."""
    size = F.coalesce(F.size(vector), F.lit(0))
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.when(size != width, 1).otherwise(0)).alias("n_wrong"), F.min(size).alias("min_width"), F.max(size).alias("max_width"))


def checked(rows: DataFrame, width: int, vector: str = "embedding") -> DataFrame:
    """rows, or ValueError before anything is written if a vector has another width."""
    wrong = width_report(rows, width, vector).first()["n_wrong"]
    if wrong:
        raise ValueError(f"{wrong} vectors do not have {width} components")
    return rows


def fuse_channels(left: DataFrame, right: DataFrame, w_left: float = 0.6, w_right: float = 0.4, importance: DataFrame | None = None) -> DataFrame:
    """Full outer fusion of two hit lists (id, score) by weighted sum; a missing score is 0.

    importance(id, importance): scores are scaled by half and half the importance; .5 where it is unknown.
    """
    l, r = left.select("id", F.col("score").alias("a")), right.select("id", F.col("score").alias("b"))
    fused = l.join(r, "id", "full").select("id", (w_left * F.coalesce("a", F.lit(0.0)) + w_right * F.coalesce("b", F.lit(0.0))).alias("score"))
    if importance is None:
        return fused
    return fused.join(importance, "id", "left").select("id", (F.col("score") * (0.5 + 0.5 * F.coalesce("importance", F.lit(0.5)))).alias("score"))


def best_match(new: DataFrame, old: DataFrame, cell: int = CELL) -> DataFrame:
    """new_id, old_id, sim: the old vector that each new one is nearest to by cosine; ties go to the smaller id (H8).

    new(new_id, a) and old(old_id, b) meet in a grid of cells of about cell rows a side; each cell is one matrix product
    and returns a row a new vector. Vectors without length are like nothing (0); only equal widths are compared.
    """
    down, across = (max(1, -(-t.count() // cell)) for t in (new, old))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = new.select("new_id", "a", F.size("a").alias("dim")).withColumn("down", deal("new_id", down)).withColumn("across", every(across))
    right = old.select("old_id", "b", F.size("b").alias("dim")).withColumn("across", deal("old_id", across)).withColumn("down", every(down))

    def meet(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({"new_id": [], "old_id": [], "sim": []}).astype({"new_id": "int64", "old_id": "int64", "sim": "float64"})
        y = y.sort_values("old_id")
        a, b = (np.array(c.tolist(), np.float64) for c in (x["a"], y["b"]))
        norm = np.sqrt((a * a).sum(1))[:, None] * np.sqrt((b * b).sum(1))[None, :]
        sim = np.round(np.clip(np.divide(a @ b.T, norm, out=np.zeros_like(norm), where=norm > 0), -1, 1), 6)
        best = sim.argmax(1)
        return pd.DataFrame({"new_id": x["new_id"].to_numpy(), "old_id": y["old_id"].to_numpy()[best], "sim": sim[np.arange(len(a)), best]})

    keys = ["down", "across", "dim"]
    cells = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, "new_id long, old_id long, sim double")
    w = Window.partitionBy("new_id").orderBy(F.desc("sim"), "old_id")
    return cells.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")


def centroid(rows: DataFrame, by: str, vector: str = "embedding") -> DataFrame:
    """Mean vector of each group at length 1."""
    parts = rows.select(by, F.posexplode(vector).alias("i", "x"))
    means = parts.groupBy(by, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    packed = means.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("i", "m"))).alias("p"))
    return packed.select(by, unit(F.transform("p", lambda x: x["m"])).alias("centroid"))
