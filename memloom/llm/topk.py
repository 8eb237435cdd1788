"""Exact top-k inner products by pivot-table elimination.

Each vector carries its distances to a fixed set of pivots, far apart in a bounded sample. For a query q and a candidate x, the largest
|d(q, p) - d(x, p)| over the pivots is a lower bound of d(q, x), and so (|q|^2 + |x|^2 - bound^2) / 2 is an upper
bound of their inner product. Candidates are evaluated in bound order until the k-th score exceeds every bound left.

Queries and candidates meet in a grid of blocks (QUERY_BLOCK by CANDIDATE_BLOCK rows at most, on average), so
neither side is broadcast; a cell returns k rows a query, which are then ranked.

Edge cases: vectors that are null or hold null or non-finite components take no part, nor do rows without vec_id;
rows that repeat both vec_id and vector are one row; a query's own row is every row with its vec_id; only vectors of
equal length are compared; integers beyond 2^53 count as 2^53, scores are compared exactly at any size, and one beyond a
long is returned as the nearest long; fewer than k candidates give fewer rows; ties go to the smaller vec_id; extra columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

PIVOTS = 32
#: Rows of a vector length among which its pivots are chosen, at most so many components in all; lengths with pivots.
SAMPLE, SAMPLE_COMPONENTS, WIDTHS = 1024, 1 << 18, 16
QUERY_BLOCK = 1024
CANDIDATE_BLOCK = 8192
#: Candidates evaluated between two looks at the bounds.
STEP = 512
#: Integers beyond this count as this, so that scores of any width fit two longs.
BOUND = 1 << 53
#: Scores travel as two longs: the multiple of 2 ** 62 and the rest.
_HALF = 62
#: Below this, sums of products of up to 2 ** 11 components are exact in doubles.
_EXACT = 1 << 20


def usable(vectors: DataFrame, scale: float = 256.0) -> DataFrame:
    """vec_id and v, the floored multiples of the components, of the rows that take part."""
    fine = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    end = F.lit(float(BOUND))
    v = F.transform("embedding", lambda x: F.floor(F.least(F.greatest(F.lit(scale) * x.cast("double"), -end), end)))
    return vectors.filter(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False))).select("vec_id", v.alias("v")).dropDuplicates()


def far_apart(x: np.ndarray, n: int) -> np.ndarray:
    """At most n rows of x: the farthest from the mean, then each time the one farthest from those chosen."""
    chosen = [int(((x - x.mean(0)) ** 2).sum(1).argmax())]
    least = ((x - x[chosen[0]]) ** 2).sum(1)
    while len(chosen) < n and least.max() > 0:
        chosen.append(int(least.argmax()))
        least = np.minimum(least, ((x - x[chosen[-1]]) ** 2).sum(1))
    return x[chosen]


def pivots_of(rows: DataFrame, n: int = PIVOTS, sample: int = SAMPLE, widths: int = WIDTHS) -> dict[int, np.ndarray]:
    """At most n pivots for each of at most widths vector lengths, far apart in a sample of rows by hash of vec_id."""
    w = Window.partitionBy(F.size("v")).orderBy(F.xxhash64("vec_id"), "vec_id", "v")
    dim = F.size("v")
    most = F.greatest(F.lit(n), F.least(F.lit(sample), F.floor(F.lit(SAMPLE_COMPONENTS) / F.greatest(dim, F.lit(1)))))
    some = rows.select("vec_id", "v", F.row_number().over(w).alias("r")).filter((F.col("r") <= max(n, sample)) & (F.col("r") <= most))
    by: dict[int, list] = {}
    for r in some.orderBy(dim, "r").limit(widths * max(n, sample)).collect():
        by.setdefault(len(r["v"]), []).append(r["v"])
    return {d: far_apart(np.array(x, dtype=np.float64), n) for d, x in sorted(by.items())[:widths] if d}


def cell_top(qid: np.ndarray, q: np.ndarray, qd: np.ndarray, xid: np.ndarray, x: np.ndarray, xd: np.ndarray, k: int) -> Iterator[tuple[int, int, int]]:
    """(query, vec_id, score) of each query's k best candidates. qd, xd: distances to the pivots, a row a vector."""
    exact = max(np.abs(q).max(initial=0), np.abs(x).max(initial=0)) < _EXACT
    if exact:
        q, x = q.astype(np.float64), x.astype(np.float64)
    else:
        q, x = q.astype(object), x.astype(object)
    q2, x2 = (q * q).sum(1).astype(np.float64), (x * x).sum(1).astype(np.float64)
    for lo in range(0, len(q), 64):
        part = slice(lo, lo + 64)
        bound = np.zeros((len(qd[part]), len(x)))
        for p in range(qd.shape[1]):
            np.maximum(bound, np.abs(qd[part, p, None] - xd[None, :, p]), out=bound)
        top = (q2[part, None] + x2[None, :] - bound * bound) / 2
        top += 1e-9 * (q2[part, None] + x2[None, :]) + 1e-6  # rounding of the distances
        for i in range(len(top)):
            order = np.argsort(-top[i], kind="stable")
            best: list[tuple[int, int]] = []
            for at in range(0, len(order), STEP):
                if len(best) == k and -best[-1][0] > top[i, order[at]]:
                    break
                some = order[at : at + STEP]
                some = some[xid[some] != qid[lo + i]]
                scores = x[some] @ q[lo + i]
                if len(best) == k:
                    good = scores >= -best[-1][0]
                    some, scores = some[good], scores[good]
                best = sorted([*best, *zip((-scores).tolist(), xid[some].tolist())])[:k]
            for s, v in best:
                yield int(qid[lo + i]), int(v), int(-s)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, n_pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank, vec_id, score for vectors(vec_id, embedding); is_query tells queries by vec_id."""
    rows = materialize(usable(vectors), "vectors")
    pivots = pivots_of(rows, n_pivots)
    n, n_q = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(is_query.cast("long")), F.lit(0))).first()
    across, down = max(1, math.ceil(n / CANDIDATE_BLOCK)), max(1, math.ceil(n_q / QUERY_BLOCK))

    def with_distances(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for v in f["v"]:
                p = pivots.get(len(v))
                out.append([] if p is None else np.sqrt(((p - v) ** 2).sum(1)).tolist())
            yield f.assign(pd=out)

    table = rows.mapInPandas(with_distances, "vec_id long, v array<long>, pd array<double>")
    table = table.withColumn("dim", F.size("v"))
    block = lambda seed, of: F.pmod(F.xxhash64("vec_id", "v", F.lit(seed)), F.lit(of)).cast("int")
    left = table.filter(is_query).withColumn("down", block(1, down)).withColumn("across", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))
    right = table.withColumn("across", block(2, across)).withColumn("down", F.explode(F.sequence(F.lit(0), F.lit(down - 1))))
    left = left.withColumn("wide", F.explode(F.array(F.lit(False), F.lit(True))))
    right = right.withColumn("wide", F.exists("v", lambda x: F.abs(x) >= _EXACT))  # these meet in Python's integers

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found: list = []
        if len(a) and len(b):
            stack = lambda c: np.array(c.tolist())
            wide = np.abs(stack(a["v"]).reshape(len(a), -1)).max(1, initial=0) >= _EXACT
            for some in (a[~wide], a[wide]):
                if len(some):
                    found += cell_top(some["vec_id"].to_numpy(), stack(some["v"]).reshape(len(some), -1), stack(some["pd"]).reshape(len(some), -1), b["vec_id"].to_numpy(), stack(b["v"]).reshape(len(b), -1), stack(b["pd"]).reshape(len(b), -1), k)
        halves = [(q, v, s >> _HALF, s & ((1 << _HALF) - 1)) for q, v, s in found]
        return pd.DataFrame(halves, columns=["query_id", "vec_id", "high", "low"]).astype("int64")

    keys = ["down", "across", "dim", "wide"]
    cells = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, "query_id long, vec_id long, high long, low long")
    w = Window.partitionBy("query_id").orderBy(F.desc("high"), F.desc("low"), "vec_id")
    near = F.shiftleft("high", _HALF) + F.col("low")
    score = F.when(F.col("high") > 1, F.lit(2**63 - 1)).when(F.col("high") < -2, F.lit(-(2**63))).otherwise(near)
    return cells.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", score.alias("score"))
