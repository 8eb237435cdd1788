"""Hard negatives by bit-sliced integer products.

Each component becomes an integer, and each integer a row of bits: v = -2^B s + sum of 2^b bit_b. For an anchor q the
product with the bits of one significance, one bit-plane, is a sum of components of q. Planes are taken most significant
first. After the planes down to b, a candidate's score lies between what it has so far plus (2^b - 1) times the sum of
q's negative components, and the same with the positive ones; each plane halves this interval. A candidate is dropped
once its interval cannot qualify: below the k-th best lower end for positives, or outside every wanted range, or below
enough candidates that surely lie in it, for negatives. After the last plane the score is exact.

Anchors and rows meet in a grid of blocks (ANCHOR_BLOCK by ROW_BLOCK rows on average), twice: first each cell gives its
best rows of the anchor's label, then, with the positives' scores known, its best rows of other labels in each wanted
range. A cell returns a fixed number of rows an anchor, so no group grows with the table, whatever its labels.

Edge cases: rows with a null id, label or vector, or with a null or non-finite component, take no part; integers beyond
2^53 count as 2^53 (BOUND); scores are compared exactly at any size, and one beyond a long is returned as the nearest long;
only vectors of equal length meet; rows that repeat id, label and vector are one row, while rows that share an id and differ
are rows of their own, mined each by itself, of which none is another's positive or negative; ties go to the smaller id,
then to a hash of label and vector; an anchor without positives, or a positive without negatives, gives no rows; extra columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, only

BOUND = 1 << 53
ANCHOR_BLOCK, ROW_BLOCK = 512, 8192
#: Vectors with a component of this size or more meet in cells of their own, in Python's integers.
NARROW = 1 << 20
#: Scores travel as two longs: the multiple of 2^62 and the rest.
_HALF = 62
#: Anchors of a cell that go through the planes together.
GROUP = 64


def usable(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, label, v (floored multiples of the components) and twin (tells rows of one vec_id apart) of the rows that take part."""
    fine = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    end = F.lit(float(BOUND))
    v = F.transform("embedding", lambda x: F.floor(F.least(F.greatest(F.lit(scale) * x.cast("double"), -end), end)))
    rows = only(vectors, "vec_id", "label", "embedding").filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(fine, F.lit(False)))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), v.alias("v")).dropDuplicates()
    return rows.withColumn("twin", F.xxhash64("label", "v"))


def bit_planes(x: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(significance b, sign, plane of 0 and 1) of integers, the sign's plane first."""
    top = max(1, max(int(x.max(initial=0)).bit_length(), int(-(x.min(initial=0) + 1)).bit_length()))
    yield top, -1, (x < 0)
    for b in range(top - 1, -1, -1):
        yield b, 1, ((x >> b) & 1)


class Cell:
    """Anchors and rows of one cell; rows' bit-planes are made once. Narrow values are exact in doubles, wide ones are Python's integers."""

    def __init__(self, anchors: pd.DataFrame, rows: pd.DataFrame):
        q, x = _stacked(anchors), _stacked(rows)
        self.anchor_ids, self.anchor_labels = anchors["vec_id"].to_numpy(), anchors["label"].to_numpy()
        self.ids, self.labels, self.twins = rows["vec_id"].to_numpy(), rows["label"].to_numpy(), rows["twin"].to_numpy()
        most = lambda a: int(np.abs(a).max(initial=0))
        kind = np.float64 if most(q) * (2 * most(x) + 2) * max(1, q.shape[1]) < BOUND else object
        self.q = q.astype(kind)
        self.planes = [(b, sign, plane.astype(kind)) for b, sign, plane in bit_planes(x)]

    def scored(self, lo: int, begins: list[np.ndarray], drops: list) -> list[tuple[np.ndarray, np.ndarray]]:
        """For the anchors from lo on, the candidates left of each one's begins and their exact scores.

        drops: for each anchor, which candidates to keep by the lower and upper ends of their intervals. While most
        candidates are left, a plane is one product for all these anchors; then each anchor takes its own candidates.
        """
        q, n = self.q[lo : lo + len(begins)], len(self.ids)
        down, up = np.where(q < 0, q, 0).sum(1), np.where(q > 0, q, 0).sum(1)
        left = begins
        score = [np.zeros(len(x), q.dtype) for x in begins]
        for b, sign, plane in self.planes:
            together = q @ plane.T if 4 * sum(map(len, left)) > n * len(left) else None
            for i, x in enumerate(left):
                part = plane[x] @ q[i] if together is None else together[i][x]
                now = score[i] + sign * (1 << b) * part
                keep = drops[i](now + ((1 << b) - 1) * down[i], now + ((1 << b) - 1) * up[i])
                left[i], score[i] = x[keep], now[keep]
        return list(zip(left, score))

    def positives(self, k: int) -> Iterator[list[tuple[int, int, int]]]:
        """For each anchor, (score, vec_id, twin) of its k best rows of its label."""

        def drop(lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
            return upper >= _kth(lower, k) if len(lower) > k else np.ones(len(lower), bool)

        for lo in range(0, len(self.q), GROUP):
            some = range(lo, min(len(self.q), lo + GROUP))
            begins = [np.flatnonzero((self.ids != self.anchor_ids[i]) & (self.labels == self.anchor_labels[i])) for i in some]
            for left, score in self.scored(lo, begins, [drop] * len(begins)):
                yield self._best(left, score, k)

    def negatives(self, ranges: list[list[tuple[int, int]]], k: int) -> Iterator[list[list[tuple[int, int, int]]]]:
        """For each anchor and each of its ranges of scores, (score, vec_id, twin) of the k best rows of other labels in it."""

        def dropping(own: list[tuple[int, int]]):
            def drop(lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
                keep = np.zeros(len(lower), bool)
                for low, high in own:
                    may = (upper >= low) & (lower <= high)
                    sure = lower[(lower >= low) & (upper <= high)]
                    if len(sure) > k:
                        may &= upper >= _kth(sure, k)
                    keep |= may
                return keep

            return drop

        for lo in range(0, len(self.q), GROUP):
            some = range(lo, min(len(self.q), lo + GROUP))
            begins = [np.flatnonzero((self.ids != self.anchor_ids[i]) & (self.labels != self.anchor_labels[i])) for i in some]
            for i, (left, score) in zip(some, self.scored(lo, begins, [dropping(ranges[i]) for i in some])):
                yield [self._best(left[inside], score[inside], k) for low, high in ranges[i] for inside in [(score >= low) & (score <= high)]]

    def _best(self, left: np.ndarray, score: np.ndarray, k: int) -> list[tuple[int, int, int]]:
        if len(left) > k:
            good = score >= _kth(score, k)
            left, score = left[good], score[good]
        return sorted(((int(s), int(self.ids[j]), int(self.twins[j])) for s, j in zip(score, left)), key=lambda r: (-r[0], r[1], r[2]))[:k]


def _kth(values: np.ndarray, k: int) -> object:
    """The k-th largest."""
    return np.sort(values)[-k] if values.dtype == object else np.partition(values, -k)[-k]


def _stacked(rows: pd.DataFrame) -> np.ndarray:
    return np.array(rows["v"].tolist(), dtype=np.int64).reshape(len(rows), -1)


def _cells(anchors: pd.DataFrame, rows: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, Cell]]:
    """The cell, in two where some anchors are wide: then the others keep to doubles."""
    if len(anchors) and len(rows):
        wide = np.abs(_stacked(anchors)).max(1, initial=0) >= NARROW
        for some in (anchors[~wide], anchors[wide]):
            if len(some):
                yield some, Cell(some, rows)


def _halves(score: int) -> tuple[int, int]:
    return score >> _HALF, score & ((1 << _HALF) - 1)


def _as_long(high: str, low: str) -> Column:
    """The score of two halves, or the nearest long."""
    near = F.shiftleft(F.col(high), _HALF) + F.col(low)
    return F.when(F.col(high) > 1, F.lit(2**63 - 1)).when(F.col(high) < -2, F.lit(-(2**63))).otherwise(near)


def _grid(anchors: DataFrame, rows: DataFrame, across: int, down: int):
    """Both sides dealt to the cells of a grid: each anchor to a line of cells, each row to a column of them."""
    block = lambda seed, of: F.pmod(F.xxhash64("vec_id", "twin", F.lit(seed)), F.lit(of)).cast("int")
    wide = F.aggregate("v", F.lit(False), lambda s, x: s | (F.abs(x) >= NARROW))
    keys = ["down", "across", "dim", "wide"]
    each = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    shaped = lambda f: f.withColumn("dim", F.size("v"))
    left = shaped(anchors).withColumn("down", block(1, down)).withColumn("across", each(across)).withColumn("wide", F.explode(F.array(F.lit(False), F.lit(True))))
    right = shaped(rows).withColumn("across", block(2, across)).withColumn("down", each(down)).withColumn("wide", wide)
    return left.groupBy(*keys).cogroup(right.groupBy(*keys))


def mine(vectors: DataFrame, is_anchor: Column, n_positives: int = 5, n_negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for vectors(vec_id, label, embedding).

    is_anchor tells anchors by vec_id. Negatives score between low and high percent of the positive's score.
    """
    rows = materialize(usable(vectors, scale), "vectors")
    n, n_anchors = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(is_anchor.cast("long")), F.lit(0))).first()
    across, down = max(1, math.ceil(n / ROW_BLOCK)), max(1, math.ceil(n_anchors / ANCHOR_BLOCK))
    anchors = rows.filter(is_anchor)

    def same(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found: list = []
        for some, cell in _cells(a, b):
            for key, best in zip(zip(some["vec_id"].tolist(), some["twin"].tolist()), cell.positives(n_positives)):
                found += [(*key, *_halves(s), j, t) for s, j, t in best]
        return pd.DataFrame(found, columns=["vec_id", "twin", "p_high", "p_low", "positive_id", "p_twin"]).astype("int64")

    near = _grid(anchors, rows, across, down).applyInPandas(same, "vec_id long, twin long, p_high long, p_low long, positive_id long, p_twin long")
    w = Window.partitionBy("vec_id", "twin").orderBy(F.desc("p_high"), F.desc("p_low"), "positive_id", "p_twin")
    positives = near.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n_positives)
    held = positives.groupBy("vec_id", "twin").agg(F.array_sort(F.collect_list(F.struct("place", "positive_id", "p_high", "p_low"))).alias("positives"))
    wanted = materialize(anchors.join(held, ["vec_id", "twin"]), "anchors")  # at most n_positives an anchor

    def other(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found: list = []
        for some, cell in _cells(a, b):
            scores = [[(int(p["p_high"]) << _HALF) + int(p["p_low"]) for p in ps] for ps in some["positives"]]
            ranges = [[(-(-low * s // 100), high * s // 100) for s in own] for own in scores]  # whole scores from low to high percent
            for vec_id, twin, ps, each in zip(some["vec_id"].tolist(), some["twin"].tolist(), some["positives"], cell.negatives(ranges, n_negatives)):
                for p, best in zip(ps, each):
                    found += [(vec_id, twin, p["place"], p["positive_id"], p["p_high"], p["p_low"], *_halves(s), j, t) for s, j, t in best]
        return pd.DataFrame(found, columns=["vec_id", "twin", "place", "positive_id", "p_high", "p_low", "n_high", "n_low", "negative_id", "n_twin"]).astype("int64")

    far = _grid(wanted, rows, across, down).applyInPandas(other, "vec_id long, twin long, place long, positive_id long, p_high long, p_low long, n_high long, n_low long, negative_id long, n_twin long")
    w = Window.partitionBy("vec_id", "twin", "place").orderBy(F.desc("n_high"), F.desc("n_low"), "negative_id", "n_twin")
    best = far.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n_negatives)
    return best.select(F.col("vec_id").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", _as_long("p_high", "p_low").alias("positive_score"), _as_long("n_high", "n_low").alias("negative_score"))
