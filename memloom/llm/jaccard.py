"""Exact Jaccard join of documents on word shingles, with set-relation skipping.

A document's set holds its distinct K-word shingles (64-bit hashes); two documents link at Jaccard >= 0.75.

* Equal sets are one class with one representative; only representatives are joined.
* Answer level: representatives that agree in half of their MinHash values with the smallest document that shares one of
  them form a ball around it, their leader. Inside a cell of the join, a set of a ball is held as its difference from the
  leader, and its overlap with any other set follows from the leader's overlap and that difference. Balls only group
  the work: whatever they hold, no pair is left out.
* Index level: each representative enters the lists of the rarest quarter of its shingles (prefix filter). A list is
  cut into blocks by position; pairs of blocks whose positions and sizes leave too little overlap, and pairs of one ball,
  are skipped. A ball of many sets enters a list's pairs as a whole, as (host ball, guest set), so a group of near copies
  yields a row a stray set and not one a pair. For the other pairs, what they share in all lists, with what is left after
  the last of them, bounds the overlap again, and the parities of their shingles, counted by hash in twice as many bits
  as there are shingles, bound the difference from below. Only then do sets move.
* The sets of a ball meet each other and the ball's guests in cells of bounded size (PART_ROWS, PART_BYTES,
  GUEST_ROWS); a popular ball or host has many cells. A cell returns how many links each of its sets has and the
  smallest node each is connected with there. n_links is the sum; components come from alternating large-star and
  small-star steps over those edges.

"Rarest" follows a count sketch of fixed size over all shingles; any total order keeps the join exact, and the
sketch keeps frequent shingles out of the lists. Lists that the sketch says are long are dealt to a grid of cells.

Edge cases: null text or no word: empty set, linked with nothing; fewer than K words: the whole sequence is the one
shingle; a doc_id is one vertex, so texts that share a doc_id share its component and links; a null doc_id gets the
component and links of its class if that has an id, else null; repeated rows are all returned; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .wordhash import hashes, mix, runs

K = 5
#: Jaccard >= NUM / DEN.
NUM, DEN = 75, 100
#: Bits that deal a set's shingles to the bins of which each gives one MinHash value.
BIN_BITS = 3
#: Rounds in which sets outside all balls may form further ones.
ROUNDS = 3
#: Sets from which a ball enters the pairs of a list as a whole.
BIG_BALL = 64
SKETCH_BITS = 18
_BLOCK = 4096
#: Rows of a list that one task takes.
CELL_ROWS = 50_000
#: Sets of a ball, and bytes of them, in one part; two parts at most meet in a cell.
PART_ROWS, PART_BYTES = 1_000, 32 << 20
#: Guests of a ball in one cell.
GUEST_ROWS = 2_000
_BATCH_ROWS, _BATCH_BYTES = 256, 8 << 20
_NONE = np.iinfo(np.int64).max


def shingle_set(text: bytes | None, k: int = K) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text given as UTF-8."""
    words = (text or b"").lower().split()  # bytes: only A-Z and ASCII white space
    if not words:
        return np.zeros(0, np.uint64)
    h = hashes(words)
    if len(words) < k:
        return mix(runs(h, len(h)) + np.uint64(len(h)))
    return np.unique(runs(h, k))


def similar(a: int, b: int, both: np.ndarray | int) -> np.ndarray | bool:
    return DEN * both >= NUM * (a + b - both)


def minhashes(s: np.ndarray) -> np.ndarray:
    """The least mixed value in each bin of a sorted set that is not empty."""
    starts = np.searchsorted(s, np.arange(1 << BIN_BITS, dtype=np.uint64) << np.uint64(64 - BIN_BITS))
    starts = starts[np.diff(np.append(starts, len(s))) > 0]
    return np.minimum.reduceat(mix(s), starts).view(np.int64)


def parities(s: np.ndarray) -> bytes:
    """Whether the number of values is odd, for each low part of them; two bits a value or more."""
    bits = min(1 << 16, max(64, 1 << (2 * len(s) - 1).bit_length()))
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """A lower bound of the symmetric difference of two sets, from their parities."""
    x, y = sorted((np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)), key=len)
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _binary(b: pa.RecordBatch, name: str) -> pa.Array:
    return b.column(name).cast(pa.binary())


def signatures(docs: DataFrame, k: int = K) -> DataFrame:
    """A row a document: doc_id, n, digest, mins, parity; and rows block, counts that hold the task's part of the sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << SKETCH_BITS, np.int64)
        shift = np.uint64(64 - SKETCH_BITS)
        names = ["doc_id", "n", "digest", "mins", "parity", "block", "counts"]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.int32(), pa.binary()]
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), _binary(b, "text"), strict=True):
                s = shingle_set(text.as_py(), k)
                if len(s):
                    np.add.at(sketch, (s >> shift).astype(np.int64), 1)
                    rows.append((doc_id, len(s), xxhash.xxh3_128_digest(s.tobytes()), minhashes(s), parities(s), None, None))
                else:
                    rows.append((doc_id, 0, b"", [], None, None, None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names) if rows else pa.RecordBatch.from_arrays([pa.array([], t) for t in kinds], names=names)
        parts = [(None, None, None, None, None, i, sketch[i * _BLOCK : (i + 1) * _BLOCK].tobytes()) for i in range(len(sketch) // _BLOCK)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*parts), kinds)], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, digest binary, mins array<long>, parity binary, block int, counts binary")


def _sketch(parts: DataFrame) -> np.ndarray:
    """The sum of the tasks' sketches: 2 ** SKETCH_BITS counts, whatever the input."""
    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(_BLOCK, np.int64)
        for c in table.column("counts"):
            total += np.frombuffer(c.as_py(), np.int64)
        return pa.table({"block": pa.array([table.column("block")[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    kind = "block int, counts binary"
    some = parts.withColumn("salt", F.pmod(F.xxhash64("counts"), F.lit(16))).groupBy("block", "salt").applyInArrow(add, kind)
    total = np.zeros(1 << SKETCH_BITS, np.int64)
    for r in some.groupBy("block").applyInArrow(add, kind).collect():
        total[r["block"] * _BLOCK : (r["block"] + 1) * _BLOCK] = np.frombuffer(r["counts"], np.int64)
    return total


def balls(classes: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """node, ball for the sets of classes(node, mins) that belong to the ball of another one, their leader.

    In each round a set goes to the leader that half of its MinHash values, two at least, name, if that one goes nowhere itself.
    """
    every = classes.select("node", F.size("mins").alias("of"), F.explode("mins").alias("value"))
    shared = every.groupBy("value").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("value")
    left = materialize(every.join(shared, "value"), "values")
    found = None
    for i in range(rounds):
        leads = left.groupBy("value").agg(F.min("node").alias("ball"), F.count(F.lit(1)).alias("c")).filter("c > 1").select("value", "ball")
        votes = left.join(leads, "value").filter("node <> ball").groupBy("node", "of", "ball").agg(F.count(F.lit(1)).alias("votes"))
        best = votes.filter("votes >= 2 and 2 * votes >= of").groupBy("node").agg(F.max(F.struct("votes", (-F.col("ball")).alias("ball"))).alias("best"))
        best = materialize(best.select("node", (-F.col("best.ball")).alias("ball")), "led")
        led = best.join(best.select(F.col("node").alias("ball")), "ball", "left_anti").select("node", "ball")
        found = led if found is None else found.unionByName(led)
        if i + 1 < rounds:
            done = led.select("node").union(led.select("ball")).distinct()
            left = materialize(left.join(done, "node", "left_anti"), "values")
    return materialize(found, "balls")


def _list_pairs(ball: np.ndarray, node: np.ndarray, n: np.ndarray, pos: np.ndarray, several: np.ndarray, big: np.ndarray, block: int = 256) -> Iterator[np.ndarray]:
    """Columns x, y, left, need for the pairs of one list that are of different balls and may overlap enough.

    Two sets, the smaller node first, with need: the overlap that they need, and left: the most that they can have after
    this shingle. Or a host ball and a guest, with need 0, if the host is a big ball or one of the two has several texts:
    their rows cannot be summed.
    """
    order = np.lexsort((node, pos))
    ball, node, n, pos, several, big = (c[order] for c in (ball, node, n, pos, several, big))
    starts = range(0, len(node), block)
    ends = [min(s + block, len(node)) for s in starts]
    most = [int(n[a:b].max()) for a, b in zip(starts, ends)]
    least = [int(n[a:b].min()) for a, b in zip(starts, ends)]
    reach = [int((n[a:b] - pos[a:b]).max()) for a, b in zip(starts, ends)]
    for i, (a, b) in enumerate(zip(starts, ends)):
        for j in range(i, len(ends)):
            c, d = starts[j], ends[j]
            if DEN * most[i] < NUM * least[j] or DEN * most[j] < NUM * least[i]:
                continue
            # at most: all before the earlier position, and what is left after both
            if (NUM + DEN) * (min(int(pos[b - 1]), int(pos[d - 1])) + min(reach[i], reach[j])) < NUM * (least[i] + least[j]):
                continue
            open_ = ball[a:b, None] != ball[None, c:d]
            if not open_.any():
                continue
            left = np.minimum((n - pos)[a:b, None], (n - pos)[None, c:d]) - 1
            need = -(-NUM * (n[a:b, None] + n[None, c:d]) // (NUM + DEN))
            u, v = np.nonzero(open_ & (np.minimum(pos[a:b, None], pos[None, c:d]) + left + 1 >= need))
            up = u + a < v + c
            u, v = u[up], v[up]
            if len(u):
                x, y = u + a, v + c
                first = np.where(big[x] == big[y], ball[x] < ball[y], big[x])
                h, g = np.where(first, x, y), np.where(first, y, x)
                loose = big[h] | several[x] | several[y]
                low, high = np.minimum(node[x], node[y]), np.maximum(node[x], node[y])
                yield np.stack([np.where(loose, ball[h], low), np.where(loose, node[g], high), left[u, v], np.where(loose, 0, need[u, v])])


def _combined(found: list[np.ndarray]) -> pa.RecordBatch:
    """A row a pair: how many shingles it shares here, and the least that is left after one of them."""
    x, y, left, need = np.concatenate(found, axis=1)
    order = np.lexsort((need, y, x))
    x, y, left, need = x[order], y[order], left[order], need[order]
    at = np.concatenate(([0], np.flatnonzero((x[1:] != x[:-1]) | (y[1:] != y[:-1]) | (need[1:] != need[:-1])) + 1))
    shared = np.diff(np.concatenate((at, [len(x)])))
    return pa.RecordBatch.from_arrays([pa.array(c) for c in (x[at], y[at], shared, np.minimum.reduceat(left, at), need[at])], names=["x", "y", "shared", "left", "need"])


def candidates(docs: DataFrame, nodes: DataFrame, counts: np.ndarray, k: int = K) -> DataFrame:
    """Distinct (host, guest) of nodes(node, n, ball, several, multi, big, parity): balls and the sets outside them that may be similar to one inside."""
    shift = np.uint64(64 - SKETCH_BITS)
    usual = int(counts.mean()) if len(counts) else 0
    long_ones = 1 + np.maximum(0, counts - 2 * usual) // CELL_ROWS
    order = np.argsort(np.argsort(counts, kind="stable"), kind="stable") >> max(0, SKETCH_BITS - 16)
    # 2 ** SKETCH_BITS values each
    sketch = docs.sparkSession.sparkContext.broadcast((order.astype(np.uint16), long_ones.astype(np.int32)))

    def prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = sketch.value[0]
        for b in batches:
            out, sizes = [], []
            for text in _binary(b, "text"):
                s = shingle_set(text.as_py(), k)
                sizes.append(len(s))
                keep = len(s) - (NUM * len(s) + DEN - 1) // DEN + 1 if len(s) else 0
                if keep:  # by rank, then by value: s is sorted
                    s = s[np.argsort(rank[(s >> shift).astype(np.int64)], kind="stable")[:keep]]
                out.append(s.view(np.int64))
            ends = np.cumsum([0, *map(len, out)])
            tokens = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(np.concatenate(out) if out else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(sizes, pa.int64()), tokens.cast(pa.list_(pa.int64()))], names=["node", "n", "tokens"])

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splits = sketch.value[1]
        for b in batches:
            tokens = b.column("tokens")
            flat = tokens.flatten().to_numpy(zero_copy_only=False)
            lengths = np.diff(tokens.offsets.to_numpy())
            row = np.repeat(np.arange(b.num_rows), lengths)
            pos = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            node, ball, n, several, big = (b.column(c).to_numpy(zero_copy_only=False)[row].astype(np.int64) for c in ("node", "ball", "n", "several", "big"))
            n = n | several << 30 | big << 29
            split = splits[(flat.view(np.uint64) >> shift).astype(np.int64)]
            if split.max(initial=1) > 1:  # part r of a long list goes to the cells (r, s) and (s, r) of its grid
                part = mix(node.view(np.uint64)).astype(np.uint64) % split.astype(np.uint64)
                idx = np.repeat(np.arange(len(flat)), split)
                other = np.arange(len(idx)) - np.repeat(np.cumsum(split) - split, split)
                mine = part[idx].astype(np.int64)
                cell = np.minimum(mine, other) * split[idx] + np.maximum(mine, other)
                flat, node, ball, n, pos = mix(flat[idx].view(np.uint64) ^ mix(cell.view(np.uint64))).view(np.int64), node[idx], ball[idx], n[idx], pos[idx]
            key = flat.view(np.uint64) >> np.uint64(16)  # 48 bits: lists that fall together only cost time
            place = (n << 32) | pos
            for lo in range(0, len(flat), 200_000):
                p = slice(lo, lo + 200_000)
                yield pa.RecordBatch.from_arrays([pa.array(key[p].view(np.int64)), pa.array(node[p]), pa.array((node - ball)[p]), pa.array(place[p])], names=["key", "node", "above", "place"])

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None
        found: list[np.ndarray] = []
        held = [0]

        def done(cols: list[np.ndarray], upto: int) -> Iterator[pa.RecordBatch]:
            key, node, above, place = (c[:upto] for c in cols)
            if not len(key):
                return
            ball, n, pos, several, big = node - above, place >> 32 & 0x1FFFFFFF, place & 0xFFFFFFFF, place >> 62 & 1 > 0, place >> 61 & 1 > 0
            cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
            starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(key)]))
            many = np.flatnonzero(ends - starts > 1)
            for i in many.tolist():
                part = slice(starts[i], ends[i])
                if (ball[part] == ball[starts[i]]).all():
                    continue
                for some in _list_pairs(ball[part], node[part], n[part], pos[part], several[part], big[part]):
                    found.append(some)
                    held[0] += some.shape[1]
                    if held[0] > 500_000:
                        yield _combined(found)
                        found.clear()
                        held[0] = 0

        for b in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            if rest is not None:
                cols = [np.concatenate(x) for x in zip(rest, cols)]
            if not len(cols[0]):
                continue
            same = cols[0] == cols[0][-1]
            first = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            yield from done(cols, first)
            rest = [c[first:] for c in cols]
        if rest is not None:
            yield from done(rest, len(rest[0]))
        if found:
            yield _combined(found)

    table = docs.select("doc_id", "text").mapInArrow(prefix, "node long, n long, tokens array<long>")
    table = table.join(nodes.select("node", "ball", "several", "big").hint("shuffle_hash"), "node").select("node", "ball", "n", "several", "big", "tokens")
    spread = table.mapInArrow(cells, "key long, node long, above long, place long")
    spread = spread.repartition("key").sortWithinPartitions("key")
    pairs = spread.mapInArrow(lists, "x long, y long, shared long, left long, need long")
    # all shared shingles of two sets up to the last one found are in both prefixes: the overlap is at most their number and what is left
    pairs = pairs.groupBy("x", "y", "need").agg(F.sum("shared").alias("shared"), F.min("left").alias("left"))
    pairs = materialize(pairs.filter("shared + left >= need").select("x", "y", "need"), "pairs")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total = b.column("x_n").to_numpy() + b.column("y_n").to_numpy()
            most = total - 2 * b.column("need").to_numpy()
            least = [least_difference(x, y) for x, y in zip(b.column("x_parity").to_pylist(), b.column("y_parity").to_pylist())]
            yield b.select(["x", "x_ball", "x_multi", "y", "y_ball", "y_multi"]).filter(pa.array(np.array(least, np.int64) <= most))

    side = lambda c: nodes.select(F.col("node").alias(c), *[F.col(k).alias(f"{c}_{k}") for k in ("ball", "multi", "n", "parity")])
    tight = pairs.filter("need > 0").join(side("x"), "x").join(side("y"), "y")
    tight = tight.mapInArrow(near, "x long, x_ball long, x_multi boolean, y long, y_ball long, y_multi boolean")
    x_hosts = F.when(F.col("x_multi") == F.col("y_multi"), F.col("x_ball") < F.col("y_ball")).otherwise(F.col("x_multi"))
    tight = tight.select(F.when(x_hosts, F.col("x_ball")).otherwise(F.col("y_ball")).alias("host"), F.when(x_hosts, F.col("y")).otherwise(F.col("x")).alias("guest"))
    return tight.union(pairs.filter("need = 0").select("x", "y")).distinct()


def sets_of(docs: DataFrame, ids: DataFrame, k: int = K) -> DataFrame:
    """node, set of the documents whose ids are listed, and of a few more.

    A bitmap of hashed ids, 16 MB at most, keeps most other texts from being shingled and moved.
    """
    bits = min(27, max(20, int(ids.count() * 32).bit_length()))
    spot = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << bits))
    words = ids.select(spot("node").alias("b")).groupBy(F.shiftright("b", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, int(b & 63)))").alias("m"))
    known = np.zeros(1 << bits - 6, np.int64)
    for part in words.toArrow().to_batches():  # 2 ** (bits - 6) words at most
        known[part.column("w").to_numpy()] = part.column("m").to_numpy()
    known = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = known.value
        for b in batches:
            spots = b.column("spot").to_numpy(zero_copy_only=False).astype(np.int64)
            hit = (table[spots >> 6] >> (spots & 63) & 1).astype(bool) & b.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            if hit.any():
                some = b.filter(pa.array(hit))
                sets = [shingle_set(t.as_py(), k).tobytes() for t in _binary(some, "text")]
                yield pa.RecordBatch.from_arrays([some.column("doc_id").cast(pa.int64()), pa.array(sets, pa.binary())], names=["node", "set"])

    asked = docs.select("doc_id", "text", spot("doc_id").alias("spot")).mapInArrow(run, "node long, set binary")
    return asked


def _common(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many values each of the sets a shares with each of the sets b."""
    value, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    again = np.cumsum(times > 1) - 1
    held = times[at] > 1
    row, at = row[held], again[at[held]]
    out = np.zeros((len(a), len(b)), np.float32)
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    for lo in range(0, int(again[-1]) + 1 if len(value) else 0, 2048):
        i, j = np.searchsorted(at, [lo, lo + 2048])
        has = np.zeros((len(sets), min(2048, int(again[-1]) + 1 - lo)), np.float32)
        has[row[i:j], at[i:j] - lo] = 1
        out += has[a] @ has[b].T
    return out.astype(np.int64)


def _spread(hit: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Labels a of rows and b of columns, each lowered to the least that hits connect it with."""
    if not hit.any():
        return a, b
    rows, columns = np.flatnonzero(hit.any(1)), np.flatnonzero(hit.any(0))
    hit, x, y = hit[np.ix_(rows, columns)], a[rows], b[columns]
    while True:
        low = np.minimum(x, np.where(hit, y[None, :], _NONE).min(1))
        other = np.minimum(y, np.where(hit, low[:, None], _NONE).min(0))
        if (low == x).all() and (other == y).all():
            break
        x, y = low, other
    a, b = a.copy(), b.copy()
    a[rows], b[columns] = x, y
    return a, b


def _folded(hit: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """hit with the texts of a doc_id as one: rows and columns tell the place of each."""
    out = np.zeros((int(rows.max(initial=-1)) + 1, int(columns.max(initial=-1)) + 1), bool)
    i, j = np.nonzero(hit)
    out[rows[i], columns[j]] = True
    return out


class Cell:
    """Sets of a ball, held as what they have less and more than the leader's base, and the ball's guests."""

    def __init__(self, key: tuple[int, int, int, int], base: np.ndarray):
        self.key, self.base = key, base
        self.texts: list[tuple[int, int]] = []  # node, part
        self.less: list[np.ndarray] = []
        self.more: list[np.ndarray] = []
        self.nodes: np.ndarray | None = None

    def add(self, node: int, part: int, s: np.ndarray) -> None:
        self.texts.append((node, part))
        self.less.append(np.setdiff1d(self.base, s, assume_unique=True))
        self.more.append(np.setdiff1d(s, self.base, assume_unique=True))

    def within(self) -> list[tuple[int, int, int | None]]:
        """node, links, least connected node, of the links inside the ball."""
        node, part = np.array(self.texts, np.int64).reshape(-1, 2).T
        self.nodes, self.place = np.unique(node, return_inverse=True)
        self.less_n, self.more_n = np.array([len(x) for x in self.less]), np.array([len(x) for x in self.more])
        self.label = self.nodes.copy()
        _, lo, hi, salt = self.key
        a, b = np.flatnonzero(part == lo), np.flatnonzero(part == hi)
        if salt or not len(a) or not len(b) or len(self.nodes) < 2:
            return []
        n = len(self.base) - self.less_n + self.more_n
        both = len(self.base) - self.less_n[a][:, None] - self.less_n[b][None, :] + _common(self.less, a, b) + _common(self.more, a, b)
        hit = similar(n[a][:, None], n[b][None, :], both)
        size = len(self.nodes)
        whole = np.zeros((size, size), bool)
        i, j = np.nonzero(hit)
        whole[self.place[a[i]], self.place[b[j]]] = True
        np.fill_diagonal(whole, False)
        links = whole.sum(1) if lo == hi else whole.sum(1) + whole.sum(0)
        x, y = _spread(whole, self.label, self.label)
        self.label = np.minimum(x, y)
        return [(int(v), int(c), int(low) if low < v else None) for v, c, low in zip(self.nodes, links, self.label) if c]

    def meet(self, guests: list[tuple[int, np.ndarray]]) -> list[tuple[int, int, int | None]]:
        """node, links, least connected node, of the links between the ball and guests."""
        sets = [s for _, s in guests]
        names, place = np.unique(np.array([g for g, _ in guests], np.int64), return_inverse=True)
        k, m = len(self.less), len(sets)
        size = np.array([len(s) for s in sets])
        # the leader's overlap with each guest; each other set's follows from its difference
        base = np.array([len(np.intersect1d(self.base, s, assume_unique=True)) for s in sets])
        a, b = np.arange(k), np.arange(k, k + m)
        both = base[None, :] - np.zeros((k, 1), np.int64)
        if self.less_n.any():
            both = both - _common([*self.less, *sets], a, b)
        if self.more_n.any():
            both = both + _common([*self.more, *sets], a, b)
        n = len(self.base) - self.less_n + self.more_n
        hit = _folded(similar(n[:, None], size[None, :], both), self.place, place)
        before = self.label
        self.label, label = _spread(hit, self.label, names)
        out = [(int(v), int(c), int(low) if low < v else None) for v, c, low in zip(names, hit.sum(0), label) if c]
        links = hit.sum(1)
        return out + [(int(v), int(c), int(low) if low < v and low != old else None) for v, c, low, old in zip(self.nodes, links, self.label, before) if c or low != old]


def links(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, k: int = K, part_rows: int = PART_ROWS, guest_rows: int = GUEST_ROWS) -> DataFrame:
    """node, links, other: partial counts of links, and edges that connect what links connect.

    nodes(node, ball, n) and pairs(host, guest); every two sets of a ball, and every set of a host and its guest, are compared.
    """
    guests = pairs.groupBy(F.col("host").alias("ball")).agg(F.count(F.lit(1)).alias("guests"))
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / part_rows), F.ceil(8 * F.sum("n") / PART_BYTES)).cast("int")
    dealt = nodes.groupBy("ball").agg(F.count(F.lit(1)).alias("size"), parts.alias("parts")).join(guests, "ball", "left")
    dealt = dealt.filter("size > 1 or guests is not null")
    dealt = materialize(dealt.select("ball", "parts", F.greatest(F.lit(1), F.ceil(F.coalesce("guests", F.lit(0)) / guest_rows)).cast("int").alias("salts")), "dealt")
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    upto = lambda low, end: F.sequence(low, end - 1)
    salted = lambda t: t.withColumn("salt", F.explode(upto(F.lit(0), F.when(F.col("lo") == F.col("hi"), F.col("salts")).otherwise(F.lit(1)))))
    columns = ["node", "ball", "lo", "hi", "salt", "role", "part"]
    leaders = dealt.withColumn("node", F.col("ball")).withColumn("lo", F.explode(upto(F.lit(0), F.col("parts"))))
    leaders = salted(leaders.withColumn("hi", F.explode(upto(F.col("lo"), F.col("parts"))))).withColumn("role", F.lit(0)).withColumn("part", own)
    members = nodes.filter("node <> ball").join(dealt, "ball").withColumn("part", own).withColumn("other", F.explode(upto(F.lit(0), F.col("parts"))))
    members = salted(members.withColumn("lo", F.least("part", "other")).withColumn("hi", F.greatest("part", "other"))).withColumn("role", F.lit(1))
    strangers = pairs.select(F.col("guest").alias("node"), F.col("host").alias("ball")).join(dealt, "ball")
    strangers = strangers.withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int")).withColumn("lo", F.explode(upto(F.lit(0), F.col("parts"))))
    strangers = strangers.withColumn("hi", F.col("lo")).withColumn("role", F.lit(2)).withColumn("part", F.lit(-1))
    routes = materialize(leaders.select(*columns).union(members.select(*columns)).union(strangers.select(*columns)), "routes")
    sets = sets_of(docs, materialize(routes.select("node").distinct(), "asked"), k)
    met = routes.join(sets, "node").select("ball", "lo", "hi", "salt", "role", "node", "part", "set")
    met = met.repartition("ball", "lo", "hi", "salt").sortWithinPartitions("ball", "lo", "hi", "salt", "role", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell: Cell | None = None
        waiting: list[tuple[int, np.ndarray]] = []
        held = 0
        out = lambda found: pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["node", "links", "other"])

        def done() -> list:
            found = [] if cell.nodes is not None else cell.within()
            if waiting:
                found += cell.meet(waiting)
                waiting.clear()
            return found

        for b in batches:
            found: list = []
            for ball, lo, hi, salt, role, node, part, s in zip(*(b.column(c).to_pylist() for c in ("ball", "lo", "hi", "salt", "role", "node", "part")), b.column("set"), strict=True):
                key, values = (ball, lo, hi, salt), np.frombuffer(s.as_buffer(), np.uint64)
                if cell is None or cell.key != key:
                    if cell is not None:
                        found += done()
                    cell, held = Cell(key, values.copy()), 0
                if role == 2:
                    if waiting and waiting[-1][0] != node and (len(waiting) >= _BATCH_ROWS or held > _BATCH_BYTES):
                        found += done()
                        held = 0
                    waiting.append((node, values.copy()))
                    held += values.nbytes
                elif role or part in (lo, hi):
                    cell.add(node, part, values)
            if found:
                yield out(found)
        if cell is not None and (found := done()):
            yield out(found)

    return met.mapInArrow(run, "node long, links long, other long")


def components(edges: DataFrame) -> DataFrame:
    """node, label for edges (x, y): label is the smallest node of its component; only nodes with an edge."""
    e = materialize(edges.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).filter("u <> v").distinct(), "edges")
    state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    while state[0]:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select("v", "m").union(low.select(F.col("u"), "m")).toDF("u", "v").filter("u <> v")
        new = materialize(small.distinct(), "edges")
        after = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        e, done = new, after == state
        state = after
        if done:
            break
    return e.groupBy("u").agg(F.min("v").alias("label")).select(F.col("u").alias("node"), "label")


def join(docs: DataFrame, k: int = K, part_rows: int = PART_ROWS, guest_rows: int = GUEST_ROWS, big_ball: int = BIG_BALL) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id (smallest doc_id with an equal set), n_links of every row of docs."""
    both = materialize(signatures(docs, k), "signatures")
    rows = both.filter("block is null").select("doc_id", "n", "digest", "mins", "parity")
    classes = rows.filter("n > 0").groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("mins").alias("mins"), F.first("parity").alias("parity"))
    classes = materialize(classes.filter("node is not null"), "classes")
    # a doc_id with several texts is in no ball
    several = rows.filter("n > 0").groupBy("doc_id").agg((F.min("digest") != F.max("digest")).alias("several")).filter("several").select(F.col("doc_id").alias("node"))
    several = materialize(several.filter("node is not null"), "several")
    led = balls(classes.join(several, "node", "left_anti"))
    sizes = led.groupBy("ball").agg((F.count(F.lit(1)) + 1).alias("size"))
    nodes = classes.groupBy("node").agg(F.sum("n").alias("n"), F.first("parity").alias("parity")).join(led, "node", "left").join(several.withColumn("several", F.lit(True)), "node", "left")
    nodes = nodes.withColumn("ball", F.coalesce("ball", "node")).join(sizes, "ball", "left")
    nodes = nodes.select("node", "n", "parity", "ball", F.coalesce("several", F.lit(False)).alias("several"), F.col("size").isNotNull().alias("multi"), F.coalesce(F.col("size") >= big_ball, F.lit(False)).alias("big"))
    nodes = materialize(nodes, "nodes")
    pairs = materialize(candidates(docs, nodes, _sketch(both.filter("block is not null").select("block", "counts")), k), "guests")
    found = materialize(links(docs, nodes, pairs, k, part_rows, guest_rows), "links")
    n_links = found.groupBy("node").agg(F.sum("links").alias("n_links"))
    edges = found.filter("other is not null").select(F.col("node").alias("x"), F.col("other").alias("y"))
    # a doc_id ties the classes of its texts
    texts = rows.join(several.toDF("doc_id"), "doc_id").join(classes.select("digest", "node"), "digest").select("doc_id", "node")
    ties = texts.join(texts.groupBy("doc_id").agg(F.min("node").alias("low")), "doc_id").filter("node <> low").select("node", "low")
    final = nodes.select("node").join(components(edges.union(ties)), "node", "left").join(n_links, "node", "left")
    final = final.select("node", F.coalesce("label", "node").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))
    named = classes.select("digest", "node").join(final, "node").withColumnRenamed("node", "class_id")
    out = rows.filter("n > 0").select("doc_id", "n", "digest").join(named, "digest", "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("class_id", "doc_id").alias("class_id"), "n_links")
    empty = rows.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.col("doc_id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links"))
    return out.unionByName(empty)
