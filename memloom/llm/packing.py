"""Packing documents into training sequences by cutting-stock column generation.

A document's ids are cut into full sequences and one rest. Rests are counted by length class (WIDTH tokens wide).
A linear program chooses how often to use each pattern of classes that fits a sequence; new patterns (columns) come
from a knapsack dynamic program over the duals until none has a reduced cost below zero. Pattern counts are rounded
down, what is left is packed first-fit over the classes, and the pieces of a class, ranked by a stable order, are
dealt to the places that the patterns have for it.

Only the histogram (at most CAPACITY / WIDTH classes) and the patterns reach the driver; ranks are made in two levels
so no class, however common, is ranked by one task.

Edge cases: null text is the empty text, whose only id is the end id; rows that repeat a doc_id are documents of
their own and all packed; ids longer than a sequence are cut at multiples of CAPACITY; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

CAPACITY = 2048
WIDTH = 16
END_ID = 1
#: Column generation ends when it is this close to the optimum, as a share.
GAP = 1e-3
TOKENIZER = "byte_bpe_50k.json"
#: Rows ranked together, roughly.
RANK_ROWS = 50_000
_CACHE_ENTRIES = 800_000

_SPLIT_UNSAFE = re.compile(r"\s\s")
_SAFE_BREAK = re.compile(r"(?<=\S)(?= )")


class _Known(dict):
    """A piece's ids, encoded when first asked for; those of long pieces are not remembered, so the entries bound the bytes."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        ids = self.encode(piece)
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= 64:
            self[piece] = packed
        return packed


class Encoder:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes.

    The tokenizer's pre-tokens never reach across a white-space character that follows another character, so the
    ids of a text are the concatenated ids of its pieces there; pieces are encoded once and remembered. Pieces go
    through the same vocabulary given as ranks, which is several times faster for short strings.
    """

    _shared: dict[str, Encoder] = {}

    def __init__(self, path: str):
        import base64

        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path.removesuffix(".json") + ".tiktoken", "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.ranked = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.known = _Known(self.ranked.encode_ordinary)

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._shared:
            cls._shared[path] = cls(path)
        return cls._shared[path]

    def encode(self, text: str) -> bytes:
        if "<|" in text:  # a special token's string is matched across pieces
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if "\x00" in text or _SPLIT_UNSAFE.search(text):
            pieces = _SAFE_BREAK.split(text)
        else:
            pieces = text.replace("\n", "\x00\n").replace(" ", "\x00 ").split("\x00")
        if len(self.known) > _CACHE_ENTRIES:
            self.known.clear()
        return b"".join(map(self.known.__getitem__, pieces))


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces_of(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of each piece. path: the tokenizer's file on every machine."""
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())]
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path or tokenizer_path())
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                ids = encoder.encode(text.as_py() or "") + end
                n = len(ids) // 4
                for at in range(0, n, capacity):
                    part = ids[4 * at : 4 * (at + capacity)]
                    rows.append((doc_id, at, len(part) // 4, zlib.crc32(part), n))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), fields)], names=[n for n, _ in fields])

    return docs.select("doc_id", "text").mapInArrow(cut, ", ".join(f"{n} long" for n, _ in fields))


def _best_pattern(value: np.ndarray, sizes: np.ndarray, room: int) -> np.ndarray:
    """The knapsack's most valuable pattern: how often each size (ascending) is used, all within room."""
    best, last = np.zeros(room + 1), np.full(room + 1, -1)
    ends = np.searchsorted(sizes, np.arange(room + 1), side="right")
    for r in range(int(sizes[0]), room + 1):
        n = ends[r]
        gain = best[r - sizes[:n]] + value[:n]
        i = int(gain.argmax())
        if gain[i] > best[r - 1] + 1e-12:
            best[r], last[r] = gain[i], i
        else:
            best[r] = best[r - 1]
    use, r = np.zeros(len(sizes)), room
    while r > 0:
        if last[r] < 0:
            r -= 1
        else:
            use[last[r]] += 1
            r -= int(sizes[last[r]])
    return use


def column_generation(sizes: np.ndarray, demand: np.ndarray, room: int, rounds: int = 1500) -> tuple[np.ndarray, np.ndarray]:
    """(patterns as columns, how often to use each) of the linear program min sum x, patterns @ x = demand, x >= 0.

    Revised simplex: the basis starts with one pattern a size. A round prices one column. The rounds are bounded, and
    rounding may drift; counts are made whole against the true demand afterwards, so only padding could suffer.
    """
    basis = np.diag((room // sizes).astype(float))
    inverse = np.diag(1.0 / np.diag(basis))
    x = inverse @ demand
    for _ in range(rounds):
        duals = inverse.sum(0)
        column = _best_pattern(duals, sizes, room)
        if column @ duals <= 1 + GAP:  # the optimum is no less than sum(x) / (column @ duals)
            break
        d = inverse @ column
        enters = d > 1e-10
        if not enters.any():
            break
        ratio = np.where(enters, x / np.where(enters, d, 1.0), np.inf)
        leave = int(ratio.argmin())
        basis[:, leave] = column
        step = max(ratio[leave], 0.0)
        x = x - step * d
        x[leave] = step
        pivot = inverse[leave] / d[leave]
        inverse = inverse - np.outer(d, pivot)
        inverse[leave] = pivot
    return basis, np.maximum(x, 0.0)


def plan_patterns(sizes: np.ndarray, demand: np.ndarray, room: int) -> list[tuple[np.ndarray, int]]:
    """Patterns with whole counts that hold exactly demand pieces of each size."""
    basis, x = column_generation(sizes, demand.astype(float), room)
    left = demand.astype(np.int64).copy()
    plan: list[tuple[np.ndarray, int]] = []
    for j in np.argsort(-x, kind="stable"):
        use = np.rint(basis[:, j]).astype(np.int64)
        held = use > 0
        n = int(min(np.floor(x[j] + 1e-6), *(left[held] // use[held]))) if held.any() else 0
        if n > 0:
            plan.append((use, n))
            left -= n * use
    while left.any():  # what rounding left: fill one sequence largest first, as often as the pieces allow
        use, space = np.zeros(len(sizes), np.int64), room
        for i in np.argsort(-sizes, kind="stable"):
            n = min(int(left[i]), space // int(sizes[i]))
            use[i], space = n, space - n * int(sizes[i])
        held = use > 0
        n = int((left[held] // use[held]).min())
        plan.append((use, n))
        left -= n * use
    return plan


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, width: int = WIDTH, end_id: int = END_ID) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    pieces = materialize(pieces_of(docs, path, capacity, end_id), "pieces")
    pieces = pieces.withColumn("size", F.ceil(F.col("length") / width).cast("int"))
    counts = {r["size"]: r["n"] for r in pieces.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity / width classes at most
    if not counts:
        return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    sizes = np.array(sorted(counts))
    plan = plan_patterns(sizes, np.array([counts[s] for s in sizes]), capacity // width)
    first, base, ranks = [], 0, dict.fromkeys(sizes.tolist(), 0)
    for use, n in plan:
        place = 0
        for s, u in zip(sizes.tolist(), use.tolist(), strict=True):
            if u:  # ranks from .. to of class s go to sequences base .., u to each, from place on
                first.append((s, ranks[s], ranks[s] + n * u, base, u, place))
                ranks[s] += n * u
                place += u
        base += n
    dealt = spark.createDataFrame(first, "c_size int, lo long, hi long, base long, each long, place long")
    groups = max(1, sum(counts.values()) // RANK_ROWS)
    key = F.pmod(F.xxhash64("doc_id", "start"), F.lit(groups)).cast("int")
    p = pieces.withColumn("g", key)
    heads = p.groupBy("size", "g").agg(F.count(F.lit(1)).alias("n"))
    run = Window.partitionBy("size").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select(F.col("size").alias("h_size"), F.col("g").alias("h_g"), F.coalesce(F.sum("n").over(run), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("size", "g").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    p = p.withColumn("r", F.row_number().over(within) - 1).join(heads, (F.col("size") == F.col("h_size")) & (F.col("g") == F.col("h_g")))
    p = p.withColumn("rank", F.col("r") + F.col("ahead"))
    # a few rows a pattern, at most (classes + leftovers) ** 2: bounded by the capacity, not the data
    p = p.join(F.broadcast(dealt), (F.col("size") == F.col("c_size")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    p = p.withColumn("sequence_id", (F.col("base") + F.floor((F.col("rank") - F.col("lo")) / F.col("each"))).cast("long"))
    p = p.withColumn("slot", F.col("place") + (F.col("rank") - F.col("lo")) % F.col("each"))
    before = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    p = p.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long"))
    return p.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
