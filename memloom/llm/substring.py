"""Substring dedup of word windows by super-k-mer partitioning.

A window is WINDOW consecutive words of a document. Consecutive windows whose smallest m-mer (minimiser: M words, by
hash, leftmost on ties) stands at the same place form a super-k-mer. Equal windows have equal minimisers, so a
minimiser that only one super-k-mer has rules its windows out; the others travel, each as one packed string, to their
minimiser's bucket. Equal strings are counted before they move; a bucket's windows are then sorted and counted
exactly, by their bytes. Words covered by a window that occurs twice or more anywhere are removed.

A bucket with more than HOT bytes of distinct strings is split by a second minimiser of longer m-mers (the next of
MS, another hash), and so on: its windows become super-k-mers again, of which those of one second minimiser are sorted
and counted in a bucket of their own. The last of MS is the window itself, whose bucket is one distinct string, so
sorting in buckets of bounded size is the one way of counting.

Edge cases: null text is the empty text; fewer words than a window: nothing is removed; rows that repeat doc_id and
text are documents of their own, so all their windows repeat; a null doc_id is like any other; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_or_empty
from .wordhash import hashes, mix, runs

WINDOW = 35
M = 8
#: Lengths of the m-mers that split crowded buckets, in turn; the window's own length comes last.
MS = (14, 22)
#: Bytes of distinct strings that a bucket sorts.
HOT = 4 << 20


def super_kmers(h: np.ndarray, window: int = WINDOW, m: int = M) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimiser, first window, windows) of each super-k-mer of a document's word hashes."""
    windows = len(h) - window + 1
    if windows <= 0:
        return h[:0], np.zeros(0, np.int64), np.zeros(0, np.int64)
    g = runs(h, m)
    span, width = window - m + 1, 1
    at = np.arange(len(g))
    left = lambda a, b: np.where(g[a] <= g[b], a, b)
    while 2 * width <= span:
        at = left(at[:-width], at[width:])
        width *= 2
    if width < span:
        at = left(at[: windows], at[span - width : span - width + windows])
    starts = np.concatenate(([0], np.flatnonzero(at[1:] != at[:-1]) + 1))
    return g[at[starts]], starts, np.diff(np.concatenate((starts, [windows])))


def repeated(strings: list[bytes], times: list[int], window: int = WINDOW) -> list[np.ndarray]:
    """Which windows of each distinct packed string occur twice or more, in a bucket of such strings."""
    seen: list[tuple[bytes, int, int]] = []
    sizes = []
    for k, s in enumerate(strings):
        ends = [i for i, c in enumerate(s) if c == 32]
        starts = [0, *(i + 1 for i in ends)]
        ends.append(len(s))
        n = len(starts) - window + 1
        sizes.append(n)
        seen += [(s[starts[i] : ends[i + window - 1]], k, i) for i in range(n)]
    seen.sort()
    flags = [np.zeros(n, bool) for n in sizes]
    i = 0
    while i < len(seen):
        j = i
        total = 0
        while j < len(seen) and seen[j][0] == seen[i][0]:
            total += times[seen[j][1]]
            j += 1
        if total > 1:
            for _, k, at in seen[i:j]:
                flags[k][at] = True
        i = j
    return flags


def _batches(rows: list[tuple], kinds: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)


def _outcome(words: list[bytes], gone: np.ndarray | None) -> tuple[int, int, str, str]:
    kept = words if gone is None else [w for w, g in zip(words, gone.tolist()) if not g]
    text = b" ".join(kept)
    return len(words), len(words) - len(kept), hashlib.sha256(text).hexdigest(), text.decode()


def dedup_substrings(docs: DataFrame, window: int = WINDOW, m: int = M, hot: int = HOT, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and text (the kept words; null unless with_text) of every row of docs."""
    plain = docs.select("doc_id", text_or_empty().alias("text")).select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [super_kmers(hashes(t.as_py().split()), window, m)[0].view(np.int64) for t in b.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(found, pa.list_(pa.int64()))], names=["row", "mins"])

    mins = materialize(plain.select("row", "text").mapInArrow(find, "row long, mins array<long>").filter(F.size("mins") > 0), "minimisers")
    each = mins.select("row", F.explode("mins").alias("mini"))
    shared = each.groupBy("mini").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("mini")
    asked = each.join(shared, "mini").groupBy("row").agg(F.collect_set("mini").alias("minis"))  # bounded by the row
    whole = plain.join(asked.withColumnRenamed("row", "r").hint("shuffle_hash"), F.col("row") == F.col("r"), "left").select("doc_id", "text", "row", "minis")
    names = ["doc_id", "row", "n_words", "n_removed", "kept_sha256", "text", "mini", "packed", "pd", "start"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.int64()]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents without a shared minimiser are done; of the others, a row with the text and one a super-k-mer."""
        for b in batches:
            rows, held = [], 0
            for doc_id, text, row, minis in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()), b.column("row").to_pylist(), b.column("minis"), strict=True):
                words = text.as_py().split()
                if not minis.is_valid:
                    n, gone, digest, kept = _outcome(words, None)
                    rows.append((doc_id, row, n, gone, digest, kept if with_text else None, None, None, None, None))
                    held += len(kept)
                else:
                    rows.append((doc_id, row, None, None, None, text.as_py().decode(), None, None, None, None))
                    mini, starts, counts = super_kmers(hashes(words), window, m)
                    take = np.flatnonzero(np.isin(mini.view(np.int64), minis.values.to_numpy()))
                    for i in take.tolist():
                        s = int(starts[i])
                        packed = b" ".join(words[s : s + int(counts[i]) + window - 1])
                        rows.append((doc_id, row, None, None, None, None, int(mini[i].view(np.int64)), packed, hashlib.md5(packed).digest(), s))
                        held += len(packed)
                if held > 8 << 20:
                    yield _batches(rows, kinds, names)
                    rows, held = [], 0
            if rows:
                yield _batches(rows, kinds, names)

    parts = materialize(whole.mapInArrow(split, "doc_id long, row long, n_words long, n_removed long, kept_sha256 string, text string, mini long, packed binary, pd binary, start long"), "parts", "zstd")
    occurrences = parts.filter("packed is not null")
    strings = materialize(occurrences.groupBy("mini", "pd", "packed").agg(F.count(F.lit(1)).alias("times")), "strings", "zstd")
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, []

        def done() -> list[tuple]:
            flags = repeated([x[1] for x in own], [x[2] for x in own], window)
            return [(at, x[0], np.flatnonzero(f).tolist()) for x, f in zip(own, flags) if f.any()]

        for b in batches:
            rows = []
            for mini, pd, packed, times in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if mini != at:
                    if own:
                        rows += done()
                    at, own = mini, []
                own.append((pd, packed, times))
            if rows:
                yield _batches(rows, [pa.int64(), pa.binary(), pa.list_(pa.int32())], ["mini", "pd", "hits"])
        if own and (rows := done()):
            yield _batches(rows, [pa.int64(), pa.binary(), pa.list_(pa.int32())], ["mini", "pd", "hits"])

    def split_by(level: int, m: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Strings of crowded buckets as shorter ones, each with its place (windows) in the string it comes from."""
            fields = [pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64()]
            for b in batches:
                rows, held = [], 0
                for up, upd, packed, times in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    words = packed.split(b" ")
                    second, starts, counts = super_kmers(mix(hashes(words) + np.uint64(level)), window, m)
                    keys = mix(second ^ mix(np.array([up], np.int64).view(np.uint64) + np.uint64(level))).view(np.int64)
                    for key, at, n in zip(keys.tolist(), starts.tolist(), counts.tolist()):
                        part = b" ".join(words[at : at + n + window - 1])
                        rows.append((up, upd, at, key, hashlib.md5(part).digest(), part, times))
                        held += len(part)
                    if held > 8 << 20:
                        yield _batches(rows, fields, ["up", "upd", "at", "mini", "pd", "packed", "times"])
                        rows, held = [], 0
                if rows:
                    yield _batches(rows, fields, ["up", "upd", "at", "mini", "pd", "packed", "times"])

        return run

    columns = ["mini", "pd", "packed", "times"]

    def hits_of(strings: DataFrame, level: int) -> DataFrame:
        """mini, pd, hits: which windows of each string occur twice or more."""
        crowded = None
        if level <= len(MS):
            crowded = strings.groupBy("mini").agg(F.sum(F.length("packed")).alias("c"), F.count(F.lit(1)).alias("n")).filter((F.col("c") > hot) & (F.col("n") > 1))
            crowded = materialize(crowded.select("mini"), "crowded")
            crowded = None if crowded.isEmpty() else crowded
        calm = strings if crowded is None else strings.join(crowded, "mini", "left_anti")
        found = calm.select(*columns).repartition("mini").sortWithinPartitions("mini").mapInArrow(count, "mini long, pd binary, hits array<int>")
        if crowded is None:
            return found
        longer = MS[level] if level < len(MS) else window
        parts = strings.join(crowded, "mini", "left_semi").select(*columns).mapInArrow(split_by(level + 1, min(longer, window)), "up long, upd binary, at int, mini long, pd binary, packed binary, times long")
        parts = materialize(parts, "parts", "zstd")
        shorter = materialize(parts.groupBy("mini", "pd", "packed").agg(F.sum("times").alias("times")), "strings", "zstd")
        below = parts.select("up", "upd", "at", "mini", "pd").join(hits_of(shorter, level + 1), ["mini", "pd"])
        below = below.select(F.col("up").alias("mini"), F.col("upd").alias("pd"), F.transform("hits", lambda i: i + F.col("at")).alias("hits"))
        return found.unionByName(below.groupBy("mini", "pd").agg(F.flatten(F.collect_list("hits")).alias("hits")))  # bounded by the string

    hits = hits_of(strings, 0)
    placed = occurrences.select("doc_id", "row", "mini", "pd", "start").join(hits, ["mini", "pd"])
    placed = placed.withColumn("id", F.coalesce("doc_id", F.lit(0))).withColumn("nil", F.col("doc_id").isNull())
    marks = placed.groupBy("id", "nil", "row").agg(F.collect_set(F.struct("start", "hits")).alias("marks"))  # bounded by the row
    open_rows = parts.filter("packed is null and n_words is null").select("doc_id", "row", "text")
    met = open_rows.join(marks.withColumnRenamed("row", "r").hint("shuffle_hash"), (F.col("row") == F.col("r")) & (F.coalesce("doc_id", F.lit(0)) == F.col("id")) & (F.col("doc_id").isNull() == F.col("nil")), "left")
    met = met.select("doc_id", "text", F.col("marks.start").alias("starts"), F.col("marks.hits").alias("hits"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, text, starts, hits in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()), b.column("starts").to_pylist(), b.column("hits").to_pylist(), strict=True):
                words = text.as_py().split()
                edge = np.zeros(len(words) + 1, np.int64)
                for s, h in zip(starts or (), hits or ()):
                    i = s + np.array(h)
                    np.add.at(edge, i, 1)
                    np.add.at(edge, i + window, -1)
                n, gone, digest, kept = _outcome(words, np.cumsum(edge[:-1]) > 0)
                rows.append((doc_id, n, gone, digest, kept if with_text else None))
            if rows:
                yield _batches(rows, [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()], ["doc_id", "n_words", "n_removed", "kept_sha256", "text"])

    closed = parts.filter("n_words is not null").select("doc_id", "n_words", "n_removed", "kept_sha256", "text")
    return closed.unionByName(met.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, text string"))
