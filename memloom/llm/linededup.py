"""Line dedup: repeated passages of two or more lines go, wherever they stand.

dedup_runs, which the query and the pipeline use, takes every pair of neighbouring lines (one with a word) as a chunk.
All pairs of a repeated run repeat, so a run goes as a whole whatever surrounds it; lines without a word between two
such pairs go with them. The globally first occurrence of a line always stays, as a pair before it would hold it.

dedup_lines cuts content-defined chunks: a rolling hash over the hashes of RUN neighbouring lines ends a chunk wherever
it is 0 modulo DIVISOR. Chunks at the edges of a shared passage depend on foreign lines, so it misses most short runs.

In both, a chunk that occurs again anywhere is removed, except its first occurrence (smallest doc_id, then smallest hash of
the text, then first in the text), after a comparison with that occurrence's bytes. The lines of that occurrence stay, also
where another chunk that goes overlaps it, so each repeated chunk stays whole in one place. SQL expressions only.

Only hashes, ids and line numbers are grouped over the corpus; texts move twice, by document, to meet its repeated chunks
and then what goes; only the repeated chunks' texts are shuffled for the comparison. The first move's shuffle files go
before the second begins, so the disk holds one copy of the texts at a time.

Edge cases: null text is one empty line and stays null; texts of one line are never changed; rows that repeat
doc_id and text, or text without a doc_id, are one document and keep the same lines; different texts under one doc_id,
or without one, are documents of their own; a null doc_id counts as the smallest; extra columns are kept; empty tables
give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, let, materialize

RUN = 2
DIVISOR = 4
_CHUNK = "array<struct<s:int,e:int,hash:bigint>>"


def chunks(text: Column, divisor: int = DIVISOR) -> Column:
    """Chunks of two or more lines: first and last line (from 0) and a hash of the lines' hashes."""

    def of_lines(lines: Column) -> Column:
        return let(F.transform(lines, lambda x: F.xxhash64(x)), lambda h: let(ends(h), lambda e: cut(lines, h, e)))

    def ends(h: Column) -> Column:
        last = F.size(h) - 1
        roll = lambda i: F.xxhash64(*[F.get(h, i - k) for k in range(RUN)])
        return F.filter(F.sequence(F.lit(0), last), lambda i: (i == last) | ((i >= RUN - 1) & (F.pmod(roll(i), F.lit(divisor)) == 0)))

    def cut(lines: Column, h: Column, e: Column) -> Column:
        start = lambda k: F.coalesce(F.get(e, k - 1) + 1, F.lit(0))
        all_of = F.transform(e, lambda x, k: F.struct(start(k).alias("s"), x.alias("e"), F.xxhash64(F.slice(h, start(k) + 1, x - start(k) + 1)).alias("hash")))
        full = lambda c: (c["e"] > c["s"]) & F.exists(F.slice(lines, c["s"] + 1, c["e"] - c["s"] + 1), lambda x: x.rlike(WORD))
        return F.filter(all_of, full)

    return F.when(text.contains("\n"), let(F.split(text, "\n", -1), of_lines)).otherwise(F.array().cast(_CHUNK))


def pairs(text: Column) -> Column:
    """Every two neighbouring lines of which one has a word, in the form of chunks."""

    def of_lines(lines: Column) -> Column:
        return let(F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("h"), x.rlike(WORD).alias("w"))), of_hashes)

    def of_hashes(h: Column) -> Column:
        pair = lambda i: F.struct(i.alias("s"), (i + 1).alias("e"), F.xxhash64(F.get(h, i)["h"], F.get(h, i + 1)["h"]).alias("hash"))
        worded = F.filter(F.sequence(F.lit(0), F.size(h) - 2), lambda i: F.get(h, i)["w"] | F.get(h, i + 1)["w"])
        return F.transform(worded, pair)

    return F.when(text.contains("\n"), let(F.split(text, "\n", -1), of_lines)).otherwise(F.array().cast(_CHUNK))


def _merged(spans: Column, lines: Column) -> Column:
    """Sorted spans that overlap, or have no word between them, as one."""

    def parted(x: Column, y: Column) -> Column:
        between = F.slice(lines, x["e"] + 2, F.greatest(y["s"] - x["e"] - 1, F.lit(0)))
        return F.exists(between, lambda t: t.rlike(WORD))

    firsts = F.filter(spans, lambda y, k: (k == 0) | parted(F.get(spans, k - 1), y))
    lasts = F.filter(spans, lambda x, k: (k == F.size(spans) - 1) | parted(x, F.get(spans, k + 1)))
    return F.zip_with(firsts, lasts, lambda x, y: F.struct(x["s"].alias("s"), y["e"].alias("e")))


def _spared(spans: Column, held: Column) -> Column:
    """Sorted spans without the lines that spans in held cover."""
    numbers = lambda of: F.flatten(F.transform(of, lambda x: F.sequence(x["s"], x["e"])))

    def again(left: Column) -> Column:
        firsts = F.filter(left, lambda x, k: (k == 0) | (F.get(left, k - 1) != x - 1))
        lasts = F.filter(left, lambda x, k: (k == F.size(left) - 1) | (F.get(left, k + 1) != x + 1))
        return F.zip_with(firsts, lasts, lambda x, y: F.struct(x.alias("s"), y.alias("e")))

    return F.when(F.size(held) == 0, spans).otherwise(let(F.array_except(numbers(spans), numbers(held)), again))


def _without(text: Column, gone: Column) -> Column:
    """text without the line spans in gone, which is sorted."""
    start = lambda k: F.coalesce(F.get(gone, k - 1)["e"] + 1, F.lit(0))

    def pieces(lines: Column) -> Column:
        heads = F.transform(gone, lambda g, k: F.slice(lines, start(k) + 1, g["s"] - start(k)))
        tail = F.slice(lines, start(F.size(gone)) + 1, F.size(lines))
        return F.array_join(F.concat(F.flatten(heads), tail), "\n")

    return let(F.split(text, "\n", -1), pieces)


def dedup_lines(docs: DataFrame, text: str = "text", divisor: int = DIVISOR) -> DataFrame:
    """docs with repeated content-defined chunks cut out of text, plus n_lines and n_removed_lines."""
    return _dedup(docs, text, lambda t: chunks(t, divisor), lambda spans, lines: spans)


def dedup_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with all repeated runs of two or more lines cut out of text, plus n_lines and n_removed_lines."""
    return _dedup(docs, text, pairs, lambda spans, lines: let(lines, lambda ls: _merged(spans, ls)))


def _dedup(docs: DataFrame, text: str, cut_up: Callable[[Column], Column], merge: Callable[[Column, Column], Column]) -> DataFrame:
    names = docs.columns
    whole = F.coalesce(F.col(f"row.`{text}`"), F.lit(""))
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    base = base.select("row", F.coalesce(F.col("row.doc_id"), F.lit(0)).alias("k"), F.col("row.doc_id").isNull().alias("nil"), F.xxhash64(whole).alias("th"))
    own = ["k", "nil", "th"]
    cut = materialize(base.select(*own, F.inline(cut_up(whole))), "chunks")
    order = F.when(F.col("nil"), F.lit(None)).otherwise(F.col("k"))
    found = cut.groupBy("hash", (F.col("e") - F.col("s")).alias("n")).agg(F.count(F.lit(1)).alias("times"), F.max("nil").alias("any_nil"), F.min(order).alias("first"))
    found = found.filter("times > 1").select(F.col("hash").alias("fh"), F.col("n").alias("fn"), F.when(F.col("any_nil"), F.lit(None)).otherwise(F.col("first")).alias("first"))
    hits = cut.join(found, (F.col("hash") == F.col("fh")) & (F.col("e") - F.col("s") == F.col("fn")))
    hits = hits.groupBy(*own).agg(F.array_sort(F.array_distinct(F.collect_list(F.struct("hash", (F.col("e") - F.col("s")).alias("n"), "s", "e", "first")))).alias("hits"))  # bounded by the document
    hits = hits.withColumnsRenamed({c: f"h_{c}" for c in own})
    with_hits = base.join(hits, (F.col("k") == F.col("h_k")) & (F.col("nil") == F.col("h_nil")) & (F.col("th") == F.col("h_th")), "left").filter("hits is not null")
    lines = F.split(whole, "\n", -1)
    before = lambda i: F.get("hits", i - 1)
    leads = lambda x, i: (i == 0) | (before(i)["hash"] != x["hash"]) | (before(i)["n"] != x["n"])
    texts = let(lines, lambda ls: F.transform("hits", lambda x, i: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["hash"].alias("hash"), (leads(x, i) & x["first"].eqNullSafe(order)).alias("leads"), F.array_join(F.slice(ls, x["s"] + 1, x["e"] - x["s"] + 1), "\n").alias("bytes"))))
    texts = materialize(with_hits.select(*own, F.inline(texts)), "repeats", release=True)
    size = F.col("e") - F.col("s")
    kept = texts.filter("leads").groupBy(F.col("hash").alias("kh"), size.alias("kn")).agg(F.min("th").alias("kept_by"), F.min_by("bytes", "th").alias("kept"))
    marks = texts.join(kept, (F.col("hash") == F.col("kh")) & (size == F.col("kn")) & (F.col("bytes") == F.col("kept")))
    marks = marks.select(*own, "s", "e", (F.col("leads") & (F.col("th") == F.col("kept_by"))).alias("stays"))
    spans = lambda which: F.array_sort(F.array_distinct(F.collect_list(F.when(which, F.struct("s", "e")))))
    gone = marks.groupBy(*own).agg(spans(~F.col("stays")).alias("gone"), spans(F.col("stays")).alias("held")).filter(F.size("gone") > 0)  # bounded by the document
    gone = gone.withColumnsRenamed({c: f"g_{c}" for c in own})
    out = base.join(gone, (F.col("k") == F.col("g_k")) & (F.col("nil") == F.col("g_nil")) & (F.col("th") == F.col("g_th")), "left")
    out = out.select("row", F.when(F.col("gone").isNotNull(), _spared(merge(F.col("gone"), lines), F.col("held"))).alias("gone"))
    n_gone = F.coalesce(F.aggregate("gone", F.lit(0), lambda a, g: a + g["e"] - g["s"] + 1), F.lit(0))
    new = F.when(F.col("gone").isNull(), F.col(f"row.{text}")).otherwise(_without(whole, F.col("gone")))
    return out.select(*[new.alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in names], F.size(lines).cast("bigint").alias("n_lines"), n_gone.cast("bigint").alias("n_removed_lines"))
