"""Phrase collocations by suffix sorting (suffix-sigma).

Every word position yields the suffix that starts there, cut to max_n words and to its piece. Tasks lower-case, split and
pre-aggregate blocks of texts with numpy; equal suffixes of a block travel as one row with a count. Suffixes are dealt
by language and first word, sorted in reverse order, and one pass counts all prefixes with a stack: of the last row's
prefixes, those that the next row does not share are closed. Rows come in Arrow batches, so the pass works on whole
batches: the stack at a batch's end opens the next. The parts of each candidate are joined afterwards.

Hot words: a prefix that holds over 1 / HOT of all words (so at most HOT a length) is dealt by one word more, as
are its own hot continuations, down to the whole suffix, of which a block sends one row. Only such prefixes are counted
in parts, which are then added up. A block names a prefix when it is that common in the block, which decides
how rows are dealt and nothing else.

Only phrases with at least least_count occurrences leave the pass; the parts of such a phrase are as common, so nothing is
lost. Ratios are taken in decimals of 38 digits.

Edge cases: null text has no words; null lang is `und`; empty pieces end phrases; rows that repeat a doc_id count each;
extra columns are ignored; an empty table, or one without a candidate, gives no rows; ties are settled as `top` states.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, only

MAX_N = 4
#: A prefix with over 1 / HOT of all words is dealt by its continuations.
HOT = 1000
#: Bytes of text that a task handles together, if one text is not longer. Its arrays take about 25 times as much;
#: four times larger blocks give only 5 % fewer rows.
BLOCK = 1 << 22
UNKNOWN = "und"
_BREAK, _GAP, _LETTER = 0, 1, 2
_FOLD = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_KIND = bytes(_BREAK if chr(i) in ".,;:!?\n\x0b\x0c\r" else _GAP if chr(i) in " \t" else _LETTER for i in range(256))


class Suffixes:
    """The words of a block of texts and, for each, the up to max_n words from it to the end of its piece."""

    def __init__(self, langs: pa.Array, texts: pa.Array, max_n: int):
        texts = texts.cast(pa.large_string()).fill_null("")
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = (texts.buffers()[2] or pa.py_buffer(b""))[int(ends[0]) : int(ends[-1])].to_pybytes()
        first = np.unique((ends - ends[0])[:-1][np.diff(ends) > 0])  # where a text that is not empty begins
        kind = np.frombuffer(raw.translate(_KIND), np.uint8)  # tables of bytes, as numpy's lookups take eight bytes for each
        letter = kind == _LETTER
        start = letter.copy()
        start[1:] &= ~letter[:-1]
        start[first] = letter[first]
        at = np.flatnonzero(start)
        new_piece = kind == _BREAK
        new_piece[first] = True
        piece = np.cumsum(new_piece, dtype=np.int32)[at]
        kept = np.append(np.flatnonzero(start[letter]), int(letter.sum())).astype(np.int64)
        folded = np.frombuffer(raw.translate(_FOLD), np.uint8)[letter]
        words = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(kept), pa.py_buffer(folded)).dictionary_encode()
        del raw, kind, letter, start, new_piece, kept, folded
        order = pc.sort_indices(words.dictionary).to_numpy()
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(1, len(order) + 1)
        self.words = words.dictionary.take(pa.array(order))
        lang = langs.cast(pa.string()).fill_null(UNKNOWN).dictionary_encode()
        self.langs = lang.dictionary
        of = np.searchsorted(ends - ends[0], at, side="right") - 1
        code = rank[words.indices.to_numpy()]
        #: lang, then the ranks of the words, 0 beyond the piece's end.
        self.columns = [lang.indices.to_numpy()[of], code]
        for k in range(1, max_n):
            later = np.zeros(len(at), np.int32)
            later[:-k or None] = np.where(piece[k:] == piece[:-k], code[k:], 0) if k < len(at) else 0
            self.columns.append(later)
        self.counts = np.ones(len(at), np.int64)

    def grouped(self) -> Suffixes:
        """Equal suffixes become one, with its count, in reverse order."""
        base = len(self.words) + 1
        keys, room = [self.columns[0].astype(np.int64)], len(self.langs)
        for x in self.columns[1:]:  # as many columns in one number as fit
            if room * base < 1 << 62:
                keys[-1], room = keys[-1] * base + x, room * base
            else:
                keys, room = [*keys, x.astype(np.int64)], base
        order = np.lexsort(keys[::-1])[::-1]
        new = np.ones(len(order), bool)
        new[1:] = False
        for k in keys:
            k = k[order]
            new[1:] |= k[1:] != k[:-1]
        at = np.flatnonzero(new)
        self.counts = np.add.reduceat(self.counts[order], at) if len(at) else self.counts
        self.columns = [x[order][at] for x in self.columns]
        return self

    def prefixes(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Of grouped rows: where each prefix of n words begins, and its count."""
        new = np.ones(len(self.counts), bool)
        new[1:] = np.any([x[1:] != x[:-1] for x in self.columns[: n + 1]], axis=0)
        at = np.flatnonzero(new)
        count = np.add.reduceat(self.counts, at) if len(at) else self.counts
        whole = self.columns[n][at] > 0
        return at[whole], count[whole]

    def texts(self, at: np.ndarray, n: int) -> pa.Array:
        """The first n words of rows, each word followed by a space."""
        parts = [self.words.take(pa.array(x[at] - 1, pa.int64(), mask=x[at] == 0)) for x in self.columns[1 : n + 1]]
        return pc.binary_join_element_wise(*parts, pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string()), null_handling="skip").cast(pa.string())

    def lang_of(self, at: np.ndarray) -> pa.Array:
        return self.langs.take(pa.array(self.columns[0][at]))


def _blocks(batches: Iterator[pa.RecordBatch], max_n: int) -> Iterator[Suffixes]:
    """Grouped suffixes of texts of about BLOCK bytes, or of one text, over the batches of a task."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        lengths = pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy()
        lo = 0
        for i, n in enumerate(lengths.tolist()):
            if size and size + n > BLOCK:
                held.append(b.slice(lo, i - lo))
                yield _of(held, max_n)
                held, size, lo = [], 0, i
            size += n
        held.append(b.slice(lo))
    if held:
        yield _of(held, max_n)


def _of(held: list[pa.RecordBatch], max_n: int) -> Suffixes:
    table = pa.Table.from_batches(held)
    text = table.column("text").cast(pa.large_string()).combine_chunks()
    return Suffixes(table.column("lang").combine_chunks(), text, max_n).grouped()


def hot_prefixes(docs: DataFrame, max_n: int = MAX_N, hot: int = HOT) -> tuple[DataFrame, set[tuple[str, str]]]:
    """(lang, n) with the words of each lang, and the prefixes shorter than max_n that hold over 1 / hot of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in _blocks(batches, max_n):
            total = int(s.counts.sum())
            for n in range(max_n):
                at, count = s.prefixes(n) if n else _langs(s)
                some = count * hot > total if n else slice(None)
                at, count = at[some], count[some]
                yield pa.RecordBatch.from_arrays([s.lang_of(at), s.texts(at, n) if n else pa.array([""] * len(at)), pa.array(count)], names=["lang", "prefix", "c"])

    found = materialize(docs.mapInArrow(run, "lang string, prefix string, c long").groupBy("lang", "prefix").agg(F.sum("c").alias("c")), "prefixes")
    totals = found.filter("prefix = ''").select("lang", F.col("c").alias("n"))
    all_ = totals.agg(F.sum("n")).first()[0] or 0
    common = found.filter((F.col("prefix") != "") & (F.col("c").cast("decimal(38,0)") * hot > all_)).select("lang", "prefix")
    return totals, {(r[0], r[1]) for r in common.collect()}  # at most hot a length


def _langs(s: Suffixes) -> tuple[np.ndarray, np.ndarray]:
    new = np.ones(len(s.counts), bool)
    new[1:] = s.columns[0][1:] != s.columns[0][:-1]
    at = np.flatnonzero(new)
    return at, np.add.reduceat(s.counts, at) if len(at) else s.counts


def suffixes(docs: DataFrame, common: set[tuple[str, str]], max_n: int = MAX_N) -> DataFrame:
    """lang, suffix (each word followed by a space), depth (how many words it is dealt by) and count c."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in _blocks(batches, max_n):
            depth = np.ones(len(s.counts), np.int8)
            for n in range(1, max_n):
                at, _ = s.prefixes(n)
                # only prefixes below a common one are looked up; the first words are few
                at = at[depth[at] == n]
                hit = [i for i, key in zip(at.tolist(), zip(s.lang_of(at).to_pylist(), s.texts(at, n).to_pylist())) if key in common] if len(at) else []
                if not hit:
                    break
                new = np.zeros(len(depth), bool)
                new[1:] = np.any([x[1:] != x[:-1] for x in s.columns[: n + 1]], axis=0)
                group = np.cumsum(new)
                depth[np.isin(group, group[hit])] = n + 1
            for lo in range(0, len(depth), 1 << 18):
                at = np.arange(lo, min(len(depth), lo + (1 << 18)))
                yield pa.RecordBatch.from_arrays([s.lang_of(at), s.texts(at, max_n), pa.array(depth[at]), pa.array(s.counts[at])], names=["lang", "suffix", "depth", "c"])

    return docs.mapInArrow(run, "lang string, suffix string, depth tinyint, c long")


def count_prefixes(rows: DataFrame, least: int, max_n: int = MAX_N) -> DataFrame:
    """lang, phrase, f of every prefix, for rows that are dealt and sorted; f is a part of the count where a row is dealt deeper."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[list] = [[None, 0, False] for _ in range(max_n)]  # of the last row's prefixes: (lang, words), count, in parts
        for b in batches:
            out: list[tuple[str, tuple[str, ...], int]] = []
            lang, split = b.column("lang"), pc.split_pattern(b.column("suffix"), " ")
            if not len(split):
                continue
            ends, flat = split.offsets.to_numpy().astype(np.int64), split.values
            n_words = np.diff(ends) - 1
            counts, depth = b.column("c").to_numpy(), b.column("depth").to_numpy()
            same = np.append(False, pc.equal(lang[1:], lang[:-1]).to_numpy(zero_copy_only=False)) if len(lang) > 1 else np.array([False])
            for n in range(1, max_n + 1):
                word = flat.take(pa.array(np.where(n_words >= n, ends[:-1] + n - 1, ends[1:] - 1)))  # the empty last part where there is none
                if len(word) > 1:
                    same[1:] &= pc.equal(word[1:], word[:-1]).to_numpy(zero_copy_only=False)
                has = n_words >= n
                new = np.flatnonzero(~same | ~has)
                sums = np.add.reduceat(counts, new)
                parts = np.maximum.reduceat(depth, new) > n
                key = lambda i: (lang[i].as_py(), tuple(flat[int(ends[i]) : int(ends[i]) + n].to_pylist()))  # noqa: B023, E731
                opened = stack[n - 1]
                if opened[0] is not None and has[0] and key(0) == opened[0]:
                    sums[0] += opened[1]
                    parts[0] |= opened[2]
                elif opened[0] is not None and (opened[1] >= least or opened[2]):
                    out.append((*opened[0], opened[1]))
                last = int(new[-1])
                stack[n - 1] = [key(last), int(sums[-1]), bool(parts[-1])] if has[last] else [None, 0, False]
                good = np.flatnonzero(((sums >= least) | parts) & has[new])
                out += [(*key(int(new[i])), int(sums[i])) for i in good.tolist() if i != len(new) - 1]
            if out:
                yield _phrases(out)
        rest = [(*key, c) for key, c, parts in stack if key is not None and (c >= least or parts)]
        if rest:
            yield _phrases(rest)

    return rows.mapInArrow(run, "lang string, phrase string, words int, f long")


def _phrases(found: list[tuple[str, tuple[str, ...], int]]) -> pa.RecordBatch:
    langs, words, counts = zip(*found)
    return pa.RecordBatch.from_arrays([pa.array(langs), pa.array([" ".join(w) for w in words]), pa.array([len(w) for w in words], pa.int32()), pa.array(counts, pa.int64())], names=["lang", "phrase", "words", "f"])


def frequent(docs: DataFrame, least_count: int, max_n: int = MAX_N, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(lang, n) and the phrases of up to max_n words with at least least_count occurrences: lang, phrase, words, f."""
    docs = only(docs, "lang", "text")
    totals, common = hot_prefixes(docs, max_n, hot)
    rows = suffixes(docs, common, max_n)
    dealt = rows.repartition("lang", F.expr("substring_index(suffix, ' ', depth)")).sortWithinPartitions(F.desc("lang"), F.desc("suffix"))
    parts = count_prefixes(dealt, least_count, max_n)
    return totals, parts.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f")).filter(F.col("f") >= least_count)


def collocations(docs: DataFrame, least_count: int = 30, absorb: int = 80, scale: int = 2_000_000, max_n: int = MAX_N, hot: int = HOT) -> DataFrame:
    """lang, phrase, words, a, l, r, n, score of the phrases of 2 to max_n words of docs(lang, text).

    A phrase goes when a longer one with at least absorb percent of its count holds its words. Of its cuts the one with
    the lowest score counts, where scores are equal the first.
    """
    totals, counted = frequent(docs, least_count, max_n, hot)
    phrases = materialize(counted, "phrases")
    words = F.split("phrase", " ")
    joined = lambda start, length: F.concat_ws(" ", F.slice("w", start, length))
    long_ = phrases.filter("words >= 2").withColumn("w", words)
    big = lambda name: F.col(name).cast("decimal(20,0)")

    cuts = long_.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select("lang", "phrase", "words", F.col("f").alias("a"), "k", joined(F.lit(1), F.col("k")).alias("head"), joined(F.col("k") + 1, F.col("words") - F.col("k")).alias("tail"))
    part = lambda name, count: phrases.select("lang", F.col("phrase").alias(name), F.col("f").alias(count))
    cuts = cuts.join(part("head", "l"), ["lang", "head"]).join(part("tail", "r"), ["lang", "tail"])
    score = F.expr(f"(cast(a as decimal(20,0)) * cast({scale} as decimal(10,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    inner = long_.filter("words >= 3").withColumn("size", F.explode(F.sequence(F.lit(2), F.col("words") - 1)))
    inner = inner.withColumn("start", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)))
    holders = inner.select("lang", joined(F.col("start"), F.col("size")).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("held"))
    left = best.join(holders, ["lang", "phrase"], "left").filter(F.col("held").isNull() | (big("held") * 100 < big("a") * absorb))
    return left.join(totals, "lang").select("lang", "phrase", "words", "a", "cut.l", "cut.r", "n", "cut.score")


def top(found: DataFrame, most: int = 2000) -> DataFrame:
    """Each lang's first phrases by score, then count, descending, then by the bytes of the phrase, with their rank."""
    w = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most).withColumn("rank", F.col("rank").cast("long"))
