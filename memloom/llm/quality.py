"""Quality rules: base statistics, and a hashed n-gram log-likelihood ratio with a fixed threshold.

The ratio compares two multinomials over hashed unigrams and bigrams: one of a trusted target (documents
labelled quality = 1), one of the raw corpus. A document's score is the mean of its n-grams' log ratios (the last word pairs with the text's end), so
long and short documents compare; it is kept if the score reaches the threshold. All of it is built from SQL
expressions: no Python runs on the executors.

Edge cases: null text is empty; a document without words scores 0.0 and fails the base rules; a null or
repeated doc_id is judged by its own row; empty tables give no rows; without trusted documents every score is
0.0 and the base rules alone decide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, let, materialize, text_or_empty, words

#: Bits of a hashed n-gram's bucket: the ratio table has 2 ** BITS doubles, whatever the corpus' size.
BITS = 13
#: A document is rejected if its score is more than so many standard deviations below the trusted ones' mean.
SPREAD = 6.0
#: Pseudo-count of each bucket.
SMOOTHING = 1.0
SYMBOLS = "[#*$%&|<>]"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30


def _pairs(h: Column, step: int) -> Column:
    """Hashes of (h[i], h[i + step]) for every i; past the end h[i] is hashed alone."""
    return F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + step)))


def _covered(w8: Column) -> Column:
    """Number of words inside windows whose hash occurs twice or more in w8 (one hash per window start).

    The entries for the last seven starts hold shorter windows; each of them ends at the end of the text and so
    differs from every other.
    """

    def marked(s: Column) -> Column:
        twin = lambda x, k: (F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False))) | (F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))
        at = F.transform(F.filter(s, twin), lambda x: x["i"])
        return let(F.sort_array(at), span)

    def span(pos: Column) -> Column:
        steps = F.transform(pos, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(pos, k + 1) - p, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0).cast("bigint"), lambda a, x: a + x)

    ordered = F.sort_array(F.transform(w8, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(_all_differ(w8), F.lit(0).cast("bigint")).otherwise(let(ordered, marked))


def _all_differ(x: Column) -> Column:
    return F.size(F.array_distinct(x)) == F.size(x)


def _repeat_words(p2: Column) -> Column:
    """From bigram hashes; if no four words repeat, no eight do."""
    eight = lambda p4: F.when(_all_differ(p4), F.lit(0).cast("bigint")).otherwise(let(_pairs(p4, 4), _covered))
    return let(_pairs(p2, 2), eight)


def _bucket(h: Column, bits: int) -> Column:
    return F.shiftrightunsigned(h, 64 - bits).cast("int")


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids of every document labelled quality = 1."""
    return labels.filter("quality = 1 and doc_id is not null").select("doc_id").distinct()


def ratio_table(docs: DataFrame, trusted: DataFrame, bits: int = BITS) -> DataFrame:
    """One row, one array: the log ratio of each bucket. The counts cover every document, and every one of trusted (a part of docs) again."""
    counted = lambda t, raw: t.select(words(text_or_empty()).alias("w"), F.lit(raw).alias("raw"))
    t = counted(docs, 1).unionByName(counted(trusted, 0))
    # each word with the one after it (null after the last): hashed and counted in generated code
    follows = F.arrays_zip(F.col("w").alias("x"), F.slice("w", F.lit(2), F.size("w")).alias("y"))
    t = t.select("raw", F.inline(follows).alias("x", "y"))
    one = F.xxhash64("x")
    two = F.when(F.col("y").isNull(), F.xxhash64(one)).otherwise(F.xxhash64(one, F.xxhash64("y")))
    grams = t.select("raw", F.explode(F.array(_bucket(one, bits), _bucket(two, bits))).alias("b"))
    counts = grams.groupBy("b").agg(F.sum("raw").alias("raw"), F.sum(1 - F.col("raw")).alias("target"))
    size = 1 << bits
    # 2 ** bits rows at most meet in one task
    packed = counts.agg(F.collect_list(F.struct("b", "raw", "target")).alias("c"), F.sum("raw").alias("n_raw"), F.sum("target").alias("n_target"))
    none = F.lit(0).cast("bigint")
    unseen = F.array_except(F.sequence(F.lit(0), F.lit(size - 1)), F.transform("c", lambda x: x["b"]))
    zeros = F.transform(unseen, lambda b: F.struct(b.alias("b"), none.alias("raw"), none.alias("target")))
    dense = packed.select("n_raw", "n_target", F.sort_array(F.concat("c", zeros)).alias("c"))
    share = lambda n, total: F.log(n + F.lit(SMOOTHING)) - F.log(total + F.lit(SMOOTHING * size))
    total = lambda c: F.coalesce(F.col(c), F.lit(0))
    ratio = F.transform("c", lambda x: share(x["target"], total("n_target")) - share(x["raw"], total("n_raw")))
    return dense.select(F.when(total("n_target") > 0, ratio).otherwise(F.transform("c", lambda x: F.lit(0.0))).alias("ratio"))


def _scored(docs: DataFrame, table: DataFrame, bits: int) -> DataFrame:
    """row (docs' columns), doc_id, the base statistics, base_failed and llr."""
    t = docs.select(F.struct("*").alias("row"), F.col("doc_id"), text_or_empty().alias("text"))
    has_word = lambda line: line.rlike(WORD)
    lines = let(F.filter(F.split("text", "\n"), has_word), lambda x: F.size(x) - F.size(F.array_distinct(x)))
    bare = F.regexp_replace("text", SYMBOLS, "")
    t = t.select("row", "doc_id", words(F.col("text")).alias("w"), (F.octet_length("text") - F.octet_length(bare)).cast("bigint").alias("n_symbols"), lines.cast("bigint").alias("n_dup_lines"))
    t = t.crossJoin(F.broadcast(table))  # one row of 2 ** bits doubles

    def grams(h: Column) -> Column:
        return let(_pairs(h, 1), lambda p2: F.struct(total(h, p2).alias("total"), _repeat_words(p2).alias("repeats")))

    def total(h: Column, p2: Column) -> Column:
        def both(ratio: Column) -> Column:
            look = lambda a, x: a + F.get(ratio, _bucket(x, bits))
            return F.aggregate(p2, F.aggregate(h, F.lit(0.0), look), look)

        return let(F.col("ratio"), both)

    both = let(F.transform("w", lambda x: F.xxhash64(x)), grams)
    t = t.select("row", "doc_id", F.size("w").cast("bigint").alias("n_words"), F.length(F.array_join("w", "")).cast("bigint").alias("word_chars"), "n_symbols", "n_dup_lines", both.alias("both"))
    t = t.select("row", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.col("both.repeats").alias("n_repeat_words"), F.when(F.col("n_words") > 0, F.col("both.total") / (2 * F.col("n_words"))).otherwise(F.lit(0.0)).alias("llr"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return t.select("row", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "llr")


def score_documents(docs: DataFrame, labels: DataFrame, spread: float = SPREAD, bits: int = BITS) -> DataFrame:
    """row (the input's columns), doc_id, base statistics, base_failed, llr (mean log ratio), threshold, kept.

    Every trusted document counts in the target multinomial, and every one that passes the base rules sets the threshold.

    The threshold is a function of the trusted documents alone (mean - spread * deviation of their scores, rounded
    to six digits), the same for every document and every run.
    """
    # the ids grow with the labels: texts move once to meet them, and only the trusted ones are kept
    trusted = materialize(docs.select("doc_id", "text").join(trusted_ids(labels).hint("shuffle_hash"), "doc_id", "left_semi"), "trusted", "zstd")
    table = materialize(ratio_table(docs, trusted, bits), "ratio")
    cut = F.round(F.avg("llr") - spread * F.coalesce(F.stddev_pop("llr"), F.lit(0.0)), 6)
    limit = materialize(_scored(trusted, table, bits).filter(~F.col("base_failed")).agg(F.coalesce(cut, F.lit(float("-inf"))).alias("threshold")), "threshold")
    t = _scored(docs, table, bits).crossJoin(F.broadcast(limit))  # one row
    return t.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= F.col("threshold")))
