"""Full text from a stored index: postings by the beginnings of their terms, kept up by new and removed rows.

Tables below a folder, each in batches: postings(term, id, tf, len) by prefix (a term's first two characters), lengths(id, len),
removed(id), and stats(n, tokens), whose rows add up to the number and length of all live documents and which ends a batch. A search reads the
folders of its terms' prefixes alone, joins what was removed, and scores with `ranking.bm25_scores`, as the search over
texts does. No search or change reads a text that it was not given.

Edge cases: null text has no words but counts as a document; ids of one call of `add` must differ, one added again later
replaces the one before; removing ids that are not there changes nothing; a batch written again changes nothing, and one
whose writing was cut off is not seen; terms of one character as prefixes read every folder that begins with it; a search
in an empty index gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.batches import last_batch, live, read_batches, write_batch
from ..sources.shared import stored
from . import ranking

#: Characters that a folder's terms share; parts in which each is written, so that a frequent term is no single task.
BEGINNING, SPREAD = 2, 8
_POSTINGS = "term string, id long, tf long, len int, prefix string"


def _words(text: str):
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[a-z0-9]+"), F.lit(0))


def _counted(ordered: Column) -> Column:
    """(term, tf) of a document's words in order: counted in its row, so that no row moves for it."""
    firsts = F.filter(F.transform(ordered, lambda x, i: F.when((i == 0) | (x != F.get(ordered, i - 1)), i)), lambda i: i.isNotNull())
    ends = lambda k, at: F.coalesce(F.get(at, k + 1), F.size(ordered))
    runs = F.transform(F.array(firsts), lambda at: F.transform(at, lambda i, k: F.struct(F.get(ordered, i).alias("term"), (ends(k, at) - i).cast("bigint").alias("tf"))))
    return F.get(runs, F.lit(0))


def add(docs: DataFrame, folder: str, id_col: str = "doc_id", text: str = "text", batch: int | None = None) -> int:
    """Write docs as a batch, in place of rows with their ids; the number of the batch."""
    spark = docs.sparkSession
    batch = last_batch(spark, folder, "stats") + 1 if batch is None else batch
    d = docs.select(F.col(id_col).cast("long").alias("id"), _words(text).alias("w")).withColumn("len", F.size("w"))
    lengths = stored(d.select("id", "len"), "lengths")
    stats = _forget(spark, lengths.select("id"), folder, batch, lengths)
    terms = d.select("id", "len", F.array_sort("w").alias("w")).select("id", "len", F.inline(_counted(F.col("w"))))
    parts = terms.withColumn("prefix", F.substring("term", 1, BEGINNING)).repartition("prefix", F.pmod(F.xxhash64("id"), F.lit(SPREAD)))
    write_batch(parts, folder, "postings", batch, ["prefix"])
    write_batch(lengths, folder, "lengths", batch)
    write_batch(stats, folder, "stats", batch)
    return batch


def remove(ids: DataFrame, folder: str, id_col: str = "doc_id", batch: int | None = None) -> int:
    spark = ids.sparkSession
    batch = last_batch(spark, folder, "stats") + 1 if batch is None else batch
    stats = _forget(spark, ids.select(F.col(id_col).cast("long").alias("id")), folder, batch, None)
    write_batch(stats, folder, "stats", batch)
    return batch


def _forget(spark: SparkSession, ids: DataFrame, folder: str, batch: int, new: DataFrame | None) -> DataFrame:
    """Ids of earlier batches go; what they take away from the stats and the new lengths bring."""
    ids = ids.distinct()
    removed = read_batches(spark, folder, "removed", "id long", "stats").filter(F.col("batch") < batch)
    old = live(read_batches(spark, folder, "lengths", "id long, len int", "stats").filter(F.col("batch") < batch), removed).join(ids, "id", "left_semi")
    change = old.select((-F.lit(1)).alias("n"), (-F.col("len")).alias("len"))
    change = change if new is None else change.unionByName(new.select(F.lit(1).alias("n"), "len"))
    stats = stored(change.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("tokens")), "stats")
    write_batch(ids, folder, "removed", batch)
    return stats


def terms_of(spark: SparkSession, folder: str, terms: list[str], prefixes: bool = False) -> DataFrame:
    """id, len, term, tf of live documents; a prefix's term ends in a star. Only the terms' folders are read."""
    wanted = sorted({t.lower() for t in terms})
    begins = [t[:BEGINNING] for t in wanted]
    place = F.col("prefix").isin(begins)
    if prefixes:
        for t in wanted:
            place = place | F.col("prefix").startswith(t[:BEGINNING])
    rows = read_batches(spark, folder, "postings", _POSTINGS, "stats").filter(place)
    match = F.lit(False)
    names = F.array().cast("array<string>")
    for t in wanted:
        names = F.concat(names, F.when(F.col("term") == t, F.array(F.lit(t))).otherwise(F.array().cast("array<string>")))
        match = match | (F.col("term") == t)
        if prefixes:
            names = F.concat(names, F.when(F.col("term").startswith(t), F.array(F.lit(f"{t}*"))).otherwise(F.array().cast("array<string>")))
            match = match | F.col("term").startswith(t)
    rows = live(rows.filter(match), read_batches(spark, folder, "removed", "id long", "stats"))
    return rows.select("id", "len", F.explode(names).alias("term"), "tf").groupBy("id", "len", "term").agg(F.sum("tf").alias("tf"))


def search(spark: SparkSession, folder: str, terms: list[str], k: int, prefixes: bool = False) -> DataFrame:
    """id, score: the k best live documents, as `ranking.bm25` over their texts would give them."""
    stats = read_batches(spark, folder, "stats", "n long, tokens long", "stats").agg((F.sum("tokens") / F.sum("n")).alias("avg_len"), F.sum("n").alias("n"))
    return ranking.bm25_scores(terms_of(spark, folder, terms, prefixes), stats).orderBy(F.desc("score"), "id").limit(k)


def compacted(spark: SparkSession, folder: str, new_folder: str) -> None:
    """The live rows of an index as the first batch of a new one."""
    removed = read_batches(spark, folder, "removed", "id long", "stats")
    parts = live(read_batches(spark, folder, "postings", _POSTINGS, "stats"), removed).drop("batch").repartition("prefix", F.pmod(F.xxhash64("id"), F.lit(SPREAD)))
    lengths = stored(live(read_batches(spark, folder, "lengths", "id long, len int", "stats"), removed).drop("batch"), "lengths")
    write_batch(parts, new_folder, "postings", 0, ["prefix"])
    write_batch(lengths, new_folder, "lengths", 0)
    write_batch(spark.createDataFrame([], "id long"), new_folder, "removed", 0)
    write_batch(lengths.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("tokens")), new_folder, "stats", 0)
