"""Mixing sources to target weights along a time-varying curriculum.

Targets share the corpus' words by weight and stop at ``cap`` times a source's size; what is over is shared
again by weight. A source's weight changes over training time u in [0, 1] as target * (1 + slope * (2u - 1));
its integral is the source's cumulative demand. Documents stand in a fixed order (by md5 of doc_id and text) in their
source's stream, pass after pass; inverting the demand at the middle of a document's stretch of the stream gives
its training position, and documents are range-sorted by position. SQL expressions only.

Running sums within a source are made in two levels (md5 prefix, then within it), so a source with a third of
all rows is spread over 16 ** PREFIX groups.

Edge cases: null text has size 0 and takes 0 words; null sources are one source, placed last; repeated rows
are separate documents (which of two rows with equal doc_id and text is taken is immaterial); a corpus without words has targets 0;
empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, WS, text_or_empty

WEIGHTS = (5, 2, 1)
#: Slope of the schedule of the sources with the weight at the same place: heavy sources rise, light ones fall.
SLOPES = (0.5, 0.0, -0.5)
CAP = 3
PREFIX = 3


def source_targets(sizes: DataFrame, weights=WEIGHTS, slopes=SLOPES, cap: int = CAP) -> DataFrame:
    """source, source_size, target, slope: one row a source. sizes has source and size."""
    t = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1  # one row a source
    pick = lambda values: F.get(F.array(*[F.lit(v) for v in values]), place % len(values))
    t = t.select("source", "source_size", pick(weights).alias("weight"), pick([float(s) for s in slopes]).alias("slope"))
    t = t.withColumn("most", cap * F.col("source_size")).withColumn("ratio", F.col("most").cast("double") / F.col("weight"))
    # by the level at which each source is full: before the first source that does not fill, all are full
    by_level = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("most").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing))
    level = (F.sum("source_size").over(Window.partitionBy()) - before).cast("double") / rest
    t = t.withColumn("level", level)
    final = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", F.col("source").isNull(), "source", "level"))).over(Window.partitionBy())["level"]
    return t.select("source", "source_size", "slope", F.least(F.col("most").cast("double"), final * F.col("weight")).alias("target"))


def document_plan(docs: DataFrame, carry: tuple[str, ...] = (), **options) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, slope, taken, before (its place in the stream).

    carry: further columns to keep.
    """
    spot = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("\n"), text_or_empty()).cast("binary"))
    t = docs.select("doc_id", "source", spot.alias("at"), F.regexp_count(text_or_empty(), F.lit(WORD)).cast("bigint").alias("size"), *[F.col(c) for c in carry if c not in ("doc_id", "source")])
    t = t.withColumn("g", F.substring("at", 1, PREFIX))
    groups = t.select("source", "g", "size").groupBy("source", "g").agg(F.sum("size").alias("size"))
    targets = source_targets(groups, **options)
    run = Window.partitionBy("source").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("source", "g", F.coalesce(F.sum("size").over(run), F.lit(0)).alias("base"))
    groups = groups.withColumnsRenamed({"source": "s", "g": "gg"})
    groups = groups.join(targets.withColumnRenamed("source", "ts"), F.col("s").eqNullSafe(F.col("ts"))).drop("ts")
    within = Window.partitionBy("source", "g").orderBy("at", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0)))
    t = t.join(groups, F.col("source").eqNullSafe(F.col("s")) & (F.col("g") == F.col("gg")))
    want = F.round("target").cast("bigint")
    passes = F.when(F.col("source_size") > 0, F.floor(want / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint")
    t = t.withColumn("before", F.col("before") + F.col("base")).withColumn("passes", passes)
    left = want - F.col("passes") * F.col("source_size") - F.col("before")
    t = t.withColumn("last", F.greatest(F.lit(0), F.least(F.col("size"), left)).cast("bigint"))
    t = t.withColumn("taken", F.col("passes") * F.col("size") + F.col("last"))
    return t.drop("s", "gg", "g", "at", "base")


def position(middle: Column, target: Column, slope: Column) -> Column:
    """u with demand(u) = middle, where demand(u) = target * ((1 - slope) * u + slope * u * u)."""
    share = F.least(F.lit(1.0), middle / target)
    curve = (F.sqrt((1 - slope) * (1 - slope) + 4 * slope * share) - (1 - slope)) / (2 * slope)
    return F.when(target <= 0, F.lit(None)).when(slope == 0, share).otherwise(curve)


def with_first_position(plan: DataFrame) -> DataFrame:
    """plan with the training position of each document's first use (null: not used)."""
    used = F.when(F.col("passes") > 0, F.col("size")).otherwise(F.col("last"))
    at = position(F.col("before") + used / 2.0, F.col("target"), F.col("slope"))
    return plan.withColumn("position", F.when(F.col("taken") > 0, F.round(at, 9)))


def curriculum(docs: DataFrame, carry: tuple[str, ...], text: str = "text", **options) -> DataFrame:
    """The mixed corpus: carry's columns, a row for each use of a document, range-sorted by training position.

    A last use of fewer words than the document has holds only those first words, joined by single spaces.
    """
    plan = document_plan(docs, carry, **options).filter("taken > 0")
    uses = plan.withColumn("use", F.explode(F.sequence(F.lit(0).cast("bigint"), F.when(F.col("last") > 0, F.col("passes")).otherwise(F.col("passes") - 1))))
    n = F.when(F.col("use") < F.col("passes"), F.col("size")).otherwise(F.col("last"))
    at = position(F.col("use") * F.col("source_size") + F.col("before") + n / 2.0, F.col("target"), F.col("slope"))
    cut = F.array_join(F.slice(F.split(F.ltrim(F.regexp_replace(text, WS, " ")), " "), F.lit(1), n.cast("int")), " ")
    uses = uses.withColumn("position", at).withColumn(text, F.when(n < F.col("size"), cut).otherwise(F.col(text)))
    return uses.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id").select(*carry, "use", "position")
