"""Secret scans over an incremental blob ledger.

Every version of every path is addressed by the SHA-256 of its content. A blob is scanned once for each rule
version, however many paths or versions hold it: pairs that the ledger lists are skipped, new ones are scanned
and listed, and findings are joined back to all paths by content address. SQL expressions only.

Spans are code-point offsets, end exclusive. Edge cases: null text is the empty blob; empty blobs and texts
without findings have empty strings; repeated rows get equal findings; null doc_ids are scanned like others;
extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, materialize, text_or_empty


class Rule(NamedTuple):
    kind: str
    version: int
    pattern: str
    #: A literal every match holds, to pass over most texts without the regular expression; None: no such literal.
    needs: str | None = None
    #: A group and the length it needs for the match to count.
    group: int = 0
    least: int = 1


#: Base rules first: their order is the order of kinds at equal starts.
RULES = (
    Rule("assign", 1, r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", None, 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]+", "AKIA", 0, 20),
    Rule("hex", 1, r"[0-9a-f]+", None, 0, 24),
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", "PRIVATE KEY-----"),
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]+", "gh", 0, 40),
    Rule("slack", 1, r"xox[abprs]-[A-Za-z0-9-]+", "xox", 0, 15),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", "eyJ"),
)
BASE = ("assign", "access", "hex")
_SPANS = "array<struct<start:bigint,rank:int,end:bigint,kind:string>>"
#: For [x]+ with a least length, a run of that length is as good: shorter runs are dropped whole.
_FAST = {"hex": r"(?<![0-9a-f])[0-9a-f]{24,}"}
#: Matches of a text that are placed in one go: arrays grow by copies, so longer lists are placed in blocks.
BLOCK = 256


def blob_id(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def spans_of(text: Column, rule: Rule, rank: int) -> Column:
    """Spans of one rule: leftmost, non-overlapping matches, those with a short group dropped afterwards."""
    pattern = _FAST.get(rule.kind, rule.pattern)
    none = F.array().cast(_SPANS)

    def placed(found: Column) -> Column:
        def gather(gaps: Column) -> Column:
            # a match begins where the texts between matches, and the matches before it, end
            sizes = F.transform(found, lambda m, i: F.struct(F.length(F.get(gaps, i)).cast("bigint").alias("gap"), F.length(m).cast("bigint").alias("own")))
            return let(let(sizes, _in_blocks), lambda blocks: let(_starts(blocks), lambda at: finished(blocks, at)))

        def finished(blocks: Column, at: Column) -> Column:
            def step(a: Column, x: Column) -> Column:
                start = a["at"] + x["gap"]
                span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), (start + x["own"]).alias("end"), F.lit(rule.kind).alias("kind"))
                return F.struct((start + x["own"]).alias("at"), F.concat(a["out"], F.array(span)).cast(_SPANS).alias("out"))

            one = lambda block, o: F.aggregate(block, F.struct(o.alias("at"), none.alias("out")), step, lambda a: a["out"])
            every = F.flatten(F.zip_with(blocks, at, one))
            if rule.group:
                ok = lambda _, i: F.length(F.regexp_extract(F.get(found, i), rule.pattern, rule.group)) >= rule.least
            else:
                ok = lambda x, _: x["end"] - x["start"] >= rule.least
            return F.filter(every, ok)

        return F.when(F.size(found) == 0, none).otherwise(let(F.split(text, pattern, -1), gather))

    hits = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)
    return F.when(text.contains(rule.needs), hits).otherwise(none) if rule.needs else hits


def _in_blocks(items: Column) -> Column:
    count = F.ceil(F.size(items) / BLOCK).cast("int")
    return F.transform(F.sequence(F.lit(0), count - 1), lambda b: F.slice(items, b * BLOCK + 1, F.lit(BLOCK)))


def _starts(blocks: Column) -> Column:
    """Where each block of (gap, own) sizes starts."""
    sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("bigint"), lambda a, x: a + x["gap"] + x["own"]))
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("out"))
    return F.aggregate(sums, zero, lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])


def _label(rule: Rule) -> str:
    return f"{rule.kind}@{rule.version}"


def scan(versions: DataFrame, key: str = "doc_id", ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """(findings, ledger) for versions(key, text), one row for each path and version.

    ledger(blob, done array of "kind@version", spans): what earlier calls returned; several rows of a blob add
    up. The returned ledger holds only new rows, to be appended. findings: the versions' key, blob, and spans
    under the present rule versions.
    """
    texts = versions.select(F.col(key).alias("key"), text_or_empty().alias("text"))
    keyed = texts.select("key", blob_id(F.col("text")).alias("blob"))
    wanted = F.array(*[F.lit(_label(r)) for r in rules])
    blobs = keyed.groupBy("blob").agg(F.min("key").alias("key"))
    if ledger is None:
        todo = blobs.withColumn("done", F.array().cast("array<string>"))
    else:
        past = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("done"))).alias("done"))
        todo = blobs.join(past, "blob", "left").withColumn("done", F.coalesce("done", F.array().cast("array<string>")))
        todo = todo.filter(F.size(F.array_except(wanted, F.col("done"))) > 0)
    # one copy of each unseen blob: the text moves once, by content, so no path is hot
    t, d = texts.withColumn("blob", blob_id(F.col("text"))).alias("t"), todo.hint("shuffle_hash").alias("d")
    unseen = t.join(d, (F.col("t.blob") == F.col("d.blob")) & F.col("t.key").eqNullSafe(F.col("d.key"))).select("t.blob", "text", "done")
    parts = [F.when(F.array_contains("done", _label(r)), F.array().cast(_SPANS)).otherwise(spans_of(F.col("text"), r, i)) for i, r in enumerate(rules)]
    scanned = unseen.select("blob", F.array_except(wanted, F.col("done")).alias("done"), F.sort_array(F.concat(*parts)).alias("spans"))
    new = materialize(scanned.dropDuplicates(["blob"]), "ledger")
    if ledger is None:
        known = new.filter(F.size("spans") > 0).select("blob", "spans")
    else:
        known = ledger.select("blob", "done", "spans").unionByName(new.select("blob", "done", "spans"))
        live = [F.struct(F.lit(r.kind).alias("kind"), F.lit(_label(r)).alias("label")) for r in rules]
        current = F.filter("spans", lambda x: F.exists(F.array(*live), lambda r: (r["kind"] == x["kind"]) & F.array_contains("done", r["label"])))
        known = known.select("blob", current.alias("spans")).groupBy("blob").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))
        known = materialize(known.filter(F.size("spans") > 0), "known")  # a join of two stored tables can split the paths of a popular blob
    findings = keyed.join(known, "blob", "left").select(F.col("key").alias(key), "blob", F.coalesce("spans", F.array().cast(_SPANS)).alias("spans"))
    return findings, new


def digest_columns(findings: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, digest of the base spans, and all spans as text."""
    shown = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    base = F.filter("spans", lambda x: x["rank"] < len(BASE))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return findings.select(
        "doc_id", *[count(k) for k in BASE],
        F.sha2(F.array_join(F.transform(base, shown), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", shown), ",").alias("spans"),
    )
