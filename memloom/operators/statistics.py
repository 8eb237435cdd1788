"""Usage statistics that are taken on the way, and kept over runs.

`observed` adds counters to a plan whose rows go elsewhere anyway (`DataFrame.observe`), so no second pass reads them. What
they counted is added to what was saved, and saved by a rename, so a reader sees the old totals or the new ones.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

TOTALS = ("calls", "tokens", "latency")


def observed(rows: DataFrame, sources: Sequence[str], source: Column, tokens: Column, latency: Column) -> tuple[DataFrame, Observation]:
    """(rows, observation): calls, tokens and latency of each source, known once the rows were used. Other sources count as `other`."""
    seen = Observation(f"usage-{uuid.uuid4().hex}")
    counters = []
    for i, s in enumerate([*sources, None]):
        own = F.coalesce(source == s, F.lit(False)) if s is not None else ~F.coalesce(source.isin(*sources), F.lit(False))
        counters += [F.count_if(own).alias(f"calls_{i}"), F.coalesce(F.sum(F.when(own, tokens)), F.lit(0)).alias(f"tokens_{i}"), F.coalesce(F.sum(F.when(own, latency)), F.lit(0.0)).alias(f"latency_{i}")]
    return rows.observe(seen, *counters), seen


def totals(seen: Observation, sources: Sequence[str]) -> dict[str, dict[str, float]]:
    """What an observation counted, by source; waits for the rows' use. Sources without calls have no entry."""
    found = seen.get
    return {name: {t: found[f"{t}_{i}"] for t in TOTALS} for i, name in enumerate([*sources, "other"]) if found[f"calls_{i}"]}


def _place(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    return jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.FileContext.getFileContext(jvm.java.net.URI(path), spark.sparkContext._jsc.hadoopConfiguration())


def load(spark: SparkSession, path: str) -> dict[str, dict[str, float]]:
    """The saved totals; none where nothing, or nothing readable, was saved."""
    place, files = _place(spark, path)
    if not files.util().exists(place):
        return {}
    try:
        return json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))  # a few lines
    except ValueError:
        return {}


def save(spark: SparkSession, path: str, new: dict[str, dict[str, float]]) -> dict[str, dict[str, float]]:
    """Add new totals to the saved ones; the file is replaced at once."""
    jvm = spark.sparkContext._jvm
    both = load(spark, path)
    for name, counts in new.items():
        old = both.setdefault(name, dict.fromkeys(TOTALS, 0))
        both[name] = {t: old[t] + counts[t] for t in TOTALS}
    place, files = _place(spark, path)
    part = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.part")
    out = part.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(part)
    out.write(bytearray(json.dumps(both).encode()))
    out.close()
    replace = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    replace[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    files.rename(part, place, replace)
    return both


def table(spark: SparkSession, path: str) -> DataFrame:
    """The saved totals as rows: source, calls, tokens, latency, mean_latency."""
    rows = [(name, int(c["calls"]), int(c["tokens"]), float(c["latency"]), float(c["latency"]) / c["calls"] if c["calls"] else None) for name, c in load(spark, path).items()]
    return spark.createDataFrame(rows, "source string, calls long, tokens long, latency double, mean_latency double")
