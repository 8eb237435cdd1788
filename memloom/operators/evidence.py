"""The inverted evidence index, its recall joins and graph views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scoring, temporal
from ..functions.text import node_id, normalize_key
from ..sources.shared import stored
from . import projections


def term_nodes(records: DataFrame) -> DataFrame:
    """entity, tag and entity_tag nodes of records(record_id, entities, tags): one row a node.

    Each kind is an explode and a group; the cross product is only within a record.
    """
    e = records.select("record_id", F.explode("entities").alias("e")).select("record_id", normalize_key(F.col("e")).alias("key"))
    t = records.select("record_id", F.explode("tags").alias("t")).select("record_id", normalize_key(F.col("t")).alias("key"))
    both = records.select("record_id", F.explode("entities").alias("e"), "tags").select("record_id", "e", F.explode("tags").alias("t"))
    both = both.select("record_id", F.concat_ws("::", normalize_key(F.col("e")), normalize_key(F.col("t"))).alias("key"))
    kinds = [x.select(F.lit(kind).alias("node_type"), "key", "record_id") for kind, x in (("entity", e), ("tag", t), ("entity_tag", both))]
    every = kinds[0].unionByName(kinds[1]).unionByName(kinds[2]).filter("key <> ''")
    nodes = every.groupBy("node_type", "key").agg(F.sort_array(F.collect_set("record_id")).alias("record_ids"))
    return nodes.select(node_id(F.col("node_type"), F.col("key")).alias("node_id"), "node_type", "key", "record_ids")


def postings(records: DataFrame) -> DataFrame:
    """The same index as narrow rows (node_type, key, record_id): the form for joins at scale."""
    e = records.select(F.lit("entity").alias("node_type"), "record_id", F.explode("entities").alias("v"))
    t = records.select(F.lit("tag").alias("node_type"), "record_id", F.explode("tags").alias("v"))
    return e.unionByName(t).select("node_type", normalize_key(F.col("v")).alias("key"), "record_id").filter("key <> ''").distinct()


def temporal_nodes(records: DataFrame) -> DataFrame:
    """day and month nodes of records(record_id, day): key, span, number of records."""
    t = records.select("record_id", F.explode(temporal.temporal_keys(F.col("day"))).alias("key")).groupBy("key").agg(F.countDistinct("record_id").alias("n_records"))
    span = temporal.key_span(F.col("key"))
    return t.select("key", span["start"].alias("start"), span["end"].alias("end"), "n_records")


def event_frames(turns: DataFrame, size: int = 4) -> DataFrame:
    """Frames of size turns of a session: first and last turn, roles, turns (A10)."""
    frame = F.floor(F.col("turn_index") / size).cast("int")
    return turns.groupBy("session_id", frame.alias("frame")).agg(F.min("turn_index").alias("start_turn"), F.max("turn_index").alias("end_turn"), F.sort_array(F.collect_set("role")).alias("roles"), F.count(F.lit(1)).alias("n_turns"))


def record_frames(records: DataFrame, span: int = 4, texts: int = 12) -> DataFrame:
    """Event frames of records (record_id, session_id, turns, memory_type, entities, tags, text, created_at) (A10).

    A frame holds a session's records whose first turn lies in one span of turns: first and last turn, key, number of records,
    distinct entities and tags (with the records' types), and its first texts by time. Sets and texts are made of rows that
    are distinct, or ranked, before they are collected; the frame's records are rows of `postings` under its key.
    """
    r = records.withColumns({"first": F.array_min("turns"), "last": F.array_max("turns")}).filter("session_id is not null and first is not null").withColumn("frame", F.floor(F.col("first") / span).cast("int"))
    keys = ["session_id", "frame"]
    whole = r.groupBy(*keys).agg(F.min("first").alias("start_turn"), F.max("last").alias("end_turn"), F.count(F.lit(1)).alias("n_records"))

    def distinct(values, name: str) -> DataFrame:
        rows = r.select(*keys, F.explode(values).alias("v")).withColumn("v", F.trim("v")).filter("v <> ''").distinct()
        return rows.groupBy(*keys).agg(F.sort_array(F.collect_list("v")).alias(name))

    ranked = r.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("created_at", "record_id"))).filter(F.col("n") <= texts)
    first = ranked.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]).alias("texts"))
    t = whole.join(distinct("entities", "entities"), keys, "left").join(distinct(F.array_append("tags", F.col("memory_type")), "tags"), keys, "left").join(first, keys)
    key = F.concat(F.col("session_id").cast("string"), F.lit(":"), F.col("frame").cast("string"), F.lit(":"), F.col("start_turn").cast("string"), F.lit("-"), F.col("end_turn").cast("string"))
    none = F.array().cast("array<string>")
    return t.select(key.alias("key"), *keys, "start_turn", "end_turn", "n_records", F.coalesce("entities", none).alias("entities"), F.coalesce("tags", none).alias("tags"), "texts")


def _by_month(rows: DataFrame, start: str, end: str) -> DataFrame:
    """A row for each month of a row's span (month), with the first one (first)."""
    months = F.sequence(F.trunc(F.to_date(start), "month"), F.trunc(F.to_date(end), "month"), F.expr("interval 1 month"))
    return rows.withColumn("m", F.explode(months)).withColumn("month", F.date_format("m", "yyyy-MM")).withColumn("first", F.substring(start, 1, 7)).drop("m")


def temporal_recall(nodes: DataFrame, plans: DataFrame, limit: int) -> DataFrame:
    """Temporal nodes that overlap each plan's range (plan_id, since, until), by granularity score.

    Both sides are joined by month as equi key, a pair at the later of their first months, with the exact overlap as
    residual. An open end is filled from the nodes' own range; plans without ends and reversed ranges recall nothing.
    """
    range_ = nodes.agg(F.min("start").alias("from"), F.max(F.coalesce("end", "start")).alias("to"))  # one row
    some = F.coalesce(F.nullif("since", F.lit("")), F.nullif("until", F.lit("")))
    p = plans.select("plan_id", F.nullif("since", F.lit("")).alias("since"), F.nullif("until", F.lit("")).alias("until")).filter(some.isNotNull())
    p = p.crossJoin(F.broadcast(range_)).select("plan_id", "since", "until", F.greatest(F.coalesce("since", "from"), F.col("from")).alias("lo"), F.least(F.coalesce("until", "to"), F.col("to")).alias("hi")).filter("lo <= hi")
    p = _by_month(p, "lo", "hi").withColumnRenamed("first", "p_first")
    n = nodes.withColumns({"start": F.coalesce("start", "end"), "end": F.coalesce("end", "start")}).filter("start <= end")
    n = _by_month(n, "start", "end")
    hits = n.join(p, "month").filter(F.col("month") == F.greatest("first", "p_first"))
    hits = hits.filter(temporal.overlaps(F.col("start"), F.col("end"), F.col("since"), F.col("until")))
    score = F.when(F.startswith("key", F.lit("day:")), F.lit(0.42)).when(F.startswith("key", F.lit("month:")), F.lit(0.28)).otherwise(F.lit(0.34))
    hits = hits.select("plan_id", "key", "n_records", score.alias("score"))
    w = Window.partitionBy("plan_id").orderBy(F.desc("score"), "key")
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def temporal_records(hits: DataFrame, index: DataFrame, records: DataFrame) -> DataFrame:
    """Records of temporal hits (plan_id, key, score) that are not expired: best score and number of nodes of each.

    index(key, record_id); records(record_id, expired).
    """
    live = records.filter("not expired").select("record_id")
    found = hits.join(index, "key").join(live, "record_id", "left_semi")
    return found.groupBy("plan_id", "record_id").agg(F.max("score").alias("field_score"), F.count(F.lit(1)).alias("n_nodes"))


def expand(node_hits: DataFrame, index: DataFrame, records: DataFrame | None = None) -> DataFrame:
    """Records of hit nodes (node_type, key, score): best weighted score and number of nodes of each record.

    records(record_id, expired): those that are expired, or unknown, are left out (F1).
    """
    hit = node_hits.join(index, ["node_type", "key"])
    if records is not None:
        hit = hit.join(records.filter("not expired").select("record_id"), "record_id", "left_semi")
    field = hit["score"] * scoring.node_weight(F.col("node_type"))
    return hit.withColumn("field", field).groupBy("record_id").agg(F.round(F.max("field"), 6).alias("field_score"), F.count(F.lit(1)).alias("n_nodes"))


def _signature(item: str) -> list[Column]:
    """256 bits in four longs, of which each item of a set sets one."""
    at = lambda i: f"case when pmod(xxhash64({item}), 4) = {i} then shiftleft(1L, cast(pmod(shiftright(xxhash64({item}), 8), 64) as int)) else 0L end"
    return [F.expr(f"bit_or({at(i)})").alias(f"bits{i}") for i in range(4)]


def containment_tree(sets: DataFrame) -> DataFrame:
    """Best parent of each set (set_id, item rows): its smallest strict superset, then smallest id.

    A superset holds its subset's rarest item, so a set meets only the larger sets that have it; popular items join
    nothing. Each set has a signature of 256 bits, one set by each item: where a bit of the smaller set is not in the larger
    one's, the pair ends in the join. The items of the others are compared. The smallest superset has no other one between, so it is also the parent of the reduced tree.
    """
    s = sets.select("set_id", "item").distinct()
    sizes = s.groupBy("set_id").agg(F.count(F.lit(1)).alias("n"), *_signature("item"))
    often = s.groupBy("item").agg(F.count(F.lit(1)).alias("times"))
    rare = s.join(often, "item").groupBy("set_id").agg(F.min(F.struct("times", "item")).alias("rare")).select("set_id", F.col("rare.item").alias("item"))
    child = rare.join(sizes, "set_id").select(F.col("set_id").alias("child"), F.col("n").alias("n_child"), "item", *[F.col(f"bits{i}").alias(f"c{i}") for i in range(4)])
    parent = s.join(sizes, "set_id").select(F.col("set_id").alias("parent"), F.col("n").alias("n_parent"), "item", *[F.col(f"bits{i}").alias(f"p{i}") for i in range(4)])
    may = " and ".join(f"c{i} & ~p{i} = 0" for i in range(4))
    pairs = child.join(parent, "item").filter(f"n_parent > n_child and {may}").select("child", "parent", "n_child", "n_parent")
    shared = pairs.join(s.select(F.col("set_id").alias("child"), "item"), "child").join(s.select(F.col("set_id").alias("parent"), "item"), ["parent", "item"])
    over = shared.groupBy("child", "parent", "n_child", "n_parent").agg(F.count(F.lit(1)).alias("shared")).filter("shared = n_child")
    w = Window.partitionBy("child").orderBy("n_parent", "parent")
    return over.withColumn("r", F.row_number().over(w)).filter("r = 1").select("child", "parent", "n_child", "n_parent")


def memory_tree(sets: DataFrame, records: DataFrame, turns: DataFrame) -> DataFrame:
    """id, kind, parent, depth, path, name of every node of the memory's trees, once for each path to it.

    sets(set_id, item, name): composites with the records they were made of; records(record_id, session_id, lo, hi,
    created_at, name); turns(session_id, turn_index, role, content). A composite hangs below its smallest superset, a record below
    the composites that hold it though none of their children does, a turn below its canonical record. Roots are
    composites without a superset and records that no composite holds. Depths are found level by level, each level stored: a
    recursive query would end at a million rows.
    """
    s = sets.select(F.col("set_id").cast("string").alias("set_id"), F.col("item").cast("string").alias("item")).distinct()
    names = sets.groupBy(F.col("set_id").cast("string").alias("set_id")).agg(F.min("name").alias("name"))
    parents = stored(containment_tree(s).select("child", "parent"), "parents")
    level = s.select(F.col("set_id").alias("id")).distinct().join(parents, F.col("id") == F.col("child"), "left_anti").select("id", F.lit(None).cast("string").alias("parent"), F.lit(0).alias("depth"), F.col("id").alias("path"))
    found = []
    while True:
        level = stored(level, "level")
        if level.isEmpty():
            break
        found.append(level)
        above = level.select(F.col("id").alias("parent"), "depth", "path")
        level = parents.join(above, "parent").select(F.col("child").alias("id"), "parent", (F.col("depth") + 1).alias("depth"), F.concat_ws("/", "path", "child").alias("path"))
    composites = level.limit(0)
    for one in found:
        composites = composites.unionByName(one)
    below = lambda rows, parent, name: rows.join(parent.select(F.col("id").alias("parent"), F.col("depth").alias("_depth"), F.col("path").alias("_path")), "parent").select("id", "parent", (F.col("_depth") + 1).alias("depth"), F.concat_ws("/", "_path", "id").alias("path"), name)
    covered = parents.join(s, F.col("child") == F.col("set_id")).select(F.col("parent").alias("set_id"), "item").distinct()
    r = records.select(F.col("record_id").cast("string").alias("id"), "name")
    direct = s.join(covered, ["set_id", "item"], "left_anti").select(F.col("set_id").alias("parent"), F.col("item").alias("id")).join(r, "id")
    loose = r.join(s.select(F.col("item").alias("id")).distinct(), "id", "left_anti").select("id", F.lit(None).cast("string").alias("parent"), F.lit(0).alias("depth"), F.col("id").alias("path"), "name")
    held = stored(below(direct, composites, "name").unionByName(loose), "records")
    edges, shown = projections.grounding(records, turns)
    canonical = edges.filter("rank = 1").select(F.col("record_id").cast("string").alias("parent"), "episode_id")
    episodes = canonical.join(shown.select("episode_id", "name"), "episode_id").select("parent", F.concat(F.lit("episode:"), "episode_id").alias("id"), "name")
    kind = lambda rows, name: rows.select("id", F.lit(name).alias("kind"), "parent", "depth", "path", F.substring("name", 1, 123).alias("name"))
    top = composites.join(names.withColumnRenamed("set_id", "id"), "id")
    return kind(top, "composite").unionByName(kind(held, "record")).unionByName(kind(below(episodes, held, "name"), "episode"))


def graph(index: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges node -> record, roots): roots are nodes, and records that no node points to."""
    edges = index.join(records.select("record_id"), "record_id", "left_semi").select(F.concat_ws(":", "node_type", "key").alias("source"), F.col("record_id").cast("string").alias("target"))
    nodes = index.select(F.concat_ws(":", "node_type", "key").alias("id")).distinct()
    loose = records.select(F.col("record_id").cast("string").alias("id")).join(edges.select(F.col("target").alias("id")), "id", "left_anti")
    return edges, nodes.unionByName(loose)
