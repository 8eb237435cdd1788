"""Rank fusion, quotas, rerank pools, diversity and keyword search."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scoring
from ..functions.text import token_set


def query_terms(query: str) -> list[str]:
    """The terms of a full-text query: what white space parts, without quotes and stars."""
    return sorted({t for x in query.split() if (t := x.replace('"', "").replace("*", "").lower())})


def holding(docs: DataFrame, terms: list[str], text: str = "text") -> DataFrame:
    """docs with at least one of the terms (K16); texts that hold none as a part of a word are not split."""
    wanted = sorted({t.lower() for t in terms})
    lower = F.lower(F.coalesce(text, F.lit("")))
    some = F.lit(False)
    for t in wanted:
        some = some | F.contains(lower, F.lit(t))
    return docs.filter(some & F.exists(F.regexp_extract_all(lower, F.lit(r"[a-z0-9]+"), F.lit(0)), lambda w: w.isin(wanted)))


def bm25(docs: DataFrame, terms: list[str], k: int, id_col: str = "doc_id", text: str = "text", k1: float = 1.2, b: float = 0.75, prefixes: bool = False) -> DataFrame:
    """The k best documents for query terms by published BM25; only the terms' postings are grouped.

    Document lengths and the number of documents are one aggregate row. prefixes: each term stands for itself and, as a term
    of its own, for every word that begins with it.
    """
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[a-z0-9]+"), F.lit(0))
    d = docs.select(F.col(id_col).alias("id"), words.alias("w")).withColumn("len", F.size("w"))
    stats = d.agg(F.avg("len").alias("avg_len"), F.count(F.lit(1)).alias("n"))
    wanted = sorted({t.lower() for t in terms})
    if prefixes:
        table = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(p).alias("p")) for t in wanted for p in (False, True)])
        match = lambda w, q: F.when(q["p"], F.startswith(w, q["t"])).otherwise(w == q["t"])
        met = F.flatten(F.transform("w", lambda w: F.transform(F.filter(table, lambda q: match(w, q)), lambda q: F.concat(q["t"], F.when(q["p"], F.lit("*")).otherwise(F.lit(""))))))
    else:
        met = F.filter("w", lambda x: x.isin(wanted))
    hits = d.select("id", "len", F.explode(met).alias("term")).groupBy("id", "len", "term").agg(F.count(F.lit(1)).alias("tf"))
    return bm25_scores(hits, stats, k1, b).orderBy(F.desc("score"), "id").limit(k)


def bm25_scores(hits: DataFrame, stats: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """id, score from hits(id, len, term, tf) and one row of stats(avg_len, n)."""
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))  # a row a query term
    s = hits.join(F.broadcast(df), "term").crossJoin(F.broadcast(stats))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    return s.groupBy("id").agg(F.round(F.sum(part), 6).alias("score"))


def _by_request(rows: DataFrame, fold: Callable[[list], list[tuple]], columns: str) -> DataFrame:
    """Fold each request's rows, which a rank before has bounded, in one Arrow group; fold gets and returns tuples."""
    names = [c.strip().split(" ")[0] for c in columns.split(",")]

    def run(part: pd.DataFrame) -> pd.DataFrame:
        request = part["request"].iloc[0]
        return pd.DataFrame([(request, *r) for r in fold(list(part.itertuples(index=False)))], columns=names)

    return rows.groupBy("request").applyInPandas(run, columns)


def rrf(hits: DataFrame, k: int, depth: int = 60) -> DataFrame:
    """Fuse the routes of each request: hits(request, route, route_no, id, score).

    Reciprocal ranks and best score make the fused score. Each route, in order, then takes its first quota ids that no
    route before it took, quota = k / routes in 1..4; a fill by fused score follows. place is the order of choice. The
    choice depends on those before it, so it is a fold over a request's rows, at most routes * max(4k, 16).
    """
    by_route = Window.partitionBy("request", "route").orderBy(F.desc("score"), "id")
    whole = Window.partitionBy("request")
    ranked = hits.withColumn("rank", F.row_number().over(by_route)).filter(F.col("rank") <= max(4 * k, 16))
    routes = hits.groupBy("request").agg(F.countDistinct("route").alias("routes"))
    ranked = ranked.join(routes, "request").withColumn("quota", F.greatest(F.lit(1), F.least(F.lit(4), F.floor(F.lit(k) / F.col("routes")))))
    ranked = ranked.filter(F.col("rank") <= F.greatest(F.lit(4 * k), 4 * F.col("quota")))
    f = ranked.groupBy("request", "id").agg(F.sum(1 / (F.lit(depth) + F.col("rank"))).alias("rrf"), F.max("score").alias("best"), F.min("rank").alias("best_rank"))
    f = f.withColumn("fused", F.round(scoring.clamp(scoring.fused(F.col("best"), F.col("rrf") / F.max("rrf").over(whole))), 6))
    rows = ranked.join(f, ["request", "id"]).select("request", "route_no", "rank", "quota", "id", "best_rank", "fused")

    def choose(part: list) -> list[tuple]:
        chosen: dict = {}
        for no in sorted({r.route_no for r in part}):
            kept = 0
            for r in sorted((r for r in part if r.route_no == no), key=lambda r: r.rank):
                if len(chosen) < k and kept < r.quota and r.id not in chosen:
                    chosen[r.id] = r
                    kept += 1
        for r in sorted({r.id: r for r in part}.values(), key=lambda r: (-r.fused, r.id)):
            if len(chosen) < k:
                chosen.setdefault(r.id, r)
        return [(r.id, int(r.best_rank), float(r.fused), i) for i, r in enumerate(chosen.values(), 1)]

    kinds = dict(hits.dtypes)
    return _by_request(rows, choose, f"request {kinds['request']}, id {kinds['id']}, best_rank int, score double, place int")


def rerank_pool(candidates: DataFrame, limit: int) -> DataFrame:
    """The rerank pool of each request: candidates(request, id, source, channels array, score).

    The best max(limit / 2, min(40, limit)) come first; then the (source, channel) buckets take turns, in order of their names,
    with their next candidate that is not in yet. A bucket never needs more than its limit best, so each is ranked over all
    candidates and cut there; the turns are a fold over a request's buckets. No candidate is out of reach.
    """
    share = max(limit // 2, min(40, limit))
    order = [F.desc("score"), F.col("id")]
    c = candidates.select("request", "id", "score", F.coalesce("source", F.lit("record")).alias("source"), F.explode(F.when(F.size("channels") > 0, F.col("channels")).otherwise(F.array(F.lit("unknown")))).alias("channel"))
    c = c.withColumn("r", F.row_number().over(Window.partitionBy("request", "source", "channel").orderBy(*order))).filter(F.col("r") <= limit).drop("r")

    def choose(part: list) -> list[tuple]:
        best = {r.id: r for r in sorted(part, key=lambda r: (-r.score, r.id))}
        chosen = {i: 0 for i in list(best)[:share]}
        buckets: dict[tuple[str, str], list] = {}
        for r in sorted(part, key=lambda r: (-r.score, r.id)):
            buckets.setdefault((r.source, r.channel), []).append(r.id)
        queues = [(key, iter(ids)) for key, ids in sorted(buckets.items())]
        turn = 0
        while queues and len(chosen) < min(limit, len(best)):
            turn += 1
            for key, ids in list(queues):
                took = next((i for i in ids if i not in chosen), None)
                if took is None:
                    queues.remove((key, ids))
                elif len(chosen) < limit:
                    chosen[took] = turn
        return [(n, i, turn, float(best[i].score)) for n, (i, turn) in enumerate(chosen.items(), 1)]

    kinds = dict(candidates.dtypes)
    return _by_request(c, choose, f"request {kinds['request']}, n int, id {kinds['id']}, turn int, score double")


#: Weights of the parts of a signature: sessions, entities, queries, nodes, turns, words (fixed values).
SIGNATURE = {"session": 0.15, "entities": 0.20, "queries": 0.15, "nodes": 0.15, "turns": 0.10, "terms": 0.25}


def signature_similarity(a: dict, b: dict) -> float:
    """How alike two candidates are: equal sessions and Jaccard of each set, weighted."""
    total = SIGNATURE["session"] * bool(a["session"] and a["session"] == b["session"])
    for part in ("entities", "queries", "nodes", "turns", "terms"):
        x, y = a[part], b[part]
        if x and y:
            total += SIGNATURE[part] * len(x & y) / len(x | y)
    return min(1.0, total)


def mmr(candidates: DataFrame, k: int, weight: float = 0.75) -> DataFrame:
    """Greedy maximal marginal relevance in each request: weight * score - (1 - weight) * nearest chosen.

    candidates(request, id, score, text) and, where there are any, session and the arrays entities, queries, nodes, turns.
    Words are taken only from each request's 4k best, which are ranked before the group; the choice is sequential.
    """
    w = Window.partitionBy("request").orderBy(F.desc("score"), "id")
    pool = candidates.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= 4 * k)
    sets = [c for c in ("entities", "queries", "nodes", "turns") if c in candidates.columns]
    pool = pool.select("request", "id", "score", *[c for c in ("session",) if c in candidates.columns], *sets, token_set(F.col("text")).alias("terms"))

    def choose(part: list) -> list[tuple]:
        left = sorted(part, key=lambda x: (-x.score, x.id))
        folded = lambda v: frozenset(x.strip().casefold() if isinstance(x, str) else x for x in v) if v is not None else frozenset()
        marks = {x.id: {"session": getattr(x, "session", None)} | {c: folded(getattr(x, c, None)) for c in ("entities", "queries", "nodes", "turns", "terms")} for x in left}
        chosen: list = []
        while left and len(chosen) < k:
            value = lambda x: weight * x.score - (1 - weight) * max((signature_similarity(marks[x.id], marks[c.id]) for c in chosen), default=0.0)
            best = max(left, key=lambda x: (round(value(x), 9), x.score, -left.index(x)))
            chosen.append(best)
            left.remove(best)
        return [(x.id, float(x.score), i) for i, x in enumerate(chosen, 1)]

    kinds = dict(candidates.dtypes)
    return _by_request(pool, choose, f"request {kinds['request']}, id {kinds['id']}, score double, place int")


def episode_budget(selected: DataFrame, candidates: DataFrame, k: int, ratio: float | Column = 0.40, min_ratio: float | Column = 0.72) -> DataFrame:
    """Cap the dialogue rows of each request's selection and fill up with records (T4, U4).

    selected(request, id, source, score, routes array, place), candidates(request, id, source, score). Dialogue rows of a
    route that no selected record has always stay. Of the others those stay, in order of place, that score max(.35, best
    record * min_ratio) or more while fewer than clamp(max(2, round(k * ratio), routes of dialogue rows), 1, k) dialogue rows
    are in. Selections without dialogue rows or a positive record pass unchanged, up to k. Every condition on the rows
    before is a running count, so there is no fold. The ratios may be columns of selected.
    """
    whole, by_place = Window.partitionBy("request"), Window.partitionBy("request").orderBy("place", "id")
    before = by_place.rowsBetween(Window.unboundedPreceding, -1)
    episode = F.col("source") == "episode"
    best = candidates.filter(~episode).groupBy("request").agg(F.max("score").alias("best"))
    s = selected.join(best, "request", "left").withColumn("best", F.coalesce("best", F.lit(0.0)))
    routes_of = lambda on: F.array_distinct(F.flatten(F.collect_list(F.when(on, F.col("routes"))).over(whole)))
    s = s.withColumn("record_routes", routes_of(~episode)).withColumn("episode_routes", F.size(routes_of(episode)))
    s = s.withColumn("any", F.max(episode.cast("int")).over(whole)).withColumn("passes", (F.col("any") == 0) | (F.col("best") <= 0))
    s = s.withColumn("needed", episode & (F.size(F.array_except("routes", "record_routes")) > 0))
    s = s.withColumn("fit", episode & ~F.col("needed") & (F.col("score") >= F.greatest(F.lit(0.35), F.col("best") * min_ratio)))
    budget = F.greatest(F.lit(1), F.least(F.lit(k), F.greatest(F.lit(2), F.bround(F.lit(k) * ratio).cast("int"), F.col("episode_routes"))))
    ahead = F.coalesce(F.sum((F.col("needed") | F.col("fit")).cast("int")).over(before), F.lit(0))
    s = s.withColumn("ahead", ahead).withColumn("kept", F.col("passes") | ~episode | F.col("needed") | (F.col("fit") & (F.col("ahead") < budget)))
    kept = s.filter("kept").select("request", "id", "source", "score", "passes", F.when(F.col("passes"), F.col("place")).otherwise(F.lit(0)).alias("place"), F.lit(0).alias("late"))
    room = kept.groupBy("request").agg(F.count(F.lit(1)).alias("n"), F.max("passes").alias("passes")).filter(~F.col("passes")).select("request", (k - F.col("n")).alias("room"))
    fill = candidates.filter(~episode).join(kept.select("request", "id"), ["request", "id"], "left_anti").join(room, "request")
    fill = fill.withColumn("r", F.row_number().over(Window.partitionBy("request").orderBy(F.desc("score"), "id"))).filter("r <= room")
    fill = fill.select("request", "id", "source", "score", F.lit(False).alias("passes"), F.lit(0).alias("place"), F.lit(1).alias("late"))
    final = Window.partitionBy("request").orderBy("place", F.desc("score"), "late", "id")
    return kept.unionByName(fill).withColumn("n", F.row_number().over(final)).filter(F.col("n") <= k).select("request", "id", "source", "score", F.col("n").alias("place"))
