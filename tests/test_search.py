"""Search over routes: fusion, quotas, diversity and dialogue budget again in plain Python, row by row."""

import re

import pytest

from memloom.operators import ranking, search
from memloom.plans import retrieval
from memloom.sources import tables


def fused(rows, k):
    """(id, score) of the k that quotas and fused scores choose."""
    names = sorted({r.route_no for r in rows})
    quota = max(1, min(4, k // len(names)))
    near = [r for r in rows if r["rank"] <= max(4 * k, 16)]
    rrf, best = {}, {}
    for r in near:
        rrf[r.id] = rrf.get(r.id, 0) + 1 / (60 + r["rank"])
        best[r.id] = max(best.get(r.id, 0), r.final)
    score = {i: round(max(0, min(1, 0.82 * best[i] + 0.18 * rrf[i] / max(rrf.values()))), 6) for i in rrf}
    chosen = []
    for no in names:
        kept = 0
        for r in sorted((r for r in near if r.route_no == no), key=lambda r: r["rank"]):
            if kept < quota and len(chosen) < k and r.id not in chosen:
                chosen.append(r.id)
                kept += 1
    chosen += [i for i in sorted(score, key=lambda i: (-score[i], i)) if i not in chosen][: k - len(chosen)]
    return {i: score[i] for i in chosen}


def alike(a, b):
    total = 0.15 * (a["session"] is not None and a["session"] != "" and a["session"] == b["session"])
    for part, weight in (("entities", 0.20), ("queries", 0.15), ("nodes", 0.15), ("turns", 0.10), ("words", 0.25)):
        if a[part] and b[part]:
            total += weight * len(a[part] & b[part]) / len(a[part] | b[part])
    return min(1, total)


def marks(r):
    fold = lambda xs: {x.strip().casefold() for x in xs or []}
    return {"session": r.session, "entities": fold(r.entities), "queries": fold(r.queries), "nodes": fold(r.nodes), "turns": set() if r.lo is None else set(range(r.lo, r.hi + 1)), "words": {w.casefold() for w in re.findall(r"\w+", r.text)}}


def diverse(scores, payload, k):
    left, chosen = sorted(scores, key=lambda i: (-scores[i], i)), []
    m = {i: marks(payload[i]) for i in left}
    while left and len(chosen) < k:
        value = [round(0.75 * scores[i] - 0.25 * max((alike(m[i], m[j]) for j in chosen), default=0), 9) for i in left]
        chosen.append(left.pop(max(range(len(left)), key=lambda n: (value[n], scores[left[n]], -n))))
    return chosen


def budgeted(order, scores, payload, routes, top, k, ratio, least):
    """The final ids in order."""
    dialogue = {i for i in top if payload[i].source == "episode"}
    best = max((top[i] for i in top if i not in dialogue), default=0)
    if not any(i in dialogue for i in order) or best <= 0:
        return [(i, scores[i]) for i in order][:k]
    covered = set().union(*(routes[i] for i in order if i not in dialogue))
    asked = set().union(*(routes[i] for i in order if i in dialogue))
    room, used, kept = max(1, min(k, max(2, round(k * ratio), len(asked)))), 0, []
    for i in order:
        if i not in dialogue:
            kept.append(i)
        elif routes[i] - covered:
            kept.append(i)
            used += 1
        elif scores[i] >= max(0.35, best * least):
            kept += [i] if used < room else []
            used += 1
    fill = [i for i in sorted(top, key=lambda i: (-top[i], i)) if i not in dialogue and i not in kept][: k - len(kept)]
    rows = [(-scores[i], 0, i) for i in kept] + [(-top[i], 1, i) for i in fill]
    return [(i, -s) for s, _, i in sorted(rows)][:k]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_search_row_by_row(spark, sf):
    d, k = f"/root/testdata/{sf}", retrieval.K
    requests, routes, channels, turns = retrieval._requests(spark), retrieval._routes(spark), retrieval._channels(spark, d), tables.dated_turns(spark, d)
    found = search.search(requests, routes, channels, turns, k)
    shown = {(r.request, r.record_id): r for r in search.provenance(found).collect()}
    found = found.collect()
    scored = search.route_search(requests, routes, channels, turns).join(routes.select("request", "route", "route_no", "goal"), ["request", "route"]).collect()
    ratios = {r.request: (r.episode_ratio, r.min_ratio) for r in requests.collect()}
    for request, (ratio, least) in ratios.items():
        rows = [r for r in scored if r.request == request]
        payload = {r.id: r for r in sorted(rows, key=lambda r: (r.final, -r.route_no))}  # the best route's, the first of equal ones
        top = {}
        matched = {}
        for r in rows:
            top[r.id] = max(top.get(r.id, 0), r.final)
            matched.setdefault(r.id, set()).add((r["rank"], r.route, r.goal))
        scores = fused(rows, k)
        order = diverse(scores, payload, k)
        want = budgeted(order, scores, payload, {i: {m[1] for m in matched[i]} for i in matched}, top, k, ratio, least)
        got = sorted((r for r in found if r.request == request), key=lambda r: r.place)
        assert [r.id for r in got] == [i for i, _ in want] and len(got) == k and [r.score for r in got] == pytest.approx([s for _, s in want], abs=2e-6)
        for r in got:
            p, seen = payload[r.id], shown[request, r.id]
            assert [tuple(m) for m in r.matched] == sorted(matched[r.id]) and (r.text, r.source, r.session, r.lo, r.hi) == (p.text, p.source, p.session, p.lo, p.hi)
            first = sorted(matched[r.id])[0]
            assert (seen.route_rank, seen.primary_route_id, seen.primary_route_goal) == first and seen.evidence_turn_range == (None if p.lo is None else list(range(p.lo, p.hi + 1)))
            assert seen.display_text == p.text and seen.matched_queries == p.queries and seen.matched_evidence_nodes == p.nodes


def test_evidence_of_hits_only(spark):
    """The evidence index of a search grows with the records, not with nodes times records."""
    d = "/root/testdata/sf0.01"
    near, records = retrieval._near(spark, d), tables.records(spark, d)
    hit, ids = {r.vec for r in near.collect()}, [r.record_id for r in records.select("record_id").collect()]
    nodes, index = retrieval._evidence_of(spark, d, near, records)
    assert len(hit) < tables.read(spark, d, "embeddings").count() and {int(r.id) for r in nodes.collect()} == hit
    assert sorted((int(r.id), r.record_id) for r in index.collect()) == sorted((n, i) for n in hit for i in ids if n % 50 == i % 50)


def test_signature_has_six_parts():
    a = {"session": "s", "entities": {"x", "y"}, "queries": {"q"}, "nodes": {"n", "m"}, "turns": {1, 2, 3}, "terms": {"a", "b", "c", "d"}}
    b = {"session": "s", "entities": {"y"}, "queries": {"q"}, "nodes": {"m", "o"}, "turns": {3}, "terms": {"d", "e"}}
    assert ranking.signature_similarity(a, b) == pytest.approx(0.15 + 0.20 / 2 + 0.15 + 0.15 / 3 + 0.10 / 3 + 0.25 / 5)
    assert ranking.signature_similarity(a, a) == pytest.approx(1.0) and ranking.signature_similarity(a, {k: type(v)() for k, v in a.items()}) == 0


def test_equal_scores_keep_the_first_route(spark):
    """An id with one score in two routes shows the first route's lists."""
    rows = [("b", 2, "from b", 0.5), ("a", 1, "from a", 0.5)]
    frame = spark.createDataFrame(rows, "route string, route_no int, text string, final double").repartition(2)
    from pyspark.sql import functions as F

    order = F.struct(F.col("final"), -F.col("route_no"))
    assert frame.agg(F.max_by("text", order)).first()[0] == "from a"


def test_reranked_scores(spark):
    """With a reranker's score the final one rests on it, else on the field score; the bonus and weights beside them."""
    base = "request int, route string, id string, source string, field double, distance double, queries array<string>"
    c = spark.createDataFrame([(1, "a", "x", "record", 0.5, 0.2, ["q", "p"]), (1, "a", "y", "episode", 0.5, 1.0, ["q"]), (1, "a", "z", "other", 0.5, 1.0, [])], base)
    rerank = spark.createDataFrame([(1, "a", "x", 0.9), (1, "a", "z", 0.8)], "request int, route string, id string, rerank double")
    got = {r.id: (round(r.final, 6), r["rank"]) for r in search.scored(c, rerank).collect()}
    plain = {r.id: (round(r.final, 6), r["rank"]) for r in search.scored(c).collect()}
    bonus = {"x": 0.03 * 0.8 + 0.02, "y": 0.01, "z": 0.0}
    assert plain == {"x": (round(0.5 + bonus["x"], 6), 1), "y": (round(0.5 + bonus["y"], 6), 2), "z": (round(0.5 * 0.95, 6), 3)}
    assert got["x"] == (round(0.9 * 1 + bonus["x"] + 0.01, 6), 1) and got["z"] == (round(0.8 * 0.95 + bonus["z"] + 0.01, 6), 2) and got["y"] == (plain["y"][0], 3)


@pytest.fixture(scope="module")
def long_texts(spark, tmp_path_factory):
    """sf0.001 with 20,000 further characters a document, which don't compress, and a date in every second one."""
    from pyspark.sql import functions as F

    d = tmp_path_factory.mktemp("long") / "sf"
    d.mkdir()
    for name in ("embeddings", "conversations"):
        (d / f"{name}.parquet").symlink_to(f"/root/testdata/sf0.001/{name}.parquet")
    noise = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(313)), lambda n: F.sha2(F.concat(F.col("doc_id").cast("string"), F.lit("/"), n.cast("string")), 256)), " ")
    date = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" on 2024-"), F.lpad((F.col("doc_id") % 12 + 1).cast("string"), 2, "0"), F.lit("-05"))).otherwise(F.lit(""))
    docs = tables.read(spark, "/root/testdata/sf0.001", "documents")
    docs.withColumn("text", F.concat(F.coalesce("text", F.lit("")), date, F.lit(" "), noise)).write.parquet(f"{d}/documents.parquet")
    return d


def test_texts_stay_in_their_table(spark, long_texts):
    """A search shuffles and stores less than the table of texts, of which it returns a few rows (F1)."""

    def moved():
        sc = spark.sparkContext._jsc.sc()
        sc.listenerBus().waitUntilEmpty(60_000)
        stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return {s.stageId(): s.shuffleWriteBytes() + s.outputBytes() for s in (stages.apply(i) for i in range(stages.size()))}

    before = set(moved())
    assert retrieval.search_end_to_end(spark, str(long_texts)).count() == len(retrieval.REQUESTS) * retrieval.K
    size = sum(f.stat().st_size for f in (long_texts / "documents.parquet").glob("*.parquet"))
    assert size > 2e6 and sum(n for stage, n in moved().items() if stage not in before) < size


def test_texts_by_reference(spark, long_texts):
    """Scores, ranks, dates and windows are those of candidates that carry their texts, and each text is found again."""
    d = str(long_texts)
    requests, routes, channels, turns = retrieval._requests(spark), retrieval._routes(spark), retrieval._channels(spark, d), tables.dated_turns(spark, d)
    texts = search.texts_of(tables.records(spark, d), turns)
    whole = search.route_search(requests, routes, channels, turns)
    light = search.stored(search.route_search(requests, routes, channels, turns, texts), "light")
    assert light.filter("source = 'record' and text is not null").isEmpty()
    got, want = (sorted(x.select(whole.columns).collect(), key=lambda r: (r.request, r.route, r["rank"])) for x in (search.with_texts(light, texts), whole))
    assert got == want and any("temporal_boost" in r.channels and r.t_start is None for r in got)


def test_texts_that_share_an_id(spark):
    """A row gets the text that its key stands for, once, however often the table has it; rows with an own text keep it."""
    from pyspark.sql import functions as F

    texts = spark.createDataFrame([("1", "a"), ("1", "b"), ("1", "b"), ("2", ""), ("3", "c")], "id string, text string")
    rows = spark.createDataFrame([(1, "1", "b", None), (2, "1", "a", None), (1, "2", "", None), (1, "w", None, "own")], "request int, id string, was string, text string")
    rows = rows.withColumn("text_key", F.when(F.col("was").isNotNull(), F.xxhash64("was")))
    got = search.with_texts(rows, texts)
    assert got.columns == ["request", "id", "was", "text"] and sorted((r.request, r.id, r.text) for r in got.collect()) == [(1, "1", "b"), (1, "2", ""), (1, "w", "own"), (2, "1", "a")]
