"""Compression of sessions with two thresholds, reranked scores, visual rows: each branch by hand."""

from pyspark.sql import functions as F

from memloom.operators import compaction, query_cache, search, stores

NONE = "session_id long, boundary_index int, content string"
TURNS = "session_id long, turn_index int, role string, content string, deleted boolean"


def turns(spark, **n_words):
    """Sessions s1, s2, ... of six turns each with so many words."""
    rows = [(int(s[1:]), i, "user" if i % 2 == 0 else "assistant", " ".join(["w"] * n), False) for s, n in n_words.items() for i in range(6)]
    return spark.createDataFrame(rows, TURNS)


def states(c):
    shown = {r.session_id: (r.origin, r.boundary_index) for r in c.decisions.collect()}
    summaries = sorted((r.session_id, r.boundary_index, r.content) for r in c.summaries.collect())
    prepared = sorted((r.session_id, r.boundary_index, r.content) for r in c.prepared.collect())
    return shown, summaries, prepared, sorted((r.session_id, r.turn_index) for r in c.turns.filter("deleted").collect())


def start(spark, ready=()):
    none = spark.createDataFrame([], NONE)
    return none.withColumn("token_count", F.lit(0).cast("long")), spark.createDataFrame(list(ready), NONE)


def test_thresholds(spark):
    """Sessions of 30, 78 and 108 tokens (a word is one, four blanks are one, a turn four more) with a budget of 100: nothing, prepared in the background, summed up at once."""
    t = turns(spark, s1=1, s2=8, s3=12)
    summaries, prepared = start(spark)
    one = compaction.compact(t, summaries, prepared, budget=100)
    s2, s3 = ("user: " + "w " * 8)[:-1] + "\n" + ("assistant: " + "w " * 8)[:-1], ("user: " + "w " * 12)[:-1] + "\n" + ("assistant: " + "w " * 12)[:-1]
    assert states(one) == ({1: ("none", 2), 2: ("background", 2), 3: ("fresh", 2)}, [(3, 2, s3)], [(2, 2, s2)], [(3, 0), (3, 1)])
    again = compaction.compact(one.turns, one.summaries, one.prepared, budget=100)
    assert states(again) == ({1: ("none", 2), 2: ("none", 2), 3: ("none", 0)}, [(3, 2, s3)], [(2, 2, s2)], [(3, 0), (3, 1)])
    more = again.turns.unionByName(spark.createDataFrame([(2, 6, "user", "x " * 20, False)], TURNS))
    third = compaction.compact(more, again.summaries, again.prepared, budget=100)
    assert states(third) == ({1: ("none", 2), 2: ("prepared", 2), 3: ("none", 0)}, [(2, 2, s2), (3, 2, s3)], [], [(2, 0), (2, 1), (3, 0), (3, 1)])
    usage = {r.session_id: r.tokens for r in compaction.context_usage(third.turns, third.summaries).collect()}
    assert usage[1] == 30 and usage[2] > 4 * 13 + 28 and usage[3] > 4 * 18


def test_unusable_summaries(spark):
    """What was prepared without a text is made anew; a summarizer that gives nothing changes nothing; earlier summaries come first."""
    t = turns(spark, s1=12)
    summaries, prepared = start(spark, [(1, 2, "  ")])
    assert states(compaction.compact(t, summaries, prepared, budget=100))[0] == {1: ("fresh", 2)}
    silent = lambda lines: lines.select("session_id", F.lit("").alias("content")).distinct()
    c = compaction.compact(t, summaries, start(spark)[1], silent, budget=100)
    assert states(c) == ({1: ("fresh", 2)}, [], [], [])
    old = spark.createDataFrame([(1, 1, "old", 5), (1, 1, "older", 5), (1, 0, "oldest", 5)], NONE + ", token_count long")
    lines = compaction.history(spark.createDataFrame([(1, 2)], "session_id long, boundary_index int"), t, old).orderBy("place").collect()
    assert [x.line[:40] for x in lines][:2] == ["[Previous Historical Summary]\nolder", "user: w w w w w w w w w w w w"] and len(lines) == 3
    empty = compaction.compact(t.limit(0), summaries, prepared, budget=100)
    assert states(empty)[0] == {} and states(empty)[2] == [(1, 2, "  ")]


def test_reranked(spark):
    """Results beyond the pool go, of two for one candidate the later counts, malformed answers give none."""
    pool = spark.createDataFrame([(1, "a", "x", 0), (1, "a", "y", 1), (2, "a", "z", 0)], "request int, route string, id string, n int")
    answers = [(1, "a", '{"results": [{"index": 0, "score": 0.9}, {"index": 5, "score": 1}, {"index": 0, "score": 0.4}, {"index": -1, "score": 1}]}'), (2, "a", "{oops")]
    got = search.reranked(pool, spark.createDataFrame(answers, "request int, route string, answer string")).collect()
    assert [(r.request, r.id, r.rerank) for r in got] == [(1, "x", 0.4)]


def test_visual_rows(spark):
    kinds = "record_id string, session_id string, timestamp string, caption string, entities string, caption_embedding string, confidence double, importance_score double, expired int, retrieval_count long, ttl int"
    rows = [("a", "s", "2024-01-02", None, '["x", "y"]', "[1, 2.5]", 0.0, 0.25, 0, 3, None), ("b", "s", None, "c", "{oops", None, None, 0.0, None, None, 5), ("c", "s", "2024-01-02", "c", None, "", 0.5, 1.0, 1, 0, 0), ("d", "t", "2024-01-03", "d", "[]", "[]", 1.0, 1.0, 0, 0, 0)]
    r = stores.visual_records(spark.createDataFrame(rows, kinds))
    got = {x.record_id: (x.caption, x.entities, x.caption_embedding, x.confidence, x.importance_score, x.expired, x.retrieval_count, x.ttl) for x in r.collect()}
    assert got["a"] == ("", ["x", "y"], [1.0, 2.5], 1.0, 0.25, False, 3, None)
    assert got["b"] == ("c", [], [], 1.0, 1.0, False, 0, 5)
    page = lambda *a, **k: [x.record_id for x in stores.visual_page(r, *a, **k).collect()]
    assert page() == ["d", "a", "b"] and page(2, 1) == ["a", "b"] and page(session="s", include_expired=True) == ["a", "c", "b"] and page(offset=9) == []
    assert [(x.session_id, x.place, x.record_id) for x in stores.session_visuals(r, 1).orderBy("session_id").collect()] == [("s", 1, "a"), ("t", 1, "d")]


def test_query_cache(spark):
    """The key used longest ago goes first; a key found counts as used; blanks and queries without a vector are not kept."""
    asked = []

    def embed(t):
        asked.append(sorted(r.text for r in t.collect()))
        return t.select("key", F.when(F.col("key") != "bad", F.array(F.length("text").cast("double"))).alias("vector"))

    batch = lambda *q: spark.createDataFrame(list(enumerate(q)), "place int, query string")
    keys = lambda c: sorted(r.key for r in c.collect())
    one = query_cache.embedded(query_cache.empty(spark), batch(" Aa ", "aA", "b", None, " ", "bad", "c"), embed, 1, 3)
    assert keys(one.vectors) == keys(one.cache) == ["aa", "b", "c"]
    two = query_cache.embedded(one.cache, batch("AA", "d"), embed, 2, 3)
    assert sorted((r.key, r.vector, r.fresh) for r in two.vectors.collect()) == [("aa", [2.0], 0), ("d", [1.0], 1)]
    assert keys(two.cache) == ["aa", "c", "d"]
    assert asked == [["Aa", "b", "bad", "c"], ["d"]]
    assert keys(query_cache.embedded(two.cache, batch(), embed, 3, 3).cache) == ["aa", "c", "d"]
