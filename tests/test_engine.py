"""Sequential operators against small Python versions, and the width contract."""

import random

import pytest

from memloom.functions import scoring, temporal, text
from memloom.operators import evidence, ranking, sessions, stores, vectors
from memloom.streaming import chunker


def one(spark, column, **values):
    from pyspark.sql import functions as F

    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]


def test_width_contract(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.0])], "vec_id long, embedding array<float>")
    assert vectors.width_report(rows, 4).first().asDict() == {"n_rows": 2, "n_wrong": 1, "min_width": 3, "max_width": 4}
    with pytest.raises(ValueError):
        vectors.checked(rows, 4)
    good = rows.filter("vec_id = 1")
    assert vectors.checked(good, 4).count() == 1
    q = good.selectExpr("vec_id query_id", "embedding q")
    assert [r["id"] for r in vectors.nearest(rows, q, 5).collect()] == [1]


@pytest.mark.parametrize("value, day", [("on 2024-02-30 or 2024-03-01", "2024-03-01"), ("May 3rd, 2023", "2023-05-03"), ("3 Dec 2022 noon", "2022-12-03"), ("2024年5月6日", "2024-05-06"), ("12024-05-066", None), ("", None), (None, None)])
def test_dates(spark, value, day):
    from pyspark.sql import functions as F

    assert one(spark, temporal.date_key(F.col("v").cast("string")), v=value) == day


def test_text(spark):
    from pyspark.sql import functions as F

    c = F.col("v").cast("string")
    assert one(spark, text.normalize_key(c), v="  Foo_Bar--Baz!  É ") == "foo bar baz é"
    assert one(spark, text.token_estimate(c), v="ab cd 中文") == chunker.token_estimate("ab cd 中文")
    assert one(spark, text.strip_fence(c), v='```json\n{"a": 1}\n```') == '{"a": 1}'
    assert one(spark, text.token_estimate(c), v=None) == 1
    assert one(spark, scoring.retrieval_score(F.col("d")), d=float("nan")) == 0.0


def merged(windows, gap):
    out = []
    for lo, hi, s in sorted(windows):
        if out and lo <= out[-1][1] + gap + 1:
            a = out[-1]
            out[-1] = (a[0], max(a[1], hi), min(1.0, max(a[2], s) + 0.03), a[3] + 1)
        else:
            out.append((lo, hi, s, 1))
    return [(lo, hi, n, round(s, 6)) for lo, hi, s, n in out]


def test_islands(spark):
    pick = random.Random(3)
    rows = [(g, lo := pick.randrange(60), lo + pick.randrange(4), round(pick.random(), 3)) for g in range(20) for _ in range(pick.randrange(1, 12))]
    got = sessions.islands(spark.createDataFrame(rows, "session_id int, lo int, hi int, score double"), 1).collect()
    for g in range(20):
        want = merged([r[1:] for r in rows if r[0] == g], 1)
        assert sorted((r["lo"], r["hi"], r["n_windows"], r["score"]) for r in got if r["session_id"] == g) == want


def alike(a, b):
    both = lambda k: len(a[k] & b[k]) / len(a[k] | b[k]) if a[k] | b[k] else 0.0
    return min(1.0, 0.15 * (a["session"] == b["session"]) + 0.2 * both("entities") + 0.25 * both("terms"))


def test_mmr(spark):
    pick = random.Random(2)
    rows = [(r, i, round(pick.random(), 3), " ".join(pick.choice("abcdef") for _ in range(5)), pick.choice("xy"), [pick.choice("pqr")]) for r in (1, 2) for i in range(60)]
    got = ranking.mmr(spark.createDataFrame(rows, "request int, id long, score double, text string, session string, entities array<string>"), 6).collect()
    for r in (1, 2):
        pool = sorted((x for x in rows if x[0] == r), key=lambda x: (-x[2], x[1]))[:24]
        marks = {x[1]: {"session": x[4], "entities": set(x[5]), "terms": set(x[3].split())} for x in pool}
        want: list = []
        while len(want) < 6:
            value = lambda x: round(0.75 * x[2] - 0.25 * max((alike(marks[x[1]], marks[c]) for c in want), default=0.0), 9)
            left = [x for x in pool if x[1] not in want]
            top = max(map(value, left))
            want.append(next(x[1] for x in left if value(x) == top))
        assert [x.id for x in sorted((x for x in got if x.request == r), key=lambda x: x.place)] == want


def test_nearest_answers_every_query(spark):
    pick = random.Random(4)
    rows = [(i, [round(pick.random(), 3) for _ in range(4)]) for i in range(300)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = vectors.nearest(frame, frame.selectExpr("vec_id query_id", "embedding q"), 2).collect()
    assert len(got) == 600
    for i, q in rows[::37]:
        want = sorted((round(sum((x - y) ** 2 for x, y in zip(q, v)), 6), j) for j, v in rows)[:2]
        assert [(r.distance, r.id) for r in sorted((r for r in got if r.query_id == i), key=lambda r: r.rank)] == want


def test_best_match_in_small_cells(spark):
    pick = random.Random(6)
    rows = [(i, [pick.gauss(0, 1) for _ in range(5)]) for i in range(90)] + [(90, [0.0] * 5), (91, [1.0, 2.0])]
    frame = spark.createDataFrame(rows, "i long, v array<double>")
    new, old = frame.filter("i % 3 = 0").selectExpr("i new_id", "v a"), frame.filter("i % 3 <> 0").selectExpr("i old_id", "v b")
    got = {r.new_id: (r.old_id, r.sim) for r in vectors.best_match(new, old, cell=10).collect()}
    assert got == {r.new_id: (r.old_id, r.sim) for r in vectors.best_match(new, old).collect()} and len(got) == 31
    norm = lambda v: sum(x * x for x in v) ** 0.5
    for i, v in rows[:90:3]:
        want = max((round(sum(x * y for x, y in zip(v, w)) / norm(v) / norm(w), 6), -j) for j, w in rows[:90] if j % 3)
        assert got[i] == (-want[1], want[0])


def test_cooldown(spark):
    from datetime import datetime, timedelta

    from memloom.streaming import throttle

    pick = random.Random(8)
    rows = [(i, pick.randrange(4), datetime(2024, 1, 1) + timedelta(seconds=pick.randrange(4000))) for i in range(200)]
    got = throttle.cooldown(spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz"), 300).collect()
    want, last = set(), {}
    for i, user, ts in sorted(rows, key=lambda r: (r[2], r[0])):
        if user not in last or (ts - last[user]).total_seconds() >= 300:
            want.add((i, user))
            last[user] = ts
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_upsert(spark):
    old = spark.createDataFrame([("a", 1, "x", "t1"), ("b", 2, "y", "t2")], "k string, seq int, v string, created string")
    new = spark.createDataFrame([("a", 3, "z", "t3")], old.schema)
    got = stores.upsert(old, new, "k", "seq", ["created"]).orderBy("k").collect()
    assert [(r["k"], r["v"], r["created"]) for r in got] == [("a", "z", "t1"), ("b", "y", "t2")]


def test_chunker_covers_every_turn_once():
    pick = random.Random(5)
    for _ in range(30):
        turns = [(i, pick.choice(["user", "assistant", "system"]), " ".join(pick.choice(["tea", "sea", "plan", "budget"]) for _ in range(pick.randrange(1, 400)))) for i in range(pick.randrange(1, 20))]
        found = list(chunker.feed(chunker.State(), turns, True))
        covered = sorted(i for _, a, b, *_ in found for i in range(a, b + 1))
        assert sorted(set(covered)) == [t[0] for t in turns]
        halves = chunker.State()
        at = pick.randrange(len(turns))
        twice = [*chunker.feed(halves, turns[: at + 1], False), *chunker.feed(halves, turns[at - 1 if at else 0 :], True)]
        assert twice == found


def test_chunker_splits():
    """Pieces of a long exchange take the ordinary path; only fragments of one long turn are chunks of their own."""
    long = lambda n: " ".join(["word"] * n)
    found = list(chunker.feed(chunker.State(), [(0, "user", long(900)), (1, "assistant", long(900)), (2, "system", long(900))], True))
    assert [f[1:3] for f in found] == [(0, 0), (1, 1), (2, 2)] and [f[5] for f in found] == ["capacity_limit", "capacity_limit", "session_flush"]
    found = list(chunker.feed(chunker.State(), [(0, "user", "hi"), (1, "assistant", long(3000)), (2, "user", "bye")], True))
    assert [f[5] for f in found] == ["oversized_turn_fragment"] * 3 + ["session_flush"] and [f[1:3] for f in found] == [(0, 0), (1, 1), (1, 1), (2, 2)]
    pieces = list(chunker._fragments("user", long(3000), 2000))
    assert all(p.startswith("user: ") and chunker.token_estimate(p) <= 2000 for p in pieces)
    assert " ".join(p.removeprefix("user: ") for p in pieces).split() == long(3000).split()
    text = "".join(random.Random(1).choice("ab 中,") for _ in range(500))
    out, buffer = [], ""  # the same, character by character
    for c in text:
        if buffer and chunker.token_estimate(f"x: {buffer}{c}") > 40:
            out, buffer = [*out, buffer], ""
        buffer += c
    assert list(chunker._fragments("x", text, 40)) == [f"x: {b.strip()}" for b in [*out, buffer] if b.strip()]


def test_stream_gives_the_chunks_of_the_batch(spark):
    from memloom.plans import catalog

    d = "/root/testdata/sf0.001"
    rows = lambda name: sorted(map(tuple, catalog.QUERIES[name](spark, d).collect()))
    assert rows("chunker_stream_equals_batch") == rows("chunker_batch")


def test_rerank_pool(spark):
    """Buckets of (source, channel) take turns; candidates in several buckets come once; low buckets have their turn."""
    kinds = "request int, id long, source string, channels array<string>, score double"
    low = [(1, 1000 + i, "a", ["low"], 1.0 - i) for i in range(3)]
    got = ranking.rerank_pool(spark.createDataFrame([(1, i, "a", ["x"], 9000.0 - i) for i in range(3000)] + low, kinds), 50).collect()
    assert {r.id for r in got if r.turn} == {40, 41, 42, 43, 44, 45, 46, 1000, 1001, 1002}
    pick = random.Random(9)
    rows = [(1, i, pick.choice("ab"), pick.sample(["x", "y", "z", "w"], pick.randrange(0, 4)), float(200 - i)) for i in range(200)]
    got = sorted(ranking.rerank_pool(spark.createDataFrame(rows, kinds), 90).collect(), key=lambda r: r.n)
    chosen = [r[1] for r in rows[:45]]
    buckets: dict = {}
    for r in rows:
        for c in r[3] or ["unknown"]:
            buckets.setdefault((r[2], c), []).append(r[1])
    while len(chosen) < 90:
        for key in sorted(buckets):
            left = [i for i in buckets[key] if i not in chosen]
            if left and len(chosen) < 90:
                chosen.append(left[0])
    assert [r.id for r in got] == chosen


def test_containment_signature(spark):
    """Bits of a subset are bits of its superset, and the tree is that of the sets themselves, also where signatures are full."""
    pick = random.Random(5)
    sets = {i: set(pick.sample(range(40), pick.randrange(1, 7))) for i in range(120)} | {200: set(range(3000)), 201: set(range(1, 3000)), 202: set(range(2999, 6000))}
    sets |= {300 + i: set(list(sets[i])[: len(sets[i]) // 2 + 1]) for i in range(40)}
    rows = spark.createDataFrame([(i, x) for i, s in sets.items() for x in s], "set_id long, item long")
    bits = {r.set_id: r[1:] for r in rows.groupBy("set_id").agg(*evidence._signature("item")).collect()}
    above = {c: [(len(sets[p]), p) for p in sets if sets[c] < sets[p]] for c in sets}
    assert all(not a & ~b for c, found in above.items() for _, p in found for a, b in zip(bits[c], bits[p]))
    assert any(a & ~b for c in sets for p in sets for a, b in zip(bits[c], bits[p]))
    assert {(r.child, r.parent) for r in evidence.containment_tree(rows).collect()} == {(c, min(found)[1]) for c, found in above.items() if found}
