"""Debounced boundaries, cooldowns and sessions as keyed state, in a table and in a stream."""

import random

import pytest

from memloom.streaming import lifecycle, throttle

SECOND = 1_000_000
SCHEMA = "event_id long, session_id long, at long, kind string, signal boolean"


def decided(spark, events, policy=lifecycle.Policy(debounce=5, boundary=15, hook=60, proactive=180, idle=1800)):
    rows = spark.createDataFrame([(i, 1, at * SECOND, kind, signal) for i, (at, kind, signal) in enumerate(events)], SCHEMA)
    return [(r.at // SECOND, r.kind, r.accepted, r.consolidated, r.reason, r.generation, r.dirty) for r in sorted(lifecycle.decisions(rows, policy).collect(), key=lambda r: (r.at, r.event_id is not None, r.event_id))]


def test_last_accepted_boundary_decides(spark):
    """At 0, 4 and 8 seconds with a gap of 5, the first and third are accepted: a steady trickle fires again."""
    rows = spark.createDataFrame([(i, u, t, k) for u in (1, 2) for i, (t, k) in enumerate([("2024-01-01 00:00:00", "r"), ("2024-01-01 00:00:04", "r"), ("2024-01-01 00:00:08", "r"), ("2024-01-01 00:00:09", "s"), ("2024-01-01 00:00:10", "r")])], "event_id long, user_id long, ts string, event_type string")
    rows = rows.withColumn("ts", rows.ts.cast("timestamp_ntz"))
    got = sorted((r.user_id, r.event_id, r.accepted, r.generation) for r in throttle.boundaries(rows, 5).collect())
    assert got == [(u, *x) for u in (1, 2) for x in [(0, True, 1), (1, False, 1), (2, True, 2), (3, True, 3), (4, True, 4)]]
    assert sorted(r.event_id for r in throttle.cooldown(rows.filter("user_id = 1"), 5).collect()) == [0, 2]
    assert throttle.boundaries(rows.limit(0), 5).count() == 0 and throttle.cooldown(rows.limit(0), 5).count() == 0


def test_tiers(spark):
    assert decided(spark, [(0, "hook", False), (1, "user", True), (2, "assistant", False), (3, "user", True), (100, "assistant", False), (182, "assistant", False)]) == [
        (0, "hook", False, False, "no_session", 0, 0), (1, "user", True, False, "turn", 0, 1), (2, "assistant", True, True, "proactive", 0, 0), (3, "user", True, False, "turn", 0, 1),
        (100, "assistant", True, False, "cooldown", 0, 2), (182, "assistant", True, True, "proactive", 0, 0),
    ]
    assert decided(spark, [(0, "user", False), (1, "hook", False), (2, "hook", False), (10, "user", False), (60, "hook", False), (61, "hook", False)])[1:] == [
        (1, "hook", True, True, "hook", 0, 0), (2, "hook", True, False, "clean", 0, 0), (10, "user", True, False, "turn", 0, 1), (60, "hook", True, False, "cooldown", 0, 1), (61, "hook", True, True, "hook", 0, 0),
    ]


def test_boundaries_rotate_and_end(spark):
    assert decided(spark, [(0, "user", False), (1, "before_reset", False), (3, "before_reset", False), (4, "session_end", False), (7, "before_reset", False), (8, "user", True), (13, "command_stop", False), (14, "before_reset", False), (15, "user", False), (16, None, False)]) == [
        (0, "user", True, False, "turn", 0, 1), (1, "before_reset", True, True, "boundary", 1, 0), (3, "before_reset", False, False, "debounced", 1, 0), (4, "session_end", False, False, "debounced", 1, 0),
        (7, "before_reset", True, False, "cooldown", 2, 0), (8, "user", True, False, "turn", 2, 1), (13, "command_stop", True, True, "boundary", 2, 0), (14, "before_reset", False, False, "no_session", 0, 0), (15, "user", True, False, "turn", 0, 1), (16, None, False, False, "unknown_kind", 0, 1),
    ]


def test_idle_sessions_are_forgotten(spark):
    got = decided(spark, [(0, "user", False), (1800, "before_reset", False), (1801, "user", False), (1802, "hook", False), (9000, "user", False)])
    assert got == [(0, "user", True, False, "turn", 0, 1), (1800, "idle", True, True, "idle", 0, 0), (1800, "before_reset", False, False, "no_session", 0, 0), (1801, "user", True, False, "turn", 0, 1), (1802, "hook", True, True, "hook", 0, 0), (3602, "idle", True, False, "clean", 0, 0), (9000, "user", True, False, "turn", 0, 1)]


def events(n=600):
    pick = random.Random(4)
    at, out = 0, []
    for i in range(n):
        at += pick.choice([0, 1, 2, 7, 40])
        out.append((i, pick.choice([1, 1, 1, 2, 3]), at * SECOND, pick.choice(["user", "assistant", "hook", "before_reset", "before_reset", "session_end", "command_stop", None]), pick.random() < 0.4))
    return out


@pytest.mark.parametrize("batches", [1, 3])
def test_stream_equals_batch(spark, tmp_path, batches):
    """Files one run after the other, the last run from what the ones before left as state; idle times within and between them."""
    rows, policy = events(), lifecycle.Policy(idle=60)
    kinds = lambda f: sorted(map(repr, map(tuple, f.collect())))
    got = None
    for b in range(batches):
        part = rows[b * len(rows) // batches : (b + 1) * len(rows) // batches]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        got = lifecycle.run_stream(spark, source, f"file://{tmp_path}/run", policy)
    want = lifecycle.decisions(spark.createDataFrame(rows, SCHEMA), policy)
    assert kinds(got) == kinds(want) and got.filter("kind = 'idle'").count() > 5
    again = lifecycle.run_stream(spark, spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), f"file://{tmp_path}/run", policy)
    assert kinds(again) == kinds(want)  # nothing new to read changes nothing


def test_folds_carry_state_over_batches(spark):
    """A key's rows in many Arrow batches, and many keys in one, fold alike."""
    rows = spark.createDataFrame(events(), SCHEMA)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    want = sorted(map(repr, map(tuple, lifecycle.decisions(rows).collect())))
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, 7)
        assert sorted(map(repr, map(tuple, lifecycle.decisions(rows).collect()))) == want
    finally:
        spark.conf.set(name, before)
    assert lifecycle.decisions(rows.limit(0)).count() == 0


def test_kinds_of_any_text_cross_the_stream(spark, tmp_path):
    """A session's decisions cross from Python as one text; unknown kinds keep theirs, whatever they hold."""
    assert len(lifecycle._packed(1, [(1, 2, "user", True, False, "turn", 0, 1)] * 9)[1].split("\n")) == 9
    kinds = ["user", "a,b\nc d", "", "=x", None, "中", "hook"]
    spark.createDataFrame([(i, 1, (i + 1) * SECOND, k, False) for i, k in enumerate(kinds)], SCHEMA).write.parquet(str(tmp_path / "in"))
    got = lifecycle.run_stream(spark, spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), f"file://{tmp_path}/run")
    assert [(r.kind, r.reason == "unknown_kind") for r in sorted(got.collect(), key=lambda r: r.at)] == [(k, k not in ("user", "hook")) for k in kinds]
