"""Ingest as a stream: chunks, decisions, records and watermarks, over failures, replays and several batches."""

import math
import random

import numpy as np
import pytest

from memloom.operators import ingest, sessions
from memloom.sources import batches
from memloom.streaming import chunker

SCHEMA = "session_id long, turn_index int, role string, content string, last boolean"


def dialogues(n=9, seed=7, marked=True):
    pick, rows = random.Random(seed), []
    for session in range(n):
        topic = [pick.choice(["tea", "sea", "plan", "budget", "prefer", "always", "中文"]) for _ in range(5)]
        turns = pick.randrange(2, 14)
        for i in range(turns):
            topic = topic if pick.random() < 0.7 else [pick.choice(["w%d" % j for j in range(40)]) for _ in range(5)]
            text = " ".join(pick.choice(topic) for _ in range(pick.choice([0, 4, 60, 300, 700] if i != 3 else [2600])))
            rows.append((session, i, pick.choice(["user", "assistant", "user", "assistant", "system"]), text, marked and i == turns - 1))
    return rows


def plain_decisions(turns, target=1500, most=2000):
    """The chunker's log, written again without its state: exchanges first, then one decision after the other."""
    count = lambda t: chunker.token_estimate(t)
    exchanges = []
    for turn, role, text in turns:
        if text.strip():
            if role == "user" or not exchanges:
                exchanges.append([])
            exchanges[-1].append((turn, f"{role}: {text}", role, text))
    parts = []
    for e in exchanges:
        if count("\n".join(x[1] for x in e)) <= most:
            parts.append((e[0][0], "\n".join(x[1] for x in e), count("\n".join(x[1] for x in e)), False))
            continue
        group, total = [], 0
        for turn, line, role, text in [*e, (None, "", "", "")]:
            big = count(line) > most
            if group and (turn is None or big or total + count(line) > most):
                parts.append((group[0][0], "\n".join(x[1] for x in group), total, False))
                group, total = [], 0
            if big:
                parts += [(turn, piece, count(piece), True) for piece in chunker._fragments(role, text, most)]
            elif turn is not None:
                group, total = [*group, (turn, line)], total + count(line)
    unit = lambda m: m / n if (n := np.linalg.norm(m)) else m
    out, vectors, tokens, past = [], [], 0, []
    for turn, text, n, forced in parts:
        v = chunker.embed(text)
        told = False
        if not vectors:
            out.append(("start_chunk", False, "start", None, None, None, None, None, None, None, None, 0, n, 0, turn))
        elif forced or tokens + n > most:
            out.append(("cut_before_exchange", True, "oversized_turn_fragment" if forced else "capacity_limit", 0.0, 1.0, None, None, None, None, None, None, tokens, n, len(vectors), turn))
            vectors, tokens, told = [], 0, forced
        else:
            together = lambda vs: np.mean([x @ unit(np.mean(vs, axis=0)) for x in vs]) if len(vs) > 1 else 1.0
            centroid, tail = v @ unit(np.mean(vectors, axis=0)), v @ unit(np.mean(vectors[-2:], axis=0))
            surprise, drop = max(0, 1 - max(centroid, tail)), max(0, together(vectors) - together([*vectors, v]))
            z = 0.0
            if len(past) >= 5:
                spread = np.median(np.abs(np.array(past) - np.median(past)))
                z = min(4, max(-2, (surprise - np.median(past)) / (1.4826 * (spread or 1e-6))))
            k = len(vectors)
            turn_prior = -0.85 if k <= 1 else -0.15 if k == 2 else 0.15 if k == 3 else min(1, 0.3 + 0.15 * (k - 4))
            length = -1.3 if tokens < 700 else -0.8 + 0.8 * (tokens - 700) / 300 if tokens < 1000 else 0.45 + 1.45 * (tokens - 1000) / 500 if tokens < 1500 else 1.9 + 0.9 * (tokens - 1500) / 500
            score = 0.65 * max(min(2.5, max(-1, (surprise - 0.2) / 0.14)), 0.45 * z) + 0.45 * min(2.5, drop / 0.06) + 0.9 * length + 0.3 * turn_prior
            p = 1 / (1 + math.exp(1.1 - score))
            out.append(("cut_before_exchange" if p >= 0.55 else "append_exchange", p >= 0.55, "semantic_boundary" if p >= 0.55 else "append", score, p, surprise, centroid, tail, drop, length, turn_prior, tokens, n, k, turn))
            past = [*past, surprise][-64:]
            if p >= 0.55:
                vectors, tokens = [], 0
        if forced or tokens + n >= target:
            reason = "oversized_turn_fragment" if forced else "oversized_exchange" if tokens + n > most else "capacity_limit" if tokens + n == most else "target_length"
            if not told:
                out.append(("finalize_after_exchange", True, reason, 0.0, 1.0, None, None, None, None, None, None, tokens, n, len(vectors), turn))
            vectors, tokens = [], 0
        else:
            vectors, tokens = [*vectors, v], tokens + n
    return out


def test_decision_log(spark):
    rows = dialogues(14)
    turns = spark.createDataFrame(rows, SCHEMA).drop("last").selectExpr("*", "false deleted")
    got = chunker.decisions(turns).collect()
    seen = set()
    for session in range(14):
        mine = [r for r in sorted(got, key=lambda r: r.nth) if r.session_id == session]
        want = plain_decisions([r[1:4] for r in rows if r[0] == session])
        assert len(mine) == len(want)
        for a, b in zip(mine, want):
            shown = (a.action, a.cut, a.reason, *[a[x] for x in chunker.SIGNALS], a.chunk_tokens_before, a.new_exchange_tokens, a.chunk_exchanges_before, a.turn_index)
            assert all(x == y if not isinstance(y, float) or x is None else abs(x - y) < 2e-6 for x, y in zip(shown, b)), (shown, b)
        seen |= {(x[0], x[2]) for x in want}
    assert {r for _, r in seen} >= {"start", "append", "semantic_boundary", "capacity_limit", "oversized_turn_fragment", "target_length"}


def fold(rows):
    """Tokens, exchanges and turns that each session's fold has open."""
    out = {}
    for session in {r[0] for r in rows}:
        s = chunker.State()
        for _ in chunker.steps(s, [r[1:4] for r in rows if r[0] == session], False):
            pass
        if s.turns or s.pending:
            out[session] = (s.tokens, s.exchanges, len(s.turns) + len(s.pending))
    return out


def test_open_chunks_of_a_stopped_stream(spark, tmp_path):
    rows = dialogues(marked=False)
    for part in (0, 1):
        spark.createDataFrame([r for r in rows if (r[1] > 4) == bool(part)], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = chunker.log_stream(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), idle=None)
        stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
        got = {r.session_id: (r.tokens, r.exchanges, r.turns) for r in chunker.open_chunks(spark, str(tmp_path / "state")).collect()}
        assert got == fold([r for r in rows if part or r[1] <= 4]) and len(got) > 5


@pytest.mark.parametrize("fails", ["", "records", "watermarks"])
def test_failure_and_replay(spark, tmp_path, fails):
    """Two files as two batches; a run dies in the second while it writes a table, or after all of them, and goes on."""
    rows, place = dialogues(), f"file://{tmp_path}/out"
    source = lambda: spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    add = lambda some: spark.createDataFrame(some, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    died = []

    def write(log, batch, folder):
        if fails and not died and batch == 1:
            died.append(batch)
            if fails == "records":
                batches.write_batch(spark.range(3).selectExpr("'x' record_id"), folder, "records", batch)
            else:
                ingest.write_ingested(log, batch, folder)
            raise RuntimeError("lost")
        ingest.write_ingested(log, batch, folder)

    add([r for r in rows if r[1] <= 4])
    ingest.ingest_stream(source(), place, idle=None, write=write)
    before = ingest.ingested(spark, place).records.count()
    add([r for r in rows if r[1] > 4])
    if fails:
        with pytest.raises(Exception, match="lost"):
            ingest.ingest_stream(source(), place, idle=None, write=write)
        if fails == "records":
            assert ingest.ingested(spark, place).records.count() == before  # what the batch left is not read
    ingest.ingest_stream(source(), place, idle=None, write=write)
    got = ingest.ingested(spark, place)
    turns = spark.createDataFrame(rows, SCHEMA).drop("last").selectExpr("*", "false deleted")
    want = ingest.ingest(turns, spark.createDataFrame([], "session_id long, watermark int"))
    same = lambda a, b, *names: sorted(map(repr, map(tuple, a.select(*names).collect()))) == sorted(map(repr, map(tuple, b.select(*names).collect())))
    assert same(got.chunks, want.chunks, *[c.split()[0] for c in chunker.OUTPUT.split(", ")])
    whole = [(r[0], r[1]) for r in rows if r[3].strip()]
    assert {r.session_id: r.watermark for r in got.watermarks.collect()} == {s: max(i for t, i in whole if t == s) + 1 for s, _ in whole}
    whole_turns = "evidence_turns[0] <> 3"  # the fourth turns are too long for a chunk and make a record a fragment
    assert same(got.records.filter(whole_turns), want.records.filter(whole_turns), "record_id", "memory_type", "normalized_text", "entities")
    vectors = batches.read_batches(spark, place, "vectors", "record_id string, vector array<double>", "watermarks")
    assert {r[0] for r in vectors.select("record_id").collect()} == {r[0] for r in got.records.select("record_id").collect()}
    assert got.chunks.count() == got.chunks.distinct().count() and sessions.new_turns(turns, got.watermarks).filter("trim(content) <> ''").count() == 0


def test_batches_of_the_stream_are_small(spark, tmp_path):
    """What a Python worker holds of the stream is bounded by rows; other queries keep their setting."""
    name, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before = spark.conf.get(name)
    spark.createDataFrame(dialogues(3), SCHEMA).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))

    def write(log, batch, folder):
        seen.append(log.sparkSession.conf.get(name))
        log.write.format("noop").mode("overwrite").save()

    ingest.ingest_stream(source, f"file://{tmp_path}/out", write=write)
    assert seen and set(seen) == {str(ingest.BATCH_ROWS)} and spark.conf.get(name) == before
    run = ingest.embedded("t")
    vectors = spark.createDataFrame([("tea",), (None,), ("",)], "t string").select(run).collect()
    assert [r[0] for r in vectors] == [chunker.embed(t).tolist() for t in ("tea", "", "")]
