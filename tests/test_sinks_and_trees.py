"""Image files, statistics taken on the way, stored vectors and memory trees."""

import json
import os

import pytest
from pyspark.sql import functions as F

from memloom.operators import evidence, statistics, stores, vector_store
from memloom.sources import images


def test_images(spark, tmp_path):
    rows = [("s1/aa.png", b"one"), ("s1/aa.png", b"one"), ("s2/bb.jpg", b"b"), ("s2/none.png", b""), ("s2/null.png", None), ("s2/cc.webp", bytes(range(256)) * 5000), (None, b"lost")]
    frame = spark.createDataFrame(rows, "image_path string, content binary").repartition(3)
    images.write_images(frame, f"file://{tmp_path}")
    os.utime(tmp_path / "s1/aa.png", (1, 1))
    (tmp_path / "s2/bb.jpg").write_bytes(b"cut off")  # another size: written again
    images.write_images(frame, f"file://{tmp_path}")
    assert {(r.image_path, bytes(r.content), r.length) for r in images.read_images(spark, f"file://{tmp_path}").collect()} == {(p, c, len(c)) for p, c in rows if p and c}
    assert os.stat(tmp_path / "s1/aa.png").st_mtime == 1 and not [f for f in os.listdir(tmp_path / "s2") if f.endswith("part")]


def test_statistics(spark, tmp_path):
    path = f"file://{tmp_path}/usage.json"
    rows = spark.createDataFrame([("a", 3, 0.5), ("a", None, 1.0), ("b", 4, 2.0), ("z", 1, 1.0), (None, 2, 0.25)], "s string, t int, l double")
    for i in (1, 2):
        out, seen = statistics.observed(rows, ["a", "b", "unused"], F.col("s"), F.col("t"), F.col("l"))
        assert out.count() == 5
        statistics.save(spark, path, statistics.totals(seen, ["a", "b", "unused"]))
        assert {r.source: (r.calls, r.tokens, r.latency, r.mean_latency) for r in statistics.table(spark, path).collect()} == {"a": (2 * i, 3 * i, 1.5 * i, 0.75), "b": (i, 4 * i, 2.0 * i, 2.0), "other": (2 * i, 3 * i, 1.25 * i, 0.625)}
    assert json.loads((tmp_path / "usage.json").read_text())["a"]["calls"] == 4 and [f for f in os.listdir(tmp_path) if not f.endswith("crc")] == ["usage.json"]
    for crc in tmp_path.glob(".*.crc"):
        crc.unlink()
    (tmp_path / "usage.json").write_text("{oops")
    assert statistics.load(spark, path) == {} == statistics.load(spark, f"{path}.none")


def test_vector_store(spark, tmp_path):
    place = f"file://{tmp_path}"
    rows = lambda *r: spark.createDataFrame(list(r), "id long, vector array<float>")
    with pytest.raises(ValueError):
        vector_store.upsert(rows((1, [1.0])), place)
    assert [vector_store.opened(spark, place, w) for w in (3, 3, 2)] == ["created", "opened", "rebuilt"]
    vector_store.upsert(rows(*[(i, [float(i), 0.0]) for i in range(300)]), place)
    with pytest.raises(ValueError, match="2 components"):
        vector_store.opened(spark, place, 3)
    for wrong in ([1.0], None, [1.0, 2.0, 3.0]):
        with pytest.raises(ValueError):
            vector_store.upsert(rows((7, [9.0, 9.0]), (8, wrong)), place)
    before = {f: os.stat(f).st_mtime_ns for f in map(str, tmp_path.rglob("*.parquet")) if "part=" in f}
    vector_store.upsert(rows((5, [-5.0, 1.0]), (1000, [1.0, 1.0])), place)
    now = {r.id: r.vector for r in vector_store.rows(spark, place).collect()}
    assert now == {i: [float(i), 0.0] for i in range(300)} | {5: [-5.0, 1.0], 1000: [1.0, 1.0]}
    kept = [f for f in before if os.path.exists(f) and os.stat(f).st_mtime_ns == before[f]]
    assert len({f.split("part=")[1].split("/")[0] for f in before} - {f.split("part=")[1].split("/")[0] for f in kept}) <= 2  # other folders were not written


def test_memory_tree(spark):
    sets = [("big", x) for x in (1, 2, 3, 4)] + [("mid", x) for x in (1, 2, 3)] + [("low", x) for x in (1, 2)] + [("else", x) for x in (2, 9)] + [("same", x) for x in (2, 9)]
    sets = spark.createDataFrame([(s, i, f"about {s}") for s, i in sets], "set_id string, item long, name string")
    records = spark.createDataFrame([(i, 1, i, i + 1, f"t{9 - i}", f"r{i}") for i in (1, 2, 3, 4, 5, 9)], "record_id long, session_id long, lo int, hi int, created_at string, name string")
    turns = spark.createDataFrame([(1, i, "user", f"x{i}") for i in range(6)], "session_id long, turn_index int, role string, content string")
    tree = evidence.memory_tree(sets, records, turns).collect()
    composites = {(r.id, r.parent, r.depth, r.path, r.name) for r in tree if r.kind == "composite"}
    assert composites == {("big", None, 0, "big", "about big"), ("mid", "big", 1, "big/mid", "about mid"), ("low", "mid", 2, "big/mid/low", "about low"), ("else", None, 0, "else", "about else"), ("same", None, 0, "same", "about same")}
    held = {(r.id, r.parent, r.depth, r.path) for r in tree if r.kind == "record"}
    assert held == {("1", "low", 3, "big/mid/low/1"), ("2", "low", 3, "big/mid/low/2"), ("3", "mid", 2, "big/mid/3"), ("4", "big", 1, "big/4"), ("2", "else", 1, "else/2"), ("9", "else", 1, "else/9"), ("2", "same", 1, "same/2"), ("9", "same", 1, "same/9"), ("5", None, 0, "5")}
    # turn 2 rests on records 1 and 2: the later record was made earlier, so it is canonical, on each of its paths
    episodes = {(r.id, r.path) for r in tree if r.kind == "episode"}
    assert {p for i, p in episodes if i == "episode:1:2"} == {f"{p}/episode:1:2" for p in ("big/mid/low/2", "else/2", "same/2")}
    assert {p for i, p in episodes if i == "episode:1:5"} == {"5/episode:1:5"} and not any(i == "episode:1:0" for i, _ in episodes)


def test_tables_are_created_once_and_migrated(spark, tmp_path):
    place = f"file://{tmp_path}"
    assert {n: t.count() for n, t in stores.create_tables(spark, place).items()} == dict.fromkeys(stores.SCHEMAS, 0)
    spark.createDataFrame([("s", "tea", ["x"])], "session_id string, topic string, tags array<string>").write.mode("append").parquet(f"{place}/session_meta")
    again = stores.create_tables(spark, place)["session_meta"]  # what is there stays, newer columns are null
    assert [tuple(r) for r in again.collect()] == [("s", "tea", ["x"], None, None)]
    old = again.select("session_id", "topic").withColumn("own", F.lit(1))
    assert stores.migrated(old, stores.SCHEMAS["session_meta"]).columns == ["session_id", "topic", "own", "tags", "updated_at", "last_consolidated_turn_index"]
