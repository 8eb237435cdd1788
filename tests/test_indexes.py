"""Stored indexes: vectors in cells and full-text postings, against plans that read every row."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from memloom.operators import cells, postings, ranking, vectors
from memloom.sources import batches

SCHEMA = "vec_id long, embedding array<float>"


def clustered(n=600, seed=3):
    pick = np.random.default_rng(seed)
    centers = pick.normal(size=(12, 8)) * 4
    return [(i, [float(x) for x in (centers[i % 12] + pick.normal(size=8) * 0.3).round(3)]) for i in range(n)]


def hits(frame):
    return sorted((r.query_id, r["rank"], r.id, r.distance) for r in frame.collect())


def test_cells_equal_all_rows_and_read_few(spark, tmp_path):
    rows = clustered() + [(i, [1.0] * 8) for i in range(600, 640)]  # ties
    e, place = spark.createDataFrame(rows, SCHEMA).repartition(3), f"file://{tmp_path}"
    cells.build(e, place, n_cells=24)
    q = spark.createDataFrame([(i, rows[i][1]) for i in range(0, 60, 7)] + [(-1, [1.0] * 8), (-2, [0.0] * 8), (-3, [1.0, 2.0])], "query_id long, q array<float>")
    for k in (7, 1000):
        found, reads = cells.nearest(spark, place, q, k)
        assert hits(found) == hits(vectors.nearest(e, q, k))
        read = {r.query_id: (r.rows_read, r.rows_in_all) for r in reads.collect()}
        assert all(n <= whole == 640 for n, whole in read.values()) and -3 not in read
        if k == 7:
            assert sum(n for i, (n, _) in read.items() if i >= 0) < 0.3 * 640 * sum(i >= 0 for i in read)


def test_cells_kept_up(spark, tmp_path):
    rows, place = clustered(), f"file://{tmp_path}"
    e = spark.createDataFrame(rows, SCHEMA)
    cells.build(e.filter("vec_id < 300"), place, n_cells=9)
    q = spark.createDataFrame([(i, rows[i][1]) for i in (0, 1, 310)], "query_id long, q array<float>")
    far = spark.createDataFrame([(5, [50.0] * 8), (7, [-50.0] * 8)], SCHEMA)
    assert cells.add(e.filter("vec_id >= 300"), place) == 1 and cells.add(far, place) == 2
    cells.remove(spark.createDataFrame([(0,), (1,), (9999,)], "vec_id long"), place)
    now = e.filter("vec_id not in (0, 1, 5, 7)").unionByName(far)
    assert hits(cells.nearest(spark, place, q, 20)[0]) == hits(vectors.nearest(now, q, 20))
    cells.add(far, place, batch=2)  # written again: nothing changes
    assert hits(cells.nearest(spark, place, q, 20)[0]) == hits(vectors.nearest(now, q, 20))
    with pytest.raises(ValueError):
        cells.add(spark.createDataFrame([(1, [1.0, 2.0])], SCHEMA), place)
    assert batches.last_batch(spark, place, "cells") == 3
    # a batch whose mark is missing is not seen, and the next one takes its place
    batches.write_batch(e.filter("vec_id < 50").selectExpr("vec_id as id"), place, "removed", 4)
    assert hits(cells.nearest(spark, place, q, 20)[0]) == hits(vectors.nearest(now, q, 20))
    assert cells.add(spark.createDataFrame([(0, rows[0][1])], SCHEMA), place) == 4
    assert hits(cells.nearest(spark, place, q, 20)[0]) == hits(vectors.nearest(now.unionByName(e.filter("vec_id = 0")), q, 20))
    with pytest.raises(ValueError):
        cells.build(e.limit(0), f"{place}/none")


def corpus(n=120, seed=2):
    pick = random.Random(seed)
    words = ["license", "licenses", "licence", "Version", "apache", "a", "ab", "v", "v2", "12", "1e5", "the", *[f"w{i}" for i in range(40)]]
    return [(i, " ".join(pick.choice(words) for _ in range(pick.randrange(0, 30)))) for i in range(n)] + [(n, None), (n + 1, "")]


@pytest.mark.parametrize("prefixes", [False, True])
def test_postings_equal_texts(spark, tmp_path, prefixes):
    place = f"file://{tmp_path}"
    docs = spark.createDataFrame(corpus(), "doc_id long, text string").repartition(3)
    postings.add(docs.filter("doc_id < 70"), place)
    postings.add(docs.filter("doc_id >= 70"), place)
    same = lambda d, *terms: [tuple(r) for r in postings.search(spark, place, list(terms), 30, prefixes).collect()] == [tuple(r) for r in ranking.bm25(d, list(terms), 30, prefixes=prefixes).collect()]
    for terms in (("licen", "version"), ("a", "12", "1e", "V"), ("nothing",)):
        assert same(docs, *terms)
    new = spark.createDataFrame([(3, "version version apache"), (500, "licen"), (4, None)], "doc_id long, text string")
    assert postings.add(new, place) == 2
    assert postings.remove(spark.createDataFrame([(10,), (11,), (777,)], "doc_id long"), place) == 3
    now = docs.filter("doc_id not in (3, 4, 10, 11)").unionByName(new)
    assert same(now, "licen", "version", "apache")
    postings.add(new, place, batch=2)  # written again
    batches.write_batch(docs.selectExpr("doc_id as id"), place, "removed", 4)  # cut off before its mark
    assert same(now, "licen", "version", "apache")
    assert postings.add(spark.createDataFrame([(10, "licen back again")], "doc_id long, text string"), place) == 4
    now = now.unionByName(spark.createDataFrame([(10, "licen back again")], "doc_id long, text string"))
    assert same(now, "licen", "back")
    postings.compacted(spark, place, f"{place}/new")
    place = f"{place}/new"
    assert same(now, "licen", "version", "a")


def test_search_reads_the_folders_of_its_terms(spark, tmp_path):
    place = f"file://{tmp_path}"
    postings.add(spark.createDataFrame(corpus(), "doc_id long, text string"), place)
    plan = postings.terms_of(spark, place, ["license", "version"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "prefix" in plan.split("PartitionFilters")[1][:200]
    folders = {f.split("prefix=")[1][:2] for f in spark.read.parquet(f"{place}/postings").inputFiles()}
    assert {"li", "ve", "ap", "w1"} <= folders and all(len(x) <= 2 for x in folders)
    assert postings.search(spark, f"{place}/none", ["license"], 5).count() == 0


def test_words_counted_in_their_row(spark):
    """A document's postings need no shuffle before they are dealt to their folders; they tell each word's number of times."""
    t = spark.createDataFrame([(1, ["b", "a", "b", "c", "b"]), (2, []), (3, ["x"] * 5)], "id long, w array<string>")
    got = t.select("id", F.array_sort("w").alias("w")).select("id", F.inline(postings._counted(F.col("w"))))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect())) == [(1, "a", 1), (1, "b", 3), (1, "c", 1), (3, "x", 5)]
