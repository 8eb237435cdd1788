"""JSON of unknown shape: planners' answers, canonical forms, rerankers' answers."""

import json

from pyspark.sql import functions as F

from memloom.functions import loose_json as loose
from memloom.operators import plans_io


def plans(spark, *answers, query=" Who met Ann? "):
    rows = spark.createDataFrame([(i, query, a) for i, a in enumerate(answers)], "plan_id int, query string, answer string")
    return plans_io.planner_answers(rows)


def as_dicts(df):
    return [r.asDict(recursive=True) for r in df.orderBy("plan_id").collect()]


def test_whole_plan(spark):
    answer = {
        "reason": "why", "mode": " Mixed ", "question_type": "Personalized-Advice", "semantic_queries": ["a", " ", 7, None, "b"], "pragmatic_queries": ["p"], "temporal_filter": {"since": "2024-03-01", "until": "soon"},
        "evidence_target": "t", "evidence_constraints": ["c"], "constraints": ["bare", {"type": "person", "text": " Ann "}, {"kind": "x"}, {"value": "v"}],
        "evidence_routes": [{"objective": " g ", "queries": ["q"]}, "no route", {"route_id": "none"}, {"queries": ["only"], "temporal_filter": {"until": "2024-05-06"}}, {"goal": "h", "constraints": [{"kind": "k", "value": "w"}]}],
    }
    (p,) = as_dicts(plans(spark, "```json\n" + json.dumps(answer) + "\n```"))
    assert (p["mode"], p["question_type"], p["semantic_queries"]) == ("mixed", "personalized_advice", ["a", "7", "b"])
    assert p["temporal_filter"] == {"since": "2024-03-01", "until": None}
    assert p["constraints"] == [{"kind": "other", "value": "bare"}, {"kind": "person", "value": "Ann"}, {"kind": "other", "value": "v"}]
    asked = ["Who met Ann?", "a", "7", "b", "p", "t", "c"]
    got = [(r["route_id"], r["evidence_goal"], r["queries"], r["temporal_filter"]["since"], r["temporal_filter"]["until"]) for r in p["evidence_routes"]]
    assert got == [("r1", "g", ["q"], "2024-03-01", None), ("r4", "t", ["only"], None, "2024-05-06"), ("r5", "h", asked, "2024-03-01", None)]


def test_malformed_and_odd_plans(spark):
    """Nothing, no JSON, other kinds, and values of another kind than expected are defaults; neighbours stay."""
    got = as_dicts(plans(spark, None, "", "{oops", "[1, 2]", '"text"', '{"semantic_queries": "one", "mode": 5, "constraints": "x", "evidence_routes": {"a": 1}, "temporal_filter": [1], "evidence_constraints": []}'))
    for p in got[:5]:
        assert (p["mode"], p["question_type"], p["semantic_queries"], p["evidence_target"], p["constraints"], p["temporal_filter"]) == ("answer", "single", ["Who met Ann?"], "Who met Ann?", [], None)
        assert [(r["route_id"], r["evidence_goal"], r["queries"]) for r in p["evidence_routes"]] == [("r1", "Who met Ann?", ["Who met Ann?"])]
    assert (got[5]["semantic_queries"], got[5]["mode"], got[5]["constraints"], len(got[5]["evidence_routes"])) == (["one"], "answer", [], 1)


def test_older_names_and_caps(spark):
    old = json.dumps({"is_aggregate_query": True, "aggregate_target": "t", "aggregate_constraints": ["x", ""], "reasoning": "r"})
    many = json.dumps({"semantic_queries": list("abcdefghijklmnopqrst"), "constraints": ["", *map(str, range(1, 30))], "evidence_routes": [{"goal": f"g{i}", "queries": list("abcdefghij")} for i in range(12)]})
    a, b = as_dicts(plans(spark, old, many))
    assert (a["question_type"], a["evidence_target"], a["evidence_constraints"], a["reason"]) == ("aggregate", "t", ["x"], "r")
    assert (len(b["semantic_queries"]), len(b["constraints"]), len(b["evidence_routes"]), {len(r["queries"]) for r in b["evidence_routes"]}) == (16, 11, 8, {8})


def test_plan_round_trip_and_routes(spark):
    p = plans(spark, '{"evidence_routes": [{"goal": "G", "queries": ["g", "Q", "q"], "constraints": [{"kind": "k", "value": "v"}, "b"]}], "temporal_filter": {"until": "2024-05-06"}}', None)
    again = plans_io.planner_answers(plans_io.plan_json(p))
    assert as_dicts(again) == as_dicts(p)
    r = plans_io.route_plans(p).orderBy("plan_id").collect()
    assert (r[0].semantic_queries, r[0].since, r[0].until, r[0].evidence_constraints) == (["G", "Q"], None, "2024-05-06", ["k: v", "other: b"])
    assert r[0].rerank_query == "Question: Who met Ann?\nEvidence goal: G\nRequired constraints: k: v | other: b"
    assert r[1].rerank_query == "Question: Who met Ann?\nEvidence goal: Who met Ann?"


def test_distinct_json(spark):
    given = ['{"b": 1, "a": [1, {"y": 2, "x": null}]}', '{"a":[1,{"x":null,"y":2}],"b":1}', "", None, "null", '""', '"t"', ' "t" ', "{oops", "{oops", '{"a":[{"x":null,"y":2},1],"b":1}']
    rows = spark.createDataFrame([(given,), ([],), (None,)], "found array<string>")
    got = [r[0] for r in rows.select(loose.distinct_json(F.col("found"))).collect()]
    assert got == [[given[0], '"t"', "{oops", given[10]], [], None]


def test_rerank_items(spark):
    answers = [
        '{"data": [{"index": "3", "score": "0.5"}, {"doc_index": 2.7, "rerank_score": [1, 2]}, {"index": null, "document_index": 4, "relevance": "x"}, 0.25, {"index": "2.5", "relevance_score": null, "score": 1}]}',
        '{"data": null, "results": [{"document_index": 1, "relevance": true}]}', '{"data": 5, "results": [{"index": 1}]}', '[{"index": 0}]', "[]", "{oops", "7", None,
    ]
    rows = spark.createDataFrame(list(enumerate(answers)), "id int, answer string")
    got = [[tuple(x) for x in r[0]] for r in rows.orderBy("id").select(loose.rerank_items(F.col("answer"))).collect()]
    assert got == [[(3, 0.5), (2, 2.0), (-1, 0.0), (-1, 0.25), (-1, 0.0)], [(1, 1.0)], [], [(0, 0.0)], [], [], [], []]
