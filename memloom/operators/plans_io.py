"""Retrieval plans as rows: JSON parsing with caps, defaults, strategy resolution, planners' answers of any shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import loose_json as loose
from ..functions import scoring, temporal
from ..functions.text import bound, clean_terms, distinct_folded

#: Most routes, queries a route, semantic queries and constraints of a plan.
ROUTES, ROUTE_QUERIES, QUERIES, CONSTRAINTS = 8, 8, 16, 12
SCHEMA = (
    "question_type string, semantic_queries array<string>, constraints array<struct<kind:string,value:string>>, "
    "routes array<struct<route_id:string,goal:string,queries:array<string>>>, temporal struct<since:string,until:string>"
)
TYPES = ("single", "other", *[s[0] for s in scoring.STRATEGIES[1:]])


def _capped(c: Column, n: int) -> Column:
    return F.slice(distinct_folded(clean_terms(c)), F.lit(1), F.lit(n))


def parse_plans(rows: DataFrame, json: str = "plan", query: str = "query") -> DataFrame:
    """plan_id, query, question_type, semantic_queries, constraints (texts), routes, since, until: plans in the stored short form.

    Answers of planners, with their own names and any shape, are read by `planner_answers`. Malformed JSON is an empty plan; a plan without routes gets one of the query itself.
    """
    p = rows.select("plan_id", query, F.from_json(json, SCHEMA).alias("p"))
    kind = F.lower(F.trim(F.coalesce("p.question_type", F.lit("single"))))
    none = F.array().cast("array<struct<route_id:string,goal:string,queries:array<string>>>")
    given = F.slice(F.coalesce("p.routes", none), F.lit(1), F.lit(ROUTES))
    route = lambda r, i: F.struct(
        F.coalesce(F.nullif(F.trim(r["route_id"]), F.lit("")), F.concat(F.lit("route_"), (i + 1).cast("string"))).alias("route_id"),
        F.coalesce(r["goal"], F.col(query)).alias("goal"),
        _capped(F.concat(F.array(F.col(query)), F.coalesce(r["queries"], F.array().cast("array<string>"))), ROUTE_QUERIES).alias("queries"),
    )
    own = F.array(F.struct(F.lit("route_1").alias("route_id"), F.col(query).alias("goal"), F.array(F.col(query)).alias("queries")))
    text = lambda x: F.concat_ws(": ", x["kind"], x["value"])
    no_constraints = F.array().cast("array<struct<kind:string,value:string>>")
    return p.select(
        "plan_id", query, F.when(kind.isin(*TYPES), kind).otherwise(F.lit("single")).alias("question_type"),
        _capped(F.concat(F.array(F.col(query)), F.coalesce("p.semantic_queries", F.array().cast("array<string>"))), QUERIES).alias("semantic_queries"),
        F.slice(F.transform(F.coalesce("p.constraints", no_constraints), text), F.lit(1), F.lit(CONSTRAINTS)).alias("constraints"),
        F.when(F.size(given) > 0, F.transform(given, route)).otherwise(own).alias("routes"),
        F.col("p.temporal.since").alias("since"), F.col("p.temporal.until").alias("until"),
    )


def strategies(spark: SparkSession) -> DataFrame:
    """The table of resolved strategies: six rows."""
    return spark.createDataFrame(scoring.STRATEGIES, list(scoring.STRATEGY_FIELDS))


def with_strategy(plans: DataFrame) -> DataFrame:
    """Each plan with its strategy; types without one of their own take the default."""
    table = strategies(plans.sparkSession)
    known = [s[0] for s in scoring.STRATEGIES]
    name = F.when(F.col("question_type").isin(*known), F.col("question_type")).otherwise(F.lit("default"))
    return plans.withColumn("strategy", name).join(F.broadcast(table.withColumnRenamed("question_type", "strategy")), "strategy")


def depths(k: Column, evidence_mult: Column, record_mult: Column, turn_mult: Column) -> Column:
    """Channel limits (T5)."""
    at = lambda least, mult: F.floor(F.greatest(k * 1.0, F.lit(float(least))) * mult).cast("int")
    return F.struct(F.floor(F.greatest(3 * k, F.lit(30)) * evidence_mult).cast("int").alias("evidence"), F.floor(F.greatest(3 * k, F.lit(30)) * record_mult).cast("int").alias("records"), at(20, turn_mult).alias("turns"), F.greatest(10 * k, F.lit(100)).cast("int").alias("temporal"))


# ---- planners' answers of unknown shape ---------------------------------------------------------------------------

MODES = ("answer", "action", "mixed")


def _range(v: Column) -> Column:
    """since and until of a temporal filter as dates; null unless it is an object with one of them."""
    day = lambda n: temporal.date_key(loose.as_text(loose.inner(v, n)))
    both = F.struct(day("since").alias("since"), day("until").alias("until"))
    return bound(both, lambda r: F.when(F.coalesce(r["since"], r["until"]).isNotNull(), r))


def _constraints(v: Column) -> Column:
    """(kind, value) of the first elements of a constraint list, objects or bare texts, that have a value."""

    def one(x: Column) -> Column:
        record = loose.has_kind(x, "OBJECT")
        value = F.when(record, loose.first_text(x, "value", "text")).otherwise(loose.as_text(x))
        kind = F.when(record, F.nullif(F.trim(loose.first_text(x, "kind", "type")), F.lit("")))
        return F.struct(F.coalesce(kind, F.lit("other")).alias("kind"), F.trim(value).alias("value"))

    return F.filter(F.transform(F.slice(loose.list_items(v, "constraints"), 1, CONSTRAINTS), one), lambda x: x["value"] != "")


def _routes(v: Column) -> Column:
    """Routes of a plan that are objects with a goal or a query; ids are numbered by place in the answer."""

    def one(x: Column, i: Column) -> Column:
        given = F.coalesce(F.nullif(loose.first_text(x, "route_id"), F.lit("")), F.concat(F.lit("r"), (i + 1).cast("string")))
        return F.struct(
            loose.has_kind(x, "OBJECT").alias("record"), F.trim(given).alias("route_id"), F.trim(loose.first_text(x, "evidence_goal", "objective", "goal")).alias("evidence_goal"),
            loose.texts(loose.items(x, "queries"), ROUTE_QUERIES).alias("queries"), _constraints(x).alias("constraints"), _range(loose.inner(x, "temporal_filter")).alias("temporal_filter"),
        )

    found = F.transform(F.slice(loose.list_items(v, "evidence_routes"), 1, ROUTES), one)
    kept = F.filter(found, lambda r: r["record"] & ((r["evidence_goal"] != "") | (F.size(r["queries"]) > 0)))
    return F.transform(kept, lambda r: r.dropFields("record"))


def merged_texts(*parts: Column) -> Column:
    """Trimmed texts of arrays, one after another; the first spelling of each stays, whatever its case."""
    return distinct_folded(clean_terms(F.concat(*parts)))


def planner_answers(rows: DataFrame, answer: str = "answer", query: str = "query") -> DataFrame:
    """Plans in their executable form from planners' answers: plan_id, query and the plan's fields.

    rows(plan_id, query, answer). An answer may stand in a code fence and hold any JSON: fields of another kind than expected take
    their defaults, bare values stand for lists of one, numbers and true count as their text. Malformed answers are
    empty plans. Aggregate plans may use the older names for target and constraints. What is missing is filled: queries and target
    by the query, routes by one that asks all of the plan's texts, each route's id, goal, queries and time range by the plan's.
    """
    p = rows.select("plan_id", query, F.trim(F.coalesce(query, F.lit(""))).alias("_q"), loose.parsed(F.col(answer)).alias("v"))
    v = F.col("v")
    aggregate = F.when(loose.as_text(loose.inner(v, "is_aggregate_query")) != "", F.lit("aggregate"))
    kind = F.coalesce(F.nullif(loose.first_text(v, "question_type"), F.lit("")), aggregate, loose.first_text(v, "kind"))
    own, older = loose.items(v, "evidence_constraints"), loose.items(v, "aggregate_constraints")
    p = p.select(
        "plan_id", query, "_q", loose.first_text(v, "reason", "reasoning").alias("reason"), loose.choice(loose.as_text(loose.inner(v, "mode")), MODES, "answer").alias("mode"), loose.choice(kind, TYPES, "single").alias("question_type"),
        loose.texts(loose.items(v, "semantic_queries"), QUERIES).alias("semantic_queries"), loose.texts(loose.items(v, "pragmatic_queries"), QUERIES).alias("pragmatic_queries"), _range(loose.inner(v, "temporal_filter")).alias("temporal_filter"),
        loose.first_text(v, "evidence_target", "aggregate_target").alias("evidence_target"), loose.texts(F.when(F.size(own) > 0, own).otherwise(older)).alias("evidence_constraints"), _constraints(v).alias("constraints"), _routes(v).alias("evidence_routes"),
    )
    p = p.withColumns({"semantic_queries": F.when(F.size("semantic_queries") > 0, F.col("semantic_queries")).otherwise(F.array("_q")), "evidence_target": F.coalesce(F.nullif("evidence_target", F.lit("")), "_q")})
    none = F.array().cast("array<string>")
    asked = merged_texts(F.array("_q"), F.col("semantic_queries"), F.when(F.col("mode") == "answer", none).otherwise(F.col("pragmatic_queries")), F.array("evidence_target"), F.col("evidence_constraints"))
    p = p.withColumn("_asked", asked)
    route = lambda r, i: F.struct(
        F.coalesce(F.nullif(r["route_id"], F.lit("")), F.concat(F.lit("r"), (i + 1).cast("string"))).alias("route_id"), F.coalesce(F.nullif(r["evidence_goal"], F.lit("")), F.col("evidence_target")).alias("evidence_goal"),
        F.when(F.size(r["queries"]) > 0, r["queries"]).otherwise(F.col("_asked")).alias("queries"), r["constraints"].alias("constraints"), F.coalesce(r["temporal_filter"], F.col("temporal_filter")).alias("temporal_filter"),
    )
    whole = F.struct(F.lit("r1").alias("route_id"), F.col("evidence_target").alias("evidence_goal"), F.col("_asked").alias("queries"), "constraints", "temporal_filter")
    routes = F.when(F.size("evidence_routes") > 0, F.transform("evidence_routes", route)).otherwise(F.array(whole))
    return p.withColumn("evidence_routes", routes).drop("_q", "_asked")


PLAN_FIELDS = ("reason", "mode", "question_type", "semantic_queries", "pragmatic_queries", "temporal_filter", "evidence_target", "evidence_constraints", "constraints", "evidence_routes")


def plan_json(plans: DataFrame) -> DataFrame:
    """plan_id, query, answer: plans of `planner_answers` as JSON that it reads back to the same plans."""
    return plans.select("plan_id", "query", F.to_json(F.struct(*PLAN_FIELDS)).alias("answer"))


def constraint_texts(constraints: Column) -> Column:
    """"kind: value" of each constraint."""
    return F.transform(constraints, lambda c: F.concat(F.when(c["kind"] != "", F.concat(c["kind"], F.lit(": "))).otherwise(F.lit("")), c["value"]))


def route_plans(plans: DataFrame) -> DataFrame:
    """A row a route of plans of `planner_answers`: what its search asks, within what, and what a reranker reads."""
    t = plans.select("*", F.posexplode_outer("evidence_routes").alias("n", "r"))  # never empty; outer, so that no filter computes the routes once more
    q, goal = F.trim(F.coalesce("query", F.lit(""))), F.col("r.evidence_goal")
    needs = constraint_texts(F.col("r.constraints"))
    line = lambda head, c: F.when(c != "", F.concat(F.lit(head), c))
    range_ = F.coalesce("r.temporal_filter", "temporal_filter")
    return t.select(
        "plan_id", (F.col("n") + 1).alias("route_no"), F.col("r.route_id").alias("route_id"), "question_type", F.slice(merged_texts(F.array(goal), F.col("r.queries")), F.lit(1), F.lit(ROUTE_QUERIES)).alias("semantic_queries"),
        range_["since"].alias("since"), range_["until"].alias("until"), F.coalesce(F.nullif(goal, F.lit("")), "evidence_target").alias("evidence_target"), F.when(F.size(needs) > 0, needs).otherwise(F.col("evidence_constraints")).alias("evidence_constraints"),
        F.concat_ws("\n", F.concat(F.lit("Question: "), q), line("Evidence goal: ", goal), line("Required constraints: ", F.array_join(needs, " | "))).alias("rerank_query"),
    )
