"""Score formulas as Column expressions; constants are fixed values of the ranking."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NODE_WEIGHTS = {"entity": 0.34, "tag": 0.32, "entity_tag": 0.38, "event_frame": 0.42, "temporal": 0.36}
OTHER_NODE_WEIGHT = 0.30
#: Resolved retrieval strategies by question type.
STRATEGY_FIELDS = ("question_type", "evidence_mult", "record_mult", "turn_mult", "raw_mult", "assistant_bonus", "user_bonus", "episode_ratio", "min_ratio", "exp_window", "exp_limit", "exp_score", "win_size", "win_anchors", "gap", "chars")
STRATEGIES = [
    ("default", 1.0, 1.0, 1.0, 1.0, 0.0, 0.0, 0.40, 0.72, 0, 0, 0.0, 1, 24, 1, 2800),
    ("prior_assistant_response", 0.95, 0.95, 3.0, 1.22, 0.18, 0.04, 0.62, 0.52, 4, 10, 0.68, 4, 32, 2, 7000),
    ("personalized_advice", 1.25, 1.2, 1.8, 1.05, 0.04, 0.08, 0.48, 0.62, 3, 8, 0.62, 3, 28, 2, 5000),
    ("aggregate", 1.55, 1.45, 1.0, 1.0, 0.0, 0.0, 0.40, 0.70, 1, 3, 0.52, 1, 40, 1, 2800),
    ("temporal", 1.35, 1.3, 1.45, 1.0, 0.0, 0.0, 0.42, 0.64, 2, 5, 0.60, 2, 28, 1, 3600),
    ("comparison", 1.35, 1.3, 1.3, 1.0, 0.0, 0.0, 0.40, 0.66, 2, 5, 0.58, 2, 28, 1, 3600),
]


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def retrieval_score(distance: Column) -> Column:
    """1 - distance in [0, 1]; NaN and null count as no match."""
    return F.when(distance.isNull() | F.isnan(distance), F.lit(0.0)).otherwise(clamp(1 - distance))


def direct_hit(score: Column) -> Column:
    return 0.30 + 0.30 * score


def node_weight(kind: Column) -> Column:
    weight = F.lit(OTHER_NODE_WEIGHT)
    for name, w in NODE_WEIGHTS.items():
        weight = F.when(kind == name, F.lit(w)).otherwise(weight)
    return weight


def raw_turn(score: Column, mult: Column, role: Column, assistant_bonus: Column, user_bonus: Column) -> Column:
    bonus = F.when(role == "assistant", assistant_bonus).when(role == "user", user_bonus).otherwise(F.lit(0.0))
    return clamp((0.34 + 0.42 * score) * mult + bonus)


def record_bonus(strategy: Column, role: Column, memory_type: Column, has_time: Column) -> Column:
    """What a record gains by the question's type."""
    kind, who = F.lower(F.trim(memory_type)), F.lower(F.trim(role))
    return (
        F.when((strategy == "prior_assistant_response") & who.isin("assistant", "both"), F.lit(0.08))
        .when((strategy == "personalized_advice") & kind.isin("preference", "constraint", "event", "failure_pattern"), F.lit(0.05))
        .when((strategy == "temporal") & has_time, F.lit(0.04))
        .when(strategy.isin("aggregate", "comparison") & (kind == "event"), F.lit(0.03))
        .otherwise(F.lit(0.0))
    )


def signal_bonus(distance: Column, n_queries: Column) -> Column:
    return 0.03 * clamp(1 - distance) + F.least(F.lit(0.03), 0.01 * n_queries)


def final_score(field: Column, weight: Column, bonus: Column, rerank: Column | None = None) -> Column:
    plain = clamp(field * weight + bonus)
    return plain if rerank is None else F.when(rerank.isNotNull(), clamp(rerank * weight + bonus + 0.01)).otherwise(plain)


def source_weight(source: Column, override: Column | None = None) -> Column:
    """A source's weight, unless a candidate brings its own."""
    own = F.when(F.lower(F.trim(F.coalesce(source, F.lit("")))).isin("record", "episode"), F.lit(1.0)).otherwise(F.lit(0.95))
    return own if override is None else F.coalesce(override, own)


def fused(best: Column, rrf: Column) -> Column:
    return 0.82 * best + 0.18 * rrf


def rerank_score(raw: Column) -> Column:
    """Scores in [0, 1] stay; others go through a sigmoid; NaN and null are 0."""
    x = clamp(raw, -50.0, 50.0)
    return F.when(raw.isNull() | F.isnan(raw), F.lit(0.0)).when((raw >= 0) & (raw <= 1), raw).otherwise(1 / (1 + F.exp(-x)))


def decay(hours: Column, importance: Column, retrievals: Column, half_life: float = 168.0, longest: float = 720.0) -> Column:
    """Forgetting curve with an importance-weighted half-life and an additive boost (X17); null time: 0."""
    life = half_life * (1 + importance * (longest / half_life - 1))
    boost = F.least(F.lit(0.3), 0.05 * retrievals)
    return F.when(hours.isNull(), F.lit(0.0)).otherwise(F.round(F.least(F.lit(1.0), F.pow(F.lit(0.5), hours / life) + boost), 4))


def ttl_days(importance: Column) -> Column:
    return F.when(importance >= 0.8, 90).when(importance >= 0.5, 30).when(importance >= 0.3, 14).otherwise(7)


#: The prior of a chunk's end by its tokens so far, in pieces (below, base, rise, from, over), and beyond them.
LENGTH_PIECES, LENGTH_BEYOND = ((700, -1.30, 0.0, 0, 1), (1000, -0.80, 0.80, 700, 300), (1500, 0.45, 1.45, 1000, 500), (2000, 1.90, 0.90, 1500, 500)), 3.00
#: The same by its exchanges so far, for none to three; beyond, from .30 by .15 an exchange up to 1.
TURN_PIECES = (-0.85, -0.85, -0.15, 0.15)


def length_prior(tokens: int) -> float:
    return next((base + rise * (tokens - start) / span for below, base, rise, start, span in LENGTH_PIECES if tokens < below), LENGTH_BEYOND)


def length_hazard(tokens: Column) -> Column:
    """Piecewise linear prior of a chunk's end by its tokens so far."""
    hazard = F.lit(LENGTH_BEYOND)
    for below, base, rise, start, span in reversed(LENGTH_PIECES):
        hazard = F.when(tokens < below, base + rise * (tokens - start) / float(span)).otherwise(hazard)
    return hazard


def turn_prior(exchanges: int) -> float:
    return TURN_PIECES[exchanges] if exchanges < len(TURN_PIECES) else min(1.0, 0.30 + 0.15 * (exchanges - 4))


def turn_hazard(exchanges: Column) -> Column:
    few = F.get(F.array(*[F.lit(x) for x in TURN_PIECES]), exchanges.cast("int"))
    return F.when(exchanges < len(TURN_PIECES), few).otherwise(F.least(F.lit(1.0), 0.30 + 0.15 * (exchanges - 4)))


def compression(tokens: Column, budget: int = 128_000, warn: float = 0.70, block: float = 0.90) -> Column:
    """none, async or sync."""
    return F.when(tokens > budget * block, "sync").when(tokens > budget * warn, "async").otherwise("none")
