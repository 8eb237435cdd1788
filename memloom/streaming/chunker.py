"""Online semantic chunking of dialogues.

One fold, ``steps``, holds the semantics; the batch form applies it to each session's turns in order, the stream form to
each session's new turns with the rest of the fold as keyed state. The end of a session flushes the open chunk. The fold gives
rows of three kinds in one table, LOG: chunks, the turns of each chunk, and decisions with all their signals; they are split
afterwards. `open_chunks` reads what a stopped stream has pending from its checkpoint.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import scoring
from ..sources import tables
from ..sources.shared import shared_place

OUTPUT = "session_id bigint, chunk int, start_turn int, end_turn int, tokens int, exchanges int, reason string"
#: What a decision rests on; null where it was not asked for.
SIGNALS = ("score", "probability", "semantic_surprise", "centroid_similarity", "tail_similarity", "cohesion_drop", "length_hazard", "turn_hazard")
#: Columns of decisions and of turns beside session_id, chunk and nth, the place of a row among its session's.
DECISION = "action string, cut boolean, reason string, " + ", ".join(f"{x} double" for x in SIGNALS) + ", chunk_tokens_before int, new_exchange_tokens int, chunk_exchanges_before int, turn_index int"
TURN = "turn_index int, role string, content string"
LOG = f"{OUTPUT}, kind string, nth int, " + ", ".join(c for c in DECISION.split(", ") if not c.startswith("reason")) + ", role string, content string"
_NAMES = [c.split()[0] for c in LOG.split(", ")]
_STATE = "state string"
WIDTH = 64
HISTORY = 64


@dataclass(frozen=True)
class Limits:
    target: int = 1500
    most: int = 2000
    cut: float = 0.55


@dataclass
class State:
    """The open chunk of a session and what outlives its chunks."""

    chunk: int = 0
    start: int = -1
    end: int = -1
    tokens: int = 0
    exchanges: int = 0
    vectors: list[list[float]] = field(default_factory=list)
    #: Turns of the open chunk: (turn, role, text).
    turns: list[list] = field(default_factory=list)
    #: Rows given so far.
    nth: int = 0
    history: list[float] = field(default_factory=list)
    #: Turns of the exchange that is still growing: (turn, role, text).
    pending: list[list] = field(default_factory=list)


def token_estimate(text: str) -> int:
    cjk = len(re.findall(r"[一-鿿]", text))
    words = re.findall(r"[A-Za-z0-9_]+", text)
    return max(1, cjk + len(words) + max(0, len(text) - cjk - sum(map(len, words))) // 4)


def embed(text: str) -> np.ndarray:
    """The default embedding: hashed byte trigrams at length 1."""
    b = np.frombuffer(f" {text.lower()} ".encode(), np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(WIDTH)
    h = (b[:-2] * np.uint32(0x9E3779B1) ^ b[1:-1] * np.uint32(0x85EBCA77) ^ b[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)
    v = np.bincount(h >> np.uint32(26), np.where(h & np.uint32(1 << 16), 1.0, -1.0), WIDTH)
    n = float(np.sqrt(v @ v))
    return v / n if n else v


def _mean(vectors: np.ndarray) -> np.ndarray:
    m = vectors.mean(0)
    n = float(np.sqrt(m @ m))
    return m / n if n else m


def _cohesion(vectors: np.ndarray) -> float:
    return 1.0 if len(vectors) < 2 else float((vectors @ _mean(vectors)).mean())


def _robust_z(x: float, history: list[float]) -> float:
    if len(history) < 5:
        return 0.0
    middle = float(np.median(history))
    spread = float(np.median(np.abs(np.array(history) - middle))) or 1e-6
    return max(-2.0, min(4.0, (x - middle) / (1.4826 * spread)))


def boundary_signals(s: State, v: np.ndarray) -> dict[str, float]:
    """SIGNALS of a boundary before an exchange with vector v."""
    own = np.array(s.vectors)
    centroid, tail = float(v @ _mean(own)), float(v @ _mean(own[-2:]))
    surprise = max(0.0, 1.0 - max(centroid, tail))
    drop = max(0.0, _cohesion(own) - _cohesion(np.vstack([own, v])))
    sudden = max(max(-1.0, min(2.5, (surprise - 0.20) / 0.14)), 0.45 * _robust_z(surprise, s.history))
    length, turn = scoring.length_prior(s.tokens), scoring.turn_prior(s.exchanges)
    score = 0.65 * sudden + 0.45 * min(2.5, drop / 0.06) + 0.90 * length + 0.30 * turn
    return dict(zip(SIGNALS, (score, 1 / (1 + math.exp(-max(-50.0, min(50.0, score - 1.10)))), surprise, centroid, tail, drop, length, turn)))


def _parts(turns: list[list], most: int) -> Iterator[tuple[list[list], int, str, bool]]:
    """(turns, tokens, text, forced) of an exchange, split at turns where it would exceed most tokens.

    Only the fragments of a turn that is too long by itself are forced to be chunks of their own (W7, W8).
    """
    whole = "\n".join(f"{role}: {text}" for _, role, text in turns)
    if turns and (n := token_estimate(whole)) <= most:
        yield turns, n, whole, False
        return
    group: list[tuple[list, str]] = []
    total = 0
    whole_of = lambda: ([t for t, _ in group], total, "\n".join(x for _, x in group), False)
    for turn, role, text in turns:
        line = f"{role}: {text}"
        n = token_estimate(line)
        if group and (n > most or total + n > most):
            yield whole_of()
            group, total = [], 0
        if n > most:
            for piece in _fragments(role, text, most):
                yield [[turn, role, piece.removeprefix(f"{role}: ")]], token_estimate(piece), piece, True
            continue
        group.append(([turn, role, text], line))
        total += n
    if group:
        yield whole_of()


def _fragments(role: str, text: str, most: int) -> Iterator[str]:
    """The longest pieces of a turn's text that fit most tokens, each with the role in front; blank ones are left out.

    The estimate never falls as a text grows, so each end is found by halving.
    """
    at = 0
    while at < len(text):
        low, high = at + 1, len(text)
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if token_estimate(f"{role}: {text[at:middle]}") <= most else (low, middle - 1)
        if text[at:low].strip():
            yield f"{role}: {text[at:low].strip()}"
        at = low


def _row(s: State, kind: str, **values) -> dict:
    s.nth += 1
    return {"kind": kind, "nth": s.nth, "chunk": s.chunk} | values


def _close(s: State, reason: str) -> Iterator[dict]:
    """The open chunk with its turns; the next one is open and empty."""
    yield _row(s, "chunk", start_turn=s.start, end_turn=s.end, tokens=s.tokens, exchanges=s.exchanges, reason=reason)
    for turn, role, text in s.turns:
        yield _row(s, "turn", turn_index=turn, role=role, content=text)
    s.chunk, s.start, s.end, s.tokens, s.exchanges, s.vectors, s.turns = s.chunk + 1, -1, -1, 0, 0, [], []


def _decision(s: State, tokens: int, turn: int, action: str, cut: bool, reason: str, **signals: float) -> dict:
    return _row(s, "decision", action=action, cut=cut, reason=reason, chunk_tokens_before=s.tokens, new_exchange_tokens=tokens, chunk_exchanges_before=s.exchanges, turn_index=turn, **signals)


def _take(s: State, limits: Limits) -> Iterator[dict]:
    """Move the pending exchange into the open chunk; yield what is decided and the chunks that this ends."""
    pending, s.pending = s.pending, []
    for members, tokens, text, forced in _parts(pending, limits.most):
        v, about, told = embed(text), (tokens, members[0][0]), False
        if not s.exchanges:
            yield _decision(s, *about, "start_chunk", False, "start")
        elif forced or s.tokens + tokens > limits.most:
            reason = "oversized_turn_fragment" if forced else "capacity_limit"
            yield _decision(s, *about, "cut_before_exchange", True, reason, score=0.0, probability=1.0)
            yield from _close(s, reason)
            told = forced  # a fragment that cut before it is not told again after it
        else:
            signals = boundary_signals(s, v)
            cut = signals["probability"] >= limits.cut
            action, reason = ("cut_before_exchange", "semantic_boundary") if cut else ("append_exchange", "append")
            yield _decision(s, *about, action, cut, reason, **{k: round(x, 6) for k, x in signals.items()})
            s.history = [*s.history, signals["semantic_surprise"]][-HISTORY:]
            if cut:
                yield from _close(s, reason)
        total = s.tokens + tokens
        ends = forced or total >= limits.target
        reason = "oversized_turn_fragment" if forced else "oversized_exchange" if total > limits.most else "capacity_limit" if total >= limits.most else "target_length"
        if ends and not told:
            yield _decision(s, *about, "finalize_after_exchange", True, reason, score=0.0, probability=1.0)
        s.start = members[0][0] if s.start < 0 else s.start
        s.end, s.tokens, s.exchanges = members[-1][0], total, s.exchanges + 1
        s.vectors.append(v.tolist())
        s.turns += [list(m) for m in members]
        if ends:
            yield from _close(s, reason)


def steps(s: State, turns: Iterable[tuple[int, str, str]], flush: bool, limits: Limits = Limits()) -> Iterator[dict]:
    """Fold turns (turn, role, text), in order, into the state; turns not after its last one are duplicates. Rows of LOG without session_id."""
    for turn, role, text in turns:
        seen = s.pending[-1][0] if s.pending else s.end
        if turn <= seen or not text.strip():
            continue
        if role == "user" and s.pending:
            yield from _take(s, limits)
        s.pending.append([turn, role, text])
    if flush:
        yield from _take(s, limits)
        if s.exchanges:
            yield from _close(s, "session_flush")


def feed(s: State, turns: Iterable[tuple[int, str, str]], flush: bool, limits: Limits = Limits()) -> Iterator[tuple]:
    """The chunks that turns end: OUTPUT without session_id."""
    names = [c.split()[0] for c in OUTPUT.split(", ")][1:]
    return (tuple(r[n] for n in names) for r in steps(s, turns, flush, limits) if r["kind"] == "chunk")


def _frame(session, rows: Iterable[dict]) -> pd.DataFrame:
    return pd.DataFrame([[({"session_id": session} | r).get(n) for n in _NAMES] for r in rows], columns=_NAMES, dtype=object)


def of_kind(log: DataFrame, kind: str) -> DataFrame:
    """The rows of one kind, chunk, decision or turn, with their columns."""
    names = [c.split()[0] for c in ({"chunk": OUTPUT, "decision": f"session_id bigint, chunk int, nth int, {DECISION}", "turn": f"session_id bigint, chunk int, nth int, {TURN}"}[kind]).split(", ")]
    return log.filter(F.col("kind") == kind).select(*names)


def _folded(turns: DataFrame, frame: Callable[[int, Iterator], pd.DataFrame], fold: Callable, schema: str, limits: Limits) -> DataFrame:
    """A fold over each session's turns in order; a session is one conversation."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("turn_index")
        return frame(rows["session_id"].iloc[0], fold(State(), zip(rows["turn_index"].tolist(), rows["role"], rows["content"]), True, limits))

    return turns.filter("not deleted").select("session_id", "turn_index", "role", "content").groupBy("session_id").applyInPandas(run, schema)


def log(turns: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """LOG of each session."""
    return _folded(turns, _frame, steps, LOG, limits)


def chunks(turns: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Chunks of each session, without what else the fold tells."""
    names = [c.split()[0] for c in OUTPUT.split(", ")]
    return _folded(turns, lambda session, rows: pd.DataFrame([(session, *r) for r in rows], columns=names), feed, OUTPUT, limits)


def decisions(turns: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """A row a decision, with its signals."""
    return of_kind(log(turns, limits), "decision")


def log_stream(turns: DataFrame, limits: Limits = Limits(), idle: str | None = "30 minutes") -> DataFrame:
    """LOG of a stream of turns (session_id, turn_index, role, content, last boolean).

    A turn marked last flushes its session; so does a session idle for longer (processing time; None: never, as a run
    over what is there now would otherwise wait for the timers).
    """
    lengths = {"second": 1000, "minute": 60_000, "hour": 3_600_000}
    wait = int(idle.split()[0]) * lengths[idle.split()[1].rstrip("s")] if idle else None

    def run(key: tuple, frames: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        s = State(**json.loads(group.get[0])) if group.exists else State()
        if group.hasTimedOut:
            out = list(steps(s, (), True, limits))
            group.remove()
        else:
            rows = pd.concat(list(frames)).sort_values("turn_index")
            ends = bool(rows["last"].any())
            out = list(steps(s, zip(rows["turn_index"].tolist(), rows["role"], rows["content"]), ends, limits))
            group.update((json.dumps(asdict(s)),))
            if wait:
                group.setTimeoutDuration(wait)
        yield _frame(key[0], out)

    return turns.groupBy("session_id").applyInPandasWithState(run, LOG, _STATE, "append", GroupStateTimeout.ProcessingTimeTimeout if wait else GroupStateTimeout.NoTimeout)


def chunk_stream(turns: DataFrame, limits: Limits = Limits(), idle: str | None = "30 minutes") -> DataFrame:
    """Chunks of a stream of turns, as log_stream takes them."""
    return of_kind(log_stream(turns, limits, idle), "chunk")


def turn_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stored table of conversations as a stream of turns, of which the last of each session is marked."""
    ends = spark.read.parquet(path).groupBy("conv_id").agg(F.max("turn").alias("end"))
    turns = tables.stream(spark, path).join(ends, "conv_id")
    return turns.select(F.col("conv_id").alias("session_id"), F.col("turn").cast("int").alias("turn_index"), "role", F.coalesce("text", F.lit("")).alias("content"), (F.col("turn") == F.col("end")).alias("last"))


def stream_chunks(spark: SparkSession, path: str) -> DataFrame:
    """chunk_stream over a stored table of conversations, run until all of it is read."""
    place = shared_place(spark)
    out = chunk_stream(turn_stream(spark, path), idle=None).writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state")
    out.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(OUTPUT).parquet(f"{place}/out")


def open_chunks(spark: SparkSession, checkpoint: str) -> DataFrame:
    """session_id, tokens, exchanges, turns of the chunks that a stopped stream has open, from its state.

    Turns count those of the exchange that still grows, which has no tokens yet. Sessions with nothing pending have no row.
    """
    state = spark.read.format("statestore").load(checkpoint)
    kept = F.from_json(F.col("value.groupState.state"), "tokens int, exchanges int, turns array<string>, pending array<string>")
    rows = state.select(F.col("key.session_id").alias("session_id"), kept.alias("s"))
    found = rows.select("session_id", "s.tokens", "s.exchanges", (F.size("s.turns") + F.size("s.pending")).alias("turns"))
    return found.filter("turns > 0")
