"""A session's life as keyed state: turns make it dirty, boundaries and cooldowns decide when it is consolidated.

Events are (event_id, session_id, at in microseconds, kind, signal). Kinds: `user` and `assistant` turns, `hook` (a host's
stop hook), and the boundaries `before_reset`, `session_end` and `command_stop`. Of each session this is kept: the last
accepted boundary, the last consolidation, whether a turn with a long-term signal waits, how many turns are dirty, and the
generation.

* A boundary of the last accepted one's kind is skipped within `debounce` seconds, and so is an end after a reset.
* An accepted boundary consolidates, unless the last consolidation is less than `boundary` seconds ago and no signal waits.
  A reset then moves the generation on; an end or stop forgets the session.
* An assistant's turn consolidates when a signal waits and the last consolidation is at least `proactive` seconds ago.
* A hook consolidates a dirty session when the last consolidation is at least `hook` seconds ago.
* A session without events for `idle` seconds is consolidated if dirty, and forgotten.

`decisions` folds a table, `decision_stream` holds the same state in a stream (transformWithState), with event-time timers for
idle sessions. Both call `Session.take`, and the stream gives what the fold over the events so far gives.

Edge cases: a boundary or hook of an unknown session is skipped (`no_session`); null session ids are left out, null kinds are
skipped as `unknown_kind`; events at one time go by event_id; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.shared import shared_place
from . import throttle

OUTPUT = "session_id long, event_id long, at long, kind string, accepted boolean, consolidated boolean, reason string, generation int, dirty int"
_STATE = "last_event long, kind string, boundary_at long, consolidated_at long, pending boolean, dirty int, generation int"
_COLUMNS = [c.split()[0] for c in OUTPUT.split(", ")]
#: Between Spark and its Python workers each cell of a Row costs more than a decision, so an event crosses as one text, and the
#: decisions on a session's events as one text for every _PACK of them.
_CROSSING, _PACK = Row("session_id", "decided"), 1_000
#: Boundaries, and whether each ends the session (else it starts a new generation).
BOUNDARIES = {"before_reset": False, "session_end": True, "command_stop": True}
KINDS = ("user", "assistant", "hook", *BOUNDARIES)
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class Policy:
    """Seconds (fixed values: the hosts' defaults)."""

    debounce: int = 5
    boundary: int = 15
    hook: int = 60
    proactive: int = 180
    idle: int = 1800


@dataclass
class Session:
    """What is kept of a session; times in microseconds, None: never."""

    last_event: int
    kind: str | None = None
    boundary_at: int | None = None
    consolidated_at: int | None = None
    pending: bool = False
    dirty: int = 0
    generation: int = 0

    def rests(self, at: int, seconds: int) -> bool:
        """Whether the last consolidation is less than seconds ago."""
        return self.consolidated_at is not None and at - self.consolidated_at < seconds * 1_000_000

    def consolidate(self, at: int) -> None:
        self.consolidated_at, self.pending, self.dirty = at, False, 0


def expiry(session: Session, policy: Policy) -> int:
    return session.last_event + policy.idle * 1_000_000


def expired(session: Session, policy: Policy) -> tuple:
    """The row of a session that has been idle for too long."""
    return None, expiry(session, policy), "idle", True, session.dirty > 0, "idle" if session.dirty else "clean", session.generation, 0


def take(session: Session | None, policy: Policy, event_id: int, at: int, kind: str | None, signal: bool) -> tuple[Session | None, list[tuple]]:
    """The session after an event, and the rows (OUTPUT without session_id) that say what was decided."""
    rows = []
    if session is not None and at >= expiry(session, policy):
        rows.append(expired(session, policy))
        session = None
    if kind not in KINDS:
        rows.append((event_id, at, kind, False, False, "unknown_kind", session.generation if session else 0, session.dirty if session else 0))
        return session, rows
    if session is None and kind not in ("user", "assistant"):
        return None, [*rows, (event_id, at, kind, False, False, "no_session", 0, 0)]
    session = session or Session(at)
    session.last_event = at
    accepted, done, reason = True, False, "turn"
    if kind in ("user", "assistant"):
        session.dirty += 1
        session.pending |= kind == "user" and bool(signal)
        if kind == "assistant" and session.pending:
            done = not session.rests(at, policy.proactive)
            reason = "proactive" if done else "cooldown"
    elif kind == "hook":
        done = session.dirty > 0 and not session.rests(at, policy.hook)
        reason = "hook" if done else "cooldown" if session.dirty else "clean"
    else:
        near = session.boundary_at is not None and at - session.boundary_at < policy.debounce * 1_000_000
        accepted = not (near and (session.kind == kind or (kind, session.kind) == ("session_end", "before_reset")))
        if accepted:
            done = session.pending or not session.rests(at, policy.boundary)
            session.kind, session.boundary_at = kind, at
        reason = "debounced" if not accepted else "boundary" if done else "cooldown"
    if done:
        session.consolidate(at)
    if accepted and kind in BOUNDARIES and not BOUNDARIES[kind]:
        session.generation += 1
    rows.append((event_id, at, kind, accepted, done, reason, session.generation, session.dirty))
    return (None if accepted and BOUNDARIES.get(kind) else session), rows


def _frame(session_id: int, rows: list[tuple]) -> pd.DataFrame:
    kinds = {"event_id": "Int64", "at": "int64", "accepted": "bool", "consolidated": "bool", "generation": "int32", "dirty": "int32", "session_id": "int64"}
    return pd.DataFrame([(session_id, *r) for r in rows], columns=_COLUMNS).astype(kinds)


def decisions(events: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """A row an event, and one an expired session: events(event_id, session_id, at, kind, signal). Now is the time of the last event."""
    events = events.select("event_id", "session_id", "at", "kind", "signal")
    now = events.agg(F.max("at")).first()[0]

    def step(session: Session | None, part: pd.DataFrame, ends: bool) -> tuple[Session | None, pd.DataFrame]:
        out: list[tuple] = []
        for event in part[["event_id", "at", "kind", "signal"]].itertuples(index=False):
            session, rows = take(session, policy, *event)
            out += rows
        if ends and session is not None and expiry(session, policy) // 1000 <= now // 1000:  # a stream's clock has milliseconds
            out.append(expired(session, policy))
        return session, _frame(int(part["session_id"].iloc[0]), out)

    return throttle.in_order(events, "session_id", ["at", "event_id"], step, OUTPUT)


def _event(text: str) -> tuple:
    """at, whether event_id is null, event_id, signal and kind of an event that crossed as text."""
    event_id, at, signal, kind = text.split(" ", 3)
    return int(at), not event_id, int(event_id) if event_id else None, signal == "true", kind or None


def _packed(session_id: int, rows: list[tuple]) -> Row:
    """Rows of OUTPUT without session_id as one text: rows parted by newlines, cells by commas, None empty."""
    cell = lambda x: "" if x is None else str(x)
    return _CROSSING(session_id, "\n".join([",".join(map(cell, r)) for r in rows]))


class Lives(StatefulProcessor):
    """Sessions as state of a stream: one value a session, and a timer at which it has been idle for too long.

    A session's timer follows from its value, so none are listed. A timer that an earlier run with another policy has left
    fires for a session that is not idle yet, and does nothing.
    """

    def __init__(self, policy: Policy):
        self.policy = policy

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", _STATE)

    def _known(self) -> Session | None:
        kept = self.session.get()
        return None if kept is None else Session(*kept)

    def _timer(self, session: Session | None) -> int | None:
        return None if session is None else expiry(session, self.policy) // 1000

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        session, out = self._known(), []
        old = self._timer(session)
        for at, _, event_id, signal, kind in sorted((_event(r[-1]) for r in rows), key=lambda e: e[:3]):
            session, more = take(session, self.policy, event_id, at, kind, signal)
            out += more
        new = self._timer(session)
        if old not in (None, new):
            self.handle.deleteTimer(old)
        if session is not None:
            self.session.update(astuple(session))
            if new != old:
                self.handle.registerTimer(new)
        elif old is not None:
            self.session.clear()
        for i in range(0, len(out), _PACK):
            yield _packed(key[0], out[i : i + _PACK])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        session = self._known()
        if session is not None and self._timer(session) <= expiredTimerInfo.getExpiryTimeInMs():
            self.session.clear()
            yield _packed(key[0], [expired(session, self.policy)])

    def close(self) -> None:
        pass


def decision_stream(events: DataFrame, policy: Policy = Policy(), late: str = "0 seconds") -> DataFrame:
    """`decisions` over a stream; events later than late behind the newest one may be dropped."""
    timed = events.filter("session_id is not null").withColumn("time", F.timestamp_micros("at")).withWatermark("time", late)
    kind = F.when(F.col("kind").isin(*KINDS), F.col("kind")).otherwise(F.concat(F.lit("="), F.hex("kind")))  # unknown ones may hold anything
    cells = [F.coalesce(F.col("event_id").cast("string"), F.lit("")), F.col("at").cast("string"), F.coalesce("signal", F.lit(False)).cast("string"), F.coalesce(kind, F.lit(""))]
    timed = timed.select("session_id", "time", F.concat_ws(" ", *cells).alias("event"))
    lives = timed.groupBy("session_id").transformWithState(Lives(policy), "session_id long, decided string", "append", "EventTime")
    lives = lives.select("session_id", F.explode(F.split("decided", "\n")).alias("r")).select("session_id", F.split("r", ",", -1).alias("r"))
    typed = [F.when(F.get("r", F.lit(i)) != "", F.get("r", F.lit(i))).cast(t).alias(c) for i, (c, t) in enumerate(x.split() for x in OUTPUT.split(", ")[1:])]
    told = F.when(F.col("kind").startswith("="), F.decode(F.unhex(F.substr("kind", F.lit(2))), "utf-8")).otherwise(F.col("kind"))
    return lives.select("session_id", *typed).withColumn("kind", told)


def run_stream(spark: SparkSession, events: DataFrame, place: str, policy: Policy = Policy()) -> DataFrame:
    """Run decision_stream over what a streaming source holds now, with its state and results under place; all results so far.

    A second call goes on where the first, or a killed one, stopped.
    """
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, STORE)  # timers and typed state need it
    try:
        out = decision_stream(events, policy).writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state")
        query = out.outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(name, before)
    return spark.read.schema(OUTPUT).parquet(f"{place}/out")


def stream_over(spark: SparkSession, files: DataFrame, policy: Policy = Policy()) -> DataFrame:
    return run_stream(spark, files, shared_place(spark), policy)
