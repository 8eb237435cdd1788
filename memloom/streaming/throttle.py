"""Folds over each key's events in order: cooldowns and debounced boundaries.

What an event may do depends on the last one that did something, not on the one before, so these are folds. Events are
dealt by key and sorted inside partitions; a task then walks through its Arrow batches and carries only the state of the
key it is at, so a key with a third of all events takes time but no memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def in_order(rows: DataFrame, key: str, order: list[str], step: Callable[[Any, pd.DataFrame, bool], tuple[Any, pd.DataFrame]], schema: str) -> DataFrame:
    """Fold each key's rows in order.

    step(state, part, ends) gets the state that the key's part before left (None at first), the key's next rows and whether
    they are its last, and gives the new state and rows of schema. A part is what one Arrow batch holds of a key.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, held = None, None  # a key's last part waits until the next batch tells whether it goes on
        for frame in frames:
            out = []
            for value, part in frame.groupby(key, sort=False):
                if held is not None:
                    goes_on = held[key].iloc[0] == value
                    state, done = step(state, held, not goes_on)
                    out.append(done)
                    state = state if goes_on else None
                held = part
            if out:
                yield pd.concat(out)
        if held is not None:
            yield step(state, held, True)[1]

    dealt = rows.filter(F.col(key).isNotNull()).repartition(key).sortWithinPartitions(key, *order)
    return dealt.mapInPandas(run, schema)


def micros(ts: str = "ts") -> F.Column:
    """Microseconds since 1970 of a time without zone."""
    return F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), F.col(ts).cast("timestamp_ntz"))


def cooldown(events: DataFrame, seconds: int) -> DataFrame:
    """event_id, user_id of the events that run: those at least seconds after the last of their user that ran."""

    def step(last: int | None, part: pd.DataFrame, ends: bool) -> tuple[int | None, pd.DataFrame]:
        at, kept, i = part["at"].to_numpy(), [], 0
        if last is not None:
            i = int(np.searchsorted(at, last + seconds * 1_000_000))
        while i < len(at):
            kept.append(i)
            last = int(at[i])
            i = max(i + 1, int(np.searchsorted(at, last + seconds * 1_000_000)))
        return last, part.iloc[kept][["event_id", "user_id"]]

    return in_order(events.select("event_id", "user_id", micros().alias("at")), "user_id", ["at", "event_id"], step, "event_id long, user_id long")


def boundaries(events: DataFrame, seconds: int) -> DataFrame:
    """event_id, user_id, accepted, generation of boundaries(event_id, user_id, event_type, ts).

    A boundary of the kind of the last accepted one, and less than seconds after it, is skipped; the others are accepted, and
    each moves the session on by one generation.
    """

    def step(state: tuple | None, part: pd.DataFrame, ends: bool) -> tuple[tuple, pd.DataFrame]:
        kind, at, generation = state or (None, 0, 0)
        accepted, generations = [], []
        for k, t in zip(part["event_type"].tolist(), part["at"].tolist()):
            takes = k != kind or t - at >= seconds * 1_000_000
            if takes:
                kind, at, generation = k, t, generation + 1
            accepted.append(takes)
            generations.append(generation)
        return (kind, at, generation), part[["event_id", "user_id"]].assign(accepted=accepted, generation=generations)

    rows = events.select("event_id", "user_id", "event_type", micros().alias("at"))
    return in_order(rows, "user_id", ["at", "event_id"], step, "event_id long, user_id long, accepted boolean, generation long")
