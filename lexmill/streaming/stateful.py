"""Folds over the events of a key, in order, with state that outlives a batch.

Each fold is a small pure function (state, event) -> (state, output). It runs on
a batch inside each key's group and on a stream with keyed state, with the same
result where a stream's batches arrive in order.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame

Fold = Callable[[dict[str, Any], float, str], str]


def rate_limit(most: int, seconds: float) -> Fold:
    """At most `most` grants in any `seconds`; a grant has expired once it is that old."""

    def fold(state: dict[str, Any], at: float, kind: str) -> str:
        granted = [t for t in state.get("granted", []) if t + seconds > at]
        ok = len(granted) < most
        state["granted"] = [*granted, at] if ok else granted
        return "granted" if ok else "refused"

    return fold


def circuit(failures: int = 3, cooldown: float = 30.0) -> Fold:
    """closed, open or half-open: opens after failures in a row, lets one probe through after the cooldown; a failure while open restarts it."""

    def fold(state: dict[str, Any], at: float, kind: str) -> str:
        opened = state.get("opened")
        half = opened is not None and at - opened >= cooldown
        if kind == "error":
            state["failed"] = state.get("failed", 0) + 1
            if opened is not None or state["failed"] >= failures:
                state["opened"] = at
        elif opened is None or half:
            state.update(failed=0, opened=None)
        return "half-open" if half else "closed" if opened is None else "open"

    return fold


def restarts(most: int = 5, seconds: float = 60.0) -> Fold:
    """Whether more than `most` restarts fell in `seconds` (one that old still counts), else the delay before the next."""

    def fold(state: dict[str, Any], at: float, kind: str) -> str:
        seen = [t for t in state.get("seen", []) if at - t <= seconds] + [at]
        state["seen"] = seen
        return "escalated" if len(seen) > most else f"{min(30.0, 0.5 * 2 ** (len(seen) - 1)):g}"

    return fold


def endpoint(on: float = 0.5, off: float = 0.35, start: float = 0.05, end: float = 0.55) -> Fold:
    """Speech with hysteresis: begins after `start` seconds above on, ends after `end` seconds below off. The level is the event's kind."""

    def fold(state: dict[str, Any], at: float, kind: str) -> str:
        level, talking = float(kind), state.get("talking", False)
        sure = level < off if talking else level >= on
        since = state.get("since") if sure else None
        since = at if sure and since is None else since
        if sure and at - since >= (end if talking else start):
            state.update(talking=not talking, since=None)
            return "end" if talking else "start"
        state.update(talking=talking, since=since)
        return "speech" if talking else "silence"

    return fold


def joined_deltas(state: dict[str, Any], at: float, kind: str) -> str:
    """Chunks of one answer joined: the text so far."""
    state["text"] = state.get("text", "") + kind
    return state["text"]


_OUT = "key string, event_id long, at double, kind string, outcome string"


def folded(events: DataFrame, fold: Fold) -> DataFrame:
    """key, event_id, at, kind, outcome of events (key, event_id, at in seconds, kind), in order of (at, event_id) within a key.

    A stream keeps each key's state as JSON; it has no timeout, since a
    breaker or a limit does not end by itself.
    """
    columns = ["key", "event_id", "at", "kind", "outcome"]

    def run(rows: pd.DataFrame, state: dict[str, Any]) -> pd.DataFrame:
        rows = rows.sort_values(["at", "event_id"])
        rows["outcome"] = [fold(state, at, kind) for at, kind in zip(rows["at"], rows["kind"], strict=True)]
        return rows[columns]

    if not events.isStreaming:
        return events.groupBy("key").applyInPandas(lambda rows: run(rows, {}), _OUT)

    def step(key: tuple, batches: Iterator[pd.DataFrame], held: Any) -> Iterator[pd.DataFrame]:
        state = json.loads(held.get[0]) if held.exists else {}
        yield run(pd.concat(list(batches)), state)
        held.update((json.dumps(state),))

    return events.groupBy("key").applyInPandasWithState(step, _OUT, "state string", "append", "NoTimeout")
