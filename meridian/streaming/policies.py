"""Policies over streams with state by key: progress, announcements, live answers, admission and rerouting.

Each keeps a row of state a key; rows of a micro-batch are taken in the order of their times, and rows older than the last
one seen are taken where they stand, so a stream that is in order equals the batch operator of the same name.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.geo import announce_band

SETTLE_MS, BACKOFF_MS, MOST_MS, MOVED_M = 30_000, 30_000, 120_000, 10.0


def keyed(rows: DataFrame, key: str, order: list[str], schema: str, state_schema: str, step: Callable, start: tuple) -> DataFrame:
    """step(state, row) gives the next state and the row to put out, or None, for the rows of a key in order."""

    def run(k, frames, state: GroupState):
        now = state.get if state.exists else start
        out = []
        for row in pd.concat(list(frames)).sort_values(order, kind="stable").itertuples(index=False):
            now, made = step(now, row)
            if made is not None:
                out.append(made)
        state.update(tuple(now))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    return rows.groupBy(key).applyInPandasWithState(run, schema, state_schema, "append", GroupStateTimeout.NoTimeout)


def progress(fixes: DataFrame, limit: float) -> DataFrame:
    """fixes (trip, ms, distance, along): (trip, ms, placed), the distance along the route, which never falls and stands still
    off the route."""

    def step(state, r):
        placed = max(state[0], r.along) if r.distance <= limit else state[0]
        return (float(placed),), (r.trip, r.ms, placed)

    return keyed(fixes.select("trip", "ms", "distance", "along"), "trip", ["ms"], "trip long, ms long, placed double", "placed double", step, (0.0,))


def announcements(rows: DataFrame, units: str = "metric") -> DataFrame:
    """rows (trip, ms, instruction, metres): those at which the pair of instruction and distance band changes."""

    def step(state, r):
        key = f"{r.instruction}@{r.band}"
        return (key,), None if key == state[0] else (r.trip, r.ms, r.instruction, r.band)

    banded = rows.select("trip", "ms", "instruction", announce_band(F.col("metres"), units).alias("band"))
    return keyed(banded, "trip", ["ms"], "trip long, ms long, instruction string, band long", "last string", step, ("",))


def live_answers(events: DataFrame) -> DataFrame:
    """events (key, ms, kind, token) of a request gate: begin and cancel raise the token, so answers to an older one are
    dropped: (key, ms, token) of the answers that are not."""

    def step(state, r):
        if r.kind == "answer":
            return state, (r.key, r.ms, r.token) if r.token == state[0] else None
        return (state[0] + 1,), None

    return keyed(events.select("key", "ms", "kind", "token"), "key", ["ms"], "key long, ms long, token long", "token long", step, (0,))


def fresh(fixes: DataFrame, delay_ms: int) -> DataFrame:
    """Fixes (ms, seen_ms) that were not stale when they were seen; stale ones are no evidence of a deviation."""
    return fixes.filter(F.col("seen_ms") - F.col("ms") <= delay_ms)


def reroute_step(state: tuple, r) -> tuple[tuple, tuple | None]:
    """One event of a trip. State: busy, failures, when the last request ended (-1: none), where the last good one began (x
    and y in metres, NaN: nowhere), the reason of the last failure."""
    busy, failures, ended, x, y, reason = state
    if r.kind == "begin":
        return (True, failures, ended, x, y, reason), (r.trip, r.ms, "rerouting", False, None)
    if r.kind in ("done", "failed"):
        good = r.kind == "done"
        at = (r.x, r.y) if good and r.x == r.x else (x, y)
        said = None if good else r.reason or "no new route found"
        return (False, 0 if good else failures + 1, r.ms, *at, "" if good else said), (r.trip, r.ms, "idle" if good else "failed", False, said)
    if busy:
        return state, (r.trip, r.ms, "rerouting", False, None)
    if r.state != "off":
        told = (reason or None) if r.state == "suspect" and failures else None
        return state, (r.trip, r.ms, "suspect" if r.state == "suspect" else "idle", False, told)
    if x == x and ((r.x - x) ** 2 + (r.y - y) ** 2) ** 0.5 < MOVED_M:
        return state, (r.trip, r.ms, "suspect", False, "waiting for a position update")
    wait = min(MOST_MS, BACKOFF_MS * 2 ** (failures - 1)) if failures else SETTLE_MS
    if ended >= 0 and r.ms - ended < wait:
        return state, (r.trip, r.ms, "failed" if failures else "suspect", False, reason if failures else "settling")
    return state, (r.trip, r.ms, "rerouting", True, None)


def reroutes(events: DataFrame) -> DataFrame:
    """events (trip, ms, kind, state, x, y, reason): (trip, ms, status, trigger, why) after each.

    kind is fix (state on, suspect or off, place in metres), begin, done (place of the fix that it answers) or failed (with
    a reason). A fix off the route triggers a request unless one runs, the place has not moved by 10 m since the last good
    one, or 30 s have not passed since the last one; after failures 30 s doubled up to 120 s.
    """
    rows = events.select("trip", "ms", "kind", "state", "x", "y", "reason")
    return keyed(rows, "trip", ["ms"], "trip long, ms long, status string, trigger boolean, why string", "busy boolean, failures long, ended long, x double, y double, reason string", reroute_step, (False, 0, -1, float("nan"), float("nan"), ""))
