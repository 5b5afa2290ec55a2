"""Streams in the order of event times, with alarms and with state that goes away.

Rows of a key wait until the watermark has passed their time and are then taken in the order of (ms, id), whatever the order
they came in, so a stream equals the batch operator of the same name. A row later than the watermark is dropped, as is one
without a key or a time; the watermark begins at 0, so times (ms) are above it. A machine's alarm rings when the watermark reaches it, without a further row of its key; a machine
whose state is None leaves nothing behind.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType


class Turn(NamedTuple):
    """What a machine does: its next state (None: forget the key), when to be woken (None: never), the rows it puts out."""

    state: tuple | None
    alarm: int | None = None
    out: tuple = ()


@dataclass(frozen=True)
class Machine:
    """reads: columns of a row besides key, ms and id; step: (state or None, row) -> Turn; ring: (state, key, time) -> Turn."""

    reads: tuple[str, ...]
    out: str
    state: str
    step: Callable[[tuple | None, Row], Turn]
    ring: Callable[[tuple, int, int], Turn]


class _Ordered(StatefulProcessor):
    def __init__(self, machine: Machine, held: str):
        self.machine, self.held_schema = machine, held
        self.names = [f.split()[0] for f in machine.out.split(", ")]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", self.held_schema)
        self.state = handle.getValueState("state", f"{self.machine.state}, alarm long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new = [tuple(r[c] for c in ("key", "ms", "id", *self.machine.reads)) for r in rows]
        self.held.appendList(new)
        for ms in {r[1] for r in new}:
            self.handle.registerTimer(ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        fields = Row("key", "ms", "id", *self.machine.reads)
        held = [fields(*r) for r in self.held.get()] if self.held.exists() else []
        due = sorted((r for r in held if r.ms <= now), key=lambda r: (r.ms, r.id))
        if due:
            rest = [tuple(r) for r in held if r.ms > now]
            self.held.put(rest) if rest else self.held.clear()
        *state, alarm = self.state.get() if self.state.exists() else (None,)
        before, out = alarm, []
        turn = Turn(tuple(state) if state else None, alarm)

        def ring_until(ms: int, turn: Turn) -> Turn:
            while turn.state is not None and turn.alarm is not None and turn.alarm <= ms:
                turn = self.machine.ring(turn.state, key[0], turn.alarm)
                out.extend(turn.out)
            return turn

        for row in due:
            turn = self.machine.step(ring_until(row.ms, turn).state, row)
            out.extend(turn.out)
        turn = ring_until(now, turn)
        if turn.state is None:
            self.state.clear()
        else:
            self.state.update((*turn.state, turn.alarm))
            if turn.alarm is not None and turn.alarm != before:
                self.handle.registerTimer(turn.alarm)
        made = Row(*self.names)
        return iter([made(*r) for r in out])


def in_order(events: DataFrame, machine: Machine, delay: str = "10 seconds") -> DataFrame:
    """machine over events (key long, ms long, id long and what it reads), a stream that may be out of order by delay."""
    rows = events.filter("key IS NOT NULL AND ms IS NOT NULL").select("key", "ms", "id", *machine.reads, F.timestamp_millis("ms").alias("at")).withWatermark("at", delay)
    held = rows.drop("at").schema.simpleString()[len("struct<") : -1].replace(":", " ")
    return rows.groupBy("key").transformWithState(_Ordered(machine, held), StructType.fromDDL(machine.out), "append", "EventTime")


def stale(fixes: DataFrame, limit_ms: int = 20_000, first_ms: int = 6_000, delay: str = "10 seconds") -> DataFrame:
    """fixes (key, ms, id, kind): (key, ms, status). kind is start (positions are asked for), fix or end.

    live at a first fix and at one after silence, waiting if first_ms pass after the start without a fix, stale if more
    than limit_ms pass after a fix. What is stale, and a trip that has ended, keeps no state.
    """

    def step(state, r):
        if r.kind == "end":
            return Turn(None)
        if r.kind == "start":
            return Turn(("start",), r.ms + first_ms) if state is None else Turn(state, r.ms + (first_ms if state[0] == "start" else limit_ms + 1))
        return Turn(("live",), r.ms + limit_ms + 1, () if state == ("live",) else ((r.key, r.ms, "live"),))

    def ring(state, key, ms):
        return Turn(None, None, ((key, ms, "waiting" if state[0] == "start" else "stale"),))

    return in_order(fixes, Machine(("kind",), "key long, ms long, status string", "phase string", step, ring), delay)


def throttle(requests: DataFrame, gap_ms: int, delay: str = "10 seconds") -> DataFrame:
    """requests (key, ms, id) with start_ms: first come, first served, starts at least gap_ms apart. A key that rests for
    a gap is forgotten."""

    def step(state, r):
        start = max(r.ms, state[0]) if state else r.ms
        return Turn((start + gap_ms,), start + gap_ms, ((r.key, r.ms, r.id, start),))

    return in_order(requests, Machine((), "key long, ms long, id long, start_ms long", "free long", step, lambda s, key, ms: Turn(None)), delay)


def debounce(requests: DataFrame, quiet_ms: int, least: int = 2, delay: str = "10 seconds") -> DataFrame:
    """requests (key, ms, id, text): the last of each burst, put out once quiet_ms have passed, if its trimmed text has at
    least so many characters (a null text has not)."""

    def ring(state, key, ms):
        fine = state[2] is not None and len(state[2].strip(" ")) >= least
        return Turn(None, None, ((key, *state),) if fine else ())

    step = lambda state, r: Turn((r.ms, r.id, r.text), r.ms + quiet_ms)
    return in_order(requests, Machine(("text",), "key long, ms long, id long, text string", "last_ms long, last_id long, last_text string", step, ring), delay)


def expired(events: DataFrame, keep_ms: int, delay: str = "10 seconds") -> DataFrame:
    """events (key, ms, id, kind) of builds: (key, ms) when a build goes. kind is build, use (its time begins anew), lease or
    release. It goes keep_ms after its last use, or at the release of its last lease if that is later."""

    def step(state, r):
        until, leases = state or (r.ms + keep_ms, 0)
        if r.kind in ("build", "use"):
            until = r.ms + keep_ms
        leases = max(0, leases + {"lease": 1, "release": -1}.get(r.kind, 0))
        if leases == 0 and until <= r.ms:
            return Turn(None, None, ((r.key, r.ms),))
        return Turn((until, leases), None if leases else until)

    return in_order(events, Machine(("kind",), "key long, ms long", "until_ms long, leases long", step, lambda s, key, ms: Turn(None, None, ((key, ms),))), delay)


def latched(calls: DataFrame, limit: int = 3, delay: str = "10 seconds") -> DataFrame:
    """calls (key, ms, id, ok) with dead: whether limit calls in a row have failed by then; it stays so. Null is a failure.
    Only keys that are failing or dead keep a state."""

    def step(state, r):
        failed, dead = state or (0, False)
        failed = 0 if r.ok else failed + 1
        dead = dead or failed >= limit
        return Turn((failed, dead) if failed or dead else None, None, ((r.key, r.ms, r.id, dead),))

    return in_order(calls, Machine(("ok",), "key long, ms long, id long, dead boolean", "failed long, dead boolean", step, lambda s, key, ms: Turn(s)), delay)


def admit(requests: DataFrame, limit: int, window_ms: int, running: int, delay: str = "10 seconds") -> DataFrame:
    """requests (key, ms, id, hold_ms) with admitted: fewer than limit admitted ones of the key in the window before, and
    fewer than running of them not yet ended, hold_ms after they began (null: at once). Only admitted ones are recorded,
    and a key without any in the window and without a running one is forgotten."""

    def step(state, r):
        times, ends = state or ([], [])
        times, ends = [t for t in times if t > r.ms - window_ms], [e for e in ends if e > r.ms]
        fine = len(times) < limit and len(ends) < running
        if fine:
            times, ends = [*times, r.ms], [*ends, r.ms + (r.hold_ms or 0)]
        last = max([t + window_ms for t in times] + ends, default=None)
        return Turn((times, ends) if last else None, last, ((r.key, r.ms, r.id, fine),))

    return in_order(requests, Machine(("hold_ms",), "key long, ms long, id long, admitted boolean", "times array<long>, ends array<long>", step, lambda s, key, ms: Turn(None)), delay)


class _Silence(StatefulProcessor):
    def __init__(self, quiet_ms: int, keep_ms: int):
        self.quiet_ms, self.keep_ms = quiet_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ms long", ttlDurationMs=self.keep_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        latest = max(r["ms"] for r in rows)
        back = not self.last.exists()
        for ms in list(self.handle.listTimers()):
            self.handle.deleteTimer(ms)
        self.last.update((latest,))
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.quiet_ms)
        return iter([Row("key", "ms", "status")(key[0], latest, "live")] if back else [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if not self.last.exists():
            return iter(())
        (ms,) = self.last.get()
        self.last.clear()
        return iter([Row("key", "ms", "status")(key[0], ms, "stale")])


def silent(fixes: DataFrame, quiet_ms: int = 20_000, keep_ms: int = 3_600_000) -> DataFrame:
    """fixes (key, ms): (key, ms, status) by the clock of the machine, live when a key's fixes begin, and stale, with the
    time of its last fix, when none has come for quiet_ms. A key's state goes then, and after keep_ms in any case, which must
    be longer than a batch takes."""
    rows = fixes.filter("key IS NOT NULL AND ms IS NOT NULL").select("key", "ms")
    return rows.groupBy("key").transformWithState(_Silence(quiet_ms, keep_ms), StructType.fromDDL("key long, ms long, status string"), "append", "ProcessingTime")
