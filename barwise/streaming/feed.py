"""The state of live feeds, carried over events and over silence.

Events say what a feed's connection does (phase, connected, closed, failed, tick). What follows from nothing happening comes from
processing-time timers: a silent feed turns stale and then falls back to polling, a lost one is told to connect again after a
backoff that grows with its failures, until it halts. One timer is set at a time, for whatever is due next.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: seq orders the events of a feed; kind is phase, connected, closed, failed or tick; phase has the session's phase with kind phase.
INPUT = ["feed", "seq", "kind", "phase"]
OUTPUT = "feed string, at_ms bigint, state string, action string, attempts int, silent_ms bigint"
_STATE = "phase string, connected boolean, last_ms bigint, since_ms bigint, attempts int, retry_ms bigint, shown string, timer_ms bigint"
_FIELDS = [f.split(" ")[0] for f in _STATE.split(", ")]
_NEW = dict(zip(_FIELDS, ("closed", False, None, None, 0, None, None, None), strict=True))


class FeedTimes(NamedTuple):
    """Seconds without a tick until a feed is stale and until it is polled; the wait before a reconnection; failures until it halts."""

    stale_s: float = 10.0
    rest_s: float = 30.0
    initial_s: float = 1.0
    multiplier: float = 2.0
    maximum_s: float = 60.0
    max_attempts: int = 20


def state_of(s: dict, now: int, times: FeedTimes) -> str:
    """idle, pre_open, connecting, live, stale, rest_fallback or halted: the rule of candles.feed_state() for one feed, whose
    attempts are those that failed."""
    if s["phase"] != "continuous":
        return "pre_open" if s["phase"] == "pre_open" else "idle"
    if s["attempts"] >= times.max_attempts:
        return "halted"
    age = now - (s["last_ms"] if s["connected"] else s["since_ms"])
    if age >= times.rest_s * 1000:
        return "rest_fallback"
    if not s["connected"]:
        return "connecting"
    return "stale" if age > times.stale_s * 1000 else "live"


def due(s: dict, now: int, times: FeedTimes) -> int | None:
    """When silence alone changes something next."""
    if state_of(s, now, times) in ("idle", "pre_open", "halted"):
        return None
    start = s["last_ms"] if s["connected"] else s["since_ms"]
    moments = [start + int(times.rest_s * 1000), s["retry_ms"]]
    if s["connected"]:
        moments.append(start + int(times.stale_s * 1000) + 1)
    return min((m for m in moments if m is not None and m > now), default=None)


def moved(s: dict, kind: str, phase: str | None, now: int, times: FeedTimes) -> dict:
    """A feed's state after an event."""
    s = dict(s)
    if kind == "phase":
        was, s["phase"] = s["phase"], phase
        if phase == "continuous" and was != phase:
            # a session opens: the feed is wanted from now on
            s |= {"since_ms": now, "last_ms": now, "retry_ms": None if s["connected"] else now}
        elif phase != "continuous":
            s |= {"connected": False, "retry_ms": None, "attempts": 0}
    elif kind == "connected":
        s |= {"connected": True, "last_ms": now, "since_ms": None, "attempts": 0, "retry_ms": None}
    elif kind == "closed" and s["connected"]:
        s |= {"connected": False, "since_ms": now, "retry_ms": now}
    elif kind == "failed":
        wait = min(times.initial_s * times.multiplier ** min(s["attempts"], 60), times.maximum_s)
        s |= {"connected": False, "attempts": s["attempts"] + 1, "retry_ms": now + int(wait * 1000)}
        s["since_ms"] = now if s["since_ms"] is None else s["since_ms"]
    elif kind == "tick" and s["connected"]:
        s["last_ms"] = now
    return s


class FeedProcessor(StatefulProcessor):
    """A row for each change of state, and one with action 'connect' when a reconnection is due."""

    def __init__(self, times: FeedTimes = FeedTimes()):
        self._times = times

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._state = handle.getValueState("feed", _STATE)

    def _settle(self, key, s: dict, now: int) -> Iterator[Row]:
        silent = None if s["last_ms"] is None else now - s["last_ms"]
        shown = state_of(s, now, self._times)
        if s["retry_ms"] is not None and s["retry_ms"] <= now and shown not in ("halted", "idle", "pre_open"):
            s["retry_ms"] = None
            yield Row(feed=key[0], at_ms=now, state=shown, action="connect", attempts=s["attempts"], silent_ms=silent)
        if shown != s["shown"]:
            s["shown"] = shown
            yield Row(feed=key[0], at_ms=now, state=shown, action=None, attempts=s["attempts"], silent_ms=silent)
        timer = due(s, now, self._times)
        if timer != s["timer_ms"]:
            if s["timer_ms"] is not None:
                self._handle.deleteTimer(s["timer_ms"])
            if timer is not None:
                self._handle.registerTimer(timer)
            s["timer_ms"] = timer
        self._state.update(tuple(s[f] for f in _FIELDS))

    def _load(self) -> dict:
        return dict(zip(_FIELDS, self._state.get(), strict=True)) if self._state.exists() else dict(_NEW)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        now, s = timerValues.getCurrentProcessingTimeInMs(), self._load()
        for r in sorted(rows, key=lambda r: r.seq):
            s = moved(s, r.kind, r.phase, now, self._times)
        yield from self._settle(key, s, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        s = self._load()
        if s["timer_ms"] == expiredTimerInfo.getExpiryTimeInMs():
            s["timer_ms"] = None
        yield from self._settle(key, s, timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass


def feed_states(events: DataFrame, times: FeedTimes = FeedTimes()) -> DataFrame:
    """A stream of OUTPUT rows from a stream of a feed's events (INPUT)."""
    rows = events.select("feed", F.col("seq").cast("long").alias("seq"), "kind", "phase")
    return rows.groupBy("feed").transformWithState(statefulProcessor=FeedProcessor(times), outputStructType=OUTPUT, outputMode="Append", timeMode="ProcessingTime")
