"""All faults in turn-taking as they can be decided, on a live stream that comes out of order.

Events wait in state until the watermark has passed them and are then taken in order, so the
findings of a session are those of ``operators.turns.findings`` on the same events, whatever
order they came in within ``delay``.  Pairing is a queue: an end closes the oldest start that
waits.  What can't be decided yet stays open; a session silent for ``gap`` ends, and all its
state goes.  Needs the RocksDB state store (``use_state_store``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from gaugeworks.operators.turns import AGENT, ENDPOINT, KINDS, USER

#: Events of one moment: starts before ends, so that a segment may be empty; endpoints last.
ORDER = {k: n for n, k in enumerate((USER[0], AGENT[0], USER[1], AGENT[1], ENDPOINT))}
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> SparkSession:
    """The session with a state store that keeps lists and timers, for streams started later."""
    spark.conf.set(_PROVIDER, _ROCKS)
    return spark


class _Open:
    """What is undecided in one session; times are microseconds.

    users: [start, talked over], agents: starts, endpoints: moments, turns: ends that wait for
    an answer, barges: starts of closed user segments that an open agent segment may cover.
    """

    NAMES = ("user", "agent", "endpoint", "turn", "barge")

    def __init__(self, rows, timeout: int, tolerance: int, margin: int):
        self.timeout, self.tolerance, self.margin = timeout, tolerance, margin
        self.users, self.agents, self.endpoints, self.turns, self.barges = ([], [], [], [], [])
        for name, t, flag in sorted(rows):
            {"user": self.users, "agent": self.agents, "endpoint": self.endpoints, "turn": self.turns, "barge": self.barges}[name].append([t, flag] if name == "user" else t)

    def rows(self) -> list[tuple]:
        return [("user", t, f) for t, f in self.users] + [(n, t, False) for n, v in zip(self.NAMES[1:], (self.agents, self.endpoints, self.turns, self.barges), strict=True) for t in v]

    def take(self, t: int, kind: str) -> Iterator[tuple[str, int]]:
        """One event, in order; yields what it decides."""
        yield from self.settle(t)
        if kind == USER[0]:
            self.users.append([t, False])
        elif kind == AGENT[0]:
            self.agents.append(t)
        elif kind == USER[1] and self.users:
            start, over = self.users.pop(0)
            yield from ((KINDS[0], p) for p in self.endpoints if start <= p < t - self.margin)
            self.endpoints = [p for p in self.endpoints if not start <= p < t - self.margin]
            self.turns.append(t)
            if over:
                yield KINDS[2], start
            else:
                self.barges.append(start)
        elif kind == AGENT[1] and self.agents:
            start = self.agents.pop(0)
            covers = lambda s: start < s and t - s > self.tolerance
            self.users = [[s, over or covers(s)] for s, over in self.users]
            yield from ((KINDS[2], s) for s in self.barges if covers(s))
            self.barges = [s for s in self.barges if not covers(s)]
            self.turns = [e for e in self.turns if start > e + self.timeout]
        elif kind == ENDPOINT:
            self.turns = [e for e in self.turns if t > e + self.timeout]
            self.endpoints.append(t)
        # an endpoint matters while a user's start at or before it waits, a barge while an agent's does
        self.endpoints = [p for p in self.endpoints if self.users and self.users[0][0] <= p]
        self.barges = [s for s in self.barges if self.agents and self.agents[0] < s]

    def settle(self, now: int) -> Iterator[tuple[str, int]]:
        """Turns whose time is over before ``now``, unless an open agent segment may yet answer."""
        late = [e for e in self.turns if e + self.timeout < now and not any(a <= e + self.timeout for a in self.agents)]
        self.turns = [e for e in self.turns if e not in late]
        yield from ((KINDS[1], e) for e in late)

    def end(self) -> Iterator[tuple[str, int]]:
        """The session is over: starts without an end are none, so turns that wait are missed."""
        yield from ((KINDS[1], e) for e in self.turns)


class _Session(StatefulProcessor):
    def __init__(self, timeout: int, tolerance: int, margin: int, gap: int):
        self.rules, self.gap = (timeout, tolerance, margin), gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ahead = handle.getListState("ahead", "t long, kind string")
        self.undecided = handle.getListState("undecided", "name string, t long, flag boolean")
        self.last = handle.getValueState("last", "t long")

    def _wake(self, t: int) -> None:
        self.handle.registerTimer(-(-t // 1000))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # only kept here: a key's events of one batch are taken together, when its timers fire
        new = [(int(t), k) for part in rows for t, k in zip(part["us"], part["type"], strict=True)]
        if new:
            self.ahead.appendList(new)
            self._wake(min(t for t, _ in new))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        ahead = [(t, k) for t, k in self.ahead.get()] if self.ahead.exists() else []
        due = sorted((e for e in ahead if e[0] <= now), key=lambda e: (e[0], ORDER[e[1]]))
        ahead = [e for e in ahead if e[0] > now]
        state = _Open([tuple(r) for r in self.undecided.get()] if self.undecided.exists() else [], *self.rules)
        last, out = self.last.get()[0] if self.last.exists() else None, []
        for t, kind in due:
            if last is not None and t - last > self.gap:  # the session before this event is over
                out += state.end()
                state = _Open([], *self.rules)
            out += state.take(t, kind)
            last = t
        out += state.settle(now)
        if last is not None and last + self.gap < now:
            out += state.end()
            state, last = _Open([], *self.rules), None
        for held, rows in ((self.ahead, ahead), (self.undecided, state.rows())):
            held.put(rows) if rows else held.clear()
        if last is None:
            self.last.clear()
        else:
            self.last.update((last,))
            self._wake(last + self.gap + 1000)
        if ahead:
            self._wake(min(t for t, _ in ahead))
        for e in state.turns:
            self._wake(e + self.rules[0] + 1000)
        if out:
            yield pd.DataFrame({"session": [key[0]] * len(out), "kind": [k for k, _ in out], "t": [t / 1e6 for _, t in out]})

    def close(self) -> None:
        pass


def stream_findings(events: DataFrame, timeout: float = 2.0, tolerance: float = 0.3, margin: float = 0.05, delay: str = "10 seconds", gap: float = 600.0) -> DataFrame:
    """(session, kind, t) of a stream (session, ts, type), appended as they are decided; ``t``
    in seconds since 1970.  Other types, and rows without a session, a time or a type, are left
    out.  Silence of more than ``gap`` seconds ends a session: nothing pairs across it."""
    micro = lambda s: round(s * 1_000_000)
    kept = events.where(F.col("session").isNotNull() & F.col("type").isin(*ORDER)).withWatermark("ts", delay)
    kept = kept.select("session", "ts", "type", F.unix_micros("ts").alias("us")).where("us is not null")
    kind = events.schema["session"].dataType.simpleString()
    return kept.groupBy("session").transformWithStateInPandas(_Session(micro(timeout), micro(tolerance), micro(margin), micro(gap)), f"session {kind}, kind string, t double", "Append", "EventTime")


def late_events(query: StreamingQuery) -> int:
    """Events that came after the watermark had passed them and were left out, as the
    query's progress still holds them (the last 100 batches by default)."""
    return sum(o["numRowsDroppedByWatermark"] for p in query.recentProgress for o in p["stateOperators"])
