"""Turn-taking on a stream: the batch rules on event-time windows of closed sessions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gaugeworks.operators.turns import AGENT, USER


def stream_segments(events: DataFrame, gap: str = "10 minutes", delay: str = "2 minutes") -> DataFrame:
    """Sessions of a live stream (session, ts, type): by session window with a watermark,
    counts of starts, ends and endpoints once the session is closed."""
    late = events.withWatermark("ts", delay)
    kind = lambda k: F.count_if(F.col("type") == k)
    return late.groupBy("session", F.session_window("ts", gap).alias("w")).agg(
        F.count("*").alias("n_events"), kind(USER[0]).alias("n_user_starts"), kind(USER[1]).alias("n_user_ends"), kind(AGENT[0]).alias("n_agent_starts"), kind("agent_endpoint").alias("n_endpoints"),
    ).select("session", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_events", "n_user_starts", "n_user_ends", "n_agent_starts", "n_endpoints")


def stream_missed_turns(events: DataFrame, timeout_s: float = 2.0, delay: str = "2 seconds") -> DataFrame:
    """Turns without an answer in time, as they happen: (session, t).

    State of a session: the end of the user's turn that waits, and whether the agent
    speaks.  An event-time timer at the end plus the timeout fires the finding.
    """

    def step(key: tuple, parts, state: GroupState):
        waiting, speaking = state.get if state.exists else (None, 0)
        out = []
        if state.hasTimedOut:
            if waiting is not None:
                out.append((key[0], waiting))
            waiting = None
        else:
            rows = pd.concat(list(parts)).sort_values("ts", kind="stable")
            for ts, kind in zip(rows.ts, rows.type, strict=True):
                t = ts.timestamp()
                if waiting is not None and t > waiting + timeout_s:
                    out.append((key[0], waiting))
                    waiting = None
                if kind == USER[1]:
                    waiting = None if speaking else t
                elif kind == AGENT[0]:
                    waiting, speaking = None, 1
                elif kind == AGENT[1]:
                    speaking = 0
                elif kind == "agent_endpoint":
                    waiting = None
        state.update((waiting, speaking))
        if waiting is not None:
            state.setTimeoutTimestamp(max(int((waiting + timeout_s) * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=["session", "t"])

    kind = events.schema["session"].dataType.simpleString()
    grouped = events.withWatermark("ts", delay).select("session", "ts", "type").groupBy("session")
    return grouped.applyInPandasWithState(step, f"session {kind}, t double", "waiting double, speaking int", "append", GroupStateTimeout.EventTimeTimeout)
