import os
import random
from datetime import datetime, timedelta, timezone

import pytest
from test_turns import AE, AN, AS, DIALOGS, UE, US, brute

from gaugeworks.streaming import findings

BASE = datetime(2024, 1, 1, tzinfo=timezone.utc)
DDL = "session string, ts timestamp, type string"


def run(spark, batches, tmp_path, name, **how):
    """Findings by session from files read one a batch, and the query."""
    findings.use_state_store(spark)
    for k, rows in enumerate(batches):
        spark.createDataFrame([(s, None if t is None else BASE + timedelta(seconds=t), x) for s, t, x in rows], DDL).repartition(1).write.mode("append").parquet(str(tmp_path / "in" / f"b={k}"))
    for k in range(len(batches)):  # read in order of their times of change
        for f in (tmp_path / "in" / f"b={k}").iterdir():
            os.utime(f, (1_700_000_000 + k * 60,) * 2)
    stream = spark.readStream.schema(DDL).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "b=*"))
    q = findings.stream_findings(stream, **how).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(150)
    got = {}
    for r in spark.table(name).collect():
        got.setdefault(r.session, []).append((r.kind, round(r.t - BASE.timestamp(), 3)))
    return {s: sorted(x) for s, x in got.items()}, q


def test_findings_equal_the_batch_in_any_order(spark, tmp_path):
    rng, dialogs = random.Random(7), dict(DIALOGS)
    for k in range(40):
        dialogs[f"r{k}"] = [(rng.randrange(80) / 4, rng.choice([US, UE, AE, AS, AN])) for _ in range(rng.randrange(1, 30))]
    rows = sorted((t + rng.random() * 8, s, t, k) for s, x in dialogs.items() for t, k in x)  # up to 8 s late
    rows = [(s, t, k) for _, s, t, k in rows]
    cut = len(rows) // 3
    extra = [(None, 1.0, US), ("clean", 1.0, "other"), ("clean", None, UE), ("clean", 1.5, None)]
    batches = [rows[:cut] + extra, rows[cut : 2 * cut], rows[2 * cut :], [("end", 10_000.0, US)], [("end", 20_000.0, UE)]]
    got, q = run(spark, batches, tmp_path, "any_order", delay="30 seconds")
    assert got == {s: brute(x) for s, x in dialogs.items() if brute(x)}
    assert findings.late_events(q) == 0
    held = [o["numRowsTotal"] for o in q.recentProgress[-1]["stateOperators"]]
    assert held and max(held) <= 12  # only "end", its lists and its timer; 47 sessions are gone


def test_late_events_are_counted_and_sessions_end(spark, tmp_path):
    first = [("a", 0.0, US), ("a", 1.0, UE), ("b", 0.0, US)]  # a's turn is never answered, b's never ends
    later = [("b", 2000.0, UE), ("b", 2001.0, US), ("b", 2002.0, UE), ("b", 2003.0, AE)]
    batches = [first, [("x", 1000.0, US)], [("x", 1001.0, US)], [("a", 1.5, AE), ("x", 1002.0, US)], later, [("x", 9000.0, US)], [("x", 9900.0, US)]]
    got, q = run(spark, batches, tmp_path, "late", delay="5 seconds")
    assert got == {"a": [("missed_turn", 1.0)]} and findings.late_events(q) == 1


@pytest.mark.parametrize("seed", range(30))
def test_one_event_at_a_time(seed):
    rng = random.Random(seed)
    x = [(rng.randrange(60) / 4, rng.choice([US, UE, AE, AS, AN])) for _ in range(rng.randrange(1, 40))]
    state, out = findings._Open([], 2_000_000, 300_000, 50_000), []
    for t, k in sorted(x, key=lambda e: (e[0], findings.ORDER[e[1]])):
        out += state.take(round(t * 1e6), k)
        state = findings._Open(state.rows(), 2_000_000, 300_000, 50_000)  # through the stored form
    out += state.end()
    assert sorted((k, t / 1e6) for k, t in out) == brute(x)
