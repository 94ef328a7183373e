import random
from datetime import datetime, timedelta, timezone

from gaugeworks.operators import turns
from gaugeworks.streaming.dialogs import stream_missed_turns, stream_segments

US, UE, AE, AS, AN = "user_speech_start", "user_speech_end", "agent_endpoint", "agent_speech_start", "agent_speech_end"
CLEAN = [(0.0, US), (2.0, UE), (2.1, AE), (2.5, AS), (4.0, AN)]
DIALOGS = {
    "clean": CLEAN,
    "cut": [(0.0, US), (1.0, AE), (2.0, UE), (2.5, AS), (4.0, AN)],
    "at_margin": [(0.0, US), (1.97, AE), (2.0, UE), (2.5, AS), (4.0, AN)],
    "missed": [(0.0, US), (2.0, UE), (9.0, AS), (10.0, AN)],
    "barge": [(0.0, AS), (1.0, US), (2.0, UE), (3.0, AN)],
    "handled": [(0.0, AS), (1.0, US), (1.2, AN), (2.0, UE), (2.4, AS), (3.0, AN)],
    "only_ends": [(1.0, UE), (2.0, AN)],
}


def paired(events, a, b):
    starts, ends, out = sorted(t for t, k in events if k == a), sorted(t for t, k in events if k == b), []
    for s in starts:
        ends = [e for e in ends if e >= s]
        if ends:
            out.append((s, ends.pop(0)))
    return out


def brute(events):
    user, agent, ends, out = paired(events, US, UE), paired(events, AS, AN), [t for t, k in events if k == AE], []
    out += [("false_endpoint", t) for t in ends if any(s <= t < e - 0.05 for s, e in user)]
    answers = ends + [s for s, _ in agent]
    out += [("missed_turn", e) for _, e in user if not any(a <= e <= b for a, b in agent) and not any(e <= t <= e + 2.0 for t in answers)]
    out += [("barge_in_error", s) for s, _ in user if any(a < s < b and b - s > 0.3 for a, b in agent)]
    return sorted(out)


def test_findings_equal_brute_force(spark):
    rng, dialogs = random.Random(4), dict(DIALOGS)
    for k in range(40):
        dialogs[f"r{k}"] = [(rng.randrange(60) / 4, rng.choice([US, UE, AE, AS, AN])) for _ in range(rng.randrange(1, 25))]
    df = spark.createDataFrame([(s, t, k) for s, x in dialogs.items() for t, k in x], "session string, t double, type string")
    got = {}
    for r in turns.findings(df).collect():
        got.setdefault(r.session, []).append((r.kind, r.t))
    for s, x in dialogs.items():
        assert sorted(got.get(s, [])) == brute(x), s
    counts = {r.kind: r.n for r in turns.finding_counts(turns.findings(df.where("session = 'clean'"))).collect()}
    assert counts == {"false_endpoint": 0, "missed_turn": 0, "barge_in_error": 0}


def run_stream(spark, df, tmp_path, name, build):
    df.repartition(1).write.parquet(str(tmp_path / "in"))
    out = build(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = out.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def stream_of(spark, dialogs):
    base = datetime(2024, 1, 1, tzinfo=timezone.utc)
    rows = [(s, base + timedelta(seconds=t), k) for s, x in dialogs.items() for t, k in x]
    rows.append(("end", base + timedelta(hours=3), "other"))  # moves the watermark past every session
    return spark.createDataFrame(rows, "session string, ts timestamp, type string"), base.timestamp()


def test_missed_turns_on_a_stream_equal_the_batch(spark, tmp_path):
    df, base = stream_of(spark, {k: DIALOGS[k] for k in ("clean", "missed", "barge", "handled", "cut")})
    got = sorted((r.session, round(r.t - base, 3)) for r in run_stream(spark, df, tmp_path, "missed", stream_missed_turns))
    assert got == [("missed", 2.0)]


def test_sessions_on_a_stream(spark, tmp_path):
    df, _ = stream_of(spark, {"clean": CLEAN, "two": CLEAN + [(5000.0, US), (5001.0, UE)]})
    got = sorted((r.session, r.n_events, r.n_user_starts) for r in run_stream(spark, df, tmp_path, "sessions", stream_segments))
    assert got == [("clean", 5, 1), ("two", 2, 1), ("two", 5, 1)]


def test_findings_move_events_once_and_pair_without_python(spark):
    """Each party's segments were made three times over by one Python call a session, then joined."""
    cut = DIALOGS["cut"] + DIALOGS["missed"]
    hot = [("hot", 20.0 * k + t, e) for k in range(500) for t, e in sorted(cut)]
    odd = [(None, t, e) for t, e in CLEAN] + [("late", float("nan"), UE), ("late", None, UE), ("late", 0.0, US), ("late", 2.0, UE)]
    df = spark.createDataFrame(hot + odd, "session string, t double, type string")
    found = turns.findings(df)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(session") == 1 and plan.count("Exchange") == 1
    assert "Join" not in plan and "InPandas" not in plan and "InArrow" not in plan
    want = brute([(t, e) for _, t, e in hot])
    assert sorted((r.kind, r.t) for r in found.where("session = 'hot'").collect()) == want and len(want) >= 500
    assert [tuple(r) for r in found.where("session is null or session = 'late'").collect()] == [("late", "missed_turn", 2.0)]
    assert sorted((r.s, r.e) for r in turns.segments(df.where("session = 'hot'"), turns.USER).collect()) == paired([(t, e) for _, t, e in hot], US, UE)
