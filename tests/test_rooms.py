import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks import schema as S
from gaugeworks.functions import numeric, text
from gaugeworks.operators import edits, ranking, rooms, sensitivity

ROWS = [
    ("a", "x", "rirs/r1.wav", 0.3, 0.31, 0.5, "w", False),
    ("b", "x_sim", "rirs/r1.wav", 0.3, 0.31, 0.1, "w", False),
    ("c", "x", "rirs_sim/r2.wav", 0.6, 0.64, None, None, True),
    ("d", None, None, 0.6, None, 0.2, "w", False),
]
DDL = "clip_id string, condition_name string, rir_key string, rt60 double, rir_rt60_measured double, wer double, transcript string, failed boolean"


def rows(spark):
    return spark.createDataFrame(ROWS, DDL).withColumn("model", F.lit("m"))


def test_rows_are_measured_or_simulated(spark):
    real, sim = rooms.split_simulated(rows(spark))
    assert {r.clip_id for r in real.collect()} == {"a", "d"} and {r.clip_id for r in sim.collect()} == {"b", "c"}


def test_rooms_that_were_delivered(spark):
    acoustics = spark.createDataFrame([("rirs/r1.wav", 4.0)], "rir_key string, drr_db double")
    got = {r.rir_key: r for r in rooms.delivered_rooms(rows(spark), acoustics).collect()}
    assert set(got) == {"rirs/r1.wav", "rirs_sim/r2.wav"}
    r1, r2 = got["rirs/r1.wav"], got["rirs_sim/r2.wav"]
    assert (r1.n_rows, r1.drr_db, r1.rt60_requested) == (2, 4.0, [0.3]) and r1.marginal_wer == pytest.approx(0.3)
    assert (r2.n_rows, r2.marginal_wer, r2.drr_db) == (0, None, None)


def test_rooms_without_a_coordinate_raise(spark):
    known = rows(spark).where("rir_key is not null")
    c = spark.createDataFrame([("rirs/r1.wav", 1.0), ("rirs_sim/r2.wav", 2.0)], "rir_key string, value double")
    assert sorted(r.c for r in rooms.remap(known, c, "c").collect()) == [1.0, 1.0, 2.0]
    with pytest.raises(S.MissingAssetError):
        rooms.remap(known, c.where("value < 2"), "c")
    with pytest.raises(S.MissingAssetError):
        rooms.remap(rows(spark), c, "c")
    with pytest.raises(S.DuplicateCellError):
        rooms.remap(known, c.union(c), "c")


def test_grids(spark):
    assert rooms.grid(spark, rooms.INTERACTION_GRID).count() == 144 + 32
    g = rooms.grid(spark, rooms.MAIN_GRID)
    # 36 of the core, 27 of the channel, of which three are in the core
    assert g.count() == 60 == g.select("condition_name").distinct().count()
    assert rooms.grid(spark, []).count() == 0


def test_clips_by_list_or_name(spark):
    m = spark.createDataFrame([("u1",), ("u2",), ("u3",)], "id string")
    ids = lambda w: {r.id for r in rooms.select_clips(m, w, {"two": ["u1", "u2"]}).collect()}
    assert ids("all") == {"u1", "u2", "u3"} and ids("two") == {"u1", "u2"} and ids("u3, u1,") == {"u1", "u3"}
    with pytest.raises(S.MissingAssetError):
        ids("u1,u9")


def test_scorecards_take_the_latest_call(spark):
    pairs = spark.createDataFrame([("a", True), ("b", True), ("c", False)], "clip_id string, named boolean")
    calls = spark.createDataFrame([("a", 1, "A", True), ("a", 2, "B", True), ("b", 1, "B", False)], "clip_id string, session int, harder_arm string, non_marginal boolean")
    r = rooms.scorecard(pairs, calls, "B").first()
    assert (r.n_pairs, r.n_scored, r.n_direction_hit, r.n_named, r.n_strict_failures, r.held) == (3, 2, 2, 2, 1, True)
    r = rooms.scorecard(pairs, calls.limit(0), "B").first()
    assert (r.n_scored, r.n_strict_failures, r.held) == (0, 2, False)


def test_gaps_in_quadrature_and_drift(spark):
    i = spark.createDataFrame([("a", 0.2, 0.03, 0.5, 0.04), ("b", 0.2, None, 0.5, 0.04)], "factor string, s1 double, s1_half double, st double, st_half double")
    a, b = sensitivity.gap_intervals(i, 0.2).orderBy("factor").collect()
    assert a.gap_half == pytest.approx(0.05) and a.low == pytest.approx(0.25) and a.significant
    assert b.low is None and b.significant is False
    c = spark.createDataFrame([("k", 0.0, 2.0), ("k", 1.0, 1.5), ("l", 1.0, 3.0)], "k string, level double, f double")
    assert {(r.k, r.level): r["drift"] for r in edits.drift(c, ["k"], "level", 0.0, "f").collect()} == {("k", 0.0): 0.0, ("k", 1.0): 0.5, ("l", 1.0): None}


def student_tail(t, df):
    """Twice the area beyond |t|, by Simpson's rule on the angle."""
    a = np.linspace(math.atan(abs(t) / math.sqrt(df)), math.pi / 2, 20001)
    y = np.cos(a) ** (df - 1)
    w = np.where(np.arange(len(a)) % 2, 4, 2) * 1.0
    w[0] = w[-1] = 1
    area = (y * w).sum() * (a[1] - a[0]) / 3
    return 2 * area * math.gamma((df + 1) / 2) / (math.sqrt(math.pi) * math.gamma(df / 2))


def test_tails(spark):
    cases = [(t, df) for t in (0.0, 0.5, -1.7, 4.0) for df in (1, 2, 3, 4, 9, 10, 61)]
    got = spark.createDataFrame(cases, "t double, df long").select("t", "df", numeric.student_two_sided(F.col("t"), F.col("df")).alias("p"), numeric.normal_two_sided(F.col("t")).alias("q")).collect()
    for r in got:
        assert r.p == pytest.approx(student_tail(r.t, r.df), abs=1e-9)
        assert r.q == pytest.approx(math.erfc(abs(r.t) / math.sqrt(2)), abs=1e-12)


def test_rank_agreement_of_constant_or_few_pairs(spark):
    ddl = "x double, y double, k int"
    for data in ([(1.0, 2.0, 0), (1.0, 3.0, 1), (1.0, 4.0, 2)], [(1.0, 2.0, 0), (2.0, 3.0, 1)]):
        r = ranking.rank_agreement(spark.createDataFrame(data, ddl), "x", "y", "k").first()
        assert (r.spearman, r.spearman_p, r.kendall, r.kendall_p) == (None,) * 4
    r = ranking.rank_agreement(spark.createDataFrame([(float(i), float(i), i) for i in range(5)], ddl), "x", "y", "k").first()
    assert r.spearman == pytest.approx(1) and r.spearman_p == pytest.approx(0, abs=1e-7) and r.kendall == pytest.approx(1)


def test_auroc_of_any_scores_equals_all_pairs(spark):
    rng = np.random.default_rng(3)
    s = np.concatenate([rng.normal(0, 1, 200), rng.choice([0.0, -1e-9, 1e12, -5.0, 0.1, 0.10000001, float("inf"), -float("inf")], 100)])
    y = rng.integers(0, 2, 300)
    pos, neg = s[y == 1], s[y == 0]
    want = np.mean((pos[:, None] > neg).astype(float) + (pos[:, None] == neg) / 2)
    df = spark.createDataFrame([("k", float(a), int(b)) for a, b in zip(s, y)] + [("k", None, 1), ("k", float("nan"), 0)], "k string, s double, y int")
    r = ranking.auroc(df, ["k"], "s", F.col("y") == 1).first()
    assert r.auroc == pytest.approx(want) and (r.n_good, r.n_bad) == (len(pos), len(neg))


def test_phrases(spark):
    df = spark.createDataFrame([(["a", "b", "a", "b"],), (["a"],), ([],), (None,)], "t array<string>")
    assert [sorted(r[0] or []) for r in df.select(text.phrases(F.col("t"), 2)).collect()] == [["a b", "b a"], [], [], []]
