import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks import schema as S
from gaugeworks.operators import active, calibration, ranking, resampling, sensitivity


def surface(spark, rng, shape, f=None):
    cells = [(*(float(i) for i in ix), float(f(*ix) if f else rng.random())) for ix in np.ndindex(*shape)]
    names = ["a", "b", "c"][: len(shape)]
    return spark.createDataFrame(cells, ", ".join(f"{n} double" for n in names) + ", y double"), names


def test_anova_parts_the_variance(spark):
    cells, names = surface(spark, np.random.default_rng(0), (3, 4, 2))
    terms = sensitivity.anova_terms(cells, names)
    y = np.array([r.y for r in cells.collect()])
    assert terms.count() == 7 and terms.agg(F.sum("variance")).first()[0] == pytest.approx(y.var())
    assert terms.where("variance < -1e-12").count() == 0


def test_additive_surfaces_have_no_gap_and_products_no_main_effect(spark):
    cells, names = surface(spark, None, (3, 3, 2), lambda a, b, c: a + 2 * b - c)
    assert sensitivity.sobol(sensitivity.anova_terms(cells, names), names).where("abs(gap) > 1e-9").count() == 0
    cells, names = surface(spark, None, (2, 2, 2), lambda a, b, c: (2 * a - 1) * (2 * b - 1) * (2 * c - 1))
    t = {r.term: r.variance for r in sensitivity.anova_terms(cells, names).collect()}
    assert t["a:b:c"] == pytest.approx(1) and max(abs(v) for k, v in t.items() if k != "a:b:c") < 1e-9
    with pytest.raises(S.IncompleteDesignError):
        sensitivity.anova_terms(cells.where("a = 0 or b = 0"), names)


def test_dips_reversals_and_half_levels(spark):
    c = spark.createDataFrame([(x, m, y) for m, ys in ((0.0, [0, 3, 1, 4]), (1.0, [4, 3, 2, 1])) for x, y in zip([0.0, 1.0, 2.0, 3.0], map(float, ys), strict=True)], "x double, m double, y double")
    assert [(r.x, r.m, r.depth) for r in sensitivity.dips(c, ["x", "m"], "x").collect()] == [(2.0, 0.0, 2.0)]
    assert sensitivity.reversals(c, "x", "m").first().reverses
    assert {r.m: r.half_level for r in sensitivity.half_level(c, ["m"], "x", "y").collect()} == pytest.approx({0.0: 2 / 3, 1.0: 1.5})
    assert {r.m: r.n_sign_flips for r in sensitivity.monotonicity(c, ["m"], "x", "y").collect()} == {0.0: 2, 1.0: 0}


def average_ranks(x):
    return np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])


def test_ranks_spearman_kendall_auroc_equal_numpy(spark):
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 9, 60).astype(float), rng.integers(0, 9, 60).astype(float)
    df = spark.createDataFrame([("k", i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "k string, i int, x double, y double")
    rho = np.corrcoef(average_ranks(x), average_ranks(y))[0, 1]
    assert ranking.spearman(df, ["k"], "x", "y").first().rho == pytest.approx(rho)
    s = [(np.sign(x[i] - x[j]), np.sign(y[i] - y[j])) for i in range(60) for j in range(i)]
    tau = sum(a * b for a, b in s) / np.sqrt(sum(abs(a) for a, _ in s) * sum(abs(b) for _, b in s))
    assert ranking.kendall(df, "x", "y", "i").first().tau == pytest.approx(tau)
    good = y > 4
    pairs = [(a > b) + (a == b) / 2 for a in x[good] for b in x[~good]]
    assert ranking.auroc(df, ["k"], "x", F.col("y") > 4).first().auroc == pytest.approx(np.mean(pairs))
    got = ranking.with_percentile(df.withColumn("x", F.when(F.col("i") > 3, F.col("x"))), ["k"], "x", "p").orderBy("i").collect()
    want = (average_ranks(x[4:]) - 1) / 55
    assert [r.p for r in got[:4]] == [0.0] * 4 and [r.p for r in got[4:]] == pytest.approx(want.tolist())


def test_a_planted_temperature_is_found(spark):
    rng = np.random.default_rng(5)
    z = rng.normal(0, 2, 20000)
    y = rng.random(20000) < 1 / (1 + np.exp(-z / 2.5))
    df = spark.createDataFrame([(float(1 / (1 + np.exp(-a))), int(b)) for a, b in zip(z, y, strict=True)], "conf double, y int")
    assert calibration.fit_temperature(df, "conf", "y") == pytest.approx(2.5, rel=0.08)


def test_a_planted_bias_is_calibrated_away(spark):
    rng = np.random.default_rng(6)
    rows = []
    for k in range(6000):
        room, conf = k % 10, float(rng.uniform(0.3, 0.95))
        p = 1 / (1 + np.exp(-(np.log(conf / (1 - conf)) - 0.3 * room)))
        rows.append((f"g{room}-{k % 7}", float(room), conf, int(rng.random() < p)))
    df = calibration.grouped_split(spark.createDataFrame(rows, "g string, room double, conf double, y int"), "g", 0.5, 3)
    assert df.select("g", "in_train").distinct().count() == 70
    _, apply = calibration.fit_feature_calibrator(df.where("in_train"), "conf", "y", ["room"])
    held = apply(df.where("not in_train")).withColumn("k", F.lit(1))
    ece = lambda c: calibration.expected_calibration_error(calibration.reliability(held, ["k"], c, "y"), ["k"]).first().ece
    assert ece("p") < 0.05 < ece("conf")


def test_bins_close_at_one_and_bootstrap_holds_the_mean(spark):
    df = spark.createDataFrame([(0.0, 1), (0.9999, 1), (1.0, 0), (0.5, 1)], "c double, y int").withColumn("k", F.lit(1))
    assert sorted((r.bin, r.n) for r in calibration.reliability(df, ["k"], "c", "y").collect()) == [(0, 1), (7, 1), (14, 2)]
    rows = spark.range(2000).select((F.col("id") % 200).alias("u"), (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000).alias("v"))
    b = resampling.bootstrap_mean(rows, "u", "v", 300)
    r = b.first()
    assert r.low < r.mean < r.high and 0.01 < r.high - r.low < 0.06 and r.n_units == 200 and b.first() == r


def test_word_records_need_one_confidence_a_word(spark):
    kind = "clip_id string, transcript string, failed boolean, edits array<struct<op:string,ref:string,hyp:string>>, word_confidences array<double>"
    fine = spark.createDataFrame([("c", "a x", False, [("match", "a", "a"), ("del", "b", None), ("sub", "c", "x")], [0.9, 0.2])], kind)
    assert [(r.position, r.op, r.conf, r.correct) for r in calibration.word_records(fine, ["clip_id"]).collect()] == [(0, "match", 0.9, 1), (1, "sub", 0.2, 0)]
    with pytest.raises(S.ConfidenceAlignmentError):
        calibration.word_records(fine.withColumn("word_confidences", F.array(F.lit(0.5))), ["clip_id"])


def test_designs_and_gaussian_process(spark):
    d = active.plackett_burman(7)
    assert (d.T @ d == 8 * np.eye(7)).all()
    x = active.latin_hypercube(10, 3, 1)
    assert all(sorted((x[:, j] * 10).astype(int)) == list(range(10)) for j in range(3))
    f = lambda p: np.sin(3 * p[:, 0]) + p[:, 1]
    x, test = active.halton(40, 2, 1), active.halton(50, 2, 2)
    mean, sd = active.GaussianProcess().fit(x, f(x)).predict(test)
    assert np.abs(mean - f(test)).max() < 0.15 and (sd > 0).all()
    with pytest.raises(S.InsufficientSeedsError):
        active.curves(spark, lambda p: 0.0, 2, [1, 1, 2])
    assert active.permutation_rank(lambda p: p[0], 3) == (2, 2 / 6)


def test_active_learning_beats_chance_near_the_contour(spark):
    oracle = lambda p: float(1 / (1 + np.exp(-12 * (p[0] - 0.5))))
    best = active.best_so_far(active.curves(spark, oracle, 2, [1, 2, 3], n_seed=5, budget=14))
    last = {r.arm: r.median for r in active.seed_band(best).where("n_evals = 14").collect()}
    assert last["boundary"] <= last["random"]
    s = {r.arm: r for r in active.savings(active.evals_to_target(best, -1.0)).collect()}
    assert s["boundary"].n_reached == 0 and s["boundary"].median_evals is None


def test_half_is_reached_from_below(spark):
    rows = [("a", float(k), y) for k, y in enumerate((1.0, 0.2, 0.0, 0.9))] + [("b", float(k), 1.0) for k in range(3)] + [("c", float(k), y) for k, y in enumerate((0.0, 0.4, 1.0))] + [("d", 4.0, 2.0)]
    got = {r.k: r.half_level for r in sensitivity.half_level(spark.createDataFrame(rows, "k string, l double, y double"), ["k"], "l", "y").collect()}
    assert got["a"] == pytest.approx(2 + 0.5 / 0.9) and got["b"] == 2.0 and got["c"] == pytest.approx(1 + 0.1 / 0.6) and got["d"] == 4.0


def test_intervals_hold_the_indices_and_decide(spark):
    rng = np.random.default_rng(0)
    rows = [(f"c{c}", a, b, e, 0.3 * a + 0.4 * a * b + 0.01 * e + 0.02 * rng.normal()) for c in range(30) for a in (0, 1, 2) for b in (0, 1) for e in (0, 1)]
    df = spark.createDataFrame(rows, "clip_id string, a int, b int, e int, y double")
    got = sensitivity.sobol_intervals(df, ["a", "b", "e"], "clip_id", "y", 200)
    terms = sensitivity.anova_terms(sensitivity.cell_means(df, ["a", "b", "e"], "y"), ["a", "b", "e"])
    want = {(r.factor, k): r[k] for r in sensitivity.sobol(terms, ["a", "b", "e"]).collect() for k in ("s1", "st", "gap")} | {(f"{r.a}:{r.b}", "s2"): r.s2 for r in sensitivity.second_order(terms).collect()}
    rows = {(r.term, r.kind): r for r in got.collect()}
    assert {k: pytest.approx(r.estimate) for k, r in rows.items()} == want
    assert all(r.low - 0.01 <= r.estimate <= r.high + 0.01 and r.low < r.high for r in rows.values())
    decide = lambda pair, frame=got: sensitivity.preregistered(frame, pair).first()
    assert tuple(decide(("a", "b")))[1:] == (True, True, False, "CONFIRMED") and decide(("a", "e")).verdict == "NOT CONFIRMED" and decide(("a", "x")).verdict == "UNRESOLVED"
    wide = spark.createDataFrame([("a", "gap", 0.1, -0.1, 0.3), ("b", "gap", 0.1, 0.05, 0.3), ("a:b", "s2", 0.1, 0.0, 0.2), ("a:e", "s2", 0.2, 0.0, 0.4)], "term string, kind string, estimate double, low double, high double")
    assert tuple(decide(("a", "b"), wide))[1:] == (False, False, True, "NOT CONFIRMED")


def test_temperatures_of_all_groups_equal_one_by_one(spark):
    rng = np.random.default_rng(1)
    rows = []
    for m, t in (("x", 0.5), ("y", 2.0), ("z", 1.0)):
        z = rng.normal(0, 2, 400)
        rows += [(m, float(1 / (1 + np.exp(-a))), int(rng.random() < 1 / (1 + np.exp(-a / t)))) for a in z]
    df = spark.createDataFrame(rows, "model string, c double, good int")
    counts = calibration.confidence_counts(df, ["model"], "c", "good")
    for r in calibration.temperatures(counts, ["model"], "c").collect():
        assert r.temperature == pytest.approx(calibration.temperature_of_counts(counts.where(F.col("model") == r.model), "c"), rel=1e-6)
