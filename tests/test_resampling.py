"""The bootstrap against loops in numpy over the same weights."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks import schema as S
from gaugeworks.operators import calibration, resampling, sensitivity

B = 60


def weights_of(spark, units):
    """Weights by unit from the column expression."""
    x = spark.createDataFrame([(u,) for u in units], "u string").withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(B)))).withColumn("w", calibration.poisson_weight(F.xxhash64("u", "b", F.lit(5))))
    out = {u: np.ones(B + 1) for u in units}
    for r in x.collect():
        out[r.u][r.b] = r.w
    return out


def test_weights_equal_the_column_expression(spark):
    units = ["", "a", "clip_17", "ü" * 40, *map(str, range(50))]
    hashes = np.array([r.h for r in spark.createDataFrame([(u,) for u in units], "u string").select(F.xxhash64("u").alias("h")).collect()])
    want = weights_of(spark, units)
    assert (resampling.poisson_matrix(hashes, B, 5) == np.array([want[u] for u in units])).all()


def rows_of(rng, n=400):
    return [(f"m{k % 2}", f"c{rng.integers(40)}", int(rng.integers(3)), int(rng.integers(2)), float(rng.integers(8)) / 8, float(rng.normal())) for k in range(n)]


def area(s, good, w):
    g, b = w * good, w * (1 - good)
    if not g.sum() * b.sum():
        return np.nan
    return (g[:, None] * b[None, :] * ((s[:, None] > s[None, :]) + 0.5 * (s[:, None] == s[None, :]))).sum() / (g.sum() * b.sum())


@pytest.mark.parametrize("step,cells,fan", [(512, 1024, 32), (7, 2, 2)])
def test_sums_areas_and_intervals_equal_loops(spark, monkeypatch, step, cells, fan):
    for name, v in (("STEP", step), ("MOST_CELLS", cells), ("FAN", fan)):
        monkeypatch.setattr(resampling, name, v)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        rows = rows_of(np.random.default_rng(1))
        df = spark.createDataFrame(rows, "model string, clip_id string, a int, b int, s double, y double").repartition(5)
        w = weights_of(spark, sorted({r[1] for r in rows}))
        for r in resampling.replicate_sums(df, "clip_id", ["model", "a"], ["y"], B).collect():
            mine = [x for x in rows if (x[0], x[2]) == (r.model, r.a)]
            assert np.allclose(r.y, sum(w[x[1]] * x[5] for x in mine))
        df = df.withColumn("good", (F.col("y") > 0).cast("int")).withColumn("t", -F.col("y") + F.col("s"))
        found = {(r.model, r.score_name): r for r in resampling.separation_intervals(df, ["model"], ["s", "t"], F.col("good"), "clip_id", "s", B).collect()}
        assert len(found) == 4
        for m in ("m0", "m1"):
            mine = [x for x in rows if x[0] == m]
            good, ws = np.array([x[5] > 0 for x in mine], float), np.array([w[x[1]] for x in mine])
            s, t = np.array([x[4] for x in mine]), np.array([x[4] - x[5] for x in mine])
            vs, vt = (np.array([area(x, good, ws[:, b]) for b in range(B + 1)]) for x in (s, t))
            r = found[m, "t"]
            assert np.allclose([r.auroc, r.low, r.high], [vt[0], *np.nanpercentile(vt[1:], [2.5, 97.5])])
            assert np.allclose([r.delta, r.delta_low, r.delta_high], [vt[0] - vs[0], *np.nanpercentile((vt - vs)[1:], [2.5, 97.5])])
            assert r.beats == (r.delta_low > 0) and r.loses == (r.delta_high < 0) and r.n_good == good.sum()
            assert found[m, "s"].delta is None and not found[m, "s"].beats and {r.rank, found[m, "s"].rank} == {1, 2}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_one_score_of_many_units_and_one_class(spark):
    rows = [("m", f"c{k}", 1.0, k % 3 == 0) for k in range(900)] + [("m", f"c{k}", k / 100.0, k % 2 == 0) for k in range(90)] + [("one", "c", 0.5, True), ("one", "d", None, False), ("one", "e", float("nan"), False)]
    df = spark.createDataFrame(rows, "k string, u string, s double, g boolean").repartition(8)
    got = {r.k: r for r in resampling.replicate_auroc(df, ["k"], "s", F.col("g"), "u", B).collect()}
    w = weights_of(spark, sorted({r[1] for r in rows}))
    mine = [r for r in rows if r[0] == "m"]
    s, g, ws = np.array([r[2] for r in mine]), np.array([r[3] for r in mine], float), np.array([w[r[1]] for r in mine])
    assert np.allclose(got["m"].auroc, [area(s, g, ws[:, b]) for b in range(B + 1)])
    assert got["one"].n_bad == 0 and set(got["one"].auroc) == {None}
    thin = resampling.separation_intervals(df.where("k = 'one'"), ["k"], ["s"], F.col("g"), "u", "s", B).first()
    assert thin.auroc is None and thin.low is None and not thin.beats and thin["rank"] == 1


def test_designs_equal_loops(spark):
    rng = np.random.default_rng(3)
    rows = [(m, f"c{c}", a, b, 0.3 * a + 0.2 * a * b * (m == "x") + 0.1 * rng.normal()) for m in ("x", "y") for c in range(12) for a in (0, 1, 2) for b in (0, 1)]
    df = spark.createDataFrame(rows, "model string, clip_id string, a int, b int, v double")
    w = weights_of(spark, [f"c{c}" for c in range(12)])

    def design(m, b):
        y = np.zeros((3, 2))
        for i in range(3):
            for j in range(2):
                mine = [(w[r[1]][b], r[4]) for r in rows if r[0] == m and (r[2], r[3]) == (i, j)]
                y[i, j] = sum(k * v for k, v in mine) / sum(k for k, _ in mine)
        return y

    def indices(y):
        ea, eb = y.mean(1) - y.mean(), y.mean(0) - y.mean()
        inner = y - y.mean() - ea[:, None] - eb[None, :]
        va, vb, vab = (ea**2).mean(), (eb**2).mean(), (inner**2).mean()
        t = va + vb + vab
        return {("a", "s1"): va / t, ("b", "s1"): vb / t, ("a", "st"): (va + vab) / t, ("b", "st"): (vb + vab) / t, ("a", "gap"): vab / t, ("b", "gap"): vab / t, ("a:b", "s2"): vab / t}

    got = sensitivity.sobol_intervals(df, ["a", "b"], "clip_id", "v", B, keys=("model",)).collect()
    for m in ("x", "y"):
        draws = [indices(design(m, b)) for b in range(B + 1)]
        mine = {(r.term, r.kind): r for r in got if r.model == m}
        assert set(mine) == set(draws[0])
        for k, r in mine.items():
            assert np.allclose([r.estimate, r.low, r.high], [draws[0][k], *np.percentile([d[k] for d in draws[1:]], [2.5, 97.5])])
    effects = sensitivity.effect_intervals(df, {"a": True, "b": False}, "clip_id", "v", B, keys=("model",), least_left=1).collect()
    for r in effects:
        of = (lambda y: y[-1].mean() - y[0].mean()) if r.factor == "a" else (lambda y: y[:, 0].mean() - y[:, -1].mean())
        draws = [of(design(r.model, b)) for b in range(B + 1)]
        assert np.allclose([r.effect, r.low, r.high], [draws[0], *np.percentile(draws[1:], [2.5, 97.5])])
        assert r.significant == (r.low > 0 or r.high < 0)
    assert {(r.model, r.factor): (r["rank"], r.survives) for r in effects if r.factor == "a"} == {("x", "a"): (1, True), ("y", "a"): (1, True)}
    with pytest.raises(Exception, match="IncompleteDesign"):
        sensitivity.sobol_intervals(df.where("not (a = 2 and b = 1)"), ["a", "b"], "clip_id", "v", B).collect()


def test_means_equal_a_loop_and_empty_tables(spark):
    rows = [(k % 3, f"c{k % 20}", float(k % 7)) for k in range(200)] + [(0, "c1", None)]
    df = spark.createDataFrame(rows, "k int, u string, v double")
    w = weights_of(spark, [f"c{c}" for c in range(20)])
    for r in resampling.bootstrap_mean(df, "u", "v", B, keys=("k",)).collect():
        mine = [x for x in rows if x[0] == r.k and x[2] is not None]
        draws = np.array([sum(w[x[1]][b] * x[2] for x in mine) / sum(w[x[1]][b] for x in mine) for b in range(B + 1)])
        assert np.allclose([r["mean"], r.low, r.high], [draws[0], *np.percentile(draws[1:], [2.5, 97.5])]) and r.n_units == len({x[1] for x in mine})
    empty = resampling.bootstrap_mean(df.where("false"), "u", "v", B).collect()
    assert [(r["mean"], r.n_units, r.low) for r in empty] == [(None, 0, None)]
    assert resampling.replicate_auroc(df.where("false"), ["k"], "v", F.lit(True), "u", B).count() == 0
    assert isinstance(S.IncompleteDesignError("x"), S.MeasurementError)
