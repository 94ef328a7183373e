"""Many splits at once against one after the other."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks import schema as S
from gaugeworks.operators import calibration, seeds
from gaugeworks.plans import views
from gaugeworks.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_all_models_and_seeds_equal_one_by_one(spark):
    rng = np.random.default_rng(5)
    rows = []
    for m, t in (("x", 0.7), ("y", 1.8)):
        for k in range(600):
            room, z = float(rng.choice([0.2, 0.7])), rng.normal(0, 2)
            rows.append((m, f"clip{rng.integers(23)}", room, float(1 / (1 + np.exp(-z))), int(rng.random() < 1 / (1 + np.exp(-(z / t - 2 * room))))))
    rows += [("x", "clip1", 0.2, None, 1), ("y", "clip2", 0.2, 0.5, None), (None, "clip2", 0.2, 0.5, 1), ("tiny", "only", 0.2, 0.5, 1)]
    df = spark.createDataFrame(rows, "model string, clip_id string, room double, conf double, y int").repartition(5)
    got = {(r.model, r.seed): r for r in seeds.calibration_seeds(df, "conf", "y", ["room"], seeds=(3, 9), discount_at={"room": 0.7}).collect()}
    assert set(got) == {(m, s) for m in ("x", "y", "tiny") for s in (3, 9)}
    for m, s in (("x", 3), ("y", 9), ("y", 3)):
        mine = calibration.grouped_split(df.where((F.col("model") == m) & F.col("conf").isNotNull() & F.col("y").isNotNull()), "clip_id", 0.5, s)
        train, r = mine.where("in_train"), got[m, s]
        _, apply = calibration.fit_feature_calibrator(train, "conf", "y", ["room"])
        held = apply(mine.where("not in_train")).withColumn("k", F.lit(1)).cache()
        assert (r.n_train, r.n_test) == (train.count(), held.count())
        t = calibration.fit_temperature(train, "conf", "y")
        held = held.withColumn("t", 1 / (1 + F.exp(-F.log(F.col("conf") / (1 - F.col("conf"))) / t)))
        ece = lambda c, held=held: calibration.expected_calibration_error(calibration.reliability(held, ["k"], c, "y"), ["k"]).first().ece
        assert r.temperature == pytest.approx(t, rel=1e-5)
        assert [r.ece_raw, r.ece_temperature] == pytest.approx([ece("conf"), ece("t")], abs=1e-6)
        assert r.ece_feature == pytest.approx(ece("p"), abs=2e-3)  # the other fit stops at its tolerance
        assert r.discount_room == pytest.approx(held.where("room >= 0.7").agg(F.avg(F.col("conf") - F.col("p"))).first()[0], abs=1e-3)
        held.unpersist()
    assert (got["tiny", 3].n_train, got["tiny", 3].n_test, got["tiny", 3].ece_raw) == (1, 0, None)


def test_masks_equal_the_split(spark):
    for n in (1, 2, 5, 37):
        df = spark.createDataFrame([("m", f"g{k}") for k in range(n)] * 2, "model string, clip_id string")
        masks = {r.clip_id: r.mask for r in seeds.split_masks(df, "model", "clip_id", (0, 7), 0.3).collect()}
        for k, s in enumerate((0, 7)):
            want = {r.clip_id: r.in_train for r in calibration.grouped_split(df, "clip_id", 0.3, s).collect()}
            assert {g: bool(m >> k & 1) for g, m in masks.items()} == want
    assert seeds.seed_bands(spark.createDataFrame([("m", 1, 0.5), ("m", 2, None), ("m", 3, 0.1)], "model string, seed int, e double"), ["e"]).collect()[0][2:] == (2, 0.1, 0.3, 0.5)


def test_passes_go_over_counts_of_equal_rows(spark, monkeypatch):
    """Every Newton step passed over all rows before, each with a join's mask."""
    rows = [("m", f"clip{k % 31}", k % 2 * 0.5, 0.2 + k % 3 * 0.3, int(k % 7 < 3)) for k in range(420)]
    df, passed, whole = spark.createDataFrame(rows, "model string, clip_id string, room double, conf double, y int"), [], seeds._vector_pass
    monkeypatch.setattr(seeds, "ROUNDS", 1)
    monkeypatch.setattr(seeds, "_vector_pass", lambda counts, *more: passed.append(counts) or whole(counts, *more))
    r = seeds.calibration_seeds(df, "conf", "y", ["room"], seeds=(4,)).first()
    assert r.n_train + r.n_test == len(rows) and passed[0].count() == 6
    want = calibration.grouped_split(df, "clip_id", 0.5, 4).where("in_train").groupBy("conf", "room").agg(F.count("*").alias("n"), F.sum("y").alias("y"))
    assert {(c.conf, c.room): (c.n, c.y) for c in want.collect()} == {(c._conf, c._f0): (c.n0, c.y0) for c in passed[0].collect()}


def one_model(rows, group, conf, correct, features, share, seed):
    """Errors of held-out rows before and after, of one model alone."""
    split = calibration.grouped_split(rows, group, share, seed)
    _, apply = calibration.fit_feature_calibrator(split.where("in_train"), conf, correct, features)
    held = apply(split.where("not in_train")).withColumn("k", F.lit(1)).cache()
    return [calibration.expected_calibration_error(calibration.reliability(held, ["k"], c, correct), ["k"]).first().ece for c in (conf, "p")]


def test_every_model_gets_its_feature_calibration(spark):
    """Only arm_a was calibrated before."""
    m = views.measurements(spark, SF).where("mean_conf is not null").withColumn("good", (F.col("wer") < S.WER_HI).cast("int")).cache()
    got = {r.model: [r.ece_before, r.ece_after] for r in QUERIES["feature_calibration"](spark, SF).collect()}
    assert set(got) == {r.model for r in m.select("model").distinct().collect()} == {"arm_a", "arm_n", "arm_r"}
    for name, errors in got.items():
        want = one_model(m.where(F.col("model") == name), "condition_name", "mean_conf", "good", ["rt60", "snr_db", "mic_rolloff"], 0.7, 1)
        assert errors == pytest.approx(want, abs=1e-6)


def test_no_temperature_is_sought_unasked(spark):
    """Two groups, so that training sees one room and the held-out rows are in the other."""
    df = spark.createDataFrame([("m", f"g{k % 2}", 0.7 if k % 2 else 0.2, (k * k % 89 + 5) / 100, int(k * 7 % 11 < 4)) for k in range(300)], "model string, g string, room double, conf double, y int")
    r = seeds.calibration_seeds(df, "conf", "y", ["room"], group="g", seeds=(1,), by_temperature=False).first()
    assert [r.ece_raw, r.ece_feature] == pytest.approx(one_model(df, "g", "conf", "y", ["room"], 0.5, 1), abs=1e-6)
    assert (r.temperature, r.ece_temperature, r.n_train, r.n_test) == (None, None, 150, 150)
