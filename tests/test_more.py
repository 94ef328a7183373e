import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks import schema as S
from gaugeworks.functions import text
from gaugeworks.operators import active, calibration, compare, estimands
from gaugeworks.sources import tables


def test_cross_model_tokens_and_claims(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first().x
    assert value(text.cross_model_tokens(F.lit("Gate B12, seven o'clock"))) == ["gate", "b", "1", "2", "7", "oclock"] and value(text.cross_model_tokens(F.lit(None).cast("string"))) == []
    words = lambda *c: F.array(*[F.struct(F.lit(x).cast("double").alias("conf")) for x in c])
    assert [value(text.claim(words(*c))) for c in ((0.95, 0.1), (0.7, 0.6), (0.7, 0.1), (None,))] == ["exact", "average", "hedged", "none"]


def test_matrix_and_first_seen(spark):
    rows = tables.synthetic(spark, 2, ["m"]).withColumn("rir_rt60_measured", F.when(F.col("rt60") == 0.2, 0.25))
    m = estimands.condition_matrix(rows)
    assert m.count() == 75 and m.where("rt60 = 0.25").count() == 15
    seen = spark.createDataFrame([("b", 3), ("a", 2), ("b", 1)], "k string, s int")
    assert estimands.first_seen(seen, "k", "s").collect() == [("b", 1), ("a", 2)]


def test_redundancy_and_alignment(spark):
    rows = tables.synthetic(spark, 2, ["m"])
    r = calibration.redundancy(rows, "mean_conf", "utterance_conf", ["model"]).first()
    assert r.share_equal == 1 and r.r == pytest.approx(1)
    edits = F.array(*[F.struct(F.lit("match").alias("op"), F.lit("a").alias("ref"), F.lit("a").alias("hyp"))] * 3)
    c = calibration.alignment_census(rows.withColumn("edits", edits), ["model"]).first()
    assert (c.n, c.n_aligned, c.n_split, c.n_dropped) == (150, 150, 0, 0)


def test_assets_are_resolved_or_refused(spark):
    conditions = spark.createDataFrame([("x", 0.3, "babble"), ("y", 0.9, "babble")], "condition_name string, rt60 double, noise_type string")
    rooms = spark.createDataFrame([("r1", 0.25), ("r2", 0.35), ("r3", 1.0)], "rir_key string, rt60 double")
    noises = spark.createDataFrame([("n1", "babble"), ("n2", "babble")], "noise_key string, noise_type string")
    got = {r.condition_name: (r.rir_key, r.noise_key) for r in compare.resolve_assets(conditions, rooms, noises).collect()}
    assert got["x"][0] in ("r1", "r2") and got["y"][0] == "r3" and {v[1] for v in got.values()} <= {"n1", "n2"}
    with pytest.raises(S.MissingAssetError):
        compare.resolve_assets(conditions.withColumn("noise_type", F.lit("road")), rooms, noises)


def test_dips_are_proposed_then_confirmed(spark):
    f = lambda p: abs(p[0] - 0.5) + 0.1 * p[1]
    levels = [[0.0, 0.25, 0.5, 0.75, 1.0], [0.0, 1.0]]
    x = np.array([(a, b) for a in levels[0] for b in levels[1]])
    proposed = active.propose_dips(active.GaussianProcess().fit(x, np.array([f(p) for p in x])), levels, 0)
    assert {c[0] for c, _ in proposed} == {0.5}
    assert {s for _, s in active.confirm_dips(proposed, levels, 0, f)} == {"CONFIRMED"}
    assert {s for _, s in active.confirm_dips(proposed, levels, 0, lambda p: p[0])} == {"REFUTED"}
    points = spark.createDataFrame([(s, "a", y) for s in (1, 2, 3) for y in (0.5, 0.9)], "seed int, arm string, y double")
    assert active.acquisition_concentration(points).first().median_share == 0.5
