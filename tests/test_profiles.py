import json

import pytest
from pyspark.sql import functions as F

from gaugeworks import schema as S
from gaugeworks.operators import gate, profiles, taxonomy
from gaugeworks.sources import tables


def test_small_tables_as_text(spark):
    df = spark.createDataFrame([("a", 1.5), ("long", None)], "k string, v double").orderBy("k")
    assert tables.fixed_width(df) == "k     v\na     1.5\nlong  -\n"
    with pytest.raises(S.MeasurementError):
        tables.fixed_width(df, most=1)


def test_artifacts_have_a_text_sibling(spark, tmp_path):
    df = spark.createDataFrame([("a", float("nan"))], "k string, v double")
    tables.write_artifact(spark, f"{tmp_path}/report", rows=df)
    body = "".join(r.value for r in spark.read.text(f"{tmp_path}/report.json").collect())
    assert json.loads(body) == {"rows": [{"k": "a", "v": None}]}
    assert [r.value for r in spark.read.text(f"{tmp_path}/report.txt").collect()][0] == "rows"


def test_indices_survive_json(spark):
    df = spark.createDataFrame([("a", 0.25, None), ("b", None, 3)], "factor string, s1 double, rank long")
    back = tables.indices_from_json(spark, tables.indices_json(df))
    assert back.schema.simpleString() == df.schema.simpleString() and sorted(back.collect()) == sorted(df.collect())


def test_provenance_prices_what_it_can(spark):
    calls = spark.createDataFrame([("x", "m", 2.0, False), ("x", "m", 1.0, True), ("x", "free", 1.0, False), ("y", "n", 1.0, False)], "label string, model string, minutes double, failed boolean")
    rates = spark.createDataFrame([("m", 0.5), ("free", 0.0)], "model string, usd_per_minute double")
    assets = spark.createDataFrame([("p", 1, "h")], "path string, bytes long, sha256 string")
    out = tables.provenance(calls, rates, assets, "c0ffee")
    got = {(r.label, r.model): (r.n_calls, r.n_failed, r.cost_usd, r.pricing_class, r.commit) for r in out["calls"].collect()}
    assert got == {("x", "m"): (2, 1, 1.5, "billed", "c0ffee"), ("x", "free"): (1, 0, 0.0, "local", "c0ffee"), ("y", "n"): (1, 0, None, "unknown", "c0ffee")}
    assert out["assets"].first().commit == "c0ffee"


def test_points_off_the_grid_raise(spark):
    df = spark.createDataFrame([], "model string, condition_name string, wer_hi double, conf_pct_hi double, flagged boolean")
    with pytest.raises(ValueError):
        profiles.sweep_sets(df, wer_hi=0.33)
    assert profiles.sweep_sets(df).count() == 0


def test_members_of_a_sweep(spark):
    rows = [("m", c, w, p, c == "core" or (c == "edge" and w <= 0.3 and p <= 0.6)) for c in ("core", "edge", "never") for w in taxonomy.WER_GRID for p in taxonomy.CONF_GRID]
    r = profiles.sweep_sets(spark.createDataFrame(rows, "model string, condition_name string, wer_hi double, conf_pct_hi double, flagged boolean")).first()
    assert (r.n_ever, r.n_core, r.n_default, r.near_low, r.near_high) == (2, 1, 2, 1, 2)
    assert r.fold == 1.5 and r.default_persistence == pytest.approx((1 + 20 / 63) / 2) and r.verdict == "moderate"


def test_ladders(spark):
    df = spark.createDataFrame([("up", k, float(k)) for k in range(4)] + [("saw", k, float(k % 2)) for k in range(4)] + [("short", k, float(k)) for k in range(2)], "k string, l int, v double")
    got = {r.k: (r.spearman, r.n_sign_flips, r.monotone) for r in profiles.trend(df, ["k"], "l", "v").collect()}
    assert got["up"] == (pytest.approx(1.0), 0, True) and got["saw"][1:] == (2, False) and got["short"] == (None, 0, False)


def test_curves_that_fall_apart(spark):
    df = spark.createDataFrame([(0, 0.0, 0.0), (1, 1.0, 0.0), (2, 1.0, 0.0), (3, 1.0, 1.0)], "l int, f double, x double").withColumn("k", F.lit(1))
    r = profiles.degradation_rates(df, ["k"], "l", "f", "x").first()
    assert (r.feature_half, r.lexical_half, r.leads, r.coupled, r.max_gap) == (0.5, 2.5, "feature", False, 1.0)


def test_half_levels_that_differ_in_their_last_digits_are_together(spark):
    ys, zs = (1856, 2379, 2362, 2201, 1980, 2113, 2220), (336, 344, 343, 321, 300, 350, 380)
    df = spark.createDataFrame([(k + 1, 0.0 + y, 0.0 + z) for k, (y, z) in enumerate(zip(ys, zs, strict=True))], "l int, f double, x double").withColumn("k", F.lit(1))
    r = profiles.degradation_rates(df, ["k"], "l", "f", "x").first()
    assert r.feature_half == pytest.approx(r.lexical_half, abs=1e-9) and r.leads == "together"


def test_gaps_of_two_runs(spark):
    df = spark.createDataFrame([(f"c{k}", 0.1 + k / 1000) for k in range(20)] + [("lost", None), ("nan", float("nan"))], "c string, g double")
    r = profiles.level_gap(df, "c", "g").first()
    assert r.n == 20 and r.direction == "overestimates" and r.significant and r.low <= r.mean_gap <= r.high
    none = profiles.level_gap(df.where("g is null"), "c", "g").first()
    assert (none.n, none.mean_gap, none.direction, none.significant) == (0, None, "undetermined", False)


def test_foreign_words_by_count_then_name(spark):
    e = spark.createDataFrame([("c", "g", "ins", w) for w in ("b", "a", "b", "own", "")] + [("c", "g", "del", None)], "clip_id string, g string, op string, hyp string")
    v = spark.createDataFrame([("c", "own"), ("c", "own")], "clip_id string, word string")
    assert [(r.word, r.n, r.place) for r in profiles.top_inserted(e, v, "g").orderBy("place").collect()] == [("b", 2, 1), ("a", 1, 2)]


def test_keys_without_a_dimension_are_counted(spark):
    rows, dim = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "k string, v int"), spark.createDataFrame([("a", "x")], "k string, d string")
    found, lost = profiles.looked_up(rows, dim, "k")
    assert [tuple(r) for r in found.collect()] == [("a", 1, "x")] and [tuple(r) for r in lost.collect()] == [("b", 2)]


def test_sentences_say_what_is_wrong(spark):
    df = spark.createDataFrame([("m", "c", 0.5, 0.75)], "model string, condition_name string, wer_spoke double, conf_pct double")
    assert df.select(profiles.sentence()).first()[0] == "m in c: 50 % of words wrong on clips it spoke, confidence above 75 % of its conditions"


def test_a_missing_measure_breaks_no_rule(spark):
    ddl = "clip_id string, fs int, channels int, subtype string, duration_s double, peak double, n_near_clip int, lead_s double, tail_s double, snr_db double"
    df = spark.createDataFrame([("good", 16000, 1, "PCM_16", 3.0, 0.4, 0, 0.3, 0.3, None), ("bad", 44100, 2, "MP3", 30.0, 0.995, 20, 0.1, 0.1, 5.0)], ddl)
    got = {r.clip_id: (r.errors, r.warnings) for r in gate.clip_faults(df).collect()}
    assert got["good"] == ([], []) and got["bad"] == (["channels", "sample_rate", "subtype", "clipped", "lead", "tail", "duration"], ["peak", "snr"])
    assert gate.sample_rates(df).first().mixed
