"""Planted truth is found, and broken data is refused."""

import pytest
from pyspark.sql import functions as F

from gaugeworks import schema as S
from gaugeworks.operators import compare, edits, estimands, guards, ranking, sensitivity, taxonomy
from gaugeworks.sources import tables


@pytest.fixture(scope="module")
def planted(spark):
    return tables.synthetic(spark, 4, ["one"]).cache()


@pytest.fixture(scope="module")
def table(planted):
    return estimands.condition_table(planted).cache()


def silenced(rows, where):
    """The rows that meet ``where`` heard nothing."""
    out = rows.withColumn("_s", where)
    change = {"transcript": F.lit(""), "n_del": F.col("n_ref"), "n_sub": F.lit(0), "n_ins": F.lit(0), "wer": F.lit(1.0), "mean_conf": F.lit(None).cast("double")}
    for c, v in change.items():
        out = out.withColumn(c, F.when(F.col("_s"), v).otherwise(F.col(c)))
    return out.drop("_s")


def test_dead_zones_are_loud_reverberant_conditions(table):
    found = taxonomy.dead_zones(table).collect()
    assert found and all(r.rt60 >= 0.6 and r.snr_db >= 10 for r in found)
    assert [r["rank"] for r in sorted(found, key=lambda r: -r.gap)] == sorted(r["rank"] for r in found)


def test_failed_rows_are_counted_and_never_averaged(spark, planted, table):
    broken = tables.synthetic(spark, 4, ["one"], failed_one_in=5)
    assert broken.where("failed").count() > 10
    got = estimands.condition_table(broken)
    assert got.agg(F.sum("n_clips"), F.sum("n_failed_excluded")).first() == (broken.where("not failed").count(), broken.where("failed").count())
    both = got.select("condition_name", F.col("wer").alias("w")).join(table, "condition_name")
    assert both.where("abs(w - wer) > 1e-12").count() == 0


def test_silence_is_no_confidence_and_mute_comes_first(planted):
    rows = silenced(planted, (F.col("rt60") == 1.0) & ((F.col("snr_db") == 20.0) | (F.col("clip_id") == "c001")))
    t = taxonomy.classify(estimands.condition_table(rows))
    mute = t.where("rt60 = 1.0 and snr_db = 20.0")
    assert mute.where("category <> 'mute_zone' or dead_zone or gap is not null").count() == 0 and mute.count() == 3
    partly = t.where("rt60 = 1.0 and snr_db = 10.0").first()
    assert partly.n_silent == 1 and partly.wer_spoke < partly.wer and partly.gap < partly.gap_all_clips


def test_without_silence_both_pairings_are_equal(table):
    g = estimands.add_gap_metrics(table)
    assert g.where("gap <> gap_all_clips or wer <> wer_spoke or acc_pct <> acc_pct_all_clips").count() == 0


def test_sweep_is_monotone_and_its_guard_fires(table):
    counts = taxonomy.require_monotone(taxonomy.sweep_counts(taxonomy.sweep(table)))
    assert counts.count() == 63
    bad = counts.withColumn("n_dead_zones", F.when((F.col("wer_hi") == 0.5) & (F.col("conf_pct_hi") == 0.9), 99).otherwise(F.col("n_dead_zones")))
    with pytest.raises(S.MeasurementError):
        taxonomy.require_monotone(bad)


def test_percentiles_are_invariant_under_rescaling(spark):
    two = tables.synthetic(spark, 3, ["a", "b"]).withColumn("mean_conf", F.when(F.col("model") == "b", F.col("mean_conf") ** 3 / 2).otherwise(F.col("mean_conf")))
    g = taxonomy.classify(estimands.condition_table(two))
    pct = g.groupBy("condition_name").agg(F.count_distinct("conf_pct").alias("n"), F.count_distinct("category").alias("c"))
    assert pct.where("n <> 1 or c <> 1").count() == 0


def test_deletions_follow_reverberation(planted):
    x = edits.contrasts(planted, ["model"], F.col("rt60") == 1.0, F.col("rt60") == 0.2, "rt60").collect()
    assert max(x, key=lambda r: abs(r.delta)).edit == "del" and all(abs(r.delta) < 1e-12 for r in x if r.edit != "del")
    x = {r.edit: r for r in edits.contrasts(planted, ["model"], F.col("noise_type") == "babble", F.col("noise_type") == "engine", "babble").collect()}
    assert x["ins"].delta == pytest.approx(0.1) and x["ins"].d_infinite and x["ins"].cohens_d is None


def test_guards_raise(spark, planted):
    with pytest.raises(S.DuplicateCellError):
        guards.require_unique_cells(planted.unionAll(planted.limit(1)))
    with pytest.raises(S.NonFiniteError):
        guards.require_finite(planted.withColumn("wer", F.lit(float("nan"))), "wer")
    with pytest.raises(S.ArmPoolingError):
        guards.require_one_model(tables.synthetic(spark, 1, ["a", "b"]))
    with pytest.raises(S.DegenerateLabelError):
        guards.require_two_classes(planted, F.lit(1))
    with pytest.raises(S.WerIncomparableArmError):
        guards.require_comparable(tables.synthetic(spark, 1, ["a", "b"]), ["b"])
    with pytest.raises(S.IncompleteDesignError):
        guards.require_complete(spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "a int, b int"), "a", "b")
    with pytest.raises(S.MeasurementError):
        guards.require_no_shrink(planted, planted.where("rt60 < 1.0"))
    with pytest.raises(S.ConfidenceAlignmentError):
        guards.require_equal_lengths(planted.withColumn("x", F.array(F.lit(1))), "word_confidences", "x")
    with pytest.raises(S.MeasurementError):
        guards.require_disjoint(planted, planted, "clip_id")
    assert guards.require_unique_cells(planted) is planted and guards.require_finite(planted, "wer") is planted


def test_intersections(spark):
    two = tables.synthetic(spark, 5, ["a", "b"])
    ragged = two.where("not (model = 'b' and clip_id in ('c000', 'c001'))")
    assert {r.model: r["count"] for r in compare.arm_intersection(ragged).groupBy("model").count().collect()} == {"a": 225, "b": 225}
    for rows, models, error in ((ragged, ["a", "x"], S.RaggedArmsError), (ragged.where("model = 'a'"), None, S.RaggedArmsError), (ragged.where("clip_id <= 'c003'"), None, S.ThinOverlapError), (two.unionAll(two.limit(1)), None, S.DuplicateCellError)):
        with pytest.raises(error):
            compare.arm_intersection(rows, models)
    with pytest.raises(S.ClipSetMismatchError):
        compare.common_clips(two, two.where("clip_id = 'c000'"))


def test_assignment_is_one_to_one_and_least(spark):
    from itertools import permutations

    a, b = [(1, 0.2), (2, 0.5), (3, 0.9)], [(7, 0.55), (8, 0.25), (9, 0.86)]
    frame = lambda x: spark.createDataFrame([("k", i, v) for i, v in x], "g string, id long, v double")
    got = compare.nearest_assignment(frame(a), frame(b), ["g"], "v", "id", 0.045).collect()
    assert sum(r.delta for r in got) == pytest.approx(min(sum(abs(x[1] - y[1]) for x, y in zip(a, p, strict=True)) for p in permutations(b)))
    assert {r.a: r.status for r in got} == {1: "too_far", 2: "too_far", 3: "paired"}
    extra = compare.nearest_assignment(frame(a), frame(b[:2]), ["g"], "v", "id", 1.0)
    assert extra.where("status = 'unmatched'").count() == 1


def test_correlations_of_degenerate_data_are_null(spark):
    flat = spark.createDataFrame([("a", 1.0, float(k)) for k in range(5)] + [("b", 1.0, 2.0)], "k string, x double, y double")
    assert {r.k: r.rho for r in ranking.spearman(flat, ["k"], "x", "y").collect()} == {"a": None, "b": None}
    assert ranking.auroc(flat.where("k = 'a'"), ["k"], "y", F.lit(True)).first().auroc is None


def test_regions_close_the_last_bin_and_leave_out_what_lies_outside(spark):
    t = spark.createDataFrame([(x, "c") for x in (0.0, 0.24, 0.25, 1.0, 1.2)], "x double, c string")
    got = estimands.with_region(t, {"x": (0.0, 1.0), "c": None}).collect()
    assert sorted((r.x, r.region) for r in got) == [(0.0, "0"), (0.24, "0"), (0.25, "1"), (1.0, "3")]


def test_severity_never_sees_an_outcome(table):
    s = sensitivity.severity(table, {"rt60": True, "snr_db": False})
    assert s.where("severity = 0").select("rt60", "snr_db").distinct().collect() == [(0.2, 20.0)]
