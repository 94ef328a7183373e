"""Assignments, sweeps and overlaps against plain loops."""

import random
import resource

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks import schema as S
from gaugeworks.operators import compare, profiles, taxonomy


def least_total(few, many):
    """The least total distance of a matching that keeps the order, cell by cell."""
    total = np.zeros(len(many) - len(few) + 1)
    for k, x in enumerate(few):
        total = np.minimum.accumulate(total) + np.abs(x - many[k : k + len(total)])
    return total.min()


def test_partners_are_of_least_total_distance():
    rng = np.random.default_rng(4)
    for trial in range(400):
        n = int(rng.integers(0, 30))
        m = n + int(rng.integers(0, 30))
        draw = (lambda k: rng.integers(0, 12, k) / 2) if trial % 2 else (lambda k: rng.normal(0, 3, k) + (rng.random(k) < 0.5) * 9)
        few, many = np.sort(draw(n)), np.sort(draw(m))
        to = compare.least_partners(few, many)
        assert len(to) == n and (np.diff(to) > 0).all()
        assert np.abs(few - many[to]).sum() == pytest.approx(least_total(few, many) if n else 0, abs=1e-9)


def test_a_large_group_takes_memory_linear_in_its_rows():
    rng = np.random.default_rng(1)
    few, many = np.sort(rng.random(40_000)), np.sort(rng.random(500_000) * 1.5)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    to = compare.least_partners(few, many)
    assert (np.diff(to) > 0).all() and np.abs(few - many[to]).sum() < 0.5
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 300_000  # KB; a bit a cell would take 2.3 GB


def table(spark, n=60):
    rng = random.Random(7)
    at = lambda grid: rng.choice([*grid, None, rng.random(), rng.random()])
    rows = [(m, f"c{k}", rng.choice([0.5, 0.5, 0.5, None]), at(taxonomy.WER_GRID), at(taxonomy.CONF_GRID)) for m in "xyz" for k in range(n)] + [("mute", "c0", None, 0.9, 0.9)]
    return spark.createDataFrame(rows, "model string, condition_name string, mean_conf double, wer_spoke double, conf_pct double")


def test_grid_equals_the_sweep_of_copies(spark):
    t = table(spark)
    swept = taxonomy.sweep(t)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(taxonomy.grid_counts(t)) == key(taxonomy.sweep_counts(swept))
    assert [(*r[:2], pytest.approx(r[2]), r[3]) for r in key(taxonomy.grid_persistence(t))] == key(taxonomy.persistence(swept))
    want = {r.model: r.asDict() for r in profiles.sweep_sets(swept).collect()}
    for r in profiles.grid_sets(t).collect():
        assert {k: pytest.approx(v) if isinstance(v, float) else v for k, v in r.asDict().items()} == want[r.model]
    assert taxonomy.grid_counts(t.where("false")).count() == 0
    fine = [k / 200 for k in range(200)]
    counts = {(r.model, r.wer_hi, r.conf_pct_hi): r.n_dead_zones for r in taxonomy.grid_counts(t, fine, fine).collect()}
    rows = t.where("mean_conf is not null").collect()
    assert len(counts) == 4 * 200 * 200
    for w, c in random.Random(1).sample([(w, c) for w in fine for c in fine], 50):
        assert counts["x", w, c] == sum(r.model == "x" and (r.wer_spoke or -1) >= w and (r.conf_pct or -1) >= c for r in rows)


def test_overlaps_of_arms(spark):
    sets = {"a": {1, 2, 3, None}, "b": {2, 3, 4}, "c": {3, 9}, "d": {3}}
    rows = [(g, i) for g, s in sets.items() for i in s] + [("a", 1), (None, 77)]
    df = spark.createDataFrame(rows, "g string, i int")
    pairs = {(r.a, r.b): (r.n_a, r.n_b, r.n_both, r.n_either, r.jaccard) for r in compare.set_overlap(df, "g", "i").collect()}
    assert pairs == {(x, y): (len(sets[x]), len(sets[y]), len(sets[x] & sets[y]), len(sets[x] | sets[y]), len(sets[x] & sets[y]) / len(sets[x] | sets[y])) for x in sets for y in sets if x < y}
    every = set.union(*sets.values())
    for r in compare.arm_overlap(df, "g", "i").collect():
        only = sets[r.g] - set.union(*(s for g, s in sets.items() if g != r.g))
        assert (r.n, r.n_only, r.n_shared, r.n_all, r.n_any, r.jaccard) == (len(sets[r.g]), len(only), len(sets[r.g] - only), 1, len(every), 1 / len(every))
    assert sorted(map(tuple, compare.only_in(df, "g", "i").na.fill(-1).collect())) == [("a", -1), ("a", 1), ("b", 4), ("c", 9)]
    assert compare.set_overlap(df.where("false"), "g", "i").count() == compare.arm_overlap(df.where("false"), "g", "i").count() == 0
    with pytest.raises(S.MeasurementError):
        compare.arm_overlap(spark.range(70).select(F.col("id").cast("string").alias("g"), "id"), "g", "id")
