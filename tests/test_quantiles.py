import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.operators.ranking import exact_quantiles

RATES = [0.0, 0.1, 1 / 3, 0.5, 0.99, 1.0]


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(2)
    draws = {"a": rng.normal(0, 1, 400) * 10.0 ** rng.integers(-8, 8, 400), "b": np.round(rng.random(500), 2), "c": np.array([3.5]), "d": np.array([-1.0, 1000.0, 999.9999999, 0.0, -0.0, 1e300, -1e-300]), None: np.arange(5.0), "same": np.full(50, 0.3)}
    rows = [(k, float(v)) for k, vs in draws.items() for v in vs] + [("a", None), ("a", float("nan")), ("none", None)]
    got = {(r.k, r.rate): r.quantile for r in exact_quantiles(spark.createDataFrame(rows, "k string, v double").repartition(4), ["k"], "v", RATES).collect()}
    assert set(got) == {(k, q) for k in draws for q in RATES}
    for (k, q), v in got.items():
        assert v == pytest.approx(np.quantile(draws[k], q), rel=1e-12, abs=1e-300), (k, q)


def test_quantiles_of_many_distinct_values_equal_percentile(spark):
    df = spark.range(1_000_000).select((F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / (1 << 40)).alias("v"))
    want = df.agg(F.percentile("v", F.array(*map(F.lit, RATES)))).first()[0]
    got = {r.rate: r.quantile for r in exact_quantiles(df, [], "v", RATES).collect()}
    assert [got[q] for q in RATES] == pytest.approx(want, rel=1e-12)
    assert exact_quantiles(df.where("false"), [], "v", RATES).count() == 0
