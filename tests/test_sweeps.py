import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gaugeworks import schema as S
from gaugeworks.operators import sweeps

DDL = "factor string, feature string, clip_id string, level double, wer double, drift double"


def points(spark, curves):
    """curves: (factor, feature, clip) -> list of (level, wer, drift)"""
    rows = [(*k, float(lv), float(w), float(d)) for k, c in curves.items() for lv, w, d in c]
    return spark.createDataFrame(rows, DDL).repartition(3)


def ranks(v):
    return [sum(y < x for y in v) + (sum(y == x for y in v) + 1) / 2 for x in v]


def rho(a, b):
    if len(a) < 3:
        return None
    a, b = ranks(a), ranks(b)
    ma, mb = sum(a) / len(a), sum(b) / len(b)
    va, vb = sum((x - ma) ** 2 for x in a), sum((x - mb) ** 2 for x in b)
    return sum((x - ma) * (y - mb) for x, y in zip(a, b)) / (va * vb) ** 0.5 if va and vb else None


def scaled(v, ends=None):
    low, high = ends or (min(v), max(v))
    return [(x - low) / (high - low) if high > low else 0.0 for x in v]


def half(levels, y):
    for k in range(1, len(y)):
        if y[k] >= 0.5:
            return levels[k] if y[k] == y[k - 1] else levels[k - 1] + (0.5 - y[k - 1]) * (levels[k] - levels[k - 1]) / (y[k] - y[k - 1])
    return levels[-1]


def censored(v, y):
    return "none" if max(v) <= min(v) else "left" if y[0] >= 0.5 else "right" if max(y) < 0.5 else "inside"


def facts(curve, falls, ends=None):
    curve = sorted(curve, key=lambda p: -p[0] if falls else p[0])
    levels, w, d = ([p[k] for p in curve] for k in range(3))
    yd, yw = scaled(d), scaled(w, ends)
    f, h = half(levels, yd), half(levels, yw)
    steps = [b - a for a, b in zip(d, d[1:]) if abs(b - a) > 1e-12]
    a, b = (-f, -h) if falls else (f, h)
    return {
        "spearman": rho(d, w), "max_gap": max(abs(x - y) for x, y in zip(yd, yw)), "feature_half": f, "lexical_half": h, "leads": "together" if abs(a - b) < 1e-9 else "feature" if a < b else "lexical",
        "trend": rho(list(range(len(d))), d), "n_sign_flips": sum((a > 0) != (b > 0) for a, b in zip(steps, steps[1:])), "lexical_range": max(w) - min(w), "feature_censored": censored(d, yd), "lexical_censored": censored(w, yw),
    }


def brute(curves, ends=None):
    out = {}
    for key in {k[:2] for k in curves}:
        clips, falls = {k[2]: sorted(c) for k, c in curves.items() if k[:2] == key}, key[0] == "snr_db"
        n = len(clips)
        mean = [(c[0][0], round(sum(p[1] for p in c) / n, 12), round(sum(p[2] for p in c) / n, 12)) for c in zip(*clips.values())]
        m, own = facts(mean, falls, ends), [facts(c, falls, ends) for c in clips.values()]
        said = Counter(c["leads"] for c in own if c["lexical_range"] >= 0.1)
        top, most = min(said.items(), key=lambda kv: (-kv[1], kv[0])) if said else (None, 0)
        m |= {"n_flat": n - sum(said.values()), "top_lead": top, "agreement": most / sum(said.values()) if said else 0.0, "lexical_floor": m["lexical_range"] < 0.1, "reliable": m["trend"] is not None and m["trend"] >= 0.7, "coupled": m["max_gap"] <= 0.2}
        m["quotable"] = m["reliable"] and not m["lexical_floor"] and all(m[f"{c}_censored"] in ("inside", "right") for c in ("feature", "lexical"))
        m["stable"] = m["agreement"] >= 0.8 and top == m["leads"] and m["reliable"] and not m["lexical_floor"]
        out[key] = m
    return out


def headline(found):
    out = {}
    for factor in sorted({k[0] for k in found}):
        all_ = sorted((k[1], v) for k, v in found.items() if k[0] == factor)
        trend = lambda v: -2.0 if v["trend"] is None else v["trend"]
        wins = lambda pool: min(Counter(v["leads"] for _, v in pool).items(), key=lambda kv: (-kv[1], kv[0]))[0]
        stable = [x for x in all_ if x[1]["stable"]]
        if all_[0][1]["lexical_floor"]:
            pool, lead = [x for x in all_ if x[1]["reliable"]], "feature"
            pool, lead = (pool, lead) if pool else (all_, "neither")
            name, v = min(pool, key=lambda x: (-trend(x[1]), x[0]))
        elif stable:
            lead = wins(stable)
            name, v = min((x for x in stable if x[1]["leads"] == lead), key=lambda x: (-abs(x[1]["feature_half"] - x[1]["lexical_half"]), x[0]))
        else:
            pool = [x for x in all_ if x[1]["quotable"]] or [x for x in all_ if x[1]["reliable"]]
            lead = wins(pool) if pool else "undetermined"
            name, v = min(pool or all_, key=lambda x: (-trend(x[1]), x[0]))
        verdict = "lexical_floor" if v["lexical_floor"] else "no_threshold" if not v["quotable"] else "coupled" if v["coupled"] else "decoupled"
        out[factor] = (name, lead, verdict)
    return out


def planted():
    up, late = [0.0, 0.25, 0.5, 0.75, 1.0], [0.0, 0.0, 0.0, 0.1, 1.0]
    falls, saw = up[::-1], [0.3, 0.9, 0.1, 0.8, 0.2]
    flat, tiny = [0.4] * 5, [0.0, 0.01, 0.02, 0.03, 0.04]
    shapes = {
        ("both", "f"): (up, up), ("early", "f"): (late, up), ("late", "f"): (up, late), ("floor", "f"): (tiny, up), ("floor", "g"): (tiny, saw), ("quiet", "g"): (tiny, saw), ("snr_db", "f"): (late, up), ("snr_db", "g"): (up, falls),
        ("unread", "g"): (up, falls), ("unread", "h"): (up, flat), ("starts_high", "f"): (falls, up), ("mixed", "f"): (up, up), ("mixed", "g"): (up, saw),
    }
    out = {}
    for (factor, feature), (w, d) in shapes.items():
        for clip in range(5):
            levels = [20, 15, 10, 5, 0] if factor == "snr_db" else range(5)
            wer = late if factor == "mixed" and clip < 2 else w
            out[factor, feature, f"c{clip}"] = [(lv, x * (1 - clip / 50), y) for lv, x, y in zip(levels, wer, d)]
    out |= {("both", "f", "still"): [(lv, 0.5, y) for lv, y in zip(range(5), up)]}
    return out


def chance(seed):
    rng, out = random.Random(seed), {}
    for k in range(12):
        n, slope, clips = rng.randrange(2, 7), rng.random(), rng.choice([2, 4])
        errors = {(c, lv): round(slope * lv / 10 + rng.random() / 8, 3) for c in range(clips) for lv in range(n)}
        for feature in "abc":
            drive = rng.choice([1.0, 0.3, -0.5])
            for c in range(clips):
                out[f"x{k}" if k else "snr_db", feature, f"c{c}"] = [(lv, errors[c, lv], round(drive * lv + rng.random(), 2)) for lv in range(n)]
    return out


@pytest.mark.parametrize("curves", [planted(), chance(1), chance(2)])
def test_verdicts_equal_brute_force(spark, curves):
    got = sweeps.feature_verdicts(points(spark, curves)).cache()
    want, rows = brute(curves), {(r.factor, r.feature): r.asDict() for r in got.collect()}
    assert rows.keys() == want.keys()
    for key, m in want.items():
        for name, v in m.items():
            assert rows[key][name] == (pytest.approx(v, abs=1e-9) if isinstance(v, float) else v), (key, name)
    heads = {r.factor: (r.primary_feature, r.factor_leads, r.verdict) for r in sweeps.sweep_verdicts(got).collect()}
    assert heads == headline(want)


def test_all_branches(spark):
    got = sweeps.feature_verdicts(points(spark, planted()))
    rows = {(r.factor, r.feature): r for r in got.withColumn("says", sweeps.sentence()).collect()}
    heads = {r.factor: r for r in sweeps.sweep_verdicts(got).collect()}
    assert {f: (r.factor_leads, r.verdict) for f, r in heads.items()} == {
        "both": ("together", "coupled"), "early": ("feature", "decoupled"), "late": ("lexical", "decoupled"), "floor": ("feature", "lexical_floor"), "quiet": ("neither", "lexical_floor"), "snr_db": ("feature", "decoupled"),
        "unread": ("undetermined", "no_threshold"), "starts_high": ("together", "no_threshold"), "mixed": ("feature", "decoupled"),
    }
    assert heads["both"].verdict == "coupled" and rows["both", "f"].n_flat == 1 and rows["both", "f"].agreement == 1.0
    assert (heads["early"].factor_leads, heads["early"].verdict) == ("feature", "decoupled") and heads["late"].factor_leads == "lexical"
    assert (heads["floor"].primary_feature, heads["floor"].factor_leads) == ("f", "feature") and heads["quiet"].factor_leads == "neither"
    assert (heads["unread"].factor_leads, heads["unread"].verdict) == ("undetermined", "no_threshold") and rows["unread", "h"].feature_censored == "none"
    assert rows["starts_high", "f"].lexical_censored == "left" and heads["starts_high"].verdict == "no_threshold"
    assert rows["snr_db", "f"].leads == "feature" and rows["snr_db", "f"].feature_half == 10.0 and (rows["snr_db", "f"].feature_from, rows["snr_db", "f"].feature_to) == (15.0, 10.0)
    assert rows["early", "f"].says == "under rising early, f reaches half at 2.00, the error at 3.44: feature leads"
    assert rows["floor", "g"].says == "under rising floor, neither the error nor g degrades measurably" and "falling snr_db" in rows["snr_db", "g"].says
    assert rows["unread", "g"].says.endswith("can be quoted: its drift doesn't follow severity, it starts past half")
    assert not rows["mixed", "f"].stable and rows["mixed", "f"].agreement == 0.6


def test_bare_numbers_and_fixed_scales(spark):
    p = points(spark, planted()).where("factor in ('snr_db', 'floor') and feature = 'f'")
    bare = {r.factor: r.leads for r in sweeps.feature_verdicts(p, by_number=True).collect()}
    assert bare["snr_db"] == "lexical"
    r = sweeps.feature_verdicts(p, lexical_scale=(0.0, 1.0)).where("factor = 'floor'").first()
    assert (r.lexical_censored, r.lexical_half, r.lexical_from, r.lexical_to) == ("right", 4.0, 4.0, None)


def test_what_is_no_sweep_raises(spark):
    good = points(spark, {("x", "f", c): [(k, k / 4, k) for k in range(4)] for c in "ab"})
    row = good.where("clip_id = 'a' and level = 1")
    for bad, error in (
        (good.unionAll(row), S.DuplicateCellError), (good.exceptAll(row), S.IncompleteDesignError), (good.where("clip_id = 'a'"), S.MeasurementError),
        (good.withColumn("drift", F.when(F.col("level") == 1, float("nan")).otherwise(F.col("drift"))), S.NonFiniteError), (good.withColumn("wer", F.when(F.col("level") != 1, F.col("wer"))), S.NonFiniteError), (good.withColumn("clip_id", F.lit(None).cast("string")), S.NonFiniteError),
    ):
        with pytest.raises(error):
            sweeps.feature_verdicts(bad)
    empty = sweeps.feature_verdicts(good.where("false"))
    assert empty.count() == 0 and sweeps.sweep_verdicts(empty).count() == 0
    wide = good.withColumn("leads", F.lit("mine")).withColumn("_s", F.lit(1))
    assert sweeps.feature_verdicts(wide).columns == empty.columns
