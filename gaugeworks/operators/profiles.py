"""Summaries of conditions, rooms and clips that reports are made of."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks import schema as S
from gaugeworks.functions import text
from gaugeworks.operators import ranking, resampling, sensitivity, taxonomy
from gaugeworks.session import persist


def spread(rows: DataFrame) -> DataFrame:
    """One row per model and condition for comparing runs: mean error with its population
    deviation, the error of the rows that spoke, and whether none did."""
    said = S.spoke()
    return S.usable(rows).groupBy("model", "condition_name").agg(
        F.count("*").alias("n"), F.count_distinct("clip_id").alias("n_clips"), F.avg("wer").alias("wer"), F.stddev_pop("wer").alias("wer_sd"),
        F.avg(F.when(said, F.col("wer"))).alias("wer_spoke"), F.count_if(said).alias("n_spoke"), (F.count_if(said) == 0).alias("mute"),
    )


def lost_conditions(rows: DataFrame) -> DataFrame:
    """Conditions of which no row can be used or none spoke a word: (model,
    condition_name, n_rows, n_failed, n_silent, errors), the errors sorted."""
    bad, silent = S.is_failed(), ~S.is_failed() & S.is_silent()
    error = F.array_sort(F.collect_set(F.when(bad, F.col("error")))) if "error" in rows.columns else F.array().cast("array<string>")
    out = rows.groupBy("model", "condition_name").agg(F.count("*").alias("n_rows"), F.count_if(bad).alias("n_failed"), F.count_if(silent).alias("n_silent"), error.alias("errors"))
    return out.where("n_failed = n_rows or (n_failed < n_rows and n_silent = n_rows - n_failed)")


def mean_by(rows: DataFrame, *keys: str, value: str = "wer", z: float = 1.96) -> DataFrame:
    """Mean of a value by keys with a normal interval; a group of one row has none."""
    x = S.usable(rows).where(F.col(value).isNotNull())
    half = z * F.stddev_samp(value) / F.sqrt(F.count("*"))
    return x.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), half.alias("half")).select(*keys, "n", "mean", (F.col("mean") - F.col("half")).alias("low"), (F.col("mean") + F.col("half")).alias("high"))


def worst(table: DataFrame, n: int = 10, value: str = "wer") -> DataFrame:
    """The ``n`` conditions of each model with the largest value, ties by name."""
    place = F.row_number().over(Window.partitionBy("model").orderBy(F.col(value).desc_nulls_last(), "condition_name"))
    return table.withColumn("place", place).where(F.col("place") <= n)


def benign(rows: DataFrame, harsher: Mapping[str, bool], most: int = 0, mildest_codec: str = "none") -> DataFrame:
    """Rows whose condition is within ``most`` steps of the mildest corner by its settings,
    never by its outcome."""
    u = rows.select("condition_name", *harsher, "codec").distinct()
    near = sensitivity.severity(u, dict(harsher), mildest_codec).where(F.col("severity") <= most)
    # written first: of few conditions Spark then knows that they are few, and moves no row for the join
    return rows.join(persist(near.select("condition_name"), "benign"), "condition_name", "left_semi")


def sweep_sets(swept: DataFrame, wer_hi: float = S.WER_HI, conf_pct_hi: float = S.CONF_PCT_HI, wer_grid: list[float] | None = None, conf_grid: list[float] | None = None) -> DataFrame:
    """What a threshold sweep (``taxonomy.sweep``) says of the published point, by model:
    conditions ever and always flagged, those at the point and their mean persistence, least
    and most flags one step of the grid around it, the fold range, and a verdict (stable: at
    most a doubling and persistence of 0.75; fragile: a fourfold range, or persistence below
    0.4)."""
    wers, confs, i, j = _point(wer_hi, conf_pct_hi, wer_grid, conf_grid)
    there = (F.col("wer_hi") == wers[i]) & (F.col("conf_pct_hi") == confs[j])
    by = swept.groupBy("model", "condition_name").agg(F.avg(F.col("flagged").cast("int")).alias("p"), F.bool_or(there & F.col("flagged")).alias("d"), F.bool_and("flagged").alias("all"))
    return _sets(by, taxonomy.sweep_counts(swept), wers[max(i - 1, 0) : i + 2], confs[max(j - 1, 0) : j + 2])


def grid_sets(table: DataFrame, wer_hi: float = S.WER_HI, conf_pct_hi: float = S.CONF_PCT_HI, wer_grid: list[float] | None = None, conf_grid: list[float] | None = None) -> DataFrame:
    """``sweep_sets`` of the conditions' table, without a row for each condition and point."""
    wers, confs, i, j = _point(wer_hi, conf_pct_hi, wer_grid, conf_grid)
    placed, *_ = taxonomy.placed(table, wers, confs)
    share = F.col("n_wer") * F.col("n_conf") / F.lit(len(wers) * len(confs))
    by = placed.select("model", share.alias("p"), ((F.col("n_wer") > i) & (F.col("n_conf") > j)).alias("d"), (share == 1).alias("all"))
    return _sets(by, taxonomy.grid_counts(table, wers, confs), wers[max(i - 1, 0) : i + 2], confs[max(j - 1, 0) : j + 2])


def _point(wer_hi: float, conf_pct_hi: float, wer_grid: list[float] | None, conf_grid: list[float] | None) -> tuple[list[float], list[float], int, int]:
    wers, confs = sorted(wer_grid or taxonomy.WER_GRID), sorted(conf_grid or taxonomy.CONF_GRID)
    return wers, confs, wers.index(wer_hi), confs.index(conf_pct_hi)


def _sets(by: DataFrame, counts: DataFrame, wers: list[float], confs: list[float]) -> DataFrame:
    """From conditions (model, p: persistence, d: flagged at the point, all) and counts."""
    sets = by.groupBy("model").agg(F.count_if(F.col("p") > 0).alias("n_ever"), F.count_if("all").alias("n_core"), F.count_if("d").alias("n_default"), F.avg(F.when(F.col("d"), F.col("p"))).alias("default_persistence"))
    near, n = F.col("wer_hi").isin(wers) & F.col("conf_pct_hi").isin(confs), F.col("n_dead_zones")
    span = counts.groupBy("model").agg(F.min(F.when(near, n)).alias("near_low"), F.max(F.when(near, n)).alias("near_high"), ((F.max(n) + 1) / (F.min(n) + 1)).alias("fold"))
    p, fold = F.col("default_persistence"), F.col("fold")
    verdict = F.when((fold <= 2) & F.coalesce(p >= 0.75, F.lit(True)), "stable").when((fold >= 4) | F.coalesce(p < 0.4, F.lit(False)), "fragile").otherwise("moderate")
    return sets.join(span, "model").withColumn("verdict", verdict)


def order_of_arms(counts: DataFrame) -> DataFrame:
    """Of a sweep's counts, for each ordered pair of models the number of grid points and of
    those at which the first has fewer: whether the order holds where the count doesn't."""
    a, b = counts.withColumnRenamed("model", "a").withColumnRenamed("n_dead_zones", "_a"), counts.withColumnRenamed("model", "b").withColumnRenamed("n_dead_zones", "_b")
    x = a.join(b, ["wer_hi", "conf_pct_hi"]).where("a <> b")
    return x.groupBy("a", "b").agg(F.count("*").alias("n_points"), F.count_if(F.col("_a") < F.col("_b")).alias("n_below"), F.min("_a").alias("least"), F.max("_a").alias("most"))


def trend(curve: DataFrame, keys: list[str], level: str, value: str) -> DataFrame:
    """Whether a curve is a ladder: Spearman's correlation with its levels' order, changes
    of direction (steps of zero left out), and whether there are none.  Curves of fewer than
    three levels have no correlation and aren't monotone."""
    rho = ranking.spearman(curve, keys, level, value, "spearman")
    flips = sensitivity.monotonicity(curve, keys, level, value)
    out = rho.join(flips, keys, "left").withColumn("n_sign_flips", F.coalesce("n_sign_flips", F.lit(0).cast("long")))
    return out.withColumn("monotone", (F.col("n") >= 3) & (F.col("n_sign_flips") == 0))


def degradation_rates(curve: DataFrame, keys: list[str], level: str, feature: str, lexical: str, most: float = 0.2) -> DataFrame:
    """Whether two curves over the same levels degrade together: Spearman's correlation, the
    largest difference after scaling each to 0..1, whether that is at most ``most``, each
    one's half level, and which comes first (equal to nine decimals is together)."""
    scaled = lambda c: F.coalesce(F.try_divide(F.col(c) - F.min(c).over(whole), F.max(c).over(whole) - F.min(c).over(whole)), F.lit(0.0))
    whole = Window.partitionBy(*keys)
    apart = curve.withColumn("_d", F.abs(scaled(feature) - scaled(lexical))).groupBy(*keys).agg(F.max("_d").alias("max_gap"))
    halves = [sensitivity.half_level(curve, keys, level, c).withColumnRenamed("half_level", f"{n}_half") for c, n in ((feature, "feature"), (lexical, "lexical"))]
    out = ranking.spearman(curve, keys, feature, lexical, "spearman").join(apart, keys).join(halves[0], keys).join(halves[1], keys)
    a, b = F.round("feature_half", 9), F.round("lexical_half", 9)  # the last digits of a division tell no order
    first = F.when(a < b, "feature").when(b < a, "lexical").otherwise("together")
    return out.withColumn("coupled", F.col("max_gap") <= most).withColumn("leads", first)


def level_gap(pairs: DataFrame, unit: str, gap: str, replicates: int = 1000) -> DataFrame:
    """The signed gap between two runs of the same conditions (second less first), as one
    row: mean with an interval over resampled conditions, mean size, median, direction, and
    whether the interval leaves out zero."""
    x = pairs.where(F.col(gap).isNotNull() & ~F.isnan(gap))
    one = x.agg(F.count("*").alias("n"), F.avg(F.abs(gap)).alias("mean_abs_gap"), F.median(gap).alias("median_gap"))
    out = one.join(resampling.bootstrap_mean(x, unit, gap, replicates).withColumnRenamed("mean", "mean_gap"))  # one row each
    m = F.col("mean_gap")
    direction = F.when(m > 0, "overestimates").when(m < 0, "underestimates").when(m == 0, "matches").otherwise("undetermined")
    return out.drop("n_units").withColumn("direction", direction).withColumn("significant", F.coalesce((F.col("low") > 0) | (F.col("high") < 0), F.lit(False)))


def entity_errors(rows: DataFrame, specs: DataFrame, keys: list[str]) -> DataFrame:
    """Entity error beside word error by key.  ``rows``: (clip_id, transcript, wer, *keys),
    ``specs``: one row a clip (clip_id, slots, critical).  Rows without a transcript or a
    spec aren't scored but counted in ``n_unscored``."""
    x = rows.join(specs, "clip_id", "left")
    r = F.when(F.col("transcript").isNotNull() & F.col("slots").isNotNull(), text.task_result(F.col("transcript"), F.col("slots"), F.col("critical")))
    x = x.withColumn("_r", r)
    scored = F.col("_r").isNotNull()
    out = x.groupBy(*keys).agg(
        F.count_if(scored).alias("n_rows"), F.count_if(~scored).alias("n_unscored"), F.avg("_r.entity_error_rate").alias("entity_error_rate"),
        F.avg(F.when(scored, F.col("wer"))).alias("wer"), F.avg(F.col("_r.critical_failure").cast("int")).alias("critical_failure_rate"),
    )
    return out.withColumn("entity_minus_wer", F.col("entity_error_rate") - F.col("wer"))


def lengths(pairs: DataFrame, keys: list[str], ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    """How much longer answers are than their references, and how foreign: median and 95th
    percentile of the ratio of lengths, share above 2, mean share of words that the
    reference lacks.  Rows with an empty reference have no ratio and are left out."""
    n, m = F.size(ref), F.size(hyp)
    foreign = F.size(F.filter(hyp, lambda w: ~F.array_contains(F.col(ref), w))) / F.greatest(m, F.lit(1))
    x = pairs.where(n > 0).select(*keys, (m / n).alias("_r"), foreign.alias("_f"))
    return x.groupBy(*keys).agg(
        F.count("*").alias("n"), F.percentile("_r", F.lit(0.5)).alias("median_ratio"), F.percentile("_r", F.lit(0.95)).alias("p95_ratio"), F.avg((F.col("_r") > 2).cast("int")).alias("share_over_2"), F.avg("_f").alias("mean_foreign"),
    )


def top_inserted(edits: DataFrame, vocabulary: DataFrame, key: str, top: int = 8) -> DataFrame:
    """The commonest foreign insertions by key: (key, word, n, place), ties by word.
    ``edits``: (clip_id, key, op, hyp), ``vocabulary``: (clip_id, word)."""
    x = edits.where("op = 'ins' and hyp <> ''").withColumnRenamed("hyp", "word").join(vocabulary.select("clip_id", "word").distinct(), ["clip_id", "word"], "left_anti")
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "word"))
    return x.groupBy(key, "word").agg(F.count("*").alias("n")).withColumn("place", place).where(F.col("place") <= top)


def with_fix(signatures: DataFrame, fixes: Mapping[tuple[str, str], str], generic: Mapping[str, str], none: str = "none") -> DataFrame:
    """Signatures (contrast, edit, delta, ...) with what would mend them: the fix of the
    contrast and its edit, of the contrast's factor (up to ``=``), or of the edit; ``none``
    where the edit became no commoner."""
    factor = F.split_part("contrast", F.lit("="), F.lit(1))
    hit = F.lit(None).cast("string")
    for place in ("contrast", factor):
        for (name, edit), fix in fixes.items():
            hit = F.coalesce(hit, F.when(((F.col(place) if isinstance(place, str) else place) == name) & (F.col("edit") == edit), F.lit(fix)))
    for edit, fix in generic.items():
        hit = F.coalesce(hit, F.when(F.col("edit") == edit, F.lit(fix)))
    return signatures.withColumn("fix", F.when(F.col("delta") > 0, hit).otherwise(F.lit(none)))


def coordinate_spread(differences: DataFrame, value: str = "median_paired_diff", least: float = 0.01) -> DataFrame:
    """How far the choice of coordinate moves a paired difference, over all coordinates, as
    one row; those without a finite difference are only counted."""
    x = F.when(~F.isnan(value) & (F.abs(value) < float("inf")), F.col(value))
    return differences.agg(
        F.count(x).alias("n"), F.count_if(x.isNull()).alias("n_incomparable"), F.min(x).alias("least"), F.median(x).alias("median"), F.max(x).alias("most"),
        F.count_if(x < 0).alias("n_favouring"), F.count_if(F.abs(x) > least).alias("n_moved"),
    )


def looked_up(rows: DataFrame, dimension: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows with the columns of their dimension, keys that it lacks with their number of
    rows): what is missing is counted, never dropped unseen."""
    return rows.join(dimension, key), rows.join(dimension.select(key), key, "left_anti").groupBy(key).agg(F.count("*").alias("n_rows"))


def sentence() -> Column:
    """A row of ``taxonomy.dead_zones`` in words."""
    pct = lambda c: F.round(F.col(c) * 100).cast("int").cast("string")
    return F.concat(F.col("model"), F.lit(" in "), F.col("condition_name"), F.lit(": "), pct("wer_spoke"), F.lit(" % of words wrong on clips it spoke, confidence above "), pct("conf_pct"), F.lit(" % of its conditions"))


def normalization_shift(rows: DataFrame, ref: str, hyp: str, keys: list[str], wer_hi: float = S.WER_HI) -> DataFrame:
    """What normalization for comparing models does to the error, by key: (keys, n, wer_strict,
    wer_normalized, shift: strict less normalized, n_cleared: rows whose error falls below
    ``wer_hi``, n_raised: rows whose error rises to it).

    Both texts of a row go through both rules (``text.normalize``, ``text.cross_model_tokens``);
    errors are over the reference's tokens under the same rule, means are of rows.  A row
    without a reference token has an error of 1 if anything was heard, else 0; null texts
    have no tokens."""
    rules = {"strict": text.normalize, "normalized": text.cross_model_tokens}
    x = rows.select(*keys, *[rule(F.col(c)).alias(f"_{side}_{name}") for name, rule in rules.items() for side, c in (("ref", ref), ("hyp", hyp))])
    for name in rules:
        x = text.error_counts(x, f"_ref_{name}", f"_hyp_{name}", f"_n_{name}")
        size, n = F.size(f"_ref_{name}"), F.col(f"_n_{name}")
        x = x.withColumn(f"_wer_{name}", F.when(size > 0, n / size).otherwise((n > 0).cast("double")))
    a, b = F.col("_wer_strict"), F.col("_wer_normalized")
    return x.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(a).alias("wer_strict"), F.avg(b).alias("wer_normalized"), F.avg(a - b).alias("shift"), F.count_if((a >= wer_hi) & (b < wer_hi)).alias("n_cleared"), F.count_if((a < wer_hi) & (b >= wer_hi)).alias("n_raised"),
    )
