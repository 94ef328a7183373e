"""Verdicts of sweeps: does a feature of the sound degrade before the transcript does, where
can a half level be read at all, and do the clips agree?

A sweep is a long table, one row for each (factor, feature, clip_id, level): ``drift``, how far
the feature moved from the clean recording, and ``wer``.  Every clip runs the same levels.
Levels are ordered by severity: rising, but for the ``falling`` factors (a signal-to-noise
ratio gets worse as it falls).  Half levels stay in the factor's own units.

All facts of a curve come from windows over its own keys and one aggregate by them, so the
curves of all clips are shuffled once, and a task never holds more than some curves.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks import schema as S
from gaugeworks.operators.ranking import correlation, with_average_rank

SWEEP = ("factor", "feature")
#: Factors that get worse as they fall.
FALLING = ("snr_db",)
#: Least travel of the mean error, and of a clip's that votes.
LEXICAL_RANGE = 0.10
#: Least Spearman's correlation of a drift with its severity.
TREND = 0.70
#: Least share of the voting clips that agree.
QUORUM = 0.8
#: Largest gap of two coupled curves, each scaled to 0..1.
GAP = 0.2
#: Half levels no further apart are one: sums in another order differ in the last digits.
SAME = 1e-9
_STILL = 1e-12


def require_sweep(points: DataFrame) -> DataFrame:
    """The points, if they are sweeps: each clip has each level of its sweep once, all values
    are finite, at least two clips.  One aggregate; an empty table is a sweep of nothing."""
    odd = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    by = points.groupBy(*SWEEP).agg(
        F.count("*").alias("n"), F.count_distinct("clip_id").alias("clips"), F.count_distinct("level").alias("levels"), F.count_distinct("clip_id", "level").alias("cells"),
        F.count_if(odd("wer")).alias("wer"), F.count_if(odd("drift")).alias("drift"), F.count_if(F.col("clip_id").isNull() | odd("level")).alias("place"),
    )
    bad = by.where("n <> cells or cells <> clips * levels or wer + drift + place > 0 or clips < 2").orderBy(*SWEEP).first()
    if bad is None:
        return points
    name = f"{bad.factor}, {bad.feature}"
    if bad.wer + bad.drift + bad.place:
        raise S.NonFiniteError(f"{name}: {bad.wer} errors, {bad.drift} drifts and {bad.place} clips or levels aren't finite")
    if bad.n != bad.cells:
        raise S.DuplicateCellError(f"{name}: {bad.n} rows for {bad.cells} pairs of clip and level")
    if bad.cells != bad.clips * bad.levels:
        raise S.IncompleteDesignError(f"{name}: {bad.cells} pairs of {bad.clips} clips and {bad.levels} levels")
    raise S.MeasurementError(f"{name}: one clip has no spread")


def _severity(falling: Collection[str]) -> Column:
    return F.col("level") * F.when(F.col("factor").isin(*falling), -1.0).otherwise(1.0)


def curve_facts(points: DataFrame, keys: list[str], *, falling: Collection[str] = FALLING, by_number: bool = False, gap: float = GAP, lexical_scale: tuple[float, float] | None = None) -> DataFrame:
    """One row a pair of curves (``drift`` and ``wer`` over ``level``, by ``keys``, ``factor``
    among them).  For both: the range, the half level, where it lies, and the two levels that
    hold it; Spearman's correlation of the two, their largest gap, ``coupled``, ``leads``; the
    drift's trend against severity, its sign flips.

    A half level is where the scaled curve first reaches one half after its mildest level, on
    the line from the level before.  ``*_censored``: ``inside`` (between ``*_from`` and
    ``*_to``), ``left`` (already past half at the mildest level: the value extrapolates),
    ``right`` (never reached: the last level stands for a bound; only where a scale wider than
    the curve is given), ``none`` (a flat curve has no half).  ``leads`` compares half levels by
    severity, so the higher one of a falling factor comes first; ``by_number`` compares the bare
    numbers.  ``lexical_scale`` scales errors by fixed ends rather than by their own range.
    """
    whole = Window.partitionBy(*keys)
    by = whole.orderBy("_s")
    x = points.withColumn("_s", _severity(falling)).withColumn("_l", F.lag("level").over(by))
    for c in ("drift", "wer"):
        low, high = F.min(c).over(whole), F.max(c).over(whole)
        if c == "wer" and lexical_scale:
            low, high = F.lit(float(lexical_scale[0])), F.lit(float(lexical_scale[1]))
        x = x.withColumn(f"_{c}", F.coalesce(F.try_divide(F.col(c) - low, high - low), F.lit(0.0))).withColumn(f"_p{c}", F.lag(f"_{c}").over(by))
        x = with_average_rank(x, keys, c, f"_r{c}")
    step = F.col("drift") - F.lag("drift").over(by)
    x = x.withColumn("_step", F.when(F.abs(step) > _STILL, F.signum(step)))
    x = x.withColumn("_turn", F.col("_step") != F.last("_step", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1))).withColumn("_place", F.row_number().over(by))
    facts = [
        F.count("*").alias("n_levels"), correlation(F.col("_rdrift"), F.col("_rwer"), 3).alias("spearman"), F.max(F.abs(F.col("_drift") - F.col("_wer"))).alias("max_gap"),
        correlation(F.col("_place"), F.col("_rdrift"), 3).alias("trend"), F.count_if("_turn").alias("n_sign_flips"),
    ]
    for c, name in (("drift", "feature"), ("wer", "lexical")):
        there = F.col(f"_p{c}").isNotNull() & (F.col(f"_{c}") >= 0.5)
        line = F.col("_l") + F.try_divide((0.5 - F.col(f"_p{c}")) * (F.col("level") - F.col("_l")), F.col(f"_{c}") - F.col(f"_p{c}"))
        first = lambda v: F.min_by(F.when(there, v), F.when(there, F.col("_s")))  # noqa: B023, E731
        facts += [
            (F.max(c) - F.min(c)).alias(f"{name}_range"), F.coalesce(first(F.coalesce(line, F.col("level").cast("double"))), F.max_by("level", "_s").cast("double")).alias(f"{name}_half"),
            F.when(F.max(c) <= F.min(c), "none").when(F.min_by(f"_{c}", "_s") >= 0.5, "left").when(F.max(f"_{c}") < 0.5, "right").otherwise("inside").alias(f"{name}_censored"),
            *[v.cast("double").alias(f"_{name}{k}") for k, v in enumerate((first(F.col("_l")), first(F.col("level")), F.min_by("level", "_s"), F.max_by("level", "_s")))],
        ]
    out = x.groupBy(*keys).agg(*facts)
    for name in ("feature", "lexical"):
        where, at = F.col(f"{name}_censored"), lambda k: F.col(f"_{name}{k}")  # noqa: B023, E731
        out = out.withColumn(f"{name}_from", F.when(where == "inside", at(0)).when(where == "right", at(3)))
        out = out.withColumn(f"{name}_to", F.when(where == "inside", at(1)).when(where == "left", at(2)))
    sign = F.lit(1.0) if by_number else F.when(F.col("factor").isin(*falling), -1.0).otherwise(1.0)
    f, w = sign * F.col("feature_half"), sign * F.col("lexical_half")
    out = out.withColumn("coupled", F.col("max_gap") <= gap).withColumn("leads", F.when(F.abs(f - w) <= SAME, "together").when(f < w, "feature").otherwise("lexical"))
    return out.withColumn("monotone", (F.col("n_levels") >= 3) & (F.col("n_sign_flips") == 0)).drop(*[f"_{n}{k}" for n in ("feature", "lexical") for k in range(4)])


def votes(clips: DataFrame, least: float = LEXICAL_RANGE) -> DataFrame:
    """The clips' say by (factor, feature).  A clip whose error hardly moves has no curve to
    race against and no vote; it is counted in ``n_flat``.  ``top_lead`` is what most voters
    say (ties: by name), ``agreement`` their share (0 without voters); spreads of the half
    levels are over all clips."""
    vote = F.when(F.col("lexical_range") >= least, F.col("leads"))
    say = {k: F.count_if(vote == k) for k in ("feature", "lexical", "together")}
    spread = [f(f"{c}_half").alias(f"{c}_half_{n}") for c in ("feature", "lexical") for n, f in (("mean", F.avg), ("sd", F.stddev_samp), ("min", F.min), ("max", F.max))]
    out = clips.groupBy(*SWEEP).agg(F.count("*").alias("n_clips"), F.count_if(vote.isNull()).alias("n_flat"), *[n.alias(f"n_{k}") for k, n in say.items()], *spread)
    most = F.greatest(*[F.col(f"n_{k}") for k in say])
    top = F.coalesce(*[F.when((F.col(f"n_{k}") == most) & (most > 0), k) for k in say])
    return out.withColumn("top_lead", top).withColumn("agreement", F.coalesce(F.try_divide(most, F.col("n_clips") - F.col("n_flat")), F.lit(0.0)))


def feature_verdicts(points: DataFrame, *, falling: Collection[str] = FALLING, by_number: bool = False, gap: float = GAP, least: float = LEXICAL_RANGE, trend: float = TREND, quorum: float = QUORUM, lexical_scale: tuple[float, float] | None = None) -> DataFrame:
    """One row a (factor, feature): facts of the mean curves, the clips' votes, and what may
    be said.  ``lexical_floor``: the mean error moves less than ``least``; ``reliable``: the
    drift follows severity; ``quotable``: both half levels can be read; ``stable``: enough
    voters agree with the mean curves.  An empty table gives an empty one; other columns of
    ``points`` are left out."""
    how = {"falling": falling, "by_number": by_number, "gap": gap, "lexical_scale": lexical_scale}
    points = require_sweep(points.select(*SWEEP, "clip_id", "level", "wer", "drift"))
    mean = points.groupBy(*SWEEP, "level").agg(*[F.round(F.avg(c), 12).alias(c) for c in ("wer", "drift")])  # equal means tie in any order
    out = curve_facts(mean, list(SWEEP), **how).join(votes(curve_facts(points, [*SWEEP, "clip_id"], **how), least), list(SWEEP))
    out = out.withColumn("lexical_floor", F.col("lexical_range") < least).withColumn("reliable", F.coalesce(F.col("trend") >= trend, F.lit(False)))
    legible = lambda c: F.col(c).isin("inside", "right")
    out = out.withColumn("quotable", F.col("reliable") & ~F.col("lexical_floor") & legible("feature_censored") & legible("lexical_censored"))
    agreed = (F.col("agreement") >= quorum) & F.coalesce(F.col("top_lead") == F.col("leads"), F.lit(False))
    return out.withColumn("stable", agreed & F.col("reliable") & ~F.col("lexical_floor"))


def sweep_verdicts(features: DataFrame) -> DataFrame:
    """One row a factor from its ``feature_verdicts``: the feature to quote, what leads, and
    the verdict.

    An error on its floor can't be raced: then reliable features make it ``feature``, else
    ``neither``, and the cleanest trend is quoted.  Otherwise stable features vote, and the
    widest separation on the winning side is quoted.  Without a stable one, legible features
    come first, then those that trend, and the cleanest trend of them is quoted; without
    either the lead is ``undetermined``.  Ties go to the first name.
    """
    clean = F.coalesce("trend", F.lit(-2.0))
    tier = F.when(F.col("quotable"), 2).when(F.col("reliable"), 1).otherwise(0)
    any_of = lambda c: F.max(F.col(c)).over(Window.partitionBy("factor"))
    x = features.withColumn("_tier", tier).withColumn("_stable", any_of("stable")).withColumn("_best", any_of("_tier"))
    x = x.withColumn("_in", F.when(F.col("lexical_floor"), F.lit(False)).when(F.col("_stable"), F.col("stable")).otherwise((F.col("_tier") == F.col("_best")) & (F.col("_best") > 0)))
    cast = x.where("_in").groupBy("factor", F.col("leads").alias("_won")).agg(F.count("*").alias("_n"))
    won = cast.groupBy("factor").agg(F.min_by("_won", F.struct(-F.col("_n"), "_won")).alias("_won"))
    x = x.join(won, "factor", "left")
    settled = F.col("_stable") & ~F.col("lexical_floor")
    ours = F.when(F.col("lexical_floor"), F.col("reliable").cast("int")).when(settled, (F.col("stable") & (F.col("leads") == F.col("_won"))).cast("int")).otherwise(F.col("_tier"))
    merit = F.when(settled, F.abs(F.col("feature_half") - F.col("lexical_half"))).otherwise(clean)
    order = F.struct(-ours, -merit, F.col("feature"))
    lead = F.when(F.col("lexical_floor"), F.when(any_of("reliable"), "feature").otherwise("neither")).otherwise(F.coalesce("_won", F.lit("undetermined")))
    x = x.withColumn("_lead", lead)
    quoted = lambda c: F.min_by(c, order)
    out = x.groupBy("factor").agg(
        quoted("feature").alias("primary_feature"), F.first("_lead").alias("factor_leads"), F.count("*").alias("n_features"), F.count_if(~F.col("coupled")).alias("n_decoupled"), F.count_if("reliable").alias("n_reliable"),
        F.count_if(F.when(F.col("lexical_floor"), F.col("reliable")).otherwise(F.col("stable"))).alias("n_stable"), F.first("lexical_floor").alias("lexical_floor"), quoted("quotable").alias("quotable"), quoted("coupled").alias("coupled"),
        quoted("feature_half").alias("feature_half"), quoted("lexical_half").alias("lexical_half"),
    )
    verdict = F.when(F.col("lexical_floor"), "lexical_floor").when(~F.col("quotable"), "no_threshold").when(F.col("coupled"), "coupled").otherwise("decoupled")
    return out.withColumn("verdict", verdict)


def sentence(falling: Collection[str] = FALLING) -> Column:
    """What a row of ``feature_verdicts`` says, in words; no number that can't be read."""
    falls = F.col("factor").isin(*falling)
    under = F.concat(F.lit("under "), F.when(falls, "falling ").otherwise("rising "), "factor", F.lit(", "))
    halves = F.format_string("%s reaches half at %.2f, the error at %.2f", "feature", "feature_half", "lexical_half")
    why = F.array_join(F.array_compact(F.array(
        F.when(~F.col("reliable"), "its drift doesn't follow severity"), F.when(F.col("feature_censored") == "left", "it starts past half"), F.when(F.col("feature_censored") == "none", "it is flat"),
        F.when(F.col("lexical_censored") == "left", "the error starts past half"),
    )), ", ")
    says = F.when(F.col("lexical_floor") & F.col("reliable"), F.format_string("the error stays on its floor while %s drifts", "feature"))
    says = says.when(F.col("lexical_floor"), F.format_string("neither the error nor %s degrades measurably", "feature"))
    says = says.when(~F.col("quotable"), F.concat(F.format_string("no half level of %s can be quoted: ", "feature"), why))
    says = says.when(F.col("coupled"), F.concat(halves, F.lit(": they degrade together")))
    return F.concat(under, says.otherwise(F.concat(halves, F.lit(": "), F.when(F.col("leads") == "together", "apart in shape only").otherwise(F.concat("leads", F.lit(" leads"))))))
