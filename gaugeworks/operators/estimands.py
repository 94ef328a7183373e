"""Condition-level estimands: one hash aggregate over the measurements.

Confidence is only ever paired with the error of the rows that spoke; failed rows are
counted beside the averages and never enter them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks import schema as S
from gaugeworks.operators.ranking import with_percentile


def _errors() -> Column:
    return F.col("n_sub") + F.col("n_del") + F.col("n_ins")


def condition_table(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row per model and condition: macro and micro WER over all clips and over
    those that spoke, confidence, silence, failures.  A condition whose rows all failed
    has none."""
    keys = keys or ["model", "condition_name"]
    ok = ~S.is_failed()
    said = ok & S.spoke()
    factors = [f for f in S.FACTORS if f in rows.columns and f not in keys]
    when = lambda c, x: F.when(c, x)
    out = rows.groupBy(*keys).agg(
        F.count_if(ok).alias("n_clips"), F.count_if(~ok).alias("n_failed_excluded"), F.sum(when(ok, F.col("n_ref"))).alias("n_ref_total"),
        F.avg(when(ok, F.col("wer"))).alias("wer"), F.try_divide(F.sum(when(ok, _errors())).cast("double"), F.sum(when(ok, F.col("n_ref")))).alias("wer_micro"),
        F.count_if(ok & S.is_silent()).alias("n_silent"), F.count_if(said & S.is_silent()).alias("n_conf_without_words"),
        F.count_if(said).alias("n_spoke"), F.avg(when(said, F.col("mean_conf"))).alias("mean_conf"), F.avg(when(said, F.col("wer"))).alias("wer_spoke"),
        F.try_divide(F.sum(when(said, _errors())).cast("double"), F.sum(when(said, F.col("n_ref")))).alias("wer_micro_spoke"),
        *[F.min(f).alias(f) for f in factors],
    )
    return out.where("n_clips > 0").withColumn("silent_frac", F.col("n_silent") / F.col("n_clips"))


def failure_summary(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Failures by key, with the conditions that failed altogether."""
    keys = keys or ["model"]
    by = rows.groupBy(*keys, "condition_name").agg(F.count("*").alias("n"), F.count_if(S.is_failed()).alias("bad"))
    return by.groupBy(*keys).agg(
        F.sum("n").alias("n_rows"), F.sum("bad").alias("n_failed"), F.count_if(F.col("bad") > 0).alias("n_conditions_hit"), F.count_if(F.col("bad") == F.col("n")).alias("n_fully_failed"),
    ).withColumn("failed_frac", F.col("n_failed") / F.col("n_rows"))


def silence_summary(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Silent rows by key, with the conditions that were silent altogether."""
    keys = keys or ["model"]
    by = S.usable(rows).groupBy(*keys, "condition_name").agg(F.count("*").alias("n"), F.count_if(S.is_silent()).alias("silent"), F.count_if(S.spoke()).alias("spoke"))
    return by.groupBy(*keys).agg(
        F.sum("n").alias("n_rows"), F.sum("silent").alias("n_silent"), F.count_if(F.col("silent") > 0).alias("n_conditions_hit"), F.count_if(F.col("silent") == F.col("n")).alias("n_fully_silent"), F.count_if(F.col("spoke") == 0).alias("n_mute"),
    ).withColumn("silent_frac", F.col("n_silent") / F.col("n_rows"))


def add_gap_metrics(table: DataFrame) -> DataFrame:
    """Confidence minus delivered accuracy, for both pairings, and their percentiles.
    Accuracy is clipped to 0..1 for the gap, not for the rank."""
    out = with_percentile(table, ["model"], "mean_conf", "conf_pct")
    out = out.withColumn("_acc", 1 - F.col("wer_spoke")).withColumn("_acc_all", 1 - F.col("wer"))
    out = with_percentile(with_percentile(out, ["model"], "_acc", "acc_pct"), ["model"], "_acc_all", "acc_pct_all_clips")
    clip = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    spoke = F.col("mean_conf").isNotNull()
    return out.select(
        *table.columns, "conf_pct", "acc_pct", "acc_pct_all_clips",
        F.when(F.col("wer_spoke").isNotNull(), F.col("mean_conf") - clip(F.col("_acc"))).alias("gap"), F.when(F.col("wer").isNotNull(), F.col("mean_conf") - clip(F.col("_acc_all"))).alias("gap_all_clips"),
        F.when(spoke, F.col("conf_pct") - F.col("acc_pct")).alias("gap_pct"),
    ).withColumn("gap_inflation", F.col("gap_all_clips") - F.col("gap"))


def distribution(rows: DataFrame, keys: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """Count, mean, sample deviation (0 for one row), quantiles and the positive share."""
    x = F.col(value)
    return rows.where(x.isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(x).alias("mean"), F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("sd"), *[F.percentile(x, F.lit(q)).alias(name) for name, q in quantiles.items()], F.avg((x > 0).cast("int")).alias("frac_positive"),
    )


def with_region(table: DataFrame, space: dict[str, tuple[float, float] | None], bins: int = S.REGION_BINS) -> DataFrame:
    """One row per condition and factor: ``factor`` and ``region``, a bin of equal width
    over the declared range (the last one closed) or the level of a categorical factor.
    Values outside the range are in no bin, and factors with fewer than two populated
    regions are left out."""
    parts = []
    for name, span in space.items():
        if span is None:
            region = F.col(name).cast("string")
        else:
            low, high = span
            step = F.floor((F.col(name) - low) / F.lit((high - low) / bins) + 1e-12).cast("int")
            region = F.when((F.col(name) >= low) & (F.col(name) <= high), F.least(step, F.lit(bins - 1)).cast("string"))
        parts.append(F.struct(F.lit(name).alias("factor"), region.alias("region")))
    out = table.withColumn("_r", F.explode(F.array(*parts))).select(*table.columns, "_r.factor", "_r.region").where("region is not null")
    wide = out.groupBy("factor").agg(F.count_distinct("region").alias("_n")).where("_n > 1").select("factor")
    return out.join(F.broadcast(wide), "factor", "left_semi")  # at most one row a factor


def condition_matrix(rows: DataFrame, value: str = "wer") -> DataFrame:
    """Mean error by the delivered factors: the measured reverberation where it is known,
    numbers to six decimals."""
    reverb = F.coalesce("rir_rt60_measured", "rt60") if "rir_rt60_measured" in rows.columns else F.col("rt60")
    keys = [F.round(reverb, 6).alias("rt60"), F.round("snr_db", 6).alias("snr_db"), "noise_type", "codec", F.round("mic_rolloff", 6).alias("mic_rolloff")]
    return S.usable(rows).groupBy("model", *keys).agg(F.count("*").alias("n"), F.avg(value).alias("y"))


def first_seen(rows: DataFrame, key: str, sequence: str) -> DataFrame:
    """One row for each key, the earliest, in order of first appearance."""
    first = rows.groupBy(key).agg(F.min_by(F.struct(*rows.columns), sequence).alias("_r"))
    return first.select("_r.*").orderBy(sequence)
