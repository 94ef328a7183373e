"""The measurement table: its frozen schema, its missing values, its errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Column order is part of the contract (fixed values).
MEASUREMENT_DDL = (
    "clip_id string, condition_name string, rt60 double, snr_db double, noise_type string, codec string, mic_rolloff double, model string, "
    "transcript string, wer double, n_ref int, n_sub int, n_del int, n_ins int, n_match int, mean_conf double, utterance_conf double, "
    "word_confidences array<double>, edits array<struct<op:string,ref:string,hyp:string>>, rir_key string, rir_rt60_measured double, "
    "noise_key string, failed boolean, error string, run_id string, ts timestamp"
)
COLUMNS = [part.strip().split(" ", 1)[0] for part in MEASUREMENT_DDL.replace("array<struct<op:string,ref:string,hyp:string>>", "array").split(",")]
FACTORS = ("rt60", "snr_db", "noise_type", "codec", "mic_rolloff")
CELL = ("clip_id", "condition_name", "model")
#: Thresholds that define meaning (fixed values).
WER_HI, CONF_PCT_HI, MAX_LOGIT_CLIP, ECE_BINS, REGION_BINS = 0.30, 0.60, 1e-6, 15, 4


class MeasurementError(ValueError):
    """A refusal: the data would give a plausible wrong number."""


class DuplicateCellError(MeasurementError):
    """More than one row for a cell."""


class NonFiniteError(MeasurementError):
    """A value that a comparison would silently turn into False."""


class ArmPoolingError(MeasurementError):
    """Confidence of several models pooled."""


class DegenerateLabelError(MeasurementError):
    """Only one class of labels."""


class RaggedArmsError(MeasurementError):
    """Models that are unknown, empty, or don't cover the same cells."""


class ThinOverlapError(MeasurementError):
    """Too few clips that all models ran."""


class ClipSetMismatchError(MeasurementError):
    """Too few clips that two runs share."""


class WerIncomparableArmError(MeasurementError):
    """Fewer than two models whose error rates may be ranked together."""


class IncompleteDesignError(MeasurementError):
    """A factorial block with a missing or repeated cell."""


class NormalizerUnavailableError(MeasurementError):
    """Text of a language that numbers can't be normalized in."""


class ConfidenceAlignmentError(MeasurementError):
    """Confidences that can't be carried to the normalized tokens."""


class SchemaDriftError(MeasurementError):
    """Columns that differ from the frozen schema."""


class InsufficientSeedsError(MeasurementError):
    """Fewer than three distinct seeds."""


class MissingAssetError(MeasurementError):
    """An asset is missing; none is put in its place."""


class PayloadError(MeasurementError):
    """A recognizer's answer that breaks its contract."""


def clean_double(column: Column) -> Column:
    """NaN and infinities become NULL: Spark's aggregates skip NULL but carry NaN on."""
    return F.when(F.isnan(column) | (F.abs(column) == float("inf")), None).otherwise(column)


def as_double(text: Column) -> Column:
    """Tolerant number: blank, 'none', 'nan' and unreadable text are NULL, never 0."""
    t = F.lower(F.trim(text))
    return clean_double(F.when(t.isin("", "none", "null", "nan"), None).otherwise(t).try_cast("double"))


def as_int(text: Column) -> Column:
    """Tolerant count: what is missing counts as 0."""
    return F.coalesce(as_double(text).cast("long"), F.lit(0)).cast("int")


def as_bool(text: Column) -> Column:
    """true, t, yes, y and 1 in any case are true, anything else false."""
    return F.coalesce(F.lower(F.trim(text)).isin("true", "t", "yes", "y", "1"), F.lit(False))


def coerce(raw: DataFrame) -> DataFrame:
    """A table of text columns, as a CSV gives it, to the frozen schema.  Missing columns
    raise; extra ones are dropped."""
    if missing := sorted(set(COLUMNS) - set(raw.columns)):
        raise SchemaDriftError(f"columns missing: {', '.join(missing)}")
    text = {c: F.col(c).cast("string") for c in COLUMNS}
    out = []
    for c in COLUMNS:
        if c in ("n_ref", "n_sub", "n_del", "n_ins", "n_match"):
            x = as_int(text[c])
        elif c in ("rt60", "snr_db", "mic_rolloff", "wer", "mean_conf", "utterance_conf", "rir_rt60_measured"):
            x = as_double(text[c])
        elif c == "failed":
            x = as_bool(text[c])
        elif c == "word_confidences":
            x = F.from_json(text[c], "array<double>")
        elif c == "edits":
            parts = F.from_json(text[c], "array<array<string>>")
            x = F.transform(parts, lambda e: F.struct(e[0].alias("op"), e[1].alias("ref"), e[2].alias("hyp")))
        elif c == "ts":
            x = text[c].try_cast("timestamp")
        elif c == "transcript":
            x = text[c]
        else:
            x = F.nullif(F.trim(text[c]), F.lit(""))
        out.append(x.alias(c))
    return raw.select(*out)


def ordered(rows: DataFrame) -> DataFrame:
    """The frozen columns in order; any drift raises."""
    if drift := sorted(set(COLUMNS) ^ set(rows.columns)):
        raise SchemaDriftError(f"columns differ: {', '.join(drift)}")
    return rows.select(*COLUMNS)


def is_failed() -> Column:
    """A failed measurement: flagged, or without a transcript ('' is silence, not failure)."""
    return F.coalesce(F.col("failed"), F.lit(False)) | F.col("transcript").isNull()


def n_hyp() -> Column:
    """Scorable words of the hypothesis, from the counts and never from confidences."""
    return F.col("n_ref") - F.col("n_del") + F.col("n_ins")


def is_silent() -> Column:
    return n_hyp() <= 0


def spoke() -> Column:
    return F.col("mean_conf").isNotNull()


def usable(rows: DataFrame) -> DataFrame:
    """Rows that may be averaged."""
    return rows.where(~is_failed())
