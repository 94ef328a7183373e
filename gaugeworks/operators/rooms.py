"""Delivered rooms and coordinates, simulated and measured rows, grids and clip sets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks import schema as S
from gaugeworks.functions.numeric import condition_name

#: What marks a simulated room in its key, and in a condition's name.
SIM_MARKERS = ("rirs_sim", "/sim_", "sim_rt60")
SIM_SUFFIX = "_sim"

#: The blocks of the two grids.
MAIN_GRID = (
    {"rt60": (0.2, 0.45, 0.7, 1.0), "snr_db": (0.0, 10.0, 20.0), "noise_type": ("babble", "engine", "road"), "codec": ("none",), "mic_rolloff": (0.0,)},
    *(
        {"rt60": (rt60,), "snr_db": (snr,), "noise_type": ("babble",), "codec": ("none", "g726", "opus-lowrate"), "mic_rolloff": (0.0, 0.5, 1.0)}
        for rt60, snr in ((0.2, 20.0), (0.45, 10.0), (1.0, 0.0))
    ),
)
INTERACTION_GRID = (
    {"rt60": (0.2, 0.45, 0.7, 1.0), "snr_db": (0.0, 5.0, 10.0, 20.0), "noise_type": ("babble",), "codec": ("none", "g726", "opus-lowrate"), "mic_rolloff": (0.0, 0.5, 1.0)},
    {"rt60": (0.45, 1.0), "snr_db": (0.0, 10.0), "noise_type": ("engine", "road"), "codec": ("none", "g726"), "mic_rolloff": (0.0, 1.0)},
)


def is_simulated() -> Column:
    """Whether a row's room was simulated; a row without a key or a name is measured."""
    key, name = F.coalesce("rir_key", F.lit("")), F.coalesce("condition_name", F.lit(""))
    return reduce(lambda a, b: a | b, [F.contains(key, F.lit(m)) for m in SIM_MARKERS], F.endswith(name, F.lit(SIM_SUFFIX)))


def split_simulated(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(measured, simulated) rows: each row is in one of them."""
    return rows.where(~is_simulated()), rows.where(is_simulated())


def delivered_rooms(rows: DataFrame, acoustics: DataFrame | None = None) -> DataFrame:
    """One row for each model and room that was delivered: the reverberations asked for, the
    measured one, the mean error of its usable rows (NULL if all failed) and their number.
    ``acoustics`` (rir_key, ...) adds what is known of a room.  Rows without a key are left out."""
    ok = ~S.is_failed() & F.col("wer").isNotNull()
    out = rows.where("rir_key is not null").groupBy("model", "rir_key").agg(
        F.array_sort(F.collect_set(F.round("rt60", 6))).alias("rt60_requested"), F.max("rir_rt60_measured").alias("rt60_measured"),
        F.avg(F.when(ok, F.col("wer"))).alias("marginal_wer"), F.count_if(ok).alias("n_rows"),
    )
    return out.join(acoustics, "rir_key", "left") if acoustics is not None else out


def remap(rows: DataFrame, coordinate: DataFrame, name: str) -> DataFrame:
    """Rows with the coordinate (rir_key, value) of the room they were delivered in, as
    column ``name``.  A room without a coordinate raises, as does a repeated one: a lost
    room would shrink the axis and still give a number."""
    if coordinate.groupBy("rir_key").count().where("count > 1").limit(1).collect():
        raise S.DuplicateCellError("a room has several coordinates")
    at = coordinate.where("value is not null and rir_key is not null").select("rir_key", F.col("value").cast("double").alias(name))
    if lost := rows.join(at, "rir_key", "left_anti").select("rir_key").distinct().limit(5).collect():
        raise S.MissingAssetError(f"{name} has no value for rooms {sorted(str(r.rir_key) for r in lost)}")
    return rows.drop(name).join(at, "rir_key")


def grid(spark: SparkSession, blocks: Sequence[Mapping[str, Sequence]]) -> DataFrame:
    """The conditions of all blocks, each with its name and once: a block is all
    combinations of its levels."""
    out = spark.createDataFrame([], "rt60 double, snr_db double, noise_type string, codec string, mic_rolloff double")
    for block in blocks:
        x = spark.range(1)
        for f in S.FACTORS:
            x = x.withColumn(f, F.explode(F.array(*map(F.lit, block[f]))))
        out = out.unionByName(x.select(*S.FACTORS))
    return out.distinct().select(condition_name().alias("condition_name"), *S.FACTORS)


def select_clips(manifest: DataFrame, wanted: str, named: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """The manifest's rows for ``all``, a named set, or ids joined by commas.  Ids that the
    manifest lacks raise."""
    if wanted == "all":
        return manifest
    ids = sorted({i.strip() for i in (named or {}).get(wanted, wanted.split(",")) if i.strip()})
    found = manifest.where(F.col("id").isin(ids))
    have = {r[0] for r in found.select("id").distinct().collect()}  # no more than were asked for
    if lost := sorted(set(ids) - have):
        raise S.MissingAssetError(f"not in the manifest: {', '.join(lost)}")
    return found


def scorecard(pairs: DataFrame, calls: DataFrame, predicted: str) -> DataFrame:
    """A sealed prediction against recorded calls, as one row.  ``pairs``: (clip_id, named),
    ``calls``: (clip_id, session, harder_arm, non_marginal), of which the latest session of a
    clip counts.  A pair that was named fails unless its call has the predicted arm and isn't
    marginal; the direction holds if every call does."""
    last = calls.groupBy("clip_id").agg(F.max_by(F.struct("harder_arm", "non_marginal"), "session").alias("_c"))
    x = pairs.join(last, "clip_id", "left").select("named", F.col("_c.harder_arm").alias("arm"), F.coalesce("_c.non_marginal", F.lit(False)).alias("clear"))
    hit = F.coalesce(F.col("arm") == predicted, F.lit(False))
    out = x.agg(F.count("*").alias("n_pairs"), F.count("arm").alias("n_scored"), F.count_if(hit).alias("n_direction_hit"), F.count_if("named").alias("n_named"), F.count_if(F.col("named") & ~(hit & F.col("clear"))).alias("n_strict_failures"))
    return out.withColumn("held", (F.col("n_scored") > 0) & (F.col("n_scored") == F.col("n_direction_hit")))
