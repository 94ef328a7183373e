"""What a recording or a manifest must be before it is scored: rules as columns.

A table of clips has one row a clip: (clip_id, fs, channels, subtype, duration_s, peak,
n_near_clip, lead_s, tail_s, snr_db), as ``functions.signal`` measures them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions import text

#: What a clip may be.
RATES = (16000, 48000)
SUBTYPES = ("PCM_16", "PCM_24", "PCM_32", "FLOAT", "DOUBLE")
PEAK_MOST, NEAR_MOST = 0.99, 10
PEAK_DBFS, PEAK_SPREAD_DB = (-14.0, -4.0), 6.0
PAD_S, DURATION_S, DURATION_FACTOR = 0.25, (1.5, 12.0), 2.0
SNR_DB = 20.0


def _named(rules: dict[str, Column]) -> Column:
    """The names of the rules that are broken; a rule of a missing value isn't."""
    return F.filter(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules.items()]), lambda x: x.isNotNull())


def peak_dbfs(peak: Column) -> Column:
    return 20 * F.log10(peak + 1e-12)


def clip_faults(clips: DataFrame) -> DataFrame:
    """Clips with ``errors`` and ``warnings``, lists of rules that they break by themselves."""
    c, peak = F.col, peak_dbfs(F.col("peak"))
    errors = {
        "channels": c("channels") != 1, "sample_rate": ~c("fs").isin(*RATES), "subtype": ~c("subtype").isin(*SUBTYPES),
        "clipped": c("peak") >= PEAK_MOST, "near_clipping": (c("peak") < PEAK_MOST) & (c("n_near_clip") > NEAR_MOST),
        "lead": c("lead_s") < PAD_S, "tail": c("tail_s") < PAD_S, "duration": ~c("duration_s").between(*DURATION_S),
    }
    return clips.withColumn("errors", _named(errors)).withColumn("warnings", _named({"peak": ~peak.between(*PEAK_DBFS), "snr": c("snr_db") < SNR_DB}))


def corpus_faults(clips: DataFrame) -> DataFrame:
    """Clips that stand apart from the whole set, with ``warnings``: a peak far from the
    median one, a duration of more than twice the median."""
    middle = clips.agg(F.median(peak_dbfs(F.col("peak"))).alias("_peak"), F.median("duration_s").alias("_duration"))
    x = clips.join(F.broadcast(middle))  # one row
    out = _named({"level_drift": F.abs(peak_dbfs(F.col("peak")) - F.col("_peak")) > PEAK_SPREAD_DB, "long": F.col("duration_s") > DURATION_FACTOR * F.col("_duration")})
    return x.withColumn("warnings", out).drop("_peak", "_duration").where(F.size("warnings") > 0)


def sample_rates(clips: DataFrame) -> DataFrame:
    """The sample rates of a set, as one row; more than one is an error."""
    return clips.agg(F.array_sort(F.collect_set("fs")).alias("rates")).withColumn("mixed", F.size("rates") > 1)


def manifest_faults(manifest: DataFrame, id_col: str = "id", text_col: str = "ground_truth") -> DataFrame:
    """(id, n_rows, n_unstable): ids that occur more than once, or whose text isn't what
    normalizing makes of it, so that it would be scored as another text than the one read."""
    stable = F.array_join(text.normalize(F.col(text_col)), " ").eqNullSafe(F.coalesce(text_col, F.lit("")))
    out = manifest.groupBy(id_col).agg(F.count("*").alias("n_rows"), F.count_if(~stable).alias("n_unstable"))
    return out.where("n_rows > 1 or n_unstable > 0")
