"""Dead zones: conditions that are wrong and confident on the clips they spoke."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks import schema as S
from gaugeworks.operators.estimands import add_gap_metrics

#: The grid of the threshold sweep (fixed values).
WER_GRID = [0.10, 0.15, 0.20, 0.25, 0.30, 0.35, 0.40, 0.45, 0.50]
CONF_GRID = [0.30, 0.40, 0.50, 0.60, 0.70, 0.80, 0.90]


def flag(wer: str, wer_hi: float | Column = S.WER_HI, conf_pct_hi: float | Column = S.CONF_PCT_HI) -> Column:
    """Wrong and confident; a mute condition is neither."""
    hit = (F.col(wer) >= wer_hi) & (F.col("conf_pct") >= conf_pct_hi)
    return F.coalesce(F.when(F.col("mean_conf").isNull(), F.lit(False)).otherwise(hit), F.lit(False))


def classify(table: DataFrame, wer_hi: float = S.WER_HI, conf_pct_hi: float = S.CONF_PCT_HI) -> DataFrame:
    """Every condition in exactly one category: mute, dead zone, silence-driven or ok."""
    rows = table if "conf_pct" in table.columns else add_gap_metrics(table)
    rows = rows.withColumn("dead_zone", flag("wer_spoke", wer_hi, conf_pct_hi)).withColumn("dead_zone_all_clips", flag("wer", wer_hi, conf_pct_hi))
    category = F.when(F.col("mean_conf").isNull(), "mute_zone").when(F.col("dead_zone"), "dead_zone").when(F.col("dead_zone_all_clips"), "silence_driven").otherwise("ok")
    return rows.withColumn("category", category)


def dead_zones(table: DataFrame, **thresholds: float) -> DataFrame:
    """The ranked deliverable: by gap within each model."""
    found = classify(table, **thresholds).where("category = 'dead_zone'")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("model").orderBy(F.col("gap").desc_nulls_last(), "condition_name")))


def raw_conf_threshold(table: DataFrame, conf_pct_hi: float = S.CONF_PCT_HI) -> DataFrame:
    """The raw confidence at the percentile cut, by model."""
    rows = table if "conf_pct" in table.columns else add_gap_metrics(table)
    return rows.groupBy("model").agg(F.min(F.when((F.col("conf_pct") >= conf_pct_hi) & F.col("mean_conf").isNotNull(), F.col("mean_conf"))).alias("raw_conf"))


def sweep(table: DataFrame, wer_grid: list[float] | None = None, conf_grid: list[float] | None = None) -> DataFrame:
    """Each condition at each point of the grid, with its flag; percentiles are computed
    once over the arm, never for a threshold."""
    rows = table if "conf_pct" in table.columns else add_gap_metrics(table)
    grid = [(w, c) for w in wer_grid or WER_GRID for c in conf_grid or CONF_GRID]
    points = F.explode(F.array(*[F.struct(F.lit(w).alias("wer_hi"), F.lit(c).alias("conf_pct_hi")) for w, c in grid]))
    rows = rows.withColumn("_p", points).select("model", "condition_name", "mean_conf", "wer_spoke", "conf_pct", "_p.*")
    return rows.withColumn("flagged", flag("wer_spoke", F.col("wer_hi"), F.col("conf_pct_hi")))


def sweep_counts(swept: DataFrame) -> DataFrame:
    return swept.groupBy("model", "wer_hi", "conf_pct_hi").agg(F.count_if("flagged").alias("n_dead_zones"))


def placed(table: DataFrame, wer_grid: list[float] | None, conf_grid: list[float] | None) -> tuple[DataFrame, list[float], list[float]]:
    """Each condition with the number of thresholds of either grid that flag it: it is flagged
    at the points of a rectangle from the mildest on."""
    wers, confs = sorted(wer_grid or WER_GRID), sorted(conf_grid or CONF_GRID)
    rows = table if "conf_pct" in table.columns else add_gap_metrics(table)
    spoke = F.col("mean_conf").isNotNull() & F.col("wer_spoke").isNotNull() & F.col("conf_pct").isNotNull()
    reached = lambda c, grid: F.when(spoke, F.size(F.filter(F.array(*map(F.lit, grid)), lambda t: F.col(c) >= t))).otherwise(0)
    return rows.select("model", "condition_name", reached("wer_spoke", wers).alias("n_wer"), reached("conf_pct", confs).alias("n_conf")), wers, confs


def grid_counts(table: DataFrame, wer_grid: list[float] | None = None, conf_grid: list[float] | None = None) -> DataFrame:
    """``sweep_counts`` of the whole grid without a row for each condition and point: a
    histogram of the conditions' rectangles by corner, summed up from its far end along both
    axes.  A model has a row for each point of the grid."""
    rows, wers, confs = placed(table, wer_grid, conf_grid)
    corners = rows.groupBy("model", "n_wer", "n_conf").agg(F.count("*").alias("n"))
    axis = lambda grid, name: F.posexplode(F.array(*map(F.lit, grid))).alias(f"_{name}", name)
    points = corners.select("model").distinct().select("model", axis(wers, "wer_hi")).select("*", axis(confs, "conf_pct_hi"))
    filled = points.join(corners.select("model", (F.col("n_wer") - 1).alias("_wer_hi"), (F.col("n_conf") - 1).alias("_conf_pct_hi"), "n"), ["model", "_wer_hi", "_conf_pct_hi"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    for along, other in (("_conf_pct_hi", "_wer_hi"), ("_wer_hi", "_conf_pct_hi")):  # a line of the grid is a window
        filled = filled.withColumn("n", F.sum("n").over(Window.partitionBy("model", other).orderBy(F.desc(along)).rowsBetween(Window.unboundedPreceding, 0)))
    return filled.select("model", "wer_hi", "conf_pct_hi", F.col("n").alias("n_dead_zones"))


def grid_persistence(table: DataFrame, wer_grid: list[float] | None = None, conf_grid: list[float] | None = None) -> DataFrame:
    """``persistence`` from the size of each condition's rectangle."""
    rows, wers, confs = placed(table, wer_grid, conf_grid)
    n = (F.col("n_wer") * F.col("n_conf")).cast("long")
    return rows.where("n_wer > 0 and n_conf > 0").select("model", "condition_name", (n / F.lit(len(wers) * len(confs))).alias("persistence"), n.alias("n_points"))


def require_monotone(counts: DataFrame) -> DataFrame:
    """A stricter threshold never flags more."""
    from pyspark.sql import Window

    for axis, other in (("wer_hi", "conf_pct_hi"), ("conf_pct_hi", "wer_hi")):
        before = F.lag("n_dead_zones").over(Window.partitionBy("model", other).orderBy(axis))
        if counts.withColumn("_b", before).where("n_dead_zones > _b").limit(1).collect():
            raise S.MeasurementError(f"the count grows along {axis}")
    return counts


def persistence(swept: DataFrame) -> DataFrame:
    """The share of grid points at which a condition is flagged, for those ever flagged."""
    return swept.groupBy("model", "condition_name").agg(F.avg(F.col("flagged").cast("int")).alias("persistence"), F.count_if("flagged").alias("n_points")).where("n_points > 0")


def sweep_verdict(counts: DataFrame) -> DataFrame:
    """How far the count hangs on the operating point: fold range (max+1)/(min+1)."""
    out = counts.groupBy("model").agg(F.min("n_dead_zones").alias("low"), F.max("n_dead_zones").alias("high"))
    fold = (F.col("high") + 1) / (F.col("low") + 1)
    return out.withColumn("fold", fold).withColumn("verdict", F.when(fold <= 2, "stable").when(fold >= 4, "fragile").otherwise("moderate"))
