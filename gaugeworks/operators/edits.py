"""Edit profiles: which errors, where, and on which words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks import schema as S

EDITS = ("sub", "del", "ins")


def composition(rows: DataFrame, *keys: str) -> DataFrame:
    """Rates by reference word, shares of the errors and the dominant type (ties in the
    order sub, del, ins); shares are NULL without errors."""
    n = {e: F.sum(f"n_{e}") for e in EDITS}
    out = S.usable(rows).groupBy(*keys).agg(F.count("*").alias("n_clips"), F.sum("n_ref").alias("n_ref_total"), *[n[e].alias(f"n_{e}") for e in EDITS])
    total = F.col("n_sub") + F.col("n_del") + F.col("n_ins")
    most = F.greatest(*[F.col(f"n_{e}") for e in EDITS])
    dominant = F.when(total == 0, None).when(F.col("n_sub") == most, "sub").when(F.col("n_del") == most, "del").otherwise("ins")
    return out.select(
        "*", *[F.try_divide(F.col(f"n_{e}").cast("double"), F.col("n_ref_total")).alias(f"rate_{e}") for e in EDITS], *[F.try_divide(F.col(f"n_{e}").cast("double"), total).alias(f"share_{e}") for e in EDITS], dominant.alias("dominant"),
    )


def contrasts(rows: DataFrame, keys: list[str], hard: Column, mild: Column, contrast: str) -> DataFrame:
    """Rates by edit type in the hard and the mild group of a contrast: difference and
    Cohen's d (NULL with ``d_infinite`` where the pooled deviation is 0)."""
    ok = S.usable(rows).where("n_ref > 0")
    side = ok.withColumn("_s", F.when(hard, 1).when(mild, 0)).where("_s is not null")
    parts = F.explode(F.array(*[F.struct(F.lit(e).alias("edit"), (F.col(f"n_{e}") / F.col("n_ref")).alias("r")) for e in EDITS]))
    side = side.withColumn("_e", parts).select(*keys, "_s", "_e.*")
    group = lambda f, s: f(F.when(F.col("_s") == s, F.col("r")))
    out = side.groupBy(*keys, "edit").agg(group(F.count, 1).alias("n_hard"), group(F.count, 0).alias("n_mild"), group(F.avg, 1).alias("_m1"), group(F.avg, 0).alias("_m0"), group(F.var_samp, 1).alias("_v1"), group(F.var_samp, 0).alias("_v0"))
    pooled = F.sqrt(F.try_divide((F.col("n_hard") - 1) * F.col("_v1") + (F.col("n_mild") - 1) * F.col("_v0"), (F.col("n_hard") + F.col("n_mild") - 2).cast("double")))
    delta = F.col("_m1") - F.col("_m0")
    return out.where("n_hard > 1 and n_mild > 1").select(F.lit(contrast).alias("contrast"), *keys, "edit", "n_hard", "n_mild", delta.alias("delta"), F.try_divide(delta, pooled).alias("cohens_d"), ((pooled == 0) & (delta != 0)).alias("d_infinite"))


def terciles(rows: DataFrame, column: str) -> tuple[Column, Column]:
    """(low, high) thirds of a continuous factor, the middle in neither."""
    low, high = rows.select(F.percentile(column, F.array(F.lit(1 / 3), F.lit(2 / 3)))).first()[0]
    return F.col(column) <= low, F.col(column) >= high


def hallucinations(rows: DataFrame, ratio: float = 1.5, least: int = 5) -> DataFrame:
    """Usable rows with far more insertions than the reference has words."""
    return S.usable(rows).where((F.col("n_ref") > 0) & (F.col("n_ins") >= least) & (F.col("n_ins") >= ratio * F.col("n_ref"))).withColumn("ins_over_ref", F.col("n_ins") / F.col("n_ref"))


def deletion_blindness(rows: DataFrame, *keys: str) -> DataFrame:
    """Errors that no word confidence can point at: deletions emit no word."""
    out = S.usable(rows).groupBy(*keys).agg(F.sum("n_ref").alias("n_ref"), F.sum("n_sub").alias("n_sub"), F.sum("n_del").alias("n_del"), F.sum("n_ins").alias("n_ins"))
    errors = F.col("n_sub") + F.col("n_del") + F.col("n_ins")
    return out.withColumn("blind_share", F.try_divide(F.col("n_del").cast("double"), errors)).withColumn("visible_ceiling", F.try_divide((F.col("n_sub") + F.col("n_ins")).cast("double"), errors))


def word_inventory(edits: DataFrame, opportunities: DataFrame, top: int = 3) -> DataFrame:
    """Reference words of (op, ref, hyp) rows: how often each was destroyed, of how many
    chances (word, n_chances), and its ``top`` confusions."""
    lost = edits.where("op in ('sub', 'del')").groupBy(F.col("ref").alias("word")).agg(F.count("*").alias("n_destroyed"), F.count_if(F.col("op") == "del").alias("n_deleted"))
    mixed = edits.where("op = 'sub'").groupBy(F.col("ref").alias("word"), "hyp").agg(F.count("*").alias("n"))
    mixed = mixed.withColumn("place", F.row_number().over(Window.partitionBy("word").orderBy(F.desc("n"), "hyp"))).where(F.col("place") <= top)
    mixed = mixed.groupBy("word").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "hyp"))), lambda x: x["hyp"]), " ").alias("confusions"))
    out = lost.join(opportunities, "word", "left").join(mixed, "word", "left")
    return out.withColumn("destroyed_share", F.try_divide(F.col("n_destroyed").cast("double"), F.col("n_chances")))


def insertions(edits: DataFrame, vocabulary: DataFrame, keys: list[str]) -> DataFrame:
    """Inserted words of (clip_id, *keys, op, hyp): foreign to the clip's reference
    vocabulary (clip_id, word), or its own; for each key and in all (grouping sets)."""
    ins = edits.where("op = 'ins'").join(vocabulary.select("clip_id", F.col("word").alias("hyp"), F.lit(True).alias("own")).distinct(), ["clip_id", "hyp"], "left")
    sets = [[F.col(k)] for k in keys] + [[]]
    out = ins.groupingSets(sets, *[F.col(k) for k in keys]).agg(F.count("*").alias("n_ins"), F.count_if(F.col("own").isNull()).alias("n_foreign"))
    return out.withColumn("foreign_share", F.col("n_foreign") / F.col("n_ins"))


def drift(curve: DataFrame, keys: list[str], level: str, clean: float, feature: str) -> DataFrame:
    """How far a feature is from its value at the clean level of the same keys, at every
    level; NULL where there is no clean value."""
    base = curve.where(F.col(level) == clean).groupBy(*keys).agg(F.avg(feature).alias("_base"))
    return curve.join(base, keys, "left").withColumn("drift", F.abs(F.col(feature) - F.col("_base"))).drop("_base")
