"""Calibration and separability of confidence."""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks import schema as S
from gaugeworks.functions.numeric import logit
from gaugeworks.operators.ranking import exact_quantiles
from gaugeworks.session import persist


def word_records(rows: DataFrame, keep: list[str]) -> DataFrame:
    """One row for each emitted word: its edit, words, confidence and whether it is
    right.  Edits with a hypothesis word and confidences must be equally many."""
    said = F.filter("edits", lambda e: e["hyp"].isNotNull())
    fits = S.usable(rows).withColumn("_said", said)
    if n := fits.agg(F.count_if(F.size("_said") != F.size("word_confidences"))).first()[0]:
        raise S.ConfidenceAlignmentError(f"{n} rows have edits and confidences of different lengths")
    out = fits.select(*keep, F.posexplode(F.arrays_zip(F.col("_said").alias("e"), F.col("word_confidences").alias("c"))).alias("position", "_w"))
    return out.select(*keep, "position", "_w.e.op", "_w.e.ref", "_w.e.hyp", F.col("_w.c").alias("conf"), (F.col("_w.e.op") == "match").cast("int").alias("correct"))


def bin_of(conf: Column, bins: int = S.ECE_BINS) -> Column:
    """Equal widths over 0..1, the last bin closed."""
    return F.least(F.greatest(F.floor(conf * bins), F.lit(0)), F.lit(bins - 1)).cast("int")


def reliability(rows: DataFrame, keys: list[str], conf: str, correct: str, bins: int = S.ECE_BINS) -> DataFrame:
    """Count, mean confidence and accuracy by bin; empty bins are left out."""
    return rows.where(F.col(conf).isNotNull()).groupBy(*keys, bin_of(F.col(conf), bins).alias("bin")).agg(F.count("*").alias("n"), F.avg(conf).alias("mean_conf"), F.avg(F.col(correct).cast("double")).alias("accuracy"))


def expected_calibration_error(curve: DataFrame, keys: list[str]) -> DataFrame:
    gap = F.abs(F.col("accuracy") - F.col("mean_conf"))
    return curve.groupBy(*keys).agg(F.sum("n").alias("n"), (F.sum(F.col("n") * gap) / F.sum("n")).alias("ece"))


def operating_points(rows: DataFrame, score: str, bad: Column, rates: list[float]) -> DataFrame:
    """Flagging the lowest scores: threshold, precision and recall for each flag rate.
    The thresholds are exact quantiles, selected without ordering all scores."""
    points = exact_quantiles(rows, [], score, rates).select(F.col("rate").alias("flag_rate"), F.col("quantile").alias("threshold"))
    out = rows.select(F.col(score).alias("_s"), bad.alias("_bad")).join(F.broadcast(points)).groupBy("flag_rate", "threshold")  # one row a rate
    flagged = F.col("_s") <= F.col("threshold")
    out = out.agg(F.count_if(flagged).alias("n_flagged"), F.count_if(flagged & F.col("_bad")).alias("n_caught"), F.count_if("_bad").alias("n_bad"))
    return out.withColumn("precision", F.try_divide(F.col("n_caught").cast("double"), F.col("n_flagged"))).withColumn("recall", F.try_divide(F.col("n_caught").cast("double"), F.col("n_bad")))


def grouped_split(rows: DataFrame, key: str, share: float, seed: int) -> DataFrame:
    """``rows`` with ``in_train``, by whole groups: the groups whose hashes come first,
    round(n * share) of them, at least one on each side."""
    groups = persist(rows.select(key).distinct(), "groups")
    n = groups.count()
    k = min(max(round(n * share), 1), max(n - 1, 1))
    place = F.row_number().over(Window.orderBy(F.xxhash64(key, F.lit(seed)), key))
    # written first: of few groups Spark then knows that they are few, and moves no row for the join
    return rows.join(persist(groups.withColumn("in_train", place <= k), "split"), key)


def confidence_counts(rows: DataFrame, keys: list[str], conf: str, correct: str) -> DataFrame:
    """Rows and right rows by exact confidence: all that a likelihood of the confidence
    alone needs, and usually far fewer rows than words."""
    return rows.where(F.col(conf).isNotNull()).groupBy(*keys, conf).agg(F.count("*").alias("n"), F.sum(F.col(correct).cast("double")).alias("n_correct"))


def temperature_of_counts(counts: DataFrame, conf: str, low: float = 0.05, high: float = 20.0, rounds: int = 4, steps: int = 32) -> float:
    """The temperature with the least negative log likelihood.  Each round tries a grid of
    temperatures in one aggregate over the counts and narrows the span around the best."""
    base = counts.select(logit(F.col(conf)).alias("z"), "n", "n_correct")
    best, z = 1.0, F.col("z")
    for _ in range(rounds):
        grid = np.exp(np.linspace(math.log(low), math.log(high), steps)).tolist()
        loss = [F.sum(F.col("n") * (F.log1p(F.exp(-F.abs(z / t))) + F.greatest(z / t, F.lit(0.0))) - F.col("n_correct") * z / t) for t in grid]
        k = int(np.argmin(np.array(base.agg(*loss).first(), float)))
        best, low, high = grid[k], grid[max(0, k - 1)], grid[min(steps - 1, k + 1)]
    return best


def temperatures(counts: DataFrame, keys: list[str], conf: str, low: float = 0.05, high: float = 20.0, rounds: int = 4, steps: int = 32) -> DataFrame:
    """``temperature_of_counts`` for every group of ``keys`` at once: each round joins the
    groups with their own grids (a few numbers a group) and takes the best in one aggregate."""
    base = counts.select(*keys, logit(F.col(conf)).alias("_z"), "n", "n_correct")
    spans = base.select(*keys).distinct().select(*keys, F.lit(math.log(low)).alias("_a"), F.lit(math.log(high)).alias("_b"))
    for k in range(rounds):
        step = (F.col("_b") - F.col("_a")) / (steps - 1)
        grid = spans.select(*keys, "_a", "_b", F.explode(F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: F.col("_a") + i * step)).alias("_t"))
        x = F.col("_z") / F.exp("_t")
        loss = F.sum(F.col("n") * (F.log1p(F.exp(-F.abs(x))) + F.greatest(x, F.lit(0.0))) - F.col("n_correct") * x)
        best = base.join(grid, keys).groupBy(*keys, "_a", "_b", "_t").agg(loss.alias("_loss")).groupBy(*keys, "_a", "_b").agg(F.min_by("_t", F.struct("_loss", "_t")).alias("_t"))
        spans = best.select(*keys, F.greatest(F.col("_a"), F.col("_t") - step).alias("_a"), F.least(F.col("_b"), F.col("_t") + step).alias("_b"), "_t")
    return spans.select(*keys, F.exp("_t").alias("temperature"))


def fit_temperature(rows: DataFrame, conf: str, correct: str, **options: float) -> float:
    """``temperature_of_counts`` over the counts of rows, which are kept while it runs."""
    counts = confidence_counts(rows, [], conf, correct).cache()
    try:
        return temperature_of_counts(counts, conf, **options)
    finally:
        counts.unpersist()


def fit_feature_calibrator(rows: DataFrame, conf: str, correct: str, features: list[str], c: float = 10.0):
    """Logistic regression of correctness on the standardized logit and condition
    features, with the strength of ``c``; returns (model, function that adds ``p``)."""
    z = rows.withColumn("_z", logit(F.col(conf)))
    names = ["_z", *features]
    stats = z.agg(F.count("*").alias("n"), *[f(x).alias(f"{k}{i}") for i, x in enumerate(names) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    assembler = VectorAssembler(inputCols=[f"_f{i}" for i in range(len(names))], outputCol="_v")

    def prepared(df: DataFrame) -> DataFrame:
        df = df.withColumn("_z", logit(F.col(conf)))
        for i, x in enumerate(names):
            df = df.withColumn(f"_f{i}", (F.col(x) - stats[f"m{i}"]) / (stats[f"s{i}"] or 1.0))
        return assembler.transform(df)

    model = LogisticRegression(featuresCol="_v", labelCol="_y", regParam=1 / (c * stats.n), standardization=False, tol=1e-9, maxIter=200).fit(prepared(z.withColumn("_y", F.col(correct).cast("double"))))

    def apply(df: DataFrame) -> DataFrame:
        w, b = model.coefficients.toArray().tolist(), model.intercept
        total = sum((F.col(f"_f{i}") * x for i, x in enumerate(w)), F.lit(b))
        return prepared(df).withColumn("p", 1 / (1 + F.exp(-total))).drop("_v", "_z", *[f"_f{i}" for i in range(len(names))])

    return model, apply


def poisson_weight(hashed: Column) -> Column:
    """A Poisson number of mean 1 from a 64-bit hash: how often a unit is drawn in a
    resample, the same on any engine and in any order."""
    u = F.pmod(hashed, F.lit(1 << 30)) / (1 << 30)
    weight, total, term = F.lit(0), 0.0, math.exp(-1)
    for k in range(8):
        total += term
        weight = weight + (u >= total).cast("int")
        term /= k + 1
    return weight


def saturation(rows: DataFrame, conf: str, correct: str | None = None, eps: float = 1e-3, keys: tuple[str, ...] = ()) -> DataFrame:
    """How much of the confidence lies at its ends, and how fine it is, by ``keys``."""
    c = F.col(conf)
    out = [F.count(c).alias("n"), F.avg((c == 1).cast("int")).alias("share_one"), F.avg((c == 0).cast("int")).alias("share_zero"), F.avg((c >= 1 - eps).cast("int")).alias("share_near_one"), F.avg((c <= eps).cast("int")).alias("share_near_zero"), F.count_distinct(c).alias("n_distinct")]
    if correct:
        out.append(F.avg(F.when(c >= 1 - eps, F.col(correct).cast("double"))).alias("accuracy_at_ceiling"))
    return rows.where(c.isNotNull()).groupBy(*keys).agg(*out)


def scale_overlap(rows: DataFrame, conf: str = "mean_conf") -> DataFrame:
    """(model, n, low, median, high, overlaps): the span of each model's raw confidence, and
    whether all spans share a value.  A diagnostic only: raw scales don't compare."""
    out = rows.groupBy("model").agg(F.count(conf).alias("n"), F.min(conf).alias("low"), F.median(conf).alias("median"), F.max(conf).alias("high"))
    every = Window.partitionBy()  # one row a model
    return out.withColumn("overlaps", F.coalesce(F.max("low").over(every) <= F.min("high").over(every), F.lit(False)))


def row_aggregates(confidences: str) -> dict[str, Column]:
    """Aggregates of an array of word confidences, quantiles by linear interpolation."""
    a = F.array_sort(F.col(confidences))
    n = F.size(a)

    def quantile(q: float) -> Column:
        h = (n - 1) * F.lit(q)
        low = F.floor(h).cast("int")
        below, above = F.get(a, low), F.get(a, F.least(low + 1, n - 1))
        return below + (above - below) * (h - low)

    mean = F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / n
    return {k: F.when(n > 0, x) for k, x in {"mean": mean, "median": quantile(0.5), "p25": quantile(0.25), "p10": quantile(0.1), "min": F.get(a, F.lit(0)), "max": F.get(a, n - 1)}.items()} | {"n_words": n}


def redundancy(rows: DataFrame, a: str, b: str, keys: list[str]) -> DataFrame:
    """Whether two confidences are one: the share of equal values and their correlation."""
    from gaugeworks.operators.ranking import correlation

    both = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    return both.groupBy(*keys).agg(F.count("*").alias("n"), F.avg((F.abs(F.col(a) - F.col(b)) <= 1e-12).cast("int")).alias("share_equal"), correlation(F.col(a), F.col(b)).alias("r"))


def alignment_census(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose words and confidences are equally many, and why the others aren't: words
    that normalization split, or that it dropped or joined."""
    words, confs = F.size(F.filter("edits", lambda e: e["hyp"].isNotNull())), F.size("word_confidences")
    return S.usable(rows).groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(words == confs).alias("n_aligned"), F.count_if(words > confs).alias("n_split"), F.count_if(words < confs).alias("n_dropped"))
