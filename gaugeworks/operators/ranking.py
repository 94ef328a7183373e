"""Average ranks, percentiles, rank correlations and AUROC as window expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.functions.numeric import normal_two_sided, student_two_sided


def _tied_window(keys: list[str], value: str) -> Column:
    over = Window.partitionBy(*keys)
    tied = Window.partitionBy(*keys, value)
    return (F.rank().over(over.orderBy(F.col(value).asc_nulls_last())) + (F.count("*").over(tied) - 1) / 2).cast("double")


def with_average_rank(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    return rows.withColumn(name, _tied_window(keys, value))


def with_percentile(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Percentile within ``keys``, computed once over each whole arm: missing values sink
    to 0 and don't count in the others' denominator."""
    n = F.count(F.col(value)).over(Window.partitionBy(*keys))
    return rows.withColumn(name, F.when(F.col(value).isNull(), F.lit(0.0)).otherwise((_tied_window(keys, value) - 1) / F.greatest(n - 1, F.lit(1))))


def correlation(x: Column, y: Column, least: int = 3) -> Column:
    """Pearson's r; NULL for fewer than ``least`` rows or a constant side."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    r = F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    return F.when(F.count(a) >= least, r)


def spearman(rows: DataFrame, keys: list[str], x: str, y: str, name: str = "rho", least: int = 3) -> DataFrame:
    """Spearman's correlation within ``keys`` over rows that have both values."""
    both = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    both = with_average_rank(with_average_rank(both, keys, x, "_x"), keys, y, "_y")
    return both.groupBy(*keys).agg(F.count("*").alias("n"), correlation(F.col("_x"), F.col("_y"), least).alias(name))


def kendall(pairs: DataFrame, x: str, y: str, label: str) -> DataFrame:
    """Kendall's tau-b over a table of a few hundred labelled pairs (a condition table):
    each pair of rows once, by label order."""
    a, b = pairs.select(F.col(label).alias("la"), F.col(x).alias("xa"), F.col(y).alias("ya")), pairs.select(F.col(label).alias("lb"), F.col(x).alias("xb"), F.col(y).alias("yb"))
    s = a.join(b, F.col("la") < F.col("lb")).select(F.signum(F.col("xa") - F.col("xb")).alias("dx"), F.signum(F.col("ya") - F.col("yb")).alias("dy"))
    sums = s.agg(F.sum(F.col("dx") * F.col("dy")).alias("s"), F.sum(F.abs("dx")).alias("nx"), F.sum(F.abs("dy")).alias("ny"))
    return sums.select(F.try_divide(F.col("s"), F.sqrt(F.col("nx") * F.col("ny"))).alias("tau"))


def rank_agreement(pairs: DataFrame, x: str, y: str, label: str) -> DataFrame:
    """Spearman's and Kendall's correlation of a condition table with their two-sided
    p-values (Student's t, normal), as one row; NULL for fewer than three pairs or a
    constant side."""
    both = pairs.where(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y))
    out = spearman(both.withColumn("_all", F.lit(1)), ["_all"], x, y, "spearman").drop("_all").join(kendall(both, x, y, label))
    n, rho = F.col("n"), F.col("spearman")
    t = F.when(F.abs(rho) < 1, rho * F.sqrt((n - 2) / (1 - rho * rho))).otherwise(F.when(rho.isNotNull(), float("inf")))
    z = 3 * F.col("tau") * F.sqrt(n * (n - 1)) / F.sqrt(2 * (2 * n + 5))
    tau = F.when(rho.isNotNull(), F.col("tau"))
    return out.select("n", "spearman", student_two_sided(t, n - 2).alias("spearman_p"), tau.alias("kendall"), F.when(rho.isNotNull(), normal_two_sided(z)).alias("kendall_p"))


def _bucket(score: Column) -> Column:
    """A coarse value in the order of the score: sign, power of ten, three digits."""
    size = F.abs(score)
    power = F.when(size > 0, F.floor(F.log10(size))).otherwise(F.lit(0)).cast("long")
    sign = F.signum(score).cast("long")
    digits = F.when(size == float("inf"), F.lit(0)).otherwise(F.floor(size / F.pow(F.lit(10.0), power) * 100)).cast("long")
    return F.struct(sign.alias("s"), (sign * power).alias("p"), (sign * digits).alias("d"))


def auroc(rows: DataFrame, keys: list[str], score: str, good: Column) -> DataFrame:
    """Mann-Whitney AUROC, ties counting half: the chance that a good row scores higher.
    NULL where a group has one class only.  Rows are counted by distinct score first; the
    scores of one coarse value are ranked in one task, and only coarse values (at most some
    thousand a power of ten) are put in order for a whole group."""
    label = good.cast("int")
    x = rows.where(F.col(score).isNotNull() & ~F.isnan(F.col(score))).select(*keys, F.col(score).cast("double").alias("_s"), label.alias("_g"))
    n = x.groupBy(*keys, _bucket(F.col("_s")).alias("_b"), "_s").agg(F.sum("_g").alias("_good"), F.sum(1 - F.col("_g")).alias("_bad"))
    before = lambda w: F.coalesce(F.sum("_bad").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wins = F.col("_good") * (before(Window.partitionBy(*keys, "_b").orderBy("_s")) + F.col("_bad") / 2)
    b = n.withColumn("_w", wins).groupBy(*keys, "_b").agg(F.sum("_w").alias("_w"), F.sum("_good").alias("_good"), F.sum("_bad").alias("_bad"))
    b = b.withColumn("_w", F.col("_w") + F.col("_good") * before(Window.partitionBy(*keys).orderBy("_b")))
    total = b.groupBy(*keys).agg(F.sum("_good").alias("n_good"), F.sum("_bad").alias("n_bad"), F.sum("_w").alias("_w"))
    return total.select(*keys, "n_good", "n_bad", F.try_divide("_w", (F.col("n_good") * F.col("n_bad")).cast("double")).alias("auroc"))


def _fine(score: Column) -> Column:
    """A finer value within a coarse one: six digits."""
    size = F.abs(score)
    power = F.when(size > 0, F.floor(F.log10(size))).otherwise(F.lit(0)).cast("long")
    return F.when(size == float("inf"), F.lit(0)).otherwise(F.signum(score).cast("long") * F.floor(size / F.pow(F.lit(10.0), power) * 100_000)).cast("long")


def exact_quantiles(rows: DataFrame, keys: list[str], value: str, rates: list[float]) -> DataFrame:
    """(keys, rate, quantile): exact quantiles by linear interpolation, as ``percentile``
    gives them, by selection: no task holds all distinct values.

    Rows are counted by coarse value (at most some thousand a power of ten), which tells
    where the wanted places lie; those coarse values' rows are counted by six digits, and only
    the rows of the finer values found then are put in order.  Null and NaN are left out; a
    key without values has no row.  Rows are read three times; rows of a null key belong together."""
    x = rows.where(F.col(value).isNotNull() & ~F.isnan(value)).select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], (F.col(value).cast("double") + F.lit(0.0)).alias("_v"))
    names = [f"_k{i}" for i in range(len(keys))]
    x = x.withColumns({"_b": _bucket(F.col("_v")), "_f": _fine(F.col("_v"))})

    def found(counts: DataFrame, wanted: DataFrame | None, within: list[str], step: str) -> DataFrame:
        """The places (within, place, rate, high) that are wanted, each with the ``step`` that
        holds it and its place there."""
        over = Window.partitionBy(*within).orderBy(step)
        c = counts.withColumn("_before", F.coalesce(F.sum("_n").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        if wanted is None:
            ends = F.explode(F.array(*[F.struct(F.lit(q).alias("rate"), F.lit(side).alias("high")) for q in rates for side in (0, 1)])).alias("_q")
            total = counts.groupBy(*within).agg(F.sum("_n").alias("_all")).where("_all > 0").select(*within, "_all", ends).select(*within, "_all", "_q.*")
            low = F.floor((F.col("_all") - 1) * F.col("rate"))
            wanted = total.withColumn("_place", F.least(low + F.col("high"), F.col("_all") - 1).cast("long")).withColumn("_part", (F.col("_all") - 1) * F.col("rate") - low)
        w = wanted.select(*[F.col(k).alias(f"_w{k}") for k in within], *[k for k in wanted.columns if k not in within])
        same = F.lit(True)
        for k in within:
            same &= F.col(k).eqNullSafe(F.col(f"_w{k}"))
        here = (F.col("_place") >= F.col("_before")) & (F.col("_place") < F.col("_before") + F.col("_n"))
        return c.join(w, same & here).select(*within, step, "rate", "high", "_part", (F.col("_place") - F.col("_before")).alias("_place"))

    def only(wanted: DataFrame, within: list[str]) -> DataFrame:
        w = wanted.select(*[F.col(k).alias(f"_w{k}") for k in within]).distinct()
        same = F.lit(True)
        for k in within:
            same &= F.col(k).eqNullSafe(F.col(f"_w{k}"))
        return x.join(w, same, "left_semi")

    count = F.count("*").alias("_n")
    places = found(x.groupBy(*names, "_b").agg(count), None, names, "_b")
    places = found(only(places, [*names, "_b"]).groupBy(*names, "_b", "_f").agg(count), places, [*names, "_b"], "_f")
    places = found(only(places, [*names, "_b", "_f"]).groupBy(*names, "_b", "_f", "_v").agg(count), places, [*names, "_b", "_f"], "_v")
    low, high = (F.max(F.when(F.col("high") == side, F.col("_v"))) for side in (0, 1))
    out = places.groupBy(*names, "rate").agg((low + (high - low) * F.max("_part")).alias("quantile"))
    return out.select(*[F.col(k).alias(c) for k, c in zip(names, keys, strict=True)], "rate", "quantile")
