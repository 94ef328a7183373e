"""Scalar functions: logits, condition names, factor levels, deterministic choice, prices."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How factors are written in a condition's name.
SHORT = {"rt60": "rt60", "snr_db": "snr", "mic_rolloff": "mic"}


def logit(p: Column, clip: float = 1e-6) -> Column:
    q = F.least(F.greatest(p, F.lit(clip)), F.lit(1 - clip))
    return F.ln(q / (1 - q))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def probability_of_logprob(lp: Column, clip: float = 1e-6) -> Column:
    """exp of a log probability, clipped; a positive one raises."""
    return F.when(lp > 0, F.raise_error(F.lit("a log probability is positive")).cast("double")).otherwise(F.least(F.greatest(F.exp(lp), F.lit(clip)), F.lit(1 - clip)))


def shortest(x: Column) -> Column:
    """A number as short as it can be written: 20.0 as 20."""
    return F.regexp_replace(x.cast("string"), r"\.0$", "")


def condition_name() -> Column:
    return F.concat_ws("_", F.concat(F.lit("rt60-"), shortest(F.col("rt60"))), F.concat(F.lit("snr-"), shortest(F.col("snr_db"))), F.col("noise_type"), F.col("codec"), F.concat(F.lit("mic-"), shortest(F.col("mic_rolloff"))))


def parse_condition(name: Column) -> Column:
    """The factors of a condition's name, as a struct."""
    p = F.split(name, "_")
    number = lambda k: F.split(p[k], "-", 2)[1].try_cast("double")
    return F.struct(number(0).alias("rt60"), number(1).alias("snr_db"), p[2].alias("noise_type"), p[3].alias("codec"), number(4).alias("mic_rolloff"))


def decode_level(value: Column, levels: list[str]) -> Column:
    """The level of a sampled number: its floor, held within the list."""
    k = F.least(F.greatest(F.floor(value), F.lit(0)), F.lit(len(levels) - 1)).cast("int")
    return F.element_at(F.array(*map(F.lit, levels)), k + 1)


def stable_choice(key: Column, n: int) -> Column:
    """A choice among n by hash: the same on every engine and run."""
    return F.pmod(F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 15), 16, 10).cast("long"), F.lit(n)).cast("int")


def with_cost(calls: DataFrame, rates: DataFrame) -> DataFrame:
    """Calls (model, minutes) priced from rates (model, usd_per_minute): a model without a
    rate has a NULL cost and class 'unknown', never a free one."""
    out = calls.join(rates, "model", "left")
    price = F.col("usd_per_minute")
    return out.withColumn("cost_usd", F.col("minutes") * price).withColumn("pricing_class", F.when(price.isNull(), "unknown").when(price > 0, "billed").otherwise("local"))


def _series(ratio, count: Column) -> Column:
    """1 + r(1) + r(1) r(2) + ..., with ``count`` ratios after the first term."""
    steps = F.when(count >= 1, F.sequence(F.lit(1).cast("long"), count)).otherwise(F.array().cast("array<long>"))
    start = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))

    def add(a: Column, k: Column) -> Column:
        t = a["t"] * ratio(k.cast("double"))
        return F.struct(t.alias("t"), (a["s"] + t).alias("s"))

    return F.aggregate(steps, start, add, lambda a: a["s"])


def student_two_sided(t: Column, df: Column) -> Column:
    """The chance that Student's t with ``df`` degrees (a positive whole number) is at least
    as far from zero, by its finite series; to about 1e-12, below which it reads 0."""
    df = df.cast("long")
    far = F.abs(t)
    c2 = F.when(far == float("inf"), 0.0).otherwise(df / (df + far * far))
    angle, sine = F.atan(far / F.sqrt(df)), F.sqrt(1 - c2)
    even = sine * _series(lambda k: c2 * (2 * k - 1) / (2 * k), F.floor((df - 2) / 2))
    tail = sine * F.sqrt(c2) * _series(lambda k: c2 * 2 * k / (2 * k + 1), F.floor((df - 3) / 2))
    odd = (angle + F.when(df >= 3, tail).otherwise(0.0)) * (2 / math.pi)
    return F.when((df >= 1) & t.isNotNull(), F.greatest(1 - F.when(df % 2 == 0, even).otherwise(odd), F.lit(0.0)))


def normal_two_sided(z: Column) -> Column:
    """The chance that a normal value is at least as far from zero, by a series without
    cancellation; beyond 8 it reads 0."""
    far = F.least(F.abs(z), F.lit(8.0))
    inside = far * F.exp(-far * far / 2) * math.sqrt(2 / math.pi) * _series(lambda k: far * far / (2 * k + 1), F.lit(200).cast("long"))
    return F.when(z.isNotNull(), F.greatest(1 - inside, F.lit(0.0)))
