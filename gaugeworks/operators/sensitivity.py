"""Factorial experiments: exact functional ANOVA by CUBE, Sobol indices, dips, reversals."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks import schema as S
from gaugeworks.operators import resampling
from gaugeworks.operators.guards import require_complete


def cell_means(rows: DataFrame, factors: list[str], value: str) -> DataFrame:
    """One mean for each combination of levels."""
    return rows.where(F.col(value).isNotNull()).groupBy(*factors).agg(F.avg(value).alias("y"))


def anova_terms(cells: DataFrame, factors: list[str]) -> DataFrame:
    """The variance of every effect of a complete design: (term, order, variance).

    A CUBE over the cell means gives all marginal means at once; the variance of the
    marginal means over a subset is the sum of the terms inside it, so inclusion and
    exclusion over subsets gives the terms.  Their sum is checked against the total.
    """
    require_complete(cells, *factors)
    cube = cells.cube(*factors).agg(F.avg("y").alias("m"), F.grouping_id().alias("g"))
    closed = {r.g: r.v for r in cube.groupBy("g").agg(F.var_pop("m").alias("v")).collect()}  # 2^k rows
    k = len(factors)

    def code(subset: tuple[int, ...]) -> int:  # grouping_id has a 1 for each factor averaged out
        return sum(1 << (k - 1 - i) for i in range(k) if i not in subset)

    terms = []
    for size in range(1, k + 1):
        for subset in combinations(range(k), size):
            v = sum((-1) ** (size - r) * closed[code(inner)] for r in range(1, size + 1) for inner in combinations(subset, r))
            terms.append((":".join(factors[i] for i in subset), size, float(v)))
    total = closed[0]
    if abs(sum(v for *_, v in terms) - total) > 1e-9 * max(1.0, abs(total)):
        raise S.MeasurementError("the terms don't sum to the variance")
    return cells.sparkSession.createDataFrame(terms, "term string, order int, variance double")


def sobol(terms: DataFrame, factors: list[str]) -> DataFrame:
    """First-order and total shares of the variance by factor, and their gap."""
    total = F.sum("variance")
    out = [total.alias("_v")]
    for f in factors:
        member = F.array_contains(F.split("term", ":"), f)
        out += [F.sum(F.when(F.col("term") == f, F.col("variance"))).alias(f"{f}_1"), F.sum(F.when(member, F.col("variance"))).alias(f"{f}_t")]
    row = terms.agg(*out)
    parts = F.explode(F.array(*[F.struct(F.lit(f).alias("factor"), F.try_divide(F.col(f"{f}_1"), F.col("_v")).alias("s1"), F.try_divide(F.col(f"{f}_t"), F.col("_v")).alias("st")) for f in factors]))
    return row.select(parts.alias("x")).select("x.*").withColumn("gap", F.col("st") - F.col("s1"))


def share_by_order(terms: DataFrame) -> DataFrame:
    return terms.groupBy("order").agg(F.sum("variance").alias("v")).withColumn("share", F.try_divide("v", F.sum("v").over(Window.partitionBy()))).select("order", "share")


def main_effects(cells: DataFrame, factors: dict[str, bool]) -> DataFrame:
    """Mean at the harshest level minus mean at the mildest; ``factors`` maps a factor to
    whether more is harsher.  Ranked by absolute effect."""
    parts = F.explode(F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).cast("double").alias("level"), F.lit(up).alias("up")) for f, up in factors.items()]))
    means = cells.select("y", parts.alias("p")).select("y", "p.*").groupBy("factor", "up", "level").agg(F.avg("y").alias("m"))
    out = means.groupBy("factor", "up").agg(F.min_by("m", "level").alias("low"), F.max_by("m", "level").alias("high"))
    effect = F.when(F.col("up"), F.col("high") - F.col("low")).otherwise(F.col("low") - F.col("high"))
    return out.select("factor", effect.alias("effect")).withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.abs("effect")), "factor")))


def dips(cells: DataFrame, factors: list[str], axis: str, up: bool = True) -> DataFrame:
    """Interior levels along an axis where more degradation gave less error: depth is the
    lower neighbour's value minus the centre's."""
    others = [f for f in factors if f != axis]
    over = Window.partitionBy(*others).orderBy(F.col(axis).asc() if up else F.col(axis).desc())
    out = cells.withColumn("_a", F.lag("y").over(over)).withColumn("_b", F.lead("y").over(over)).where("_a is not null and _b is not null")
    return out.select(*factors, F.lit(axis).alias("axis"), (F.least("_a", "_b") - F.col("y")).alias("depth")).where("depth > 0")


def reversals(cells: DataFrame, factor: str, moderator: str, eps: float = 0.02) -> DataFrame:
    """Whether a factor's effect changes sign between the ends of a moderator."""
    m = cells.groupBy(factor, moderator).agg(F.avg("y").alias("_m"))
    by = m.groupBy(moderator).agg((F.max_by("_m", factor) - F.min_by("_m", factor)).alias("effect"))
    out = by.agg(F.min_by("effect", moderator).alias("effect_first"), F.max_by("effect", moderator).alias("effect_last"))
    a, b = F.col("effect_first"), F.col("effect_last")
    return out.select(F.lit(factor).alias("factor"), F.lit(moderator).alias("moderator"), "*", ((a * b < 0) & (F.abs(a) > eps) & (F.abs(b) > eps)).alias("reverses"))


def half_level(curve: DataFrame, keys: list[str], level: str, value: str) -> DataFrame:
    """Where a curve, scaled to 0..1, first reaches one half: at the first level after the
    mildest whose value is one half or more, on the line from the level before it; that level
    itself if both values are equal, and the last level if none reaches it."""
    whole, by = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy(level)
    low, high = F.min(value).over(whole), F.max(value).over(whole)
    x = curve.withColumn("_y", F.coalesce(F.try_divide(F.col(value) - low, high - low), F.lit(0.0))).withColumn("_py", F.lag("_y").over(by)).withColumn("_pl", F.lag(level).over(by))
    there = F.col("_py").isNotNull() & (F.col("_y") >= 0.5)
    line = F.col("_pl") + F.try_divide((0.5 - F.col("_py")) * (F.col(level) - F.col("_pl")), F.col("_y") - F.col("_py"))
    at = F.coalesce(line, F.col(level).cast("double"))
    return x.groupBy(*keys).agg(F.coalesce(F.min_by(F.when(there, at), F.when(there, F.col(level))), F.max(level)).alias("half_level"))


def monotonicity(curve: DataFrame, keys: list[str], level: str, value: str) -> DataFrame:
    """How often the direction of a curve changes, steps of zero left out."""
    by = Window.partitionBy(*keys).orderBy(level)
    steps = curve.withColumn("_s", F.signum(F.col(value) - F.lag(value).over(by))).where("_s <> 0")
    return steps.withColumn("_f", F.col("_s") != F.lag("_s").over(by)).groupBy(*keys).agg(F.count_if("_f").alias("n_sign_flips"))


def second_order(terms: DataFrame) -> DataFrame:
    """Shares of the variance of the pairs of factors, ranked: (a, b, s2, rank)."""
    share = F.try_divide("variance", F.sum("variance").over(Window.partitionBy()))  # 2^k rows
    pairs = terms.withColumn("s2", share).where(F.col("order") == 2).withColumn("_p", F.split("term", ":"))
    place = F.row_number().over(Window.orderBy(F.desc("s2"), "term"))
    return pairs.select(F.col("_p")[0].alias("a"), F.col("_p")[1].alias("b"), "s2", place.alias("rank"))


def _effects_of(y: np.ndarray) -> tuple[dict[tuple[int, ...], np.ndarray], dict[tuple[int, ...], np.ndarray]]:
    """Effects of complete designs and their variances, by axes; the first axis of ``y`` tells
    replicates apart, each other one is a factor.  An effect is the marginal mean less the
    effects inside it."""
    k, kept = y.ndim - 1, y.shape[:1]
    effects, out = {(): y.mean(axis=tuple(range(1, k + 1)), keepdims=True)}, {}
    for size in range(1, k + 1):
        for axes in combinations(range(k), size):
            rest = tuple(j + 1 for j in range(k) if j not in axes)
            e = y.mean(axis=rest, keepdims=True) if rest else y
            for r in range(size):
                for inner in combinations(axes, r):
                    e = e - effects[inner]
            effects[axes], out[axes] = e, np.square(e).reshape(*kept, -1).mean(axis=1)
    return effects, out


def replicate_designs(rows: DataFrame, keys: list[str], factors: list[str], unit: str, value: str, replicates: int, seed: int) -> DataFrame:
    """(keys, factors, y): every cell's mean as a vector over the sample and the replicates;
    null in a replicate that draws none of the cell's units."""
    x = rows.where(F.col(value).isNotNull() & F.col(unit).isNotNull()).select(*keys, *factors, unit, F.col(value).alias("_s"), F.lit(1.0).alias("_n"))
    return resampling.replicate_sums(x, unit, [*keys, *factors], ["_s", "_n"], replicates, seed).select(*keys, *factors, F.zip_with("_s", "_n", F.try_divide).alias("y"))


def _of_designs(rows: DataFrame, keys: list[str], factors: list[str], unit: str, value: str, replicates: int, seed: int, work, result: str) -> DataFrame:
    """``work`` (levels of each factor, means by replicate and cell: an axis each) for the
    complete design of each key; replicates without a mean in some cell are left out.  A
    design is one group of bounded size: its cells times the replicates."""
    designs = replicate_designs(rows, keys, factors, unit, value, replicates, seed)
    kinds = "".join(f"`{c}` {designs.schema[c].dataType.simpleString()}, " for c in keys)

    def one(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(factors, kind="stable")
        levels = [sorted(part[f].unique()) for f in factors]
        if len(part) != int(np.prod([len(x) for x in levels])):
            raise S.IncompleteDesignError(f"{len(part)} cells where {' x '.join(str(len(x)) for x in levels)} make the design")
        y = np.array([np.array(v, float) for v in part.y]).T
        y = y[np.isfinite(y).all(axis=1)].reshape(-1, *map(len, levels))
        out = pd.DataFrame(work(levels, y))
        for i, c in enumerate(keys):
            out.insert(i, c, part[c].iloc[0])
        return out

    # without keys all cells are one group of bounded size too
    return designs.groupBy(*keys).applyInPandas(one, kinds + result)


def sobol_intervals(rows: DataFrame, factors: list[str], unit: str, value: str, replicates: int = 1000, level: float = 0.95, seed: int = 5, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, term, kind, estimate, low, high): s1, st and gap of every factor and s2 of every
    pair, with percentile intervals over resampled units (clips).  A replicate that leaves a
    cell empty is left out; an incomplete design raises."""

    def indices(levels: list, y: np.ndarray) -> dict:
        _, v = _effects_of(y)
        total = sum(v.values())
        total = np.where(total == 0, 1.0, total)
        out: dict = {"term": [], "kind": [], "x": []}

        def add(term: str, kind: str, x: np.ndarray) -> None:
            for c, z in zip(out, (term, kind, x.tolist()), strict=True):
                out[c].append(z)

        for k, f in enumerate(factors):
            s1, st = v[(k,)] / total, sum(x for axes, x in v.items() if k in axes) / total
            for kind, x in (("s1", s1), ("st", st), ("gap", st - s1)):
                add(f, kind, x)
        for axes, x in v.items():
            if len(axes) == 2:
                add(":".join(factors[k] for k in axes), "s2", x / total)
        return out

    found = _of_designs(rows, list(keys), factors, unit, value, replicates, seed, indices, "term string, kind string, x array<double>")
    return found.select(*keys, "term", "kind", resampling.interval(F.col("x"), level).alias("i")).select(*keys, "term", "kind", "i.*")


def effect_intervals(rows: DataFrame, factors: dict[str, bool], unit: str, value: str, replicates: int = 1000, level: float = 0.95, seed: int = 5, keys: tuple[str, ...] = (), least_left: int = 4, least_share: float = 0.05) -> DataFrame:
    """Main effects of a complete design with percentile intervals over resampled units:
    (keys, factor, effect, low, high, significant, rank, survives).

    An effect is the mean at the harshest level less that at the mildest, over all others;
    ``factors`` maps a factor to whether more of it is harsher.  It is significant if its
    interval leaves out zero.  Factors are ranked by size (ties: in the order given); the
    weakest ones below ``least_share`` of the largest don't survive, down to ``least_left``."""
    names = list(factors)

    def effects(levels: list, y: np.ndarray) -> dict:
        ends = []
        for k, f in enumerate(names):
            m = y.mean(axis=tuple(j + 1 for j in range(len(names)) if j != k))
            ends.append(m[:, -1] - m[:, 0] if factors[f] else m[:, 0] - m[:, -1])
        size = [abs(float(e[0])) for e in ends]
        order = sorted(range(len(names)), key=lambda k: (-size[k], k))
        left = list(order)
        while len(left) > least_left and size[left[-1]] < least_share * (size[order[0]] or 1.0):
            left.pop()
        return {"factor": [names[k] for k in order], "x": [ends[k].tolist() for k in order], "rank": range(1, len(order) + 1), "survives": [k in left for k in order]}

    found = _of_designs(rows, list(keys), names, unit, value, replicates, seed, effects, "factor string, x array<double>, rank int, survives boolean")
    out = found.select(*keys, "factor", "rank", "survives", resampling.interval(F.col("x"), level).alias("i"))
    low, high = F.col("i.low"), F.col("i.high")
    return out.select(*keys, "factor", F.col("i.estimate").alias("effect"), low.alias("low"), high.alias("high"), F.coalesce((low > 0) | (high < 0), F.lit(False)).alias("significant"), "rank", "survives")


def gap_intervals(indices: DataFrame, least: float = 0.0) -> DataFrame:
    """Interactions by factor from (factor, s1, s1_half, st, st_half): the gap, the half width
    of its interval (both in quadrature, which is too wide rather than too narrow as the two
    go together), and whether the whole interval lies above the threshold."""
    gap, half = F.col("st") - F.col("s1"), F.hypot("s1_half", "st_half")
    out = indices.select("factor", "s1", "s1_half", "st", "st_half", gap.alias("gap"), half.alias("gap_half"), (gap - half).alias("low"), (gap + half).alias("high"))
    return out.withColumn("significant", F.coalesce(F.col("low") > least, F.lit(False)))


def preregistered(intervals: DataFrame, pair: tuple[str, str], least: float = 0.02, keys: tuple[str, ...] = ()) -> DataFrame:
    """The sealed rule on ``sobol_intervals``: CONFIRMED if the intervals of both factors'
    gaps lie above the threshold and no other pair has a larger s2; else NOT CONFIRMED, and
    ``power_limited`` where only the width of an interval stands against it.  UNRESOLVED
    where a factor is missing."""
    mine = F.col("kind").eqNullSafe("gap") & F.col("term").isin(*pair)
    own = F.col("term").isin(":".join(pair), ":".join(reversed(pair)))
    s2 = F.when(F.col("kind") == "s2", F.col("estimate"))
    out = intervals.groupBy(*keys).agg(
        F.count_if(mine).alias("n"), F.count_if(mine & (F.col("low") > least)).alias("n_clear"), F.count_if(mine & (F.col("estimate") > least)).alias("n_above"),
        F.min(F.when(mine, F.col("estimate"))).alias("least_gap"), F.max(F.when(own, s2)).alias("_own"), F.max(s2).alias("_top"),
    )
    clear, top = F.col("n_clear") == 2, F.coalesce(F.col("_own") >= F.col("_top"), F.lit(False))
    verdict = F.when(F.col("n") < 2, "UNRESOLVED").when(clear & top, "CONFIRMED").otherwise("NOT CONFIRMED")
    return out.select(*keys, "least_gap", clear.alias("gap_criterion"), top.alias("pair_criterion"), (~clear & (F.col("n") == 2) & (F.col("n_above") > 0)).alias("power_limited"), verdict.alias("verdict"))


def severity(conditions: DataFrame, harsher: dict[str, bool], mildest_codec: str = "none") -> DataFrame:
    """Steps from the mildest corner by factor settings alone, never by an outcome.
    ``harsher`` maps a factor to whether more of it is harsher."""
    steps = []
    out = conditions
    for f, up in harsher.items():
        order = F.col(f).asc() if up else F.col(f).desc()
        steps.append(F.dense_rank().over(Window.orderBy(order)) - 1)
    return out.withColumn("severity", sum(steps, F.lit(0)) + (F.col("codec") != mildest_codec).cast("int"))
