"""The bootstrap over units: all replicates of a statistic at once.

A unit (a clip) weighs in each replicate as often as a Poisson number says that is drawn from
a hash of unit, replicate and seed: the same in all its rows, in any order and on any number
of workers.  Rows are summed by unit first; then a batch of units times its matrix of weights
gives partial sums, one vector of replicates for each cell, and these are added up in a tree.
Nothing is exploded by replicate.  Place 0 of a vector is the sample itself (all weights 1).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.session import persist, ship

#: Rows that are weighed at a time, cells that a task holds before it hands them on, partial vectors of a tree's node.
STEP, MOST_CELLS, FAN = 1024, 1024, 32
#: Fewest draws that an interval is made of: so many, and this share of the replicates.
LEAST_DRAWS, LEAST_SHARE = 20, 0.1
# The constants of the 64-bit xxHash.
_P1, _P2, _P3, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
#: Low 30 bits of a hash from which a Poisson number of mean 1 is 1, 2, ... 8.
_FROM = [math.ceil(sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) * (1 << 30)) for k in range(8)]


def _hash_int(value, seed: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of an int, with the hash of what comes before it as seed."""
    h = (seed + _P5 + np.uint64(4)) ^ (np.asarray(value, np.uint64) * _P1)
    h = ((h << np.uint64(23)) | (h >> np.uint64(41))) * _P2 + _P3
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def poisson_matrix(hashes: np.ndarray, replicates: int, seed: int) -> np.ndarray:
    """Weights of units (64-bit hashes) in the sample, column 0, and in every replicate; as
    ``calibration.poisson_weight`` of xxhash64(unit, replicate, seed)."""
    out = np.ones((len(hashes), replicates + 1))
    if len(hashes) and replicates:
        h = _hash_int(seed, _hash_int(np.arange(1, replicates + 1), hashes.astype(np.int64).view(np.uint64)[:, None]))
        low = (h & np.uint64((1 << 30) - 1)).astype(np.int32)
        out[:, 1:] = sum((low >= t).astype(np.int8) for t in _FROM if t < 1 << 30)
    return out


def _vectors(matrix: np.ndarray) -> pa.Array:
    """Rows of a matrix as a list column; NaN as null."""
    flat = pa.array(matrix.ravel(), from_pandas=True)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]), flat)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1) if n else np.zeros((0, 0))


def _kinds(df: DataFrame, columns: list[str]) -> str:
    return "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in columns)


def added_up(parts: DataFrame, cells: list[str], values: list[str]) -> DataFrame:
    """(cells, one vector for each value): partial vectors of tasks (their number in ``_node``)
    added up in two steps, of which the first joins every FAN-th task's."""
    ddl = f"{_kinds(parts, cells)}_node int, " + ", ".join(f"`{v}` array<double>" for v in values)

    def added(part: pa.Table) -> pa.Table:
        keys = [part.column(c).slice(0, 1) for c in cells]
        return pa.Table.from_arrays([*keys, pa.array([0], pa.int32()), *(_vectors(_matrix(part.column(v)).sum(axis=0)[None, :]) for v in values)], names=[*cells, "_node", *values])

    out = parts.groupBy(*cells, F.pmod("_node", F.lit(FAN))).applyInArrow(added, ddl)
    return out.groupBy(*cells).applyInArrow(added, ddl).drop("_node")


def replicate_sums(rows: DataFrame, unit: str, cells: list[str], values: list[str], replicates: int = 1000, seed: int = 5) -> DataFrame:
    """(cells, one vector for each value): its sum over each cell's rows in the sample and in
    every replicate.  Values must not be null.  A task holds at most MOST_CELLS cells'
    vectors; the result has a row for each cell."""
    ship(rows.sparkSession)
    by = rows.groupBy(unit, *cells).agg(*[F.sum(v).cast("double").alias(v) for v in values])
    # a unit's rows (one a cell) side by side, so that its weights are drawn once
    x = by.select(*cells, F.xxhash64(unit).alias("_h"), *values).repartition("_h").sortWithinPartitions("_h")
    ddl = f"{_kinds(x, cells)}_node int, " + ", ".join(f"`{v}` array<double>" for v in values)
    size, n = replicates + 1, len(cells)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places: dict[tuple, int] = {}
        sums = np.zeros((0, len(values), size))
        node = TaskContext.get().partitionId()

        def handed_on() -> pa.RecordBatch:
            keys = [pa.array([k[i] for k in places], kinds[i]) for i in range(n)]
            return pa.RecordBatch.from_arrays([*keys, pa.array([node] * len(places), pa.int32()), *(_vectors(sums[: len(places), v]) for v in range(len(values)))], [*cells, "_node", *values])

        for batch in batches:
            kinds = [batch.column(i).type for i in range(n)]
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(n)), strict=True)) if n else [()] * batch.num_rows
            hashes = batch.column(n).to_numpy()
            amounts = np.array([batch.column(n + 1 + v).to_numpy() for v in range(len(values))]).reshape(len(values), -1)
            for lo in range(0, batch.num_rows, STEP):
                hi = min(lo + STEP, batch.num_rows)
                if len(places) > MOST_CELLS:
                    yield handed_on()
                    places.clear()
                    sums[:] = 0
                code = np.array([places.setdefault(k, len(places)) for k in keys[lo:hi]])
                if len(places) > len(sums):
                    sums = np.concatenate([sums, np.zeros((max(len(places), 2 * len(sums)) - len(sums), *sums.shape[1:]))])
                mine, at = np.unique(code, return_inverse=True)
                units, of = np.unique(hashes[lo:hi], return_inverse=True)
                weights = poisson_matrix(units, replicates, seed)
                for v in range(len(values)):
                    spread = np.zeros((len(mine), len(units)))
                    np.add.at(spread, (at, of), amounts[v, lo:hi])
                    sums[mine, v] += spread @ weights
        if places:
            yield handed_on()

    return added_up(x.mapInArrow(partial, ddl), cells, values)


# ------------------------------------------------------------------ ranks

_PARTS = ["good", "bad", "wins", "first_good", "first_bad", "last_good", "last_bad"]


def _joined(x: dict | None, y: dict) -> dict:
    """Two stretches of scores in order, as one; they may share the score where they meet."""
    if x is None:
        return y
    tie = x["high"] == y["low"]
    out = {"low": x["low"], "high": y["high"], "good": x["good"] + y["good"], "bad": x["bad"] + y["bad"]}
    out["wins"] = x["wins"] + y["wins"] + y["good"] * x["bad"]
    if tie:  # such pairs count half, whichever side the good one is on
        out["wins"] = out["wins"] + (x["last_good"] * y["first_bad"] - y["first_good"] * x["last_bad"]) / 2
    for c in ("good", "bad"):
        out[f"first_{c}"] = x[f"first_{c}"] + (y[f"first_{c}"] if tie and x["low"] == x["high"] else 0)
        out[f"last_{c}"] = y[f"last_{c}"] + (x[f"last_{c}"] if tie and y["low"] == y["high"] else 0)
    return out


def _stretch(scores: np.ndarray, good: np.ndarray, bad: np.ndarray, weights: np.ndarray) -> dict:
    """Sorted scores: weights of good and bad units and the good ones' wins, by replicate."""
    starts = np.flatnonzero(np.concatenate([[True], scores[1:] != scores[:-1]]))
    g, b = np.add.reduceat(good[:, None] * weights, starts), np.add.reduceat(bad[:, None] * weights, starts)
    below = np.cumsum(b, axis=0) - b
    return {"low": scores[0], "high": scores[-1], "good": g.sum(axis=0), "bad": b.sum(axis=0), "wins": (g * (below + b / 2)).sum(axis=0), "first_good": g[0], "first_bad": b[0], "last_good": g[-1], "last_bad": b[-1]}


def replicate_auroc(rows: DataFrame, keys: list[str], score: str, good: Column, unit: str, replicates: int = 1000, seed: int = 5) -> DataFrame:
    """(keys, n_good, n_bad, auroc): Mann-Whitney's area, ties counting half, as a vector over
    the sample and the replicates; null in a replicate that draws one class only.  Rows whose
    score is null or not finite are left out.

    Rows are counted by score and unit and sorted over ranges; each range gives one stretch a
    key, and neighbouring stretches are joined, also where they share a score.  So neither
    distinct scores nor the units of one score need to fit in a task."""
    ship(rows.sparkSession)
    label = good.cast("int")
    x = rows.where(F.col(score).isNotNull() & ~F.isnan(score) & (F.abs(score) < float("inf")))
    # -0.0 is 0.0, and stays so in Python
    x = x.groupBy(*keys, (F.col(score).cast("double") + F.lit(0.0)).alias("_s"), unit).agg(F.sum(label).alias("_good"), F.sum(1 - label).alias("_bad"))
    x = x.select(*keys, "_s", F.xxhash64(unit).alias("_h"), F.coalesce("_good", F.lit(0)).cast("double").alias("_g"), F.coalesce("_bad", F.lit(0)).cast("double").alias("_b"))
    order = [*keys, "_s", "_h"]
    n = len(keys)
    ddl = f"{_kinds(x, keys)}_part int, low double, high double, " + ", ".join(f"{c} array<double>" for c in _PARTS)

    def row_of(key: tuple, kinds: list, part: int, s: dict) -> pa.RecordBatch:
        columns = [pa.array([k], t) for k, t in zip(key, kinds, strict=True)]
        columns += [pa.array([part], pa.int32()), pa.array([float(s["low"])]), pa.array([float(s["high"])]), *(_vectors(s[c][None, :]) for c in _PARTS)]
        return pa.RecordBatch.from_arrays(columns, [*keys, "_part", "low", "high", *_PARTS])

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, held, kinds = TaskContext.get().partitionId(), None, None, []
        for batch in batches:
            kinds = [batch.column(i).type for i in range(n)]
            names = list(zip(*(batch.column(i).to_pylist() for i in range(n)), strict=True)) if n else [()] * batch.num_rows
            s, h, g, b = (batch.column(n + i).to_numpy() for i in range(4))
            lo = 0
            while lo < len(names):
                hi = lo + 1
                while hi < min(len(names), lo + STEP) and names[hi] == names[lo]:
                    hi += 1
                if held is not None and names[lo] != last:
                    yield row_of(last, kinds, part, held)
                    held = None
                last, held = names[lo], _joined(held, _stretch(s[lo:hi], g[lo:hi], b[lo:hi], poisson_matrix(h[lo:hi], replicates, seed)))
                lo = hi
        if held is not None:
            yield row_of(last, kinds, part, held)

    def joined(table: pa.Table) -> pa.Table:
        table = table.sort_by("_part")
        vectors, low, high = {c: _matrix(table.column(c)) for c in _PARTS}, table.column("low").to_numpy(), table.column("high").to_numpy()
        out = None
        for i in range(table.num_rows):
            out = _joined(out, {"low": low[i], "high": high[i], **{c: vectors[c][i] for c in _PARTS}})
        key = [table.column(c)[0].as_py() for c in keys]
        return pa.Table.from_batches([row_of(tuple(key), [table.column(c).type for c in keys], table.column("_part")[0].as_py(), out)])

    out = x.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(stretches, ddl)
    out = out.groupBy(*keys, F.floor(F.col("_part") / FAN)).applyInArrow(joined, ddl)
    out = out.groupBy(*keys).applyInArrow(joined, ddl)
    pairs = F.zip_with("good", "bad", lambda g, b: g * b)
    return out.select(*keys, F.element_at("good", 1).cast("long").alias("n_good"), F.element_at("bad", 1).cast("long").alias("n_bad"), F.zip_with("wins", pairs, F.try_divide).alias("auroc"))


# ------------------------------------------------------------------ intervals


def sorted_quantile(a: Column, q: float) -> Column:
    """A quantile of a sorted array without nulls, by linear interpolation; null if empty."""
    n = F.size(a)
    h = (n - 1) * F.lit(q)
    low = F.floor(h).cast("int")
    below, above = F.get(a, low), F.get(a, F.least(low + 1, n - 1))
    return F.when(n > 0, below + (above - below) * (h - low))


def interval(vector: Column, level: float = 0.95, least_draws: int = 1, least_share: float = 0.0) -> Column:
    """(estimate, low, high) of a vector: its place 0 and percentiles of the replicates that
    aren't null; no interval where fewer are left than ``least_draws`` or that share of them."""
    draws = F.slice(vector, 2, F.greatest(F.size(vector) - 1, F.lit(0)))
    left = F.array_sort(F.filter(draws, lambda x: x.isNotNull() & ~F.isnan(x)))
    enough = F.size(left) >= F.greatest(F.lit(float(least_draws)), F.size(draws) * F.lit(least_share))
    edge = (1 - level) / 2
    return F.struct(F.get(vector, F.lit(0)).alias("estimate"), F.when(enough, sorted_quantile(left, edge)).alias("low"), F.when(enough, sorted_quantile(left, 1 - edge)).alias("high"))


def bootstrap_mean(rows: DataFrame, unit: str, value: str, replicates: int = 1000, seed: int = 5, level: float = 0.95, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, mean, n_units, low, high): mean and percentile interval over resampled units."""
    x = rows.where(F.col(value).isNotNull()).select(*keys, unit, F.col(value).alias("_s"), F.lit(1.0).alias("_n"))
    sums = replicate_sums(x, unit, list(keys), ["_s", "_n"], replicates, seed)
    found = sums.select(*keys, interval(F.zip_with("_s", "_n", F.try_divide), level).alias("i"))
    units = x.groupBy(*keys).agg(F.count_distinct(F.coalesce(F.col(unit).cast("string"), F.lit(""))).alias("n_units"))
    whole = units.join(found, list(keys), "left") if keys else units.join(found, how="left")  # one row each without keys
    return whole.select(*keys, F.col("i.estimate").alias("mean"), "n_units", F.col("i.low").alias("low"), F.col("i.high").alias("high"))


def separation_intervals(rows: DataFrame, keys: list[str], scores: list[str], good: Column, unit: str, baseline: str, replicates: int = 1000, seed: int = 5, level: float = 0.95) -> DataFrame:
    """How well each score tells good rows from bad, with intervals, and whether that is more
    or less than the baseline's: (keys, score_name, n_good, n_bad, auroc, low, high, delta,
    delta_low, delta_high, beats, loses, rank).

    A difference is paired: both areas are of the same replicate, that is of the same units.
    A replicate with one class only is left out, and there is no interval where fewer than
    LEAST_DRAWS of them or LEAST_SHARE are left.  The rank is by area (null last, then name)."""
    label = good.cast("int").alias("_good")
    parts = F.explode(F.array(*[F.struct(F.lit(n).alias("score_name"), F.col(n).cast("double").alias("_score")) for n in scores])).alias("_p")
    x = rows.select(*keys, unit, label, parts).select(*keys, unit, "_good", "_p.*")
    # written once: they are read as such and as the baseline
    areas = persist(replicate_auroc(x, [*keys, "score_name"], "_score", F.col("_good"), unit, replicates, seed), "areas")
    base = areas.where(F.col("score_name") == baseline).select(*keys, F.col("auroc").alias("_base"))
    both = areas.join(base, keys, "left") if keys else areas.join(base, how="left")
    delta = F.when(F.col("score_name") != baseline, F.zip_with("auroc", "_base", lambda a, b: a - b))
    both = both.select(*keys, "score_name", "n_good", "n_bad", interval(F.col("auroc"), level, LEAST_DRAWS, LEAST_SHARE).alias("a"), interval(delta, level, LEAST_DRAWS, LEAST_SHARE).alias("d"))
    out = both.select(
        *keys, "score_name", "n_good", "n_bad", F.col("a.estimate").alias("auroc"), F.col("a.low").alias("low"), F.col("a.high").alias("high"), F.col("d.estimate").alias("delta"), F.col("d.low").alias("delta_low"), F.col("d.high").alias("delta_high"),
        F.coalesce(F.col("d.low") > 0, F.lit(False)).alias("beats"), F.coalesce(F.col("d.high") < 0, F.lit(False)).alias("loses"),
    )
    order = F.struct(F.col("auroc").isNull().alias("none"), (-F.col("auroc")).alias("area"), "score_name")
    places = out.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col("score_name").alias("s")))).alias("_all"))  # a few scores a key
    out = out.join(places, keys) if keys else out.join(places)
    return out.withColumn("rank", F.array_position(F.transform("_all", lambda p: p["s"]), F.col("score_name")).cast("int")).drop("_all")
