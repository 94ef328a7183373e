"""Calibration over many splits: every model and seed fitted at once.

Which groups train under a seed is told by the hash of the last one that does, so a row knows
its seeds without a join.  Rows equal in model, confidence and features are counted once, with
their number in every seed's training half, and all that follows passes over these counts.  A
Newton step is one pass: each batch adds its Gram matrix and gradient to those of every (model,
seed), and tasks' sums are added up in a tree.  What reaches the driver is one vector for each
model and seed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks import schema as S
from gaugeworks.functions.numeric import logit
from gaugeworks.operators import calibration, resampling
from gaugeworks.session import persist, ship

#: Seeds of a report (fixed values); most seeds, Newton steps, and the step that ends them.
SEEDS, MOST_SEEDS, ROUNDS, SMALL_STEP = (0, 1, 2, 3, 4), 62, 40, 1e-9
#: Bits of a group's hash by which groups are counted before any are put in order.
_COARSE = 12


def last_in_training(groups: DataFrame, model: str, group: str, seeds: tuple[int, ...], share: float) -> DataFrame:
    """(model, ends): for every seed, in their order, the (seed's place, hash, group) of the last
    group to train, as ``calibration.grouped_split`` within each model: round(n * share) groups
    train, those whose hashes come first, at least one on each side.  ``groups`` are distinct.

    Groups are counted by their hashes' first bits; only those that share them with the last
    group to train are put in order."""
    if len(seeds) > MOST_SEEDS:
        raise ValueError(f"more than {MOST_SEEDS} seeds")
    hashed = groups.select(model, group, F.explode(F.array(*[F.struct(F.lit(i).alias("seed"), F.xxhash64(group, F.lit(s)).alias("hash")) for i, s in enumerate(seeds)])).alias("h")).select(model, group, "h.*")
    hashed = hashed.withColumn("_c", F.shiftright("hash", 64 - _COARSE))
    coarse = hashed.groupBy(model, "seed", "_c").agg(F.count("*").alias("_m"))  # at most 2^_COARSE rows for a model and seed
    each = Window.partitionBy(model, "seed")
    coarse = coarse.select("*", F.sum("_m").over(each).alias("_n"), (F.sum("_m").over(each.orderBy("_c")) - F.col("_m")).alias("_before"))
    part = F.col("_n") * F.lit(share)
    k = F.least(F.greatest(F.round(part - F.when(part % 1 == 0.5, (F.floor(part) + 1) % 2).otherwise(0)), F.lit(1)), F.greatest(F.col("_n") - 1, F.lit(1)))  # halves to even, as round
    torn = coarse.withColumn("_left", k.cast("long") - F.col("_before")).where("_left > 0 and _left <= _m").select(model, "seed", "_c", "_left")
    place = F.row_number().over(Window.partitionBy(model, "seed").orderBy("hash", group))
    last = hashed.join(F.broadcast(torn), [model, "seed", "_c"]).withColumn("_place", place).where("_place = _left")  # torn: one row for a model and seed
    return last.groupBy(model).agg(F.array_sort(F.collect_list(F.struct("seed", "hash", F.col(group).alias("group")))).alias("ends"))


def _trains(group: str, place: int, seed: int) -> Column:
    """Whether a row with its model's ``ends`` trains under a seed."""
    end = F.get("ends", F.lit(place))
    h = F.xxhash64(group, F.lit(seed))
    return (h < end["hash"]) | ((h == end["hash"]) & (F.col(group) <= end["group"]))


def split_masks(rows: DataFrame, model: str, group: str, seeds: tuple[int, ...], share: float) -> DataFrame:
    """(model, group, mask): bit k tells that the group trains under the k-th seed."""
    groups = persist(rows.select(model, group).distinct(), "groups")
    ends = F.broadcast(last_in_training(groups, model, group, seeds, share))  # one row a model
    bits = [F.when(_trains(group, i, s), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, s in enumerate(seeds)]
    return groups.join(ends, model).select(model, group, sum(bits[1:], bits[0]).alias("mask"))


def training_counts(rows: DataFrame, conf: str, correct: str, features: list[str], model: str, group: str, seeds: tuple[int, ...], share: float) -> DataFrame:
    """(model, _conf, _z, _f0, ..., n, y, n0, y0, ...): how many rows a model has of one confidence
    and one set of features, and the sum of their labels; of all and of those that train under
    each seed.  That is all that errors and likelihoods of the splits need."""
    ends = last_in_training(persist(rows.select(model, group).distinct(), "groups"), model, group, seeds, share)
    x = rows.join(F.broadcast(persist(ends, "ends")), model)  # one row a model
    fs = [f"_f{i}" for i in range(len(features))]
    x = x.select(F.col(model).cast("string").alias("model"), F.col(conf).cast("double").alias("_conf"), *[F.col(f).cast("double").alias(k) for f, k in zip(features, fs, strict=True)], F.col(correct).cast("double").alias("_y"), *[_trains(group, i, s).alias(f"_t{i}") for i, s in enumerate(seeds)])
    sums = [F.count("*").cast("double").alias("n"), F.sum("_y").alias("y")]
    for i in range(len(seeds)):
        sums += [F.count_if(f"_t{i}").cast("double").alias(f"n{i}"), F.sum(F.when(F.col(f"_t{i}"), F.col("_y")).otherwise(0.0)).alias(f"y{i}")]
    out = x.groupBy("model", "_conf", *fs).agg(*sums)
    return out.select("model", "_conf", logit(F.col("_conf")).alias("_z"), *fs, "n", "y", *[f"{c}{i}" for i in range(len(seeds)) for c in "ny"])


def _vector_pass(counts: DataFrame, d: int, n_seeds: int, work: Callable[..., np.ndarray | None]) -> dict[tuple[str, int], np.ndarray]:
    """Adds up ``work`` (model, seed's place, d features, confidence, and numbers of rows and sums
    of labels: in all, in training) over all counts: a vector for each model and seed."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            coded = batch.column(0).dictionary_encode()
            code = coded.indices.to_numpy(zero_copy_only=False)
            columns = np.array([batch.column(k).to_numpy(zero_copy_only=False) for k in range(1, batch.num_columns)])
            for at, name in enumerate(coded.dictionary.to_pylist()):
                mine = columns[:, code == at]
                conf, x, n, y = mine[0], mine[1 : d + 1].T, mine[d + 1], mine[d + 2]
                for seed in range(n_seeds):
                    v = work(name, seed, x, conf, n, y, mine[d + 3 + 2 * seed], mine[d + 4 + 2 * seed])
                    if v is not None:
                        sums[name, seed] = sums.get((name, seed), 0) + v
        if sums:
            node = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in sums]), pa.array([s for _, s in sums], pa.int32()), pa.array([node] * len(sums), pa.int32()), resampling._vectors(np.array(list(sums.values())))], ["model", "seed", "_node", "v"])

    parts = counts.mapInArrow(partial, "model string, seed int, _node int, v array<double>")
    return {(r.model, r.seed): np.array(r.v, float) for r in resampling.added_up(parts, ["model", "seed"], ["v"]).collect()}


def calibration_seeds(rows: DataFrame, conf: str, correct: str, features: list[str], *, model: str = "model", group: str = "clip_id", seeds: tuple[int, ...] = SEEDS, share: float = 0.5, c: float = 10.0, bins: int = S.ECE_BINS, discount_at: dict[str, float] | None = None, by_temperature: bool = True) -> DataFrame:
    """(model, seed, n_train, n_test, ece_raw, ece_temperature, ece_feature, temperature, and
    for each factor of ``discount_at`` discount_<factor>): held-out calibration errors of the
    raw confidence, of a temperature and of a logistic regression on its logit and condition
    features, under every seed's split by whole groups within every model.

    A discount is how much the regression takes off the raw confidence on average, over
    held-out rows at the factor's level or beyond; null where there is none.  Without
    ``by_temperature`` no temperature is sought, and its two columns are null.  Rows without
    confidence, label or a feature are left out.  The regression is that of
    ``calibration.fit_feature_calibrator``.  ``rows`` are passed over twice."""
    spark = ship(rows.sparkSession)
    wanted = [conf, correct, *features]
    fine = rows.where(" and ".join([f"`{k}` is not null" for k in [*wanted, model, group]]))
    counts = persist(training_counts(fine, conf, correct, features, model, group, seeds, share), "counts")
    n_seeds, d, levels = len(seeds), len(features) + 1, {features.index(f) + 1: v for f, v in (discount_at or {}).items()}
    temperature = {}
    if by_temperature:
        each = F.explode(F.array(*[F.struct(F.lit(i).alias("seed"), F.col(f"n{i}").alias("n"), F.col(f"y{i}").alias("n_correct")) for i in range(n_seeds)])).alias("s")
        by = counts.select("model", "_conf", each).select("model", "_conf", "s.*").where("n > 0").groupBy("model", "seed", "_conf").agg(F.sum("n").alias("n"), F.sum("n_correct").alias("n_correct"))
        temperature = {(r.model, r.seed): r.temperature for r in calibration.temperatures(persist(by, "by"), ["model", "seed"], "_conf").collect()}

    def moments(_, __, x, ___, ____, _____, n, ______):
        return np.concatenate([[n.sum()], n @ x])

    first = _vector_pass(counts, d, n_seeds, moments)
    mean = {k: v[1:] / max(v[0], 1) for k, v in first.items()}

    def spread(name, seed, x, _, __, ___, n, ____):  # about the mean, so that no digits are lost
        return n @ np.square(x - mean[name, seed])

    scale = {k: np.sqrt(v / max(first[k][0], 1)) for k, v in _vector_pass(counts, d, n_seeds, spread).items()}
    scale = {k: np.where(v > 0, v, 1.0) for k, v in scale.items()}
    weights = {k: np.zeros(d + 1) for k in first}
    penalty = np.append(np.full(d, 1 / c), 0.0)

    def scaled(name, seed, x):
        return np.column_stack([(x - mean[name, seed]) / scale[name, seed], np.ones(len(x))])

    def chance(name, seed, u):
        return 1 / (1 + np.exp(-np.clip(u @ weights[name, seed], -700, 700)))

    live = set(first)
    for _ in range(ROUNDS):

        def step(name, seed, x, _, __, ___, n, y):
            if (name, seed) not in live:
                return None
            u = scaled(name, seed, x)
            p = chance(name, seed, u)
            return np.concatenate([(u * (n * p * (1 - p))[:, None]).T.dot(u).ravel(), u.T @ (y - n * p)])

        for k, v in _vector_pass(counts, d, n_seeds, step).items():
            gram, slope = v[: (d + 1) ** 2].reshape(d + 1, d + 1), v[(d + 1) ** 2 :]
            move = np.linalg.lstsq(gram + np.diag(penalty), slope - penalty * weights[k], rcond=None)[0]
            move *= min(1.0, 5 / max(np.abs(move).max(), 1e-300))  # a step too far is cut short
            weights[k] = weights[k] + move
            if np.abs(move).max() < SMALL_STEP:
                live.discard(k)
        if not live:
            break

    def errors(name, seed, x, conf, n, y, n_train, y_train):
        n, y = n - n_train, y - y_train  # held out
        t = 1 / (1 + np.exp(-x[:, 0] / temperature.get((name, seed), 1.0)))
        f, out = chance(name, seed, scaled(name, seed, x)), [np.array([n_train.sum(), n.sum()])]
        for p in (conf, t, f):
            at = np.clip(np.floor(p * bins), 0, bins - 1).astype(int)
            out += [np.bincount(at, w, bins) for w in (n, n * p, y)]
        for k, level in levels.items():
            there = n * (x[:, k] >= level)
            out.append(np.array([there.sum(), there @ (conf - f)]))
        return np.concatenate(out)

    out = []
    for (name, k), v in sorted(_vector_pass(counts, d, n_seeds, errors).items()):
        row = [name, int(seeds[k]), int(v[0]), int(v[1])]
        for part, asked in zip(v[2 : 2 + 9 * bins].reshape(3, 3, bins), (True, by_temperature, True), strict=True):
            row.append(float(np.abs(part[1] - part[2]).sum() / v[1]) if asked and v[1] else None)
        row.append(temperature.get((name, k)))
        row += [float(t / n) if n else None for n, t in v[2 + 9 * bins :].reshape(-1, 2)]
        out.append(row)
    more = "".join(f", `discount_{f}` double" for f in (discount_at or {}))
    return spark.createDataFrame(out, f"model string, seed int, n_train long, n_test long, ece_raw double, ece_temperature double, ece_feature double, temperature double{more}")


def seed_bands(found: DataFrame, columns: list[str]) -> DataFrame:
    """(model, statistic, n_seeds, low, median, high) of columns of ``calibration_seeds``."""
    parts = F.explode(F.array(*[F.struct(F.lit(c).alias("statistic"), F.col(c).alias("x")) for c in columns])).alias("p")
    return found.select("model", parts).select("model", "p.*").groupBy("model", "statistic").agg(F.count("x").alias("n_seeds"), F.min("x").alias("low"), F.median("x").alias("median"), F.max("x").alias("high"))
