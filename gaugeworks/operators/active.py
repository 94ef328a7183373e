"""Active learning of a failure contour: designs, a Gaussian process, acquisition, curves.

A run works on a few dozen points, so it is numpy on one core; independent runs (seeds)
are spread over the cluster as groups of a seed table.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeworks.schema import InsufficientSeedsError

CONTOUR, BAND, KAPPA = 0.5, 0.15, 1.96


def latin_hypercube(n: int, k: int, seed: int) -> np.ndarray:
    """n points in the unit cube, one in each of n strata along every axis."""
    rng = np.random.default_rng(seed)
    return (np.argsort(rng.random((k, n)), axis=1).T + rng.random((n, k))) / n


def halton(n: int, k: int, seed: int) -> np.ndarray:
    """A scrambled low-discrepancy pool: Halton points shifted by a seeded offset."""
    bases, out = [2, 3, 5, 7, 11, 13, 17, 19][:k], np.zeros((n, k))
    for j, b in enumerate(bases):
        i, f = np.arange(1, n + 1), 1.0
        while i.any():
            f /= b
            out[:, j] += f * (i % b)
            i //= b
    return (out + np.random.default_rng(seed).random(k)) % 1.0


def plackett_burman(factors: int) -> np.ndarray:
    """A two-level screening design of +-1 with at least ``factors`` + 1 runs, from
    quadratic residues (runs of 4, 8, 12, 20 or 24)."""
    runs = next(r for r in (4, 8, 12, 20, 24) if r > factors)
    q = runs - 1
    squares = {i * i % q for i in range(1, q)}
    row = np.array([1] + [1 if i in squares else -1 for i in range(1, q)])
    design = np.array([[row[(j - i) % q] for j in range(q)] for i in range(q)])
    return np.vstack([design, -np.ones(q, int)])[:, :factors]


class GaussianProcess:
    """Matern 5/2 with a length for each axis and noise, on the unit cube.  Lengths and
    noise maximize the marginal likelihood over a coordinate search on a log grid."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> GaussianProcess:
        self.x, self.mean, self.scale = np.asarray(x, float), float(np.mean(y)), float(np.std(y)) or 1.0
        z, k = (np.asarray(y, float) - self.mean) / self.scale, x.shape[1]
        best, params = -np.inf, np.r_[np.full(k, 0.5), 1e-2]
        grids = [np.geomspace(0.05, 5, 9)] * k + [np.geomspace(1e-5, 0.1, 5)]
        for _ in range(2):
            for j, grid in enumerate(grids):
                for value in grid:
                    trial = params.copy()
                    trial[j] = value
                    if (fit := self._likelihood(z, trial)) > best:
                        best, params = fit, trial
        self.likelihood, self.params = best, params
        self.factor = np.linalg.cholesky(self._kernel(self.x, self.x, params) + (params[-1] + 1e-9) * np.eye(len(z)))
        self.alpha = np.linalg.solve(self.factor.T, np.linalg.solve(self.factor, z))
        return self

    @staticmethod
    def _kernel(a: np.ndarray, b: np.ndarray, params: np.ndarray) -> np.ndarray:
        r = np.sqrt(5 * np.square((a[:, None] - b[None]) / params[:-1]).sum(axis=2))
        return (1 + r + r * r / 3) * np.exp(-r)

    def _likelihood(self, z: np.ndarray, params: np.ndarray) -> float:
        try:
            c = np.linalg.cholesky(self._kernel(self.x, self.x, params) + (params[-1] + 1e-9) * np.eye(len(z)))
        except np.linalg.LinAlgError:
            return -np.inf
        v = np.linalg.solve(c, z)
        return float(-0.5 * v @ v - np.log(np.diag(c)).sum())

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = self._kernel(np.asarray(x, float), self.x, self.params)
        v = np.linalg.solve(self.factor, k.T)
        sd = np.sqrt(np.maximum(1 + self.params[-1] - np.square(v).sum(axis=0), 1e-12))
        return self.mean + self.scale * (k @ self.alpha), self.scale * sd


def acquire(gp: GaussianProcess, candidates: np.ndarray, taken: np.ndarray, strategy: str = "boundary", contour: float = CONTOUR) -> int:
    """The next candidate: near the contour and uncertain ('boundary'), or the most
    uncertain ('uncertainty'); points already taken are left out."""
    mean, sd = gp.predict(candidates)
    score = {"boundary": KAPPA * sd - np.abs(mean - contour), "uncertainty": sd}[strategy]
    near = np.sqrt(np.square(candidates[:, None] - taken[None]).sum(axis=2)).min(axis=1) <= 1e-3
    return int(np.argmax(np.where(near, -np.inf, score)))


def run_arm(oracle: Callable[[np.ndarray], float], k: int, seed: int, arm: str, n_seed: int = 8, budget: int = 30, pool: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Points and values in the order they were asked for."""
    if arm == "random":
        x = np.random.default_rng(seed).random((budget, k))
        return x, np.array([oracle(p) for p in x])
    x = latin_hypercube(n_seed, k, seed)
    y = np.array([oracle(p) for p in x])
    candidates = halton(pool, k, seed)
    while len(x) < budget:
        p = candidates[acquire(GaussianProcess().fit(x, y), candidates, x, arm)]
        x, y = np.vstack([x, p]), np.append(y, oracle(p))
    return x, y


def learning_curve(x: np.ndarray, y: np.ndarray, test_x: np.ndarray, test_y: np.ndarray, start: int, every: int = 3) -> pd.DataFrame:
    """Fidelity after the first n points: error near the contour, share of points on its
    wrong side, and overall error."""
    out = []
    for n in sorted({*range(start, len(x) + 1, every), len(x)}):
        mean, _ = GaussianProcess().fit(x[:n], y[:n]).predict(test_x)
        near = np.abs(test_y - CONTOUR) <= BAND
        out.append((n, float(np.sqrt(np.square(mean - test_y)[near].mean())) if near.any() else None, float(((mean >= CONTOUR) != (test_y >= CONTOUR)).mean()), float(np.sqrt(np.square(mean - test_y).mean()))))
    return pd.DataFrame(out, columns=["n_evals", "boundary_rmse", "boundary_error", "rmse"])


def curves(spark: SparkSession, oracle: Callable[[np.ndarray], float], k: int, seeds: list[int], arms: tuple[str, ...] = ("boundary", "random"), n_seed: int = 8, budget: int = 30) -> DataFrame:
    """Learning curves of every seed and arm, one task each: (seed, arm, n_evals, ...).
    Fewer than three distinct seeds raise."""
    if len(set(seeds)) < 3 or len(set(seeds)) != len(seeds):
        raise InsufficientSeedsError(f"{seeds} aren't three distinct seeds")
    test_x = halton(200, k, 10_007)
    test_y = np.array([oracle(p) for p in test_x])

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        seed, arm = int(rows.seed.iloc[0]), rows.arm.iloc[0]
        c = learning_curve(*run_arm(oracle, k, seed, arm, n_seed, budget), test_x, test_y, n_seed)
        return c.assign(seed=seed, arm=arm)[["seed", "arm", *c.columns]]

    plan = spark.createDataFrame(list(product(seeds, arms)), "seed long, arm string")
    return plan.groupBy("seed", "arm").applyInPandas(work, "seed long, arm string, n_evals long, boundary_rmse double, boundary_error double, rmse double")


def best_so_far(curve: DataFrame, metric: str = "boundary_rmse") -> DataFrame:
    """The least value up to each number of evaluations."""
    over = Window.partitionBy("seed", "arm").orderBy("n_evals").rowsBetween(Window.unboundedPreceding, 0)
    return curve.withColumn("best", F.min(metric).over(over))


def evals_to_target(best: DataFrame, target: float) -> DataFrame:
    """The first number of evaluations at which a run reaches the target; NULL if never."""
    return best.groupBy("seed", "arm").agg(F.min(F.when(F.col("best") <= target, F.col("n_evals"))).alias("n_to_target"))


def seed_band(best: DataFrame) -> DataFrame:
    """Median and range over seeds at each number of evaluations."""
    return best.groupBy("arm", "n_evals").agg(F.median("best").alias("median"), F.min("best").alias("low"), F.max("best").alias("high"), F.count("*").alias("n_seeds"))


def savings(to_target: DataFrame, active: str = "boundary", passive: str = "random") -> DataFrame:
    """Median evaluations by arm, 'never' counting as infinite, and how many seeds got there."""
    n = F.coalesce(F.col("n_to_target").cast("double"), F.lit(float("inf")))
    return to_target.where(F.col("arm").isin(active, passive)).groupBy("arm").agg(F.count("*").alias("n_seeds"), F.count("n_to_target").alias("n_reached"), F.sort_array(F.collect_list(n)).alias("_n")).select("arm", "n_seeds", "n_reached", F.try_element_at("_n", ((F.col("n_seeds") + 1) / 2).cast("int")).alias("median_evals")).withColumn("median_evals", F.when(F.col("median_evals") < float("inf"), F.col("median_evals")))


def permutation_rank(score: Callable[[tuple[int, ...]], float], n: int) -> tuple[int, float]:
    """Rank of the identity among all orders of n things by score (least first), and p."""
    from itertools import permutations

    scores = {p: score(p) for p in permutations(range(n))}
    own = scores[tuple(range(n))]
    rank = sum(s <= own for s in scores.values())
    return rank, rank / len(scores)


def acquisition_concentration(points: DataFrame) -> DataFrame:
    """The share of each run's points (seed, arm, y) near the contour; medians by arm."""
    near = points.groupBy("seed", "arm").agg(F.avg((F.abs(F.col("y") - CONTOUR) <= BAND).cast("int")).alias("share"))
    return near.groupBy("arm").agg(F.median("share").alias("median_share"), F.count("*").alias("n_seeds"))


def propose_dips(gp: GaussianProcess, levels: list[list[float]], axis: int, top: int = 5) -> list[tuple[tuple[float, ...], float]]:
    """Cells of a grid where the surrogate has an interior minimum along an axis: more
    degradation, less error.  Deepest first, with depth; these are proposals only."""
    grid = np.array(list(product(*levels)))
    mean = gp.predict(grid)[0].reshape([len(v) for v in levels])
    mean = np.moveaxis(mean, axis, 0)
    depth = np.minimum(mean[:-2], mean[2:]) - mean[1:-1]
    full = np.moveaxis(np.pad(depth, [(1, 1)] + [(0, 0)] * (depth.ndim - 1), constant_values=-np.inf), 0, axis).ravel()
    return [(tuple(grid[k].tolist()), float(full[k])) for k in np.argsort(-full, kind="stable")[:top] if full[k] > 0]


def confirm_dips(proposed: list[tuple[tuple[float, ...], float]], levels: list[list[float]], axis: int, oracle: Callable[[tuple[float, ...]], float], eps: float = 0.02) -> list[tuple[tuple[float, ...], str]]:
    """CONFIRMED where the measured neighbours lie above the cell by more than ``eps``, else
    REFUTED."""
    out = []
    for cell, _ in proposed:
        k = levels[axis].index(cell[axis])
        beside = [oracle((*cell[:axis], levels[axis][j], *cell[axis + 1 :])) for j in (k - 1, k + 1)]
        out.append((cell, "CONFIRMED" if min(beside) - oracle(cell) > eps else "REFUTED"))
    return out
