"""Bounded training samples and the small fits that run on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.common import persist

#: Bytes of text that the sample of one class holds at most.
SAMPLE_BYTES = 48 << 20


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, per_class: int, most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """(doc_id, text, y): at most ``per_class`` whole documents of label 0 and of label 1,
    in all at most ``most_bytes`` of each, those whose hashed ids come first; so the choice
    doesn't depend on order or size.

    The chosen ids (at most 2 * per_class rows of two numbers) are broadcast to one scan
    of the documents.  Rows without a label, an id or a text are left out; an id that is
    labelled twice counts once, with its larger label.  Of an id that several documents
    have one is taken, by the hash of its text.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & allowed)
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    chosen = None
    for value in (0, 1):
        part = known.where(F.col("y") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionAll(part)
    found = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    size = F.octet_length("text").cast("long")
    # a text beyond the bound is dropped in the scan, so that the rows that move are bounded
    found = found.where(size <= most_bytes).select("doc_id", "y", size.alias("size"), F.xxhash64("text").alias("hash"), "text")
    one = persist(found.groupBy("doc_id", "y").agg(F.min_by(F.struct("size", "text"), F.struct("hash", "text")).alias("d")).select("doc_id", "y", "d.*"), "labelled")
    total, beyond = {0: 0, 1: 0}, []  # of at most 2 * per_class rows of numbers
    for r in sorted(one.select("doc_id", "y", "size", F.xxhash64("doc_id").alias("h")).collect(), key=lambda r: (r.h, r.doc_id)):
        total[r.y] += r.size
        if total[r.y] > most_bytes:
            beyond.append((r.doc_id,))
    if beyond:
        one = one.join(F.broadcast(docs.sparkSession.createDataFrame(beyond, "doc_id long")), "doc_id", "left_anti")
    return one.select("doc_id", "text", "y")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray, strength: float, rounds: int = 40, balanced: bool = True) -> np.ndarray:
    """Newton's method for logistic regression; the weights are drawn to ``prior``
    (the last one is the constant's) with ``strength``.  Classes weigh the same, unless
    ``balanced`` is false: then each row does."""
    x = np.column_stack([x, np.ones(len(x))])
    w = prior.astype(float).copy()
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y) if balanced else np.ones(len(y))

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((share * (np.logaddexp(0, z) - y * z)).sum() + strength / 2 * ((w - prior) ** 2).sum())

    for _ in range(rounds):
        p = sigmoid(x @ w)
        gradient = x.T @ (share * (p - y)) + strength * (w - prior)
        hessian = (x * (share * p * (1 - p))[:, None]).T @ x + strength * np.eye(len(w))
        step, size, now = np.linalg.solve(hessian, gradient), 1.0, loss(w)
        while size > 1e-6 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-6:
            break
    return w
