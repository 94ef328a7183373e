"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of 512 bytes.  Each passage is encoded by figures of
its bytes and words; a hidden layer embeds it; gated attention (a tanh unit times a
sigmoid unit, then a softmax over the document's passages) weighs the embeddings, and
a logistic unit scores their weighted sum.  Attention is learned from document labels
alone.

Training runs on the driver over the figures of a bounded sample of whole documents
(``PER_CLASS`` a class, of at most ``MOST_PASSAGES`` passages).  Scoring is one scan
without a shuffle: every passage of every whole text is encoded in bulk.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.chunks import BLANKS
from gaugeworks.llm.common import byte_class, hash_runs, runs, slices, tune
from gaugeworks.llm.training import sigmoid

#: Documents and passages of a class that are learned from at most.
PER_CLASS, MOST_PASSAGES = 3000, 30_000
PASSAGE = 512
HIDDEN, ATTENTION, ROUNDS = 16, 8, 250
#: Classes of bytes whose shares in a passage are figures.
CLASSES = np.stack([
    byte_class((0x61, 0x7A)), byte_class((0x41, 0x5A)), byte_class((0x30, 0x39)), byte_class((0x20, 0x20)), byte_class((0x09, 0x0D)), byte_class((0x80, 0xFF)),
    byte_class((0x2C, 0x2C), (0x2E, 0x2E)), byte_class((0x21, 0x21), (0x3F, 0x3F)), byte_class((0x7C, 0x7C), (0x5C, 0x5C), (0x2F, 0x2F)), byte_class((0x23, 0x26), (0x2A, 0x2B), (0x40, 0x40), (0x5E, 0x60), (0x7E, 0x7E)),
    byte_class((0x22, 0x22), (0x27, 0x29), (0x2D, 0x2D), (0x3A, 0x3B)), byte_class((0x3C, 0x3E), (0x5B, 0x5B), (0x5D, 0x5D), (0x7B, 0x7B), (0x7D, 0x7D)),
])
_CLASS_OF = np.where(CLASSES.any(axis=0), CLASSES.argmax(axis=0), len(CLASSES)).astype(np.int64)
#: Figures: the classes' shares, then words a byte, mean word length, short and long
#: words, words equal to the last one, distinct words in the passage and in the text.
FIGURES = len(CLASSES) + 1 + 7


def encode_passages(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For runs of documents: (first row, end row, figures of every passage, first
    passage of each document).  An empty text is one passage of zeros."""
    for lo, hi, data, offsets in slices(column, 1 << 20):
        size = np.diff(offsets)
        count = np.maximum(1, -(-size // PASSAGE))
        at = np.concatenate([[0], np.cumsum(count)])
        passages = int(at[-1])
        out = np.zeros((passages, FIGURES))
        if len(data):
            doc = np.repeat(np.arange(hi - lo), size)
            place = at[doc] + (np.arange(len(data)) - offsets[doc]) // PASSAGE
            width = len(CLASSES) + 1
            shares = np.bincount(place * width + _CLASS_OF[data], minlength=passages * width).reshape(passages, width)
            total = np.maximum(1, shares.sum(axis=1))
            out[:, :width] = shares / total[:, None]
            member = ~BLANKS[data]
            starts, ends, of = runs(member, offsets)
            if len(starts):
                hashes, home, length = hash_runs(data, member, starts, ends), place[starts], ends - starts
                words = np.bincount(home, minlength=passages)
                some = np.maximum(1, words)
                same = np.zeros(len(hashes), bool)
                same[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
                for k, x in enumerate((words / total * 8, np.bincount(home, np.minimum(length, 64), passages) / some / 16, np.bincount(home, length <= 3, passages) / some, np.bincount(home, length >= 14, passages) / some, np.bincount(home, same, passages) / some)):
                    out[:, width + k] = x
                out[:, width + 5] = distinct(home, hashes, passages) / some
                in_text = np.maximum(1, np.bincount(of, minlength=hi - lo))
                out[:, width + 6] = np.repeat((distinct(of, hashes, hi - lo) / in_text), count)
        yield lo, hi, out, at


def distinct(group: np.ndarray, value: np.ndarray, groups: int) -> np.ndarray:
    """Distinct values of each group."""
    order = np.lexsort((value, group))
    g, v = group[order], value[order]
    fresh = np.ones(len(g), bool)
    fresh[1:] = (g[1:] != g[:-1]) | (v[1:] != v[:-1])
    return np.bincount(g[fresh], minlength=groups)


@dataclass
class Model:
    """Weights, and the means and scales of the figures."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
        """Every layer for passages x of the documents that start at ``at``."""
        w, first = self.weights, at[:-1]
        count = np.diff(at)
        h = np.tanh(x @ w["w"] + w["b"])
        t, s = np.tanh(h @ w["v"]), sigmoid(h @ w["u"])
        e = (t * s) @ w["a"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), count))
        share = e / np.repeat(np.add.reduceat(e, first), count)
        z = np.add.reduceat(h * share[:, None], first, axis=0)
        return {"h": h, "t": t, "s": s, "share": share, "z": z, "score": sigmoid(z @ w["o"] + w["c"])}

    def score(self, column: pa.Array) -> np.ndarray:
        """The score of each text of a column."""
        out = np.zeros(len(column))
        for lo, hi, x, at in encode_passages(column):
            out[lo:hi] = self.forward((x - self.mean) / self.scale, at)["score"]
        return out


def fit(x: np.ndarray, at: np.ndarray, y: np.ndarray, rounds: int = ROUNDS) -> Model:
    """Gradient descent (Adam) on the mean loss of documents; classes weigh the same."""
    rng = np.random.default_rng(3)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    shapes = {"w": (x.shape[1], HIDDEN), "b": (HIDDEN,), "v": (HIDDEN, ATTENTION), "u": (HIDDEN, ATTENTION), "a": (ATTENTION,), "o": (HIDDEN,), "c": ()}
    model = Model(mean, scale, {k: np.asarray(rng.normal(0, 0.3, s)) for k, s in shapes.items()})
    x, w, count = (x - mean) / scale, model.weights, np.diff(at)
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in w.items()}
    for step in range(1, rounds + 1):
        f = model.forward(x, at)
        d_out = share * (f["score"] - y)
        d_z = np.repeat(d_out[:, None] * w["o"], count, axis=0)
        d_share = (d_z * f["h"]).sum(axis=1)
        d_e = f["share"] * (d_share - np.repeat(np.add.reduceat(f["share"] * d_share, at[:-1]), count))
        d_t, d_s = d_e[:, None] * w["a"] * f["s"] * (1 - f["t"] ** 2), d_e[:, None] * w["a"] * f["t"] * f["s"] * (1 - f["s"])
        d_h = (d_z * f["share"][:, None] + d_t @ w["v"].T + d_s @ w["u"].T) * (1 - f["h"] ** 2)
        grads = {"w": x.T @ d_h, "b": d_h.sum(axis=0), "v": f["h"].T @ d_t, "u": f["h"].T @ d_s, "a": (f["t"] * f["s"]).T @ d_e, "o": f["z"].T @ d_out, "c": d_out.sum()}
        for k, g in grads.items():
            g = g + 1e-4 * w[k]
            m = moment[k]
            m[0], m[1] = 0.9 * m[0] + 0.1 * g, 0.99 * m[1] + 0.01 * g * g
            w[k] = w[k] - 0.03 * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-8)
    return model


def train(sample: DataFrame) -> Model | None:
    """Fit on a bounded sample (doc_id, text, y) of whole texts; None without documents of
    both labels.  Figures are computed on the workers; of each class the documents whose
    hashed ids come first are taken, as long as their passages are MOST_PASSAGES at most."""
    tune(sample.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, x, at in encode_passages(batch.column(0)):
                bags = [x[a:b].astype(np.float32).tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(np.diff(at)), pa.array(bags, pa.binary())], names=["doc_id", "y", "n", "bag"])

    found = sample.select("text", "doc_id", "y").mapInArrow(work, "doc_id bigint, y int, n bigint, bag binary")
    rows, total = [], {}  # the sample's texts are bounded, and a passage's figures take less than its text
    for r in sorted(found.select("*", F.xxhash64("doc_id").alias("h")).collect(), key=lambda r: (r.h, r.doc_id or 0, r.bag)):
        total[r.y] = total.get(r.y, 0) + r.n
        if total[r.y] <= MOST_PASSAGES:
            rows.append(r)
    rows.sort(key=lambda r: (r.doc_id or 0, r.bag))
    y = np.array([r.y for r in rows])
    if len(set(y.tolist())) < 2:
        return None
    bags = [np.frombuffer(r.bag, np.float32).reshape(-1, FIGURES).astype(float) for r in rows]
    return fit(np.concatenate(bags), np.concatenate([[0], np.cumsum([len(b) for b in bags])]), y)


def score_documents(docs: DataFrame, model: Model | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: its id and ``score`` (0 to 1; 1: good).  Null and empty
    texts count as one empty passage; without a model every score is 0.5.  Repeated rows
    score alike; other columns are ignored; an empty table gives none."""
    tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = shared.value.score(batch.column(1)) if shared.value else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=[id_col, "score"])

    return docs.select(id_col, text_col).mapInArrow(work, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, score double")


def keep_good(docs: DataFrame, model: Model | None, *, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows that score ``threshold`` or more, all columns as they are.  Null and empty
    texts score as one empty passage; repeated rows fare alike, rows with a null id as any
    other; without a model, and of an empty table, every row stays."""
    tune(docs.sparkSession)
    shared, place = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(shared.value.score(batch.column(place)) >= threshold)) if shared.value else batch

    return docs.mapInArrow(work, docs.schema)
