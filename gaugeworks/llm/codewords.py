"""Language identification by error-correcting output codes.

Every language gets a codeword of ``BITS`` bits, chosen so that codewords lie far
apart.  For each bit a binary classifier over hashed byte n-grams (of 1 to 3 bytes,
A-Z lower-cased, runs of other ASCII as one blank) learns from a bounded sample which
side a text's language is on.  Decoding sums a logistic loss of the bits' margins over
every codeword and takes the least; a small distance to the second marks a text as
ambiguous.

Scoring is one scan without a shuffle; the weights (a table of a fixed number of rows, a
column for each bit) are broadcast.  Texts are scanned whole, in steps of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.common import LOWER, byte_class, persist, slices, tune

#: Documents that are learned from in all, dealt evenly to the languages, but at least so
#: many of each.
MOST_DOCUMENTS, LEAST_EACH = 2000, 4
BITS, SLOTS, ROUNDS = 15, 1 << 13, 60
#: Bytes whose n-grams are held at a time; training documents held as full vectors at a time.
STEP_BYTES, STEP_DOCUMENTS = 1 << 18, 2048
UNDETERMINED = "und"
_LETTER = byte_class((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))


def codewords(n: int, bits: int = BITS) -> np.ndarray:
    """n codewords of +-1: of random sets of columns that split the languages, those
    with the largest least distance between rows."""
    rng = np.random.default_rng(11)
    bits = max(bits, 2 * int(np.ceil(np.log2(max(2, n)))) + 1)
    best, far = np.ones((n, bits)), -1
    for _ in range(200 if n > 1 else 0):
        code = np.where(rng.random((n, bits)) < 0.5, -1.0, 1.0)
        flat = np.abs(code.sum(axis=0)) == n
        code[rng.integers(n, size=int(flat.sum())), np.flatnonzero(flat)] *= -1
        apart = (bits - code @ code.T) / 2
        least = apart[~np.eye(n, dtype=bool)].min()
        if least > far:
            best, far = code, least
    return best


def plain_bytes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of texts with A-Z lower-cased and runs of other ASCII as one blank."""
    plain = np.where(_LETTER[data], LOWER[data], np.uint8(32))
    starts = np.zeros(len(plain) + 1, bool)
    starts[offsets] = True
    keep = np.ones(len(plain), bool)
    keep[1:] = (plain[1:] != 32) | (plain[:-1] != 32) | starts[1:-1]
    return plain[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]


def gram_steps(plain: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For steps of bounded size: (slots, texts, first of each text): for each byte the
    slots of the n-grams of 1, 2 and 3 bytes that end there, within its text."""
    starts = np.zeros(len(plain) + 2, bool)
    starts[at] = True
    padded = np.concatenate([np.full(2, 32, np.uint8), plain])
    for lo in range(0, len(plain), STEP_BYTES):
        hi = min(lo + STEP_BYTES, len(plain))
        now, before, second = (padded[2 - k + lo : 2 - k + hi].astype(np.uint32) for k in range(3))
        first = starts[lo:hi]
        before[first] = second[first] = 32
        second[1:][first[:-1]] = 32
        if lo and starts[lo - 1]:
            second[0] = 32
        pair = before << 8 | now
        slots = np.stack([now, 256 + (pair * np.uint32(0x9E3779B1) >> np.uint32(21)), 2304 + ((second << 16 | pair) * np.uint32(0x85EBCA6B) >> np.uint32(16)) % np.uint32(SLOTS - 2304)])
        texts = np.arange(np.searchsorted(at, lo, "right") - 1, np.searchsorted(at, hi, "left"))
        texts = texts[at[texts + 1] > at[texts]]
        yield slots.astype(np.int64), texts, np.maximum(at[texts] - lo, 0)


def bags(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(slots, shares) of each text's n-grams, those that occur."""
    plain, at = plain_bytes(data, offsets)
    open_text, counts = -1, np.zeros(SLOTS)
    found: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def close() -> None:
        if open_text >= 0:
            slots = np.flatnonzero(counts)
            found[open_text] = slots.astype(np.uint16), (counts[slots] / (at[open_text + 1] - at[open_text])).astype(np.float32)

    for slots, texts, first in gram_steps(plain, at):
        for text, a, b in zip(texts.tolist(), first.tolist(), [*first[1:].tolist(), slots.shape[1]], strict=True):
            if text != open_text:
                close()
                open_text, counts = text, np.zeros(SLOTS)
            counts += np.bincount(slots[:, a:b].ravel(), minlength=SLOTS)
    close()
    none = np.zeros(0, np.uint16), np.zeros(0, np.float32)
    for k in range(len(offsets) - 1):
        yield found.get(k, none)


@dataclass
class Model:
    """Languages, their codewords, and the weights of each bit's classifier."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray  # slots + 1 rows (the last: constants) by bits

    def margins(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Each bit's margin for each text of a slice."""
        plain, at = plain_bytes(data, offsets)
        out, table = np.zeros((len(offsets) - 1, self.code.shape[1])), self.weights[:-1]
        for slots, texts, first in gram_steps(plain, at):
            row = table[slots[0]]
            row += table[slots[1]]
            row += table[slots[2]]
            out[texts] += np.add.reduceat(row, first, axis=0)
        return out / np.maximum(np.diff(at), 1)[:, None] + self.weights[-1]

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language number, probability, ambiguous) by the least sum of losses."""
        loss = np.logaddexp(0, -margins[:, None, :] * self.code[None]).sum(axis=2)
        p = np.exp(loss.min(axis=1, keepdims=True) - loss)
        p /= p.sum(axis=1, keepdims=True)
        best = loss.argmin(axis=1)
        ordered = np.sort(loss, axis=1)
        gap = ordered[:, 1] - ordered[:, 0] if loss.shape[1] > 1 else np.full(len(loss), np.inf)
        return best, p[np.arange(len(p)), best], gap < 1.0


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Learn from a bounded sample of rows with a language and a text; None if there is none.

    Every language that occurs is learned, from the rows whose hashes of id and text come
    first, equal rows counting once.  The n-gram shares of their whole texts are computed on
    the workers and gathered (MOST_DOCUMENTS sparse vectors, or LEAST_EACH of each language).
    """
    tune(docs.sparkSession)
    rows = docs.select(F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("l"), F.pmod(F.xxhash64(id_col, text_col, F.lit(5)), F.lit(1 << 40)).alias("h")).where("t is not null and l is not null and t <> ''")
    sizes = rows.groupBy("l").agg(F.count("*").alias("n"), F.min("h").alias("least")).collect()
    if not sizes:
        return None
    each = max(LEAST_EACH, MOST_DOCUMENTS // len(sizes))
    # a share of the hashes that holds somewhat more than is asked for, and one row in any case
    reach = {r["l"]: max(min(1 << 40, int((1.2 * each + 30) / r["n"] * (1 << 40))), r["least"]) for r in sizes}
    bounds = docs.sparkSession.createDataFrame(list(reach.items()), "l string, reach long")
    some = rows.join(F.broadcast(bounds), "l").where("h <= reach").select("l", "h", "t")  # one row a language

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column(2), 1 << 20):
                parts = [(x.tobytes(), y.tobytes()) for x, y in bags(data, offsets)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array([x for x, _ in parts], pa.binary()), pa.array([y for _, y in parts], pa.binary())], names=["l", "h", "slots", "shares"])

    found = persist(some.mapInArrow(work, "l string, h bigint, slots binary, shares binary").dropDuplicates(["l", "h"]), "languages")
    kept, taken = [], dict.fromkeys(reach, 0)
    for r in sorted(found.collect(), key=lambda r: (r.l, r.h)):
        taken[r.l] += 1
        if taken[r.l] <= each:
            kept.append(r)
    languages = sorted(reach)
    number, code = {name: k for k, name in enumerate(languages)}, codewords(len(languages))
    sparse = [(np.frombuffer(r.slots, np.uint16), np.frombuffer(r.shares, np.float32)) for r in kept]
    return Model(languages, code, fit(sparse, np.array([number[r.l] for r in kept]), code))


def dense(sparse: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    out = np.zeros((len(sparse), SLOTS), np.float32)
    for k, (slots, shares) in enumerate(sparse):
        out[k, slots] = shares
    return out


def fit(sparse: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, code: np.ndarray) -> np.ndarray:
    """All bits' logistic regressions at once (Adam on the mean loss, classes weighing
    the same); the weights take texts' n-gram shares.  The vectors are held in full
    STEP_DOCUMENTS at a time."""
    spans = [slice(a, min(a + STEP_DOCUMENTS, len(y))) for a in range(0, len(y), STEP_DOCUMENTS)]
    total, squares = np.zeros(SLOTS), np.zeros(SLOTS)
    for span in spans:
        part = dense(sparse[span])
        total += part.sum(axis=0)
        squares += np.einsum("ij,ij->j", part, part)
    mean = (total / len(y)).astype(np.float32)
    scale = (1 / (np.sqrt(np.maximum(squares / len(y) - mean.astype(float) ** 2, 0)) + 1e-3)).astype(np.float32)

    def scaled(span: slice) -> np.ndarray:
        part = dense(sparse[span])
        part -= mean
        part *= scale
        return part

    held = scaled(spans[0]) if len(spans) == 1 else None
    target = (code[y] > 0).astype(np.float32)
    weight = (1 / np.bincount(y, minlength=len(code))[y] / len(code)).astype(np.float32)[:, None]
    w, b = np.zeros((SLOTS, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)
    for step in range(1, ROUNDS + 1):
        g, gb = 1e-5 * w, np.zeros_like(b)
        for span in spans:
            x = scaled(span) if held is None else held
            d = weight[span] * (1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30))) - target[span])
            g, gb = g + x.T @ d, gb + d.sum(axis=0)
        for grad, mean1, mean2, value in ((g, m, v, w), (gb, mb, vb, b)):
            mean1 += 0.1 * (grad - mean1)
            mean2 += 0.02 * (grad * grad - mean2)
            value -= 0.01 * (mean1 / (1 - 0.9**step)) / (np.sqrt(mean2 / (1 - 0.98**step)) + 1e-7)
    w = w * scale[:, None]
    return np.concatenate([w, (b - mean @ w)[None]]).astype(np.float32)


def identify(docs: DataFrame, model: Model | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: its id, ``lang_pred``, ``score`` (the decoded
    probability) and ``ambiguous``.

    ``und`` with score 0 for null texts and texts without a letter, and for all texts if
    there is no model.  Repeated rows give repeated results; an empty table gives none.
    """
    tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = batch.column(1)
            name, score, close = [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
            for lo, hi, data, offsets in slices(texts, STEP_BYTES):
                letters = np.concatenate([[0], np.cumsum(_LETTER[data])])[offsets]
                with_letters = np.flatnonzero(np.diff(letters)).tolist()
                if model is None or not with_letters:
                    continue
                best, p, ambiguous = model.decode(model.margins(data, offsets))
                ascii_letters = np.diff(np.concatenate([[0], np.cumsum(_LETTER[data] & (data < 128))])[offsets])
                for d in with_letters:
                    if ascii_letters[d] or any(c.isalpha() for c in texts[lo + d].as_py()):
                        name[lo + d], score[lo + d], close[lo + d] = model.languages[best[d]], p[d], ambiguous[d]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(name), pa.array(score), pa.array(close)], names=[id_col, "lang_pred", "score", "ambiguous"])

    return docs.select(id_col, text_col).mapInArrow(work, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double, ambiguous boolean")
