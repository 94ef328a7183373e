"""Periodic runs of words: stretches that repeat themselves with a small period.

A stretch of period q matches itself at lag q, so a run of length L leaves L - q equal pairs
in a row there.  For each text the pairs at every lag up to a third of it are counted
exactly, frequent and rare words in different ways: the indicator of a frequent (heavy) word
is autocorrelated by FFT, the spectra of all heavy words of a text added up before one
inverse; the places of a rare (light) word are subtracted pair by pair, for all texts of a
slice at once.  A word is heavy where its pairs would cost more than its transform.  Only
lags with enough pairs for one run are scanned for islands.

Pairs inside runs that are found already don't call for a scan again: two runs of periods
p < q share fewer than p + q words (Fine and Wilf), so pairs at lag q whose two words lie
deeper in a run of period p can't belong to a run of period q, and are taken off the count.
A multiple of p as lag finds the same stretch; that is told by its ends.

Texts are independent of each other: no shuffle, one scan.  A text is the unit of work; its
work arrays are some 100 bytes a word.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.common import byte_class, hash_runs, mix, runs, slices, tune

#: Least words of a run, and how often its period fits in it.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Bytes of words: all but space, tab and the line ends up to 0x0D.
WORD = ~byte_class((0x20, 0x20), (0x09, 0x0D))
#: A word is heavy if half the square of its frequency exceeds this many times n log n, and at least so frequent.
HEAVY, LEAST_HEAVY = 2.0, 64
#: Texts of more words are tested in blocks before a lag is scanned from end to end.
LONG = 8192


@dataclass(frozen=True)
class Run:
    """Words start to start + length - 1 have the smallest period ``period``."""

    start: int
    length: int
    period: int

    @property
    def end(self) -> int:
        return self.start + self.length


def least_pairs(lag: np.ndarray | int):
    """Pairs in a row that a run of a period has at least: its least length less the period."""
    return np.maximum(LEAST_WORDS, LEAST_PERIODS * lag) - lag


def _groups(words: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places in order of text and word, which of these start a group, group sizes)."""
    order = np.argsort(mix(words ^ mix(doc.astype(np.uint64) + np.uint64(1))), kind="stable")
    w, d = words[order], doc[order]
    first = np.ones(len(order), bool)
    first[1:] = (w[1:] != w[:-1]) | (d[1:] != d[:-1])
    starts = np.flatnonzero(first)
    return order, starts, np.diff(np.append(starts, len(order)))


def _heavy_lags(places: list[np.ndarray], n: int, lags: int) -> np.ndarray:
    """Pairs at lags 0 to ``lags`` - 1 of the words at the given places of a text."""
    size = 1 << (n + lags - 1).bit_length()
    power = np.zeros(size // 2 + 1)
    for at in places:
        mark = np.zeros(size)
        mark[at] = 1
        spectrum = np.fft.rfft(mark)
        power += spectrum.real**2 + spectrum.imag**2
    return np.rint(np.fft.irfft(power, size)[:lags]).astype(np.int64)


def lag_counts(words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal pairs of words at every lag of every text, exactly: (counts, where each text's
    begin).  ``words``: hashes of all texts' words, a text's from ``offsets[k]`` on.  A text
    of n words has the lags 0 to n // 3; lag 0 isn't counted."""
    n = np.diff(offsets)
    width = n // LEAST_PERIODS + 1
    base = np.concatenate([[0], np.cumsum(width)])
    counts = np.zeros(int(base[-1]), np.int64)
    if not len(words):
        return counts, base
    doc = np.repeat(np.arange(len(n)), n)
    order, starts, size = _groups(words, doc)
    of = doc[order[starts]]
    bound = np.sqrt(2 * HEAVY * n * np.log2(n + 2))
    heavy = size > np.maximum(LEAST_HEAVY, bound)[of]
    for k in np.unique(of[heavy]).tolist():
        mine = np.flatnonzero(heavy & (of == k))
        places = [order[starts[g] : starts[g] + size[g]] - offsets[k] for g in mine.tolist()]
        counts[base[k] : base[k + 1]] += _heavy_lags(places, int(n[k]), int(width[k]))
    # light words: each place less the place ``step`` further back in its group
    live = np.repeat(~heavy, size)
    place = order[live]
    back = (np.arange(len(order)) - np.repeat(starts, size))[live]  # places of the group before it
    left = np.arange(len(place))
    step = 0
    while True:
        step += 1
        left = left[back[left] >= step]
        if not len(left):
            break
        lag = place[left] - place[left - step]
        near = lag < width[doc[place[left]]]  # further back only grows
        left, lag = left[near], lag[near]
        counts += np.bincount(base[doc[place[left]]] + lag, minlength=len(counts))
    counts[base[:-1]] = 0
    return counts, base


def _islands(same: np.ndarray, least: int) -> list[tuple[int, int]]:
    """(start, end) of the stretches of True of at least so many."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], same.view(np.int8), [0]])))
    a, b = edge[::2], edge[1::2]
    keep = b - a >= least
    return list(zip(a[keep].tolist(), b[keep].tolist(), strict=True))


def _some_block(words: np.ndarray, lag: int, least: int) -> bool:
    """Whether an aligned block of half of ``least`` pairs matches whole: every island of
    ``least`` pairs holds one."""
    size = (least + 1) // 2
    at = np.arange(0, len(words) - lag - size + 1, size)
    for k in range(size.bit_length() + 1):  # a few places of each block first
        inside = min(size - 1, (1 << k) - 1)
        at = at[words[at + inside] == words[at + inside + lag]]
        if not len(at):
            return False
    return any(np.array_equal(words[a : a + size], words[a + lag : a + lag + size]) for a in at.tolist())


def _deep_pairs(words: np.ndarray, found: list[Run], lag: int) -> int:
    """Pairs at a lag so deep in runs of smaller periods that no run of period ``lag`` has them."""
    out = 0
    for r in found:
        p, n = r.period, r.length - 2 * r.period - lag
        if n <= 0:
            continue
        if lag % p == 0:
            out += n
            continue
        a = r.start + p
        cycle = words[a : a + p] == words[a + lag % p : a + lag % p + p]  # both lie in the run: it has 3 periods
        out += n // p * int(cycle.sum()) + int(cycle[: n % p].sum())
    return out


def find_runs(words: np.ndarray, counts: np.ndarray) -> list[Run]:
    """All runs of one text, by start, then period.  ``counts``: its pairs by lag."""
    lags = np.arange(len(counts))
    found: list[Run] = []
    seen: set[tuple[int, int]] = set()
    for lag in (np.flatnonzero(counts[1:] >= least_pairs(lags[1:])) + 1).tolist():
        least = int(least_pairs(lag))
        if found and counts[lag] - _deep_pairs(words, found, lag) < least:
            continue
        if len(words) > LONG and not _some_block(words, lag, least):
            continue
        for a, b in _islands(words[:-lag] == words[lag:], least):
            if (a, b + lag) not in seen:  # else its period divides this lag
                seen.add((a, b + lag))
                found.append(Run(a, b + lag - a, lag))
    return sorted(found, key=lambda r: (r.start, r.period))


def strongest(found: list[Run]) -> Run | None:
    """The run of the greatest exact length / period; ties: smallest start, then period."""
    best = None
    for r in found:  # in that order
        if best is None or r.length * best.period > best.length * r.period:
            best = r
    return best


def kept_words(n: int, found: list[Run]) -> np.ndarray:
    """Which words stay: those that no run contains after its first period."""
    steps = np.zeros(n + 1, np.int64)
    for r in found:
        steps[r.start + r.period] += 1
        steps[r.end] -= 1
    return np.cumsum(steps[:n]) == 0


def looped(n: int, doc_id: int | None) -> np.ndarray | None:
    """The places that the words of a text come from where the registered query makes its
    end periodic (crc32 of the id ends in 0): word i >= a is word a + (i - a) % p.  None
    where it leaves the text alone."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    out = np.arange(n)
    out[a:] = a + (out[a:] - a) % p
    return out


_ROW = [("n_words", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("exponent_milli", pa.int64()), ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])))]
_DDL = "n_words bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>"


def _scan(texts: pa.Array, ids: list | None) -> Iterator[tuple[list[bytes], np.ndarray | None, list[Run]]]:
    """(words, the places they come from or None, runs) of every text; ``ids`` are given where
    texts are made periodic by id."""
    for lo, hi, data, at in slices(texts):
        starts, ends, doc = runs(WORD[data], at)
        words = hash_runs(data, WORD[data], starts, ends)
        offsets = np.searchsorted(doc, np.arange(hi - lo + 1))
        places: list = [None] * (hi - lo)
        if ids is not None:
            for k in range(hi - lo):
                a, b = int(offsets[k]), int(offsets[k + 1])
                places[k] = looped(b - a, ids[lo + k])
                if places[k] is not None:
                    words[a:b] = words[a:b][places[k]]
        counts, base = lag_counts(words, offsets)
        lag = np.arange(len(counts)) - np.repeat(base[:-1], np.diff(base))
        hopeful = np.zeros(hi - lo + 1, np.int64)
        np.add.at(hopeful, np.searchsorted(base, np.flatnonzero((lag > 0) & (counts >= least_pairs(lag))), "right") - 1, 1)
        raw = data.tobytes()
        for k in range(hi - lo):
            a, b = int(offsets[k]), int(offsets[k + 1])
            found = find_runs(words[a:b], counts[base[k] : base[k + 1]]) if hopeful[k] else []
            yield raw[at[k] : at[k + 1]].split(), places[k], found


def _row(n: int, found: list[Run]) -> tuple:
    best = strongest(found)
    four = (None,) * 4 if best is None else (best.start, best.length, best.period, 1000 * best.length // best.period)
    return n, len(found), *four


def find_periods(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", collapse: bool = True) -> DataFrame:
    """The periodic runs of every whole text: ``doc_id``, ``n_words``, ``n_runs``, the
    strongest run's ``start``, ``length``, ``period`` and ``exponent_milli`` (null without a
    run), ``runs`` (all of them by start, then period) and, unless ``collapse`` is false,
    ``collapsed``: the text of the words left when every run keeps its first period only.

    A run is a stretch of words with smallest period q and at least max(24, 3 q) words that
    no neighbouring word extends.  Words are runs of bytes other than space and 0x09 to 0x0D,
    told apart by 64-bit hashes.  Null and empty texts have no words and no runs.  Rows with
    equal or null ids are rows of their own; an empty table gives none; other columns are
    left out, whatever their names.
    """
    return _found(docs, id_col, text_col, collapse, by_id=False)


def _found(docs: DataFrame, id_col: str, text_col: str, collapse: bool, by_id: bool, digests: bool = False) -> DataFrame:
    tune(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    extra = [("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())] if digests else [("collapsed", pa.string())] if collapse else []

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [("doc_id", pa.int64()), *(_ROW[:-1] if digests else _ROW), *extra]
        for batch in batches:
            out: list[list] = [[] for _ in fields]
            names = batch.column(0).to_pylist()
            for words, places, found in _scan(batch.column(1), names if by_id else None):
                n = len(words)
                row = [names[len(out[0])], *_row(n, found)]
                if not digests:
                    row.append([{"start": r.start, "length": r.length, "period": r.period} for r in found])
                if extra:
                    if places is not None:
                        words = [words[i] for i in places.tolist()]
                    if found:
                        words = [words[i] for i in np.flatnonzero(kept_words(n, found)).tolist()]
                    rest = b" ".join(words)
                    if digests:
                        listed = "".join(f"{r.start},{r.length},{r.period}\n" for r in found)
                        row += [hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(rest).hexdigest()]
                    else:
                        row.append(rest.decode("utf-8", "replace"))
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(out, fields, strict=True)], [k for k, _ in fields])

    ddl = f"doc_id bigint, {_DDL if not digests else _DDL.rpartition(', runs')[0]}" + "".join(f", {k} string" for k, _ in extra)
    return rows.mapInArrow(work, ddl)


def period_digests(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What the registered query returns: every tenth text by crc32 of its id is made periodic
    (``looped``; a null id counts as an empty one), runs are found as ``find_periods`` does,
    and their list and the collapsed text are given as SHA-256 digests, which are those of the
    empty string where there is nothing."""
    out = _found(docs, id_col, text_col, True, by_id=True, digests=True)
    return out.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
