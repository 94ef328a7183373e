r"""Cutting texts into chunks that byte-level BPE encodes independently, and a compact
memory of the chunks' ids.

The tokenizer first splits at its added tokens, then by a fixed pattern.  These cuts
always lie between pieces of that pattern: at the start of a run of white space,
before its last character if the run goes on to a word, after that character unless
it is a space, and between an ASCII letter and a sign that follows it.  So the ids of
a text are the joined ids of its chunks.  A batch is cut as bytes; each distinct
chunk is encoded once and its ids are looked up from then on.  The lookup goes by a
64-bit hash and then compares the bytes, so chunks that share a hash are told apart.

Texts that hold an added token, or white space outside ASCII, are rare and take a
slower way of the caller's.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from gaugeworks.llm.common import byte_class, hash_runs, slices

#: White space as the pattern's \s means it (fixed values: Unicode White_Space).
SPACE = r"\t-\r \x85\xa0  -     　"
#: Signs after a letter; any set of ASCII signs but the apostrophe would do.
SIGNS = byte_class((0x21, 0x26), (0x28, 0x2F), (0x3A, 0x40), (0x5B, 0x5F), (0x7B, 0x7E))
LETTERS = byte_class((0x41, 0x5A), (0x61, 0x7A))
BLANKS = byte_class((0x09, 0x0D), (0x20, 0x20))
#: Bytes that start white space outside ASCII or are controls that need the slower way.
_ODD = (b"\x1c", b"\x1d", b"\x1e", b"\x1f", b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")
_ODD_TEXT = re.compile(r"[\x1c-\x1f\x85\xa0  -     　]")
#: Chunks a worker remembers before it starts anew (about 50 bytes each), and text bytes it cuts at a time.
MOST_CHUNKS, STEP_BYTES = 1_000_000, 1 << 19


class Splitter:
    """Splits a text at the added tokens of a tokenizer file."""

    def __init__(self, spec: str):
        added = json.loads(spec)["added_tokens"]
        if any(x["single_word"] or x["lstrip"] or x["rstrip"] for x in added):
            raise ValueError("added tokens that take in neighbouring characters aren't supported")
        self.added = {x["content"]: x["id"] for x in added}
        self.pattern = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

    def segments(self, text: str) -> list[str]:
        """Ordinary stretches and added tokens in turn."""
        return [text] if self.pattern is None or not any(x in text for x in self.added) else [x for x in self.pattern.split(text) if x]


def chunk_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the chunks of a slice of texts start; they cover every byte."""
    n = len(data)
    blank = BLANKS[data]
    begins, ends = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
    begins[offsets], ends[offsets] = True, True
    cut = begins[:n].copy()
    before = np.zeros(n, bool)
    before[1:] = blank[:-1]
    cut |= blank & ~before
    last = np.zeros(n, bool)
    last[:-1] = blank[:-1] & ~blank[1:] & ~ends[1:n]
    cut |= last
    joins = np.zeros(n, bool)
    joins[1:] = blank[:-1] & (data[:-1] != 0x20)
    cut |= joins & ~blank
    follows = np.zeros(n, bool)
    follows[1:] = LETTERS[data[:-1]]
    cut |= follows & SIGNS[data]
    return np.flatnonzero(cut)


def joined(pool: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
    """A pool with ``more`` behind its first ``used`` items, grown by doubling."""
    if used + len(more) > len(pool):
        pool = np.concatenate([pool[:used], np.zeros(max(len(more), used), pool.dtype)])
    pool[used : used + len(more)] = more
    return pool


def differ(data: np.ndarray, at: np.ndarray, pool: np.ndarray, pool_at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which of the runs data[at : at + size] aren't those of the pool at ``pool_at``; runs
    of the pool are at least as long."""
    first = np.cumsum(size) - size
    inside = np.arange(int(size.sum()), dtype=np.int64) - np.repeat(first, size)
    wrong = np.flatnonzero(data[inside + np.repeat(at, size)] != pool[inside + np.repeat(pool_at, size)])
    out = np.zeros(len(size), bool)
    out[np.searchsorted(first, wrong, "right") - 1] = True
    return out


class ChunkTable:
    """Ids of chunks by hash: sorted hashes, and where in pools the chunks' bytes and ids
    lie.  ``learn`` encodes new chunks: (bytes of each) -> (ids of all, ids of each)."""

    def __init__(self, learn: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]):
        self.learn = learn
        self._clear()

    def _clear(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.at, self.size, self.text_at, self.text_size = (np.zeros(0, np.int64) for _ in range(4))
        self.pool, self.used, self.text, self.text_used = np.zeros(1 << 16, np.uint32), 0, np.zeros(1 << 16, np.uint8), 0
        self.others: dict[bytes, tuple[int, int]] = {}  # chunks whose hash another one has taken

    def _keep_ids(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of new chunks lie, and how many they are."""
        ids, size = self.learn(chunks)
        self.pool = joined(self.pool, self.used, ids)
        at = self.used + np.cumsum(size) - size
        self.used += len(ids)
        return at, size

    def _add(self, hashes: np.ndarray, chunks: list[bytes]) -> None:
        at, size = self._keep_ids(chunks)
        lengths = np.array([len(c) for c in chunks], np.int64)
        self.text = joined(self.text, self.text_used, np.frombuffer(b"".join(chunks), np.uint8))
        where = np.searchsorted(self.hashes, hashes)
        self.at, self.size = np.insert(self.at, where, at), np.insert(self.size, where, size)
        self.text_at = np.insert(self.text_at, where, self.text_used + np.cumsum(lengths) - lengths)
        self.text_size, self.hashes = np.insert(self.text_size, where, lengths), np.insert(self.hashes, where, hashes)
        self.text_used += int(lengths.sum())

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return at, self.hashes[at] == hashes

    def _strangers(self, data: np.ndarray, starts: np.ndarray, length: np.ndarray, first: np.ndarray, inverse: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Chunks that aren't the bytes kept under their hash: neither they nor the first of
        the slice with that hash, which stands for them in the comparison."""
        alike = self.text_size[at] == length[first]
        alike[alike] = ~differ(data, starts[first[alike]], self.text, self.text_at[at[alike]], length[first[alike]])
        leader = first[inverse]
        out = length[leader] != length
        same = np.flatnonzero(~out)
        out[same] = differ(data, starts[same], data, starts[leader[same]], length[same])
        return np.flatnonzero(out | ~alike[inverse])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts of a slice, number of ids of each)."""
        docs = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(docs, np.int64)
        starts = chunk_starts(data, offsets)
        stops = np.append(starts[1:], len(data))
        hashes = hash_runs(data, np.ones(len(data), bool), starts, stops)
        unique, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        raw = data.tobytes()
        if len(self.hashes) + len(unique) + len(self.others) > MOST_CHUNKS and len(self.hashes):
            self._clear()
        at, known = self._places(unique)
        if not known.all():
            new = first[~known]
            self._add(unique[~known], [raw[a:b] for a, b in zip(starts[new].tolist(), stops[new].tolist(), strict=True)])
            at, _ = self._places(unique)
        begin, size = self.at[at][inverse], self.size[at][inverse]
        for k in self._strangers(data, starts, stops - starts, first, inverse, at).tolist():
            chunk = raw[starts[k] : stops[k]]
            if chunk not in self.others:
                place, n = self._keep_ids([chunk])
                self.others[chunk] = int(place[0]), int(n[0])
            begin[k], size[k] = self.others[chunk]
        total = np.cumsum(size)
        ids = self.pool[np.repeat(begin - total + size, size) + np.arange(int(total[-1]))]
        bounds = np.concatenate([[0], total])[np.searchsorted(starts, offsets)]
        return ids, np.diff(bounds)


def encoded(column: pa.Array, table: ChunkTable, splitter: Splitter, slow: Callable[[str], np.ndarray]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Encode a text column in runs of rows: (first row, end row, ids, ids of each
    row).  ``slow`` encodes a text that chunks don't suit."""
    for lo, hi, data, offsets in slices(column, STEP_BYTES):
        raw = data.tobytes()
        odd = []
        if any(x in raw for x in (*_ODD, *(a.encode() for a in splitter.added))):
            texts = column.slice(lo, hi - lo).to_pylist()
            odd = [k for k, t in enumerate(texts) if t and (_ODD_TEXT.search(t) or any(a in t for a in splitter.added))]
        if not odd:
            yield lo, hi, *table.encode(data, offsets)
            continue
        keep = np.ones(len(offsets) - 1, bool)
        keep[odd] = False
        spans = np.diff(offsets)
        ids, size = table.encode(data[np.repeat(keep, spans)], np.concatenate([[0], np.cumsum(spans * keep)]))
        parts = np.split(ids, np.cumsum(size)[:-1])
        for k in odd:
            parts[k] = slow(texts[k])
        yield lo, hi, np.concatenate(parts), np.array([len(p) for p in parts])
