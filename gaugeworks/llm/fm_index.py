"""Benchmark decontamination by an FM-index over each shard of training text.

Every task cuts its documents into shards of bounded size.  A shard is a sequence
of word numbers; words that occur in no benchmark item become one separator, and a
run between separators that is shorter than the shortest searched phrase is left
out, because no phrase can lie in it (this drops no occurrence).  Over the sequence
stand a suffix array, its Burrows-Wheeler transform in a wavelet matrix with rank
directories, and suffix positions sampled at every 16th place.  All phrases are
searched backwards at once; the rows found are walked to the next sampled position;
overlapping occurrences are merged into removal spans.

No shuffle takes place: the work is one scan of the documents.  The phrases are
broadcast in blocks of at most ``BLOCK_WORDS`` words of windows.  A batch of documents
is searched for one block after the other, each loaded and let go again, and the spans
and items of all blocks are merged by row, so a benchmark of any size is searched whole.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame

from gaugeworks.llm.common import LOWER, byte_class, hash_runs, runs, slices, texts_of, tune

#: Consecutive words of an item that make a window; a shorter item is one window.
WINDOW = 13
#: Bytes of words: digits, a-z and everything outside ASCII.
WORD = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
#: Words of a shard; the most words of windows, guessed from the length of the texts, that
#: the driver collects at once; and the most in a block that is broadcast.
SHARD_WORDS, MOST_WORDS, BLOCK_WORDS = 400_000, 20_000_000, 5_000_000
SAMPLE = 16
SEPARATOR = 1


class RankBits:
    """A bitmap with a rank directory: one running count per 64 bits."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before position i."""
        w, b = i >> 6, (i & 63).astype(np.uint64)
        return self.before[w] + np.bitwise_count(self.words[w] & ((np.uint64(1) << b) - np.uint64(1)))

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64)


class WaveletMatrix:
    """Ranks and reads of symbols, one bitmap for each bit of the alphabet."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.depth = max(1, int(sigma - 1).bit_length())
        self.levels, self.zeros = [], []
        start = np.zeros(sigma, np.int64)
        every = np.arange(sigma)
        for k in reversed(range(self.depth)):
            bit = (symbols >> k) & 1
            self.levels.append(RankBits(bit.astype(np.uint8)))
            self.zeros.append(int(len(bit) - bit.sum()))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])
            ones = self.levels[-1].rank(start)
            start = np.where((every >> k) & 1, self.zeros[-1] + ones, start - ones)
        self.start = start

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of symbol c before position i."""
        for d, (level, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            ones = level.rank(i)
            i = np.where((c >> (self.depth - 1 - d)) & 1, zeros + ones, i - ones)
        return i - self.start[c]

    def read(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at i and its occurrences before i."""
        c = np.zeros(len(i), np.int64)
        for level, zeros in zip(self.levels, self.zeros, strict=True):
            bit, ones = level.get(i), level.rank(i)
            c = c * 2 + bit
            i = np.where(bit == 1, zeros + ones, i - ones)
        return c, i - self.start[c]


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; the last symbol is the unique smallest."""
    n, k = len(seq), 1
    rank = np.unique(seq, return_inverse=True)[1].astype(np.int64)
    while True:
        key = rank * (n + 1)
        key[:-k] += rank[k:] + 1
        order = np.argsort(key)
        ordered = key[order]
        fresh = np.zeros(n, np.int64)
        np.cumsum(ordered[1:] != ordered[:-1], out=fresh[1:])
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        if fresh[-1] == n - 1:
            return order
        k *= 2


class FmIndex:
    """Count and locate phrases in one sequence of symbols 1..sigma-1."""

    def __init__(self, seq: np.ndarray, sigma: int):
        seq = np.append(seq, 0)
        order = suffix_array(seq)
        bwt = seq[order - 1]
        self.size, self.wavelet = len(seq), WaveletMatrix(bwt, sigma)
        self.first = np.zeros(sigma + 1, np.int64)
        np.cumsum(np.bincount(seq, minlength=sigma), out=self.first[1:])
        kept = order % SAMPLE == 0
        self.marked, self.sampled = RankBits(kept.astype(np.uint8)), order[kept]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of equally long phrases (one a row): row ranges."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.size)
        live = np.arange(len(phrases))
        for place in reversed(range(phrases.shape[1])):
            c = phrases[live, place]
            lo[live] = self.first[c] + self.wavelet.rank(c, lo[live])
            hi[live] = self.first[c] + self.wavelet.rank(c, hi[live])
            live = live[hi[live] > lo[live]]
            if not len(live):
                break
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions in the sequence: step back until a sampled suffix."""
        rows, out, steps = rows.copy(), np.full(len(rows), -1, np.int64), np.zeros(len(rows), np.int64)
        live = np.arange(len(rows))
        while len(live):
            at = rows[live]
            done = self.marked.get(at) == 1
            out[live[done]] = self.sampled[self.marked.rank(at[done])] + steps[live[done]]
            live = live[~done]
            c, before = self.wavelet.read(rows[live])
            rows[live] = self.first[c] + before
            steps[live] += 1
        return out


class Phrases:
    """The windows of a block of benchmark items, ready to be searched."""

    def __init__(self, items: list[tuple[int, str]], window: int):
        words, seen, owners = {}, {}, defaultdict(set)
        for item, text in items:
            _, _, hashes = words_of(text.encode())
            ids = [words.setdefault(int(h), len(words) + 2) for h in hashes]
            for at in range(max(1, len(ids) - window + 1)) if ids else ():
                owners[seen.setdefault(tuple(ids[at : at + window]), len(seen))].add(item)
        self.hashes = np.array(sorted(words), np.uint64)
        self.ids = np.array([words[int(h)] for h in self.hashes], np.int64)
        self.sigma = len(words) + 2
        by_size = defaultdict(list)
        for phrase, number in seen.items():
            by_size[len(phrase)].append((number, phrase))
        self.groups = [(size, np.array([n for n, _ in group]), np.array([p for _, p in group], np.int64)) for size, group in sorted(by_size.items())]
        self.shortest = min(by_size, default=0)
        self.owners = [list(owners[k]) for k in range(len(seen))]

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        """Word numbers; SEPARATOR for words of no item."""
        if not len(self.hashes):
            return np.full(len(hashes), SEPARATOR)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.ids[at], SEPARATOR)


def words_of(data: bytes | np.ndarray, offsets: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, document, hash) of the words of a slice of texts."""
    data = LOWER[np.frombuffer(data, np.uint8) if isinstance(data, bytes) else data]
    offsets = np.array([0, len(data)]) if offsets is None else offsets
    member = WORD[data]
    starts, ends, doc = runs(member, offsets)
    return np.stack([starts, ends]), doc, hash_runs(data, member, starts, ends)


class Shard:
    """Runs of benchmark words of some documents, gathered up to SHARD_WORDS."""

    def __init__(self, phrases: Phrases):
        self.phrases, self.parts, self.places, self.size = phrases, [], [], 0

    def add(self, doc: np.ndarray, place: np.ndarray, hashes: np.ndarray) -> None:
        """Words in order with their document and place in it."""
        p = self.phrases
        if not p.groups or not len(hashes):
            return
        symbol = p.symbols(hashes)
        known = symbol != SEPARATOR
        edge = np.ones(len(known) + 1, bool)
        edge[1:-1] = doc[1:] != doc[:-1]
        begin = np.flatnonzero(known & (edge[:-1] | ~np.concatenate([[False], known[:-1]])))
        end = np.flatnonzero(known & (edge[1:] | ~np.concatenate([known[1:], [False]]))) + 1
        long = end - begin >= p.shortest
        begin, end = begin[long], end[long]
        if not len(begin):
            return
        size = end - begin
        first = np.cumsum(size + 1) - size - 1
        take = np.arange(int((size + 1).sum())) - np.repeat(first, size + 1) + np.repeat(begin, size + 1)
        stop = np.zeros(len(take), bool)
        stop[first + size] = True
        take = np.minimum(take, len(symbol) - 1)
        self.parts.append(np.where(stop, SEPARATOR, symbol[take]))
        self.places.append(np.stack([np.where(stop, -1, doc[take]), place[take]]))
        self.size += len(take)

    def find(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(document, first word, words, phrase) of every occurrence."""
        found = [[], [], [], []]
        if self.parts:
            where = np.concatenate(self.places, axis=1)
            index = FmIndex(np.concatenate(self.parts), self.phrases.sigma)
            for size, numbers, phrases in self.phrases.groups:
                lo, hi = index.search(phrases)
                n = hi - lo
                rows = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
                at = index.locate(rows)
                for out, x in zip(found, (where[0, at], where[1, at], np.full(len(at), size), np.repeat(numbers, n)), strict=True):
                    out.append(x)
        return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in found)


def merged(starts: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int]]:
    """Union of word ranges as sorted, disjoint (first, end)."""
    out: list[list[int]] = []
    for a, n in sorted(zip(starts.tolist(), sizes.tolist(), strict=True)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], a + n)
        else:
            out.append([a, a + n])
    return [tuple(x) for x in out]


def hits_of(texts: pa.Array, phrases: Phrases) -> tuple[np.ndarray, dict[int, list[tuple[int, int]]], dict[int, set[int]]]:
    """Words of each text; its merged spans of hit words; the items they are of."""
    n_words, spans, items = np.zeros(len(texts), np.int64), defaultdict(list), defaultdict(set)
    shard = Shard(phrases)

    def flush() -> None:
        doc, start, size, phrase = shard.find()
        order = np.argsort(doc, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(doc[order])) + 1) if len(doc) else ():
            d = int(doc[part[0]])
            spans[d] += zip(start[part].tolist(), size[part].tolist(), strict=True)
            for number in np.unique(phrase[part]).tolist():
                items[d].update(phrases.owners[number])

    for lo, hi, data, offsets in slices(texts):
        _, doc, hashes = words_of(data, offsets)
        count = np.bincount(doc, minlength=hi - lo)
        n_words[lo:hi] = count
        place = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        shard.add(doc + lo, place, hashes)
        if shard.size > SHARD_WORDS:
            flush()
            shard = Shard(phrases)
    flush()
    return n_words, {d: merged(*np.array(x).T) for d, x in spans.items()}, items


def pieces(item: object, text: str, window: int, most: int) -> Iterator[tuple[object, str, int]]:
    """(item, text, words of windows) of an item, cut into texts that overlap by all but
    one word of a window if its windows hold more than ``most`` words."""
    data = text.encode()
    (starts, ends), _, _ = words_of(data)
    n, step = len(starts), max(1, most // window)
    windows = max(1, n - window + 1) if n else 0
    if windows <= step:
        yield item, text, windows * min(n, window)
        return
    for at in range(0, windows, step):
        end = min(at + step, windows) + window - 1
        yield item, data[starts[at] : ends[end - 1]].decode(), (end - window + 1 - at) * window


def blocks_of(items: Iterable[tuple[object, str]], window: int, most: int) -> Iterator[Phrases]:
    """The items' windows in blocks of at most ``most`` words; one empty block if none."""
    block, size, made = [], 0, 0
    for item, text in items:
        for _, piece, n in pieces(item, text, window, most):
            if block and size + n > most:
                yield Phrases(block, window)
                block, size, made = [], 0, made + 1
            block.append((item, piece))
            size += n
    if block or not made:
        yield Phrases(block, window)


def share_phrases(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> list[Broadcast]:
    """The benchmark's windows, broadcast block by block; the driver holds one block."""
    rows = benchmark.select(item_col, text_col).where(f"`{text_col}` is not null")
    size = rows.selectExpr(f"coalesce(sum(length(`{text_col}`)), 0)").first()[0] // 2 * window
    items = rows.collect() if size <= MOST_WORDS else rows.toLocalIterator()
    return [benchmark.sparkSession.sparkContext.broadcast(x) for x in blocks_of(items, window, BLOCK_WORDS)]


def hits_of_blocks(texts: pa.Array, shared: list[Broadcast]) -> tuple[np.ndarray, dict[int, list[tuple[int, int]]], dict[int, set[int]]]:
    """``hits_of`` for all blocks, merged by text; of several blocks a worker holds one."""
    if len(shared) == 1:
        return hits_of(texts, shared[0].value)
    n_words, spans, items = np.zeros(len(texts), np.int64), defaultdict(list), defaultdict(set)
    for block in shared:
        n_words, found, of = hits_of(texts, block.value)
        if getattr(block, "_path", None):
            block.__dict__.pop("_value", None)
        for d, x in found.items():
            spans[d] += x
        for d, x in of.items():
            items[d] |= x
    return n_words, {d: merged(*np.array([(a, b - a) for a, b in x]).T) for d, x in spans.items()}, items


def named(items: Iterable[object]) -> list[str | None]:
    """Item ids as strings, sorted; items without an id are one null at the end."""
    return sorted(str(x) for x in items if x is not None) + [None] * (None in items)


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per document row: its id, ``n_words``, ``n_hit``, ``items`` (ids,
    sorted as strings) and ``spans`` (first word and end of each removal span).

    Null and empty texts have no words and no hits; items with a null text are skipped;
    items of fewer words than ``window`` are searched whole, items without words never
    match.  Items without an id are searched too and stand as one null at the end of
    ``items``; items that share an id are one.  Repeated rows give repeated results; a
    null id is passed through; an empty table gives an empty result, an empty benchmark
    no hits; other columns are ignored.
    """
    tune(docs.sparkSession)
    shared = share_phrases(benchmark, item_col, item_text_col, window)
    out = pa.schema([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, spans, items = hits_of_blocks(batch.column(1), shared)
            rows = range(batch.num_rows)
            columns = [
                pa.array(n_words), pa.array([sum(b - a for a, b in spans.get(d, ())) for d in rows], pa.int64()),
                pa.array([named(items.get(d, ())) for d in rows], out.field("items").type),
                pa.array([[{"first": a, "end": b} for a, b in spans.get(d, ())] for d in rows], out.field("spans").type),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], schema=pa.schema([batch.schema.field(0), *out]))

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(work, f"`{id_col}` {kind}, n_words bigint, n_hit bigint, items array<string>, spans array<struct<first:bigint,end:bigint>>")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", window: int = WINDOW, share: int = 20) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated: fewer than one word in
    ``share`` lies in an occurrence of a window.  All columns, repeated rows and rows with
    a null id or text stay as they are; of an empty table nothing is left, and an empty
    benchmark (its columns are item_id and text) drops nothing."""
    tune(docs.sparkSession)
    shared = share_phrases(benchmark, "item_id", "text", window)
    place = docs.columns.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, spans, _ = hits_of_blocks(batch.column(place), shared)
            n_hit = np.zeros(batch.num_rows, np.int64)
            for d, x in spans.items():
                n_hit[d] = sum(b - a for a, b in x)
            yield batch.filter(pa.array((n_hit == 0) | (share * n_hit < n_words)))

    return docs.mapInArrow(work, docs.schema)


__all__ = ["FmIndex", "RankBits", "WaveletMatrix", "drop_contaminated", "find_contamination", "texts_of"]
