"""Language-model scoring with log-frequency Bloom filters.

Counts of bigrams are quantised to levels of their logarithm.  A bigram of level q goes
into a Bloom filter q times, with the numbers 1 to q; its level is read back by probing
1, 2, 3 and on until a probe fails, so errors are one-sided and rare.  A text's
probability interpolates the bigram estimates with exact, smoothed unigram counts.

A level stands for its smallest count, so the estimates of a context's successors add up
to no more than the context's count; the mass that false positives are expected to add
over the whole vocabulary is part of the denominator.  So the probabilities of all words
after a context sum to at most 1 (in expectation over the hash functions).

The filter of a large corpus is larger than a worker's memory, and grows with the
corpus.  So it is cut into shards by hash, and instead of sending every shard to every
worker each block of documents sends the hashes it asks for, once each, to the shard
that holds them:

1. Documents are dealt to blocks of a few MB.  A block counts its tokens and bigrams
   and sends its distinct hashes with their training counts to the shards that hold some
   of them; so there are never more messages than distinct hashes of blocks, and what is
   sent grows with the corpus.
2. A shard sums the counts over the blocks, builds its filter, and answers each block:
   exact counts of the tokens, probed levels of the bigrams, in the order asked.  Each
   shard's number of known tokens and training tokens are added up over all shards.
3. The block scores its documents with the answers.

Tokens and bigrams are told apart by 64-bit hashes.  Hot tokens are counted within a
block first, so a shard gets each at most once a block.  Every task holds one block or one
shard; the driver gathers nothing.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.common import LOWER, byte_class, hash_runs, mix, persist, runs, scan_bytes, slices, tune

#: Input bytes (as stored) of a block, and of the part of the corpus a shard answers for;
#: below STEEP blocks' bytes of input both shrink with its square root.
BLOCK_BYTES, SHARD_BYTES, STEEP = 4 << 20, 8 << 20, 52
#: Bits of the filter for each entry (at least), its hash functions, the base of the levels.
BITS_PER_ENTRY, HASHES, BASE = 32, 20, 1.5
#: The chance that a probe for what isn't in the filter succeeds (at most).
FALSE = (1 - math.exp(-HASHES / BITS_PER_ENTRY)) ** HASHES
#: The unigram smoothing of the contract, and the bigrams' weight.
ALPHA, WEIGHT, TRUST = 0.1, 0.5, 2.0
WORD = ~byte_class((0x09, 0x0D), (0x20, 0x20))
END = np.uint64(0x5BD1E995A5A5A5A5)


class LogFrequencyFilter:
    """A Bloom filter of (key, level) entries."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        levels = level_of(counts)
        self.most = int(levels.max(initial=0))
        self.size = 1 << max(20, (int(levels.sum()) * BITS_PER_ENTRY - 1).bit_length())
        self.bits = np.zeros(self.size // 8, np.uint8)
        for q in range(1, self.most + 1):
            slot, step = self._slots(keys[levels >= q], q)
            for _ in range(HASHES):
                np.bitwise_or.at(self.bits, slot >> np.uint64(3), np.uint8(1) << (slot & np.uint64(7)).astype(np.uint8))
                slot = (slot + step) & np.uint64(self.size - 1)

    def _slots(self, keys: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
        """The first slot of each key at a level, and the odd step to the next ones."""
        first = mix(keys + np.uint64(q * 0x9E3779B97F4A7C15 & 2**64 - 1))
        return first & np.uint64(self.size - 1), mix(first + np.uint64(1)) & np.uint64(self.size - 1) | np.uint64(1)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The level of each key: probes until one fails."""
        out, live = np.zeros(len(keys), np.uint8), np.arange(len(keys))
        for q in range(1, self.most + 1):
            slot, step = self._slots(keys[live], q)
            for k in range(HASHES):
                inside = (self.bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1
                slot = (slot + step) & np.uint64(self.size - 1)
                if k % 4 == 0 and not inside.all() or not k % 4 == 0 and inside.sum() < len(live):
                    live, slot, step = live[inside], slot[inside], step[inside]
            if not len(live):
                break
            out[live] = q
        return out


def level_of(counts: np.ndarray) -> np.ndarray:
    """0 for none, else 1 + the logarithm to BASE, rounded down."""
    return np.where(counts > 0, 1 + np.floor(np.log(np.maximum(counts, 1)) / math.log(BASE) + 1e-9), 0).astype(np.int64)


def count_of(levels: np.ndarray) -> np.ndarray:
    """The smallest count of a level."""
    return np.where(levels > 0, np.ceil(BASE ** (np.maximum(levels, 1) - 1.0) - 1e-9), 0)


def mixed(count: np.ndarray, context: np.ndarray, level: np.ndarray, total: int, known: int) -> tuple[np.ndarray, np.ndarray]:
    """(smoothed unigram, interpolated) probabilities of tokens with a count, after contexts
    with a count, for bigrams of a level; ``total`` and ``known`` training tokens."""
    single = (count + ALPHA) / (total + ALPHA * (known + 1))
    trust = WEIGHT * context / (context + TRUST)
    room = np.maximum(context + FALSE * (context + known + 1), 1)
    return single, (1 - trust) * single + trust * np.minimum(count_of(level), context) / room


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all tokens with each text's end, tokens of each text)."""
    parts, sizes = [], []
    for lo, hi, data, offsets in slices(texts, 1 << 20):
        data = LOWER[data]
        member = WORD[data]
        starts, ends, doc = runs(member, offsets)
        count = np.bincount(doc, minlength=hi - lo)
        out = np.full(len(starts) + hi - lo, END)
        out[np.arange(len(starts)) + np.repeat(np.arange(hi - lo), count)] = hash_runs(data, member, starts, ends)
        parts.append(out)
        sizes.append(count + 1)
    return (np.concatenate(parts), np.concatenate(sizes)) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


class Block:
    """A block's tokens and bigrams, each as sorted distinct keys and places in them."""

    def __init__(self, texts: pa.Array):
        tokens, self.sizes = tokens_of(texts)
        self.tokens, self.token = np.unique(tokens, return_inverse=True)
        before = np.empty_like(tokens)
        before[1:] = tokens[:-1]
        before[:1] = END  # an end precedes every text
        self.pairs, self.pair = np.unique(mix(before * np.uint64(0x9E3779B97F4A7C15) + tokens), return_inverse=True)


def spans_of(keys: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """The shards (highest bits) of sorted keys, and where each one's keys start."""
    shard = (keys >> np.uint64(shift)).astype(np.int64)
    first = np.flatnonzero(np.diff(shard, prepend=-1))
    return shard[first], np.append(first, len(keys))


def packed_keys(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys: the number of bytes that their differences take, then these byte
    by byte."""
    if not len(keys):
        return b""
    steps = np.diff(keys, prepend=np.uint64(0))
    head, steps[0] = keys[:1].tobytes(), 0
    width = -(-int(steps.max()).bit_length() // 8)
    return bytes([width]) + head + steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpacked_keys(data: bytes, n: int) -> np.ndarray:
    """The ``n`` keys again."""
    if not n:
        return np.zeros(0, np.uint64)
    wide = np.zeros((n, 8), np.uint8)
    wide[:, : data[0]] = np.frombuffer(data, np.uint8, n * data[0], 9).reshape(data[0], n).T
    steps = wide.view("<u8").ravel()
    steps[0] = np.frombuffer(data, np.uint64, 1, 1)[0]
    return np.cumsum(steps, dtype=np.uint64)


def packed(counts: np.ndarray) -> bytes:
    """Counts, mostly small: a byte each, 255 standing for one of the list behind."""
    large = counts >= 255
    return np.where(large, 255, counts).astype(np.uint8).tobytes() + counts[large].astype(np.uint64).tobytes()


def unpacked(data: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(data, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(data, np.uint64, offset=n)
    return out


def score_corpus(docs: DataFrame, *, train_col: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every document with counts of those whose boolean ``train_col`` is true.

    One row per document row: the id, ``train_col``, ``n_tokens`` (with the end),
    ``n_known``, ``train_tokens``, ``base_score`` (exact unigrams) and ``score`` (the
    model), both base-10 logarithms of the text's probability.  Null and empty texts are
    their end alone.  Rows repeated are counted and scored each.  Without training
    documents every count is 0 and both scores are those of one unknown word.  An empty
    table gives none; other columns are ignored.
    """
    tune(docs.sparkSession)
    size = scan_bytes(docs.select(id_col, text_col))
    part = min(1.0, math.sqrt(size / (STEEP * BLOCK_BYTES)))
    blocks = max(1, math.ceil(size / (part * BLOCK_BYTES))) if size else 1
    shard_bits = max(1, math.ceil(math.log2(max(2, size / (part * SHARD_BYTES))))) if size else 1
    shift = 64 - shard_bits
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.col(train_col), F.lit(False)).alias("train"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks))).repartition(min(blocks, 100_000), "block")

    def ask(key: tuple, table: pa.Table) -> pa.Table:
        block = Block(table.column("text").combine_chunks())
        train = np.repeat(table.column("train").to_numpy(), block.sizes)
        counts = [np.bincount(place[train], minlength=len(keys)) for keys, place in ((block.tokens, block.token), (block.pairs, block.pair))]
        parts: dict[int, list[tuple[bytes, bytes, int]]] = {}
        for kind, keys in enumerate((block.tokens, block.pairs)):
            shards, at = spans_of(keys, shift)
            for shard, a, b in zip(shards.tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                parts.setdefault(shard, [(b"", b"", 0)] * 2)[kind] = packed_keys(keys[a:b]), packed(counts[kind][a:b]), b - a
        column = lambda kind, k, form: pa.array([x[kind][k] for x in parts.values()], form)
        return pa.table({
            "shard": pa.array(list(parts), pa.int64()), "block": pa.array([key[0].as_py()] * len(parts), pa.int64()),
            "tokens": column(0, 0, pa.binary()), "token_counts": column(0, 1, pa.binary()), "n_tokens": column(0, 2, pa.int64()),
            "pairs": column(1, 0, pa.binary()), "pair_counts": column(1, 1, pa.binary()), "n_pairs": column(1, 2, pa.int64()),
        })

    def answer(table: pa.Table) -> pa.Table:
        def summed(keys: str, counts: str, n: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            size = table.column(n).to_pylist()
            own = [unpacked_keys(x, k) for x, k in zip(table.column(keys).to_pylist(), size, strict=True)]
            n = np.concatenate([unpacked(x, k) for x, k in zip(table.column(counts).to_pylist(), size, strict=True)])
            unique, place = np.unique(np.concatenate(own), return_inverse=True)
            return unique, np.bincount(place, n, len(unique)).astype(np.int64), place, np.cumsum([0, *size])

        _, count, place, at = summed("tokens", "token_counts", "n_tokens")
        pairs, pair_count, pair_place, pair_at = summed("pairs", "pair_counts", "n_pairs")
        levels = LogFrequencyFilter(pairs[pair_count > 0], pair_count[pair_count > 0]).levels(pairs)[pair_place]
        counts = count[place]
        first = np.zeros(table.num_rows, np.int64)
        known, total = first.copy(), first.copy()
        known[0], total[0] = (count > 0).sum(), count.sum()  # once a shard
        return pa.table({
            "block": table.column("block"), "shard": table.column("shard"), "known": pa.array(known), "total": pa.array(total),
            "counts": pa.array([packed(counts[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary()), "levels": pa.array([levels[a:b].tobytes() for a, b in zip(pair_at[:-1], pair_at[1:], strict=True)], pa.binary()),
        })

    def score(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        block = Block(table.column("text").combine_chunks())
        answers = answers.sort_by("shard")
        shard = answers.column("shard").to_numpy()

        def gathered(keys: np.ndarray, column: str, read) -> np.ndarray:
            shards, at = spans_of(keys, shift)
            data = answers.column(column)
            return np.concatenate([read(data[k].as_py(), n) for k, n in zip(np.searchsorted(shard, shards).tolist(), np.diff(at).tolist(), strict=True)])

        count = gathered(block.tokens, "counts", unpacked)[block.token]
        level = gathered(block.pairs, "levels", lambda data, n: np.frombuffer(data, np.uint8, n))[block.pair]
        context = np.empty_like(count)
        context[1:] = count[:-1]
        first = np.concatenate([[0], np.cumsum(block.sizes)[:-1]])
        context[first] = count[first[0] + block.sizes[0] - 1]  # the end's count
        single, both = mixed(count, context, level.astype(np.int64), total, known)
        add = lambda x: np.add.reduceat(x, first)
        return pa.table({
            "id": table.column("id"), "train": table.column("train"), "n_tokens": pa.array(block.sizes), "n_known": pa.array(add((count > 0).astype(np.int64))),
            "train_tokens": pa.array([total] * table.num_rows, pa.int64()), "base_score": pa.array(add(np.log10(single))), "score": pa.array(add(np.log10(both))),
        })

    asked = rows.groupBy("block").applyInArrow(ask, "shard bigint, block bigint, tokens binary, token_counts binary, n_tokens bigint, pairs binary, pair_counts binary, n_pairs bigint")
    answers = persist(asked.groupBy("shard").applyInArrow(answer, "block bigint, shard bigint, known bigint, total bigint, counts binary, levels binary"), "answers")
    known, total = (n or 0 for n in answers.agg(F.sum("known"), F.sum("total")).first())
    kind = rows.schema["id"].dataType.simpleString()
    scored = rows.groupBy("block").cogroup(answers.select("block", "shard", "counts", "levels").groupBy("block")).applyInArrow(score, f"id {kind}, train boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
    return scored.select(F.col("id").alias(id_col), F.col("train").alias(train_col), "n_tokens", "n_known", "train_tokens", "base_score", "score")
