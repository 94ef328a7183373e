"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

For every prefix of a piece the last token of its encoding is unique.  An automaton
of all vocabulary entries (a trie with suffix links) reads the piece byte by byte
and lists the entries that end at each place, longest first.  An entry is the
prefix's last token if it starts the piece, or if it is compatible with the last
token of the prefix before it: no merge across their border comes before the merges
that build the two.  Following the stored tokens back from the end gives the ids.
Nothing is merged step by step, and time is linear in the piece.

The tokenizer file's content is broadcast (a few MB, checked); each Python worker
builds the automaton once and remembers the ids of chunks (words) within a bound.
The work is one scan without a shuffle.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from gaugeworks.llm.chunks import SPACE, ChunkTable, Splitter, encoded
from gaugeworks.llm.common import tune, worker_kept

#: The largest tokenizer file that is broadcast, in bytes.
MOST_BYTES = 64 << 20
#: The pattern that cuts a chunk into pieces (a fixed value of byte-level BPE).
PIECE = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
NEVER = 1 << 60
#: Pairs of tokens whose compatibility a worker remembers before it starts anew.
MOST_PAIRS = 300_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable
    Latin-1 stands for itself, the other bytes for 256, 257 and on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class PrefixEncoder:
    """Encodes pieces with one vocabulary."""

    def __init__(self, spec: str):
        model, letters = json.loads(spec)["model"], byte_letters()
        ids = model["vocab"]
        self.bytes_of = {n: bytes(letters[c] for c in token) for token, n in ids.items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merge, self.parts, self.rank = {}, {}, {}
        for k, (a, b) in enumerate(merges):
            whole = ids[a + b]
            self.merge[ids[a], ids[b]] = k
            self.parts[whole], self.rank[whole] = (ids[a], ids[b]), k
        self.splitter = Splitter(spec)
        self.bytes_of |= {n: content.encode() for content, n in self.splitter.added.items()}
        self.compatible: dict[int, bool] = {}
        self._spines: tuple[dict, dict] = ({}, {})
        self._automaton(list(self.bytes_of.items()))
        self.table = ChunkTable(self._learn)

    def _automaton(self, entries: list[tuple[int, bytes]]) -> None:
        """States of the trie; ``step`` gets missing transitions when they're used."""
        own = {n for n in self.splitter.added.values()}
        self.step: dict[int, int] = {}
        ends, depth = [0], [0]
        token_at: list[int | None] = [None]
        for n, word in entries:
            if n in own or (len(word) > 1 and n not in self.parts):
                continue  # added tokens are split off before; an entry that no merge makes is never an id
            state = 0
            for byte in word:
                key = state << 8 | byte
                state = self.step.get(key) or self.step.setdefault(key, len(depth))
                if state == len(depth):
                    depth.append(depth[key >> 8] + 1)
                    token_at.append(None)
            token_at[state] = n
        below: list[list[int]] = [[] for _ in depth]
        for key in self.step:
            below[key >> 8].append(key)
        self.suffix, ends = [0] * len(depth), [()] * len(depth)
        queue = [0]
        for state in queue:
            for key in below[state]:
                child = self.step[key]
                if state:
                    self.suffix[child] = self.move(self.suffix[state], key & 255)
                shorter = ends[self.suffix[child]]
                ends[child] = ((token_at[child], depth[child]), *shorter) if token_at[child] is not None else shorter
                queue.append(child)
        self.ends = ends

    def move(self, state: int, byte: int) -> int:
        """The state of the longest known suffix after one more byte."""
        path = []
        while (found := self.step.get(state << 8 | byte)) is None:
            path.append(state)
            if not state:
                found = 0
                break
            state = self.suffix[state]
        for s in path:
            self.step[s << 8 | byte] = found
        return found

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """Nodes of a token's merge tree along its left (0) or right (1) border, with
        the rank of the merge that hides each."""
        if (known := self._spines[side].get(token)) is None:
            known, hidden, node = [], NEVER, token
            while True:
                known.append((node, hidden))
                if node not in self.parts:
                    break
                hidden, node = self.rank[node], self.parts[node][side]
            self._spines[side][token] = known
        return known

    def fits(self, a: int, b: int) -> bool:
        """Whether the border between neighbours a and b stays.  Of equal merges the
        left one comes first, so a merge across wins a tie with b's, not with a's."""
        merge, right = self.merge, self._spine(b, 0)
        known = True
        for u, hidden_u in self._spine(a, 1):
            for v, hidden_v in right:
                m = merge.get((u, v))
                if m is not None and m < hidden_u and m <= hidden_v:
                    known = False
        if len(self.compatible) > MOST_PAIRS:
            self.compatible.clear()
        self.compatible[a << 20 | b] = known
        return known

    def piece(self, data: bytes) -> list[int]:
        """The ids of one piece."""
        state, step, ends, known = 0, self.step, self.ends, self.compatible
        tokens, sizes = [-1], [0]
        for place, byte in enumerate(data, 1):
            nxt = step.get(state << 8 | byte)
            state = self.move(state, byte) if nxt is None else nxt
            for token, size in ends[state]:
                if size == place:
                    break
                before = tokens[place - size]
                fit = known.get(before << 20 | token)
                if fit or fit is None and self.fits(before, token):
                    break
            else:
                raise ValueError("no token ends here: the vocabulary lacks a byte")
            tokens.append(token)
            sizes.append(size)
        out, place = [], len(data)
        while place:
            out.append(tokens[place])
            place -= sizes[place]
        return out[::-1]

    def stretch(self, text: str) -> list[int]:
        """The ids of a text without added tokens."""
        return [n for p in PIECE.findall(text) for n in self.piece(p.encode())]

    def _learn(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = [self.stretch(c.decode()) for c in chunks]
        size = np.array([len(x) for x in found])
        return np.fromiter((n for x in found for n in x), np.uint32, int(size.sum())), size

    def encode(self, text: str | None) -> list[int]:
        """The ids of a whole text; none for null."""
        added = self.splitter.added
        return [n for part in self.splitter.segments(text or "") for n in ([added[part]] if part in added else self.stretch(part))]

    def encode_all(self, texts: pa.Array) -> Iterator[list[int]]:
        """The ids of each text of a column, chunk by chunk with a memory."""
        for _, _, ids, size in encoded(texts, self.table, self.splitter, lambda t: np.array(self.encode(t), np.uint32)):
            for part in np.split(ids, np.cumsum(size)[:-1]):
                yield part.tolist()

    def encode_column(self, texts: pa.Array) -> pa.ListArray:
        """The ids of each text of a column as one list array, without Python numbers."""
        parts, sizes = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
        for _, _, ids, size in encoded(texts, self.table, self.splitter, lambda t: np.array(self.encode(t), np.uint32)):
            parts.append(ids.astype(np.int32))
            sizes.append(size)
        return pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(sizes)).astype(np.int32)), pa.array(np.concatenate(parts)))

    def decode(self, ids: list[int]) -> str:
        """The text of ids, added tokens included; broken UTF-8 as U+FFFD."""
        table = self.bytes_of
        return b"".join([table[n] for n in ids]).decode("utf-8", "replace")


def encoder_of(spec: str) -> PrefixEncoder:
    """The worker's encoder for a tokenizer."""
    return worker_kept(("bpe", spec), lambda: PrefixEncoder(spec))


def read_spec(path: str) -> str:
    """A tokenizer file's content, if it is small enough to broadcast."""
    with open(path, "rb") as f:
        data = f.read(MOST_BYTES + 1)
    if len(data) > MOST_BYTES:
        raise ValueError(f"{path} is larger than {MOST_BYTES} bytes")
    return data.decode()


def _mapped(docs: DataFrame, path: str, text_col: str, schema: str, make: Callable[[pa.RecordBatch, pa.Array, PrefixEncoder], list[pa.Array]]) -> DataFrame:
    tune(docs.sparkSession)
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(path))
    place = docs.columns.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(spec.value)
        for batch in batches:
            names, columns = make(batch, batch.column(place), encoder)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(work, schema)


def encode_documents(docs: DataFrame, path: str, *, text_col: str = "text", ids_col: str = "token_ids") -> DataFrame:
    """``docs`` with the ids of each whole text in place of the text: ``ids_col``, an
    array of int.  Null and empty texts have no ids.  Other columns, repeated rows and
    empty tables pass through; a column named ``ids_col`` is replaced."""
    others = [f for f in docs.schema if f.name not in (text_col, ids_col)]
    names = [f.name for f in others]

    def make(batch, texts, encoder):
        return [*names, ids_col], [*(batch.column(n) for n in names), encoder.encode_column(texts)]

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in others), f"`{ids_col}` array<int>"])
    return _mapped(docs, path, text_col, schema, make)


def decode_documents(tokens: DataFrame, path: str, *, ids_col: str = "token_ids", text_col: str = "text") -> DataFrame:
    """The reverse: ids to text.  Null ids give an empty text."""
    others = [f for f in tokens.schema if f.name not in (text_col, ids_col)]
    names = [f.name for f in others]

    def make(batch, ids, encoder):
        return [*names, text_col], [*(batch.column(n) for n in names), pa.array([encoder.decode(x.as_py() or ()) for x in ids], pa.string())]

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in others), f"`{text_col}` string"])
    return _mapped(tokens, path, ids_col, schema, make)


def digest_documents(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every text, keeping digests only: ``n_tokens``,
    ``ids_sha256`` of the decimal ids joined by commas, ``decoded_sha256`` of the
    decoded text.  Null texts count as empty."""

    def make(batch, texts, encoder):
        digits = _digits(encoder)
        n, ids_hash, text_hash = [], [], []
        for ids in encoder.encode_all(texts):
            n.append(len(ids))
            ids_hash.append(hashlib.sha256(",".join([digits[k] for k in ids]).encode()).hexdigest())
            text_hash.append(hashlib.sha256(encoder.decode(ids).encode()).hexdigest())
        return [id_col, "n_tokens", "ids_sha256", "decoded_sha256"], [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_hash), pa.array(text_hash)]

    kind = docs.schema[id_col].dataType.simpleString()
    return _mapped(docs.select(id_col, text_col), path, text_col, f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string", make)


def _digits(encoder: PrefixEncoder) -> list[str]:
    if not hasattr(encoder, "digits"):
        encoder.digits = list(map(str, range(max(encoder.bytes_of) + 1)))
    return encoder.digits
