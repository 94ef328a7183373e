"""Token-id output in directly addressable codes.

An id is cut into chunks of 8 bits, lowest first.  Level k holds the k-th chunk of
all ids that have one, and a bitmap that tells which of them go on to level k+1; a
rank directory over the bitmap gives the place there.  So any id is read by one rank
a level, without decoding a block.

Documents are dealt by ranges of doc_id and sorted within a range, tokenized, and
written as segments of whole documents: one file image a row, in a parquet dataset
that Spark commits task by task, so a lost executor leaves no torn file.  A segment
holds the doc_ids, the document bounds and the ids, each addressable.  Where a
segment starts in the whole stream follows from the totals of the ranges before it,
a few numbers for each range.

One shuffle: the documents' ids and texts, to their ranges.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeworks.llm.bpe import read_spec
from gaugeworks.llm.chunks import ChunkTable, Splitter, encoded
from gaugeworks.llm.common import scan_bytes, shared_path, tune, worker_kept

MAGIC = b"DAC1"
#: Columns of the dataset that holds the file images.
FILES = "part int, seq int, n_docs bigint, n_tokens bigint, image binary"
#: Ids of a segment before it is closed, input bytes of a range.
SEGMENT_IDS, RANGE_BYTES = 1 << 20, 8 << 20
#: Characters of a text that order rows of one id; ranges whose totals are summed together.
PREFIX, RANGES = 64, 4096
#: Bitmap bits for each entry of a rank directory.
BLOCK = 512


def encode(ids: np.ndarray) -> bytes:
    """Directly addressable codes of unsigned 32-bit ids."""
    out, level = [], ids.astype(np.uint32)
    while len(level):
        more = level > 255
        bits = np.zeros(-(-len(level) // BLOCK) * BLOCK, np.uint8)
        bits[: len(level)] = more
        packed = np.packbits(bits, bitorder="little")
        ranks = np.zeros(len(bits) // BLOCK, np.uint32)
        np.cumsum(np.bitwise_count(packed.view(np.uint64)).reshape(-1, BLOCK // 64).sum(axis=1)[:-1], out=ranks[1:])
        out += [struct.pack("<Q", len(level)), (level & 255).astype(np.uint8).tobytes(), ranks.tobytes(), packed.tobytes()]
        level = level[more] >> 8
    return struct.pack("<Q", sum(map(len, out))) + b"".join(out)


class Codes:
    """Reads codes: one id, a range, or all."""

    def __init__(self, data: bytes, at: int = 0):
        (size,) = struct.unpack_from("<Q", data, at)
        self.end, at = at + 8 + size, at + 8
        self.levels = []
        while at < self.end:
            (n,) = struct.unpack_from("<Q", data, at)
            blocks = -(-n // BLOCK)
            chunk = np.frombuffer(data, np.uint8, n, at + 8)
            ranks = np.frombuffer(data, np.uint32, blocks, at + 8 + n)
            bits = np.frombuffer(data, np.uint8, blocks * BLOCK // 8, at + 8 + n + 4 * blocks).copy()  # aligned, to be read as words
            self.levels.append((chunk, ranks, bits))
            at += 8 + n + 4 * blocks + blocks * BLOCK // 8

    def __len__(self) -> int:
        return len(self.levels[0][0]) if self.levels else 0

    def __getitem__(self, i: int) -> int:
        """The i-th id, by one rank a level."""
        if not 0 <= i < len(self):
            raise IndexError(i)
        out, shift = 0, 0
        for chunk, ranks, bits in self.levels:
            out |= int(chunk[i]) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            lo = i // BLOCK * (BLOCK // 8)
            whole = bits[lo : i >> 3]
            i = int(ranks[i // BLOCK]) + int(np.bitwise_count(whole).sum()) + int(np.bitwise_count(bits[i >> 3] & ((1 << (i & 7)) - 1)))
            shift += 8
        return out

    def take(self, places: np.ndarray) -> np.ndarray:
        """The ids at any places: ranks of all of them, a level at a time."""
        i = np.asarray(places, np.int64)
        if len(i) and not 0 <= i.min() <= i.max() < len(self):
            raise IndexError(f"places outside 0 to {len(self) - 1}")
        out, live, shift = np.zeros(len(i), np.uint32), np.arange(len(i)), 0
        for chunk, ranks, bits in self.levels:
            out[live] |= chunk[i].astype(np.uint32) << np.uint32(shift)
            more = (bits[i >> 3] >> (i & 7).astype(np.uint8)) & 1 == 1
            live, i = live[more], i[more]
            if not len(live):
                break
            ones = np.bitwise_count(bits.view(np.uint64)).astype(np.int64)
            before = np.concatenate([[0], np.cumsum(ones)])[i >> 6] - np.concatenate([[0], np.cumsum(ones)])[i // BLOCK * (BLOCK // 64)]
            rest = np.bitwise_count(bits.view(np.uint64)[i >> 6] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))
            i, shift = ranks[i // BLOCK] + before + rest, shift + 8
        return out

    def all(self) -> np.ndarray:
        """Every id, level by level from the last."""
        above = np.zeros(0, np.uint32)
        for chunk, _, bits in reversed(self.levels):
            level = chunk.astype(np.uint32)
            more = np.unpackbits(bits, count=len(chunk), bitorder="little").view(bool)
            level[more] |= above << np.uint32(8)
            above = level
        return above


def segment(doc_ids: list[int | None], sizes: list[int], ids: np.ndarray) -> bytes:
    """A file image: header, doc_ids with null flags, and the codes of sizes and ids."""
    known = np.array([d is not None for d in doc_ids], np.uint8)
    plain = np.array([d or 0 for d in doc_ids], np.int64)
    return MAGIC + struct.pack("<Q", len(doc_ids)) + known.tobytes() + plain.tobytes() + encode(np.array(sizes, np.uint32)) + encode(ids)


class Segment:
    """Opens a file image."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a segment of directly addressable codes")
        (n,) = struct.unpack_from("<Q", data, 4)
        known = np.frombuffer(data, np.uint8, n, 12)
        plain = np.frombuffer(data, np.int64, n, 12 + n)
        self.doc_ids = [int(d) if k else None for d, k in zip(plain, known, strict=True)]
        sizes = Codes(data, 12 + 9 * n)
        self.sizes, self.ids = sizes.all().astype(np.int64), Codes(data, sizes.end)


class LibraryEncoder:
    """Whole texts through the tokenizers library: each distinct chunk is encoded once.
    New chunks go to the library in one text, a line each: a line end before a chunk
    is a piece of its own, so its id parts the chunks' ids again."""

    def __init__(self, spec: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.splitter, self.library, self.table = Splitter(spec), Tokenizer.from_str(spec), ChunkTable(self._learn)
        self.library.no_truncation()
        self.library.no_padding()
        (self.line_end,) = self.text("\n").tolist()

    def text(self, text: str) -> np.ndarray:
        """The ids of one text as the library gives them."""
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _learn(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        words = [c for c in chunks if not c.isspace()]
        ids = self.text(b"\n".join([b"", *words]).decode())
        ends = ids == self.line_end
        ids, size = ids[~ends], np.diff(np.append(np.flatnonzero(ends), len(ids))) - 1
        if len(words) == len(chunks):
            return ids, size
        found = iter(np.split(ids, np.cumsum(size)[:-1]) if words else ())
        parts = [self.text(c.decode()) if c.isspace() else next(found) for c in chunks]
        return np.concatenate(parts), np.array([len(p) for p in parts])

    def __call__(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, end row, ids, ids of each row) for runs of rows."""
        return encoded(texts, self.table, self.splitter, self.text)


def encoder_of(spec: str) -> LibraryEncoder:
    """The worker's encoder for a tokenizer."""
    return worker_kept(("library", spec), lambda: LibraryEncoder(spec))


def write_tokens(docs: DataFrame, path: str, tokenizer: str, *, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Tokenize every text, append ``end_id`` and write segments below ``path`` in
    ascending order of id; returns ``path``.

    Null and empty texts are the end id alone.  Rows with equal ids are in order of their
    first PREFIX characters, then of a hash of the text; so an id that many rows share is
    cut into ranges as any other.  Null ids come first.  An empty table writes no segment;
    other columns are ignored.
    """
    spark = docs.sparkSession
    tune(spark)
    spec = spark.sparkContext.broadcast(read_spec(tokenizer))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ranges = max(1, -(-scan_bytes(rows) // RANGE_BYTES))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_texts = encoder_of(spec.value)
        part, seq = TaskContext.get().partitionId(), 0
        names, sizes, data, n = [], [], [], 0

        def closed() -> pa.RecordBatch:
            image = segment(names, sizes, np.concatenate(data))
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "n_docs": pa.array([len(names)], pa.int64()), "n_tokens": pa.array([n], pa.int64()), "image": pa.array([image], pa.binary())})

        for batch in batches:
            for lo, hi, ids, size in encode_texts(batch.column(1)):
                ended = np.full(len(ids) + hi - lo, end_id, np.uint32)
                ended[np.arange(len(ids)) + np.repeat(np.arange(hi - lo), size)] = ids
                names += batch.column(0).slice(lo, hi - lo).to_pylist()
                sizes += (size + 1).tolist()
                data.append(ended)
                n += len(ended)
                if n >= SEGMENT_IDS:
                    yield closed()
                    seq += 1
                    names, sizes, data, n = [], [], [], 0
        if names:
            yield closed()

    # equal rows may lie in any order, so where a row was read parts them as a last resort
    ties = [F.col("doc_id"), F.substring("text", 1, PREFIX).alias("head"), F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("read")]
    keyed = rows.select("text", *ties).repartitionByRange(ranges, "doc_id", "head", "hash", "read").sortWithinPartitions("doc_id", "head", "hash")
    keyed.select("doc_id", "text").mapInArrow(work, FILES).write.option("parquet.block.size", 16 << 20).parquet(path)
    return path


def segment_starts(files: DataFrame) -> DataFrame:
    """(part, seq, before): the ids before each segment.  Totals are summed within groups
    of RANGES ranges, then over the groups, so no task orders all ranges."""
    segments = files.select("part", "seq", "n_tokens", F.floor(F.col("part") / RANGES).alias("group"))
    parts = segments.groupBy("group", "part").agg(F.sum("n_tokens").alias("size"))
    running = F.sum("size").over(Window.partitionBy("group").orderBy("part")) - F.col("size")
    groups = parts.groupBy("group").agg(F.sum("size").alias("size"))
    groups = groups.select("group", (F.sum("size").over(Window.orderBy("group")) - F.col("size")).alias("group_start"))
    parts = parts.select("group", "part", running.alias("inside")).join(groups, "group").select("part", (F.col("group_start") + F.col("inside")).alias("part_start"))
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_tokens")
    return segments.select("part", "seq", inside.alias("seq_start")).join(parts, "part").select("part", "seq", (F.col("part_start") + F.col("seq_start")).alias("before"))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """What the files hold, one row per document in the order of the files: ``doc_id`` (null
    as written), ``start`` (ids of all documents before it), ``n_tokens`` and ``ids_crc32``.
    A folder without segments gives none."""
    tune(spark)
    files = spark.read.schema(FILES).parquet(path)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, image in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                s = Segment(image.as_py())
                data, ends = s.ids.all().astype("<u4").tobytes(), np.cumsum(s.sizes)
                crc = [zlib.crc32(data[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), s.sizes.tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([part.as_py()] * len(crc), pa.int32()), "seq": pa.array([seq.as_py()] * len(crc), pa.int32()),
                    "doc_id": pa.array(s.doc_ids, pa.int64()), "inside": pa.array(ends - s.sizes), "n_tokens": pa.array(s.sizes), "ids_crc32": pa.array(crc, pa.int64()),
                })

    rows = files.select("part", "seq", "image").mapInArrow(work, "part int, seq int, doc_id bigint, inside bigint, n_tokens bigint, ids_crc32 bigint")
    return rows.join(segment_starts(files), ["part", "seq"]).select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def read_ids(spark: SparkSession, path: str, start: int, end: int) -> DataFrame:
    """(position, id) of the ids at positions ``start`` to ``end`` - 1 of the whole stream.
    Only segments that hold some are opened, and only those ids are decoded; positions
    outside the stream give no row."""
    tune(spark)
    files = spark.read.schema(FILES).parquet(path)
    wanted = segment_starts(files).join(files.select("part", "seq", "n_tokens"), ["part", "seq"])
    wanted = wanted.where((F.col("before") < end) & (F.col("before") + F.col("n_tokens") > start)).select("part", "seq", "before")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for before, image in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                codes = Segment(image.as_py()).ids
                places = np.arange(max(start - before, 0), min(end - before, len(codes)))
                yield pa.RecordBatch.from_pydict({"position": pa.array(places + before), "id": pa.array(codes.take(places).astype(np.int64))})

    return files.join(F.broadcast(wanted), ["part", "seq"]).select("before", "image").mapInArrow(work, "position bigint, id bigint")


def round_trip(docs: DataFrame, tokenizer: str, *, end_id: int) -> DataFrame:
    """Write the files to the shared folder and read them back."""
    return read_tokens(docs.sparkSession, write_tokens(docs, shared_path(docs.sparkSession, "tokens"), tokenizer, end_id=end_id))
