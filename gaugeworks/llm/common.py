"""Shared helpers: session settings, shared storage and vectorised text scanning.

The scanning helpers work on the UTF-8 bytes of a whole Arrow batch at once, so
one pass costs a few tens of nanoseconds a byte and never builds a Python object
per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.session import BATCH_BYTES, BATCH_ROWS, persist, shared_path, ship, tune  # noqa: F401  (operators take them from here)

#: Bytes of text that a scanning step holds as work arrays at a time.
SLICE_BYTES = 1 << 21


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Read only the named columns of one parquet table."""
    df = ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


_KEPT: dict = {}


def worker_kept(key, make):
    """What a Python worker keeps from one task to the next: the thing of one key at a
    time, so that stages of other operators don't add up in its memory."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores behind it until no column has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def scan_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of a plan's input in bytes: file sizes, no job.  Where
    the plan doesn't know (rows that don't come from files), 16 MB a partition."""
    known = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return known if known < 1 << 60 else df.rdd.getNumPartitions() << 24


def remainder(doc_id, modulus: int):
    """crc32 of the decimal doc_id, modulo ``modulus``; a null id counts as ''."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


# ---------------------------------------------------------------- byte scanning

#: Maps A-Z to a-z, every other byte to itself.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a text column into runs of whole documents of about ``limit`` bytes:
    (first row, end row, bytes, offsets from 0).  One longer text is one run."""
    data, at = texts_of(column)
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def runs(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of member bytes that don't cross a document's bounds:
    (starts, ends, document of each)."""
    n = len(member)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first = member.copy()
    first[1:] &= ~member[:-1] | edge[1:n]
    last = member.copy()
    last[:-1] &= ~member[1:] | edge[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


#: Places of a run whose random numbers are looked up; those of later places are computed.
_PLACES = 256
_NUMBERS = mix(np.arange(_PLACES << 8, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019))


def hash_runs(data: np.ndarray, member: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes: the sum of a random number for each byte at its
    place, and the length.  Runs of different bytes meet as random numbers do, whatever
    their structure."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    first = np.zeros(len(size), np.int64)
    np.cumsum(size[:-1], out=first[1:])
    place = np.arange(int(size.sum()), dtype=np.int32)
    place -= np.repeat(first.astype(np.int32), size)
    key = place << 8 if size.max() < 1 << 22 else place.astype(np.int64) << 8
    key |= data[member]
    if size.max() <= _PLACES:
        value = _NUMBERS[key]
    else:
        value = _NUMBERS[np.minimum(key, len(_NUMBERS) - 1)]
        late = np.flatnonzero(place >= _PLACES)
        value[late] = mix(key[late].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019))
    return mix(np.add.reduceat(value, first) ^ (size.astype(np.uint64) << np.uint64(40)))


def byte_class(*spans: tuple[int, int]) -> np.ndarray:
    """A table of 256 flags: the bytes of the given closed ranges."""
    out = np.zeros(256, bool)
    for a, b in spans:
        out[a : b + 1] = True
    return out
