"""Connected components of a distributed edge list, and set filters sized by count."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.common import persist

#: Bits of a filter for each id, and the least and the most bits of one (16 MB).
BITS_PER_ID, LEAST_BITS, MOST_BITS = 16, 1 << 17, 1 << 27
_PAGE = 32768  # bits of one bitmap of bitmap_construct_agg


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root: the smallest node.

    Large-star and small-star steps in turn, until the edges no longer change.  Every
    step is an aggregate and a join; lineage is cut in the shared folder each round.
    No node's neighbours are gathered in one place.
    """
    stars = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    stars, before = persist(stars, "edges"), None
    for _ in range(most_rounds):
        both = stars.unionAll(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        stars = persist(small.where("a <> b").distinct(), "edges")
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("the components did not settle")
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(stars.select(F.col("b"), F.col("b"))).distinct()


def filter_bits(n: int) -> int:
    """Bits of a filter of n ids; 0 where it would let most other ids pass."""
    bits = max(LEAST_BITS, 1 << max(0, BITS_PER_ID * n - 1).bit_length())
    return min(bits, MOST_BITS) if n < MOST_BITS else 0


def filter_slot(column, bits: int) -> F.Column:
    """The bit that stands for an id."""
    return F.pmod(F.xxhash64(column), F.lit(bits)).cast("int")


def id_filter(ids: DataFrame, column: str, size: int) -> np.ndarray:
    """A bitmap of ``size`` bits of the ids' slots: tells surely that an id is not in
    ``ids``.  Aggregated to pages of 4 KB, of which MOST_BITS make 4096."""
    slot = filter_slot(F.col(column), size)
    pages = ids.select(slot.alias("s")).groupBy((F.col("s") / _PAGE).cast("int").alias("page")).agg(F.bitmap_construct_agg(F.col("s").cast("long") % _PAGE).alias("bits"))
    out = np.zeros(size // 8, np.uint8)
    for page, bits in pages.collect():
        out[page * (_PAGE // 8) : (page + 1) * (_PAGE // 8)] = np.frombuffer(bits, np.uint8)
    return out


def maybe_in(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bits[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 == 1
