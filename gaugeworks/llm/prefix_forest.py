"""Approximate nearest neighbours by cosine with a hash-prefix forest.

Vectors are hashed to strings of bits by random projections, each cut at its median over a
bounded sample.  The first bits of one string name a cell; cells hold some ``SHARD``
vectors, and one that holds more is cut into parts.  In a part every tree keeps the strings
of its own projections as one sorted array.  A query goes to its own cell and to those
whose bits differ only where its projections lie near the cut (their distances summed are
at most ``reach``).  There it descends each tree to its longest matching prefix; then all
trees ascend together, one bit a step, until the rows that share that prefix in some tree
are enough (``share`` of the part a tree).  These candidates are ranked by their exact
cosine in double precision, and the parts' best are merged.

How far a query must reach and how much of a part it must see depends on the data: vectors
that lie in clusters need little of either, vectors without structure most of the table.
Both are fitted on at most ``SAMPLE`` queries, whose true neighbours are found by comparing
them with every vector, so that ``RECALL`` of these neighbours are found; where nothing less
does, whole parts of all cells are looked at.

Equal vectors are collapsed before that (the smallest ids are enough for any answer),
so a hot vector costs as much as any other.  A task holds one part and one block of the
queries that reach it, whatever the table's size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.llm.common import persist, tune

#: Trees, and bits of a hash string.
TREES, BITS = 24, 48
#: Vectors of a part, queries of a block, and bits that name a cell at most.
SHARD, BLOCK, MOST_CELL_BITS = 32_000, 8_000, 20
#: Vectors whose projections give the medians; queries whose true neighbours are sought;
#: the share of these that reach, and then share, are fitted to.
MEDIANS, SAMPLE, RECALL = 2000, 256, 0.985
#: Shares of a part that are tried; the last is all of it.
SHARES = (0.0002, 0.0005, 0.001, 0.002, 0.005, 0.01, 0.02, 0.03, 0.045, 0.07, 0.12, 1.0)


@cache
def planes(tree: int, dim: int, bits: int = BITS) -> np.ndarray:
    """The directions of a tree's projections; those that name cells are tree -1's."""
    return np.random.default_rng([tree + 1, dim]).normal(size=(dim, BITS))[:, :bits]


class Cuts:
    """Where the projections of vectors of one length are cut."""

    def __init__(self, sample: np.ndarray):
        self.dim = sample.shape[1]
        self.at = [np.median(sample @ planes(t, self.dim), axis=0) for t in range(-1, TREES)]

    def margins(self, x: np.ndarray, bits: int) -> np.ndarray:
        """Signed distances of unit vectors to the cuts that part the cells."""
        return x @ planes(-1, self.dim, bits) - self.at[0][:bits]


def hash_strings(x: np.ndarray, tree: int, cuts: Cuts | None = None) -> np.ndarray:
    """The hash strings of vectors in one tree, first bit highest; without cuts the
    projections are cut at 0."""
    bits = x @ planes(tree, x.shape[1]) > (cuts.at[tree + 1] if cuts else 0)
    return (bits.astype(np.uint64) << np.arange(BITS - 1, -1, -1, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def cells_of(margins: np.ndarray) -> np.ndarray:
    return ((margins > 0).astype(np.int64) << np.arange(margins.shape[1])).sum(axis=1)


def cells_within(margins: np.ndarray, reach: float) -> Iterator[int]:
    """The cells that differ from a query's own where its distances sum to ``reach`` at most."""
    own, order = int(cells_of(margins[None])[0]), np.argsort(np.abs(margins))
    steps = [(float(abs(margins[k])), 1 << int(k)) for k in order]
    todo = [(0, 0.0, own)]
    while todo:
        first, cost, cell = todo.pop()
        yield cell
        for k in range(first, len(steps)):
            if cost + steps[k][0] > reach:
                break
            todo.append((k + 1, cost + steps[k][0], cell ^ steps[k][1]))


class Forest:
    """Sorted hash strings of each tree."""

    def __init__(self, x: np.ndarray, trees: int = TREES, cuts: Cuts | None = None):
        self.cuts, self.size, self.order, self.keys = cuts, len(x), [], []
        for t in range(trees):
            keys = hash_strings(x, t, cuts)
            order = np.argsort(keys, kind="stable")
            self.order.append(order)
            self.keys.append(keys[order])

    def ranges(self, strings: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each tree (rows) and query (columns) the rows that share a prefix."""
        free = (BITS - length).astype(np.uint64)
        low = strings >> free << free
        lo = np.stack([np.searchsorted(k, a) for k, a in zip(self.keys, low, strict=True)])
        hi = np.stack([np.searchsorted(k, a) for k, a in zip(self.keys, low + (np.uint64(1) << free), strict=True)])
        return lo, hi

    def candidates(self, x: np.ndarray, share: float) -> Iterator[np.ndarray]:
        """The candidates of each query: descend, then ascend in step until enough."""
        if share >= 1:
            for _ in range(len(x)):
                yield np.arange(self.size)
            return
        strings = np.stack([hash_strings(x, t, self.cuts) for t in range(len(self.keys))])
        length, enough = np.full(len(x), BITS), max(64, int(share * self.size * len(self.keys)))
        climbing = np.arange(len(x))
        while len(climbing):
            lo, hi = self.ranges(strings[:, climbing], length[climbing])
            climbing = climbing[((hi - lo).sum(axis=0) < enough) & (length[climbing] > 0)]
            length[climbing] -= 1
        lo, hi = self.ranges(strings, length)
        for q in range(len(x)):
            found = np.zeros(self.size, bool)
            for t, order in enumerate(self.order):
                found[order[lo[t, q] : hi[t, q]]] = True
            yield np.flatnonzero(found)


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Vectors as rows, scaled so that lengths of tiny or huge ones stay finite."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return x / np.abs(x).max(axis=1, initial=0)[:, None] if len(x) else x


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1)[:, None]


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v, dim) of rows whose vector has a direction."""
    v = F.col(vector_col)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), v.alias("v"), F.size(v).alias("dim"))


def best(q: np.ndarray, long_q: float, x: np.ndarray, long_x: np.ndarray, near: np.ndarray, ids: list, own: int, k: int) -> list[tuple[float, int, int]]:
    """(-cosine, id, row) of a query's k best candidates, itself left out; ties to smaller ids."""
    score = x[near] @ q / (long_x[near] * long_q)
    if len(near) > k + 1:
        top = score >= np.partition(score, -(k + 1))[-(k + 1)]
        near, score = near[top], score[top]
    return sorted((-s, i, j) for s, j in zip(score.tolist(), near.tolist(), strict=True) for i in ids[j] if i != own)[:k]


class Places:
    """Cells of the vectors of each length: bits, cuts, and parts of each cell."""

    def __init__(self, bits: int, cuts: dict[int, Cuts]):
        self.bits, self.cuts, self.parts = bits, cuts, {}

    def count(self, sizes: list[tuple[int, int, int]]) -> None:
        for dim, cell, n in sizes:
            self.parts.setdefault(dim, {})[cell] = -(-n // SHARD)


def fitted(data: DataFrame, asked: DataFrame, shared, k: int) -> tuple[float, float]:
    """(reach, share) under which RECALL of the true neighbours of a sample of queries is
    found.  Every part compares the sample with all its vectors; gathered are the k nearest
    of each query with what it took to find them."""
    rows = asked.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    queries: dict[int, list] = {}
    for r in rows:
        queries.setdefault(r.dim, []).append((r.id, r.v))
    sample = data.sparkSession.sparkContext.broadcast(queries)

    def work(key: tuple, table: pa.Table) -> pa.Table:
        dim, cell = key[0].as_py(), key[1].as_py()
        own, q = zip(*sample.value.get(dim, [(-1, [1.0] * dim)]), strict=True)
        x, q = matrix(table.column("v"), dim), matrix(pa.array(q), dim)
        cuts, ids = shared.value.cuts[dim], table.column("ids").to_pylist()
        long_x, every = np.linalg.norm(x, axis=1), np.arange(len(x))
        true = [best(a, float(np.linalg.norm(a)), x, long_x, every, ids, i, k) if i >= 0 else [] for a, i in zip(q, own, strict=True)]
        level = [[len(SHARES) - 1] * len(t) for t in true]
        forest = Forest(unit(x), cuts=cuts)
        for n in reversed(range(len(SHARES) - 1)):
            for a, near in enumerate(forest.candidates(unit(q), SHARES[n])):
                wanted = np.array([j for _, _, j in true[a]], np.int64)
                inside = np.append(near, -1)[np.searchsorted(near, wanted)] == wanted
                level[a] = [n if hit else old for old, hit in zip(level[a], inside.tolist(), strict=True)]
        margins = cuts.margins(unit(q), shared.value.bits)
        flips = (cells_of(margins) ^ cell)[:, None] >> np.arange(shared.value.bits) & 1
        cost = (np.abs(margins) * flips).sum(axis=1)
        out = [(own[a], i, -s, level[a][n], float(cost[a])) for a in range(len(q)) for n, (s, i, _) in enumerate(true[a])]
        columns = list(zip(*out, strict=True)) if out else [()] * 5
        return pa.table({"query": pa.array(columns[0], pa.int64()), "id": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.float64()), "level": pa.array(columns[3], pa.int64()), "cost": pa.array(columns[4], pa.float64())})

    found = data.groupBy("dim", "cell", "part").applyInArrow(work, "query bigint, id bigint, score double, level bigint, cost double")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    true = found.withColumn("place", place).where(F.col("place") <= k).select("level", "cost").collect()
    if not true:
        return 0.0, SHARES[-1]
    level, cost = (np.sort(np.array(c)) for c in zip(*true, strict=True))
    at = min(len(true) - 1, math.ceil(RECALL * len(true)))
    return float(cost[at]) * (1 + 1e-9), SHARES[int(level[at])]


def nearest(vectors: DataFrame, *, k: int = 5, every: int = 50, share: float | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest found of each query (rows whose id is divisible by ``every``) among
    all other ids: query_id, rank from 1, vec_id, score (the cosine), inspected (different
    vectors the query was compared with); ties go to smaller ids, and there are fewer rows
    where there are fewer candidates.  With a ``share`` nothing is fitted: all cells are
    visited, and so much of each part is seen (1: all of it, which is exact).

    Vectors that are null, empty, zero or hold null or non-finite components take no
    part, nor do rows with a null id; a vector meets only those of its own length.  Rows
    repeated with equal id and vector count once; an id with several vectors is found by
    its nearest, and as a query uses its smallest vector.  An empty table gives none;
    other columns are ignored.
    """
    tune(vectors.sparkSession)
    context = vectors.sparkSession.sparkContext
    rows = usable(vectors, id_col, vector_col)
    first = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    kept = rows.dropDuplicates(["id", "v"]).withColumn("place", first).where(f"place <= {k + 1}")
    unique = persist(kept.groupBy("v", "dim").agg(F.sort_array(F.collect_list("id")).alias("ids")), "vectors")
    n = unique.count()
    bits = min(MOST_CELL_BITS, max(0, math.ceil(math.log2(max(1, n / SHARD)))))
    some: dict[int, list] = {}
    for r in unique.select("v", "dim").orderBy(F.xxhash64("v"), "v").limit(MEDIANS).collect():
        some.setdefault(r.dim, []).append(r.v)
    dims = [r.dim for r in unique.select("dim").distinct().collect()]  # lengths of vectors: a few
    places = Places(bits, {d: Cuts(unit(matrix(pa.array(some.get(d, [[1.0] * d])), d))) for d in dims})
    kind = rows.schema["v"].dataType.simpleString()

    def cell_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dim, cell = batch.column(1).to_numpy(), np.zeros(batch.num_rows, np.int64)
            for d in np.unique(dim).tolist():
                at = np.flatnonzero(dim == d)
                cell[at] = cells_of(places.cuts[d].margins(unit(matrix(batch.column(0).take(pa.array(at)), d)), bits))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=["v", "dim", "ids", "cell"])

    data = persist(unique.mapInArrow(cell_of, f"v {kind}, dim int, ids array<bigint>, cell bigint"), "cells") if bits else unique.withColumn("cell", F.lit(0).cast("long"))
    places.count([tuple(r) for r in data.groupBy("dim", "cell").count().collect()])  # at most 2^bits rows a length
    shared = context.broadcast(places)
    whole = data.sparkSession.createDataFrame([(d, c, p) for d, x in places.parts.items() for c, p in x.items()], "dim int, cell bigint, parts int")
    data = data.join(F.broadcast(whole), ["dim", "cell"]).select("v", "ids", "dim", "cell", F.pmod(F.xxhash64("v"), F.col("parts")).cast("int").alias("part"))  # the same rows
    asked = rows.where(f"id % {every} = 0").groupBy("id", "dim").agg(F.min("v").alias("v"))
    asked = persist(asked.groupBy("id").agg(F.min(F.struct("v", "dim")).alias("m")).select("id", "m.v", "m.dim"), "queries")
    reach, share = fitted(data, asked, shared, k) if share is None else (math.inf, share)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(2).to_numpy()
            for d in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == d)
                margins = shared.value.cuts[d].margins(unit(matrix(batch.column(1).take(pa.array(rows)), d)), bits)
                parts, at, cell, part = shared.value.parts.get(d, {}), [], [], []
                for row, m in zip(rows.tolist(), margins, strict=True):
                    for c in cells_within(m, reach):
                        for p in range(parts.get(c, 0)):
                            at.append(row)
                            cell.append(c)
                            part.append(p)
                    if len(at) > 4 * BLOCK or row == rows[-1]:
                        taken = batch.take(pa.array(at, pa.int64()))
                        yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(cell, pa.int64()), pa.array(part, pa.int32())], names=["id", "v", "dim", "cell", "part"])
                        at, cell, part = [], [], []

    routed = persist(asked.select("id", "v", "dim").mapInArrow(route, f"id bigint, v {kind}, dim int, cell bigint, part int"), "routes")
    most = routed.groupBy("dim", "cell", "part").count().agg(F.max("count")).first()[0] or 0
    blocks = max(1, -(-most // BLOCK))
    data = data.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    queries = routed.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))

    def work(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        dim = key[0].as_py()
        if left.num_rows and right.num_rows:
            x, q = matrix(left.column("v"), dim), matrix(right.column("v"), dim)
            long_x, long_q, ids = np.linalg.norm(x, axis=1), np.linalg.norm(q, axis=1), left.column("ids").to_pylist()
            for a, (own, near) in enumerate(zip(right.column("id").to_pylist(), Forest(unit(x), cuts=shared.value.cuts[dim]).candidates(unit(q), share), strict=True)):
                out += [(own, i, -s, 0) for s, i, _ in best(q[a], long_q[a], x, long_x, near, ids, own, k)]
                out.append((own, None, None, len(near)))
        columns = list(zip(*out, strict=True)) if out else [()] * 4
        return pa.table({"query_id": pa.array(columns[0], pa.int64()), "vec_id": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.float64()), "inspected": pa.array(columns[3], pa.int64())})

    by = ["dim", "cell", "part", "block"]
    found = data.groupBy(*by).cogroup(queries.groupBy(*by)).applyInArrow(work, "query_id bigint, vec_id bigint, score double, inspected bigint")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"), F.sum("inspected").alias("inspected"))
    seen = F.sum("inspected").over(Window.partitionBy("query_id"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc_nulls_last("score"), "vec_id"))
    found = found.withColumn("rank", place).withColumn("inspected", seen)
    return found.where(f"vec_id is not null and rank <= {k}").select("query_id", "rank", "vec_id", "score", "inspected")
