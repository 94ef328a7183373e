"""A trie of conversations' prefixes, built as a Patricia tree.

Each distinct sequence of a conversation's first d turns is a node.  Most nodes lie on
unary stretches, so only points where conversations branch or end are made, with the
stretch above them as one edge:

1. Turns are numbered within their conversation by a sort over ranges, so a conversation of
   any length is spread out.  A turn stands as 128 bits of hash bound to its place; a prefix
   as the exclusive or of its turns', so prefixes of all lengths have names that meet where the
   prefixes are equal.
2. Conversations are cut into sections of SECTION turns, each named by the prefix before it.
   Equal sections are counted once.  Distinct ones are sorted and packed into runs.
3. A run's points come from the common prefixes of neighbouring sections, by one pass with a
   stack that sums up what lies below.  Where a run meets its neighbours the shared prefix is
   made of single nodes, which are summed up over runs, and distinct nodes there count in the
   first run only.
4. What lies below the end of a section is added from the conversations that go on: of a
   subtree's leaves and of its repeated turns each conversation stands for those that it is
   the smallest member of.  So no step follows the depth of the tree.
5. Unary nodes are expanded from their edges' suffix sums.

No task holds a conversation, a node's members or its subtree.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.llm.common import persist, scan_bytes, tune

#: Turns of a section (fewer than 2^15).
SECTION = 128
#: Input bytes of a range of turns, characters of a text that order turns of one number.
RANGE_BYTES, PREFIX = 8 << 20, 64
#: Sections of a shard, most shards, sampled sections a shard, bytes of a run and of a chunk of ids.
SHARD_SECTIONS, MOST_SHARDS, SAMPLED, RUN_BYTES, CHUNK = 50_000, 1024, 16, 2 << 20, 1 << 16
_SALT = 7919
#: Bytes of a section's name before its turns: its number and the prefix before it.
_HEAD, _TURN = 20, 16
NO_ENDS = hashlib.sha256(b"").hexdigest()
_KEY = ["depth", "x1", "x2"]
_POINT = "depth bigint, x1 bigint, x2 bigint, p_depth bigint, p1 bigint, p2 bigint, n bigint, member bigint, leaves bigint, below bigint, suffix array<bigint>"


def hex_of(column: Column, digits: int = 16) -> Column:
    return F.lpad(F.hex(column), digits, "0")


def numbered_turns(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, pos, h1, h2, size): every turn's place in its conversation, a hash of role and
    text, and the text's code points."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = turns.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text")).where("conv is not null")
    rows = rows.select(
        "conv", "turn", "role", F.substring("text", 1, PREFIX).alias("head"), F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit(_SALT), "text", "role").alias("h2"),
        F.char_length("text").cast("long").alias("size"), F.monotonically_increasing_id().alias("read"),
    )
    order = ["conv", F.col("turn").asc_nulls_first(), "role", "head", "h1", "h2"]
    # equal rows may lie in any order, so where a row was read parts them as a last resort
    dealt = rows.repartitionByRange(max(1, -(-scan_bytes(turns) // RANGE_BYTES)), *order, "read").sortWithinPartitions(*order)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, count = None, 0
        for batch in batches:
            conv = batch.column(0).to_numpy()
            if not len(conv):
                continue
            first = np.ones(len(conv), bool)
            first[1:] = conv[1:] != conv[:-1]
            starts = np.flatnonzero(first)
            at = np.arange(len(conv)) - np.repeat(starts, np.diff(np.append(starts, len(conv))))
            if last == conv[0]:
                at[: starts[1] if len(starts) > 1 else len(at)] += count
            last, count = conv[-1], int(at[-1]) + 1
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(4), pa.array(at), *(batch.column(k) for k in (1, 2, 3))], ["conv", "part", "at", "h1", "h2", "size"])

    small = dealt.select("conv", "h1", "h2", "size", F.spark_partition_id().alias("part"))
    rows = persist(small.mapInArrow(number, "conv bigint, part int, at bigint, h1 bigint, h2 bigint, size bigint"), "trie-turns")
    parts = rows.groupBy("conv", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv").orderBy("part")) - F.col("n")
    # at most one conversation goes on from earlier ranges into a range: a row for each range at most
    later = parts.withColumn("before", before).where("before > 0").select("conv", "part", "before")
    return rows.join(F.broadcast(later), ["conv", "part"], "left").select("conv", (F.col("at") + F.coalesce("before", F.lit(0))).alias("pos"), "h1", "h2", "size")


def rebuilt_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Numbered turns whose first h = crc32(conv) % 6 turns come from conversation
    conv - conv % 100 instead, as far as it has them: (conversations with their length, turns)."""
    h = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(6))
    found = turns.groupBy("conv").agg(F.count("*").alias("n")).withColumn("h", h)
    turn = F.struct("pos", "h1", "h2", "size")
    heads = turns.where("conv % 100 = 0 and pos < 5").groupBy(F.col("conv").alias("base")).agg(F.array_sort(F.collect_list(turn)).alias("first"))
    convs = found.withColumn("base", F.col("conv") - F.col("conv") % 100).join(heads, "base", "left")
    convs = convs.withColumn("first", F.slice(F.coalesce("first", F.array().cast("array<struct<pos:bigint,h1:bigint,h2:bigint,size:bigint>>")), 1, F.col("h").cast("int")))
    convs = convs.withColumn("taken", F.size("first").cast("long")).withColumn("length", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    convs = persist(convs.select("conv", "h", "taken", "length", "first"), "trie-convs")
    own = turns.join(convs.select("conv", "h", "taken", "length"), "conv").where("pos >= h").withColumn("pos", F.col("pos") - F.col("h") + F.col("taken"))
    given = convs.select("conv", "length", F.explode("first").alias("t")).select("conv", "length", "t.*")
    columns = ["conv", "length", "pos", "h1", "h2", "size"]
    return convs.select("conv", "length"), given.select(*columns).unionByName(own.select(*columns))


def all_sections(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """(conv, k, length, key, sizes, r1, r2, x1, x2): every section of every conversation; r:
    the prefix before it, x: the prefix to its end."""
    v1, v2 = F.xxhash64("pos", "h1", "h2"), F.xxhash64(F.lit(_SALT), "pos", "h2", "h1")
    rows = turns.select("conv", "length", "pos", "size", v1.alias("v1"), v2.alias("v2"), F.floor(F.col("pos") / SECTION).cast("long").alias("k"))
    turn = F.array_sort(F.collect_list(F.struct("pos", "v1", "v2", "size")))
    cut = rows.groupBy("conv", "k", "length").agg(turn.alias("t"), F.bit_xor("v1").alias("x1"), F.bit_xor("v2").alias("x2"))
    named = F.array_join(F.transform("t", lambda t: F.concat(hex_of(t["v1"]), hex_of(t["v2"]))), "")
    cut = cut.select("conv", "k", "length", named.alias("turns"), F.transform("t", lambda t: t["size"]).alias("sizes"), "x1", "x2")
    zero = F.lit(0).cast("long")
    none = convs.where("length = 0").select("conv", zero.alias("k"), "length", F.lit("").alias("turns"), F.array().cast("array<bigint>").alias("sizes"), zero.alias("x1"), zero.alias("x2"))
    cut = persist(cut.unionByName(none), "trie-cut")
    over = Window.partitionBy("conv").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    slim = cut.where(F.col("length") > SECTION).select("conv", "k", *[F.bit_xor(x).over(over).alias(r) for x, r in (("x1", "r1"), ("x2", "r2"))])
    out = cut.join(slim.where("k > 0"), ["conv", "k"], "left").withColumns({r: F.coalesce(r, zero) for r in ("r1", "r2")})
    key = F.unhex(F.concat(hex_of(F.col("k"), 8), hex_of(F.col("r1")), hex_of(F.col("r2")), F.col("turns")))
    return persist(out.select("conv", "k", "length", key.alias("key"), "sizes", "r1", "r2", F.col("r1").bitwiseXOR(F.col("x1")).alias("x1"), F.col("r2").bitwiseXOR(F.col("x2")).alias("x2")), "trie-sections")


def common_turns(a: bytes | None, b: bytes | None) -> int:
    """Turns that two sections have in common from their start; -1 if they don't follow one prefix."""
    if a is None or b is None or a[:_HEAD] != b[:_HEAD]:
        return -1
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return (n - _HEAD) // _TURN
    x, y = np.frombuffer(a, np.uint8, n), np.frombuffer(b, np.uint8, n)
    return (int(np.argmax(x != y)) - _HEAD) // _TURN


class _Point:
    __slots__ = ("below", "depth", "leaves", "member", "n", "shared")

    def __init__(self, depth: int, shared: bool = False):
        self.depth, self.shared, self.n, self.member, self.leaves, self.below = depth, shared, 0, None, 0, 0

    def add(self, n: int, member: int, leaves: int, below: int) -> None:
        self.n, self.leaves, self.below = self.n + n, self.leaves + leaves, self.below + below
        self.member = member if self.member is None else min(self.member, member)


def points_of(rows: list[tuple], previous: bytes | None, following: bytes | None, section: int) -> Iterator[tuple]:
    """Branch, end and leaf points of one sorted run of sections (key, sizes, n, member, goes
    on, leaves below, repeats below), as far as this run knows them: rows of _POINT.

    ``previous`` and ``following``: the sections before and after the run.  Nodes shared with
    the section before are there as points of their own, whose turn the earlier run counts;
    so are those shared with the section after."""
    before, after = common_turns(previous, rows[0][0]), common_turns(rows[-1][0], following)
    stack = [_Point(d, True) for d in range(max(before, 0) + 1)]

    def closed(point: _Point, parent: int, key: bytes, sizes: list[int], names: np.ndarray) -> tuple | None:
        """Adds a finished point to the one above it, at depth ``parent`` of its section."""
        k, root = int.from_bytes(key[:4]), point.depth == 0
        if not root:
            if stack[-1].depth < parent:
                stack.append(_Point(parent))
            edge = sizes[parent : point.depth]
            stack[-1].add(point.n, point.member, point.leaves, point.below + (point.n - (not point.shared)) * sum(edge))
        elif k:
            return None  # the end of a section of the layer above
        x, at = names[point.depth], k * section
        up = (None, None, None) if root else (at + parent, int(names[parent][0]), int(names[parent][1]))
        suffix = [] if root else np.cumsum(edge[::-1])[::-1].tolist()
        return at + point.depth, int(x[0]), int(x[1]), *up, point.n, point.member, point.leaves, point.below, suffix

    held: tuple = ()
    for i, (key, sizes, n, member, more, leaves, below) in enumerate(rows):
        if i:
            shared = common_turns(rows[i - 1][0], key)
            while stack and stack[-1].depth > shared:
                point = stack.pop()
                out = closed(point, max(stack[-1].depth if stack else 0, shared), *held)
                if out:
                    yield out
            if not stack:
                stack.append(_Point(0))
        turns = np.frombuffer(key, ">i8", offset=4).astype(np.int64).reshape(-1, 2)
        held = key, sizes, np.bitwise_xor.accumulate(turns, axis=0)  # names[d]: the prefix of depth d
        length = len(sizes)
        if stack[-1].depth < length:
            stack.append(_Point(length))
        follows = common_turns(key, rows[i + 1][0]) if i + 1 < len(rows) else after
        stack[-1].add(n, member, leaves if more else int(follows < length), below if more else 0)
    while stack:
        point = stack.pop()
        floor = point.depth - 1 if point.depth <= after else after
        out = closed(point, max(stack[-1].depth if stack else 0, floor), *held)
        if out:
            yield out


def _runs(sections: DataFrame) -> DataFrame:
    """Distinct sections sorted and packed: (part, seq, first, last, image), runs of about
    RUN_BYTES; shards begin at keys of a sample bounded by SAMPLED x MOST_SHARDS keys."""
    total = sections.count()
    shards = min(MOST_SHARDS, max(1, -(-total // SHARD_SECTIONS)))
    step = max(1, total // (SAMPLED * shards))
    sample = sorted(bytes(r.key) for r in sections.where(F.pmod(F.xxhash64("key"), F.lit(step)) == 0).select("key").collect()) if shards > 1 else []
    most = RUN_BYTES
    bounds = [sample[len(sample) * k // shards] for k in range(1, shards)] if sample else []

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("part", pa.array([bisect_right(bounds, k.as_py()) for k in batch.column(0)], pa.int32()))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held, size = None, 0, [], 0

        def closed() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, whole.schema) as writer:
                writer.write_table(whole)
            first, last = whole.column(0)[0].as_py(), whole.column(0)[-1].as_py()
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "first": pa.array([first], pa.binary()), "last": pa.array([last], pa.binary()), "image": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

        for batch in batches:
            parts = batch.column(7).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if held and (parts[a] != part or size >= most):
                    yield closed()
                    seq, held, size = (seq + 1 if parts[a] == part else 0), [], 0
                part = int(parts[a])
                piece = batch.slice(a, b - a).select(range(7))
                held.append(piece)
                size += piece.nbytes
        if held:
            yield closed()

    columns = "key binary, sizes array<bigint>, n bigint, member bigint, more boolean, leaves bigint, below bigint"
    rows = sections.select("key", "sizes", "n", "member", "more", "leaves", "below").mapInArrow(dealt, f"{columns}, part int")
    rows = rows.repartitionById(shards, "part").sortWithinPartitions("part", "key")
    return persist(rows.mapInArrow(pack, "part int, seq int, first binary, last binary, image binary"), "trie-runs")


def tree_points(sections: DataFrame) -> DataFrame:
    """The points of the whole tree, each once: partial ones of all runs are added up."""
    runs = _runs(sections)
    ends = runs.select("part", "seq", "first", "last")
    inside = Window.partitionBy("part").orderBy("seq")
    near = ends.select("part", "seq", F.lag("last").over(inside).alias("a"), F.lead("first").over(inside).alias("z"))
    whole = ends.groupBy("part").agg(F.min_by("first", "seq").alias("first"), F.max_by("last", "seq").alias("last"))
    over = Window.orderBy("part")  # numbers of shards only, at most MOST_SHARDS
    order = whole.select("part", F.lag("part").over(over).alias("left"), F.lead("part").over(over).alias("right"))
    order = order.join(whole.select(F.col("part").alias("left"), F.col("last").alias("left_last")), "left", "left").join(whole.select(F.col("part").alias("right"), F.col("first").alias("right_first")), "right", "left")
    near = near.join(order.select("part", "left_last", "right_first"), "part").select("part", "seq", F.coalesce("a", "left_last").alias("previous"), F.coalesce("z", "right_first").alias("following"))

    section = SECTION

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = pa.schema([(c.split()[0], pa.list_(pa.int64()) if "array" in c else pa.int64()) for c in _POINT.split(", ")])
        for batch in batches:
            for image, previous, following in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                data = pa.ipc.open_stream(image).read_all().to_pydict()
                rows, held = list(zip(*data.values(), strict=True)), []
                for point in points_of(rows, previous, following, section):
                    held.append(point)
                    if len(held) >= 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), shape, strict=True)], schema=shape)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), shape, strict=True)], schema=shape)

    parts = runs.join(near, ["part", "seq"]).select("image", "previous", "following").mapInArrow(build, _POINT)
    same = [F.any_value(c).alias(c) for c in ("p_depth", "p1", "p2", "suffix")]
    points = parts.groupBy(*_KEY).agg(F.sum("n").alias("n"), F.min("member").alias("member"), F.sum("leaves").alias("leaves"), F.sum("below").alias("below"), *same)
    return persist(points, "trie-points")


def child_counts(points: DataFrame) -> DataFrame:
    return points.where("p_depth is not null").groupBy(F.col("p_depth").alias("depth"), F.col("p1").alias("x1"), F.col("p2").alias("x2")).agg(F.count("*").alias("children"))


def _below(sections: DataFrame, points: DataFrame) -> DataFrame:
    """What lies below the ends of sections that conversations go on from: (key of the end,
    leaves, repeats).  A conversation stands for a leaf if it is the smallest member there, and
    repeats the turns of nodes that it isn't the smallest member of: those above ``own``."""
    leaf = F.max(F.col("children").isNull().cast("long"))
    owners = points.join(child_counts(points), _KEY, "left").groupBy(F.col("member").alias("conv")).agg(F.min(F.coalesce(F.col("p_depth") + 1, F.lit(0))).alias("own"), leaf.alias("leaf"))
    long = sections.where(F.col("length") > SECTION).join(owners, "conv", "left")
    repeated = F.greatest(F.lit(0), F.least(F.size("sizes"), F.coalesce(F.col("own"), F.col("length") + 1) - 1 - F.col("k") * SECTION)).cast("int")
    size = F.aggregate(F.slice("sizes", 1, repeated), F.lit(0).cast("long"), lambda s, x: s + x)
    rest = F.coalesce(F.sum("size").over(Window.partitionBy("conv").orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tails = long.select("conv", "k", "length", "x1", "x2", F.coalesce("leaf", F.lit(0)).alias("leaf"), size.alias("size")).withColumn("rest", rest)
    goes_on = tails.withColumn("depth", (F.col("k") + 1) * SECTION).where("length > depth")
    return goes_on.groupBy(*_KEY).agg(F.sum("leaf").alias("leaves"), F.sum("rest").alias("below"))


def end_digests(ends: DataFrame) -> DataFrame:
    """(depth, x1, x2, ends_sha256) from one row per conversation: ids are packed into chunks
    in order, and a node's chunks are hashed as they stream by."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, first, held, size = None, None, [], 0
        for batch in batches:
            out = []
            for *key, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (key != node or size >= CHUNK):
                    out.append((*node, first, ",".join(held)))
                    held, size = [], 0
                if not held:
                    node, first = key, conv
                held.append(str(conv))
                size += len(held[-1]) + 1
            if out:
                yield rows_of(out)
        if held:
            yield rows_of([(*node, first, ",".join(held))])

    def rows_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64()] * 4 + [pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [*_KEY, "first", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, None

        def result(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64()] * 3 + [pa.string()], strict=True)], [*_KEY, "ends_sha256"])

        for batch in batches:
            out = []
            for *key, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key == node:
                    sha.update(b"," + ids.encode())
                    continue
                if node is not None:
                    out.append((*node, sha.hexdigest()))
                node, sha = key, hashlib.sha256(ids.encode())
            if out:
                yield result(out)
        if node is not None:
            yield result([(*node, sha.hexdigest())])

    parts = max(1, ends.sparkSession.sparkContext.defaultParallelism, -(-scan_bytes(ends) // RANGE_BYTES))
    chunks = ends.select(*_KEY, "conv").repartitionByRange(parts, *_KEY, "conv").sortWithinPartitions(*_KEY, "conv").mapInArrow(pack, "depth bigint, x1 bigint, x2 bigint, first bigint, ids string")
    return chunks.repartition(*_KEY).sortWithinPartitions(*_KEY, "first").mapInArrow(digest, "depth bigint, x1 bigint, x2 bigint, ends_sha256 string")


def build_trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """The trie of conversations (conv, length) and their numbered turns (conv, length, pos, h1,
    h2, size): one row per node, as ``conversation_trie`` gives them."""
    sections = all_sections(convs, turns)
    more = F.col("length") > (F.col("k") + 1) * SECTION
    depth = F.least(F.col("length"), (F.col("k") + 1) * SECTION)
    # an end names its whole prefix, so equal ends are equal sections
    distinct = sections.groupBy(depth.alias("depth"), "x1", "x2").agg(
        F.any_value("key").alias("key"), F.any_value("sizes").alias("sizes"), F.count("*").alias("n"), F.min("conv").alias("member"), F.bool_or(more).alias("more"),
    )
    zero = F.lit(0).cast("long")
    distinct = persist(distinct.withColumns({"leaves": zero, "below": zero}), "trie-distinct")
    points = tree_points(distinct)
    if distinct.where("more").limit(1).count():
        known = _below(sections, points)
        distinct = distinct.drop("leaves", "below").join(known, _KEY, "left").withColumns({c: F.coalesce(c, zero) for c in ("leaves", "below")})
        points = tree_points(persist(distinct, "trie-distinct"))
    ends = sections.where(~more).select(F.col("length").alias("depth"), "x1", "x2", "conv")
    parents = points.select(F.col("depth").alias("p_depth"), F.col("x1").alias("p1"), F.col("x2").alias("p2"), F.col("member").alias("above"))
    out = points.join(parents, ["p_depth", "p1", "p2"], "left").join(child_counts(points), _KEY, "left").join(end_digests(ends), _KEY, "left")
    steps = F.when(F.col("p_depth").isNull(), F.array(zero)).otherwise(F.col("suffix"))
    out = out.select("*", F.posexplode(steps).alias("step", "sum"))
    last, first = F.col("step") + 1 >= F.size("suffix"), F.col("step") == 0
    return out.select(
        F.col("member").alias("conv_id"), F.coalesce(F.col("p_depth") + 1 + F.col("step"), zero).alias("depth"), F.when(first, F.col("above")).otherwise(F.col("member")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.when(last, F.coalesce("children", zero)).otherwise(F.lit(1)).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"), (F.col("below") + (F.col("n") - 1) * F.col("sum")).alias("saved_tokens"),
        F.when(last, F.coalesce("ends_sha256", F.lit(NO_ENDS))).otherwise(F.lit(NO_ENDS)).alias("ends_sha256"),
    )


def conversation_trie(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", rebuild: bool = False) -> DataFrame:
    """One row per node of the trie of whole conversations: ``conv_id`` (its smallest member),
    ``depth``, ``parent_conv_id`` (null at the root), ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens`` (over its subtree, for each node members less one, times the code points of
    its last text) and ``ends_sha256`` (of the ids of conversations that end there).
    ``rebuild`` gives conversations their base's first turns before (``rebuilt_turns``).

    A conversation's turns are in order of their number, null first; turns of one number are in
    order of role, then of the text's first 64 characters, then of a hash of it, so equal rows
    are turns of their own.  Null roles and texts are empty.  Rows without conversation belong
    to none and are left out; an empty table has no node, not even a root.  Other columns are
    ignored, whatever their names."""
    tune(turns.sparkSession)
    rows = numbered_turns(turns, conv_col, turn_col, role_col, text_col)
    if rebuild:
        return build_trie(*rebuilt_turns(rows))
    convs = rows.groupBy("conv").agg(F.count("*").alias("length"))
    return build_trie(convs, rows.join(convs, "conv"))
