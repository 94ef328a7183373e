"""Comparing models and runs: common cells, divergence, overlaps, assignments."""

from __future__ import annotations

import heapq
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks import schema as S

#: Assets that are broadcast at most; values in a range of those searched in order.
MOST_ASSETS, RANGE_ROWS = 10_000, 10_000
#: Groups whose items are compared together at most: bits of a mask.
MOST_ARMS = 62


def arm_intersection(rows: DataFrame, models: list[str] | None = None, min_common_clips: int = 3) -> DataFrame:
    """The usable rows of the cells that every model ran, one row a cell and model.

    Unknown or empty models, repeated cells and too few common clips raise.  One pass
    over the models, one aggregate by cell to check, one window on the cell: rows are moved
    once for each of the last two."""
    ok = S.usable(rows)
    ok = ok.where(F.col("model").isin(models)) if models else ok
    present = {r.model: r.n for r in ok.groupBy("model").agg(F.count("*").alias("n")).collect()}
    if models and (absent := sorted(set(models) - set(present))):
        raise S.RaggedArmsError(f"models without rows: {', '.join(absent)}")
    if len(present) < 2:
        raise S.RaggedArmsError("fewer than two models")
    cell = ["clip_id", "condition_name"]
    # a bit a model, where there are few: a number of fixed width, whose aggregate combines
    names = sorted(n for n in present if n is not None)
    few = len(names) <= MOST_ARMS
    bit = reduce(lambda out, k: F.when(F.col("model") == F.lit(names[k]), F.lit(1 << k)).otherwise(out), range(len(names) if few else 0), F.lit(None)).cast("long")
    different = F.bit_count(F.coalesce(F.bit_or(bit), F.lit(0))) if few else F.count_distinct("model")
    cells = ok.groupBy(*cell).agg(different.alias("m"), F.count("*").alias("n"))
    full = F.col("m") == len(present)
    repeated, clips = cells.agg(F.count_if(F.col("n") > F.col("m")), F.count_distinct(F.when(full, F.col("clip_id")))).first()
    if repeated:
        raise S.DuplicateCellError(f"{repeated} cells have several rows of one model")
    if clips < min_common_clips:
        raise S.ThinOverlapError(f"{clips} clips are common to all models")
    # no model is twice in a cell, as was checked; a cell with a null key is in no other's
    whole = F.count("*").over(Window.partitionBy(*cell)) == len(present)
    return ok.withColumn("_whole", whole).where("_whole and clip_id is not null and condition_name is not null").drop("_whole")


def intersection_census(rows: DataFrame) -> DataFrame:
    """How many cells are run by how many models."""
    cells = S.usable(rows).groupBy("clip_id", "condition_name").agg(F.count_distinct("model").alias("n_models"))
    return cells.groupBy("n_models").agg(F.count("*").alias("n_cells"), F.count_distinct("clip_id").alias("n_clips"))


def common_clips(left: DataFrame, right: DataFrame, least: int = 3) -> tuple[DataFrame, DataFrame]:
    """Two runs restricted to the clips of both, before anything is averaged."""
    both = S.usable(left).select("clip_id").intersect(S.usable(right).select("clip_id"))
    if (n := both.count()) < least:
        raise S.ClipSetMismatchError(f"{n} clips are common")
    return S.usable(left).join(both, "clip_id", "left_semi"), S.usable(right).join(both, "clip_id", "left_semi")


def divergence(regions: DataFrame) -> DataFrame:
    """Regions (factor, region, model, wer, n) with the best and worst model and their
    gap; a region that models cover unequally raises."""
    out = regions.groupBy("factor", "region").agg(
        F.count("*").alias("n_models"), F.count_distinct("n").alias("_n"), F.max_by("model", F.struct("wer", "model")).alias("worst"), F.min_by("model", F.struct("wer", "model")).alias("best"), (F.max("wer") - F.min("wer")).alias("wer_gap"),
    )
    if out.where("_n > 1").limit(1).collect():
        raise S.RaggedArmsError("models cover a region with different conditions")
    return out.drop("_n")


def _masks(flags: DataFrame, group: str, item: str) -> tuple[list, DataFrame]:
    """(groups in order, (mask, n)): how many items exactly those groups have whose bits are
    set.  One aggregate by item and one by mask: items are never gathered nor joined."""
    items = flags.where(F.col(group).isNotNull())
    names = sorted(r[0] for r in items.select(group).distinct().limit(MOST_ARMS + 1).collect())
    if len(names) > MOST_ARMS:
        raise S.MeasurementError(f"more than {MOST_ARMS} groups can't be compared at once")
    bit = F.lit(0)
    for k, name in enumerate(names):
        bit = F.when(F.col(group) == F.lit(name), F.lit(1 << k)).otherwise(bit)
    by = items.groupBy(F.col(item).alias("i")).agg(F.bit_or(bit.cast("long")).alias("mask"))
    return names, by.groupBy("mask").agg(F.count("*").alias("n"))


def set_overlap(flags: DataFrame, group: str, item: str) -> DataFrame:
    """Pairs of groups with the sizes of intersection and union of their items, and the
    Jaccard index (NULL for an empty union).  A null item is an item; null groups are left out."""
    names, masks = _masks(flags, group, item)
    kind = flags.schema[group].dataType.simpleString()
    has = lambda k: F.col("mask").bitwiseAND(F.lit(1 << k)) != 0
    n = lambda f: F.coalesce(F.sum(F.when(f, F.col("n"))), F.lit(0))
    pairs = [(j, k) for j in range(len(names)) for k in range(j + 1, len(names))]
    if not pairs:
        return flags.sparkSession.createDataFrame([], f"a {kind}, b {kind}, n_a bigint, n_b bigint, n_both bigint, n_either bigint, jaccard double")
    one = masks.agg(*[n(has(k)).alias(f"n{k}") for k in range(len(names))], *[n(has(j) & has(k)).alias(f"n{j}_{k}") for j, k in pairs])
    rows = F.explode(F.array(*[F.struct(F.lit(names[j]).alias("a"), F.lit(names[k]).alias("b"), F.col(f"n{j}").alias("n_a"), F.col(f"n{k}").alias("n_b"), F.col(f"n{j}_{k}").alias("n_both")) for j, k in pairs]))
    out = one.select(rows.alias("p")).select("p.*").withColumn("n_either", F.col("n_a") + F.col("n_b") - F.col("n_both"))
    return out.withColumn("jaccard", F.try_divide(F.col("n_both").cast("double"), F.col("n_either")))


def arm_overlap(flags: DataFrame, group: str, item: str) -> DataFrame:
    """The groups' items all together, one row a group: (group, n, n_only: items of no other
    group, n_shared: of this and some other, n_all: of every group, n_any, jaccard: n_all / n_any)."""
    names, masks = _masks(flags, group, item)
    kind = flags.schema[group].dataType.simpleString()
    if not names:
        return flags.sparkSession.createDataFrame([], f"`{group}` {kind}, n bigint, n_only bigint, n_shared bigint, n_all bigint, n_any bigint, jaccard double")
    n = lambda f: F.coalesce(F.sum(F.when(f, F.col("n"))), F.lit(0))
    mask = F.col("mask")
    own = [F.struct(F.lit(name).alias(group), n(mask.bitwiseAND(F.lit(1 << k)) != 0).alias("n"), n(mask == (1 << k)).alias("n_only")) for k, name in enumerate(names)]
    one = masks.agg(F.array(*own).alias("own"), n(mask == (1 << len(names)) - 1).alias("n_all"), n(F.lit(True)).alias("n_any"))
    out = one.select(F.explode("own").alias("o"), "n_all", "n_any").select("o.*", "n_all", "n_any")
    return out.select(group, "n", "n_only", (F.col("n") - F.col("n_only")).alias("n_shared"), "n_all", "n_any", F.try_divide(F.col("n_all").cast("double"), F.col("n_any")).alias("jaccard"))


def only_in(flags: DataFrame, group: str, item: str) -> DataFrame:
    """(group, item): the items that one group only has."""
    by = flags.where(F.col(group).isNotNull()).groupBy(item).agg(F.min(group).alias(group), F.max(group).alias("_last"))
    return by.where(F.col(group) == F.col("_last")).select(group, item)


def agreement(pairs: DataFrame, predicted: str, actual: str) -> DataFrame:
    """Precision, recall and Jaccard of two flags over paired conditions."""
    p, a = F.col(predicted), F.col(actual)
    out = pairs.agg(F.count("*").alias("n"), F.count_if(p & a).alias("both"), F.count_if(p).alias("n_predicted"), F.count_if(a).alias("n_actual"))
    return out.select("*", F.try_divide(F.col("both").cast("double"), F.col("n_predicted")).alias("precision"), F.try_divide(F.col("both").cast("double"), F.col("n_actual")).alias("recall"), F.try_divide(F.col("both").cast("double"), F.col("n_predicted") + F.col("n_actual") - F.col("both")).alias("jaccard"))


def least_partners(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For sorted values the place in ``b`` of the partner of each of ``a`` (no longer than
    ``b``), of least total distance; partners keep the order.

    One pass over all values in order, which keeps what a change of mind would cost.  One of
    ``a`` takes the cheapest place on offer: the last free one, or one whose taker would
    rather go back; one of ``b`` takes over the value that gains most by moving up to it.
    Offers wait in two heaps by their cost, so work is n log n and memory is linear in
    the values.  Only which places are used matters: in order, they are the partners."""
    used = np.zeros(len(b), bool)
    order = np.argsort(np.concatenate([b, a]), kind="stable")
    free: list[int] = []  # places passed and not used: the last is the nearest
    back: list[tuple[int, float, int]] = []  # (values left without a place, cost, place used then; -1: none)
    moves: list[tuple[int, float, int]] = []  # (the same, cost, place freed then)
    for k in order.tolist():
        if k < len(b):
            y = float(b[k])
            if moves and (moves[0][0], moves[0][1] + y) < (0, 0.0):
                lacking, cost, place = heapq.heappop(moves)
                used[k] = True
                if place >= 0:
                    used[place] = False
                heapq.heappush(back, (-lacking, -cost - 2 * y, place))
            else:
                free.append(k)
            continue
        x = float(a[k - len(b)])
        if free and (not back or (0, -float(b[free[-1]])) <= back[0][:2]):
            place = free.pop()
            lacking, cost = 0, -float(b[place])
        elif back:
            lacking, cost, place = heapq.heappop(back)
        else:  # it waits for a place to come
            lacking, cost, place = 1, 0.0, -1
        if place >= 0:
            used[place] = True
        heapq.heappush(moves, (-lacking, -cost - 2 * x, place))
    return np.flatnonzero(used)


def nearest_assignment(left: DataFrame, right: DataFrame, keys: list[str], value: str, label: str, tolerance: float) -> DataFrame:
    """One-to-one pairs within equal keys of least total distance, as many as the smaller
    side has rows.  Pairs wider apart than the tolerance are reported as such, what is left
    over (and what has no value or key) as unmatched.  A group is held by one worker, in
    memory linear in its rows, and takes n log n steps."""
    side = lambda x, n: x.select(*keys, F.col(label).alias(n), F.col(value).cast("double").alias(f"value_{n}"))
    a, b = side(left, "a"), side(right, "b")
    kinds = {f.name: f.dataType.simpleString() for f in [*a.schema, *b.schema]}
    columns = [*keys, "a", "value_a", "b", "value_b"]

    def pair(x: pa.Table, y: pa.Table) -> pa.Table:
        x, y = (t.sort_by([(f"value_{n}", "ascending"), (n, "ascending")]) for t, n in ((x, "a"), (y, "b")))
        swap = x.num_rows > y.num_rows
        few, many = (t.column(f"value_{n}").to_numpy() for t, n in (((y, "b"), (x, "a")) if swap else ((x, "a"), (y, "b"))))
        to = least_partners(few, many)
        rest = np.setdiff1d(np.arange(len(many)), to)
        none = pa.nulls(len(rest), pa.int64())
        small, large = pa.concat_arrays([pa.array(np.arange(len(few))), none]), pa.array(np.concatenate([to, rest]))
        of_x, of_y = (large, small) if swap else (small, large)
        source = x if x.num_rows else y
        key = [source.column(k).take(pa.array(np.zeros(len(large), np.int64))) for k in keys]
        return pa.Table.from_arrays([*key, x.column("a").take(of_x), x.column("value_a").take(of_x), y.column("b").take(of_y), y.column("value_b").take(of_y)], names=columns)

    fit = lambda n: " and ".join([f"value_{n} is not null and not isnan(value_{n})", *(f"`{k}` is not null" for k in keys)])
    out = a.where(fit("a")).groupBy(*keys).cogroup(b.where(fit("b")).groupBy(*keys)).applyInArrow(pair, ", ".join(f"`{c}` {kinds[c]}" for c in columns))
    for x, n in ((a, "a"), (b, "b")):
        out = out.unionByName(x.where(f"not ({fit(n)})"), allowMissingColumns=True)
    out = out.withColumn("delta", F.abs(F.col("value_a") - F.col("value_b")))
    status = F.when(F.col("a").isNull() | F.col("b").isNull(), "unmatched").when(F.col("delta") <= tolerance, "paired").otherwise("too_far")
    return out.withColumn("status", status)


def closest(wanted: DataFrame, assets: DataFrame, value: str, key: str) -> DataFrame:
    """For each wanted value the asset nearest to it, ties to the smaller key.  Up to
    ``MOST_ASSETS`` assets are broadcast; more are searched in order of value.  Assets
    without a value are left out."""
    a = assets.select(F.col(key).alias("asset"), F.col(value).alias("_have")).where("_have is not null")
    if a.limit(MOST_ASSETS + 1).count() > MOST_ASSETS:
        return closest_in_order(wanted, a, value)
    near = wanted.join(F.broadcast(a)).groupBy(*wanted.columns).agg(F.min(F.struct(F.abs(F.col(value) - F.col("_have")).alias("d"), "asset")).alias("m"))
    return near.select(*wanted.columns, "m.asset", F.col("m.d").alias("distance"))


def closest_in_order(wanted: DataFrame, assets: DataFrame, value: str) -> DataFrame:
    """``closest`` for any number of assets (asset, _have): distinct values of both sides are
    cut into ranges at quantiles; in a range each value meets the assets next to it, and a
    range without one on a side takes the last one of the ranges before or after.  Missing
    values are nearest to none: they get the smallest key and no distance, as in ``closest``."""
    have = assets.groupBy("_have").agg(F.min("asset").alias("asset"))
    seek = wanted.where(F.col(value).isNotNull()).select(F.col(value).alias("_v")).distinct()
    both = have.select(F.col("_have").alias("_v"), F.struct(F.col("_have").alias("h"), "asset").alias("_a")).unionByName(seek, allowMissingColumns=True)
    n = both.count() // RANGE_ROWS + 1
    bounds = sorted(set(both.select(F.col("_v").cast("double").alias("_v")).approxQuantile("_v", [k / n for k in range(1, n)], 0.25 / n))) if n > 1 else []
    at = F.lit(0)
    if bounds:
        at = F.size(F.filter(F.lit(bounds), lambda x: x <= F.col("_v").cast("double")))
    both = both.withColumn("_r", at)
    up, down = Window.partitionBy("_r").orderBy("_v"), Window.partitionBy("_r").orderBy(F.desc("_v"))
    reach = lambda w: F.last("_a", ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    near = both.withColumn("_below", reach(up)).withColumn("_above", reach(down)).where("_a is null").drop("_a")
    # one row a range, of which there are few: the outermost assets of each
    ends = both.where("_a is not null").groupBy("_r").agg(F.min("_a").alias("least"), F.max("_a").alias("most"))
    ends = ends.agg(F.array_sort(F.collect_list(F.struct("_r", "least", "most"))).alias("_ends"))
    near = near.join(F.broadcast(ends))
    before, after = F.filter("_ends", lambda e: e["_r"] < F.col("_r")), F.filter("_ends", lambda e: e["_r"] > F.col("_r"))
    sides = [F.coalesce("_below", F.try_element_at(before, F.lit(-1))["most"]), F.coalesce("_above", F.try_element_at(after, F.lit(1))["least"])]
    gap = lambda c: F.when(c.isNotNull(), F.struct(F.abs(F.col("_v") - c["h"]).alias("d"), c["asset"].alias("asset")))
    near = near.select("_v", F.least(*[gap(c) for c in sides]).alias("m"))
    rows = wanted.distinct()
    found = rows.join(near, rows[value] == near["_v"]).select(*[rows[c] for c in wanted.columns], "m.asset", F.col("m.d").alias("distance"))
    lost = rows.where(F.col(value).isNull()).join(F.broadcast(assets.agg(F.min("asset").alias("asset"))))
    return found.unionByName(lost, allowMissingColumns=True)


def paired_difference(rows: DataFrame, first: str, second: str) -> DataFrame:
    """Clips run under both conditions, and the difference of their error."""
    a = S.usable(rows).where(F.col("condition_name") == first).select("model", "clip_id", F.col("wer").alias("wer_a"))
    b = S.usable(rows).where(F.col("condition_name") == second).select("model", "clip_id", F.col("wer").alias("wer_b"))
    return a.join(b, ["model", "clip_id"]).withColumn("difference", F.col("wer_a") - F.col("wer_b"))


def resolve_assets(conditions: DataFrame, rooms: DataFrame, noises: DataFrame) -> DataFrame:
    """The room and noise that deliver each condition: the room of the nearest measured
    reverberation (rooms: rir_key, rt60), and one of the noises of the type by a hash of
    the condition's name (noises: noise_key, noise_type).  What finds none raises."""
    out = closest(conditions, rooms.withColumnRenamed("rir_key", "_k"), "rt60", "_k").withColumnRenamed("asset", "rir_key").drop("distance")
    kinds = noises.groupBy("noise_type").agg(F.array_sort(F.collect_set("noise_key")).alias("_n"))
    out = out.join(kinds, "noise_type", "left")
    if missing := out.where("rir_key is null or _n is null").select("noise_type").limit(1).collect():
        raise S.MissingAssetError(f"no asset for noise {missing[0][0]}")
    hashed = F.conv(F.substring(F.sha2(F.col("condition_name").cast("binary"), 256), 1, 15), 16, 10).cast("long")
    return out.withColumn("noise_key", F.element_at("_n", (F.pmod(hashed, F.size("_n")) + 1).cast("int"))).drop("_n")
