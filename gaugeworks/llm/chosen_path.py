"""N-gram Jaccard join by chosen paths.

Every document is the set of its word n-grams.  Equal sets are collapsed first; what
follows works on one representative of each.  A set gets ``POSITIONS`` minimum hashes
under independent hash functions; two sets agree at a position with the probability
of their Jaccard similarity.  A run samples about 1/threshold positions at the root
and sends each set to the buckets of its values there (the shared tokens); a bucket
that isn't small is split again by positions sampled from its own path, and small
buckets are compared by brute force.  Runs repeat until a pair at the threshold is
missed with a probability below ``MISS``.

Comparisons in a bucket use sketches of one byte a position and yield a spanning
forest of possible links, never all pairs.  Within each connected group of possible
links every pair is then counted exactly from the full n-gram sets, in blocks of
bounded size; so the number of links and the classes are exact for all pairs of a
group, found by one bucket or not.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.common import LOWER, hash_runs, mix, persist, runs, slices, tune
from gaugeworks.llm.components import connected_components, filter_bits, filter_slot, id_filter, maybe_in
from gaugeworks.llm.fm_index import WORD

WORDS, THRESHOLD, POSITIONS, MISS = 5, 0.8, 64, 1e-7
#: A bucket up to this size is compared by brute force; one up to BUCKET is split
#: further within its task; a larger one is split by another shuffle.  Below the root a
#: path is split so many times at most, as ``root_choices`` reckons; then all is compared.
SMALL, BUCKET, SPLITS = 256, 20_000, 2
#: n-grams of one block of the exact count.
BLOCK_GRAMS = 1_500_000
_HASHES = np.random.default_rng(20240607).integers(1, 1 << 63, (2, 256), dtype=np.uint64) | np.uint64(1)


def root_choices(threshold: float) -> list[tuple[int, int]]:
    """(run, position) pairs sampled at the root: each run takes each position with
    probability 1/(threshold * POSITIONS); as many runs as MISS asks for, if a pair
    must also survive SPLITS more splits below each bucket it shares."""
    chance, survive = 1 / (threshold * POSITIONS), 1.0
    for _ in range(SPLITS):
        survive = 1 - math.exp(-survive)
    rng, out, run, missed = np.random.default_rng(7), [], 0, 1.0
    while missed > MISS:
        for position in np.flatnonzero(rng.random(POSITIONS) < chance).tolist():
            out.append((run, position))
            missed *= 1 - threshold * survive
        run += 1
    return out


def gram_sets(column: pa.Array, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For runs of documents: (first row, end row, n-gram hashes, start of each
    document's sorted distinct n-grams).  A text of fewer words is one n-gram."""
    for lo, hi, data, offsets in slices(column):
        data = LOWER[data]
        member = WORD[data]
        starts, ends, doc = runs(member, offsets)
        words = hash_runs(data, member, starts, ends)
        count = np.bincount(doc, minlength=hi - lo)
        first = np.cumsum(count) - count
        grams = np.zeros(len(words), np.uint64)
        padded = np.concatenate([words, np.zeros(size, np.uint64)])
        left = np.repeat(first + count, count) - np.arange(len(words))  # words from here to the document's end
        for k in range(size):
            grams = grams * np.uint64(0x9E3779B97F4A7C15) + np.where(left > k, padded[k : k + len(words)], np.uint64(0))
        keep = (left >= size) | (np.arange(len(words)) == np.repeat(first, count))
        grams, doc = mix(grams[keep]), doc[keep]
        order = np.lexsort((grams, doc))
        grams, doc = grams[order], doc[order]
        fresh = np.ones(len(grams), bool)
        fresh[1:] = (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])
        grams, doc = grams[fresh], doc[fresh]
        yield lo, hi, grams, np.searchsorted(doc, np.arange(hi - lo + 1))


def minima(grams: np.ndarray, at: np.ndarray) -> np.ndarray:
    """POSITIONS minimum hashes of each set that isn't empty."""
    full = at[:-1][at[1:] > at[:-1]]
    out = np.zeros((len(full), POSITIONS), np.uint64)
    if len(full):
        for p in range(POSITIONS):
            out[:, p] = np.minimum.reduceat(grams * _HASHES[0, p] + _HASHES[1, p], full)
    return mix(out)


def features(docs: DataFrame, size: int, threshold: float) -> DataFrame:
    """id, hash of the text, two 64-bit signatures of the set, its n-grams, root keys and sketch."""
    choices = root_choices(threshold)

    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = np.array([p for _, p in choices])
        salt = mix(np.array([run * 1000 + p + 1 for run, p in choices], np.uint64))
        for batch in batches:
            for lo, hi, grams, at in gram_sets(batch.column(1), size):
                n = np.diff(at)
                full = n > 0
                low = minima(grams, at)
                keys = np.zeros((hi - lo, len(choices)), np.uint64)
                keys[full] = mix(low[:, where] + salt)
                sketch = np.zeros((hi - lo, POSITIONS), np.uint8)
                sketch[full] = (low >> np.uint64(7)).astype(np.uint8)
                signs = np.zeros((2, hi - lo), np.uint64)
                if full.any():
                    for k, x in enumerate((grams, mix(grams + np.uint64(1)))):
                        signs[k, full] = np.add.reduceat(x, at[:-1][full])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(signs[0].view(np.int64)), pa.array(signs[1].view(np.int64)), pa.array(n.astype(np.int64)),
                     pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * len(choices)), pa.array(keys.ravel().view(np.int64))),
                     pa.array([x.tobytes() for x in sketch], pa.binary())],
                    names=["doc_id", "text_hash", "sign_a", "sign_b", "n", "keys", "sketch"],
                )

    return docs.mapInArrow(work, "doc_id bigint, text_hash bigint, sign_a bigint, sign_b bigint, n bigint, keys array<bigint>, sketch binary")


def alike(sketches: np.ndarray, least: int) -> np.ndarray:
    """Labels of the groups that comparing all sketches connects: a search from each
    unlabelled row that compares only with rows still unlabelled."""
    label, left = np.full(len(sketches), -1), np.arange(len(sketches))
    while len(left):
        queue, left = [left[0]], left[1:]
        name = label[queue[0]] = queue[0]
        while queue and len(left):
            near = (sketches[left] == sketches[queue.pop()]).sum(axis=1) >= least
            found, left = left[near], left[~near]
            label[found] = name
            queue += found.tolist()
    return label


def joined(parent: np.ndarray, rows: np.ndarray, label: np.ndarray) -> None:
    """Union-find: put rows of one label together."""

    linked = label != np.arange(len(rows))
    for x, y in zip(rows[linked].tolist(), rows[label[linked]].tolist(), strict=True):
        a, b = find_root(parent, x), find_root(parent, y)
        parent[max(a, b)] = min(a, b)


def split(path: np.uint64, rows: np.ndarray, sketches: np.ndarray, threshold: float) -> Iterator[tuple[np.uint64, np.ndarray]]:
    """The buckets below a path: rows that share the value of a sampled position."""
    draw = mix(path + np.arange(1, POSITIONS + 1, dtype=np.uint64))
    for p in np.flatnonzero((draw >> np.uint64(11)).astype(float) / (1 << 53) < 1 / (threshold * POSITIONS)).tolist():
        values = sketches[rows, p]
        order = np.argsort(values, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(values[order])) + 1):
            if len(part) > 1:
                yield mix(np.array([path ^ draw[p]]) + np.uint64(int(values[part[0]]) + 1))[0], rows[part]


def bucket_groups(key: int, sketches: np.ndarray, threshold: float, splits: int) -> np.ndarray:
    """Chosen-path recursion within one bucket, ``splits`` deep; the group of each row."""
    parent, least = np.arange(len(sketches)), int(POSITIONS * threshold * 0.65)
    todo = [(np.uint64(key & (2**64 - 1)), np.arange(len(sketches)), 0)]
    while todo:
        path, rows, depth = todo.pop()
        if alike_first(sketches[rows], least).all():
            joined(parent, rows, np.zeros(len(rows), int))
        elif len(rows) <= SMALL or depth == splits:
            joined(parent, rows, alike(sketches[rows], least))
        else:
            todo += [(p, r, depth + 1) for p, r in split(path, rows, sketches, threshold)]
    return np.array([find_root(parent, x) for x in range(len(parent))])


def alike_first(sketches: np.ndarray, least: int) -> np.ndarray:
    """Which rows are like the first: a bucket of copies needs no more splits."""
    return (sketches == sketches[0]).sum(axis=1) >= least


def possible_links(classes: DataFrame, threshold: float) -> DataFrame:
    """Edges (a, b) that connect every group of possibly similar representatives."""
    keys = classes.select("cls", F.explode("keys").alias("key"))
    edges, depth = None, 0
    while True:
        sizes = keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
        crowded = keys.join(sizes, "key")
        crowded = persist(crowded.join(classes.select("cls", "sketch"), "cls"), "buckets")
        most = crowded.agg(F.max("size")).first()[0] or 0
        here = crowded if most <= BUCKET else crowded.where(f"size <= {BUCKET}")
        if most > BUCKET and depth == SPLITS:  # compare block by block
            blocks = F.ceil(2 * F.col("size") / BUCKET).cast("int")
            block = F.pmod(F.xxhash64("cls"), blocks)
            pair = F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other")
            rest = crowded.where(f"size > {BUCKET}").select("key", "cls", "sketch", "size", block.alias("block"), pair)
            rest = rest.select(F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("key"), "cls", "sketch", "size")
            here = here.select("key", "cls", "sketch", "size").unionAll(rest)

        left = SPLITS - depth

        def work(key: tuple, rows: pa.Table) -> pa.Table:
            reps = rows.column("cls").to_numpy()
            sketches = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint8).reshape(-1, POSITIONS)
            root = bucket_groups(key[0].as_py(), sketches, threshold, left)
            linked = root != np.arange(len(root))
            return pa.table({"a": reps[linked], "b": reps[root[linked]]})

        found = here.select("key", "cls", "sketch").groupBy("key").applyInArrow(work, "a bigint, b bigint").distinct()
        edges = found if edges is None else edges.unionAll(found)
        if most <= BUCKET or depth == SPLITS:
            return edges
        depth += 1
        place = "transform(sequence(1, {n}), p -> struct(p, pmod(xxhash64(key, p), 1000000) < {c} as taken))".format(n=POSITIONS, c=int(1_000_000 / (threshold * POSITIONS)))
        chosen = crowded.where(f"size > {BUCKET}").select("cls", "sketch", F.col("key").alias("path"), F.explode(F.expr(f"filter({place}, x -> x.taken)")).alias("x"))
        keys = persist(chosen.select("cls", F.xxhash64("path", "x.p", F.expr("substring(sketch, x.p, 1)")).alias("key")), "paths")


def exact_links(docs: DataFrame, groups: DataFrame, size: int, threshold: float) -> DataFrame:
    """(cls, links, root): for each class of ``groups`` (cls, root, rep, copies, n) the
    documents that its partners stand for, and edges that connect similar classes; one
    row for each block that it takes part in.  Only the representatives' texts are cut
    into n-grams again: a filter sized by their number leaves most others out before that,
    or, where they are too many for one, a join by id does."""
    bits = filter_bits(groups.count())
    shared = docs.sparkSession.sparkContext.broadcast(id_filter(groups, "rep", bits)) if bits else None

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if shared:
                batch = batch.filter(pa.array(maybe_in(shared.value, batch.column(2).to_numpy())))
            for lo, hi, grams, at in gram_sets(batch.column(1), size):
                raw, spans = grams.tobytes(), list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
                sign = pa.array([int(grams[a:b].sum().astype(np.int64)) for a, b in spans], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), sign, pa.array([raw[8 * a : 8 * b] for a, b in spans], pa.binary())], names=["rep", "cls", "grams"])

    total = groups.groupBy("root").agg(F.sum("n").alias("total"))
    blocks = F.ceil(F.col("total") / BLOCK_GRAMS).cast("int")
    plan = groups.join(total, "root").select("rep", "cls", "root", "copies", F.pmod(F.xxhash64("cls"), blocks).alias("block"), blocks.alias("blocks"))
    wanted = docs.where("doc_id is not null").select("doc_id", "text", *([filter_slot(F.col("doc_id"), bits).alias("slot")] if bits else []))
    if not bits:
        wanted = wanted.join(groups.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    full = wanted.mapInArrow(sets, "rep bigint, cls bigint, grams binary")
    rows = full.join(plan, ["rep", "cls"])
    rows = rows.select("root", "cls", "copies", "grams", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = rows.select("root", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "cls", "copies", "grams")

    def work(key: tuple, rows: pa.Table) -> pa.Table:
        x, y = key[1].as_py(), key[2].as_py()
        cls, copies, block = (rows.column(c).to_numpy() for c in ("cls", "copies", "block"))
        _, once = np.unique(cls, return_index=True)  # a representative's row may be repeated
        cls, copies, block, grams = cls[once], copies[once], block[once], rows.column("grams").take(pa.array(once)).to_pylist()
        links, root = count_links([np.frombuffer(g, np.uint64) for g in grams], copies, block if x != y else None, threshold)
        return pa.table({"cls": cls, "links": links, "root": cls[root]})

    return rows.groupBy("root", "x", "y").applyInArrow(work, "cls bigint, links bigint, root bigint")


def count_links(sets: list[np.ndarray], weight: np.ndarray, side: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Exact links of each set (the sum of its partners' weights) and a root of its
    connected part.  With ``side`` only pairs of different sides count.

    Near copies share most n-grams, so a set is described by how it differs from those that
    more than half of the sets hold: what it lacks of them and what it adds.  Two sets that
    share no difference have as many n-grams in common as the numbers alone tell, so such
    pairs are counted by classes of equal numbers; only sets that share a difference are
    looked at one by one."""
    m, size = len(sets), np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(m), size)
    known, gram = np.unique(np.concatenate(sets), return_inverse=True)
    common = 2 * np.bincount(gram, minlength=len(known)) > m
    base, shown = int(common.sum()), common[gram]
    held = np.bincount(owner[shown], minlength=m)
    lacks, adds = base - held, size - held
    of, what = [owner[~shown]], [gram[~shown]]
    place, step = np.cumsum(common) - 1, max(1, (4 << 20) // max(1, base))
    first = np.searchsorted(owner, np.arange(m + 1))
    for lo in range(0, m, step) if base else ():
        hi = min(lo + step, m)
        own = slice(first[lo], first[hi])
        has = np.zeros((hi - lo, base), bool)
        has[owner[own][shown[own]] - lo, place[gram[own][shown[own]]]] = True
        row, column = np.nonzero(~has)
        of.append(row + lo)
        what.append(column + len(known))
    of, what = np.concatenate(of), np.concatenate(what)
    holders = np.bincount(what, minlength=len(known) + base)
    of, what = of[holders[what] > 1], what[holders[what] > 1]
    by_set, by_what = np.argsort(of, kind="stable"), np.argsort(what, kind="stable")
    mine, of_what = what[by_set], of[by_what]
    at, start = np.searchsorted(of[by_set], np.arange(m + 1)), np.searchsorted(what[by_what], np.arange(len(known) + base + 1))
    side = np.zeros(m, np.int64) if side is None else (side == side.max()).astype(np.int64) + 1  # 0: pairs of all
    kinds, kind = np.unique(np.stack([lacks, adds, side], axis=1), axis=0, return_inverse=True)
    kind = kind.ravel()
    total, number = np.bincount(kind, weight), np.bincount(kind)
    leader = np.full(len(kinds), m)
    np.minimum.at(leader, kind, np.arange(m))
    links, parent, whole = np.zeros(m, np.int64), np.arange(m), np.zeros(len(kinds), bool)
    members = np.split(np.argsort(kind, kind="stable"), np.cumsum(number)[:-1])

    def near(shared: np.ndarray, a: int, b: np.ndarray) -> np.ndarray:
        return shared >= threshold * (a + b - shared) - 1e-9

    for k, (lack, add, own) in enumerate(kinds.tolist()):
        alike = near(base - lack - kinds[:, 0], base - lack + add, base - kinds[:, 0] + kinds[:, 1]) & ((kinds[:, 2] != own) | (own == 0))
        among = bool(alike[k])
        partners = np.flatnonzero(alike)
        partners = partners[partners != k]
        count = int(total[alike].sum())
        if len(partners) or among and number[k] > 1:
            whole[k] = True
            whole[partners] = True
            unite(parent, int(leader[k]), leader[partners])
        for i in members[k].tolist():
            links[i] = count - (int(weight[i]) if among else 0)
            own_what = mine[at[i] : at[i + 1]]
            n = start[own_what + 1] - start[own_what]
            if not len(n):
                continue
            found = of_what[np.repeat(start[own_what] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
            if 8 * len(found) > m:
                both = np.bincount(found, minlength=m)
                found = np.flatnonzero(both)
                both = both[found]
            else:
                found, both = np.unique(found, return_counts=True)
            fit = near(base - lack - lacks[found] + both, size[i], size[found]) & ~alike[kind[found]] & (found != i)
            if own:
                fit &= side[found] != own
            found = found[fit]
            links[i] += weight[found].sum()
            unite(parent, i, found)
    for k in np.flatnonzero(whole).tolist():
        unite(parent, int(leader[k]), members[k])
    return links, np.array([find_root(parent, i) for i in range(m)])


def unite(parent: np.ndarray, i: int, others: np.ndarray) -> None:
    """Union-find: put i and all the others together.  Roots are the smallest rows."""
    while len(others):
        roots = parent[others]
        if (roots == parent[roots]).all():
            break
        parent[others] = parent[roots]
    roots = np.unique(np.append(parent[others], find_root(parent, i)))
    parent[roots] = roots[0]


def find_root(parent: np.ndarray, x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def similar_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document row: ``doc_id``, ``class_id`` (the smallest id among the
    documents that links connect), ``copy_id`` (the smallest id with the same n-gram
    set), ``n_links`` (other documents with a Jaccard similarity of ``threshold`` or
    more, copies included), and ``text_hash`` (to tell rows of one id apart).

    Null and empty texts and texts without words link to nothing and are their own
    class; so are rows with a null id.  An id that repeats over different texts gets a
    row for each.  Texts of fewer than ``words`` words are one
    n-gram.  Repeated rows count as copies of each other.  An empty table gives none.
    """
    tune(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    known = persist(features(docs, words, threshold), "features")
    full = known.where("n > 0 and doc_id is not null")
    classes = full.groupBy("sign_a", "sign_b").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.max("n").alias("n"), F.max(F.struct("sketch", "keys")).alias("f"))
    classes = persist(classes.select(F.col("sign_a").alias("cls"), "rep", "copies", "n", "f.keys", "f.sketch"), "classes")
    possible = connected_components(possible_links(classes, threshold)).withColumnRenamed("node", "cls")
    groups = persist(possible.join(classes.select("cls", "rep", "copies", "n"), "cls"), "groups")
    exact = persist(exact_links(docs, groups, words, threshold), "links")
    links = exact.groupBy("cls").agg(F.sum("links").alias("links"))
    roots = connected_components(exact.select(F.col("cls").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "cls")
    roots = roots.join(groups.select("cls", "rep"), "cls")
    roots = roots.join(roots.groupBy("root").agg(F.min("rep").alias("class_id")), "root").select("cls", "class_id")
    of = classes.select("cls", "rep", "copies").join(links, "cls", "left").join(roots, "cls", "left")
    of = of.select(F.col("cls").alias("sign_a"), "rep", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("class_id", "rep").alias("root"))
    out = known.select("doc_id", "text_hash", F.when(F.expr("n > 0 and doc_id is not null"), F.col("sign_a")).alias("sign_a")).join(of, "sign_a", "left")
    return out.select("doc_id", "text_hash", F.coalesce("root", "doc_id").alias("class_id"), F.coalesce("rep", "doc_id").alias("copy_id"), F.coalesce("links", F.lit(0)).alias("n_links"))


def keep_one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each class of similar documents: the one with the
    smallest id, of several texts of that id the one with the smallest hash.  All columns
    stay, whatever their names; rows with a null id all stay; equal rows count as copies.
    Of an empty table nothing is left."""
    classes = persist(similar_documents(docs, id_col=id_col, text_col=text_col, **options), "similar").where("doc_id is not null")
    kept = classes.groupBy("class_id").agg(F.min(F.struct("doc_id", "text_hash")).alias("k")).select("k.*")
    taken, number, hashed = {c.lower() for c in docs.columns}, "_id", "_hash"
    while number in taken or hashed in taken:
        number, hashed = number + "_", hashed + "_"
    rows = docs.withColumn(number, F.col(id_col).cast("long")).withColumn(hashed, F.xxhash64(text_col))
    same = (rows[number] == kept["doc_id"]) & (rows[hashed] == kept["text_hash"])
    one = rows.join(kept, same, "left_semi").dropDuplicates([number, hashed])
    return one.unionByName(rows.where(F.col(number).isNull())).drop(number, hashed)
