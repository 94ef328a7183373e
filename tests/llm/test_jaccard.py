import math
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.llm import chosen_path, components
from gaugeworks.llm.components import connected_components
from gaugeworks.llm.queries import op2_jaccard_join

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(docs):
    """{row: (class_id, copy_id, n_links)} by comparing all pairs that share an n-gram."""
    sets = []
    for d, text in docs:
        w = WORD.findall((text or "").translate(LOWER))
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w and d is not None else None)
    holders = defaultdict(list)
    for k, s in enumerate(sets):
        for g in s or ():
            holders[g].append(k)
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links, copy = Counter(), {}
    for k, s in enumerate(sets):
        if s is None:
            continue
        shared = Counter(j for g in s for j in holders[g] if j != k)
        for j, n in shared.items():
            if n / (len(s) + len(sets[j]) - n) >= 0.8:
                links[k] += 1
                a, b = root(k), root(j)
                parent[max(a, b)] = min(a, b)
        copy[k] = min(docs[j][0] for j in holders[next(iter(s))] if sets[j] == s)
    members = defaultdict(list)
    for k, s in enumerate(sets):
        if s is not None:
            members[root(k)].append(docs[k][0])
    return sorted(((d, min(members[root(k)]), copy[k], links[k]) if sets[k] is not None else (d, d, d, 0) for k, (d, _) in enumerate(docs)), key=str)


def rows(df):
    return sorted(((r.doc_id, r.class_id, r.copy_id, r.n_links) for r in df.collect()), key=str)


def planted():
    rng = random.Random(11)
    word = lambda: rng.choice("abcdefgh") + rng.choice("aeiou") + str(rng.randrange(300))
    base = [[word() for _ in range(rng.choice([6, 40, 200]))] for _ in range(30)]
    docs = []
    for k, w in enumerate(base):
        docs.append((k, " ".join(w)))
        for m in range(rng.randrange(4)):
            x = list(w)
            for _ in range(rng.randrange(1 + len(x) // 20)):
                x[rng.randrange(len(x))] = word()
            docs.append((1000 + 10 * k + m, ". ".join(x).title()))
    docs += [(500 + k, f"v{k} " + " ".join(base[0][:150] * 2)) for k in range(40)]
    return docs + [(700, None), (701, ""), (702, "?!"), (703, "one two"), (704, "One  two"), (None, "one two"), (705, "x"), (703, "one two"), (706, "far " * 30000)]


@pytest.mark.parametrize("limits", [{}, {"SMALL": 8}, {"SMALL": 4, "BUCKET": 10, "BLOCK_GRAMS": 400}])
def test_equals_brute_force(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(chosen_path, name, value)
    docs = planted()
    df = spark.createDataFrame([(d, t, d) for d, t in docs], "doc_id long, text string, class_id long")
    assert rows(chosen_path.similar_documents(df)) == brute(docs)


def test_empty_table(spark):
    assert rows(chosen_path.similar_documents(spark.createDataFrame([], "doc_id long, text string"))) == []


def test_query_equals_brute_force(spark):
    d = "/root/testdata/sf0.001"
    assert rows(op2_jaccard_join(spark, d)) == brute([tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()])


def test_components_of_long_paths_and_stars(spark):
    rng = random.Random(2)
    ids = rng.sample(range(10**6), 300)
    edges = [(a, b) for a, b in zip(ids[:200], ids[1:200], strict=False)] + [(ids[200], x) for x in ids[201:]] + [(5, 5)]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {x: min(ids[:200]) for x in ids[:200]} | {x: min(ids[200:]) for x in ids[200:]}


def test_runs_reach_the_target():
    choices = chosen_path.root_choices(0.8)
    assert len({r for r, _ in choices}) >= 20 and math.prod(1 - 0.8 * 0.46 for _ in choices) < 1e-6
    assert chosen_path.alike(np.zeros((3, 64), np.uint8), 30).tolist() == [0, 0, 0]


def brute_links(sets, weight, side, threshold):
    links, parts = [0] * len(sets), [{k} for k in range(len(sets))]
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = len(set(a) & set(b))
            if both >= threshold * (len(a) + len(b) - both) - 1e-9 and (side is None or side[i] != side[j]):
                links[i], links[j] = links[i] + weight[j], links[j] + weight[i]
                one = next(p for p in parts if i in p)
                other = next(p for p in parts if j in p)
                if one is not other:
                    one |= other
                    parts.remove(other)
    return links, sorted(sorted(p) for p in parts)


@pytest.mark.parametrize("seed", range(12))
def test_links_of_a_group_equal_brute_force(seed):
    rng = np.random.default_rng(seed)
    bases = [rng.integers(0, 1 << 40, rng.integers(4, 40)) for _ in range(rng.integers(1, 4))]
    sets = []
    for _ in range(90):
        s = set(bases[rng.integers(len(bases))].tolist())
        s = {x for x in s if rng.random() > 0.06} | set(rng.integers(0, 30 if seed % 2 else 1 << 40, rng.integers(0, 4)).tolist())
        sets.append(np.array(sorted(s or {1}), np.uint64))
    weight = rng.integers(1, 5, len(sets))
    for side in (None, rng.integers(0, 2, len(sets)) * 7 + 3):
        links, root = chosen_path.count_links(sets, weight, side, 0.8)
        want, parts = brute_links([s.tolist() for s in sets], weight.tolist(), None if side is None else side.tolist(), 0.8)
        assert links.tolist() == want
        assert sorted([k for k in range(len(sets)) if root[k] == r] for r in set(root.tolist())) == parts


def test_many_short_near_copies_take_little_time():
    n, base = 40_000, np.arange(1, 21, dtype=np.uint64)
    sets = [np.append(np.delete(base, k % 20), np.uint64(1000 + k)) for k in range(n)]
    began = time.perf_counter()
    links, root = chosen_path.count_links(sets, np.ones(n, np.int64), None, 0.8)
    assert time.perf_counter() - began < 60
    # one word changed in each: 18 of 22 n-grams are shared, or 19 of 21 where the same one is
    assert set(links.tolist()) == {n - 1} and set(root.tolist()) == {0}


@pytest.mark.parametrize("most", [1 << 27, 4])
def test_groups_too_many_for_a_filter_are_joined(spark, monkeypatch, most):
    monkeypatch.setattr(components, "MOST_BITS", most)
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(k, text + f" x{k}", "kept") for k in range(6)] + [(k, f"{k} other words that nothing else has {k}", "kept") for k in range(10, 14)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _hash string")
    got = {r.doc_id: (r.class_id, r.n_links) for r in chosen_path.similar_documents(docs).collect()}
    assert got == {k: (0, 5) if k < 6 else (k, 0) for k, *_ in rows}
    out = chosen_path.keep_one_of_each(docs.withColumn("_id", F.lit(1)))
    assert out.columns == ["doc_id", "text", "_hash", "_id"] and sorted(r.doc_id for r in out.collect()) == [0, 10, 11, 12, 13]
    assert {r._hash for r in out.collect()} == {"kept"}
