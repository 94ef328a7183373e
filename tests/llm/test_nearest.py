import numpy as np
import pytest

from gaugeworks.llm import prefix_forest
from gaugeworks.llm.queries import op9_nearest


def brute(rows, k=5, every=50):
    """{query: [(vec_id, score)]} over usable rows."""
    fine = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, v in fine:
        if i % every == 0:
            best = {}
            for j, w in fine:
                if j != i and len(w) == len(v):
                    s = float(v @ w / np.linalg.norm(v) / np.linalg.norm(w))
                    best[j] = max(s, best.get(j, -9))
            out[i] = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]
    return out


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    return {q: [x[k] for k in sorted(x)] for q, x in out.items() if sorted(x) == list(range(1, len(x) + 1))}


def test_recall_and_scores_on_the_table(spark):
    d = "/root/testdata/sf0.01"
    got, want = found(op9_nearest(spark, d)), brute([tuple(r) for r in spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding").collect()])
    assert got.keys() == want.keys() and all(len(x) == 5 for x in got.values())
    hits = [v in dict(want[q]) for q, x in got.items() for v, _ in x]
    assert np.mean(hits) >= 0.9
    for q, x in got.items():
        assert x == sorted(x, key=lambda y: (-y[1], y[0])) and q not in dict(x)
        assert all(abs(s - dict(want[q])[v]) < 1e-12 for v, s in x if v in dict(want[q]))


@pytest.mark.parametrize("limits", [{}, {"SHARD": 40, "BLOCK": 2}])
def test_edge_cases_with_every_candidate(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(prefix_forest, name, value)
    rng = np.random.default_rng(1)
    rows = [(k, rng.normal(size=4).tolist()) for k in range(200)]
    rows += [(1000 + k, [1.0, 2.0, 0.0, 0.0]) for k in range(20)] + [(50, rows[50][1]), (400, [1.0, 2.0, 0.0, 0.0])]
    rows += [(2000, None), (2001, [0.0] * 4), (2002, [1.0, None, 1.0, 1.0]), (2050, [float("nan"), 1.0, 1.0, 1.0]), (2003, [float("inf"), 1.0, 1.0, 1.0]), (None, [1.0] * 4), (2100, [1.0, 2.0]), (2004, [2.0, 1.0]), (2150, [])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, score int")
    got, want = found(prefix_forest.nearest(df, share=1.0)), brute(rows)
    assert got.keys() == want.keys()
    for q, x in got.items():
        assert [v for v, _ in x] == [v for v, _ in want[q]] and np.allclose([s for _, s in x], [s for _, s in want[q]], atol=1e-12)
    assert prefix_forest.nearest(df.limit(0)).collect() == []


def test_ascending_keeps_longest_prefixes_first():
    x = np.random.default_rng(2).normal(size=(500, 16))
    forest = prefix_forest.Forest(x, 3)
    for q, near in enumerate(forest.candidates(x[:20], 0.05)):
        assert q in near and len(near) >= 0.05 * 500
        strings = [prefix_forest.hash_strings(x, t) for t in range(3)]
        shared = np.max([48 - np.array([int(s[q] ^ y).bit_length() for y in s]) for s in strings], axis=0)
        assert shared[near].min() >= np.delete(shared, near).max()


def test_cells_within_reach():
    rng = np.random.default_rng(0)
    for _ in range(20):
        m, reach = rng.normal(size=6), float(rng.uniform(0, 3))
        own = int(prefix_forest.cells_of(m[None])[0])
        want = {c for c in range(64) if sum(abs(x) for k, x in enumerate(m) if (c ^ own) >> k & 1) <= reach}
        got = list(prefix_forest.cells_within(m, reach))
        assert set(got) == want and len(got) == len(want)


def test_clusters_need_few_candidates(spark, monkeypatch):
    monkeypatch.setattr(prefix_forest, "SHARD", 400)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 24)) * 3
    rows = [(k, (centres[k % 40] + rng.normal(size=24)).tolist()) for k in range(6000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = prefix_forest.nearest(df).collect()
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    got = {}
    for r in out:
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = []
    for q in range(0, 6000, 50):
        s = x @ x[q]
        s[q] = -9
        hits.append(len(got[q] & set(np.argsort(-s)[:5].tolist())) / 5)
    assert len(got) == 120 and np.mean(hits) >= 0.9
    assert np.mean([r.inspected for r in out]) < 0.25 * len(rows)
