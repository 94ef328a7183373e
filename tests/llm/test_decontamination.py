import random
import re

import numpy as np

from gaugeworks.llm import fm_index
from gaugeworks.llm.fm_index import FmIndex, drop_contaminated, find_contamination
from gaugeworks.llm.queries import op8_decontamination

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
A_Z = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORDS.findall((text or "").translate(A_Z))


def brute(docs, items, window=13):
    phrases = {}
    for item, text in items:
        w = words(text)
        for k in range(max(1, len(w) - window + 1)) if w else ():
            phrases.setdefault(tuple(w[k : k + window]), set()).add(item)
    sizes = {len(p) for p in phrases}
    out = []
    for d, text in docs:
        w = words(text)
        hit, of = set(), set()
        for size in sizes:
            for k in range(len(w) - size + 1):
                if (p := tuple(w[k : k + size])) in phrases:
                    hit |= set(range(k, k + size))
                    of |= phrases[p]
        out.append((d, len(w), len(hit), sorted(map(str, of))))
    return out


def test_index_counts_and_locates_every_phrase():
    rng = np.random.default_rng(1)
    seq = rng.integers(1, 5, 600)
    index = FmIndex(seq, 6)
    for size in (1, 2, 5):
        phrases = rng.integers(1, 6, (50, size))
        lo, hi = index.search(phrases)
        for p, a, b in zip(phrases, lo, hi, strict=True):
            want = [k for k in range(len(seq) - size + 1) if (seq[k : k + size] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_equals_brute_force_with_edge_cases(spark):
    rng = random.Random(3)
    vocabulary = ["ab", "Cd", "é", "7", "x9", "über"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(1, text(16)), (2, text(13)), (3, "one ONE"), (4, ""), (5, None), (11, "one one"), (6, "x")]
    docs = [(k, text(rng.randrange(80))) for k in range(60)] + [(99, None), (98, ""), (97, "..."), (96, "a one-ONE b"), (96, "a one-ONE b"), (None, "one one")]
    docs += [(95, text(5000) + " " + items[0][1] + "! " + items[1][1].upper())]
    got = find_contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted([(r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got], key=order) == sorted(brute(docs, items), key=order)
    for r in got:
        assert sum(s.end - s.first for s in r.spans) == r.n_hit
        assert all(a.end < b.first for a, b in zip(r.spans, r.spans[1:], strict=False))


def test_empty_tables_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 5, 6)], "doc_id long, text string, n_words long, item_id long")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[:3] for r in find_contamination(docs, none).collect()] == [(1, 2, 0)]
    assert find_contamination(docs.limit(0), none).collect() == []
    item = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert drop_contaminated(docs, none).collect() == docs.collect()
    assert drop_contaminated(docs, item).collect() == []


def test_query_equals_brute_force(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{d}/benchmark.parquet").collect()
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.contaminated) for r in op8_decontamination(spark, d).collect()}
    want = {i: (n, h, len(x), h > 0 and 20 * h >= n) for i, n, h, x in brute(docs, items)}
    assert got == want and any(x[3] for x in got.values())


def test_benchmark_beyond_one_block_is_searched_whole(spark, monkeypatch):
    monkeypatch.setattr(fm_index, "MOST_WORDS", 500)
    monkeypatch.setattr(fm_index, "BLOCK_WORDS", 13 * 20, raising=False)
    rng = random.Random(5)
    text = lambda n: " ".join(f"w{rng.randrange(400)}" for _ in range(n))
    items = [(k, text(rng.choice([3, 13, 15, 30]))) for k in range(40)] + [(90, text(200)), (91, text(200)), (92, None), (93, "")]
    long = [t.split() for _, t in items[40:42]]
    docs = [(k, text(30) + " " + rng.choice(items[:40])[1] + " " + text(10)) for k in range(50)]
    docs += [(100, " ".join(long[0])), (101, " ".join(long[0][15:40] + long[1][150:])), (102, items[3][1] + " " + items[4][1]), (102, items[3][1]), (None, " ".join(long[1][30:60])), (103, None), (104, text(40))]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = find_contamination(table, bench).collect()
    want = brute(docs, items)
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted([(r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got], key=order) == sorted(want, key=order)
    for r in got:
        assert sum(s.end - s.first for s in r.spans) == r.n_hit
        assert all(a.end < b.first for a, b in zip(r.spans, r.spans[1:], strict=False))
    kept = sorted(str(r.doc_id) for r in drop_contaminated(table, bench).collect())
    assert kept == sorted(str(d) for d, n, h, _ in want if not h or 20 * h < n)


def test_items_without_an_id_are_searched(spark):
    text = " ".join(f"w{k}" for k in range(13))
    bench = spark.createDataFrame([(None, text), (7, text), (None, "x y"), (7, "z"), (10, text)], "item_id long, text string")
    docs = spark.createDataFrame([(1, text), (2, "x y"), (3, "z z"), (4, "q")], "doc_id long, text string")
    got = {r.doc_id: (r.n_hit, r["items"]) for r in find_contamination(docs, bench).collect()}
    assert got == {1: (13, ["10", "7", None]), 2: (2, [None]), 3: (2, ["7"]), 4: (0, [])}
    assert [r.doc_id for r in drop_contaminated(docs, bench).collect()] == [4]
