import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from gaugeworks.llm import bloom_lm
from gaugeworks.llm.queries import op3_lm_score


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)})), None]


def base(docs):
    """[(id, train, n_tokens, n_known, N, base)] with exact counts."""
    c = Counter(t for _, text, train in docs if train for t in tokens(text))
    n, v = sum(c.values()), len(c)
    return [(d, bool(train), len(t := tokens(text)), sum(c[x] > 0 for x in t), n, sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in t)) for d, text, train in docs]


def same(got, want):
    key = lambda r: (str(r[0]), r[2], round(r[5], 6))
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-9, atol=1e-9)


def test_filter_never_underestimates_and_seldom_errs():
    rng = np.random.default_rng(1)
    keys = rng.choice(1 << 32, 30000, replace=False).astype(np.uint64)
    counts = rng.geometric(0.4, 20000)
    f = bloom_lm.LogFrequencyFilter(keys[:20000], counts)
    seen, unseen = f.levels(keys[:20000]), f.levels(keys[20000:])
    want = bloom_lm.level_of(counts)
    assert (seen >= want).all() and (seen > want).mean() < 0.06 and (unseen > 0).mean() < 0.06
    assert (bloom_lm.count_of(bloom_lm.level_of(np.arange(1, 3))) == [1, 2]).all()
    x = np.array([0, 3, 254, 255, 10**7])
    assert bloom_lm.unpacked(bloom_lm.packed(x), 5).tolist() == x.tolist()


DOCS = [(1, "A b a\tb", True), (2, "a c é", True), (3, "b zz", False), (4, None, True), (5, "", False), (6, "x " * 3000, True), (None, "a b", True), (2, "a c é", True), (7, "q" * 5000, False)]


@pytest.mark.parametrize("size", [None, 100 << 20])
def test_counts_are_exact(spark, monkeypatch, size):
    if size:
        monkeypatch.setattr(bloom_lm, "scan_bytes", lambda df: size)
    df = spark.createDataFrame([(*r, 1) for r in DOCS], "doc_id long, text string, train boolean, score int")
    rows = [tuple(r) for r in bloom_lm.score_corpus(df, train_col="train").collect()]
    same([r[:6] for r in rows], base(DOCS))
    assert all(r[6] < 0 for r in rows)


def test_without_training_documents_and_empty(spark):
    df = spark.createDataFrame([(1, "a b", False), (2, None, None)], "doc_id long, text string, train boolean")
    rows = bloom_lm.score_corpus(df, train_col="train").collect()
    assert sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in rows) == [(1, 3, 0, 0, 0.0, 0.0), (2, 1, 0, 0, 0.0, 0.0)]
    assert bloom_lm.score_corpus(df.limit(0), train_col="train").collect() == []


def test_query_equals_brute_force_and_helps(spark):
    d = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text, zlib.crc32(str(r.doc_id).encode()) % 10 != 0) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    rows = op3_lm_score(spark, d).collect()
    same([(r.doc_id, not r.held_out, *tuple(r)[2:6]) for r in rows], base(docs))
    assert sum(r.score for r in rows if r.held_out) > sum(r.base_score for r in rows if r.held_out)


def brute_score(docs):
    """{(id, text): score} with quantised counts from plain dictionaries."""
    single, pair = Counter(t for _, text, train in docs if train for t in tokens(text)), Counter()
    for _, text, train in docs:
        if train:
            t = tokens(text)
            pair.update(zip([None, *t], t, strict=False))
    n, v, out = sum(single.values()), len(single), {}
    for d, text, _ in docs:
        t, total = tokens(text), 0.0
        for before, word in zip([None, *t], t, strict=False):
            c, k = pair[before, word], single[before]
            low = max((math.ceil(bloom_lm.BASE**q - 1e-9) for q in range(40) if bloom_lm.BASE**q <= c + 1e-9), default=0)
            trust = bloom_lm.WEIGHT * k / (k + bloom_lm.TRUST)
            p1 = (single[word] + 0.1) / (n + 0.1 * (v + 1))
            total += math.log10((1 - trust) * p1 + trust * min(low, k) / max(1, k + bloom_lm.FALSE * (k + v + 1)))
        out[d, text] = total
    return out


def test_score_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(60)]
    docs = [(100 + k, " ".join(rng.choice(words, rng.integers(0, 60), p=np.arange(1, 61) / 1830)), bool(k % 5)) for k in range(120)] + DOCS
    want = brute_score(docs)
    rows = bloom_lm.score_corpus(spark.createDataFrame(docs, "doc_id long, text string, train boolean"), train_col="train").collect()
    texts = {d: text for d, text, _ in docs}
    assert len(rows) == len(docs)
    off = [r for r in rows if abs(r.score - want[r.doc_id, texts[r.doc_id]]) > 1e-9]
    assert not off  # a false positive would show here: FALSE is 2e-7


def test_probabilities_sum_to_at_most_one():
    rng = np.random.default_rng(3)
    for _ in range(50):
        successors = rng.geometric(0.3, rng.integers(1, 200))  # counts of the words seen after one context
        unseen, context = int(rng.integers(1, 3000)), int(successors.sum())
        counts = np.concatenate([successors, np.zeros(unseen, np.int64)])
        known = len(counts)
        keys = rng.integers(0, 1 << 62, known).astype(np.uint64)
        level = bloom_lm.LogFrequencyFilter(keys[: len(successors)], successors).levels(keys)
        # unigram counts of the same words, and one unknown word
        single, both = bloom_lm.mixed(np.append(counts, 0), np.full(known + 1, context), np.append(level, 0).astype(np.int64), context, len(successors))
        assert both.sum() <= 1 + (single.sum() - 1) * (1 - bloom_lm.WEIGHT * context / (context + bloom_lm.TRUST)) + 1e-9 and (both > 0).all()
    x = np.arange(1, 5000)
    assert (bloom_lm.count_of(bloom_lm.level_of(x)) <= x).all() and (bloom_lm.count_of(bloom_lm.level_of(x)) > x / 2).all()


def test_keys_are_packed_without_loss():
    rng = np.random.default_rng(2)
    for n, top in ((0, 2**63), (1, 2**63), (2, 256), (5000, 2**63), (5000, 2**40)):
        keys = np.unique(rng.integers(0, top, n).astype(np.uint64) | np.uint64(1 << 63))
        assert (bloom_lm.unpacked_keys(bloom_lm.packed_keys(keys), len(keys)) == keys).all()


def test_messages_grow_with_the_corpus(spark, monkeypatch):
    sent = []
    for n in (400, 1600):
        monkeypatch.setattr(bloom_lm, "scan_bytes", lambda df, n=n: n * 40_000)
        whole = bloom_lm.persist
        monkeypatch.setattr(bloom_lm, "persist", lambda df, label: sent.append((out := whole(df, label)).count()) or out)
        docs = spark.range(n).selectExpr("id doc_id", "concat_ws(' ', transform(sequence(1, 30), i -> concat('w', cast(hash(id, i) % 5000 as string)))) text", "true train")
        assert bloom_lm.score_corpus(docs, train_col="train").count() == n
        monkeypatch.undo()
    assert sent[1] <= 6 * sent[0]
