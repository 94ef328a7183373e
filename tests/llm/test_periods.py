import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gaugeworks.llm import periods
from gaugeworks.llm.queries import op13_periods


def period_of(words):
    """Smallest period of a list."""
    return next(q for q in range(1, len(words) + 1) if all(words[i] == words[i + q] for i in range(len(words) - q)))


def brute_runs(words):
    """All runs by trying every period from every start."""
    n, out = len(words), set()
    for q in range(1, n // 3 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(24, 3 * q) and period_of(words[i : j + q]) == q:
                out.add((i, j + q - i, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    """A row of the contract, from its words."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32((str(doc_id) if doc_id is not None else "").encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute_runs(words)
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    best = None
    for s, length, q in found:
        if best is None or length * best[2] > best[1] * q:
            best = s, length, q
    four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return doc_id, len(found), *four, sha("".join(f"{s},{length},{q}\n" for s, length, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in dropped))


def found(words):
    ids = {w: k for k, w in enumerate(dict.fromkeys(words))}
    hashes = np.array([ids[w] for w in words], np.uint64)
    counts, base = periods.lag_counts(hashes, np.array([0, len(words)]))
    assert counts[1:].tolist() == [sum(words[i] == words[i + q] for i in range(len(words) - q)) for q in range(1, len(words) // 3 + 1)]
    return [(r.start, r.length, r.period) for r in periods.find_runs(hashes, counts)]


@pytest.mark.parametrize("heavy", [(2.0, 64), (0.0, 0), (0.05, 3)])
def test_runs_equal_brute_force(monkeypatch, heavy):
    monkeypatch.setattr(periods, "HEAVY", heavy[0])
    monkeypatch.setattr(periods, "LEAST_HEAVY", heavy[1])
    rng = random.Random(13)
    for trial in range(250):
        words = []
        while len(words) < rng.randrange(1, 160):
            unit = [rng.choice("abcd"[: rng.randrange(1, 5)]) for _ in range(rng.randrange(1, 12))]
            words += (unit * rng.randrange(1, 14))[: rng.randrange(1, 90)]
        assert found(words) == brute_runs(words), (trial, words)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from("ab"), min_size=1, max_size=6), st.integers(1, 20)), max_size=6))
def test_runs_of_two_words(parts):
    words = [w for unit, k in parts for w in unit * k]
    assert found(words) == brute_runs(words)


def test_long_texts_by_blocks(monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(periods, "LONG", 0)
    for _ in range(60):
        words = [rng.choice("abcdefgh") for _ in range(80)]
        unit = [rng.choice("abc") for _ in range(rng.randrange(1, 20))]
        words += unit * rng.randrange(3, 6) + [rng.choice("ab") for _ in range(60)]
        assert found(words) == brute_runs(words)


def test_lags_inside_a_run_are_not_scanned(monkeypatch):
    scans = []
    whole = periods._islands
    monkeypatch.setattr(periods, "_islands", lambda same, least: scans.append(len(same)) or whole(same, least))
    words = np.array([1, 2, 1, 3] * 50_000, np.uint64)
    counts, _ = periods.lag_counts(words, np.array([0, len(words)]))
    assert [(r.start, r.length, r.period) for r in periods.find_runs(words, counts)] == [(0, 200_000, 4)]
    assert len(scans) < 10


CASES = [(k, t) for k, t in enumerate([
    None, "", " \t\n", "a", "a " * 23, "a " * 24, "x " + "a b " * 12 + "c", "a b c d e f g h i " * 2 + "a b c d e f g h", "a b c d e f g h i " * 3,
    "α β " * 20, "a b " * 30, "w " * 3000, " ".join(str(k % 700) for k in range(2100)), " ".join(str(k % 700) for k in range(2099)),
    ("p q r s " * 10 + "z ") * 5, "a b " * 12 + "b a " * 12,
])]


def test_query_equals_brute_force(spark, tmp_path):
    looped = [k for k in range(100, 4000) if zlib.crc32(str(k).encode()) % 10 == 0][:20]
    rng = random.Random(1)
    rows = CASES + [(k, " ".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(1, 200)))) for k in looped] + [(None, "a b " * 30), (5, "a " * 30), (5, "a " * 30)]
    spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, TEXT_2 string, n_runs int").write.parquet(str(tmp_path / "documents.parquet"))
    got = op13_periods(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted((brute_row(*r) for r in rows), key=key)
    assert any(r[1] > 0 and r[0] in looped for r in map(tuple, got.collect()))


def test_operator_gives_runs_and_texts(spark):
    docs = spark.createDataFrame([(1, "say it: " + "la di da " * 9 + "end", 5), (2, None, 6)], "doc_id bigint, text string, runs int")
    a, b = periods.find_periods(docs).orderBy("doc_id").collect()
    assert [tuple(r) for r in a.runs] == [(2, 27, 3)] and a.collapsed == "say it: la di da end" and a.exponent_milli == 9000
    assert b.n_words == 0 and b.runs == [] and b.collapsed == "" and b.start is None
    assert periods.find_periods(docs.where("false")).count() == 0
    assert "collapsed" not in periods.find_periods(docs, collapse=False).columns


def test_whole_table_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    short = docs.where(F.length("text") < 6000).select("doc_id", "text").collect()
    want = {r.doc_id: brute_row(r.doc_id, r.text) for r in short}
    got = {r.doc_id: tuple(r) for r in op13_periods(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == docs.count() and all(got[k] == v for k, v in want.items())
