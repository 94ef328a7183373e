import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gaugeworks.llm import bpe, chunks, common, dac
from gaugeworks.llm.queries import op5_bpe_roundtrip, op10_token_files, tokenizer_path

PATH = tokenizer_path()
LIBRARY = Tokenizer.from_file(PATH)
BITS = ["a", "aa", " ", "  ", "\n", "'s", "é", "中", "1½", "\xa0", "\x1c", "\x85", "<|endoftext|>", "<|endo", "!!", "the", " ing", "x" * 30, "😀", "́", "\r\n", "\x00"]


def wanted(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


def test_prefix_encoder_equals_the_library():
    encoder, rng = bpe.encoder_of(bpe.read_spec(PATH)), random.Random(5)
    for _ in range(3000):
        text = "".join(rng.choice(BITS) for _ in range(rng.randrange(25)))
        ids = encoder.encode(text)
        assert ids == wanted(text) and encoder.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)
    long = "ab" * 20000
    assert encoder.encode(long) == wanted(long)


@pytest.mark.parametrize("odd", [True, False])
def test_columns_of_texts_equal_the_library(odd):
    rng, bits = random.Random(6), [b for b in BITS if odd or not b.strip("\xa0\x1c\x85") == "" or b.isascii() and b not in "\x1c"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(25))) for _ in range(2000)] + [None, ""]
    want = [wanted(t or "") for t in texts]
    assert list(bpe.encoder_of(bpe.read_spec(PATH)).encode_all(pa.array(texts))) == want
    found = dac.encoder_of(bpe.read_spec(PATH))(pa.array(texts))
    assert [p.tolist() for _, _, ids, size in found for p in np.split(ids, np.cumsum(size)[:-1])] == want


def thue_morse(n):
    """Words whose polynomial hashes modulo a power of two are equal."""
    word = "a"
    while len(word) < n:
        word += word.translate({97: 98, 98: 97})
    return word, word.translate({97: 98, 98: 97})


@pytest.mark.parametrize("hashed", ["as it is", "all alike", "by length"])
def test_chunks_of_one_hash_are_told_apart(monkeypatch, hashed):
    if hashed != "as it is":
        monkeypatch.setattr(chunks, "hash_runs", lambda data, member, starts, ends: (ends - starts if hashed == "by length" else 0 * starts).astype(np.uint64))
    a, b = thue_morse(2048)
    texts = [a, b, f"{b} {a} x", "the cat", "the dog", "tea dog", a[:1024], b[:1024], None, "cat the", f"{a} {a}{b}"] * 2
    want = [wanted(t or "") for t in texts]
    spec = bpe.read_spec(PATH)
    for _ in range(2):
        assert list(bpe.PrefixEncoder(spec).encode_all(pa.array(texts))) == want
        encoder = dac.LibraryEncoder(spec)
        for _ in range(2):  # from the memory too
            assert [p.tolist() for _, _, ids, size in encoder(pa.array(texts)) for p in np.split(ids, np.cumsum(size)[:-1])] == want


def test_hashes_tell_words_apart():
    words = [w for n in (256, 1024, 4096) for w in thue_morse(n)] + ["ab", "ba", "a", "b", "aa", "\x00", "\x00\x00"]
    data = np.frombuffer("".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    got = common.hash_runs(data, np.ones(len(data), bool), ends - [len(w) for w in words], ends)
    alone = [common.hash_runs(np.frombuffer(w.encode(), np.uint8), np.ones(len(w), bool), np.array([0]), np.array([len(w)]))[0] for w in words]
    assert got.tolist() == alone and len(set(alone)) == len(words)


def test_every_entry_encodes_to_itself():
    encoder = bpe.encoder_of(bpe.read_spec(PATH))
    assert all(encoder.piece(encoder.bytes_of[n]) == [n] for n in range(50256))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1)), st.integers(0, 3))
def test_codes_round_trip(ids, shift):
    ids = np.array(ids, np.uint32) >> np.uint32(8 * shift)
    codes = dac.Codes(dac.encode(ids))
    assert codes.all().tolist() == ids.tolist() and [codes[k] for k in range(len(codes))] == ids.tolist()


def test_random_access_over_many_blocks():
    ids = np.random.default_rng(0).integers(0, 70000, 5000).astype(np.uint32)
    codes = dac.Codes(dac.encode(ids))
    assert [codes[k] for k in range(0, 5000, 7)] == ids[::7].tolist()
    places = np.random.default_rng(1).integers(0, 5000, 900)
    assert (codes.take(places) == ids[places]).all() and not len(codes.take(np.zeros(0, np.int64)))
    with pytest.raises(IndexError):
        codes[5000]


EDGES = [(5, "b"), (5, "a"), (3, None), (None, "x y"), (1, ""), (9, "word " * 30000), (7, "<|endoftext|> z"), (5, "a")]


def test_files_keep_order_starts_and_ties(spark):
    docs = spark.createDataFrame([(d, t, 1) for d, t in EDGES], "doc_id long, text string, n_tokens int")
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in dac.round_trip(docs, PATH, end_id=2).collect())
    at, want = 0, []
    for d, t in sorted(EDGES, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*wanted(t or ""), 2]
        want.append((at, d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    assert dac.round_trip(docs.limit(0), PATH, end_id=2).collect() == []


def test_any_range_is_read_from_the_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(dac, "RANGE_BYTES", 100)
    monkeypatch.setattr(dac, "RANGES", 3)
    texts = [f"word{k} " * (k % 40) for k in range(300)]
    docs = spark.createDataFrame([(k if k < 200 else 200, t) for k, t in enumerate(texts)], "doc_id long, text string")
    monkeypatch.setattr(dac, "scan_bytes", lambda df: 2000)
    path = dac.write_tokens(docs, f"{tmp_path}/t", PATH, end_id=2)
    assert spark.read.parquet(path).groupBy("part").count().count() > 15  # the repeated id is cut into ranges too
    tail = sorted(texts[200:])  # ids of one document keep the order of their first characters
    stream = [n for t in texts[:200] + tail for n in (*wanted(t), 2)]
    rows = dac.read_tokens(spark, path).collect()
    assert sorted((r.start, r.n_tokens) for r in rows) == [(sum(len(wanted(u)) + 1 for u in (texts[:200] + tail)[:k]), len(wanted(t)) + 1) for k, t in enumerate(texts[:200] + tail)]
    first = sum(len(wanted(t)) + 1 for t in texts[:200])
    for a, b in ((0, 5), (first - 700, first), (17, 18), (first - 1, first)):
        got = sorted((r.position, r.id) for r in dac.read_ids(spark, path, a, b).collect())
        assert got == list(enumerate(stream))[a:b]
    assert dac.read_ids(spark, path, 10**9, 10**9 + 5).collect() == []


def test_encode_and_decode_keep_other_columns(spark):
    docs = spark.createDataFrame([(d, t, "k") for d, t in EDGES], "doc_id long, text string, token_ids string")
    coded = bpe.encode_documents(docs, PATH)
    assert [r.token_ids for r in coded.collect()] == [wanted(t or "") for _, t in EDGES]
    assert [r.text for r in bpe.decode_documents(coded, PATH).collect()] == [t or "" for _, t in EDGES]
    assert bpe.encode_documents(docs.limit(0), PATH).collect() == []


def test_queries_equal_the_library(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").orderBy("doc_id").collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    five = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op5_bpe_roundtrip(spark, d).collect()}
    ten = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in op10_token_files(spark, d).collect()}
    at = 0
    for r in docs:
        ids = wanted(r.text)
        assert five[r.doc_id] == (len(ids), sha(",".join(map(str, ids))), sha(LIBRARY.decode(ids, skip_special_tokens=False)))
        assert ten[r.doc_id] == (at, len(ids) + 1, zlib.crc32(np.array([*ids, 2], "<u4").tobytes()))
        at += len(ids) + 1
    assert len(five) == len(ten) == len(docs)
