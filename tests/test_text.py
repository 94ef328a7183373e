import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.functions import numeric, text

SAMPLES = ["O'Brien’s Wi-Fi, it’s £5!", "wi fi wi fi wifi swi fix", "", None, "  \t ", "é‿ü ½ — ’", "naïve café\xa0x", "a_b-c", "ΑΒΓ 中文", "Wi Fi"]


def plain(s):
    s = re.sub("['’ʼʻ`]", "", (s or "").lower())
    words, out = re.sub(r"[^\w\s]", " ", s).split(), []
    while words:
        if words[:2] == ["wi", "fi"]:
            out.append("wifi")
            words = words[2:]
        else:
            out.append(words.pop(0))
    return out


def test_normalize_equals_a_plain_version(spark):
    df = spark.createDataFrame([(s,) for s in SAMPLES], "s string")
    for r in df.select("s", text.normalize(F.col("s")).alias("t")).collect():
        assert r.t == plain(r.s), r.s


def counts(ref, hyp):
    out = [o for o, _, _ in text._backtrace(ref, hyp)]
    return tuple(out.count(k) for k in ("match", "sub", "del", "ins"))


def test_edits_equal_the_matrix(spark):
    rng = random.Random(7)
    pairs = [([rng.choice("abc") for _ in range(rng.randrange(9))], [rng.choice("abcd") for _ in range(rng.randrange(9))]) for _ in range(300)] + [([], []), ([], ["a"]), (["a"], [])]
    df = spark.createDataFrame(pairs, "ref array<string>, hyp array<string>")
    rows = text.edit_lists(df.withColumn("e", text.edits(F.col("ref"), F.col("hyp"))), "ref", "hyp", "l").withColumn("w", text.wer(F.col("e"), F.size("ref"))).collect()
    for r in rows:
        assert tuple(r.e) == counts(r.ref, r.hyp), (r.ref, r.hyp)
        assert [x.ref for x in r.l if x.ref is not None] == r.ref and [x.hyp for x in r.l if x.hyp is not None] == r.hyp
        errors = sum(tuple(r.e)[1:])
        assert r.w == pytest.approx(errors / len(r.ref) if r.ref else float(bool(r.hyp)))


def test_confidences_follow_their_words(spark):
    rows = [("Wi fi is-on", [0.2, 0.4, 0.8], [0.3, 0.8, 0.8]), ("a — b", [0.1, 0.9, 0.2], [0.1, 0.2]), ("a b", [0.5], None), ("", [], [])]
    df = spark.createDataFrame(rows, "t string, c array<double>, want array<double>")
    for r in df.withColumn("got", text.align_confidences(F.col("t"), F.col("c"))).collect():
        assert (r.got is None) == (r.want is None) and (r.got is None or r.got == pytest.approx(r.want))


def test_tasks(spark):
    df = spark.createDataFrame([("send it to Oak Street", {"a": "oak street", "b": "nine"}, ["a"]), ("oak", {"a": "oak street"}, None), (None, {}, None)], "t string, s map<string,string>, c array<string>")
    got = [r.r for r in df.select(text.task_result(F.col("t"), F.col("s"), F.col("c")).alias("r")).collect()]
    assert [(r.n_hit, r.critical_failure) for r in got] == [(1, False), (0, True), (0, False)] and got[0].entity_error_rate == 0.5 and got[2].slot_accuracy is None


def test_names_classes_failures_and_leaks(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first().x
    assert value(text.proper_nouns(F.lit("Ask for Maria. The code is A seven. Then call “O'Neil” in Ghent!"))) == ["ghent", "maria", "oneil"]
    words = {"b": "spelled_letter", "a": "function_word", "Seven": "digit_word", "maria": "proper_noun", "the": "function_word", "code": "content_word", "": "content_word"}
    for w, want in words.items():
        assert value(text.word_class(F.lit(w), F.array(F.lit("maria")))) == want
    errors = {"": "unknown", "HTTP 401 x": "auth", "quota; timeout": "rate_limit", "socket closed": "network", "corrupt file": "input_rejected", "odd": "other"}
    for e, want in errors.items():
        assert value(text.failure_category(F.lit(e))) == want
    hit = lambda failed, error, mode: value(text.is_cache_hit(F.lit(failed), F.lit(error), mode))
    assert hit(False, "", "all") and not hit(True, "timeout", "auto") and hit(True, "corrupt", "auto") and hit(True, "timeout", "none") and not hit(True, "corrupt", "all")
    assert value(text.redact(F.lit("Big-Vendor, big_vendor bigvendor xbig vendor"), ["big vendor"])) == "[redacted], [redacted] bigvendor xbig vendor"
    assert value(text.room_name(F.lit("/a/b/large_hall-03.wav"))) == "large_hall"


def test_numbers(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first().x
    assert value(numeric.sigmoid(numeric.logit(F.lit(0.3)))) == pytest.approx(0.3) and value(numeric.logit(F.lit(1.0))) == pytest.approx(13.8155, abs=1e-3)
    with pytest.raises(Exception, match="log probability"):
        value(numeric.probability_of_logprob(F.lit(0.1)))
    c = spark.createDataFrame([(0.45, 20.0, "babble", "opus-lowrate", 0.0)], "rt60 double, snr_db double, noise_type string, codec string, mic_rolloff double")
    r = c.select(numeric.condition_name().alias("n")).select("n", numeric.parse_condition(F.col("n")).alias("p")).first()
    assert r.n == "rt60-0.45_snr-20_babble_opus-lowrate_mic-0" and tuple(r.p) == tuple(c.first())


def test_alignment_in_blocks_is_that_of_the_whole_matrix(monkeypatch):
    draw = np.random.default_rng(3)
    for n, m in ((0, 0), (0, 3), (4, 0), (1, 1), (30, 41), (50, 7)):
        a, b = draw.integers(0, 4, n), draw.integers(0, 4, m)
        monkeypatch.setattr(text, "_CELLS", 1 << 22)
        whole = text._alignment(a, b).tolist()
        monkeypatch.setattr(text, "_CELLS", 8)
        assert text._alignment(a, b).tolist() == whole
        assert (whole.count(0) + whole.count(1) + whole.count(2), whole.count(0) + whole.count(1) + whole.count(3)) == (n, m)
        assert len(whole) - whole.count(0) == text.word_errors(a.tolist(), b.tolist())


def test_edits_come_in_bounded_batches(spark):
    df = spark.createDataFrame([(["a", "b"], ["a", "c", "d"]), (None, ["x"]), ([], [])], "r array<string>, h array<string>")
    assert [[tuple(e) for e in r.edits] for r in text.edit_lists(df, "r", "h").collect()] == [[("match", "a", "a"), ("ins", None, "c"), ("sub", "b", "d")], [("ins", None, "x")], []]
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 4 << 20
