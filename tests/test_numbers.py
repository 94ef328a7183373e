import random

import pytest
from pyspark.sql import functions as F

from gaugeworks import schema as S
from gaugeworks.functions import text

ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "x x twenty thirty forty fifty sixty seventy eighty ninety".split()


def below_hundred(n):
    return [ONES[n]] if n < 20 else [TENS[n // 10]] + ([ONES[n % 10]] if n % 10 else [])


def speak(n, also):
    """A number in words, with or without an "and" after hundreds and thousands."""
    if n >= 1000:
        rest = n % 1000
        return speak(n // 1000, also) + ["thousand"] + (["and"] if also and 0 < rest < 100 else []) + (speak(rest, also) if rest else [])
    if n >= 100:
        return [ONES[n // 100], "hundred"] + ((["and"] if also else []) + below_hundred(n % 100) if n % 100 else [])
    return below_hundred(n)


def tokens(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    return [r.x for r in df.select("k", text.cross_model_tokens(F.col("t")).alias("x")).orderBy("k").collect()]


def test_numbers_below_a_million_come_back(spark):
    rng = random.Random(3)
    numbers = [*range(0, 2100), *(rng.randrange(1_000_000) for _ in range(2500)), *range(1000, 1_000_000, 9973), 999_999]
    for also in (False, True):
        got = tokens(spark, ["we paid " + " ".join(speak(n, also)) + " today" for n in numbers])
        assert got == [["we", "paid", *str(n), "today"] for n in numbers]


CASES = {
    "four zero five": "4 0 5", "fourteen hundred": "1 4 0 0", "eighty-eight keys": "8 8 keys", "nineteen eighty four": "1 9 8 4", "call oh five": "call 0 5", "a hundred and five": "a 1 0 5", "two hundred and": "2 0 0 and",
    "one hundred and cats": "1 0 0 and cats", "twenty first": "2 1 st", "the forty second one": "the 4 2 nd 1", "one hundredth": "1 0 0 th", "two thousand and twelfth": "2 0 1 2 th", "twenty twenty": "2 0 2 0", "ten five": "1 0 5", "twenty zero": "2 0 0",
    "five million": "5 million", "Q9J05": "q 9 j 0 5", "405-912-7777": "4 0 5 9 1 2 7 7 7 7", "thousand": "1 0 0 0", "two hundred thousand": "2 0 0 0 0 0", "three thousand four thousand": "3 0 0 0 4 0 0 0", "and one and two": "and 1 and 2", "": "", None: "",
    "five hundred hundred": "5 0 0 1 0 0", "12th street": "1 2 th street",
}


def test_spoken_variants(spark):
    assert [" ".join(x) for x in tokens(spark, list(CASES))] == list(CASES.values())


def test_other_languages_are_refused():
    with pytest.raises(S.NormalizerUnavailableError):
        text.cross_model_tokens(F.lit("zwei"), "de")
    assert text.cross_model_tokens(F.lit("two"), "en-GB") is not None


def test_errors_equal_the_lists_of_edits():
    rng = random.Random(9)
    for _ in range(600):
        a, b = ([rng.choice("abcde") for _ in range(rng.randrange(rng.choice([1, 9, 150])))] for _ in range(2))
        assert text.word_errors(a, b) == sum(o != "match" for o, *_ in text._backtrace(a, b))


def test_shift_by_arm(spark):
    from gaugeworks.operators import profiles

    rows = [("a", "pay forty two now", "pay 42 now"), ("a", "pay forty two now", "pay forty two now"), ("b", "one", "two"), ("b", None, "heard"), ("b", "", None), ("b", "it is x", "it is x 5")]
    got = {r.k: r for r in profiles.normalization_shift(spark.createDataFrame(rows, "k string, r string, h string"), "r", "h", ["k"]).collect()}
    assert (got["a"].n, got["a"].wer_strict, got["a"].wer_normalized, got["a"]["shift"], got["a"].n_cleared) == (2, 0.25, 0.0, 0.25, 1)
    assert (got["b"].n, got["b"].n_cleared, got["b"].n_raised) == (4, 0, 0) and got["b"].wer_strict == pytest.approx((1 + 1 + 0 + 1 / 3) / 4)
    assert profiles.normalization_shift(spark.createDataFrame([], "k string, r string, h string"), "r", "h", ["k"]).count() == 0
