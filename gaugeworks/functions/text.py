"""Text functions as Column expressions: normalization, token tests, word classes, edits."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks import schema as S
from gaugeworks.session import ship, tune

#: Marks deleted rather than spaced, and words written together or apart.
APOSTROPHES = "'’ʼʻ`"
COMPOUNDS = {("wi", "fi"): "wifi"}

#: Digit and function words.
DIGIT_WORDS = """
zero one two three four five six seven eight nine ten eleven twelve thirteen
fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty
sixty seventy eighty ninety hundred thousand million billion
first second third fourth fifth sixth seventh eighth ninth tenth
oh
""".split()
FUNCTION_WORDS = """
a an the and or but if then than that this these those there here
i you he she it we they me him her us them my your his its our their
is are was were be been being am do does did done doing have has had having
will would can could shall should may might must
to of in on at by for with from into onto over under about as up down out off
not no yes so very just too also only please thank thanks
""".split()

#: Categories of failures in order, with the substrings that tell them.
FAILURES = {
    "auth": "api_key|api key|unauthorized|authentication|http 401|http 403|forbidden|invalid token|credential",
    "rate_limit": "rate limit|ratelimit|http 429|too many requests|quota|insufficient|payment|billing",
    "network": "timeout|timed out|connection|ssl|certificate|http 500|http 502|http 503|http 504|unavailable|temporarily|dns|socket|remote end closed",
    "asset": "missingasseterror|codecunavailable|filenotfounderror|no such file|no such directory",
    "input_rejected": "unsupported media|unsupported file|unsupported audio|invalid audio|corrupt|could not decode|decode error|http 415|file too short|file too long|duration exceeds",
}


def normalize(text: Column) -> Column:
    """Tokens for scoring: lower case, apostrophes deleted, other signs to spaces (letters,
    numbers and '_' stay), compounds joined.  Empty and NULL text give no tokens."""
    t = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), f"[{APOSTROPHES}]", "")
    t = F.trim(F.regexp_replace(F.regexp_replace(t, r"(?U)[^\p{L}\p{N}_\s]", " "), r"(?U)\s+", " "))
    for parts, whole in COMPOUNDS.items():
        t = F.regexp_replace(t, rf"(?<![^ ]){' '.join(parts)}(?![^ ])", whole)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " "))


def has_phrase(tokens: Column, phrase: Column) -> Column:
    """Whether the phrase's tokens stand in the tokens, adjacent and in order; an empty
    phrase always does."""
    join = lambda x: F.concat(F.lit(" "), F.array_join(x, " "), F.lit(" "))
    return F.when(F.size(phrase) == 0, True).otherwise(F.contains(join(tokens), join(phrase)))


def word_class(word: Column, proper: Column | None = None) -> Column:
    """letter, digit word, proper noun, function word or content word, in that order."""
    w = F.lower(F.trim(F.coalesce(word, F.lit(""))))
    letter = (F.length(w) == 1) & w.rlike(r"^\p{L}$")
    out = F.when(w == "", "content_word").when(letter, F.when(w.isin("a", "i"), "function_word").otherwise("spelled_letter")).when(w.isin(DIGIT_WORDS), "digit_word")
    if proper is not None:
        out = out.when(F.coalesce(F.array_contains(proper, w), F.lit(False)), "proper_noun")
    return out.when(w.isin(FUNCTION_WORDS), "function_word").otherwise("content_word")


def proper_nouns(say_this: Column) -> Column:
    """Names by capitals inside a sentence: neither the first word nor a single letter."""
    strip = "^[\\p{Punct}“”‘’]+|[\\p{Punct}“”‘’]+$"
    sentences = F.split(F.coalesce(say_this, F.lit("")), "[.!?]+")
    words = F.transform(sentences, lambda s: F.filter(F.transform(F.split(F.trim(s), r"(?U)\s+"), lambda w, k: F.when(k > 0, F.regexp_replace(w, strip, ""))), lambda w: w.isNotNull() & (F.length(w) > 1) & w.rlike(r"^\p{Lu}")))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.flatten(words), normalize))))


def task_result(transcript: Column, slots: Column, critical: Column) -> Column:
    """Struct of slots, hits, accuracy, entity error and critical failure for a map of
    slots; without a list of critical slots all are."""
    tokens = normalize(transcript)
    entries = F.map_entries(slots)
    missed = F.transform(F.filter(entries, lambda e: ~has_phrase(tokens, normalize(e.value))), lambda e: e.key)
    n = F.size(entries)
    lost = F.when(F.coalesce(F.size(critical), F.lit(0)) > 0, F.array_intersect(missed, critical)).otherwise(missed)
    return F.struct(
        n.alias("n_slots"), (n - F.size(missed)).alias("n_hit"), F.try_divide(n - F.size(missed), n).alias("slot_accuracy"), F.try_divide(F.size(missed), n).alias("entity_error_rate"), (F.size(lost) > 0).alias("critical_failure"), lost.alias("critical_missed"),
    )


def failure_category(error: Column) -> Column:
    """The first category whose substring occurs; 'unknown' without text, else 'other'."""
    e = F.lower(F.coalesce(error, F.lit("")))
    out = F.when(F.trim(e) == "", "unknown")
    for name, pattern in FAILURES.items():
        out = out.when(e.rlike(pattern), name)
    return out.otherwise("other")


def is_cache_hit(failed: Column, error: Column, retry: str = "auto") -> Column:
    """Whether a cached row spares the call: always when it succeeded; a failed one with
    'none', never with 'all', and with 'auto' if trying again is of no use."""
    again = {"none": F.lit(True), "all": F.lit(False), "auto": failure_category(error) == "input_rejected"}[retry]
    return ~F.coalesce(failed, F.lit(False)) | again


def edits(ref: Column, hyp: Column) -> Column:
    """Typed word alignment of two token arrays: struct of n_match, n_sub, n_del, n_ins.

    A fold over the hypothesis carries one row of the edit matrix; each cell holds its
    cost and counts.  Among equal costs match comes before substitution, deletion and
    insertion, seen from the end.  Work is |ref| x |hyp|, inside one row.
    """
    cell = lambda cost, m, s, d, i: F.struct(cost.cast("int").alias("cost"), m.cast("int").alias("m"), s.cast("int").alias("s"), d.cast("int").alias("d"), i.cast("int").alias("i"))
    zero = F.lit(0)
    first = F.transform(F.sequence(zero, F.size(ref)), lambda k: cell(k, zero, zero, k, zero))

    def better(diagonal: Column, up: Column, left: Column, same: Column) -> Column:
        hit = cell(diagonal["cost"], diagonal["m"] + 1, diagonal["s"], diagonal["d"], diagonal["i"])
        sub = cell(diagonal["cost"] + 1, diagonal["m"], diagonal["s"] + 1, diagonal["d"], diagonal["i"])
        dele = cell(left["cost"] + 1, left["m"], left["s"], left["d"] + 1, left["i"])
        ins = cell(up["cost"] + 1, up["m"], up["s"], up["d"], up["i"] + 1)
        least = F.least(F.when(same, diagonal["cost"]).otherwise(diagonal["cost"] + 1), left["cost"] + 1, up["cost"] + 1)
        return F.when(same & (diagonal["cost"] == least), hit).when(~same & (diagonal["cost"] + 1 == least), sub).when(left["cost"] + 1 == least, dele).otherwise(ins)

    def row(before: Column, word: Column) -> Column:
        start = before[0]
        head = F.array(cell(start["cost"] + 1, start["m"], start["s"], start["d"], start["i"] + 1))
        places = F.transform(ref, lambda r, k: F.struct(r.alias("r"), k.alias("k")))
        return F.aggregate(places, head, lambda acc, p: F.concat(acc, F.array(better(F.get(before, p["k"]), F.get(before, p["k"] + 1), F.element_at(acc, -1), p["r"] == word))))

    last = F.element_at(F.aggregate(hyp, first, row), -1)
    return F.struct(last["m"].alias("n_match"), last["s"].alias("n_sub"), last["d"].alias("n_del"), last["i"].alias("n_ins"))


#: Cells of an edit matrix whose steps are kept at a time.
_CELLS = 1 << 22
#: What an edit is, by its number.
_OPS = ("match", "sub", "del", "ins")


def _alignment(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The numbers (in ``_OPS``) of the edits in order between two arrays of words as numbers;
    seen from the end a match comes before a substitution, a deletion and an insertion of equal
    cost.  Costs are kept at the first row of each block only, and a block's steps, one byte a
    cell, are made again when the way back reaches it: no matrix of two long turns is held."""
    n, m = len(a), len(b)
    places = np.arange(m + 1)
    block = max(n, 1) if n * m <= _CELLS else math.isqrt(n)
    last = max(n - 1, 0) // block * block

    def after(cost: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        diagonal, up = cost[:-1] + (b != a[k]), cost[1:] + 1
        # insertions reach a cell along its row: a running minimum of cost less place
        return np.minimum.accumulate(np.append(k + 1, np.minimum(diagonal, up)) - places) + places, diagonal, up

    firsts, cost = [], places
    for k in range(last):
        if k % block == 0:
            firsts.append(cost.astype(np.int32))
        cost = after(cost, k)[0]
    firsts.append(cost.astype(np.int32))
    out, i, j = [], n, m
    while i and j:
        lo = (i - 1) // block * block
        step, cost = np.empty((i - lo, j), np.uint8), firsts[lo // block].astype(places.dtype)
        for k in range(lo, i):
            cost, diagonal, up = after(cost, k)
            step[k - lo] = np.where(cost[1:] == diagonal, 0, np.where(cost[1:] == up, 1, 2))[:j]
        while i > lo and j:
            way = int(step[i - 1 - lo, j - 1])
            out.append(way + 1 if way else int(a[i - 1] != b[j - 1]))
            i, j = i - (way != 2), j - (way != 1)
    out += [2] * int(i) + [3] * int(j)
    return np.array(out[::-1], np.uint8)


def _backtrace(ref: list, hyp: list) -> list[tuple]:
    """The edits in order of two lists of words: (op, word of the first, word of the second)."""
    words: dict = {}
    a, b = (np.array([words.setdefault(w, len(words)) for w in x], np.int64) for x in (ref, hyp))
    r, h = iter(ref), iter(hyp)
    return [(_OPS[k], next(r) if k != 3 else None, next(h) if k != 2 else None) for k in _alignment(a, b)]


def _coded(x: pa.Array, y: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array, pa.Array]:
    """Of two columns of word lists: where each list starts, all words as numbers, and all words."""
    x, y = (v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v for v in (x, y))
    starts = [np.concatenate([[0], np.cumsum(v.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64) for v in (x, y)]
    words = [v.flatten() for v in (x, y)]
    codes = pa.concat_arrays(words).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    return *starts, codes[: len(words[0])], codes[len(words[0]) :], *words


def edit_lists(rows: DataFrame, ref: str, hyp: str, name: str = "edits") -> DataFrame:
    """``rows`` with the full list of edits between two token arrays, in Arrow batches bounded
    in bytes; no object is made for a word or an edit.  Null arrays have no words."""
    tune(ship(rows.sparkSession))

    @F.arrow_udf("array<struct<op:string,ref:string,hyp:string>>")
    def align(x: pa.Array, y: pa.Array) -> pa.Array:
        at, to, a, b, refs, hyps = _coded(x, y)
        found, n = [np.zeros(0, np.uint8)], len(at) - 1
        for k in range(n):
            found.append(_alignment(a[at[k] : at[k + 1]], b[to[k] : to[k + 1]]))
        ops = np.concatenate(found)
        # every word of a side is in one edit, in order
        taken = [w.take(pa.array(np.cumsum(there) - 1, mask=~there)) for w, there in ((refs, ops != 3), (hyps, ops != 2))]
        ends = np.cumsum([len(f) for f in found])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(_OPS).take(pa.array(ops)), *taken], ["op", "ref", "hyp"]))

    return rows.withColumn(name, align(F.col(ref), F.col(hyp)))


def word_errors(ref: list, hyp: list) -> int:
    """The least number of words to change, drop or add.  The reference's words are bit
    positions: a column of the distance matrix is two sets of steps, up and down, kept as
    integers of any length (Myers), so a word of the other side costs a few operations on
    words of 64 steps, and no matrix is made."""
    at: dict = {}
    for k, w in enumerate(ref):
        at[w] = at.get(w, 0) | 1 << k
    top, full = 1 << max(len(ref) - 1, 0), (1 << len(ref)) - 1
    up, down, score = full, 0, len(ref)
    if not ref:
        return len(hyp)
    for w in hyp:
        same = at.get(w, 0)
        free = same | down
        over = (((same & up) + up) ^ up) | same
        more, less = down | (full & ~(over | up)), up & over
        score += bool(more & top) - bool(less & top)
        more, less = (more << 1 | 1) & full, less << 1 & full
        up, down = less | (full & ~(free | more)), more & free
    return score


def error_counts(rows: DataFrame, ref: str, hyp: str, name: str) -> DataFrame:
    """``rows`` with the number of word errors between two token arrays, in Arrow batches;
    null arrays have no words."""

    tune(ship(rows.sparkSession))

    @F.arrow_udf("int")
    def count(x: pa.Array, y: pa.Array) -> pa.Array:
        at, to, a, b, *_ = _coded(x, y)
        return pa.array([word_errors(a[at[k] : at[k + 1]].tolist(), b[to[k] : to[k + 1]].tolist()) for k in range(len(at) - 1)], pa.int32())

    return rows.withColumn(name, count(F.col(ref), F.col(hyp)))


def wer(counts: Column, n_ref: Column) -> Column:
    """Errors a reference word; without one 1 if anything was heard, else 0."""
    errors = counts["n_sub"] + counts["n_del"] + counts["n_ins"]
    return F.when(n_ref > 0, errors / n_ref).otherwise(F.when(counts["n_ins"] > 0, 1.0).otherwise(0.0))


def align_confidences(transcript: Column, confidences: Column) -> Column:
    """Confidences of raw tokens carried to normalized ones: a split token repeats its
    value, a compound averages, a token that vanishes loses it.  NULL where the two don't
    fit; callers count or raise."""
    raw = F.filter(F.split(F.trim(F.coalesce(transcript, F.lit(""))), r"(?U)\s+"), lambda t: t != "")
    pairs = F.flatten(F.transform(F.arrays_zip(raw.alias("t"), confidences.alias("c")), lambda p: F.transform(normalize(p["t"]), lambda w: F.struct(w.alias("w"), p["c"].alias("c")))))
    none = F.array().cast("array<struct<w:string,c:double>>")

    def merge(acc: Column, p: Column) -> Column:
        before = F.element_at(acc, -1)
        out = F.concat(acc, F.array(p))
        for (a, b), whole in COMPOUNDS.items():
            joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.lit(whole).alias("w"), ((before["c"] + p["c"]) / 2).alias("c"))))
            out = F.when((F.size(acc) > 0) & (before["w"] == a) & (p["w"] == b), joined).otherwise(out)
        return out

    merged = F.aggregate(pairs, none, merge)
    fits = (F.size(raw) == F.size(confidences)) & (F.transform(merged, lambda p: p["w"]) == normalize(transcript))
    return F.when(fits, F.transform(merged, lambda p: p["c"]))


def leak_pattern(terms: list[str]) -> str:
    """Matches any term; '_', '-' and blanks part its words alike, and letters or digits
    may not touch it."""
    import re

    body = "|".join("[\\s_-]+".join(re.escape(w) for w in re.split(r"[\s_-]+", t.lower()) if w) for t in sorted(terms, key=len, reverse=True))
    return rf"(?i)(?<![\p{{L}}\p{{N}}])(?:{body})(?![\p{{L}}\p{{N}}])"


def redact(text: Column, terms: list[str], mark: str = "[redacted]") -> Column:
    return F.regexp_replace(text, leak_pattern(terms), mark)


def room_name(path: Column) -> Column:
    """File name without folders, ending and a trailing number."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*?)(\.[A-Za-z0-9]+)?$", 1), r"[_-]?\d+$", "")


#: Number words that cross-model scoring writes as digits.
NUMBER_WORDS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}


#: The other English number words, and ordinals with the ending of their digits.
TEENS = {"ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19}
TENS = {"twenty": 20, "thirty": 30, "forty": 40, "fourty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90}
ORDINAL_ONES = {"zeroth": "0th", "first": "1st", "second": "2nd", "third": "3rd", "fourth": "4th", "fifth": "5th", "sixth": "6th", "seventh": "7th", "eighth": "8th", "ninth": "9th"}
ORDINAL_TEENS = {"tenth": "10th", "eleventh": "11th", "twelfth": "12th", "thirteenth": "13th", "fourteenth": "14th", "fifteenth": "15th", "sixteenth": "16th", "seventeenth": "17th", "eighteenth": "18th", "nineteenth": "19th"}
ORDINAL_TENS = {"twentieth": "20th", "thirtieth": "30th", "fortieth": "40th", "fiftieth": "50th", "sixtieth": "60th", "seventieth": "70th", "eightieth": "80th", "ninetieth": "90th"}
SCALES = {"hundred": "100", "thousand": "1000", "hundredth": "100th", "thousandth": "1000th"}


def _number_words() -> dict[str, tuple[str, int, str]]:
    """(kind, value, ending of an ordinal) of each English number word."""
    out: dict[str, tuple[str, int, str]] = {}
    for kind, words in (("one", NUMBER_WORDS | ORDINAL_ONES), ("teen", TEENS | ORDINAL_TEENS), ("ten", TENS | ORDINAL_TENS), ("scale", SCALES)):
        for word, shown in words.items():
            digits = str(shown).rstrip("dhnrst")
            out[word] = kind, int(digits), str(shown)[len(digits) :]
    return out


def spoken_numbers(tokens: Column, locale: str = "en") -> Column:
    """Tokens with numbers below a million that are spoken in words as digits: ``eighty
    eight`` is 88, ``fourteen hundred`` 1400, ``two thousand and five`` 2005, ``forty second``
    42nd, and digits one by one (``four zero five``) stay apart.  Only English is known.

    One pass over the tokens that carries the number so far: thousands, the group below
    them, and what kind of word came last.  It copies what it has put out for each token, so
    long texts are cut into runs of number words first, as ``cross_model_tokens`` does."""
    if locale.lower().split("-")[0].split("_")[0] != "en":
        raise S.NormalizerUnavailableError(f"no number words are known for {locale}")
    words = _number_words()
    look = lambda k, w: F.try_element_at(F.create_map(*[F.lit(x) for word, found in words.items() for x in (word, found[k])]), w)
    none, no = F.array().cast("array<string>"), F.lit(False)
    number = lambda x: F.lit(x).cast("long")

    def state(out: Column, live: Column, whole: Column, part: Column, last: Column, also: Column) -> Column:
        return F.struct(out.alias("out"), live.alias("live"), whole.cast("long").alias("whole"), part.cast("long").alias("part"), last.cast("string").alias("last"), also.alias("also"))

    def shown(s: Column) -> Column:
        """What was put out, and the number so far."""
        tail = F.concat(F.array((s["whole"] + s["part"]).cast("string")), F.when(s["also"], F.array(F.lit("and"))).otherwise(none))
        return F.concat(s["out"], F.when(s["live"], tail).otherwise(none))

    def step(s: Column, w: Column) -> Column:
        kind, value, ending = F.coalesce(look(0, w), F.lit("")), F.coalesce(look(1, w), F.lit(0)), F.coalesce(look(2, w), F.lit(""))
        plain, small = ending == "", kind.isin("one", "teen", "ten")
        after_scale = s["live"] & s["last"].isin("hundred", "thousand") & small & (value > 0)
        after_ten = s["live"] & (s["last"] == "ten") & (kind == "one") & (value > 0)
        goes_on = after_scale | after_ten
        counted = s["live"] & ~s["also"] & (kind == "scale")
        hundreds = counted & (value == 100) & s["last"].isin("one", "teen", "ten") & s["part"].between(1, 99)
        times = counted & (value == 1000) & (s["last"] != "thousand") & s["part"].between(1, 999)
        thousands, again = times & (s["whole"] == 0), times & (s["whole"] > 0)  # again: the thousands before were a number of their own
        joined = goes_on | hundreds | thousands
        whole = F.when(times, s["part"] * 1000).when(joined, s["whole"]).otherwise(number(0))
        part = F.when(goes_on, s["part"] + value).when(hundreds, s["part"] * 100).when(times, number(0)).otherwise(value)
        last = F.when(kind != "scale", kind).otherwise(F.when(value == 100, "hundred").otherwise("thousand"))
        before = F.when(joined, s["out"]).when(again, F.concat(s["out"], F.array(s["whole"].cast("string")))).otherwise(shown(s))
        ordinal = F.concat(before, F.array(F.concat((whole + part).cast("string"), ending)))
        waits = s["live"] & (w == "and") & s["last"].isin("hundred", "thousand") & ~s["also"]
        return (
            F.when(waits, state(s["out"], s["live"], s["whole"], s["part"], s["last"], F.lit(True)))
            .when(kind == "", state(F.concat(shown(s), F.array(w)), no, number(0), number(0), F.lit(""), no))
            .when(plain, state(before, F.lit(True), whole, part, last, no))
            .otherwise(state(ordinal, no, number(0), number(0), F.lit(""), no))
        )

    return F.aggregate(tokens, state(none, no, number(0), number(0), F.lit(""), no), step, shown)


def cross_model_tokens(text: Column, locale: str = "en") -> Column:
    """Tokens that compare models of different writing habits: as ``normalize``, numbers in
    words as digits (``spoken_numbers``), letters parted from digits, digit runs into digits."""
    word = "(?:" + "|".join([*_number_words(), "and"]) + ")"
    marked = F.regexp_replace(F.array_join(normalize(text), " "), f"(?<![^ ]){word}(?: {word})*(?![^ ])", "\u0001$0\u0001")
    run = lambda p: F.array_join(spoken_numbers(F.split(p, " "), locale), " ")
    pieces = F.transform(F.split(marked, "\u0001"), lambda p: F.when(p.rlike(f"^{word}( |$)"), run(p)).otherwise(p))
    t = F.array_join(pieces, "")
    t = F.regexp_replace(t, r"(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})|(?<=\p{N})(?=\p{N})", " ")
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " "))


def phrases(tokens: Column, n: int) -> Column:
    """The different runs of ``n`` tokens, joined by blanks; none in a shorter text.  Tokens
    that are costly to compute belong in a column of their own first."""
    starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda k: F.array_join(F.slice(tokens, k, n), " ")))


def claim(words: Column, certain: float = 0.9, fair: float = 0.6) -> Column:
    """The strongest claim that wrong words (array of struct with ``conf``) bear out: one
    of them certain, their average high, some confidence, or none."""
    conf = F.filter(F.transform(words, lambda w: w["conf"]), lambda c: c.isNotNull())
    mean = F.aggregate(conf, F.lit(0.0), lambda s, c: s + c) / F.size(conf)
    return F.when(F.coalesce(F.size(conf), F.lit(0)) == 0, "none").when(F.array_max(conf) >= certain, "exact").when(mean >= fair, "average").otherwise("hedged")
