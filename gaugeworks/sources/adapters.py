"""Recognizers' answers to one contract: transcript, word_confidences, mean_conf and
utterance_conf, as JSON functions in the JVM.  What a recognizer doesn't tell stays NULL."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions.numeric import probability_of_logprob

CONTRACT = "transcript string, word_confidences array<double>, mean_conf double, utterance_conf double"


def _mean(values: Column) -> Column:
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values))


def _known(values: Column) -> Column:
    return F.coalesce(F.filter(values, lambda x: x.isNotNull()), F.array().cast("array<double>"))


def _contract(text: Column, words: Column, utterance: Column | None = None, fallback: bool = False) -> Column:
    mean = _mean(words)
    if utterance is None:
        utterance = mean
    return F.struct(text.alias("transcript"), words.alias("word_confidences"), (F.coalesce(mean, utterance) if fallback else mean).alias("mean_conf"), utterance.alias("utterance_conf"))


def channel_alternatives(wire: Column) -> Column:
    """results.channels[0].alternatives[0] with words of a confidence each."""
    ddl = "struct<results:struct<channels:array<struct<alternatives:array<struct<transcript:string,confidence:double,words:array<struct<word:string,confidence:double>>>>>>>>"
    best = F.from_json(wire, ddl)["results"]["channels"][0]["alternatives"][0]
    words = _known(F.transform(best["words"], lambda w: w["confidence"]))
    return _contract(F.coalesce(best["transcript"], F.lit("")), words, best["confidence"])


def decoder_segments(wire: Column) -> Column:
    """text and segments; words may lack probabilities, then the segments' mean
    exp(avg_logprob) stands for the mean and no word value is made up."""
    ddl = "struct<text:string,segments:array<struct<avg_logprob:double,words:array<struct<word:string,probability:double>>>>>"
    x = F.from_json(wire, ddl)
    words = _known(F.flatten(F.transform(F.coalesce(x["segments"], F.array()), lambda s: F.transform(F.coalesce(s["words"], F.array()), lambda w: w["probability"]))))
    segments = _known(F.transform(x["segments"], lambda s: F.exp(s["avg_logprob"])))
    return _contract(F.trim(F.coalesce(x["text"], F.lit(""))), words, _mean(segments), fallback=True)


def word_results(wire: Column) -> Column:
    """text and result, a list of words with ``conf``."""
    x = F.from_json(wire, "struct<text:string,result:array<struct<word:string,conf:double>>>")
    return _contract(F.coalesce(x["text"], F.lit("")), _known(F.transform(x["result"], lambda w: w["conf"])))


def typed_tokens(wire: Column) -> Column:
    """text and words of a type and a log probability: only type 'word' counts, an
    unknown type raises, and so does a positive log probability."""
    x = F.from_json(wire, "struct<text:string,words:array<struct<text:string,type:string,logprob:double>>>")
    entries = F.coalesce(x["words"], F.array())
    odd = F.filter(entries, lambda w: ~F.coalesce(w["type"].isin("word", "spacing", "audio_event"), F.lit(False)))
    words = F.when(F.size(odd) > 0, F.raise_error(F.lit("a token of unknown type")).cast("array<double>")).otherwise(
        _known(F.transform(F.filter(entries, lambda w: w["type"] == "word"), lambda w: F.when(w["logprob"].isNotNull(), probability_of_logprob(w["logprob"])))))
    return _contract(F.coalesce(x["text"], F.lit("")), words)


#: Models by the form of their answers; further ones are added by name.
REGISTRY: dict[str, Callable[[Column], Column]] = {"channel_alternatives": channel_alternatives, "decoder_segments": decoder_segments, "word_results": word_results, "typed_tokens": typed_tokens}


def parse(answers: DataFrame, form: str, wire_col: str = "wire") -> DataFrame:
    """Answers (any columns and the wire text) with the contract's columns."""
    if form not in REGISTRY:
        raise KeyError(f"{form} isn't one of {', '.join(sorted(REGISTRY))}")
    return answers.withColumn("_a", REGISTRY[form](F.col(wire_col))).select(*answers.columns, "_a.*")


def transcribe(calls: DataFrame, recognize: Callable[[str], str], key: str = "path", attempts: int = 3) -> DataFrame:
    """Call ``recognize`` (path -> wire text) for each row on the workers.  An error is
    tried again, then becomes a row with ``failed`` and its text; it never fails a task."""

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for path in part[key]:
                wire, error = None, None
                for _ in range(attempts):
                    try:
                        wire, error = recognize(path), None
                        break
                    except Exception as e:  # noqa: BLE001 - any failure is a result here
                        error = f"{type(e).__name__}: {e}"
                out.append((path, wire, error, wire is None))
            yield pd.DataFrame(out, columns=[key, "wire", "error", "failed"])

    return calls.select(key).mapInPandas(work, f"{key} string, wire string, error string, failed boolean")
