"""Recordings (WAV) as tables: samples in pieces, and what the gate asks of a clip, measured.

Files come through Spark's binary source, one file a row, so any store works; a file must fit
in a row (2 GB).  Everything after that is cut into pieces of some seconds, and a clip is put
together from sums over frames of 20 ms, so a recording of hours is many small rows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.functions import signal

#: A sample above NEAR is near clipping; frames within SPEECH_DB of the loudest are speech.
NEAR, SPEECH_DB, FRAME_MS = 0.95, 30.0, 20.0
_EXTENSIBLE = 0xFFFE
_SUBTYPE = {(1, 8): "PCM_U8", (1, 16): "PCM_16", (1, 24): "PCM_24", (1, 32): "PCM_32", (3, 32): "FLOAT", (3, 64): "DOUBLE"}
_PIECES = "path string, fs int, channels int, subtype string, n_samples long, at long, samples array<double>, error string"
_FRAMES = "path string, fs int, channels int, subtype string, n_samples long, frame long, n long, power double, peak double, near long"


def decoded(body: bytes) -> tuple[int, str, np.ndarray]:
    """(rate, subtype, samples x channels in -1..1) of a WAV file; ValueError says what is
    wrong.  A last frame cut short is left out."""
    if len(body) < 12 or body[:4] != b"RIFF" or body[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, form, data = 12, None, None
    while at + 8 <= len(body) and data is None:
        name, size = body[at : at + 4], struct.unpack_from("<I", body, at + 4)[0]
        if name == b"fmt " and at + 24 <= len(body):
            tag, channels, fs, _, _, bits = struct.unpack_from("<HHIIHH", body, at + 8)
            if tag == _EXTENSIBLE and size >= 26 and at + 34 <= len(body):
                tag = struct.unpack_from("<H", body, at + 32)[0]
            form = tag, bits
        elif name == b"data":
            data = memoryview(body)[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    if form is None or data is None:
        raise ValueError("no format or no data")
    if form not in _SUBTYPE or not channels or not fs:
        raise ValueError(f"format {form[0]} of {form[1]} bits")
    width = form[1] // 8 * channels
    data = data[: len(data) // width * width]
    if form[0] == 3:
        x = np.frombuffer(data, "<f4" if form[1] == 32 else "<f8").astype(float)
    elif form[1] == 8:
        x = (np.frombuffer(data, np.uint8).astype(float) - 128) / 128
    elif form[1] == 24:
        wide = np.zeros((len(data) // 3, 4), np.uint8)
        wide[:, 1:] = np.frombuffer(data, np.uint8).reshape(-1, 3)
        x = wide.reshape(-1).view("<i4").astype(float) / 2**31
    else:
        x = np.frombuffer(data, f"<i{form[1] // 8}").astype(float) / 2 ** (form[1] - 1)
    return fs, _SUBTYPE[form], x.reshape(-1, channels)


def frame_length(fs: int) -> int:
    return max(1, int(fs * FRAME_MS / 1000))


def read_recordings(spark: SparkSession, path: str, piece_s: float = 10.0) -> DataFrame:
    """(path, fs, channels, subtype, n_samples, at, samples, error): every WAV file below a
    folder in pieces of about ``piece_s`` seconds, channels averaged.  ``at`` counts samples.
    A file without samples has one empty piece; one that can't be read has one row with
    ``error`` and no samples, so that it is missed by nobody (but for files of no bytes at
    all, which Spark's readers leave out)."""

    def pieces(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in _PIECES.split(", ")]
        for part in parts:
            for path, body in zip(part["path"], part["content"], strict=True):
                try:
                    fs, subtype, x = decoded(body)
                except ValueError as e:
                    yield pd.DataFrame([(path, None, None, None, None, None, None, str(e))], columns=names)
                    continue
                n, step = len(x), max(1, round(piece_s * 1000 / FRAME_MS)) * frame_length(fs)
                for at in range(0, max(n, 1), step):
                    yield pd.DataFrame([(path, fs, x.shape[1], subtype, n, at, x[at : at + step].mean(axis=1), None)], columns=names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[wW][aA][vV]").load(path)
    return files.select("path", "content").mapInPandas(pieces, _PIECES)


def clip_stats(pieces: DataFrame) -> DataFrame:
    """One row a readable recording, as ``operators.gate`` takes it: clip_id (the file's name
    without its ending), path, fs, channels, subtype, n_samples, duration_s, peak, n_near_clip,
    lead_s, tail_s, snr_db.  Without a sound lead and tail are 0; without a sound or without a
    pause ``snr_db`` is NULL."""

    def frames(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for r in part.itertuples(index=False):
                x, step = np.asarray(r.samples, float), frame_length(int(r.fs))
                starts = np.arange(0, max(len(x), 1), step)
                padded = np.pad(x, (0, len(starts) * step - len(x))).reshape(-1, step)
                yield pd.DataFrame({
                    "path": r.path, "fs": r.fs, "channels": r.channels, "subtype": r.subtype, "n_samples": r.n_samples, "frame": r.at // step + np.arange(len(starts)),
                    "n": np.clip(len(x) - starts, 0, step), "power": (padded**2).sum(axis=1), "peak": np.abs(padded).max(axis=1), "near": (np.abs(padded) > NEAR).sum(axis=1),
                })

    x = pieces.where("error is null").mapInPandas(frames, _FRAMES)
    step = F.greatest(F.lit(1), F.floor(F.col("fs") * F.lit(FRAME_MS) / 1000))
    level = 10 * F.log10(F.col("power") / step + 1e-12)
    # the loudest frame by file first: a small table, so no file's frames are sorted
    loudest = x.groupBy("path").agg(F.max(level).alias("_top"), F.max("power").alias("_most"))
    x = x.join(loudest, "path").withColumn("_on", (F.col("_most") > 0) & (level >= F.col("_top") - SPEECH_DB))
    on, off = F.col("_on"), ~F.col("_on")
    total = lambda c, w: F.sum(F.when(w, F.col(c)))
    out = x.groupBy("path", "fs", "channels", "subtype", "n_samples").agg(
        F.max("peak").alias("peak"), F.sum("near").alias("n_near_clip"), F.min(F.when(on, F.col("frame") * step)).alias("_first"), F.max(F.when(on, F.least((F.col("frame") + 1) * step, F.col("n_samples")))).alias("_end"),
        F.try_divide(total("power", on), total("n", on)).alias("_speech"), F.try_divide(total("power", off), total("n", off)).alias("_floor"),
    )
    decibel = lambda c: 20 * F.log10(F.sqrt(c) + 1e-12)
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    snr = F.when((F.col("_speech") > 0) & (F.col("_floor") > 0), decibel("_speech") - decibel("_floor"))
    return out.select(
        name.alias("clip_id"), "path", "fs", "channels", "subtype", "n_samples", (F.col("n_samples") / F.col("fs")).alias("duration_s"), "peak", "n_near_clip",
        F.coalesce(F.col("_first") / F.col("fs"), F.lit(0.0)).alias("lead_s"), F.coalesce((F.col("n_samples") - F.col("_end")) / F.col("fs"), F.lit(0.0)).alias("tail_s"), snr.alias("snr_db"),
    )


def room_responses(spark: SparkSession, path: str) -> DataFrame:
    """(path, fs, rt60) of measured impulse responses, at their own rate; NULL where none can
    be estimated or the file can't be read."""

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, body in zip(part["path"], part["content"], strict=True):
                try:
                    fs, _, x = decoded(body)
                    got = (path, fs, signal.rt60(x.mean(axis=1), fs) if len(x) else None)
                except ValueError:
                    got = (path, None, None)
                yield pd.DataFrame([got], columns=["path", "fs", "rt60"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[wW][aA][vV]").load(path)
    return files.select("path", "content").mapInPandas(work, "path string, fs int, rt60 double")
