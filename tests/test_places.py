import json
import os
import random
import struct

import numpy as np
import pytest

from gaugeworks.functions import signal
from gaugeworks.operators import gate
from gaugeworks.sources import logs, recordings

DDL = "clip_id string, condition_name string, model string, wer double, words array<double>"


def line(clip, wer, **more):
    return json.dumps({"clip_id": clip, "condition_name": "c", "model": "m", "wer": wer, **more})


def test_the_last_line_wins_in_a_file_read_in_parts(spark, tmp_path):
    rng, want, lines = random.Random(3), {}, []
    for k in range(4000):
        clip = f"u{rng.randrange(300)}" if k % 3 else "hot"  # a third of all lines are one cell
        lines.append(line(clip, float(k), words=[k / 2] * rng.randrange(9)))
        want[clip] = float(k)
    lines[100:100] = ["", "   ", '{"clip_id": "u1", "wer": 0.', "nonsense", '{"clip_id": null, "condition_name": "c", "model": "m", "wer": 1}', "[1]"]
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.jsonl").write_text("\n".join(lines) + '\n{"clip_id": "hot", "condi')
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        rows, census = logs.read_ordered_log(spark, str(tmp_path / "log"), DDL)
        assert logs.placed_lines(spark, str(tmp_path / "log")).select("part_start").distinct().count() > 5
        assert {r.clip_id: r.wer for r in rows.collect()} == want
        assert tuple(census.first()) == (4005, 4000, 5, 4000 - len(want))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_files_go_by_time_then_name(spark, tmp_path):
    for name, wer, at in (("z", 1.0, 100), ("a", 2.0, 200), ("b", 3.0, 200)):
        (tmp_path / name).write_text(line("x", wer) + "\n")
        os.utime(tmp_path / name, (1_700_000_000 + at,) * 2)
    rows, census = logs.read_ordered_log(spark, str(tmp_path), DDL)
    assert [r.wer for r in rows.collect()] == [3.0] and tuple(census.first()) == (3, 3, 0, 2)
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "f").write_text("\n")
    rows, census = logs.read_ordered_log(spark, str(tmp_path / "empty"), DDL)
    assert rows.count() == 0 and tuple(census.first()) == (0, 0, 0, 0) and rows.columns == ["clip_id", "condition_name", "model", "wer", "words"]


def wav(x, fs, bits=16, tag=1, odd=b""):
    x = np.asarray(x, float)
    x = x[:, None] if x.ndim == 1 else x
    if tag == 3:
        body = x.astype("<f4" if bits == 32 else "<f8").tobytes()
    elif bits == 8:
        body = np.clip(np.round(x * 128 + 128), 0, 255).astype(np.uint8).tobytes()
    else:
        v = np.clip(np.round(x * 2 ** (bits - 1)), -(2 ** (bits - 1)), 2 ** (bits - 1) - 1).astype("<i4")
        body = v.reshape(-1).view(np.uint8).reshape(-1, 4)[:, : bits // 8].tobytes()
    width = bits // 8 * x.shape[1]
    form = struct.pack("<HHIIHH", tag, x.shape[1], fs, fs * width, width, bits)
    parts = b"".join(n + struct.pack("<I", len(b)) + b + b"\0" * (len(b) % 2) for n, b in ((b"LIST", b"abc"), (b"fmt ", form), (b"data", body + odd)))
    return b"RIFF" + struct.pack("<I", 4 + len(parts)) + b"WAVE" + parts


def measured(x, fs):
    """The same by whole arrays."""
    mask = signal.speech_mask(x, fs)
    at, power = np.flatnonzero(mask), lambda m: np.sqrt(np.mean(x[m] ** 2)) if m.any() else 0.0
    a, f = power(mask), power(~mask)
    snr = 20 * np.log10(a + 1e-12) - 20 * np.log10(f + 1e-12) if a > 0 and f > 0 else None
    return (at[0] / fs, (len(x) - 1 - at[-1]) / fs, snr) if len(at) else (0.0, 0.0, None)


def test_clips_measured_in_pieces_equal_whole_ones(spark, tmp_path):
    rng, clips = np.random.default_rng(1), {}
    for name, fs, bits, tag, channels, s in (("a", 16000, 16, 1, 1, 3.3), ("b", 8000, 24, 1, 2, 1.234), ("c", 48000, 32, 3, 1, 2.0), ("d", 22050, 32, 1, 3, 1.7), ("e", 8000, 8, 1, 1, 2.0), ("f", 11025, 64, 3, 1, 1.0)):
        n = int(fs * s)
        x = rng.normal(0, 0.002, (n, channels))
        x[n // 5 : n * 3 // 5] += 0.5 * np.sin(np.arange(n * 3 // 5 - n // 5) / 9)[:, None]
        if name == "a":
            x[n // 3 : n // 3 + 12] = 0.99
        clips[name] = (fs, bits, tag, channels, x)
    clips |= {"still": (16000, 16, 1, 1, np.zeros((16000, 1))), "none": (16000, 16, 1, 1, np.zeros((0, 1)))}
    (tmp_path / "deep").mkdir()
    for name, (fs, bits, tag, _, x) in clips.items():
        (tmp_path / ("deep" if name == "c" else ".") / f"{name}.{'WAV' if name == 'b' else 'wav'}").write_bytes(wav(x, fs, bits, tag, b"\1" if bits == 24 else b""))
    (tmp_path / "bad.wav").write_bytes(b"RIFF")
    (tmp_path / "law.wav").write_bytes(wav(np.zeros(9), 8000, 8, tag=7))
    (tmp_path / "notes.txt").write_text("no recording")
    pieces = recordings.read_recordings(spark, str(tmp_path), piece_s=0.5)
    errors = {r.path.rsplit("/")[-1]: r.error for r in pieces.where("error is not null").collect()}
    assert errors == {"bad.wav": "not a WAV file", "law.wav": "format 7 of 8 bits"} and pieces.where("size(samples) > 24000").count() == 0
    got = {r.clip_id: r for r in recordings.clip_stats(pieces).collect()}
    assert got.keys() == clips.keys()
    for name, (fs, bits, tag, channels, _) in clips.items():
        file = next(p for p in tmp_path.rglob("*.[wW][aA][vV]") if p.stem == name)
        x, r = recordings.decoded(file.read_bytes())[2].mean(axis=1), got[name]
        assert (r.fs, r.channels, r.n_samples, r.n_near_clip) == (fs, channels, len(x), int((np.abs(x) > 0.95).sum()))
        if len(x):
            assert np.abs(x - clips[name][4].mean(axis=1)).max() < (0.01 if bits == 8 else 1e-4)
            assert r.peak == pytest.approx(np.abs(x).max()) and (r.lead_s, r.tail_s) == pytest.approx(measured(x, fs)[:2])
            assert r.snr_db == (None if measured(x, fs)[2] is None else pytest.approx(measured(x, fs)[2], abs=1e-6))
    assert got["none"].peak == 0.0 and got["none"].snr_db is None and got["b"].subtype == "PCM_24" and got["c"].subtype == "FLOAT"
    faults = {r.clip_id: r.errors for r in gate.clip_faults(recordings.clip_stats(pieces)).collect()}
    assert faults["a"] == ["near_clipping"]
    assert "channels" in faults["b"] and "duration" in faults["none"]


def test_rooms_from_their_responses(spark, tmp_path):
    fs = 16000
    t = np.arange(fs) / fs
    h = np.random.default_rng(2).normal(0, 1, fs) * 10 ** (-3 * t / 0.5)
    (tmp_path / "r.wav").write_bytes(wav(0.9 * h / np.abs(h).max(), fs, 32, 3))
    (tmp_path / "x.wav").write_bytes(b"RIFF")
    got = {r.path.rsplit("/")[-1]: r.rt60 for r in recordings.room_responses(spark, str(tmp_path)).collect()}
    assert got["r.wav"] == pytest.approx(0.5, abs=0.05) and got["x.wav"] is None
