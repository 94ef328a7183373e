import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.functions import signal

FS = 8000


def burst(seconds=1.0, pad=0.5, hz=200):
    t = np.arange(int(FS * seconds)) / FS
    return np.concatenate([np.zeros(int(FS * pad)), np.sin(2 * np.pi * hz * t), np.zeros(int(FS * pad))])


def test_mixing_reaches_the_ratio_over_active_speech():
    x, noise = burst(), np.random.default_rng(0).normal(size=3000)
    for snr in (0.0, 10.0, 20.0):
        mixed = signal.mix_at_snr(x, noise, snr, FS)
        assert len(mixed) == len(x) and signal.measured_snr_db(x, mixed - x, FS) == pytest.approx(snr, abs=0.2)
    assert signal.speech_mask(x, FS).mean() == pytest.approx(0.5, abs=0.05) and not signal.speech_mask(np.zeros(100), FS).any()


def test_room_response_keeps_time_and_level():
    x, h = burst(), np.zeros(400)
    h[50] = 1.0
    assert np.allclose(signal.apply_rir(x, h, FS), x, atol=1e-9)
    decay = np.exp(-6.9078 * np.arange(FS) / FS / 0.5) * np.random.default_rng(1).normal(size=FS)
    decay[0] = 3.0
    assert signal.rt60(decay, FS) == pytest.approx(0.5, rel=0.15) and signal.rt60(np.array([1.0]), FS) is None


def test_array_columns_equal_the_functions(spark):
    rng = np.random.default_rng(4)
    rirs = [rng.normal(size=900) * np.exp(-np.arange(900) / t) for t in (60, 150)] + [np.array([1.0])]
    x, noise = burst(0.2, 0.1), rng.normal(size=300)
    df = spark.createDataFrame([(k, h.tolist(), x.tolist(), noise.tolist()) for k, h in enumerate(rirs)] + [(9, None, None, None), (8, [], [], [])], "k int, h array<double>, x array<double>, n array<double>")
    ten, half = F.lit(10.0), F.lit(0.5)
    got = {r.k: r for r in df.select("k", signal.rt60_of(F.col("h"), FS).alias("t"), signal.energy_ratio_db(F.col("h"), FS, 2.5).alias("drr"), signal.energy_ratio_db(F.col("h"), FS, 50).alias("c50"),
        signal.reverberated(F.col("x"), F.col("h"), FS).alias("wet"), signal.degraded(F.col("x"), F.col("n"), ten, half, FS).alias("bad"), signal.rolled_off(F.col("x"), half, FS).alias("mic"), signal.active_share(F.col("x"), FS).alias("a")).collect()}
    for k, h in enumerate(rirs):
        at = int(np.abs(h).argmax())
        for ms, value in ((2.5, got[k].drr), (50, got[k].c50)):
            cut = at + int(FS * ms / 1000)
            assert value == pytest.approx(10 * np.log10((np.square(h[at:cut]).sum() + 1e-20) / (np.square(h[cut:]).sum() + 1e-20)))
        assert got[k].t == pytest.approx(signal.rt60(h, FS)) and np.allclose(got[k].wet, signal.apply_rir(x, h, FS))
        assert np.allclose(got[k].bad, signal.peak_guard(signal.degrade(x, FS, noise=noise, snr_db=10.0, rolloff=0.5))) and np.allclose(got[k].mic, signal.mic_rolloff(x, FS, 0.5))
        assert got[k].a == pytest.approx(signal.speech_mask(x, FS).mean())
    assert all(v is None for k in (8, 9) for v in tuple(got[k])[1:])


def test_rolloff_has_the_stated_corner():
    assert signal.corner_hz(16000, 0.0) == 7600 and signal.corner_hz(16000, 1.0) == 1500 and signal.corner_hz(16000, 0.5) == 4550
    t = np.arange(16000) / 16000
    for hz, low, high in ((300, 0.99, 1.01), (1500, 0.48, 0.52), (6000, 0.0, 0.01)):  # run forth and back, the corner halves
        gain = np.abs(signal.mic_rolloff(np.sin(2 * np.pi * hz * t), 16000, 1.0))[4000:12000].max()
        assert low <= gain <= high
    with pytest.raises(signal.CodecUnavailableError):
        signal.degrade(t, 16000, codec="g726")


def brute_features(x, size, hop):
    """Frames one by one, sums term by term."""
    out = []
    for at in range(0, len(x) - size + 1, hop):
        f = x[at : at + size]
        m = [abs(sum(v * w * np.exp(-2j * np.pi * k * n / size) for n, (v, w) in enumerate(zip(f, np.hanning(size), strict=True)))) for k in range(size // 2 + 1)]
        hz, total = [k * FS / size for k in range(len(m))], sum(m) + 1e-12
        c = sum(a * b for a, b in zip(m, hz, strict=True)) / total
        lags = {k: sum((f[n] - f.mean()) * (f[n + k] - f.mean()) for n in range(size - k)) for k in range(size)}
        k = max(range(FS // 400, min(FS // 80, size)), key=lambda k: (lags[k], -k))
        run, roll = 0.0, None
        for a, b in zip(m, hz, strict=True):
            run += a
            roll = b if roll is None and run >= 0.85 * sum(m) - 1e-12 else roll
        out.append((np.sqrt(np.mean(f * f)), np.mean(np.sign(f[1:]) != np.sign(f[:-1])), c, np.sqrt(sum(a * (b - c) ** 2 for a, b in zip(m, hz, strict=True)) / total), roll, FS / k if lags[k] >= 0.3 * lags[0] else 0.0))
    return np.array(out)


def test_features_equal_brute_force():
    rng = np.random.default_rng(7)
    x = np.concatenate([np.sin(np.arange(260) * 2 * np.pi * 130 / FS), rng.normal(size=200)])
    got = signal.frame_features(x, FS)
    want = brute_features(x, 200, 80)
    assert np.allclose(np.stack([got[k] for k in ("rms", "zcr", "centroid", "bandwidth", "rolloff", "f0")], axis=1), want, rtol=1e-6, atol=1e-6)


def test_degradation_keeps_the_length_and_rolloff_takes_highs():
    x = burst(hz=3500)
    y = signal.degrade(x, 16000, noise=np.ones(100), snr_db=10.0, rolloff=1.0)
    assert len(y) == len(x) and np.square(signal.mic_rolloff(x, 16000, 1.0)).sum() < 0.5 * np.square(x).sum()
    assert np.abs(signal.peak_guard(np.array([2.0, -4.0]))).max() == pytest.approx(0.99)


def test_frames_find_pitch_and_silence(spark):
    x = burst()
    f = signal.frame_features(x, FS)
    assert np.median(f["f0"][f["voiced"]]) == pytest.approx(200, rel=0.03) and 0.3 < f["voiced"].mean() < 0.7
    df = spark.createDataFrame([("a", x.tolist()), ("b", None), ("c", [])], "k string, x array<double>")
    frames = signal.frames_of(df, "k", "x", FS)
    assert frames.count() == len(f["rms"]) and signal.summaries(frames, "k").first().rms == pytest.approx(f["rms"].mean())
    r = df.where("k = 'a'").select(signal.rms(F.col("x")).alias("r"), signal.zero_crossings(F.col("x")).alias("z")).first()
    assert r.r == pytest.approx(np.sqrt(np.square(x).mean())) and 0 < r.z < 0.1
