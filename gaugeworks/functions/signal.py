"""Signal operators on array columns.

What a row needs is an expression in the JVM (levels, zero crossings, energy ratios); what
needs spectra goes through Arrow batches, where all frames of a clip are one matrix and
sums over frames are differences of running sums.  The numpy functions serve both the
column functions and tests.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TINY = 1e-12
FEATURES = ("rms", "zcr", "centroid", "bandwidth", "flatness", "rolloff", "f0", "voiced")
#: Corner of the microphone's low pass, as a share of half the sampling rate
#: without any rolloff and in Hz with all of it, and the bounds of any corner.
WIDEST_CORNER, NARROWEST_CORNER_HZ, CORNER_BOUNDS = 0.95, 1500.0, (50.0, 0.99)
#: Span of the decay that a reverberation time is read from, in dB.
DECAY_SPAN = (-5.0, -25.0)
#: Span of pitch in Hz, and how much of its energy a voiced frame repeats.
PITCH_SPAN, PERIODIC = (80.0, 400.0), 0.3


class CodecUnavailableError(RuntimeError):
    """A codec needs an external program, and is never imitated."""


def _running(values: np.ndarray) -> np.ndarray:
    """Sums of the first 0, 1, ... values."""
    return np.append(0.0, np.cumsum(values, dtype=float))


def _level(power: np.ndarray | float) -> np.ndarray | float:
    return 10 * np.log10(np.asarray(power) + _TINY)


def speech_mask(x: np.ndarray, fs: int, frame_ms: float = 20.0, within_db: float = 30.0) -> np.ndarray:
    """Samples in frames whose energy is within ``within_db`` of the loudest frame's; the
    last frame counts as if silence filled it."""
    width = max(1, int(fs * frame_ms / 1000))
    total, frame = _running(np.square(x)), np.arange(len(x)) // width
    edges = np.minimum(np.arange(0, len(x) + width, width), len(x))
    power = np.diff(total[edges])[: frame[-1] + 1 if len(frame) else 0] / width
    if not power.any():
        return np.zeros(len(x), bool)
    return (_level(power) >= _level(power.max()) - within_db)[frame]


def active_power(x: np.ndarray, mask: np.ndarray) -> float:
    """Mean square over the mask, over everything where it is empty."""
    weight = mask.astype(float) if mask.any() else np.ones(len(x))
    return float(np.square(x) @ weight / max(weight.sum(), 1))


def mix_at_snr(speech: np.ndarray, noise: np.ndarray, snr_db: float, fs: int, seed: int = 0) -> np.ndarray:
    """Speech with noise at a ratio measured over active speech; noise is repeated where it
    is too short and read from a seeded place."""
    speech, noise = np.asarray(speech, float), np.asarray(noise, float)
    spare = max(len(noise) * -(-len(speech) // max(1, len(noise))) - len(speech), 0)
    place = int(np.random.default_rng(seed).integers(spare + 1)) if len(noise) >= len(speech) else 0
    noise = np.take(noise, np.arange(place, place + len(speech)), mode="wrap")
    have = active_power(noise, np.zeros(len(noise), bool))
    if not have:
        return speech.copy()
    return speech + noise * (active_power(speech, speech_mask(speech, fs)) / have) ** 0.5 * 10 ** (-snr_db / 20)


def measured_snr_db(speech: np.ndarray, noise: np.ndarray, fs: int) -> float:
    return float(_level(active_power(speech, speech_mask(speech, fs))) - _level(active_power(noise, np.zeros(len(noise), bool))))


def _filtered(x: np.ndarray, response: Callable[[np.ndarray, int], np.ndarray], spare: int) -> np.ndarray:
    """x through a spectrum's response, with ``spare`` mirrored samples at both ends."""
    spare = min(spare, max(len(x) - 1, 0))
    wide = np.pad(x, spare, mode="reflect", reflect_type="odd") if spare else x
    return np.fft.irfft(np.fft.rfft(wide) * response(np.arange(len(wide) // 2 + 1), len(wide)), len(wide))[spare : spare + len(x)]


def apply_rir(x: np.ndarray, rir: np.ndarray, fs: int, keep_level: bool = True) -> np.ndarray:
    """Convolution from the direct path on, same length, level matched over active speech."""
    x, rir = np.asarray(x, float), np.asarray(rir, float)
    tail = rir[np.abs(rir).argmax() :]
    room = 1 << (len(x) + len(tail)).bit_length()
    wet = np.fft.irfft(np.fft.rfft(x, room) * np.fft.rfft(tail, room), room)[: len(x)]
    mask = speech_mask(x, fs)
    have = active_power(wet, mask)
    return wet * (active_power(x, mask) / have) ** 0.5 if keep_level and have else wet


def corner_hz(fs: int, amount: float) -> float:
    """The low pass's corner: from WIDEST_CORNER of half the sampling rate in a straight
    line to NARROWEST_CORNER_HZ."""
    half = fs / 2
    corner = np.interp(amount, [0, 1], [WIDEST_CORNER * half, NARROWEST_CORNER_HZ])
    return float(np.clip(corner, CORNER_BOUNDS[0], CORNER_BOUNDS[1] * half))


def mic_rolloff(x: np.ndarray, fs: int, amount: float) -> np.ndarray:
    """A Butterworth low pass of fourth order run forth and back, so without delay: the
    square of its digital response, applied to the spectrum."""
    x = np.asarray(x, float)
    if amount <= 0 or not len(x):
        return x
    edge = np.tan(np.pi * corner_hz(fs, amount) / fs)
    return _filtered(x, lambda k, n: 1 / (1 + (np.tan(np.minimum(np.pi * k / n, 1.5707)) / edge) ** 8), 256)


def degrade(x: np.ndarray, fs: int, *, rir=None, noise=None, snr_db: float | None = None, rolloff: float = 0.0, codec: str = "none", seed: int = 0) -> np.ndarray:
    """Room, noise, microphone, in this fixed order; any codec but 'none' raises.  The
    length stays."""
    if codec != "none":
        raise CodecUnavailableError(f"{codec} needs an external program")
    if rir is not None:
        x = apply_rir(x, rir, fs)
    if noise is not None and snr_db is not None:
        x = mix_at_snr(x, noise, snr_db, fs, seed)
    return mic_rolloff(x, fs, rolloff)


def peak_guard(x: np.ndarray, most: float = 0.99) -> np.ndarray:
    """Scaled down where samples would clip in 16 bits."""
    return x / max(1.0, float(np.abs(x).max(initial=0)) / most)


def rt60(h: np.ndarray, fs: int) -> float | None:
    """Reverberation time: the energy still to come after each sample falls by DECAY_SPAN's
    decibels along a line fitted by least squares; None without such a fall."""
    energy = np.square(np.asarray(h, float))
    energy = energy[energy.argmax() :]
    left = energy.sum() - _running(energy)[:-1]
    decay = 10 * np.log10(np.maximum(left, 0) / (left[0] + 1e-20) + 1e-20)
    inside = slice(*(len(decay) - np.searchsorted(decay[::-1], level, "right") for level in DECAY_SPAN))
    y = decay[inside]
    t = np.arange(len(y)) - (len(y) - 1) / 2
    fall = float(t @ y) if len(y) > 1 else 0.0
    return -60 * float(t @ t) / fall / fs if fall < 0 else None


def frame_features(x: np.ndarray, fs: int, frame_ms: float = 25.0, hop_ms: float = 10.0, share: float = 0.85) -> dict[str, np.ndarray]:
    """Features of overlapping frames, as parallel arrays.

    Level and crossings are differences of running sums, centroid and bandwidth the
    moments of one product of the magnitudes with powers of the frequency, and pitch the
    best lag of all frames' autocorrelations at once, by the transform of their power.
    """
    x = np.asarray(x, float)
    width, hop = max(8, int(fs * frame_ms / 1000)), max(1, int(fs * hop_ms / 1000))
    x = np.append(x, np.zeros(max(0, width - len(x))))
    begin = np.arange(0, len(x) - width + 1, hop)
    squares, flips = _running(x * x), _running(np.sign(x[1:]) != np.sign(x[:-1]))
    frames = x[begin[:, None] + np.arange(width)]
    size = np.abs(np.fft.rfft(frames * np.hanning(width)))
    hz = np.arange(size.shape[1]) * fs / width
    mass, first, second = (size @ np.stack([np.ones_like(hz), hz, hz * hz], axis=1)).T
    mass = mass + _TINY
    centre, power = first / mass, size * size
    spread = second / mass - 2 * centre * first / mass + centre * centre * (mass - _TINY) / mass
    reached = np.cumsum(size, axis=1) < share * size.sum(axis=1, keepdims=True)
    pitch = pitches(frames, fs)
    return {
        "rms": np.sqrt((squares[begin + width] - squares[begin]).clip(0) / width + _TINY), "zcr": (flips[begin + width - 1] - flips[begin]) / (width - 1), "centroid": centre,
        "bandwidth": np.sqrt(spread.clip(0)), "flatness": np.exp(np.log(power + _TINY).mean(axis=1)) / (power.mean(axis=1) + _TINY),
        "rolloff": hz[np.minimum(reached.sum(axis=1), len(hz) - 1)], "f0": pitch, "voiced": pitch > 0,
    }


def pitches(frames: np.ndarray, fs: int) -> np.ndarray:
    """The pitch of each frame, 0 where too little of its energy repeats."""
    width = frames.shape[1]
    spectrum = np.fft.rfft(frames - frames.mean(axis=1, keepdims=True), 2 * width)
    repeats = np.fft.irfft(spectrum.real**2 + spectrum.imag**2)[:, :width]
    lags = np.arange(int(fs / PITCH_SPAN[1]), min(int(fs / PITCH_SPAN[0]), width))
    if not len(lags):
        return np.zeros(len(frames))
    strength = repeats[:, lags]
    voiced = (strength.max(axis=1) >= PERIODIC * repeats[:, 0]) & (repeats[:, 0] > _TINY)
    return np.where(voiced, fs / np.maximum(lags[strength.argmax(axis=1)], 1), 0.0)


# ------------------------------------------------------------------- array columns


def _each(f: Callable[..., object], kind: str) -> Callable[..., Column]:
    """A function of arrays and numbers of one row as a column function; rows with a NULL
    or empty array give NULL."""

    @F.pandas_udf(kind)
    def run(*columns: pd.Series) -> pd.Series:
        rows = zip(*columns, strict=True)
        return pd.Series([None if any(v is None or np.ndim(v) == 0 and pd.isna(v) or np.ndim(v) and not len(v) for v in row) else f(*row) for row in rows])

    return run


def degraded(samples: Column, noise: Column, snr_db: Column, rolloff: Column, fs: int) -> Column:
    """Samples with noise at a ratio and through a microphone, row by row."""
    return _each(lambda x, n, s, r: peak_guard(degrade(x, fs, noise=n, snr_db=float(s), rolloff=float(r))), "array<double>")(samples, noise, snr_db, rolloff)


def reverberated(samples: Column, rir: Column, fs: int) -> Column:
    return _each(lambda x, h: apply_rir(x, h, fs), "array<double>")(samples, rir)


def rolled_off(samples: Column, amount: Column, fs: int) -> Column:
    return _each(lambda x, a: mic_rolloff(x, fs, float(a)), "array<double>")(samples, amount)


def rt60_of(rir: Column, fs: int) -> Column:
    return _each(lambda h: rt60(h, fs), "double")(rir)


def active_share(samples: Column, fs: int) -> Column:
    """How much of a clip is active speech."""
    return _each(lambda x: float(speech_mask(x, fs).mean()), "double")(samples)


def rms(samples: Column) -> Column:
    """Root mean square of a short array, without leaving the JVM."""
    return F.sqrt(F.aggregate(samples, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")) / F.size(samples))


def zero_crossings(samples: Column) -> Column:
    """Share of steps between samples that change sign."""
    s = F.transform(samples, lambda x: F.signum(x.cast("double")))
    flips = F.filter(F.zip_with(F.slice(s, 1, F.size(s) - 1), F.slice(s, 2, F.size(s) - 1), lambda a, b: a != b), lambda x: x)
    return F.size(flips) / (F.size(s) - 1)


def energy_ratio_db(rir: Column, fs: int, ms: float) -> Column:
    """Early to late energy around a moment after the direct path (the largest sample, the
    first of equal ones): 2.5 ms for the direct to reverberant ratio, 50 ms for clarity.
    Inside the JVM; NULL for NULL and empty arrays."""
    energy = F.transform(rir, lambda x: x.cast("double") * x.cast("double"))
    cut = F.array_position(energy, F.array_max(energy)).cast("int") + int(fs * ms / 1000)
    begin = F.array_position(energy, F.array_max(energy)).cast("int")
    total = lambda part: F.aggregate(part, F.lit(0.0), lambda s, x: s + x) + 1e-20
    early, late = F.slice(energy, begin, cut - begin), F.slice(energy, cut, F.greatest(F.size(energy) - cut + 1, F.lit(0)))
    return F.when(F.size(rir) > 0, 10 * F.log10(total(early) / total(late)))


def frames_of(clips: DataFrame, key: str, samples: str, fs: int) -> DataFrame:
    """One row for each frame of each clip: key, frame and the features."""

    def work(parts):
        for part in parts:
            out = []
            for k, x in zip(part[key], part[samples], strict=True):
                f = pd.DataFrame(frame_features(x, fs))
                f.insert(0, "frame", range(len(f)))
                f.insert(0, key, k)
                out.append(f)
            if out:
                yield pd.concat(out)

    kind = clips.schema[key].dataType.simpleString()
    return clips.where(F.col(samples).isNotNull() & (F.size(samples) > 0)).select(key, samples).mapInPandas(work, f"{key} {kind}, frame int, " + ", ".join(f"{f} double" for f in FEATURES[:-1]) + ", voiced boolean")


def summaries(frames: DataFrame, key: str) -> DataFrame:
    """Means of the features by clip; pitch over voiced frames only."""
    return frames.groupBy(key).agg(*[F.avg(f).alias(f) for f in FEATURES[:-2]], F.coalesce(F.avg(F.when(F.col("voiced"), F.col("f0"))), F.lit(0.0)).alias("f0"), F.avg(F.col("voiced").cast("int")).alias("voiced_frac"))
