"""Kernels from samples to numbers: levels, spectra, onsets, tempo, chroma, key.

Levels and correlations of short arrays are column functions. The few helpers that
need a transform take one piece of a recording, of bounded length; ``recordings``
cuts the pieces and puts the numbers together.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Frame sizes, tempo search, key profiles (tonic first), chroma range, edges and bandwidth.
RATE, FRAME, HOP, CHROMA_FRAME, ONSET_FRAME = 16_000, 2_048, 1_024, 4_096, 1_024
MIN_BPM, MAX_BPM, BPM_STEP, PRIOR_BPM, PRIOR_OCTAVES, SUB_WEIGHT = 40, 220, 0.25, 120, 0.9, 0.7
HARMONICS = (1, 0.5, 0.33, 0.25)
PEAK_FLOOR, PEAK_CEILING = 3, 15
MAJOR = (6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88)
MINOR = (6.33, 2.68, 3.52, 5.38, 2.6, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17)
CHROMA_LOW, CHROMA_HIGH = 80, 5_000
EDGE_SEC, EDGE_DB, EDGE_RUN = 0.05, -40, 4
GRID_BPM, PHASES, LEAST_GRID, LEAST_TEMPO, LEAD_FRAMES, BUSY, LEVEL_SEC, END_SEC = (50, 210), 32, 0.4, 0.3, 0.78, 4, 0.25, 20
WINDOW_SEC, WINDOW_AT, SHORT_SEC, LEAST_SEC, TEMPO_SEC, TEMPO_AT = 10, (0.15, 0.5, 0.8), 35, 3, 30, 0.25
SEGMENTS, SEGMENT_FRAMES = 3, 20
CLIP_LEVEL, CLIP_RUN = 0.98, 3
BAND_HZ, CUTOFF_FRAME, CUTOFF_FRAMES, CUTOFF_DB, CUTOFF_SEC, CUTOFF_HZ = 500, 8_192, 64, -55, 30, 24_000


# --- column functions over arrays ---


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def doubles(samples: Column) -> Column:
    return F.transform(samples, lambda v: v.cast("double"))


def rms(samples: Column) -> Column:
    return F.sqrt(F.try_divide(_total(F.transform(samples, lambda v: v * v)), F.size(samples)))


def peak(samples: Column) -> Column:
    return F.array_max(F.transform(samples, F.abs))


def crest(samples: Column) -> Column:
    """Peak over level; 0 for silence."""
    level = rms(samples)
    return F.when(level > 0, peak(samples) / level).otherwise(0.0)


def zero_crossings(samples: Column) -> Column:
    """The part of neighbours with different signs; 0 counts as positive."""
    n = F.size(samples)
    pairs = F.zip_with(F.slice(samples, 1, n - 1), F.slice(samples, F.lit(2), n - 1), lambda a, b: F.when((a >= 0) != (b >= 0), 1.0).otherwise(0.0))
    return F.when(n > 1, F.try_divide(_total(pairs), n - 1)).otherwise(0.0)


def clipped(samples: Column, level: float = CLIP_LEVEL, run: int = CLIP_RUN) -> Column:
    """The part of samples in runs of three or more at full scale."""
    state = F.struct(F.lit(0).alias("run"), F.lit(0).alias("all"))

    def step(s, v):
        now = F.when(F.abs(v) >= level, s["run"] + 1).otherwise(0)
        return F.struct(now.alias("run"), (s["all"] + F.when(now == run, run).when(now > run, 1).otherwise(0)).alias("all"))

    return F.coalesce(F.try_divide(F.aggregate(samples, state, step, lambda s: s["all"]), F.size(samples)), F.lit(0.0))


def side_ratio(left: Column, right: Column) -> Column:
    """Level of the difference of two channels over that of their sum; null without one."""
    energy = lambda f: _total(F.zip_with(left, right, lambda a, b: f(a, b) * f(a, b)))
    mid = energy(lambda a, b: a + b)
    return F.when(mid > 0, F.sqrt(energy(lambda a, b: a - b) / mid))


def moving_average(values: Column, radius: int) -> Column:
    """Means over up to ``radius`` neighbours on either side."""
    n = F.size(values)

    def at(_, i):
        lo, hi = F.greatest(F.lit(0), i - radius), F.least(n - 1, i + radius)
        part = F.slice(values, lo + 1, hi - lo + 1)
        return _total(part) / F.size(part)

    return F.transform(values, at)


def resample(samples: Column, rate: int, to: int) -> Column:
    """Linear interpolation at another rate."""
    n = F.size(samples)
    count = F.greatest(F.lit(1), F.floor(n * (to / rate)).cast("int"))

    def at(i):
        x = i * (rate / to)
        lo = F.least(n - 1, F.floor(x).cast("int"))
        a, b = F.try_element_at(samples, lo + 1), F.try_element_at(samples, F.least(n - 1, lo + 1) + 1)
        return a + (b - a) * (x - lo)

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), count - 1), at))


def correlation(a: Column, b: Column) -> Column:
    """Pearson's r of two arrays of one length; 0 if either does not vary."""
    n = F.size(a)
    ma, mb = _total(a) / n, _total(b) / n
    cross = _total(F.zip_with(a, b, lambda x, y: (x - ma) * (y - mb)))
    va, vb = _total(F.transform(a, lambda x: (x - ma) * (x - ma))), _total(F.transform(b, lambda y: (y - mb) * (y - mb)))
    return F.when((va > 0) & (vb > 0), cross / F.sqrt(va * vb)).otherwise(0.0)


def key_of(chroma: Column) -> Column:
    """struct(root, scale, strength, margin) of 12 pitch classes; the lower tonic, then major, on ties."""

    def fits(profile):
        p = F.array(*map(F.lit, profile))
        return F.transform(F.sequence(F.lit(0), F.lit(11)), lambda t: correlation(F.concat(F.slice(chroma, t + 1, 12 - t), F.slice(chroma, F.lit(1), t)), p))

    ranked = lambda r, minor: F.transform(r, lambda c, i: F.struct((-c).alias("r"), i.alias("root"), F.lit(minor).alias("minor")))
    major, minor = fits(MAJOR), fits(MINOR)
    best = F.array_min(F.concat(ranked(major, 0), ranked(minor, 1)))
    other = F.when(best["minor"] == 0, F.array_max(minor)).otherwise(F.array_max(major))
    unit = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    return F.struct(best["root"].alias("root"), F.when(best["minor"] == 0, "major").otherwise("minor").alias("scale"), unit(-best["r"]).alias("strength"), unit(-best["r"] - other).alias("margin"))


def plan_windows(samples: Column, rate: Column) -> Column:
    """struct(descriptor, tempo) of (offset, length) windows of a signal of so many samples: the whole of a short one, null below 3 seconds."""
    window = lambda at, sec: F.struct(F.least(F.floor(samples * at + 0.5), F.greatest(F.lit(0), samples - F.floor(rate * sec + 0.5))).cast("long").alias("offset"), F.least(samples, F.floor(rate * sec + 0.5)).cast("long").alias("length"))
    whole = F.struct(F.lit(0).cast("long").alias("offset"), samples.cast("long").alias("length"))
    plan = lambda parts, tempo: F.struct(F.array(*parts).alias("descriptor"), tempo.alias("tempo"))
    sec = samples / rate
    return F.when(sec >= SHORT_SEC, plan([window(at, WINDOW_SEC) for at in WINDOW_AT], window(TEMPO_AT, TEMPO_SEC))).when(sec >= LEAST_SEC, plan([whole], whole))


# --- numpy inside tasks ---


def frames(x: np.ndarray, size: int, hop: int) -> np.ndarray:
    """The whole frames of a signal."""
    x = np.asarray(x, np.float64)
    return np.lib.stride_tricks.sliding_window_view(x, size)[::hop] if len(x) >= size else np.empty((0, size))


def spectra(x: np.ndarray, size: int = FRAME, hop: int = HOP) -> np.ndarray:
    window = 0.5 * (1 - np.cos(2 * np.pi * np.arange(size) / size))
    return np.abs(np.fft.rfft(frames(x, size, hop) * window, axis=1))


def _smooth(x: np.ndarray, radius: int) -> np.ndarray:
    sums = np.concatenate([[0.0], np.cumsum(x)])
    at = np.arange(len(x))
    lo, hi = np.maximum(0, at - radius), np.minimum(len(x), at + radius + 1)
    return (sums[hi] - sums[lo]) / (hi - lo)


def envelope(x: np.ndarray, rate: int) -> tuple[np.ndarray, float, float]:
    """(onset strength, its rate, peakiness)."""
    hop = max(1, round(rate / 100))
    mags = spectra(x, ONSET_FRAME, hop)
    flux = np.maximum(0, np.diff(mags, axis=0)).sum(axis=1) if len(mags) > 1 else np.empty(0)
    own = rate / hop
    smooth = _smooth(flux, 1)
    strength = np.maximum(0, smooth - _smooth(smooth, round(0.4 * own)))
    mean = strength.mean() if len(strength) else 0.0
    return strength, own, float(strength.max() / mean) if mean > 0 else 1.0


def tempo(strength: np.ndarray, rate: float, peakiness: float) -> tuple[float, float]:
    """(bpm, confidence) by a comb over the autocorrelation; zeros where there is no pulse."""
    longest = int(np.ceil(60 * rate / MIN_BPM))
    energy = float((strength * strength).sum())
    if len(strength) < 2 * longest or energy <= 0:
        return 0.0, 0.0
    spread = np.fft.rfft(strength, 2 * len(strength))
    r = np.fft.irfft(spread * np.conj(spread))[: longest + 1] / energy
    bpm = np.arange(MIN_BPM, MAX_BPM + BPM_STEP / 2, BPM_STEP)
    lag = 60 * rate / bpm
    at = lambda lags: np.interp(lags, np.arange(longest + 1), r)
    used = [np.where(lag * h <= longest, w, 0.0) for h, w in enumerate(HARMONICS, 1)]
    comb = sum(w * at(lag * h) for h, w in enumerate(used, 1)) / np.maximum(sum(used), 1e-12)
    score = (comb - SUB_WEIGHT * np.maximum(0, np.maximum(at(lag / 2), at(lag / 3)))) * np.exp(-0.5 * (np.log2(bpm / PRIOR_BPM) / PRIOR_OCTAVES) ** 2)
    best = int(np.argmax(score))
    if comb[best] <= 0:
        return 0.0, 0.0
    salience = min(1.0, max(0.0, (peakiness - PEAK_FLOOR) / (PEAK_CEILING - PEAK_FLOOR)))
    return float(bpm[best]), round(min(1.0, float(comb[best])) * salience, 3)


def beat_grid(strength: np.ndarray, rate: float, bpm: float, lead_sec: float = 0.0) -> tuple[float, float] | None:
    """(time of the first beat, strength from 0 to 1) of an onset envelope at a known tempo; None where no grid can be laid. lead_sec: how far the envelope runs ahead of the sound."""
    mean = strength.mean() if len(strength) else 0.0
    period = 60 * rate / bpm if GRID_BPM[0] <= bpm <= GRID_BPM[1] else 0.0
    beats = int(len(strength) // period) if period else 0
    if beats < 4 or mean <= 0:
        return None
    at = np.arange(PHASES)[:, None] / PHASES * period + np.arange(beats) * period
    value = np.interp(at, np.arange(len(strength)), strength)
    score = value.sum(axis=1)
    best = int(np.argmax(score))
    hits = (value[best] > mean).mean()
    margin = (score[best] - score.mean()) / (score[best] + score.mean())
    return (best / PHASES * period / rate + lead_sec) % (60 / bpm), float(min(1.0, max(0.0, margin * hits)))


def onset_density(strength: np.ndarray, rate: float) -> float:
    """Peaks a second that stand out by a standard deviation."""
    if len(strength) < 3 or strength.mean() == 0:
        return 0.0
    mid = strength[1:-1]
    return float(((mid > strength.mean() + strength.std()) & (mid >= strength[:-2]) & (mid > strength[2:])).sum() * rate / len(strength))


def chroma(x: np.ndarray, rate: int) -> np.ndarray:
    """Energy of 12 pitch classes from C, split between the two nearest, the largest being 1."""
    energy = (spectra(x, CHROMA_FRAME, CHROMA_FRAME) ** 2).sum(axis=0)
    hz = np.arange(len(energy)) * rate / CHROMA_FRAME
    inside = (hz >= CHROMA_LOW) & (hz <= CHROMA_HIGH)
    pitch = 69 + 12 * np.log2(hz[inside] / 440)
    low = np.floor(pitch)
    part = pitch - low
    out = np.bincount(low.astype(int) % 12, energy[inside] * (1 - part), 12) + np.bincount((low.astype(int) + 1) % 12, energy[inside] * part, 12)
    return out / out.max() if out.max() > 0 else out
