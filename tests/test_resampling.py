"""Recordings of different rates are measured alike."""

import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from soundlake.functions import codes
from soundlake.operators import recordings
from soundlake.streaming import analysis

RATES = (8_000, 16_000, 44_100, 48_000)


def linear(x, rate, to):
    """The plain loop."""
    out = []
    for i in range(max(1, len(x) * to // rate)):
        k, part = i * rate // to, i * rate % to / to
        b = x[k + 1] if k + 1 < len(x) else x[k]
        out.append(x[k] + (b - x[k]) * part)
    return out


@pytest.mark.parametrize("size", [1, 7, 1_000, 5_000])
def test_chunks_join_like_the_whole_signal(spark, size):
    rng = np.random.default_rng(size)
    sounds = {f"{rate}-{n}": (rate, rng.normal(size=n).tolist()) for rate in (8_000, 11_025, 16_000, 44_100, 96_000) for n in (1, 2, 50, 333)}
    rows = spark.createDataFrame([(k, rate, x) for k, (rate, x) in sounds.items()] + [("none", None, [0.5]), ("zero", 0, [0.5]), ("empty", 8_000, None)], "id string, rate int, samples array<double>")
    got = {}
    for r in recordings.resampled(recordings.chunked(rows, size)).orderBy("id", "pos").collect():
        before = got.setdefault(r.id, [])
        assert r.pos == len(before)
        before += r.samples
    for k, (rate, x) in sounds.items():
        assert np.allclose(got[k], linear(x, rate, 16_000), atol=1e-12) and len(got[k]) == max(1, len(x) * 16_000 // rate)
    assert got["none"] == got["zero"] == [0.5] and got["empty"] == []
    bad = recordings.plans(recordings.resampled(recordings.chunked(rows, size))).where("id in ('none', 'zero', 'empty')").collect()
    assert {r.status for r in bad} == {"bad_input"}


def sound(rate, seconds=16):
    """A chord with a click every half second, the same at every rate."""
    t = np.arange(rate * seconds) / rate
    x = sum(np.sin(2 * np.pi * f * t) for f in (220.0, 277.2, 329.6, 880.0)) / 8
    return x * (0.3 + 0.7 * np.exp(-20 * (t % 0.5)))


def test_descriptors_of_one_sound_at_four_rates(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for rate in RATES:
        body = np.round(np.column_stack([sound(rate), sound(rate) / 2]) * 32_767).astype("<i2").tobytes()
        (tmp_path / "in" / f"{rate}.wav").write_bytes(b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 2, rate, rate * 4, 4, 16) + b"data" + struct.pack("<I", len(body)) + body)
    analysis.analyse(analysis.arriving(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "marks"))
    got = {int(r.id.rsplit("/", 1)[1][:-4]): r for r in analysis.results(spark, str(tmp_path / "out")).collect()}
    base = got[16_000]
    for rate in RATES:
        r = got[rate]
        assert r.status == "ok" and r.duration_sec == pytest.approx(16, abs=1e-4) and r.side_ratio == pytest.approx(1 / 3, abs=1e-3)
        assert r.rms == pytest.approx(base.rms, rel=0.02) and r.centroid_hz == pytest.approx(base.centroid_hz, rel=0.1) and r.flux == pytest.approx(base.flux, rel=0.1)
        assert r.bpm == base.bpm and (r.key.root, r.key.scale) == (base.key.root, base.key.scale)
        prints = spark.createDataFrame([(r.fingerprint, base.fingerprint)], "a string, b string").select(*(codes.fingerprint_bytes(F.col(c)).alias(c) for c in "ab")).first()
        assert len(prints.a) == 720 and np.abs(np.subtract(prints.a, prints.b)).mean() < 8
        assert r.cutoff_hz <= rate / 2


def test_cutoff_of_a_band(spark):
    """Noise up to 5 kHz at 44.1 kHz, over an offset that is no sound, and below the middle 30 seconds nothing counts."""
    rate, n = 44_100, 44_100 * 40
    rng = np.random.default_rng(2)
    spectrum = np.fft.rfft(rng.normal(size=n))
    spectrum[np.arange(len(spectrum)) * rate / n > 5_000] = 0
    x = np.fft.irfft(spectrum, n) * 0.05 + 0.5
    x[: rate * 4] = rng.normal(size=rate * 4)
    chunks = recordings.chunked(spark.createDataFrame([("a", rate, x.tolist()), ("short", rate, [0.1] * 8_000), ("silent", rate, [0.0] * 10_000)], "id string, rate int, samples array<double>"))
    assert {r.id: r.cutoff_hz for r in recordings.cutoffs(chunks).collect()} == {"a": 5_000.0}


def test_a_batch_of_long_chunks_comes_out_in_small_ones():
    """Values are given out a few chunks at a time, so a task's memory doesn't follow a batch's rows or the rates."""
    rows, to = 500, 16_000
    x = np.random.default_rng(3).normal(size=(rows, 64))
    pos = np.arange(rows) * 64
    first, last = pos * 10, (pos + 64) * 10 - 1
    after = np.append(x[1:, 0], np.nan)
    columns = [["a"] * rows, np.full(rows, 1_600.0), pos, pa.array(list(x)), pa.array(after, from_pandas=True), first, last]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["id", "rate", "pos", "samples", "after", "first", "last"])
    for most in (100, 5_000):
        out = list(recordings._interpolated(to, most)(iter([batch])))
        assert max(len(b.column("samples").values) for b in out) <= most
        got = pa.Table.from_batches(out)
        assert np.allclose(np.concatenate(got["samples"].to_pylist()), linear(x.ravel(), 1_600, to), atol=1e-12)
        sizes = [len(v) for v in got["samples"].to_pylist()]
        assert got["pos"].to_pylist() == np.append(0, np.cumsum(sizes)[:-1]).tolist() and max(sizes) <= most
