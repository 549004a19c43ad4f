"""From samples to descriptors, in stages: chunks, pieces of bounded length, numbers by piece, numbers by recording.

A recording is a table of chunks (id, rate, pos, samples), so no task ever holds
more of it than it needs: what is measured over the whole signal (its edges, clipped
samples) comes from sums by chunk and windows over frames of 50 ms, and what needs
a transform is measured on pieces of at most 30 seconds, the windows that
``signals.plan_windows`` places. Small helpers turn one piece into a few numbers;
means, ratios, medians and joins are Spark's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import codes, levels
from ..sources.files import checkpointed
from . import signals as S

CHUNK = 65_536
BAD, SHORT, OK = "bad_input", "too_short", "ok"


def chunked(recordings: DataFrame, size: int = CHUNK) -> DataFrame:
    """(id, rate, pos, samples): chunks of recordings (id, rate, samples); a recording without samples is one empty chunk."""
    whole = F.coalesce(F.col("samples"), F.array().cast("array<double>"))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(whole) - 1), F.lit(size))
    rows = recordings.select(F.col("id").cast("string").alias("id"), F.col("rate").cast("double").alias("rate"), whole.cast("array<double>").alias("whole"), F.explode(starts).alias("at"))
    return rows.select("id", "rate", F.col("at").cast("long").alias("pos"), F.slice("whole", F.col("at") + 1, F.lit(size)).alias("samples"))


def _interpolated(to: int, most: int = CHUNK):
    """Rows (id, rate, pos, samples, after, first, last) become chunks of at most ``most`` values, at places first to last of the new rate, which lie between the row's samples; after: the next chunk's first one, if there is one.

    Values are made and given out a few chunks at a time, however many rows a batch has and however far apart the rates are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("samples")
            x, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy().astype(np.int64)
            pos, first, last = (batch.column(c).to_numpy() for c in ("pos", "first", "last"))
            rate, after = batch.column("rate").to_numpy().astype(np.int64), batch.column("after").to_numpy(zero_copy_only=False)
            ends = x[offsets[1:] - 1]
            after = np.where(np.isnan(after), ends, after)
            parts = (last - first) // most + 1
            row = np.repeat(np.arange(len(batch)), parts)
            lo = first[row] + (np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)) * most
            n = np.minimum(last[row] - lo + 1, most)
            full = np.cumsum(n)
            i = 0
            while i < len(row):
                j = max(i + 1, int(np.searchsorted(full, (full[i - 1] if i else 0) + most, "right")))
                r = np.repeat(row[i:j], n[i:j])
                starts = np.append(0, full[i:j] - full[i] + n[i])
                at = (np.arange(starts[-1]) - np.repeat(starts[:-1] - lo[i:j], n[i:j])) * rate[r]  # whole numbers, so that no place is off by rounding
                k = offsets[r] + at // to - pos[r]
                left, inside = x[k], k + 1 < offsets[r + 1]
                right = np.where(inside, x[np.where(inside, k + 1, k)], after[r])
                values = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(left + (right - left) * ((at % to) / to), from_pandas=True))  # nulls, not NaN
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(row[i:j])), pa.array(np.full(j - i, float(to))), pa.array(lo[i:j]), values], names=["id", "rate", "pos", "samples"])
                i = j

    return run


def resampled(chunks: DataFrame, to: int = S.RATE) -> DataFrame:
    """Chunks (id, rate, pos, samples) at another rate, by linear interpolation across their borders, as for the whole signal: its length is rounded down, and is 1 at least.

    Chunks of a recording must follow on each other. Each needs the first sample of the
    next, which it finds by its own end. Rates are whole numbers. A recording that has the
    rate, or none that is above 0, or no samples, stays as it is.
    """
    rows = chunks.select("id", "rate", F.col("pos").cast("long").alias("pos"), "samples")
    able = F.coalesce((F.col("rate") >= 1) & ~F.isnan("rate") & (F.col("rate") != to), F.lit(False)) & (F.size("samples") > 0)
    heads = rows.where(F.size("samples") > 0).select("id", F.col("pos").alias("end"), F.col("samples")[0].alias("after"))
    ended = rows.withColumn("end", F.col("pos") + F.size("samples"))
    met = ended.join(heads, ["id", "end"], "left").join(ended.groupBy("id").agg(F.max("end").alias("n")), "id")
    rate, wide = F.col("rate").cast("long"), F.lit(to).cast("long")
    up = lambda n: F.floor((n * wide + rate - 1) / rate)
    whole = F.greatest(F.lit(1), F.floor(F.col("n") * wide / rate))
    bounds = met.withColumns({"able": able, "first": F.when(able, up(F.col("pos"))), "last": F.when(able, F.least(up(F.col("end")), whole) - 1)})
    kind = rows.schema["id"].dataType.simpleString()
    fresh = bounds.where("able AND last >= first").select("id", "rate", "pos", F.col("samples").cast("array<double>").alias("samples"), F.col("after").cast("double").alias("after"), "first", "last").mapInArrow(_interpolated(to), f"id {kind}, rate double, pos long, samples array<double>")
    return bounds.where("NOT able").select("id", "rate", "pos", "samples").unionByName(fresh)


def plans(chunks: DataFrame) -> DataFrame:
    """(id, n, rate, status, plan) of each recording; plan is null unless the status is ok."""
    meta = chunks.groupBy("id").agg(F.max(F.col("pos") + F.size("samples")).alias("n"), F.max("rate").alias("rate"))
    bad = F.col("rate").isNull() | F.isnan("rate") | (F.col("rate") <= 0) | (F.col("n") <= 0)
    status = F.when(bad, BAD).when(F.col("n") / F.col("rate") < S.LEAST_SEC, SHORT).otherwise(OK)
    return meta.withColumn("status", status).withColumn("plan", F.when(F.col("status") == OK, S.plan_windows(F.col("n"), F.col("rate"))))


def _piece(kind: str, k: Column, offset: Column, length: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), k.cast("int").alias("k"), offset.cast("long").alias("offset"), length.cast("long").alias("length"))


def pieces(planned: DataFrame) -> DataFrame:
    """(id, rate, kind, k, offset, length): the windows of the descriptors, the tempo's, 20 seconds and a quarter second of both ends."""
    n, rate = F.col("n"), F.col("rate")
    end = lambda sec: F.least(n, F.greatest(F.lit(1), F.floor(rate * sec + 0.5)))
    zero, long, brief = F.lit(0), end(S.END_SEC), end(S.LEVEL_SEC)
    windows = F.transform("plan.descriptor", lambda w, i: _piece("window", i, w["offset"], w["length"]))
    single = F.array(_piece("tempo", zero, F.col("plan.tempo.offset"), F.col("plan.tempo.length")), _piece("intro", zero, zero, long), _piece("outro", zero, n - long, long), _piece("start", zero, zero, brief), _piece("end", zero, n - brief, brief))
    return planned.where("plan IS NOT NULL").select("id", "rate", F.explode(F.concat(windows, single)).alias("p")).select("id", "rate", "p.*")


def cutoff_pieces(planned: DataFrame) -> DataFrame:
    """(id, rate, kind, k, offset, length): up to 64 frames spread over the middle 30 seconds, for the cutoff; none for less than a frame."""
    n, half = F.col("n"), S.CUTOFF_FRAME // 2
    length = F.least(n, F.floor(F.col("rate") * S.CUTOFF_SEC + 0.5))
    there = F.floor((length - S.CUTOFF_FRAME) / half) + 1
    frames = F.least(there, F.lit(S.CUTOFF_FRAMES))
    stride = F.greatest(F.lit(1), F.floor(there / frames))
    places = F.transform(F.sequence(F.lit(0).cast("long"), frames - 1), lambda i: _piece("cutoff", i, F.floor((n - length) / 2) + i * stride * half, F.lit(S.CUTOFF_FRAME)))
    able = planned.where((F.col("status") != BAD) & (length >= S.CUTOFF_FRAME))
    return able.select("id", "rate", F.explode(places).alias("p")).select("id", "rate", "p.*")


def cut_out(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, rate, kind, k, x): the samples of pieces; none is longer than 30 seconds, or a recording below 35."""
    last = F.col("offset") + F.col("length")
    met = chunks.select("id", "pos", "samples").join(wanted, "id").where((F.col("pos") < last) & (F.col("pos") + F.size("samples") > F.col("offset")))
    lo, hi = F.greatest(F.col("offset") - F.col("pos"), F.lit(0)), F.least(last - F.col("pos"), F.size("samples"))
    part = F.struct("pos", F.slice("samples", (lo + 1).cast("int"), (hi - lo).cast("int")).alias("x"))
    whole = met.groupBy("id", "rate", "kind", "k").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    return whole.select("id", "rate", "kind", "k", F.flatten(F.transform("parts", lambda p: p["x"])).alias("x"))


# --- helpers: one piece each ---


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=columns)


_DOUBLES = T.ArrayType(T.DoubleType())


def _numbers(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.DoubleType()) for n in names])


@F.pandas_udf(_numbers("centroid_hz", "rolloff_hz", "low_band", "flux").add("chroma", _DOUBLES))
def _spectral(pieces_: pd.Series, rates: pd.Series) -> pd.DataFrame:
    rows = []
    for x, rate in zip(pieces_, rates, strict=True):
        mags = S.spectra(x)
        hz = np.arange(mags.shape[1]) * rate / S.FRAME
        mass, energy, n = mags.sum(axis=1), mags**2, max(1, len(mags))
        with np.errstate(divide="ignore", invalid="ignore"):
            centroid = np.nan_to_num((mags * hz).sum(axis=1) / mass).sum() / n
            low = np.nan_to_num(energy[:, hz <= 200].sum(axis=1) / energy.sum(axis=1)).sum() / n
        rolloff = hz[np.minimum((np.cumsum(mags, axis=1) < 0.85 * mass[:, None]).sum(axis=1), len(hz) - 1)].sum() / n
        rows.append((centroid, rolloff, low, np.maximum(0, np.diff(mags, axis=0)).sum() / max(1, n - 1), S.chroma(x, rate)))
    return _frame(rows, ["centroid_hz", "rolloff_hz", "low_band", "flux", "chroma"])


@F.pandas_udf(_numbers("bpm", "confidence", "density"))
def _rhythm(pieces_: pd.Series, rates: pd.Series) -> pd.DataFrame:
    rows = []
    for x, rate in zip(pieces_, rates, strict=True):
        strength, own, peakiness = S.envelope(x, rate)
        rows.append((*S.tempo(strength, own, peakiness), S.onset_density(strength, own)))
    return _frame(rows, ["bpm", "confidence", "density"])


@F.pandas_udf(_numbers("phase", "strength"))
def _grid(pieces_: pd.Series, rates: pd.Series, bpms: pd.Series) -> pd.DataFrame:
    rows = []
    for x, rate, bpm in zip(pieces_, rates, bpms, strict=True):
        strength, own, _ = S.envelope(x, rate)
        rows.append(S.beat_grid(strength, own, bpm, S.LEAD_FRAMES * S.ONSET_FRAME / rate) or (None, None))
    return _frame(rows, ["phase", "strength"]).astype("float64")


@F.pandas_udf(_DOUBLES)
def _bands(pieces_: pd.Series, rates: pd.Series) -> pd.Series:
    def one(x: np.ndarray, rate: float) -> np.ndarray:
        energy = (S.spectra(x, S.CUTOFF_FRAME, S.CUTOFF_FRAME) ** 2).sum(axis=0)[1:]  # an offset is no sound
        hz = np.arange(1, len(energy) + 1) * rate / S.CUTOFF_FRAME
        bands = int(np.ceil(min(rate / 2, S.CUTOFF_HZ) / S.BAND_HZ))
        inside = hz < bands * S.BAND_HZ
        return np.bincount((hz[inside] // S.BAND_HZ).astype(int), energy[inside], bands)

    return pd.Series([one(x, r) for x, r in zip(pieces_, rates, strict=True)])


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _print(pieces_: pd.Series, rates: pd.Series) -> pd.Series:
    """20 chroma frames as bytes; null for a piece too short for them."""

    def one(x: np.ndarray, rate: float):
        if len(x) < S.SEGMENT_FRAMES * S.CHROMA_FRAME:
            return None
        ends = np.arange(S.SEGMENT_FRAMES + 1) * len(x) // S.SEGMENT_FRAMES
        cells = np.concatenate([S.chroma(x[i:j], rate) for i, j in zip(ends[:-1], ends[1:], strict=True)])
        return np.floor(cells * 255 + 0.5).astype(np.int32)

    return pd.Series([one(x, r) for x, r in zip(pieces_, rates, strict=True)], dtype=object)


# --- numbers by recording ---


def _squares(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v)


def window_levels(cut: DataFrame) -> DataFrame:
    """(id, rms, zcr, crest): means of the descriptors' windows; the crest over all of them joined."""
    rows = cut.where("kind = 'window'").select("id", F.size("x").alias("n"), _squares(F.col("x")).alias("ss"), S.peak(F.col("x")).alias("peak"), S.zero_crossings(F.col("x")).alias("zcr"))
    level = F.sqrt(F.sum("ss") / F.sum("n"))
    return rows.groupBy("id").agg(F.avg(F.sqrt(F.col("ss") / F.col("n"))).alias("rms"), F.avg("zcr").alias("zcr"), F.when(level > 0, F.max("peak") / level).otherwise(0.0).alias("crest"))


def spectral(cut: DataFrame) -> DataFrame:
    """(id, centroid_hz, rolloff_hz, low_band, flux, chroma): means over the windows; the chroma's over those that have any."""
    rows = cut.where("kind = 'window'").select("id", _spectral("x", "rate").alias("s"))
    classes = [F.avg(F.when(F.array_max("s.chroma") > 0, F.col("s.chroma")[i])) for i in range(12)]
    return rows.groupBy("id").agg(*(F.avg(f"s.{c}").alias(c) for c in ("centroid_hz", "rolloff_hz", "low_band", "flux")), F.array(*(F.coalesce(c, F.lit(0.0)) for c in classes)).alias("chroma"))


def rhythm(cut: DataFrame) -> DataFrame:
    """(id, bpm, bpm_confidence, onset_density) of the tempo's window."""
    return cut.where("kind = 'tempo'").select("id", _rhythm("x", "rate").alias("r")).select("id", "r.bpm", F.col("r.confidence").alias("bpm_confidence"), F.col("r.density").alias("onset_density"))


def beats(cut: DataFrame, tempo: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, intro_beat_sec, outro_beat_sec): times of a beat near both ends; null where tempo or grid are too weak."""
    sure = tempo.where((F.col("bpm") > 0) & (F.col("bpm_confidence") >= S.LEAST_TEMPO)).select("id", "bpm")
    grids = cut.where("kind IN ('intro', 'outro')").join(sure, "id").select("id", "rate", "kind", _grid("x", "rate", "bpm").alias("g")).where(F.col("g.strength") >= S.LEAST_GRID)
    placed = grids.join(wanted.where("kind IN ('intro', 'outro')").select("id", "kind", "offset"), ["id", "kind"])
    at = F.col("offset") / F.col("rate") + F.col("g.phase")
    return placed.groupBy("id").agg(*(F.max(F.when(F.col("kind") == k, at)).alias(f"{k}_beat_sec") for k in ("intro", "outro")))


def end_levels(cut: DataFrame) -> DataFrame:
    """(id, head, tail): levels of the first and the last quarter second."""
    rows = cut.where("kind IN ('start', 'end')").select("id", "kind", S.rms(F.col("x")).alias("v"))
    return rows.groupBy("id").agg(F.max(F.when(F.col("kind") == "start", F.col("v"))).alias("head"), F.max(F.when(F.col("kind") == "end", F.col("v"))).alias("tail"))


def prints(cut: DataFrame) -> DataFrame:
    """(id, fingerprint): 20 chroma frames of each of three segments, which are the windows, or thirds of a single one; null for a recording too short for them."""
    rows = cut.where("kind = 'window'").withColumn("several", F.count("*").over(Window.partitionBy("id")) >= S.SEGMENTS)  # at most three pieces
    n = F.size("x").cast("long")
    third = lambda i: F.slice("x", F.floor(i * n / S.SEGMENTS).cast("int") + 1, (F.floor((i + 1) * n / S.SEGMENTS) - F.floor(i * n / S.SEGMENTS)).cast("int"))
    parts = F.when(F.col("several"), F.array(F.struct(F.col("k"), F.col("x").alias("x")))).otherwise(F.array(*(F.struct(F.lit(i).cast("int").alias("k"), third(i).alias("x")) for i in range(S.SEGMENTS))))
    cells = rows.select("id", "rate", F.explode(parts).alias("p")).select("id", F.col("p.k").alias("k"), _print("p.x", "rate").alias("c")).where("c IS NOT NULL")
    return cells.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("k", "c"))).alias("c")).where(F.size("c") == S.SEGMENTS).select("id", codes.fingerprint_text(F.flatten(F.transform("c", lambda s: s["c"]))).alias("fingerprint"))


def cutoffs(chunks: DataFrame, planned: DataFrame | None = None) -> DataFrame:
    """(id, cutoff_hz) of recordings at their own rate: the upper edge of the highest band of 500 Hz below 24 kHz whose median energy is within 55 dB of the loudest; none for silence or less than a frame."""
    cut = cut_out(chunks, cutoff_pieces(plans(chunks) if planned is None else planned))
    bands = cut.select("id", F.posexplode(_bands("x", "rate")).alias("band", "e")).groupBy("id", "band").agg(F.percentile("e", F.lit(0.5)).alias("m"))
    loudest = F.max("m").over(Window.partitionBy("id"))  # a row for each band
    return bands.withColumn("top", loudest).where((F.col("top") > 0) & (F.col("m") > F.col("top") * 10 ** (S.CUTOFF_DB / 10))).groupBy("id").agg(((F.max("band") + 1) * F.lit(float(S.BAND_HZ))).alias("cutoff_hz"))


def sound_edges(chunks: DataFrame, planned: DataFrame) -> DataFrame:
    """(id, sound_start_sec, sound_end_sec): where the sound begins and ends, by whole frames of 50 ms; no row for silence."""
    rows = chunks.select("id", "pos", "samples").join(planned.where(F.col("status") != BAD).select("id", "rate", "n", F.greatest(F.lit(1), F.floor(F.col("rate") * S.EDGE_SEC + 0.5)).alias("size")), "id").where(F.size("samples") > 0)
    first, last = F.floor(F.col("pos") / F.col("size")), F.floor((F.col("pos") + F.size("samples") - 1) / F.col("size"))
    lo = lambda f: F.greatest(f * F.col("size") - F.col("pos"), F.lit(0))
    hi = lambda f: F.least((f + 1) * F.col("size") - F.col("pos"), F.size("samples"))
    cells = F.transform(F.sequence(first, last), lambda f: F.struct(f.alias("f"), _squares(F.slice("samples", (lo(f) + 1).cast("int"), (hi(f) - lo(f)).cast("int"))).alias("ss")))
    frames = rows.select("id", "rate", "n", "size", F.explode(cells).alias("c")).groupBy("id", "rate", "n", "size", F.col("c.f").alias("f")).agg(F.sum("c.ss").alias("ss")).where(F.col("f") < F.floor(F.col("n") / F.col("size")))
    leveled = frames.withColumn("level", F.sqrt(F.col("ss") / F.col("size")))
    mean = leveled.groupBy("id").agg(F.avg("level").alias("mean")).where("mean > 0")
    w = Window.partitionBy("id").orderBy("f")  # the frames of one recording
    loud = leveled.join(mean, "id").withColumn("loud", (F.col("level") > F.col("mean") * 10 ** (S.EDGE_DB / 20)).cast("int"))
    mostly = lambda a, b: (F.sum("loud").over(w.rowsBetween(a, b)) * 2 >= F.count("*").over(w.rowsBetween(a, b))) & (F.col("loud") == 1)
    run = S.EDGE_RUN - 1
    told = loud.select("id", "rate", "size", "f", mostly(0, run).alias("opens"), mostly(-run, 0).alias("closes"))
    ends = told.groupBy("id", "rate", "size").agg(F.min(F.when(F.col("opens"), F.col("f"))).alias("a"), F.max(F.when(F.col("closes"), F.col("f"))).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    return ends.select("id", (F.col("a") * F.col("size") / F.col("rate")).alias("sound_start_sec"), ((F.col("b") + 1) * F.col("size") / F.col("rate")).alias("sound_end_sec"))


def clipped(chunks: DataFrame, planned: DataFrame) -> DataFrame:
    """(id, clipped_ratio): the part of samples in runs of three or more at full scale; no row if there are none. Only such samples become rows."""
    full = F.filter(F.transform("samples", lambda v, i: F.when(F.abs(v) >= S.CLIP_LEVEL, F.col("pos") + i)), lambda p: p.isNotNull())
    at = chunks.select("id", F.explode(full).alias("p"))
    runs = at.withColumn("run", F.col("p") - F.row_number().over(Window.partitionBy("id").orderBy("p"))).groupBy("id", "run").agg(F.count("*").alias("c")).where(F.col("c") >= S.CLIP_RUN)
    return runs.groupBy("id").agg(F.sum("c").alias("c")).join(planned.select("id", "n"), "id").select("id", (F.col("c") / F.col("n")).alias("clipped_ratio"))


def side_ratios(left: DataFrame, right: DataFrame) -> DataFrame:
    """(id, side_ratio) of two channels as chunks that begin at the same places: the level of their difference over that of their sum; null without a sum."""
    both = left.select("id", "pos", F.col("samples").alias("l")).join(right.select("id", "pos", F.col("samples").alias("r")), ["id", "pos"])
    energy = lambda f: _squares(F.zip_with("l", "r", f))
    sums = both.select("id", energy(lambda a, b: a + b).alias("mid"), energy(lambda a, b: a - b).alias("side")).groupBy("id").agg(F.sum("mid").alias("mid"), F.sum("side").alias("side"))
    return sums.select("id", F.when(F.col("mid") > 0, F.sqrt(F.col("side") / F.col("mid"))).alias("side_ratio"))


def measured_levels(chunks: DataFrame) -> DataFrame:
    """(id, status, duration_sec, rms, loudness_db, crest, zcr, head_ratio, tail_ratio, clipped_ratio, sound_start_sec, sound_end_sec): what needs no transform."""
    planned = plans(chunks)
    cut = cut_out(chunks, pieces(planned).where("kind IN ('window', 'start', 'end')"))
    return _joined_levels(planned, cut, chunks).drop("n", "rate", "plan")


def _joined_levels(planned: DataFrame, cut: DataFrame, chunks: DataFrame) -> DataFrame:
    rows = planned
    for part in (window_levels(cut), end_levels(cut), clipped(chunks, planned), sound_edges(chunks, planned)):
        rows = rows.join(part, "id", "left")
    ok = F.col("status") == OK
    over = lambda c: F.when(ok, F.when(F.col("rms") > 0, F.col(c) / F.col("rms")).otherwise(0.0))
    kept = lambda c: F.when(ok, F.col(c))
    return rows.select("id", "n", "rate", "plan", "status", F.when(F.col("status") != BAD, F.col("n") / F.col("rate")).alias("duration_sec"), "rms", F.when(ok, levels.to_db(F.col("rms"))).alias("loudness_db"), "crest", "zcr", over("head").alias("head_ratio"), over("tail").alias("tail_ratio"), F.when(ok, F.coalesce("clipped_ratio", F.lit(0.0))).alias("clipped_ratio"), kept("sound_start_sec").alias("sound_start_sec"), kept("sound_end_sec").alias("sound_end_sec"))


def danceability(clarity: Column, low_band: Column, density: Column) -> Column:
    unit = lambda v: F.least(F.lit(1.0), F.greatest(F.lit(0.0), v))
    return unit(F.cbrt((0.2 + 0.8 * unit(clarity)) * (0.4 + 0.6 * unit(2 * low_band)) * (0.3 + 0.7 * unit(density / S.BUSY))))


def extract(chunks: DataFrame, side: DataFrame | None = None, cutoff: DataFrame | None = None) -> DataFrame:
    """Every descriptor of recordings as chunks (id, rate, pos, samples), a row each; side: (id, side_ratio) where channels are known; cutoff: (id, cutoff_hz) where it is known from another rate.

    Frames are whole numbers of samples, so recordings compare at one rate only: see ``resampled``.
    status is ok, bad_input (no samples, or a rate that is null or not above 0) or too_short (below 3 seconds); descriptors are null unless it is ok.
    """
    chunks = checkpointed(chunks)
    planned = checkpointed(plans(chunks))
    wanted = pieces(planned)
    cut = checkpointed(cut_out(chunks, wanted))
    tempo = checkpointed(rhythm(cut))
    rows = _joined_levels(planned, cut, chunks)
    for part in (spectral(cut), tempo, beats(cut, tempo, wanted), cutoffs(chunks, planned.where(F.col("status") == OK)) if cutoff is None else cutoff, prints(cut)):
        rows = rows.join(part, "id", "left")
    rows = rows.join(side, "id", "left") if side is not None else rows.withColumn("side_ratio", F.lit(None).cast("double"))
    return rows.withColumns({"danceability": danceability(F.col("bpm_confidence"), F.col("low_band"), F.col("onset_density")), "key": F.when(F.col("status") == OK, S.key_of(F.col("chroma")))}).drop("n", "rate", "plan")
