"""Levels, silence and bandwidth of recordings, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Trim limits in dB, health thresholds, bandwidth limits in Hz and kbit/s.
MAX_TRIM, MARGIN, MAX_BAND = 12.0, 2.0, 12.0
SILENT_DB, SIDE, TAIL, CLIPPED, DEAD_AIR = -45.0, 0.005, 0.5, 0.001, 2.0
FULL_HZ, HIGH_HZ, LOSSY_HZ, TRANSCODE_KBPS = 20_000, 18_500, 17_000, 224


def to_db(x: Column) -> Column:
    """20 log10 x; minus infinity at 0 and below."""
    return F.when(x > 0, 20 * F.log10(x)).otherwise(F.lit(float("-inf")))


def to_gain(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 20)


def slider_to_db(value: Column) -> Column:
    """The gain of an equaliser band whose slider stands at 0 to 100; 50 is none."""
    return (F.greatest(F.lit(0.0), F.least(F.lit(100.0), value)) - 50) / 50 * MAX_BAND


def trim_db(reference_db: Column, level_db: Column, crest: Column) -> Column:
    """How much to turn a recording up or down: to the reference, at most 12 dB, and up only as far as its peaks allow."""
    wanted = F.greatest(F.lit(-MAX_TRIM), F.least(F.lit(MAX_TRIM), reference_db - level_db))
    headroom = -(level_db + 20 * F.log10(crest)) - MARGIN
    return F.when(wanted <= 0, wanted).when(crest > 0, F.greatest(F.lit(0.0), F.least(wanted, headroom))).otherwise(0.0)


def dead_air(start_sec: Column, end_sec: Column, duration_sec: Column) -> Column:
    """Seconds of silence at both ends; 0 if the edges of the sound are unknown."""
    tail = F.coalesce(F.greatest(F.lit(0.0), duration_sec - end_sec), F.lit(0.0))
    return F.when(start_sec.isNotNull() & end_sec.isNotNull(), F.greatest(F.lit(0.0), start_sec) + tail).otherwise(0.0)


def bitrate_kbps(size: Column, duration_sec: Column) -> Column:
    return F.when(duration_sec > 0, size * 8 / duration_sec / 1000)


def cutoff_verdict(cutoff_hz: Column, kbps: Column) -> Column:
    """What the highest frequency of a file says: full, high, lossy, or transcode if a high bitrate belies it."""
    return F.when(cutoff_hz >= FULL_HZ, "full").when(cutoff_hz >= HIGH_HZ, "high").when((cutoff_hz < LOSSY_HZ) & (kbps >= TRANSCODE_KBPS), "transcode").when(cutoff_hz.isNotNull(), "lossy")


def cutoff_words(cutoff_hz: Column) -> Column:
    return F.format_string("%.1f kHz", cutoff_hz / 1000)


def effective_end(sound_end_sec: Column, duration_sec: Column) -> Column:
    """Where the music ends: the sound's end where it is known and lies inside the file."""
    return F.when((sound_end_sec > 0) & (sound_end_sec < duration_sec), sound_end_sec).otherwise(duration_sec)


def head_trim(start_sec: Column, duration_sec: Column) -> Column:
    """Silence to skip at the start: half a second or more, and no more than a quarter of the file."""
    return F.when((start_sec >= 0.5) & (start_sec <= duration_sec / 4), start_sec).otherwise(0.0)


def equaliser_headroom(gains: Column) -> Column:
    return -F.greatest(F.lit(0.0), F.coalesce(F.array_max(gains), F.lit(0.0)))
