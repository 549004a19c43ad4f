"""Findings about files: what cannot be decoded, is silent, cut off, clipped, or not what it claims to be."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import levels

#: The issues in order, and the versions since which they can be told.
ISSUES = ("undecodable", "failed", "silent", "fake-stereo", "abrupt-end", "clipped", "dead-air")
DESCRIPTORS_SINCE, EDGES_SINCE = 3, 5


def _checked():
    return F.col("analysed") & (F.col("version") >= DESCRIPTORS_SINCE)


def _silent():
    return _checked() & (levels.to_db(F.col("loudness")) < levels.SILENT_DB)


def findings(tracks: DataFrame) -> DataFrame:
    """(issue, id, measure): one row for each rule that a file breaks; silent files are measured no further."""
    dead = levels.dead_air(F.col("sound_start_sec"), F.col("sound_end_sec"), F.col("duration_sec"))
    loud = _checked() & ~_silent()
    rules = (
        (F.col("status") == "unsupported", F.lit(None).cast("double")),
        (F.col("status") == "failed", F.lit(None).cast("double")),
        (_silent(), levels.to_db(F.col("loudness"))),
        (loud & (F.col("side_ratio") < levels.SIDE), F.col("side_ratio")),
        (loud & (F.col("tail_ratio") > levels.TAIL), F.col("tail_ratio")),
        (loud & (F.col("clipped_ratio") > levels.CLIPPED), F.col("clipped_ratio")),
        (loud & (F.col("version") >= EDGES_SINCE) & (dead > levels.DEAD_AIR), dead),
    )
    hits = F.array_compact(F.array(*(F.when(rule, F.struct(F.lit(issue).alias("issue"), measure.alias("measure"))) for issue, (rule, measure) in zip(ISSUES, rules, strict=True))))
    return tracks.select("id", F.explode(hits).alias("h")).select("h.issue", "id", "h.measure")


def worst(found: DataFrame, issue: str, limit: int = 8) -> DataFrame:
    """The worst files of an issue, first the most silent or the longest dead air."""
    order = F.asc("measure") if issue == "silent" else F.desc("measure")
    return found.where(F.col("issue") == issue).orderBy(order, "id").limit(limit)


def totals(tracks: DataFrame) -> DataFrame:
    """One row: files, checked files, files awaiting a new analysis, and files with any finding."""
    affected = findings(tracks).agg(F.count_distinct("id").alias("affected"))
    return tracks.agg(F.count("*").alias("total"), F.count_if(_checked()).alias("checked"), F.count_if(F.col("analysed") & (F.col("version") < DESCRIPTORS_SINCE)).alias("awaiting")).crossJoin(affected)


def blind_spots(tracks: DataFrame) -> DataFrame:
    """One row of booleans: what the rules cannot see here."""
    seen = tracks.where(_checked())
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    return seen.agg(F.lit(True).alias("above_8_khz"), some(F.col("clipped_ratio") > 0).alias("resampled_clipping"), some(F.col("side_ratio").isNull()).alias("mono_files"), some(F.col("side_ratio").isNotNull()).alias("one_channel_faults"))


def dead_air(tracks: DataFrame) -> DataFrame:
    """(id, dead_air_sec, music_end_sec, head_trim_sec) of analysed files."""
    start, end, duration = F.col("sound_start_sec"), F.col("sound_end_sec"), F.col("duration_sec")
    return tracks.where("analysed").select("id", levels.dead_air(start, end, duration).alias("dead_air_sec"), levels.effective_end(end, duration).alias("music_end_sec"), levels.head_trim(start, duration).alias("head_trim_sec"))


def cutoff_report(readings: DataFrame) -> DataFrame:
    """(id, cutoff_hz, kbps, verdict, cutoff) of readings (id, cutoff_hz, size, duration_sec)."""
    kbps = levels.bitrate_kbps(F.col("size"), F.col("duration_sec"))
    return readings.select("id", "cutoff_hz", kbps.alias("kbps"), levels.cutoff_verdict(F.col("cutoff_hz"), kbps).alias("verdict"), levels.cutoff_words(F.col("cutoff_hz")).alias("cutoff"))


def cutoff_groups(readings: DataFrame) -> DataFrame:
    """cutoff_report in groups by verdict, those with the lowest cutoff first; files without a verdict are left out."""
    return cutoff_report(readings).where("verdict IS NOT NULL").orderBy("verdict", "cutoff_hz", "id")


def cutoff_counts(readings: DataFrame) -> DataFrame:
    """(verdict, files, lowest_hz, highest_hz)."""
    return cutoff_report(readings).where("verdict IS NOT NULL").groupBy("verdict").agg(F.count("*").alias("files"), F.min("cutoff_hz").alias("lowest_hz"), F.max("cutoff_hz").alias("highest_hz"))


def trims(tracks: DataFrame, reference: DataFrame) -> DataFrame:
    """(id, level_db, trim_db) against a reference level of one row."""
    level = levels.to_db(F.col("loudness"))
    rows = tracks.where("analysed").crossJoin(F.broadcast(reference))  # one row
    return rows.select("id", level.alias("level_db"), F.coalesce(levels.trim_db(F.col("reference_db"), level, F.col("crest")), F.lit(0.0)).alias("trim_db"))
