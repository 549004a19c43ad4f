"""Plays: how often, how recently, and what they say about the next choice."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RECENT, MEMORY = "INTERVAL 4 HOURS", 10


def frequency(plays: DataFrame) -> DataFrame:
    """(id, plays, frequency): plays of each recording, and as a part of the most played one's."""
    counts = plays.groupBy(F.col("track_id").alias("id")).agg(F.count("*").alias("plays"))
    most = counts.agg(F.max("plays").alias("most"))
    return counts.crossJoin(F.broadcast(most)).select("id", "plays", (F.col("plays") / F.col("most")).alias("frequency"))  # one row


def now_of(plays: DataFrame) -> DataFrame:
    return plays.agg(F.max("played_at").alias("now"))


def recent(plays: DataFrame, now: DataFrame | None = None) -> DataFrame:
    """(id) of recordings played in the four hours before now, which is the last play's time unless given."""
    at = now_of(plays) if now is None else now
    return plays.crossJoin(F.broadcast(at)).where(F.expr(f"played_at > now - {RECENT}")).select(F.col("track_id").alias("id")).distinct()


def recent_names(plays: DataFrame, tracks: DataFrame, field: str, seed_id: str | None = None, now: DataFrame | None = None, limit: int = MEMORY) -> DataFrame:
    """(ord, name): artists or albums that count as recent, at most ten: the seed's first, then those of analysed recordings played in the four hours before now, earliest first; names may repeat."""
    at = now_of(plays) if now is None else now
    window = plays.crossJoin(F.broadcast(at)).where(F.expr(f"played_at > now - {RECENT}"))  # one row
    first = window.groupBy(F.col("track_id").alias("id")).agg(F.min(F.struct("played_at", "event_id")).alias("at"))
    if seed_id is not None:
        seed = tracks.sparkSession.createDataFrame([(seed_id,)], "id string").join(first.select("id", "at"), "id", "left").select("id", F.lit(None).cast(first.schema["at"].dataType).alias("at"))
        first = seed.unionByName(first)  # a null comes first
    named = first.join(tracks.where("analysed").select("id", F.col(field).alias("name")), "id").where("name IS NOT NULL")
    top = named.orderBy("at", "id").limit(limit)
    rows = top.agg(F.array_sort(F.collect_list(F.struct(F.coalesce(F.col("at")["played_at"], F.lit("1900-01-01").cast("timestamp")).alias("a"), F.coalesce(F.col("at")["event_id"], F.lit(-1)).alias("e"), "id", "name"))).alias("r"))  # at most ten
    return rows.select(F.posexplode("r").alias("ord", "s")).select("ord", F.col("s.name").alias("name"))


def context(plays: DataFrame, tracks: DataFrame, now: DataFrame | None = None, seed_id: str | None = None) -> DataFrame:
    """tracks with recent_artist, recent_album, recent and frequency; the seed's artist and album count as recent."""
    named = lambda field: recent_names(plays, tracks, field, seed_id, now).select(F.col("name").alias(field), F.lit(True).alias(f"recent_{field}")).distinct()
    rows = tracks.join(F.broadcast(named("artist")), "artist", "left").join(F.broadcast(named("album")), "album", "left")  # at most ten rows each
    rows = rows.join(recent(plays, now).withColumn("recent", F.lit(True)), "id", "left").join(frequency(plays).select("id", "frequency"), "id", "left")
    no = F.lit(False)
    return rows.withColumns({"recent_artist": F.coalesce("recent_artist", no), "recent_album": F.coalesce("recent_album", no), "recent": F.coalesce("recent", no), "frequency": F.coalesce("frequency", F.lit(0.0))})


def without_repeats(changes: DataFrame, by: str) -> DataFrame:
    """changes (event_id, track_id, played_at) of what plays, without those that name the recording already playing and those that name none; by: a listener's column, each of whom is told on their own."""
    w = Window.partitionBy(by).orderBy("played_at", "event_id")  # the changes of one listener
    told = changes.where("track_id IS NOT NULL").withColumn("before", F.lag("track_id").over(w))
    return told.where("before IS NULL OR before <> track_id").drop("before")


def job_times(marks: DataFrame) -> DataFrame:
    """(job, stage, ms): times that jobs spent in stages, from marks (job, kind: stage, done or failed, stage, at in ms, number). Entering a stage closes the one before, done closes the last, and a failure ends one without a time; one that is still open is not told."""
    w = Window.partitionBy("job").orderBy("at", "number")  # the marks of one job
    rows = marks.withColumns({"until": F.lead("at").over(w), "next": F.lead("kind").over(w)})
    return rows.where((F.col("kind") == "stage") & (F.col("next") != "failed")).select("job", "stage", (F.col("until") - F.col("at")).alias("ms"))


def stage_times(events: DataFrame) -> DataFrame:
    """(stage, n, mean_ms) of (stage, ms), longest first."""
    return events.groupBy("stage").agg(F.count("*").alias("n"), F.avg("ms").alias("mean_ms")).orderBy(F.desc("mean_ms"), "stage")


def last_failures(events: DataFrame, limit: int = 20) -> DataFrame:
    return events.orderBy(F.desc("at"), F.desc("id")).limit(limit)
