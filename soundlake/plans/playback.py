"""What a player needs of each position of a playlist: grids, level, edges, what comes next and whether it runs on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import levels, names
from ..operators.segues import ENDS_RUNNING, STARTS_RUNNING, neighbours


def _grid(beat: str) -> Column:
    """struct(bpm, beat_sec), or null without a tempo or a beat."""
    return F.when(F.col("analysed") & (F.col("bpm") > 0) & F.col(beat).isNotNull(), F.struct("bpm", F.col(beat).alias("beat_sec")))


def playback(entries: DataFrame, tracks: DataFrame, reference: DataFrame) -> DataFrame:
    """(list_id, pos, id, title, artist, duration_sec, intro, outro, trim_db, sound_start_sec, sound_end_sec, next_id, remaining, joined) of playlists (list_id, pos, id).

    reference: one row (reference_db). remaining: positions after this one; joined: it runs
    straight into the next. An id that is no recording keeps its position and has no more than that.
    """
    fields = ("folder", "file_name", "track_no", "album_key", "leading", "head_ratio", "tail_ratio")
    t = tracks.withColumns({"album_key": names.fold(F.col("album")), "leading": names.leading_number(F.col("file_name"))})
    if "folder" not in tracks.columns:
        t = t.withColumn("folder", F.when(F.contains("rel_path", F.lit("/")), F.regexp_replace("rel_path", "/[^/]*$", "")).otherwise(""))
    level = levels.to_db(F.col("loudness"))
    trim = F.coalesce(F.when(F.col("analysed") & F.col("reference_db").isNotNull(), levels.trim_db(F.col("reference_db"), level, F.col("crest"))), F.lit(0.0))
    side = F.when(F.col("analysed") & F.col("head_ratio").isNotNull() & F.col("tail_ratio").isNotNull(), F.struct(*fields))
    known = lambda c: F.when(F.col("analysed"), F.col(c)).alias(c)
    told = t.crossJoin(F.broadcast(reference.select("reference_db"))).select(  # one row
        "id", F.coalesce("title", "file_name").alias("title"), F.coalesce("artist", F.lit("")).alias("artist"), "duration_sec", _grid("intro_beat_sec").alias("intro"), _grid("outro_beat_sec").alias("outro"), trim.alias("trim_db"), known("sound_start_sec"), known("sound_end_sec"), side.alias("side")
    )
    w = Window.partitionBy("list_id").orderBy("pos")  # the positions of one playlist
    rows = entries.select("list_id", "pos", "id").join(told, "id", "left").withColumns({"next_id": F.lead("id").over(w), "next": F.lead("side").over(w), "remaining": F.count("*").over(Window.partitionBy("list_id")) - F.row_number().over(w)})
    a, b = ({f: F.col(f"{p}.{f}") for f in fields} for p in ("side", "next"))
    joined = F.coalesce(neighbours(a, b) & (a["tail_ratio"] > ENDS_RUNNING) & (b["head_ratio"] > STARTS_RUNNING), F.lit(False))
    return rows.withColumn("joined", joined).select("list_id", "pos", "id", "title", "artist", "duration_sec", "intro", "outro", "trim_db", "sound_start_sec", "sound_end_sec", "next_id", "remaining", "joined")
