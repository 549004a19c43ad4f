"""Streams of plays: counts, sessions, exactly-once history, and when to move on to the next recording.

Each function takes a streaming or a batch DataFrame of (track_id, played_at,
played_sec) unless it says otherwise.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import levels
from ..operators.statistics import histograms
from ..sources.files import checkpoint_folder

#: How late plays may come, a session's gap, a fade's least multiple of a track, lead of a join.
LATE, GAP, LEAST_MULTIPLE, SEGUE_LEAD_SEC = "4 hours", "30 minutes", 3, 0.3


def play_counts(plays: DataFrame) -> DataFrame:
    """(id, plays): for complete or update mode."""
    return plays.groupBy(F.col("track_id").alias("id")).agg(F.count("*").alias("plays"))


def hourly(plays: DataFrame, slide: str | None = None) -> DataFrame:
    """(start, end, plays, seconds) of windows of an hour, sliding if ``slide`` is given; plays later than the watermark are dropped."""
    at = F.window("played_at", "1 hour", slide) if slide else F.window("played_at", "1 hour")
    out = plays.withWatermark("played_at", LATE).groupBy(at.alias("w")).agg(F.count("*").alias("plays"), F.sum("played_sec").alias("seconds"))
    return out.select("w.start", "w.end", "plays", "seconds")


def sessions(events: DataFrame, who: str, gap: str = GAP) -> DataFrame:
    """(who, start, end, plays): runs of plays with no gap of half an hour. events also has the column ``who``."""
    out = events.withWatermark("played_at", LATE).groupBy(who, F.session_window("played_at", gap).alias("w")).agg(F.count("*").alias("plays"))
    return out.select(who, "w.start", "w.end", "plays")


def once(plays: DataFrame) -> DataFrame:
    """Plays without repeats of (track_id, played_at) inside the watermark."""
    return plays.withWatermark("played_at", LATE).dropDuplicatesWithinWatermark(["track_id", "played_at"])


def growing_histograms(tracks: DataFrame) -> DataFrame:
    """(descriptor, cell, n) of a stream of analysed recordings, for complete mode; ranks are always taken at reading."""
    return histograms(tracks)


def moves(ticks: DataFrame) -> DataFrame:
    """(player, track_id, elapsed_sec): one row when a recording is to be followed by the next, once for each that plays.

    ticks: (player, seq, track_id, elapsed_sec, duration_sec, sound_end_sec, fade_sec, joined, has_next). Recordings shorter than three fades are left to end, unless they run into the next one.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fired = state.get[0] if state.exists else None
        due = [r for b in batches for r in zip(b["seq"].tolist(), b["track_id"].tolist(), b["elapsed_sec"].tolist(), strict=True)]
        due.sort(key=lambda r: r[0])
        out = []
        for _, track, elapsed in due:
            if track != fired:
                fired = track
                out.append((track, elapsed))
        if out:
            state.update((fired,))
            yield pd.DataFrame({"player": [key[0]] * len(out), "track_id": [t for t, _ in out], "elapsed_sec": [e for _, e in out]})

    joined = F.coalesce(F.col("joined"), F.lit(False))
    fade = F.when(joined, SEGUE_LEAD_SEC).otherwise(F.col("fade_sec"))
    end = levels.effective_end(F.col("sound_end_sec"), F.col("duration_sec"))
    due = (fade > 0) & (F.col("duration_sec") > 0) & (F.col("elapsed_sec") >= 0) & (joined | (end >= fade * LEAST_MULTIPLE)) & (end - F.col("elapsed_sec") <= fade) & F.col("has_next")
    rows = ticks.where(F.col("track_id").isNotNull() & F.coalesce(due, F.lit(False))).select("player", "seq", "track_id", "elapsed_sec")  # no other changes what was told last
    return rows.groupBy("player").applyInPandasWithState(step, "player string, track_id string, elapsed_sec double", "fired string", "append", GroupStateTimeout.NoTimeout)


def run_once(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All that a stream gives for what its source holds now, written to the checkpoint folder.

    Each batch has a folder of its own, so a batch that is repeated after a failure replaces itself; in complete mode the last result replaces all before.
    """
    spark, folder = stream.sparkSession, f"{checkpoint_folder(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    spark.createDataFrame([], stream.schema).write.parquet(f"{folder}/out/batch=-1")

    def keep(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/out/batch={0 if mode == 'complete' else batch}")

    stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out").select(*stream.columns)


def append_plays(stream: DataFrame, folder: str, checkpoint: str) -> None:
    """Appends what a stream of plays gives to a table: a folder for each batch, so a batch that is repeated after a failure replaces itself."""

    def keep(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/batch={batch}")

    stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
