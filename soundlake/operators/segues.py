"""Recordings that run into each other: neighbours in a folder with no silence between."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names

ENDS_RUNNING = STARTS_RUNNING = 0.5


def neighbours(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Same folder, different file, and the next number of one album or of the file names."""
    album = (a["album_key"] == b["album_key"]) & (a["album_key"] != "")
    by_tag = (a["track_no"] + 1 == b["track_no"]) & album
    by_name = a["leading"] + 1 == b["leading"]
    return (a["folder"] == b["folder"]) & (a["file_name"] != b["file_name"]) & (F.coalesce(by_tag, F.lit(False)) | F.coalesce(by_name, F.lit(False)))


def find_segues(tracks: DataFrame) -> DataFrame:
    """(from_id, to_id) of files that follow each other in a folder and run on; the folder is that of rel_path where no column tells it."""
    if "folder" not in tracks.columns:
        tracks = tracks.withColumn("folder", F.when(F.contains("rel_path", F.lit("/")), F.regexp_replace("rel_path", "/[^/]*$", "")).otherwise(""))
    rows = tracks.where(F.col("analysed") & F.col("tail_ratio").isNotNull() & F.col("head_ratio").isNotNull()).select(
        "id", "folder", "file_name", "track_no", "tail_ratio", "head_ratio", names.fold(F.col("album")).alias("album_key"), names.leading_number(F.col("file_name")).alias("leading"), names.natural(F.col("file_name")).alias("file_key")
    )
    w = Window.partitionBy("folder").orderBy(F.col("track_no").asc_nulls_last(), "file_key", "id")
    fields = ("id", "folder", "file_name", "track_no", "head_ratio", "album_key", "leading")
    pairs = rows.withColumn("to", F.lead(F.struct(*fields)).over(w)).where("to IS NOT NULL")
    a, b = ({f: F.col(p + f) for f in fields} for p in ("", "to."))
    runs = neighbours(a, b) & (F.col("tail_ratio") > ENDS_RUNNING) & (F.col("to.head_ratio") > STARTS_RUNNING)
    return pairs.where(runs).select(F.col("id").alias("from_id"), F.col("to.id").alias("to_id"))
