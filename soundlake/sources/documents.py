"""A library as one JSON document: an object with a head, an array of tracks and one of plays.

The document may be too long for a row. It is read as text in pieces that end at closing
braces, which Spark splits over tasks, and turned into rows by running sums: how many
quotes lie before a piece tells whether it begins inside a string, how many braces tell
how deep it lies, and pieces between two returns to the first level are one element.
Sums run inside a split, and from split to split over one row for each.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .files import EXPORT_FORMAT, EXPORT_VERSION, checkpointed

TRACKS, PLAYS = "tracks", "playHistory"
_PLAY = "trackId string, playedAt long, playedSec double"


def _outside(text: Column, inside: Column) -> Column:
    """What of a piece lies outside strings; inside: 1 if it begins in one."""
    return F.array_join(F.filter(F.split(F.regexp_replace(text, r"\\.", ""), '"'), lambda _, i: (i + inside) % 2 == 0), "")


def _running(pieces: DataFrame, value: str, name: str) -> DataFrame:
    """pieces with the sum of value over all pieces before, in order of (split, n)."""
    sums = pieces.groupBy("split").agg(F.sum(value).alias("s"))
    past = sums.select("split", F.coalesce(F.sum("s").over(Window.orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("past"))  # a row for each split of the file
    inner = F.coalesce(F.sum(value).over(Window.partitionBy("split").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # the pieces of one split
    return pieces.withColumn("inner", inner).join(F.broadcast(past), "split").withColumn(name, F.col("inner") + F.col("past")).drop("inner", "past")


#: Text without braces outside strings; and a document's or an element's text before its first brace on the first level.
_FLAT = r'(?:[^"{]++|"(?:[^"\\]++|\\.)*+")*+'
_FIRST, _LATER = rf"(?s)^({_FLAT}\{{{_FLAT})(\{{.*)$", rf"(?s)^({_FLAT})(\{{.*)$"


def elements(spark: SparkSession, path: str) -> DataFrame:
    """(ord, before, json): the objects on the second level of a document, in order, and the text between each and the one before; text after which no object comes has a null json.

    path: a file, or a folder of files whose texts, in order of their names, are the document; those must end with a line end.
    """
    raw = spark.read.option("lineSep", "}").text(path)
    pieces = checkpointed(raw.select(F.struct("_metadata.file_path", "_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("n"), F.col("value").alias("text")))
    last = pieces.groupBy("split.file_path").agg(F.max(F.struct("split", "n")).alias("last")).select("last.*", F.lit(True).alias("is_last"))  # a row a file
    told = _running(pieces.join(F.broadcast(last), ["split", "n"], "left").withColumn("quotes", F.length(F.regexp_replace(F.regexp_replace("text", r"\\.", ""), '[^"]', ""))), "quotes", "seen")
    out = _outside(F.col("text"), F.col("seen") % 2)
    closes = ((F.col("quotes") + F.col("seen")) % 2 == 0) & F.col("is_last").isNull()  # the last piece of a file has no brace after it
    deep = told.withColumns({"closes": closes.cast("int"), "step": F.length(F.regexp_replace(out, r"[^{]", "")) - closes.cast("int")})
    placed = _running(deep, "step", "level").withColumn("home", ((F.col("closes") == 1) & (F.col("level") + F.col("step") <= 1)).cast("int"))
    text = F.aggregate(F.array_sort(F.collect_list(F.struct("split", "n", F.concat("text", F.when(F.col("is_last").isNull(), "}").otherwise("")).alias("text")))), F.lit(""), lambda a, s: F.concat(a, s["text"]))
    whole = _running(placed, "home", "ord").groupBy("ord").agg(text.alias("text"))  # the pieces of one element
    met = F.when(F.col("ord") == 0, F.col("text").rlike(_FIRST)).otherwise(F.col("text").rlike(_LATER))
    part = lambda k: F.when(F.col("ord") == 0, F.regexp_extract("text", _FIRST, k)).otherwise(F.regexp_extract("text", _LATER, k))
    return whole.select("ord", F.when(met, part(1)).otherwise(F.col("text")).alias("before"), F.when(met, part(2)).alias("json"))


def read_document(spark: SparkSession, path: str, track_schema: str) -> tuple[dict, DataFrame, DataFrame]:
    """(head, tracks, plays) of a document; ValueError if it is no export of this library, of another version, or without tracks."""
    rows = checkpointed(elements(spark, path))
    between = rows.where(~F.col("before").rlike(r"^\s*,\s*$")).orderBy("ord").collect()  # one for each key of the document
    skeleton = "".join(r.before + ("{}" if r.json is not None and r.before.rstrip().endswith(":") else "") for r in between)
    head = None
    for end in ("", "}"):  # a last brace that nothing follows is not told from none
        try:
            head = json.loads(skeleton + end)
            break
        except ValueError:
            pass
    if head is None:
        raise ValueError("that file is not JSON")
    if not isinstance(head, dict) or head.get("format") != EXPORT_FORMAT:
        raise ValueError("not an export of this library")
    if head.get("version") != EXPORT_VERSION:
        raise ValueError(f"this export is version {head.get('version')}; version {EXPORT_VERSION} is read")
    if not isinstance(head.get(TRACKS), list):
        raise ValueError("the export has no tracks in it")
    opened = [(r.ord, re.search(r'"(\w+)"\s*:\s*\[\s*$', r.before)) for r in between if r.json is not None]

    def section(name: str, schema: str) -> DataFrame:
        inside = F.lit(False)
        for k, (at, m) in enumerate(opened):
            if m and m[1] == name:
                until = opened[k + 1][0] if k + 1 < len(opened) else None
                inside = inside | ((F.col("ord") >= at) & (F.lit(True) if until is None else F.col("ord") < until))
        return rows.where(inside & F.col("json").isNotNull()).select(F.from_json("json", schema).alias("s")).select("s.*")

    told = {k: head[k] if isinstance(head.get(k), int) else 0 for k in ("exportedAt", "analysisVersion")}
    plays = section(PLAYS, _PLAY).select(F.col("trackId").alias("track_id"), F.timestamp_millis("playedAt").alias("played_at"), F.col("playedSec").alias("played_sec"))
    return told, section(TRACKS, track_schema), plays


def document(tracks: DataFrame, plays: DataFrame, exported_at: int, analysis_version: int) -> DataFrame:
    """(part, key, value): the lines of a document in order of part and key: tracks by id, plays by time. exported_at: in ms."""
    line = lambda part, value: tracks.sparkSession.range(1).select(F.lit(part).alias("part"), F.lit("").alias("key"), F.lit(value).alias("value"))
    head = json.dumps({"format": EXPORT_FORMAT, "version": EXPORT_VERSION, "exportedAt": exported_at, "analysisVersion": analysis_version})[:-1]

    def body(rows: DataFrame, part: int, key: Column, value: Column) -> DataFrame:
        told = rows.select(F.lit(part).alias("part"), F.concat_ws(" ", key, F.xxhash64(value).cast("string")).alias("key"), value.alias("value"))
        first = told.agg(F.min("key").alias("first"), F.count_if(F.col("key").isNull()).alias("none"))  # one row
        n = F.row_number().over(Window.partitionBy("key").orderBy("value"))  # rows that are equal
        return told.withColumn("n", n).crossJoin(F.broadcast(first)).select("part", "key", F.concat(F.when((F.col("key") == F.col("first")) & (F.col("n") == 1), "").otherwise(","), "value").alias("value"))

    played = F.struct(F.col("track_id").alias("trackId"), F.unix_millis("played_at").alias("playedAt"), F.col("played_sec").alias("playedSec"))
    parts = [line(0, f'{head},"{TRACKS}":['), body(tracks, 1, F.col("id"), F.to_json(F.struct(*tracks.columns))), line(2, f'],"{PLAYS}":['), body(plays, 3, F.date_format("played_at", "yyyyMMddHHmmssSSS"), F.to_json(played)), line(4, "]}")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_document(tracks: DataFrame, plays: DataFrame, folder: str, exported_at: int, analysis_version: int) -> None:
    """A folder of text files that are the document one after the other, in order of their names."""
    comma = F.regexp_extract("value", "^(,?)", 1)
    lines = document(tracks, plays, exported_at, analysis_version).orderBy("part", "key", comma)
    lines.select("value").write.text(folder)
