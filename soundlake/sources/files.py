"""Folders, playlists, want lists and library files as DataFrames, and back."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import names

#: Header cells, in lower case, that name the columns of a want list.
TITLE_COLUMNS = ("track name", "title", "name", "song", "track", "track title")
ARTIST_COLUMNS = ("artist name(s)", "artist name", "artist", "artists", "album artist")
EXPORT_FORMAT, EXPORT_VERSION, HEAD_BYTES = "soundlake-library", 1, 1 << 20


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where none is named, one of our own in local mode, while a cluster gets an error."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="soundlake-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written to the checkpoint folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def content_id(content, size):
    """Names a file by its first MiB and its size."""
    return F.sha2(F.concat(F.substring(content, 1, HEAD_BYTES), F.encode(F.concat(F.lit(":"), size.cast("string")), "UTF-8")), 256)


def audio_files(spark: SparkSession, folder: str) -> DataFrame:
    """Spark's binary files (path, modificationTime, length, content) that are audio files below a folder; content is read only where it is used."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.*").load(folder)
    return found.where(names.is_audio(F.element_at(F.split("path", "/"), -1)))


def described(folder: str) -> list[Column]:
    """rel_path, file_name, size and last_modified of binary files below a folder."""
    rel = F.substring_index("path", folder.rstrip("/").split("://")[-1].split(":")[-1] + "/", -1)
    return [rel.alias("rel_path"), F.element_at(F.split("path", "/"), -1).alias("file_name"), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("last_modified")]


def scan_folder(spark: SparkSession, folder: str, root_id: str | None = None) -> DataFrame:
    """(id, rel_path, file_name, size, last_modified) of the audio files below a folder, and root_id where one is given."""
    rows = audio_files(spark, folder).select(content_id(F.col("content"), F.col("length")).alias("id"), *described(folder))
    return rows if root_id is None else rows.withColumn("root_id", F.lit(root_id))


def lines_of(texts: DataFrame) -> DataFrame:
    """(list_id, pos, line) of whole texts (list_id, text); null texts have no lines."""
    return texts.where("text IS NOT NULL").select("list_id", F.posexplode(F.split("text", "\r\n|\n|\r")).alias("pos", "line"))


def parse_m3u(texts: DataFrame) -> DataFrame:
    """(list_id, ord, path, title, length_sec) of playlists (list_id, text). A length below 0 is null; remarks between a title line and its path change nothing."""
    rows = lines_of(texts).select("list_id", "pos", names.trimmed(F.col("line")).alias("line")).where("line <> ''")
    info, path = F.col("line").rlike("(?i)^#EXTINF:"), ~F.col("line").startswith("#")
    w = Window.partitionBy("list_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)  # the lines of one playlist
    blocks = rows.withColumns({"entry": F.coalesce(F.sum(path.cast("int")).over(w), F.lit(0)), "info": F.when(info, F.regexp_replace("line", "(?i)^#EXTINF:", "")), "path": F.when(path, F.col("line"))})
    got = blocks.groupBy("list_id", "entry").agg(F.max_by("info", F.when(F.col("info").isNotNull(), F.col("pos"))).alias("info"), F.max("path").alias("path")).where("path IS NOT NULL")
    seconds = F.expr("try_cast(trim(regexp_extract(info, '^([^,]*)', 1)) AS double)")
    title = names.trimmed(F.regexp_extract("info", "^[^,]*,(.*)$", 1))
    return got.select("list_id", F.col("entry").alias("ord"), "path", F.when(title != "", title).alias("title"), F.when(seconds >= 0, seconds).alias("length_sec"))


def _remark(text):
    return F.concat(F.lit("# "), F.trim(F.regexp_replace(text, r"[\r\n]+", " ")))


def build_m3u(entries: DataFrame) -> DataFrame:
    """(list_id, text): playlists of entries (list_id, ord, path, title, length_sec, note)."""
    seconds = F.coalesce(F.floor(F.col("length_sec") + 0.5), F.lit(-1)).cast("string")
    info = F.when(F.col("title").isNotNull() | F.col("length_sec").isNotNull(), F.concat(F.lit("#EXTINF:"), seconds, F.lit(","), F.coalesce("title", "path")))
    block = F.concat_ws("\n", _remark(F.col("note")), info, F.col("path"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", block.alias("b")))), lambda s: s["b"]), "\n")  # the entries of one playlist
    return entries.groupBy("list_id").agg(F.concat(F.lit("#EXTM3U\n"), body, F.lit("\n")).alias("text"))


def wants_from_lines(texts: DataFrame) -> DataFrame:
    """(list_id, ord, artist, title) of pasted lines; blank ones and remarks don't count."""
    rows = lines_of(texts).where((names.trimmed(F.col("line")) != "") & ~F.ltrim(F.col("line")).startswith("#"))
    artist, title = names.split_name(F.col("line"))
    return rows.select("list_id", F.col("pos").alias("ord"), artist.alias("artist"), title.alias("title"))


def wants_from_m3u(texts: DataFrame) -> DataFrame:
    """(list_id, ord, artist, title) of playlists: their title lines, or else the file names."""
    stem = F.regexp_replace(F.element_at(F.split(names.decoded(F.col("path")), "/"), -1), r"\.[^.]+$", "")
    line = F.coalesce("title", stem)
    artist, title = names.split_name(line)
    return parse_m3u(texts).where(names.trimmed(line) != "").select("list_id", "ord", artist.alias("artist"), title.alias("title"))


def wants_from_csv(spark: SparkSession, path: str) -> DataFrame | None:
    """(artist, title) of a table whose header names a title column, else None; of several artists the first counts."""
    table = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    named = {c.strip().lower(): c for c in reversed(table.columns)}
    title = next((named[c] for c in named if c in TITLE_COLUMNS), None)
    if title is None or len(table.columns) < 2:
        return None
    artist = next((named[c] for c in named if c in ARTIST_COLUMNS), None)
    first = F.trim(F.split(table[artist], ",")[0]) if artist else F.lit(None).cast("string")
    return table.select(F.when(first != "", first).alias("artist"), F.trim(table[title]).alias("title")).where("title <> ''")


def csv_rows(texts: DataFrame) -> DataFrame:
    """(list_id, row, cells) of tables (list_id, text): a quoted cell may hold commas, line ends (as \\n) and doubled quotes.

    A line begins a row if the quotes of all lines before it are even in number; inside a
    row every other piece between quotes is quoted. NUL characters are dropped.
    """
    whole = texts.select("list_id", F.replace("text", F.lit("\0"), F.lit("")).alias("text"))
    lines = lines_of(whole).withColumn("quotes", F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit(""))))
    w = Window.partitionBy("list_id").orderBy("pos")  # the lines of one table
    before = F.coalesce(F.sum("quotes").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begun = lines.withColumn("begins", (before % 2 == 0).cast("int")).withColumn("row", F.sum("begins").over(w) - 1)
    joined = begun.groupBy("list_id", "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda s: s["line"]), "\n").alias("line"))  # the lines of one row
    parts = F.split("line", '"')
    told = F.transform(parts, lambda x, i: F.when(i % 2 == 1, x).when((x == "") & (i > 0) & (i < F.size(parts) - 1), '"').otherwise(F.replace(x, F.lit(","), F.lit("\0"))))
    return joined.select("list_id", F.col("row").cast("long").alias("row"), F.split(F.array_join(told, ""), "\0").alias("cells"))


def csv_heads(texts: DataFrame) -> DataFrame:
    """(list_id, title_at, artist_at) of texts that are tables: their first row has two cells or more, and names a title column."""
    return _heads(csv_rows(texts.select("list_id", names.trimmed(F.col("text")).alias("text"))))


def _heads(rows: DataFrame) -> DataFrame:
    cells = F.transform("cells", lambda c: F.lower(names.trimmed(c)))
    place = lambda wanted: F.array_min(F.filter(F.transform(cells, lambda c, i: F.when(c.isin(*wanted), i)), lambda i: i.isNotNull()))
    return rows.where("row = 0").select("list_id", F.when(F.size("cells") >= 2, place(TITLE_COLUMNS)).alias("title_at"), place(ARTIST_COLUMNS).alias("artist_at")).where("title_at IS NOT NULL")


def wants_from_tables(texts: DataFrame) -> DataFrame:
    """(list_id, ord, artist, title) of tables whose first row names a title column among two or more; of several artists in a cell the first counts. Other texts give no rows."""
    rows = csv_rows(texts.select("list_id", names.trimmed(F.col("text")).alias("text")))
    heads = _heads(rows)
    cell = lambda at: names.trimmed(F.coalesce(F.try_element_at("cells", F.col(at) + 1), F.lit("")))
    told = rows.where("row > 0").join(heads, "list_id").select("list_id", F.col("row").alias("ord"), cell("artist_at").alias("artists"), cell("title_at").alias("title")).where("title <> ''")
    return told.select("list_id", "ord", F.when(F.col("artists") != "", names.trimmed(F.split("artists", ",")[0])).alias("artist"), "title")


def wants_of(texts: DataFrame) -> DataFrame:
    """(list_id, ord, artist, title) of want lists (list_id, text) in whatever form each came: a playlist, a table or lines. Nulls and blanks have no rows."""
    some = texts.where(names.trimmed(F.coalesce("text", F.lit(""))) != "")
    m3u = F.col("text").rlike("(?im)^#EXTM3U|^#EXTINF:")
    tables = wants_from_tables(some.where(~m3u))
    lines = wants_from_lines(some.where(~m3u).join(csv_heads(some.where(~m3u)), "list_id", "left_anti"))
    return wants_from_m3u(some.where(m3u)).select("list_id", F.col("ord").cast("long").alias("ord"), "artist", "title").unionByName(tables).unionByName(lines.withColumn("ord", F.col("ord").cast("long")))


def kind_of_list(text):
    """How a want list is written: m3u, csv or lines."""
    head = F.lower(F.regexp_extract(text, r"^\s*([^\r\n]*)", 1))
    cells = F.transform(F.split(head, ","), lambda c: F.trim(F.replace(c, F.lit('"'), F.lit(""))))
    csv = (F.size(cells) >= 2) & F.arrays_overlap(cells, F.array(*map(F.lit, TITLE_COLUMNS)))
    return F.when(text.rlike("(?im)^#EXTM3U|^#EXTINF:"), "m3u").when(csv, "csv").otherwise("lines")


def export_rows(tracks: DataFrame, plays: DataFrame) -> DataFrame:
    """(kind, json): a row for the header, for every recording and every play, to be written as text."""
    head = tracks.sparkSession.range(1).select(F.lit("head").alias("kind"), F.to_json(F.struct(F.lit(EXPORT_FORMAT).alias("format"), F.lit(EXPORT_VERSION).alias("version"))).alias("json"))
    body = [df.select(F.lit(kind).alias("kind"), F.to_json(F.struct(*cols)).alias("json")) for df, kind, cols in ((tracks, "track", tracks.columns), (plays, "play", ["track_id", "played_at", "played_sec"]))]
    return head.unionByName(body[0]).unionByName(body[1])


def import_rows(rows: DataFrame, track_schema: str) -> tuple[DataFrame, DataFrame]:
    """(tracks, plays) of exported rows; ValueError if the header is missing or of another format."""
    head = rows.where("kind = 'head'").select(F.get_json_object("json", "$.format").alias("f"), F.get_json_object("json", "$.version").alias("v")).first()
    if head is None or (head.f, head.v) != (EXPORT_FORMAT, str(EXPORT_VERSION)):
        raise ValueError("not an export of this library")
    typed = lambda kind, schema: rows.where(F.col("kind") == kind).select(F.from_json("json", schema).alias("s")).select("s.*")
    return typed("track", track_schema), typed("play", "track_id string, played_at timestamp, played_sec double")
