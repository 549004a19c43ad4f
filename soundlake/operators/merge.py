"""Changes to a stored collection as queries: discovery, results, imports, accepted names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The version that analyses carry now, and how often a failed one is tried.
CURRENT_VERSION, MAX_ATTEMPTS = 6, 3
#: What an import never changes in a stored row, besides columns that start with given_.
LOCAL = ("id", "k", "root_id", "rel_path", "file_name", "folder", "size", "last_modified", "added_at", "artist", "album_artist", "title", "album", "track_no", "genre", "year")


def upsert_discovered(tracks: DataFrame, found: DataFrame) -> DataFrame:
    """tracks (id, rel_path, file_name, status, version) after a scan found (id, rel_path, file_name): new files wait for analysis, moved ones get their path, stale ones wait again. Column action tells which."""
    t, f = tracks.alias("t"), found.select("id", F.col("rel_path").alias("new_path"), F.col("file_name").alias("new_name")).dropDuplicates(["id"]).alias("f")
    rows = t.join(f, "id", "full_outer")
    new, seen = F.col("t.status").isNull(), F.col("new_path").isNotNull()
    stale = seen & ~new & (F.col("version") < CURRENT_VERSION) & (F.col("t.status") != "pending")
    action = F.when(new, "new").when(stale, "requeued").when(seen & (F.col("new_path") != F.col("rel_path")), "moved").otherwise("kept")
    return rows.select("id", F.coalesce("new_path", "rel_path").alias("rel_path"), F.coalesce("new_name", "file_name").alias("file_name"), F.when(new | stale, "pending").otherwise(F.col("t.status")).alias("status"), F.coalesce("version", F.lit(0)).alias("version"), action.alias("action"))


def with_failures(tracks: DataFrame, failures: DataFrame) -> DataFrame:
    """tracks (id, status, attempts, error) after failures (id, message, retryable): one attempt more, failed or unsupported. A failure without a message counts, too, and leaves none."""
    f = failures.groupBy("id").agg(F.max("message").alias("new_error"), F.bool_or("retryable").alias("again"), F.lit(True).alias("hit"))
    rows = tracks.join(f, "id", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    values = {"status": F.when(F.col("hit"), F.when(F.col("again"), "failed").otherwise("unsupported")).otherwise(F.col("status")), "attempts": F.coalesce("attempts", F.lit(0)) + F.col("hit").cast("int"), "error": F.when(F.col("hit"), F.col("new_error")).otherwise(F.col("error"))}
    return rows.withColumns(values).select(*tracks.columns)


#: Columns of a stored row and the descriptors that they take.
MEASURED = {"bpm": "bpm", "bpm_confidence": "bpm_confidence", "key_root": "key.root", "key_scale": "key.scale", "key_strength": "key.strength", "key_margin": "key.margin", "loudness": "rms", "brightness_hz": "centroid_hz", "crest": "crest", "dance_raw": "danceability"} | {c: c for c in ("tail_ratio", "head_ratio", "clipped_ratio", "side_ratio", "sound_start_sec", "sound_end_sec", "intro_beat_sec", "outro_beat_sec", "fingerprint")}


def with_status(tracks: DataFrame, changes: DataFrame) -> DataFrame:
    """tracks (id, status, error) after changes of status (id, status, message), one a recording; the message takes the place of the error, a null one too."""
    c = changes.select("id", F.col("status").alias("new_status"), F.col("message").alias("new_error"), F.lit(True).alias("hit"))
    rows = tracks.join(c, "id", "left")
    hit = F.coalesce("hit", F.lit(False))
    return rows.withColumns({"error": F.when(hit, F.col("new_error")).otherwise(F.col("error")), "status": F.coalesce("new_status", "status")}).select(*tracks.columns)


def waiting(tracks: DataFrame, unreachable: DataFrame, limit: int) -> DataFrame:
    """The next recordings to analyse, without those (id) whose files can't be reached."""
    return pending(tracks.join(unreachable.select("id"), "id", "left_anti"), limit)


def pending(tracks: DataFrame, limit: int) -> DataFrame:
    """The next recordings to analyse, in order of id."""
    return tracks.where("status = 'pending'").orderBy("id").limit(limit)


def with_results(tracks: DataFrame, measured: DataFrame) -> DataFrame:
    """tracks after an analysis gave measured rows (id, status, duration_sec and descriptors as recordings.extract names them).

    A status of ok makes a row done, of the current version; of any other, unsupported with that status as its error and one attempt more, and its former descriptors stay. Ranks are to be made anew then (statistics.rerank).
    """
    got = measured.withColumn("came", F.lit(True)).alias("m")
    rows = tracks.alias("t").join(got, F.col("t.id") == F.col("m.id"), "left")
    came, ok = F.col("came").isNotNull(), F.coalesce(F.col("m.status") == "ok", F.lit(False))
    fixed = {"status": F.when(ok, "done").otherwise("unsupported"), "analysed": ok | F.coalesce(F.col("t.analysed"), F.lit(False)), "version": F.when(ok, CURRENT_VERSION).otherwise(F.col("t.version")), "duration_sec": F.coalesce("m.duration_sec", "t.duration_sec")}
    if "error" in tracks.columns:
        fixed["error"] = F.when(~ok, F.col("m.status"))
    if "attempts" in tracks.columns:
        fixed["attempts"] = F.coalesce(F.col("t.attempts"), F.lit(0)) + F.when(ok, 0).otherwise(1)

    def value(c: str) -> Column:
        old = F.col(f"t.{c}")
        if c in fixed:
            return F.when(came, fixed[c]).otherwise(old).alias(c)
        if c in MEASURED and MEASURED[c].split(".")[0] in measured.columns:
            return F.when(ok, F.col(f"m.{MEASURED[c]}")).otherwise(old).alias(c)
        return old

    return rows.select(*map(value, tracks.columns))


def retryable(code: Column, attempts: Column) -> Column:
    return (code == "algorithm") & (attempts < MAX_ATTEMPTS)


def replaces(new_analysed: Column, new_version: Column, old_analysed: Column, old_version: Column) -> Column:
    """An import takes the place of a stored analysis only with one that is missing here or of a newer version. Nulls stand for no analysis and version 0."""
    new, old = (F.coalesce(c, F.lit(False)) for c in (new_analysed, old_analysed))
    return new & (~old | (F.coalesce(new_version, F.lit(0)) > F.coalesce(old_version, F.lit(0))))


def import_actions(tracks: DataFrame, incoming: DataFrame) -> DataFrame:
    """(id, action) of incoming rows (id, analysed, version): added, improved or unchanged."""
    old = tracks.select("id", F.lit(True).alias("stored"), F.col("analysed").alias("old_analysed"), F.col("version").alias("old_version"))
    rows = incoming.join(old, "id", "left")
    better = replaces(F.col("analysed"), F.col("version"), F.col("old_analysed"), F.col("old_version"))
    return rows.select("id", F.when(F.col("stored").isNull(), "added").when(better, "improved").otherwise("unchanged").alias("action"))


def merged(tracks: DataFrame, incoming: DataFrame) -> DataFrame:
    """tracks after an import: new rows are added as they come; of a stored row only the analysis and what belongs to it changes, and only for a better one.

    Path, file, tags and given names of a stored row stay, and its length if the import has none. Of rows that repeat an id in the import the newest version counts. Columns of tracks that the import lacks are null in new rows and stay in stored ones.
    """
    have = {c.lower(): c for c in incoming.columns}
    latest = F.max_by(F.struct(*incoming.columns), F.struct(F.coalesce("analysed", F.lit(False)), F.coalesce("version", F.lit(0))))
    new = incoming.groupBy("id").agg(latest.alias("n"), F.lit(True).alias("came"))
    rows = tracks.withColumn("here", F.lit(True)).alias("t").join(new, "id", "full_outer")
    stored = F.col("here").isNotNull()
    better = F.col("came").isNotNull() & replaces(F.col("n.analysed"), F.col("n.version"), F.col("t.analysed"), F.col("t.version"))

    def value(c: str) -> Column:
        if c == "id":
            return F.col("id")
        old, got = F.col(f"t.{c}"), F.col(f"n.{have[c.lower()]}") if c.lower() in have else F.lit(None)
        if c.lower() not in have or c in LOCAL or c.startswith("given_"):
            return F.when(stored, old).otherwise(got).alias(c)
        return F.when(stored & ~better, old).otherwise(F.coalesce(got, old) if c == "duration_sec" else got).alias(c)

    return rows.select(*map(value, tracks.columns))


def new_plays(plays: DataFrame, incoming: DataFrame) -> DataFrame:
    """incoming plays not stored yet; rows that repeat inside the import all stay."""
    return incoming.join(plays.select("track_id", "played_at").distinct(), ["track_id", "played_at"], "left_anti")


def forget_names(tracks: DataFrame) -> DataFrame:
    return tracks.withColumns({c: F.lit(None).cast("string") for c in tracks.columns if c.startswith("given_")})


def lookup(tracks: DataFrame, ids: list[str]) -> DataFrame:
    """The recordings asked for, in the order asked."""
    wanted = tracks.sparkSession.createDataFrame(list(enumerate(ids)), "pos long, id string")
    return tracks.join(F.broadcast(wanted), "id").orderBy("pos")
