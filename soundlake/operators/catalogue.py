"""Names to pick recordings by, settings, and the whole report on a collection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import checkpointed
from . import health, identity, segues, shape

#: Fixed value: how many names a picker shows.
SHOWN = 60
#: How many rows of each list are shown at first.
LIMITS = {"health": 8, "duplicates": 12, "proposals": 10, "wants": 15, "common": 12, "catalogue": SHOWN, "segues": 10, "queue": 4}
#: Texts that can be looked for at once.
MOST_ASKED = 10_000


def first(rows: DataFrame, kind: str, limit: int | None = None) -> DataFrame:
    """The rows of an ordered list that are shown before the rest is asked for."""
    return rows.limit(LIMITS[kind] if limit is None else limit)


def labels(tracks: DataFrame) -> DataFrame:
    """(id, label) of analysed recordings, to be typed: artist and title, the file's name where there is no title; the second and later ones of a name, in order of id, carry their file's name, too."""
    title = F.coalesce("title", F.regexp_replace("file_name", r"\.[^.]+$", ""))
    base = F.when(F.col("artist").isNull(), title).otherwise(F.concat("artist", F.lit(" - "), title))
    rows = tracks.where("analysed").select("id", "file_name", base.alias("base"))
    nth = F.row_number().over(Window.partitionBy("base").orderBy("id"))
    return rows.withColumn("nth", nth).select("id", F.when(F.col("nth") == 1, F.col("base")).otherwise(F.concat("base", F.lit(" ("), F.col("file_name"), F.lit(")"))).alias("label"))


def shown(named: DataFrame, text: str, limit: int = SHOWN) -> DataFrame:
    """The first names, in order, that hold a text in either case; all names hold an empty one."""
    wanted = F.trim(F.lower(F.lit(text)))
    return named.where(F.contains(F.lower("label"), wanted)).orderBy(F.lower("label"), "label", "id").limit(limit)


def find(named: DataFrame, asked: DataFrame) -> DataFrame:
    """(ord, text, id): for each text asked (ord, text) the recording with that very name, else the only one whose name holds it in either case, else null.

    The texts asked go to every task, and each name is looked through for all of them, so there may be MOST_ASKED; ValueError for more.
    """
    if asked.limit(MOST_ASKED + 1).count() > MOST_ASKED:
        raise ValueError(f"more than {MOST_ASKED} texts are asked for at once")
    wanted = asked.select("ord", "text", F.trim("text").alias("w"))
    some = wanted.where("w <> ''")
    exact = some.join(named.groupBy("label").agg(F.min("id").alias("exact")), F.col("w") == F.col("label")).select("ord", "exact")
    near = named.join(F.broadcast(some), F.contains(F.lower("label"), F.lower("w"))).groupBy("ord").agg(F.min("id").alias("only"), F.count("*").alias("n")).where("n = 1").drop("n")
    return wanted.join(exact, "ord", "left").join(near, "ord", "left").select("ord", "text", F.coalesce("exact", "only").alias("id"))


def read_setting(settings: DataFrame, key: str, default: str | None = None) -> str | None:
    """The value of a key in (key, value), or the default."""
    row = settings.where(F.col("key") == key).select("value").first()
    return default if row is None else row.value


def write_setting(settings: DataFrame, key: str, value: str | None) -> DataFrame:
    """settings (key, value) with one key set."""
    return settings.where(F.col("key") != key).unionByName(settings.sparkSession.createDataFrame([(key, value)], "key string, value string"))


def report(tracks: DataFrame, recordings: DataFrame) -> dict[str, DataFrame]:
    """The whole report from one read of both tables: shape, gaps, keys, duplicates, findings about files, segues, names for files without tags, and names to pick by. recordings is what ``identity`` takes."""
    t, r = checkpointed(tracks), checkpointed(recordings)
    tempo = shape.tempo_histogram(t)
    pairs = checkpointed(identity.duplicate_pairs(r))  # made once for groups and verdicts
    groups = identity.components(pairs)
    return {
        "totals": shape.totals(t),
        "tempo": tempo,
        "tempo_gaps": shape.tempo_gaps(tempo),
        "keys": shape.key_wheel(t),
        "islands": shape.key_islands(t),
        "bridges": shape.key_bridges(t),
        "decades": shape.decades(t),
        "findings": shape.findings(t),
        "duplicates": identity.duplicate_groups(r, pairs=pairs, groups=groups),
        "verdicts": identity.duplicate_verdicts(r, pairs=pairs, groups=groups),
        "health": health.findings(t),
        "health_totals": health.totals(t),
        "segues": segues.find_segues(t),
        "proposals": identity.propose_names(r),
        "catalogue": labels(t),
    }
