"""The shape of a collection: tempo, keys, decades, totals, and what is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codes, keys
from ..functions.names import duration_words

#: The tempo axis, and the confidences below which tempo and key don't count.
SLOT, LOWEST, HIGHEST, LEAST_CONFIDENCE, LEAST_STRENGTH, GAP_SLOTS = 10, 60, 200, 0.3, 0.5, 2
STATUSES = ("pending", "decoding", "analyzing", "done", "failed", "unsupported")


def place_of() -> Column:
    return keys.place(F.col("key_root"), F.col("key_scale"))


def _counts() -> Column:
    return F.col("analysed") & (F.col("bpm_confidence") >= LEAST_CONFIDENCE) & (F.col("bpm") >= LOWEST) & (F.col("bpm") < HIGHEST)


def tempo_histogram(tracks: DataFrame) -> DataFrame:
    """(from_bpm, to_bpm, n) for all 14 slots."""
    counted = tracks.where(_counts())
    counts = counted.groupBy((F.floor(F.col("bpm") / SLOT) * SLOT).cast("int").alias("from_bpm")).agg(F.count("*").alias("c"))
    axis = tracks.sparkSession.range(LOWEST, HIGHEST, SLOT).select(F.col("id").cast("int").alias("from_bpm"))
    return axis.join(F.broadcast(counts), "from_bpm", "left").select("from_bpm", (F.col("from_bpm") + SLOT).alias("to_bpm"), F.coalesce("c", F.lit(0)).cast("long").alias("n"))


def key_wheel(tracks: DataFrame) -> DataFrame:
    """(place, camelot, n) for all 24 codes."""
    counts = tracks.where(F.col("analysed") & (F.col("key_strength") >= LEAST_STRENGTH)).groupBy(place_of().alias("place")).agg(F.count("*").alias("c"))
    axis = tracks.sparkSession.range(keys.PLACES).select(F.col("id").cast("int").alias("place"))
    return axis.join(F.broadcast(counts), "place", "left").select("place", keys.code(F.col("place")).alias("camelot"), F.coalesce("c", F.lit(0)).cast("long").alias("n"))


def decades(tracks: DataFrame) -> DataFrame:
    return tracks.where("analysed AND year BETWEEN 1900 AND 2100").groupBy((F.floor(F.col("year") / 10) * 10).cast("int").alias("decade")).agg(F.count("*").alias("n"))


def totals(tracks: DataFrame) -> DataFrame:
    """One row: rows, analysed rows, and the playing time of the analysed ones."""
    return tracks.agg(F.count("*").alias("total"), F.count_if("analysed").alias("analysed"), F.sum(F.when(F.col("analysed"), F.coalesce("duration_sec", F.lit(0.0))).otherwise(0.0)).alias("playing_sec"))


def status_counts(tracks: DataFrame) -> DataFrame:
    axis = tracks.sparkSession.createDataFrame([(s,) for s in STATUSES], "status string")
    return axis.join(F.broadcast(tracks.groupBy("status").agg(F.count("*").alias("c"))), "status", "left").select("status", F.coalesce("c", F.lit(0)).cast("long").alias("n"))


def tempo_slots(tracks: DataFrame, by: str) -> DataFrame:
    """(who, from_bpm, to_bpm, n) of the occupied slots for each value of a column."""
    counted = tracks.where(F.col(by).isNotNull() & _counts()).groupBy(F.col(by).alias("who"), (F.floor(F.col("bpm") / SLOT) * SLOT).cast("int").alias("from_bpm")).agg(F.count("*").alias("n"))
    return counted.select("who", "from_bpm", (F.col("from_bpm") + SLOT).alias("to_bpm"), "n")


def tempo_gaps(histogram: DataFrame, by: str | None = None) -> DataFrame:
    """(from_bpm, to_bpm) of runs of at least two empty slots between occupied ones, from a histogram of 14 rows, or of 14 for each value of a column, which then comes first."""
    who = [by] if by else []
    following = F.lead("from_bpm").over(Window.partitionBy(*(who or [F.lit(0)])).orderBy("from_bpm"))
    return histogram.where("n > 0").select(*who, F.col("to_bpm").alias("from_bpm"), following.alias("to_bpm")).where(F.col("to_bpm") - F.col("from_bpm") >= GAP_SLOTS * SLOT)


def densest_band(histogram: DataFrame) -> DataFrame:
    """(from_bpm, to_bpm, share): the narrowest run of slots with half the recordings, the first on ties; no row if none counts."""
    w = Window.orderBy("from_bpm")
    sums = histogram.select("from_bpm", "to_bpm", "n", F.sum("n").over(w).alias("upto"), F.sum("n").over(Window.partitionBy()).alias("total"))
    left = sums.select(F.col("from_bpm").alias("lo"), (F.col("upto") - F.col("n")).alias("before"))
    runs = sums.join(left, F.col("lo") <= F.col("from_bpm")).withColumn("inside", F.col("upto") - F.col("before")).where("total > 0 AND inside * 2 >= total")  # at most 105 rows
    best = runs.agg(F.min(F.struct((F.col("to_bpm") - F.col("lo")).alias("width"), F.col("to_bpm").alias("hi"), F.col("lo"), F.col("inside"), F.col("total"))).alias("b")).where("b IS NOT NULL")
    return best.select(F.col("b.lo").alias("from_bpm"), F.col("b.hi").alias("to_bpm"), F.floor(F.col("b.inside") * 100 / F.col("b.total") + 0.5).cast("long").alias("share"))


def _occupied(tracks: DataFrame, by: str | None) -> DataFrame:
    """(who, place, n) of codes with recordings; at most 24 rows each."""
    who = F.col(by) if by else F.lit("all")
    rows = tracks.where(F.col("analysed") & (F.col("key_strength") >= LEAST_STRENGTH)).select(who.alias("who"), place_of().alias("place"))
    return rows.where("who IS NOT NULL").groupBy("who", "place").agg(F.count("*").alias("n"))


def _with_islands(tracks: DataFrame, by: str | None) -> DataFrame:
    """(who, place, n, held, island): island is the least place that steps to compatible, occupied codes reach."""
    rows = _occupied(tracks, by)
    held = rows.groupBy("who").agg(F.collect_set("place").alias("held"))  # at most 24 places
    step = lambda seen, _: F.array_intersect(F.array_distinct(F.concat(seen, F.flatten(F.transform(seen, keys.compatible)))), F.col("held"))
    reach = F.aggregate(F.sequence(F.lit(1), F.lit(keys.PLACES - 1)), F.array(F.col("place")), step)
    return rows.join(held, "who").withColumn("island", F.array_min(reach))


def key_islands(tracks: DataFrame, by: str | None = None) -> DataFrame:
    """(who, ord, island, codes, n): groups of codes that can be mixed into each other, largest first, for the collection or for each value of a column."""
    got = _with_islands(tracks, by).groupBy("who", "island").agg(F.array_join(F.transform(F.array_sort(F.collect_list("place")), keys.code), ",").alias("codes"), F.sum("n").alias("n"))
    ranked = got.withColumn("ord", F.row_number().over(Window.partitionBy("who").orderBy(F.desc("n"), "island")) - 1)  # at most 24 of one
    return ranked.select("who", "ord", keys.code(F.col("island")).alias("island"), "codes", "n")


def key_bridges(tracks: DataFrame, by: str | None = None) -> DataFrame:
    """(who, ord, camelot, joins): empty codes whose neighbours lie in at least two islands, those that join most first."""
    placed = _with_islands(tracks, by)
    near = placed.select("who", "held", "island", F.explode(keys.compatible(F.col("place"))).alias("place")).where(~F.array_contains("held", F.col("place")))
    joined = near.groupBy("who", "place").agg(F.count_distinct("island").alias("joins")).where("joins >= 2")
    ranked = joined.withColumn("ord", F.row_number().over(Window.partitionBy("who").orderBy(F.desc("joins"), "place")) - 1)
    return ranked.select("who", "ord", keys.code(F.col("place")).alias("camelot"), "joins")


def arrays(tracks: DataFrame) -> DataFrame:
    """One row (analysed, tempo, keys): the histograms as arrays of 14 and 24 counts."""
    ordered = lambda df, by: df.agg(F.transform(F.array_sort(F.collect_list(F.struct(by, "n"))), lambda s: s["n"]).alias("a"))
    tempo, wheel = ordered(tempo_histogram(tracks), "from_bpm").withColumnRenamed("a", "tempo"), ordered(key_wheel(tracks), "place").withColumnRenamed("a", "keys")
    return totals(tracks).select("analysed").crossJoin(tempo).crossJoin(wheel)  # rows of one


def shape_code(tracks: DataFrame) -> DataFrame:
    """One row (code): 57 characters that carry both histograms."""
    return arrays(tracks).select(codes.shape_code(F.col("analysed"), F.col("tempo"), F.col("keys")).alias("code"))


def findings(tracks: DataFrame) -> DataFrame:
    """(ord, finding): at most four sentences about the collection."""
    band = densest_band(tempo_histogram(tracks)).agg(F.first("from_bpm").alias("lo"), F.first("to_bpm").alias("hi"), F.first("share").alias("share"))
    wheel = key_wheel(tracks).agg(
        F.sum("n").alias("counted"),
        F.count_if(F.col("n") > 0).alias("used"),
        F.max_by("camelot", F.struct("n", -F.col("place"))).alias("top"),
        F.max("n").alias("most"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("n") == 0, F.col("place")))), keys.code), ", ").alias("empty"),
    )
    # The four sentences.
    said = [
        F.when(F.col("playing_sec") > 0, F.concat(duration_words(F.col("playing_sec")), F.lit(" of music, measured rather than tagged."))),
        F.when(F.col("lo").isNotNull(), F.format_string("Half of it lives between %d and %d BPM — %d%% inside that band.", "lo", "hi", "share")),
        F.when(F.col("counted") > 0, F.format_string("%s is the most common key, at %d%%. %d of the wheel's 24 positions are occupied.", "top", F.floor(F.try_divide(F.col("most") * 100, F.col("counted")) + 0.5), "used")),
        F.when((F.col("counted") > 0) & F.col("used").between(18, 23), F.concat(F.lit("Nothing at all in "), F.col("empty"), F.lit("."))),
    ]
    row = totals(tracks).crossJoin(band).crossJoin(wheel)  # rows of one
    return row.select(F.posexplode(F.slice(F.array_compact(F.array(*said)), 1, 4)).alias("ord", "finding"))
