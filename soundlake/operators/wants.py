"""Want lists and playlists held against a collection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names
from ..functions.scores import js_round
from . import shape


def name_index(tracks: DataFrame, given: DataFrame | None = None, proposals: DataFrame | None = None) -> DataFrame:
    """(artist_key, title_key, id, via, rank): every name a recording goes by, in the order in which names count.

    Recordings in order of id, each with its accepted name before its tags; proposals come last.
    """
    source = lambda df, via, late, second: df.select("id", "artist", "title", via.alias("via"), F.struct(F.lit(late).alias("late"), F.col("id"), F.lit(second).alias("second")).alias("order"))
    rows = source(tracks, F.lit("tags"), 0, 1)
    for more, late in ((given, 0), (proposals, 1)):
        if more is not None:
            filled = more.select("id", F.col("artist").alias("a"), F.col("title").alias("t"), "source").join(tracks.select("id", "artist", "title"), "id")
            rows = rows.unionByName(source(filled.select("id", F.coalesce("a", "artist").alias("artist"), F.coalesce("t", "title").alias("title"), "source"), F.col("source"), late, 0))
    return rows.select("id", "via", "order", F.coalesce(names.fold(F.col("artist")), F.lit("")).alias("artist_key"), F.coalesce(names.fold(F.col("title")), F.lit("")).alias("title_key")).where("title_key <> ''")


def match_wants(wants: DataFrame, tracks: DataFrame, given: DataFrame | None = None, proposals: DataFrame | None = None) -> DataFrame:
    """(ord, artist, title, id, via): wants (ord, artist, title) with the recording found, or nulls.

    By artist and title; then by each part of a list of artists, in order; without an artist, by a title that only one recording has.
    """
    index = name_index(tracks, given, proposals)
    full = index.where("artist_key <> ''").groupBy("artist_key", "title_key").agg(F.min_by(F.struct("id", "via"), "order").alias("hit"))
    alone = index.groupBy("title_key").agg(F.count_distinct("id").alias("ids"), F.min_by(F.struct("id", "via"), "order").alias("hit")).where("ids = 1").drop("ids")
    keyed = wants.select("ord", "artist", "title", names.fold(F.col("title")).alias("title_key"))
    parts = F.concat(F.array(F.col("artist")), F.split(F.col("artist"), r"\s*[,;]\s*|\s+/\s+"))
    tries = keyed.where("artist IS NOT NULL").select("ord", "title_key", F.posexplode(parts).alias("at", "part")).select("ord", "title_key", "at", names.fold(F.col("part")).alias("artist_key"))
    by_name = tries.join(full, ["artist_key", "title_key"]).groupBy("ord").agg(F.min_by("hit", "at").alias("hit"))
    by_title = keyed.where("artist IS NULL").join(alone, "title_key").select("ord", "hit")
    hits = by_name.unionByName(by_title)
    return keyed.join(hits, "ord", "left").select("ord", "artist", "title", F.col("hit.id").alias("id"), F.col("hit.via").alias("via"))


def ambiguous_titles(tracks: DataFrame) -> DataFrame:
    """(title_key, ids) of titles that several recordings have."""
    return name_index(tracks).groupBy("title_key").agg(F.count_distinct("id").alias("ids")).where("ids > 1")


def artist_notes(tracks: DataFrame) -> DataFrame:
    """(artist_key, owned, median_bpm, codes): what the collection has of each artist; the upper median of reliable tempos, the three commonest codes (first seen first on ties)."""
    rows = tracks.where(~names.blank(F.col("artist"))).select("id", "bpm", "bpm_confidence", "analysed", F.when(F.col("analysed"), shape.place_of()).alias("place"), names.fold(F.col("artist")).alias("artist_key")).where("artist_key <> ''")
    # the upper median by rank, with no list per artist
    w = Window.partitionBy("artist_key")
    reliable = rows.where("analysed AND bpm > 0 AND bpm_confidence >= 0.3").select("artist_key", "bpm", F.row_number().over(w.orderBy("bpm", "id")).alias("r"), F.count("*").over(w).alias("n"))
    median = reliable.where(F.col("r") == F.floor(F.col("n") / 2) + 1).select("artist_key", js_round(F.col("bpm")).cast("long").alias("median_bpm"))
    counts = rows.where("place IS NOT NULL").groupBy("artist_key", "place").agg(F.count("*").alias("c"), F.min("id").alias("seen"))
    top = counts.groupBy("artist_key").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("c"), "seen", "place"))), 1, 3).alias("t"))  # at most 24 places
    codes = top.select("artist_key", F.array_join(F.transform("t", lambda s: shape.keys.code(s["place"])), ",").alias("codes"))
    return rows.groupBy("artist_key").agg(F.count("*").alias("owned")).join(median, "artist_key", "left").join(codes, "artist_key", "left").select("artist_key", "owned", "median_bpm", "codes")


def artist_islands(tracks: DataFrame) -> DataFrame:
    """(artist_key, island_n, island_codes) of artists whose commonest codes all lie in one island that is not the collection's largest; no row if the wheel is in one piece."""
    islands = shape.key_islands(tracks).select("ord", "n", "codes")
    if islands.limit(2).count() < 2:  # at most 24 rows
        return artist_notes(tracks).where("false").select("artist_key", F.lit(0).cast("long").alias("island_n"), F.lit("").alias("island_codes"))
    notes = artist_notes(tracks).where("codes IS NOT NULL").select("artist_key", F.split("codes", ",").alias("own"))
    placed = notes.join(F.broadcast(islands.where("ord > 0")), F.size(F.array_except("own", F.split("codes", ","))) == 0)
    return placed.select("artist_key", F.col("n").cast("long").alias("island_n"), F.col("codes").alias("island_codes"))


def with_notes(matched: DataFrame, tracks: DataFrame) -> DataFrame:
    """matched wants, those that are missing with what the collection has of their artist: owned, median_bpm, codes, island_n, island_codes."""
    notes = artist_notes(tracks).join(artist_islands(tracks), "artist_key", "left")
    keyed = matched.withColumn("artist_key", F.when(F.col("id").isNull(), names.fold(F.col("artist"))))
    return keyed.join(notes, "artist_key", "left").drop("artist_key")


def _median(rows: DataFrame, name: str) -> DataFrame:
    """One row: the upper median of reliable tempos, exact, from the counts of each tempo."""
    counts = rows.where("analysed AND bpm > 0 AND bpm_confidence >= 0.3").groupBy("bpm").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    # quarters of a beat a minute first, of which there are few; then the tempos of one of them
    cells = counts.groupBy(js_round(F.col("bpm") * 4).alias("cell")).agg(F.sum("n").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    hit = cells.withColumn("before", before).crossJoin(total).where((F.col("before") <= F.floor(F.col("total") / 2)) & (F.col("before") + F.col("n") > F.floor(F.col("total") / 2)))
    inside = counts.join(F.broadcast(hit.select("cell", "before", "total")), js_round(F.col("bpm") * 4) == F.col("cell"))
    upto = F.sum("n").over(Window.orderBy("bpm")) + F.col("before")
    return inside.withColumn("upto", upto).where(F.col("upto") > F.floor(F.col("total") / 2)).agg(F.min("bpm").alias(name))


def want_findings(matched: DataFrame, tracks: DataFrame) -> DataFrame:
    """(ord, finding): at most three sentences about the wants that are owned, held against the collection."""
    own = matched.where("id IS NOT NULL").select("ord", "id").join(tracks, "id")
    tempo = [_rounded(_median(df, name), name) for df, name in ((own, "theirs"), (tracks, "ours"))]
    codes = own.where("analysed").groupBy(shape.place_of().alias("place")).agg(F.min("ord").alias("o"))
    codes = codes.agg(F.count("*").alias("codes"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "place"))), lambda s: shape.keys.code(s["place"])), ", ").alias("listed"))  # at most 24
    row = want_summary(matched).withColumn("total", F.col("owned") + F.col("missing")).crossJoin(tempo[0]).crossJoin(tempo[1]).crossJoin(codes)  # rows of one
    text = lambda c: F.col(c).cast("string")
    # The sentences.
    said = (
        F.when(F.col("owned") == 0, F.concat(F.lit("None of these "), text("total"), F.lit(" are here."))).otherwise(F.concat(text("owned"), F.lit(" of "), text("total"), F.lit(" are already on the shelf."))),
        F.when((F.col("owned") >= 3) & (F.abs(F.col("theirs") - F.col("ours")) >= 6), F.concat(F.lit("The ones you have sit around "), text("theirs"), F.lit(" BPM, against "), text("ours"), F.lit(" for the library as a whole."))),
        F.when((F.col("owned") >= 3) & F.col("codes").between(1, 6), F.concat(F.lit("They occupy "), text("codes"), F.lit(" of the wheel's 24 positions: "), F.col("listed"), F.lit("."))),
    )
    return row.where("total > 0").select(F.posexplode(F.array_compact(F.array(*said))).alias("ord", "finding"))


def _rounded(one: DataFrame, name: str) -> DataFrame:
    return one.select(js_round(F.col(name)).cast("long").alias(name))


def want_summary(matched: DataFrame) -> DataFrame:
    """One row: wants that are owned, missing, and without an artist."""
    return matched.agg(F.count("id").alias("owned"), F.count_if(F.col("id").isNull()).alias("missing"), F.count_if(F.col("artist").isNull()).alias("title_only"))


def match_playlist(entries: DataFrame, tracks: DataFrame) -> DataFrame:
    """(pos, path, id, tier): playlist entries (pos, path) matched by path, by a path that ends in the other, or by file name.

    The middle tier compares trailing parts of both paths by equality, so it needs no comparison of all with all. Ties go by id; of equal file names the last id counts.
    """
    want = entries.select("pos", "path", names.decoded(F.col("path")).alias("p"))
    own = tracks.select("id", "rel_path", "file_name")
    exact = want.join(own.groupBy("rel_path").agg(F.max("id").alias("id")), F.col("p") == F.col("rel_path")).select("pos", "id")
    tails = lambda c: F.transform(F.sequence(F.lit(2), F.greatest(F.lit(2), F.size(F.split(c, "/")))), lambda i: F.array_join(F.slice(F.split(c, "/"), i, F.size(F.split(c, "/"))), "/"))
    longer = want.select("pos", F.explode(tails(F.col("p"))).alias("k")).where("k <> ''").join(own, F.col("k") == F.col("rel_path")).select("pos", "id")
    shorter = own.select("id", F.explode(tails(F.col("rel_path"))).alias("k")).where("k <> ''").join(want, F.col("k") == F.col("p")).select("pos", "id")
    suffix = longer.unionByName(shorter).groupBy("pos").agg(F.min("id").alias("id"))
    file = want.withColumn("k", F.element_at(F.split("p", "/"), -1)).join(own.groupBy(F.col("file_name").alias("k")).agg(F.max("id").alias("id")), "k").select("pos", "id")
    named = lambda df, n: df.select("pos", F.col("id").alias(n))
    rows = want.join(named(exact, "e"), "pos", "left").join(named(suffix, "s"), "pos", "left").join(named(file, "f"), "pos", "left")
    tier = F.when(F.col("e").isNotNull(), "path").when(F.col("s").isNotNull(), "suffix").when(F.col("f").isNotNull(), "file")
    return rows.select("pos", "path", F.coalesce("e", "s", "f").alias("id"), tier.alias("tier"))
