"""Two collections side by side, known by the shares of their tempo and key slots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codes, keys
from . import shape

#: A slot is present from a share of .02, absent below .005, a band of theirs is told from .08.
PRESENT, ABSENT, TOLD = 0.02, 0.005, 0.08


def own_shape(tracks: DataFrame) -> DataFrame:
    """One row (analysed, tempo, keys) of shares."""
    return shape.arrays(tracks).select("analysed", codes.shares(F.col("tempo")).alias("tempo"), codes.shares(F.col("keys")).alias("keys"))


def decoded_shape(spark, code: str) -> DataFrame:
    """The same from a code; no row if the text is none."""
    return spark.range(1).select(codes.shape_of(F.lit(code)).alias("s")).where("s IS NOT NULL").select("s.*")


def _slots(mine: DataFrame, theirs: DataFrame, facet: str) -> DataFrame:
    """(slot, ours, other) of two rows of shares."""
    pairs = F.arrays_zip(F.col("o").alias("ours"), F.col("t").alias("other"))
    return mine.select(F.col(facet).alias("o")).crossJoin(theirs.select(F.col(facet).alias("t"))).select(F.posexplode(pairs).alias("slot", "p")).select("slot", F.coalesce("p.ours", F.lit(0.0)).alias("ours"), F.coalesce("p.other", F.lit(0.0)).alias("other"))


def overlaps(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """One row (tempo_overlap, key_overlap): sums of the lesser shares."""
    one = lambda facet, name: _slots(mine, theirs, facet).agg(F.sum(F.least("ours", "other")).alias(name))
    return one("tempo", "tempo_overlap").crossJoin(one("keys", "key_overlap"))


_KEEP = {
    "common": (lambda: (F.col("ours") >= PRESENT) & (F.col("other") >= PRESENT), lambda: F.least("ours", "other")),
    "theirs": (lambda: (F.col("other") >= PRESENT) & (F.col("ours") < ABSENT), lambda: F.col("other")),
    "yours": (lambda: (F.col("ours") >= PRESENT) & (F.col("other") < ABSENT), lambda: F.col("ours")),
}


def tempo_bands(mine: DataFrame, theirs: DataFrame, which: str) -> DataFrame:
    """(from_bpm, to_bpm, share) of runs of slots that are common, theirs alone or yours alone; 14 slots at most."""
    keep, share = _KEEP[which]
    kept = _slots(mine, theirs, "tempo").where(keep()).select("slot", share().alias("s"))
    runs = kept.withColumn("run", F.col("slot") - F.row_number().over(Window.orderBy("slot"))).groupBy("run").agg(F.min("slot").alias("lo"), F.max("slot").alias("hi"), F.sum("s").alias("share"))
    return runs.select((F.col("lo") * shape.SLOT + shape.LOWEST).alias("from_bpm"), (F.col("hi") * shape.SLOT + shape.LOWEST + shape.SLOT).alias("to_bpm"), "share")


def key_sets(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """(which, place, camelot): codes that are common, theirs alone or yours alone."""
    slots = _slots(mine, theirs, "keys")
    which = F.array_compact(F.array(*(F.when(keep(), name) for name, (keep, _) in _KEEP.items())))
    return slots.select(F.explode(which).alias("which"), F.col("slot").cast("int").alias("place"), keys.code(F.col("slot")).alias("camelot"))


def findings(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """(ord, finding): at most four sentences about two shapes (analysed, tempo, keys), each a row."""
    widest = lambda which, p: tempo_bands(mine, theirs, which).agg(F.max_by(F.struct("from_bpm", "to_bpm", "share"), F.struct("share", -F.col("from_bpm"))).alias(p))
    listed = lambda which, p: key_sets(mine, theirs).where(F.col("which") == which).agg(F.count("*").alias(f"n_{p}"), F.array_join(F.transform(F.array_sort(F.collect_list("place")), keys.code), ", ").alias(p))
    row = overlaps(mine, theirs).crossJoin(mine.select(F.col("analysed").alias("ours"))).crossJoin(theirs.select(F.col("analysed").alias("other")))
    for part in (widest("common", "band"), widest("theirs", "alone"), listed("common", "both"), listed("theirs", "only")):
        row = row.crossJoin(part)  # rows of one
    percent = lambda c: F.concat(F.floor(c * 100 + 0.5).cast("string"), F.lit("%"))
    text = lambda c: F.col(c).cast("string")
    # The sentences.
    said = (
        F.concat(F.lit("Their "), text("other"), F.lit(" against your "), text("ours"), F.lit(": "), percent(F.col("tempo_overlap")), F.lit(" of the tempo curve is shared, and "), percent(F.col("key_overlap")), F.lit(" of the wheel.")),
        F.when(F.col("band").isNull(), "There is no tempo you are both at home in.").otherwise(F.concat(F.lit("You are both at home between "), text("band.from_bpm"), F.lit(" and "), text("band.to_bpm"), F.lit(" BPM"), F.when(F.col("n_both").between(1, 4), F.concat(F.lit(", in "), F.col("both"))).otherwise(""), F.lit("."))),
        F.when(F.col("alone.share") >= TOLD, F.concat(percent(F.col("alone.share")), F.lit(" of theirs is between "), text("alone.from_bpm"), F.lit(" and "), text("alone.to_bpm"), F.lit(" BPM, where you have next to nothing."))),
        F.when(F.col("n_only").between(1, 6), F.concat(F.lit("They keep music in "), F.col("only"), F.lit(" and you do not."))),
    )
    return row.select(F.posexplode(F.array_compact(F.array(*said))).alias("ord", "finding"))


def common_ground(tracks: DataFrame, mine: DataFrame, theirs: DataFrame, limit: int = 20) -> DataFrame:
    """Recordings where both collections live: of the busiest common bands, in order of tempo. Ties go by id."""
    bands = tempo_bands(mine, theirs, "common").select(F.col("from_bpm").alias("lo"), F.col("to_bpm").alias("hi"), F.col("share").alias("weight"))
    codes_ = key_sets(mine, theirs).where("which = 'common'").select(F.col("camelot").alias("code"))
    no_bands, no_codes = bands.isEmpty(), codes_.isEmpty()
    rows = tracks.where("analysed").withColumn("code", keys.code(shape.place_of()))
    if no_bands and no_codes:
        return rows.where("false").select("id", "bpm", "code", F.lit(0.0).alias("weight"))
    if not no_codes:
        rows = rows.join(F.broadcast(codes_), "code", "left_semi")  # at most 24 rows
    if no_bands:
        rows = rows.withColumn("weight", F.lit(0.0))
    else:
        rows = rows.join(F.broadcast(bands), (F.col("bpm") >= F.col("lo")) & (F.col("bpm") < F.col("hi")))  # at most 14 rows
    return rows.select("id", "bpm", "code", "weight").orderBy(F.desc("weight"), "id").limit(limit).orderBy("bpm", "id")
