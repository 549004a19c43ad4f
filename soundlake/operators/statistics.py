"""Percentile ranks of descriptors inside their own collection.

Every descriptor has a histogram of 100 cells over a fixed range. Ranks are
derived from the histograms, never stored, so a collection that grows is ranked
anew by one grouped count and a broadcast of 400 numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import clamp

CELLS, LEAST_FOR_RANKS, LEAST_FOR_REFERENCE = 100, 50, 8
#: The range of each descriptor's histogram.
RANGES = {"loudness": (0.0, 0.5), "brightness_hz": (0.0, 5000.0), "crest": (1.5, 15.0), "dance_raw": (0.0, 1.0)}


def cell(value: Column, lo: float, hi: float) -> Column:
    """0 to 99; values outside the range fall into the first and last cells."""
    return F.least(F.lit(CELLS - 1), F.greatest(F.lit(0), F.floor((value - lo) / (hi - lo) * CELLS))).cast("int")


def histograms(tracks: DataFrame) -> DataFrame:
    """(descriptor, cell, n) of the analysed rows; infinite values and NaN don't count."""
    parts = F.array(*(F.struct(F.lit(d).alias("descriptor"), F.col(d).cast("double").alias("v"), cell(F.col(d), *r).alias("cell")) for d, r in RANGES.items()))
    long = tracks.where("analysed").select(F.explode(parts).alias("p")).select("p.*")
    return long.where(F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < float("inf"))).groupBy("descriptor", "cell").agg(F.count("*").alias("n"))


def cumulative(hist: DataFrame) -> DataFrame:
    """(descriptor, cell, n, below, total): at most 400 rows."""
    w = Window.partitionBy("descriptor")
    return hist.withColumns({"below": F.coalesce(F.sum("n").over(w.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "total": F.sum("n").over(w)})


def _row(hist: DataFrame) -> DataFrame:
    """One row: for each descriptor its total, and arrays of 100 counts and of counts below."""
    each = hist.groupBy("descriptor").agg(F.map_from_entries(F.collect_list(F.struct("cell", "n"))).alias("cells"), F.sum("n").alias("total"))  # at most 100 cells
    one = each.agg(F.map_from_entries(F.collect_list(F.struct("descriptor", F.struct("cells", "total").alias("h")))).alias("of"))

    def arrays(d: str) -> list[Column]:
        h = F.try_element_at("of", F.lit(d))
        counts = F.transform(F.sequence(F.lit(0), F.lit(CELLS - 1)), lambda i: F.coalesce(F.try_element_at(h["cells"], i), F.lit(0).cast("long")))
        below = F.transform(F.sequence(F.lit(0), F.lit(CELLS - 1)), lambda i: F.aggregate(F.slice(counts, F.lit(1), i), F.lit(0).cast("long"), lambda a, n: a + n))
        return [counts.alias(f"n_{d}"), below.alias(f"below_{d}"), F.coalesce(h["total"], F.lit(0)).alias(f"total_{d}")]

    return one.select(*(c for d in RANGES for c in arrays(d)))


def percentile(value: Column, counts: Column, below: Column, total: Column, lo: float, hi: float) -> Column:
    """Rank of a value, linear inside its cell; half if nothing is known."""
    width = (hi - lo) / CELLS
    b = cell(value, lo, hi)
    inside = clamp((F.greatest(F.lit(lo), F.least(F.lit(hi), value)) - (lo + b * width)) / width)
    known = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")) & (total > 0)
    return F.when(known, clamp((F.try_element_at(below, b + 1) + F.try_element_at(counts, b + 1) * inside) / total)).otherwise(0.5)


def rerank(tracks: DataFrame) -> DataFrame:
    """tracks with energy, brightness, compression and danceability from 0 to 1, and whether they are provisional (fewer than 50 rows, so taken from the ranges)."""
    both = tracks.crossJoin(F.broadcast(_row(histograms(tracks))))  # one row of 804 numbers
    few = F.col("total_loudness") < LEAST_FOR_RANKS

    def rank(d: str) -> Column:
        lo, hi = RANGES[d]
        linear = F.when(F.col(d).isNull() | F.isnan(d), 0.5).otherwise(clamp((F.col(d) - lo) / (hi - lo)))
        return F.when(F.col("analysed"), F.when(few, linear).otherwise(percentile(F.col(d), F.col(f"n_{d}"), F.col(f"below_{d}"), F.col(f"total_{d}"), lo, hi)))

    ranks = {"energy": rank("loudness"), "brightness": rank("brightness_hz"), "compression": 1 - rank("crest"), "danceability": rank("dance_raw"), "provisional": F.when(F.col("analysed"), few)}
    return both.select(*tracks.columns, *(c.alias(n) for n, c in ranks.items()))


def value_at(hist: DataFrame, descriptor: str, p: float) -> DataFrame:
    """One row (value, total): the descriptor's value at rank p; null for an empty histogram."""
    lo, hi = RANGES[descriptor]
    width = (hi - lo) / CELLS
    rows = cumulative(hist.where(F.col("descriptor") == descriptor)).where("n > 0")
    wanted = min(1.0, max(0.0, p)) * F.col("total")
    at = lo + (F.col("cell") + clamp((wanted - F.col("below")) / F.col("n"))) * width
    return rows.agg(F.min_by(F.when(F.col("below") + F.col("n") >= wanted, at), F.when(F.col("below") + F.col("n") >= wanted, F.col("cell"))).alias("value"), F.max("total").alias("total"))


def reference_level(tracks: DataFrame) -> DataFrame:
    """One row (reference_db): the median loudness; null below 8 recordings."""
    return value_at(histograms(tracks), "loudness", 0.5).select(F.when(F.col("total") >= LEAST_FOR_REFERENCE, 20 * F.log10("value")).alias("reference_db"))
