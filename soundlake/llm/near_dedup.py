"""Near duplicates by min-max hashing, confirmed on full sets.

A document's set holds its distinct shingles of ``shingle`` words (A-Z in lower
case, cut at ASCII white space); with fewer words, all of them as one. Each
multiplier of the hashes serves as a permutation and gives two values, the least
and the greatest; ``band_perms`` permutations make a band, and a pair with
similarity 0.8 misses all ``bands`` with a probability of 3e-7 (less above 0.8).

Equal sets are one node, named by its least doc_id. Nodes that share a band are
candidates. Pairs inside a band are not listed. Each node meets one pivot of its
band, confirmed links are contracted to components, and only bands that still
hold several components go on, with another pivot.

What is left after ``pivot_rounds`` are pairs under a first pivot of which one at
least is not similar to it. Such a pair can only be similar if both differ from
the pivot in the same shingles: with d the size of a node's difference from the
pivot, n that of its set and r = (100 - percent) / (100 + percent), the two
differences share (g + g') / 2 shingles, g = d - r n, and that is above 0. So these
nodes are joined on the rarest shingles of their differences, as many as that
number of shared ones leaves open, and no similar pair is left out. A confirmation
compares the full sets.

Nulls: a null text is an empty set. An empty set is linked with nothing. A null
doc_id stays on its own, with a null component, and is kept. Rows that repeat a
doc_id are one node, each with its own set. Texts of any length are read whole;
other columns are not read. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import LOWER, SPACE, Block, Spans, blocks, blocks_of, grams, id_column, mix, text_buffers, words
from .components import components
from .shared import checkpointed, id_and_text

SHINGLE, PERCENT = 5, 80
BANDS, BAND_PERMS, PIVOT_ROUNDS, SALTS = 50, 3, 3, 32
_FACTORS = np.random.Generator(np.random.PCG64(11)).integers(1, 2**63, 1024, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def sets(block: Block, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each row's distinct shingles, sorted by both."""
    low = Block(block.ids, LOWER[block.data], block.offsets)
    w = words(low, ~SPACE)
    h = Spans(low.data)(w.starts, w.ends)
    rows, values = [], []
    if len(w) >= shingle:
        inside = w.row[: len(w) - shingle + 1] == w.row[shingle - 1 :]
        rows.append(w.row[: len(w) - shingle + 1][inside])
        values.append(grams(h, shingle)[inside])
    size = np.diff(w.first)
    for n in range(1, shingle):
        short = np.flatnonzero(size == n)
        if len(short):
            rows.append(short)
            values.append(mix(grams(h, n)[w.first[short]] + np.uint64(n)))
    if not rows:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    row, value = np.concatenate(rows), np.concatenate(values)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[new], value[new]


def _sketch(shingle: int, bands: int, band_perms: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for b in blocks(batch):
                row, value = sets(b, shingle)
                has, first = np.unique(row, return_index=True)
                size = np.zeros(len(b), np.int64)
                size[has] = np.diff(np.append(first, len(row)))
                keys = np.zeros((len(b), bands), np.uint64)
                whole = np.zeros((len(b), 2), np.uint64)
                if len(has):
                    for band in range(bands):
                        key = np.full(len(has), band + 1, np.uint64)
                        for p in range(band * band_perms, (band + 1) * band_perms):
                            v = (value * _FACTORS[p]) >> np.uint64(24)
                            key = mix(key ^ np.minimum.reduceat(v, first)) * np.uint64(3) ^ np.maximum.reduceat(v, first)
                        keys[has, band] = mix(key)
                    for lane, factor in enumerate((0x9FB21C651E98DF25, 0xD1B54A32D192ED03)):
                        whole[has, lane] = np.add.reduceat(mix(value * np.uint64(factor)), first)
                texts = [squeeze.compress(b.text(i)) for i in range(len(b))]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(b) + 1) * bands, pa.int32()), pa.array(keys.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([id_column(b.ids), pa.array(size), *(pa.array(whole[:, k].view(np.int64)) for k in (0, 1)), lists, pa.array(texts, pa.binary())], names=["doc_id", "n", "s0", "s1", "bands", "body"])

    return run


def _paired(part: pa.RecordBatch, shingle: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Both sets of every pair with compressed texts: (sizes left and right; row and hash of all their shingles, sorted)."""
    open_, side = zstandard.ZstdDecompressor(), []
    for name in ("left", "right"):
        raw = [open_.decompress(x) for x in part.column(name).to_pylist()]
        got = [(row + b.lo, value) for b in blocks_of(np.zeros(len(raw), np.int64), *text_buffers(pa.array(raw, pa.large_binary()))) for row, value in [sets(b, shingle)]]
        side.append([np.concatenate(x) for x in zip(*got, strict=True)])
    row, value = (np.concatenate([s[k] for s in side]) for k in (0, 1))
    order = np.lexsort((value, row))
    return [np.bincount(s[0], minlength=len(part)) for s in side], row[order], value[order]


def _similar(n: list[np.ndarray], both: np.ndarray, percent: int) -> np.ndarray:
    return 100 * both >= percent * (n[0] + n[1] - both)


def _confirm(shingle: int, percent: int):
    """Pairs (a, b, left, right) whose full sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 128):
                part = batch.slice(lo, 128)
                n, row, value = _paired(part, shingle)
                both = np.bincount(row[1:][(row[1:] == row[:-1]) & (value[1:] == value[:-1])], minlength=len(part))
                yield part.filter(pa.array(_similar(n, both, percent))).select(["a", "b"])

    return run


def _differences(shingle: int, percent: int):
    """Pairs (a, b, c_b, left, right): b's component and size, the size of the difference of both sets, whether they are similar, and a row for each shingle in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 128):
                part = batch.slice(lo, 128)
                n, row, value = _paired(part, shingle)
                twin = np.concatenate([(row[1:] == row[:-1]) & (value[1:] == value[:-1]), [False]]) if len(row) else np.empty(0, bool)
                both = np.bincount(row[twin], minlength=len(part))
                one = ~twin
                one[1:] &= ~twin[:-1]
                at = row[one]
                like = _similar(n, both, percent)
                columns = [part.column("a").take(pa.array(at)), part.column("b").take(pa.array(at)), part.column("c_b").take(pa.array(at)), *(pa.array(x[at]) for x in (n[0], n[1], n[0] + n[1] - 2 * both, like)), pa.array((value[one] >> np.uint64(32)).astype(np.uint32).view(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["p", "x", "c", "np", "n", "d", "like", "e"])

    return run


def _by_differences(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b) of nodes in different components, under one pivot, that share enough of their differences from it. rows: (p, x, c, np, n, d, like, e)."""
    r = F.lit((100 - percent) / (100 + percent))
    counts = rows.groupBy("p", "e").agg(F.count("*").alias("often"), (F.min("c") < F.max("c")).alias("several"))
    rare = Window.partitionBy("p", "x").orderBy("often", "e")  # no more than the shingles of two documents
    ranked = rows.join(counts, ["p", "e"]).withColumns({"rank": F.row_number().over(rare), "g": F.col("d") - r * F.col("n"), "w": F.greatest(F.lit(1.0), F.col("np") * r / 2)})
    ranked = checkpointed(ranked.withColumn("bin", F.floor(F.col("g") / F.col("w"))).where("several").drop("often", "several"))  # a shingle of one component's nodes links nothing
    first = lambda g, h: F.col("d") + 1 - F.greatest(F.lit(1), F.ceil((g + h) / 2 - 1e-6))
    held = ranked.where(F.col("rank") <= first(F.col("g"), F.col("np") * r)).select("p", "e", "bin", *(F.col(c).alias(f"{c}_") for c in ("x", "c", "n", "g", "d", "rank")))
    # sizes of differences in steps of a part of the pivot's size; each pivot's go to every salt, so that one with very many nodes is no single key
    bins = ranked.groupBy("p").agg(F.collect_set("bin").alias("bins")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = ranked.where("not like").drop("bin").withColumn("salt", F.pmod(F.xxhash64("x", "e"), F.lit(SALTS)).cast("int"))
    asked = salted.join(bins, ["p", "salt"]).withColumn("bin", F.explode("bins")).where(F.col("rank") <= first(F.col("g"), F.col("bin") * F.col("w")))
    shared = F.greatest(F.lit(1), F.ceil((F.col("g") + F.col("g_")) / 2 - 1e-6))
    near = (F.col("rank") <= F.col("d") + 1 - shared) & (F.col("rank_") <= F.col("d_") + 1 - shared) & (F.least("n", "n_") * 100 >= F.greatest("n", "n_") * percent)
    keys = ["p", "bin", "e"]
    # nodes of one component never meet: its name meets other names first
    apart = asked.select(*keys, "c").distinct().join(held.select(*keys, "c_").distinct(), keys).where("c <> c_")
    return asked.join(apart, [*keys, "c"]).join(held, [*keys, "c_"]).where(near).select(F.least("x", "x_").alias("a"), F.greatest("x", "x_").alias("b"))


def near_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS, band_perms: int = BAND_PERMS, pivot_rounds: int = PIVOT_ROUNDS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row."""
    rows = id_and_text(docs, doc_id, text)
    known = checkpointed(rows.mapInArrow(_sketch(shingle, bands, band_perms), "doc_id long, n long, s0 long, s1 long, bands array<long>, body binary"))
    linked = known.where("n > 0 and doc_id is not null")
    classes = linked.groupBy("s0", "s1", "n").agg(F.min("doc_id").alias("node"))
    member = checkpointed(linked.select("doc_id", "s0", "s1", "n").join(classes, ["s0", "s1", "n"]).select("doc_id", "s0", "s1", "n", "node"))
    # the row that stands for each class: rows that repeat it are equal
    heads = linked.join(member.where("doc_id = node").select("doc_id", "s0", "s1").distinct(), ["doc_id", "s0", "s1"], "left_semi")
    places = heads.select(F.col("doc_id").alias("x"), F.explode("bands").alias("band")).repartition("band")  # one exchange for the count and the join
    crowded = places.groupBy("band").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).where("lo < hi").select("band")
    held = checkpointed(places.join(crowded, "band").distinct())  # nodes by the bands that they share with another
    bodies = checkpointed(heads.select("doc_id", "s0", "body").join(held.select(F.col("x").alias("doc_id")).distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id", "s0"]).select("doc_id", "body"))

    def with_texts(pairs: DataFrame) -> DataFrame:
        left, right = bodies.select(F.col("doc_id").alias("a"), F.col("body").alias("left")), bodies.select(F.col("doc_id").alias("b"), F.col("body").alias("right"))
        return pairs.join(left, "a").join(right, "b").select(*pairs.columns, "left", "right")

    # rows of one doc_id are one node: what they are equal to hangs together
    links = checkpointed(member.where("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b")).distinct())
    of = tested = first = None

    def named(df: DataFrame, *nodes: str) -> DataFrame:
        """df with the component of each of these columns, under the name c_ and the column's."""
        for x in nodes:
            df = df.join(of.select(F.col("node").alias(x), F.col("component").alias(f"c_{x}")), x, "left").withColumn(f"c_{x}", F.coalesce(f"c_{x}", x))
        return df

    def linked_by(pairs: DataFrame) -> None:
        nonlocal links, of
        links = checkpointed(links.unionByName(with_texts(pairs).mapInArrow(_confirm(shingle, percent), "a long, b long")))
        of = checkpointed(components(links))

    for step in range(max(1, pivot_rounds)):
        at = held.withColumn("c_x", F.col("x")) if of is None else named(held, "x")
        if of is not None:
            several = at.groupBy("band").agg(F.min("c_x").alias("lo"), F.max("c_x").alias("hi")).where("lo < hi").select("band")
            at = checkpointed(at.join(several, "band", "left_semi"))
            if at.isEmpty():
                break
        order = F.struct((F.col("x") if not step else F.xxhash64("x", F.lit(step))).alias("rank"), F.col("x"), F.col("c_x"))
        pairs = at.join(at.groupBy("band").agg(F.min(order).alias("p")), "band").where("c_x <> p.c_x").select(F.least("x", "p.x").alias("a"), F.greatest("x", "p.x").alias("b")).distinct()
        pairs = checkpointed(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"))
        tested = pairs if tested is None else tested.unionByName(pairs)
        first = first or pairs  # a is the pivot, b every other node of its bands
        linked_by(pairs)
    if first is not None:
        under = checkpointed(named(first, "a", "b"))
        open_ = under.where("c_a <> c_b").select("a").distinct()
        rows = with_texts(under.join(open_, "a", "left_semi").select("a", "b", "c_b")).mapInArrow(_differences(shingle, percent), "p long, x long, c long, np long, n long, d long, like boolean, e int")
        linked_by(checkpointed(_by_differences(rows, percent).distinct().join(tested, ["a", "b"], "left_anti")))
    names = member.select("doc_id", "s0", "s1", "n", "node").distinct()
    if of is not None:
        names = names.join(of, names.node == of.node, "left").select("doc_id", "s0", "s1", "n", F.coalesce("component", names.node).alias("c"))
    else:
        names = names.withColumn("c", F.col("node")).drop("node")
    out = known.select("doc_id", "n", "s0", "s1").join(names, ["doc_id", "s0", "s1", "n"], "left")
    component = F.coalesce("c", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
