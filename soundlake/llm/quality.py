"""Quality classifier: importance weights from hashed n-gram models.

Target text is what labels call good and not toxic; raw text is every document of
the corpus. Both are modelled by how many of their documents hold each feature, by
a hash of 48 bits: words and their first 4 to 6 bytes, pairs of words, runs of
signs, and triples of word shapes (case, signs that follow, repetition of the word
before). A feature's log-ratio of the two models is shrunk by how sure it is: by
1 - (z / d)^2, d being the root of the deviance of its count in the target from
what its share of the corpus lets expect, and to 0 where d is below z. A
document's weight is the sum over its features.

A feature that no good document holds is sure only if its share of the corpus is
z^2 / 2 of the number of good documents or more; one that is commoner in the
target counts from ``LEAST_GOOD`` good documents on. So only such features are
counted: what has a share of the whole has it in one part at least, so the parts
that tasks gather name all frequent features, and a second scan counts the named
ones in every document. There are at most (features of a document) x (2 / z^2 +
1 / LEAST_GOOD) x (good documents) of them, whatever the size of the corpus.

z and the cut are those with the fewest errors on the labelled rows, each weighed
without its own label. Where no cut errs less than keeping all, all stay.

``resample`` takes k documents by the Gumbel top-k trick. With k given, keys are
weight + noise: a sample without replacement in proportion to the importance
weights. Without k, weights above the cut are capped, so that all such documents
are equally likely, and as many are taken as lie above the cut; with sharp weights
(``sharpness``, for a cut of -4; relative to other cuts) chance is left to
documents at the very cut, so this is a threshold on importance weights, under
which every good document stays in the corpus, once. Exactly k rows are taken;
rows of equal key go by their place in the table.

The target model is fitted on at most ``max_labelled`` labelled rows, those of
least hash of doc_id; the raw model and the weights cover every document. Features
with d of the least z or more go to all tasks.

Nulls: a null text has no features and weight 0; a null doc_id is kept or not as
any other row. Rows with null labels don't count. Without labels nothing is
significant and all documents stay. Rows that repeat are weighed and counted each.
A text longer than a block is one block, whole. Other columns are not read.
Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import LOWER, SPACE, Block, Spans, Words, ascending, blocks, byte_set, grams, mix, words
from .shared import checkpointed, id_and_text, row_key

MAX_LABELLED, LEAST_GOOD = 5_000, 5
SHARPNESS = 50.0
#: Values of z to choose from.
ZS = (2.0, 2.5, 3.0, 4.0, 5.5, 7.5)
#: Distinct features that a task gathers before it names the frequent ones, and rows of a batch.
GATHERED, FRESH, BATCH = 6_000_000, 500_000, 50_000
#: A block's rows and hashes share 64 bits; among 10**5 sure features, one in 3 * 10**9 others is taken for one of them.
HASH_BITS, PREFIX_BITS = 48, 22
HEADS = (4, 5, 6)
#: The scale of sharpness where the cut is nearer to 0.
LEAST_CUT = 1e-3
_WORD = byte_set((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
_SIGN = ~_WORD & ~SPACE & ~byte_set((0x00, 0x1F), (0x7F, 0x7F))
_UPPER, _LOWERCASE = byte_set((0x41, 0x5A)), byte_set((0x61, 0x7A))


def _inside(told: np.ndarray, w: Words) -> np.ndarray:
    """How many of the bytes told lie in each word."""
    sums = np.zeros(len(told) + 1, np.int32 if len(told) < 1 << 31 else np.int64)
    np.cumsum(told, out=sums[1:])
    return sums[w.ends] - sums[w.starts]


def features(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every feature, repeats included."""
    low = Block(block.ids, LOWER[block.data], block.offsets)
    w, signs = words(low, _WORD), words(block, _SIGN)
    hashes = Spans(low.data)
    h, s = hashes(w.starts, w.ends), hashes(signs.starts, signs.ends)  # signs hold no letters
    up, down = (_inside(t[block.data], w) for t in (_UPPER, _LOWERCASE))
    # 0 no letters, 1 lower, 2 capital first, 3 several capitals
    shape = np.where(up + down == 0, 0, np.where(up == 0, 1, np.where((up == 1) | (down > 0), 2, 3))).astype(np.uint64)
    same = np.zeros(len(w), np.uint64)
    if len(w) > 1:
        same[1:] = (h[1:] == h[:-1]) & (w.row[1:] == w.row[:-1])
    follows = np.searchsorted(signs.starts, w.ends)
    joined = np.zeros(len(w), np.uint64)
    if len(signs):
        at = np.minimum(follows, len(signs) - 1)
        joined = ((signs.starts[at] == w.ends) & (signs.row[at] == w.row)).astype(np.uint64) * (np.minimum(signs.ends[at] - signs.starts[at], 2).astype(np.uint64))
    shapes = mix(shape * np.uint64(8) + same * np.uint64(4) + joined + np.uint64(77))
    out = [(w.row, h), (signs.row, mix(s + np.uint64(1)))]
    for n in HEADS:
        longer = w.ends - w.starts > n
        at = w.starts[longer]
        out.append((w.row[longer], mix(hashes(at, at + n) + np.uint64(n))))
    if len(w) >= 2:
        inside = w.row[:-1] == w.row[1:]
        out.append((w.row[:-1][inside], mix(grams(h, 2)[inside] + np.uint64(2))))
    if len(w) >= 3:
        inside = w.row[:-2] == w.row[2:]
        out.append((w.row[:-2][inside], grams(shapes, 3)[inside]))
    return np.concatenate([r for r, _ in out]), (np.concatenate([x for _, x in out]) >> np.uint64(64 - HASH_BITS)).view(np.int64)


def distinct_features(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every feature, once a row."""
    row, h = features(block)
    rows = 1 << (64 - HASH_BITS)
    if len(block) <= rows:
        both, _ = ascending((row.astype(np.uint64) << np.uint64(HASH_BITS)) | h.view(np.uint64))
        return (both >> np.uint64(HASH_BITS)).view(np.int64), (both & np.uint64((1 << HASH_BITS) - 1)).view(np.int64)
    _, at = np.unique(mix(h.view(np.uint64) + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
    return row[at], h[at]


def holders(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """The block's distinct features, in ascending order, and how many rows hold each."""
    room = np.uint64(64 - HASH_BITS)
    if len(block) > 1 << (64 - HASH_BITS):
        return ascending(distinct_features(block)[1])
    row, h = features(block)
    if not len(h):
        return h, np.empty(0, np.int64)
    both = (h.view(np.uint64) << room) | row.astype(np.uint64)  # one sort tells rows and features apart
    both.sort()
    h = both[np.append(True, both[1:] != both[:-1])] >> room
    at = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    return h[at].view(np.int64), np.diff(np.append(at, len(h)))


def shrunk(target: np.ndarray, expected: np.ndarray, z: float) -> np.ndarray:
    """Log-ratios of counts to what is expected, shrunk by their sureness; 0 where that is below z."""
    with np.errstate(divide="ignore", invalid="ignore"):
        deviance = 2 * (np.where(target > 0, target * np.log(target / expected), 0) - target + expected)
        sure = np.where(deviance > 0, 1 - z * z / deviance, 0)
    return np.log((target + 1) / (expected + 1)) * np.maximum(sure, 0)


class Named:
    """Features by sorted hash."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.sort(hashes)
        self.prefixes = None

    def places(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """(row, place among the hashes) of the block's features that have one, once a row."""
        if self.prefixes is None:  # made where it is used, not sent
            self.prefixes = np.zeros(1 << PREFIX_BITS, bool)
            self.prefixes[self.hashes >> (HASH_BITS - PREFIX_BITS)] = True
        row, h = features(block)
        told = self.prefixes[h >> (HASH_BITS - PREFIX_BITS)]
        row, h = row[told], h[told]
        if not len(h):
            return row, h
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        told = self.hashes[at] == h
        return np.divmod(ascending(row[told] * len(self.hashes) + at[told])[0], len(self.hashes))


class Model(Named):
    """Counts of the features that may matter, and what turns them into weights."""

    def __init__(self, hashes: np.ndarray, raw: np.ndarray, target: np.ndarray, n_raw: int, n_target: int):
        super().__init__(hashes)
        order = np.argsort(hashes)
        self.raw, self.target = raw[order].astype(float), target[order].astype(float)
        self.n_raw, self.n_target = n_raw, n_target

    def weights(self, z: float, without: int = 0) -> np.ndarray:
        """Of every feature; without=1: as a good document sees them that is taken out of the target."""
        return shrunk(np.maximum(self.target - without, 0), self.raw * (max(self.n_target - without, 0) / max(self.n_raw, 1)), z)


def labelled_rows(labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, good) of at most max_labelled labelled ids."""
    told = (
        labels.select(labels["doc_id"].cast("long").alias("doc_id"), ((labels["quality"] == 1) & (labels["toxic"] == 0)).alias("good"))
        .dropna()
        .groupBy("doc_id")
        .agg(F.min("good").alias("good"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_labelled)
    )
    return checkpointed(told)


def _tallies(least: float):
    """Hashes of features that at least this share of the rows gathered hold, with how many do."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[pa.RecordBatch]:
            h, n = merged()
            told = n >= least * rows
            for i in range(0, int(told.sum()), BATCH):
                yield pa.RecordBatch.from_arrays([pa.array(x[told][i : i + BATCH]) for x in (h, n)], names=["hash", "n"])

        def merged() -> tuple[np.ndarray, np.ndarray]:
            both = parts[0] if len(parts) == 1 else np.concatenate(parts)
            parts.clear()
            both.sort()
            if not len(both):
                return np.empty(0, np.int64), np.empty(0, np.int64)
            new = both[1:] ^ both[:-1]
            new >>= room
            at = np.append(0, np.flatnonzero(new) + 1)
            del new
            h = (both[at] >> room).view(np.int64)
            both &= np.uint64(most)
            return h, np.add.reduceat(both, at).astype(np.int64)

        # a hash and its count share 64 bits, so that merging is one sort in place
        room, most = np.uint64(64 - HASH_BITS), (1 << (64 - HASH_BITS)) - 1
        parts, rows, held, fresh = [], 0, 0, 0
        for batch in batches:
            for b in (b for lo in range(0, len(batch), most) for b in blocks(batch.slice(lo, most))):
                if parts and (rows + len(b) > most or held > GATHERED):
                    yield from out()
                    rows, held, fresh = 0, 0, 0
                h, n = holders(b)
                parts.append((h.view(np.uint64) << room) | n.astype(np.uint64))
                rows, fresh = rows + len(b), fresh + len(h)
                if fresh > max(FRESH, held):  # merge when as many are new as are held
                    h, n = merged()
                    parts.append((h.view(np.uint64) << room) | n.astype(np.uint64))
                    held, fresh = len(h), 0
        if parts:
            yield from out()

    return tally


def _counted(sent, named: int):
    """(hash, raw, target) of the features named, over a task's rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        raw, target = np.zeros(named, np.int32), np.zeros(named, np.int32)
        for batch in batches:
            good = batch.column(2).to_numpy(zero_copy_only=False)
            for b in blocks(batch):
                row, at = model.places(b)
                used, n = ascending(at)
                raw[used] += n.astype(np.int32)
                used, n = ascending(at[good[b.lo : b.hi][row]])
                target[used] += n.astype(np.int32)
        used = np.flatnonzero(raw)
        for i in range(0, len(used), BATCH):
            yield pa.RecordBatch.from_arrays([pa.array(x[used[i : i + BATCH]].astype(np.int64)) for x in (model.hashes, raw, target)], names=["hash", "raw", "target"])

    return count


def fit(docs: DataFrame, some: DataFrame, zs: tuple[float, ...] = ZS) -> Model:
    """Counts of the features of docs (doc_id, text) that are as sure as the least of zs, in all documents and in the good ones of some (doc_id, good)."""
    marked = docs.join(F.broadcast(some), "doc_id", "left").select("doc_id", "text", F.coalesce("good", F.lit(False)).alias("good"))  # at most max_labelled ids
    size = marked.agg(F.count("*").alias("raw"), F.count_if("good").alias("target")).first()
    none = np.empty(0, np.int64)
    if not size.target:
        return Model(none, none, none, size.raw, 0)
    least = min(zs) ** 2 / 2 / size.target
    frequent = marked.mapInArrow(_tallies(least), "hash long, n long").select("hash")
    parts = LEAST_GOOD - 1  # fewer than LEAST_GOOD, so that one holds two of a feature's good documents; at most max_labelled rows in all
    of_good = marked.where("good").repartition(parts, F.xxhash64("doc_id")).mapInArrow(_tallies(0.0), "hash long, n long").where("n >= 2").select("hash")
    named = frequent.union(of_good).distinct().toArrow().column("hash").to_numpy().astype(np.int64)  # bounded by the labelled rows, see above
    if not len(named):
        return Model(none, none, none, size.raw, size.target)
    sent = docs.sparkSession.sparkContext.broadcast(Named(named))
    counts = marked.mapInArrow(_counted(sent, len(named)), "hash long, raw long, target long").groupBy("hash").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    hashes, raw, target = (counts.column(c).to_numpy().astype(np.int64) for c in ("hash", "raw", "target"))
    kept = np.logical_or.reduce([shrunk(np.maximum(target - w, 0).astype(float), raw * (max(size.target - w, 0) / size.raw), min(zs)) != 0 for w in (0, 1)])
    return Model(hashes[kept], raw[kept], target[kept], size.raw, size.target)


def best_cut(weights: np.ndarray, good: np.ndarray) -> tuple[int, float, float]:
    """(errors, -gap, cut): the cut below 0 with the fewest good rows at or below it and bad ones above it, in the widest gap between weights; minus infinity if that is no better than keeping all."""
    at = np.unique(np.append(weights[weights < 0], 0.0))
    lost = np.searchsorted(np.sort(weights[good]), at[:-1], "right")
    errors = lost + (~good).sum() - np.searchsorted(np.sort(weights[~good]), at[:-1], "right")
    kept = int((~good).sum())
    if not len(errors) or errors.min() >= kept:
        return kept, 0.0, -np.inf
    gap = np.diff(at)
    i = min(np.flatnonzero(errors == errors.min()), key=lambda i: -gap[i])
    return int(errors[i]), -float(gap[i]), float((at[i] + at[i + 1]) / 2)


def choose(docs: DataFrame, some: DataFrame, model: Model, zs: tuple[float, ...] = ZS) -> tuple[float, float]:
    """(z, cut) with the fewest errors on the labelled rows, each weighed without its own label."""
    if not len(model.hashes):
        return zs[0], -np.inf
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        tables = [(m.weights(z), m.weights(z, 1)) for z in zs]
        for batch in batches:
            good = batch.column(2).to_numpy(zero_copy_only=False)
            for b in blocks(batch):
                row, at = m.places(b)
                mine = good[b.lo : b.hi]
                sums = [np.bincount(row, np.where(mine[row], own[at], all_[at]), len(b)) for all_, own in tables]
                yield pa.RecordBatch.from_arrays([pa.array(mine), *(pa.array(x, pa.float64()) for x in sums)], names=["good", *(f"w{i}" for i in range(len(zs)))])

    told = docs.join(F.broadcast(some), "doc_id").select("doc_id", "text", "good")
    rows = told.mapInArrow(score, "good boolean, " + ", ".join(f"w{i} double" for i in range(len(zs)))).toArrow()  # a row a labelled document
    good = rows.column("good").to_numpy().astype(bool)
    tried = [(*best_cut(rows.column(f"w{i}").to_numpy(), good), z) for i, z in enumerate(zs)]
    errors, _, cut, z = min(tried, key=lambda x: (x[0], -x[3]))
    return z, cut


def weigh(docs: DataFrame, model: Model, z: float) -> DataFrame:
    """(doc_id, row_key, weight) of each row of (doc_id, text, row_key)."""
    told = model.weights(z)
    used = told != 0
    small = Model(model.hashes[used], model.raw[used], model.target[used], model.n_raw, model.n_target)
    sent = docs.sparkSession.sparkContext.broadcast((small, told[used]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, table = sent.value
        for batch in batches:
            for b in blocks(batch):
                row, at = m.places(b)
                weight = np.bincount(row, table[at], len(b))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(b.lo, len(b)), batch.column(2).slice(b.lo, len(b)), pa.array(weight, pa.float64())], names=["doc_id", "row_key", "weight"])

    return docs.mapInArrow(score, "doc_id long, row_key long, weight double")


def _kth(rows: DataFrame, column: str, k: int, cells: int = 1024, few: int = 10_000):
    """The k-th greatest value of a column, by rounds of counts in cells of its range; at most ``few`` values come to the driver, or one if they are equal."""
    while True:
        ends = rows.agg(F.min(column).alias("lo"), F.max(column).alias("hi"), F.count("*").alias("n")).first()
        if ends.lo == ends.hi:
            return ends.lo
        if ends.n <= few:
            return sorted((r[0] for r in rows.select(column).collect()), reverse=True)[k - 1]
        cell = F.least(F.lit(cells - 1), F.floor((F.col(column) - ends.lo) / ((ends.hi - ends.lo) / cells)))
        for r in sorted(rows.groupBy(cell.alias("cell")).count().collect(), reverse=True):
            if r["count"] >= k:
                rows = rows.where(cell == r.cell)
                break
            k -= r["count"]


def gumbel_top_k(weighted: DataFrame, k: int, key: str = "key", row: str = "uid") -> DataFrame:
    """Exactly k rows (all, if there are fewer): those of greatest key, and of least row among equals; neither may be null."""
    if k <= 0:
        return weighted.where("false")
    if weighted.count() <= k:
        return weighted
    least = _kth(weighted, key, k)
    above, ties = F.col(key) > least, weighted.where(F.col(key) == least)
    left = k - weighted.where(above).count()
    if ties.count() == left:
        return weighted.where(F.col(key) >= least)
    last = -_kth(ties.select((-F.col(row)).alias(row)), row, left)
    return weighted.where(above | ((F.col(key) == least) & (F.col(row) <= last)))


def resample(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", max_labelled: int = MAX_LABELLED, cut: float | None = None, sharpness: float = SHARPNESS, k: int | None = None, seed: int = 0) -> DataFrame:
    """(doc_id, row_key, weight, key) of the documents taken; weight: the log-ratio of target to raw text; cut: None for the one of fewest errors on the labelled rows; k: None for as many as lie above the cut."""
    rows = id_and_text(docs, doc_id, text)
    some = labelled_rows(labels, max_labelled)
    model = fit(rows, some)
    z, best = choose(rows, some, model)
    cut = max(best if cut is None else cut, -1e9)
    uniform = (F.pmod(F.xxhash64("doc_id", "row_key", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    logit = F.col("weight") if k is not None else F.lit(sharpness) * F.least(F.lit(0.0), F.col("weight") - cut) * (4 / max(abs(cut), LEAST_CUT))
    weighed = weigh(rows.select("doc_id", "text", row_key(rows.text).alias("row_key")), model, z)
    weighted = checkpointed(weighed.withColumns({"key": logit - F.log(-F.log(uniform)), "uid": F.monotonically_increasing_id()}))
    return gumbel_top_k(weighted, weighted.where(F.col("weight") > cut).count() if k is None else k).drop("uid")
