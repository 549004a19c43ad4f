"""The same recording stored twice, and names borrowed from a copy that has them.

Recordings within a tolerance of each other's length share a slot of that width
or lie in neighbouring slots. A task holds the recordings of a slot, or of a part
of a large one, as bytes, and those of the next slot pass by: so each is sent
about twice. Blocks of both are compared by products of matrices.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import codes, names

#: How alike fingerprints and lengths of one recording are; when two copies are different masterings.
THRESHOLD, TOLERANCE_SEC, REMASTER_DB, REMASTER_COMPRESSION = 0.12, 1.5, 2.5, 0.12
SEGMENTS, FRAMES, BINS, LAG = 3, 20, 12, 3
#: Recordings of a block; what products of matrices in single precision may be off.
BLOCK, SLACK = 1_024, 1e-3
#: Recordings that a task holds and that pass by at a time, at most; the segment, and how many of its bins, that tell most pairs apart.
HELD, PASSING, PROBED, PROBE_BINS = 16 * BLOCK, 4 * BLOCK, 1, 6


def _cells(texts: pd.Series) -> np.ndarray:
    """n x segments x frames x bins; NaN for a text that is no fingerprint."""
    out = np.full((len(texts), SEGMENTS * FRAMES * BINS), np.nan)
    for i, t in enumerate(texts):
        if t is not None and len(t) == 960:
            try:
                out[i] = np.frombuffer(base64.b64decode(t, altchars=b"-_", validate=True), np.uint8)
            except ValueError:
                pass
    return out.reshape(-1, SEGMENTS, FRAMES, BINS)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of all rows of two arrays of cells: 1 less the mean over segments of the best correlation at lags of up to three frames, every bin about its own mean; NaN if nothing varies. One product of matrices for each lag and segment."""
    best = np.full((SEGMENTS, len(a), len(b)), -np.inf)
    for lag in range(-LAG, LAG + 1):
        x = a[:, :, max(0, -lag) : FRAMES - max(0, lag)]
        y = b[:, :, max(0, lag) : FRAMES + min(0, lag)]
        x, y = ((v - v.mean(axis=2, keepdims=True)).reshape(len(v), SEGMENTS, -1) for v in (x, y))
        nx, ny = (np.sqrt((v * v).sum(axis=2)) for v in (x, y))
        for s in range(SEGMENTS):
            with np.errstate(divide="ignore", invalid="ignore"):
                r = np.clip(x[:, s] @ y[:, s].T / (nx[:, s, None] * ny[None, :, s]), -1, 1)
            best[s] = np.fmax(best[s], r)
    told = np.isfinite(best)
    n = told.sum(axis=0)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(n > 0, 1 - np.where(told, best, 0).sum(axis=0) / n, np.nan)


def _unit(a: np.ndarray, lag: int) -> np.ndarray:
    """The cells that a lag compares, every bin about its own mean and each segment of length 1; NaN where nothing varies."""
    x = a[:, :, max(0, -lag) : FRAMES - max(0, lag)]
    x = (x - x.mean(axis=2, keepdims=True)).reshape(len(x), SEGMENTS, -1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return x / np.sqrt((x * x).sum(axis=2, keepdims=True))


def _near(a: np.ndarray, b: np.ndarray, threshold: float, able: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, distance) of rows of two arrays of cells that are able and no further apart than the threshold.

    Products in single precision, off by less than ``SLACK``, leave out what is further; the rest is measured in double precision.
    """
    far, told = np.zeros((len(a), len(b)), np.float32), np.zeros((len(a), len(b)), np.uint8)
    units = [(_unit(a, lag).astype(np.float32), _unit(b, -lag).astype(np.float32)) for lag in range(-LAG, LAG + 1)]
    with np.errstate(invalid="ignore", divide="ignore"):
        for s in range(SEGMENTS):
            best = np.full(far.shape, np.nan, np.float32)
            for x, y in units:
                np.fmax(best, np.ascontiguousarray(x[:, s]) @ np.ascontiguousarray(y[:, s]).T, out=best)
            known = ~np.isnan(best)
            far += np.where(known, np.minimum(best, 1), 0)
            told += known
        i, j = np.nonzero(able & (1 - far / told <= threshold + SLACK))
        if len(i) * 20 > far.size:
            d = _distances(a, b)[i, j]
        else:
            parts = [slice(k, k + BLOCK) for k in range(0, len(i), BLOCK)]
            d = np.concatenate([_distance_of(a[i[p]], b[j[p]]) for p in parts]) if parts else np.zeros(0)
        kept = d <= threshold
    return i[kept], j[kept], d[kept]


def _distance_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The distances of ``_distances`` of each row of a and the same row of b."""
    best = np.full((len(a), SEGMENTS), np.nan)
    for lag in range(-LAG, LAG + 1):
        best = np.fmax(best, np.clip((_unit(a, lag) * _unit(b, -lag)).sum(axis=2), -1, 1))
    told = ~np.isnan(best)
    with np.errstate(invalid="ignore", divide="ignore"):
        return 1 - np.where(told, best, 0).sum(axis=1) / told.sum(axis=1)


@F.pandas_udf(T.DoubleType())
def fingerprint_distance(left: pd.Series, right: pd.Series) -> pd.Series:
    """How far apart two fingerprints are; null if that can't be told."""
    a, b = _cells(left), _cells(right)
    far = [_distances(a[i : i + 1], b[i : i + 1])[0, 0] for i in range(len(a))]
    return pd.Series([None if np.isnan(x) else float(x) for x in far], dtype=object).astype("float64")


def _bytes(text: Column) -> Column:
    """The bytes of a fingerprint; null for a text that is none."""
    plain = F.translate(text, "-_", "+/")
    right = (F.length(plain) == codes.FINGERPRINT_CHARS) & plain.rlike(f"^[A-Za-z0-9+/]{{{codes.FINGERPRINT_CHARS}}}$")  # $ alone lets a last line end by
    return F.when(right, F.unbase64(plain))


def _cells_of(prints) -> np.ndarray:
    """n x segments x frames x bins of fingerprints as bytes."""
    return np.frombuffer(b"".join(prints), np.uint8).reshape(-1, SEGMENTS, FRAMES, BINS)


@F.pandas_udf(T.BooleanType())
def _varies(prints: pd.Series) -> pd.Series:
    """Whether any bin varies inside a segment: else a fingerprint is like none, not even itself."""
    return pd.Series(np.ptp(_cells_of(prints), axis=2).any(axis=(1, 2)))


def _bests(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """n x segments: the best correlation of each row of a and the same row of b, from sums that are whole numbers; NaN where nothing varies."""
    a, b = a.astype(float), b.astype(float)
    best = np.full(a.shape[:2], np.nan)
    for lag in range(-LAG, LAG + 1):
        x = a[:, :, max(0, -lag) : FRAMES - max(0, lag)]
        y = b[:, :, max(0, lag) : FRAMES + min(0, lag)]
        sx, sy, w = x.sum(axis=2), y.sum(axis=2), x.shape[2]
        about = lambda u, v, su, sv: w * np.einsum("nsfb,nsfb->ns", u, v) - np.einsum("nsb,nsb->ns", su, sv)  # noqa: E731, B023
        with np.errstate(divide="ignore", invalid="ignore"):
            best = np.fmax(best, np.clip(about(x, y, sx, sy) / np.sqrt(about(x, x, sx, sx) * about(y, y, sy, sy)), -1, 1))
    return best


class _Rows:
    """Recordings side by side: ids, lengths, cells, and what a probe of one segment takes of them."""

    def __init__(self, ids: pa.Array, secs: np.ndarray, cells: np.ndarray):
        self.ids, self.secs, self.cells = ids, secs, cells

    @classmethod
    def of(cls, batches: list[pa.RecordBatch]) -> _Rows:
        t = pa.Table.from_batches(batches)
        return cls(t["id"].combine_chunks(), t["sec"].to_numpy(), _cells_of(t["print"].to_pylist()))

    def __len__(self) -> int:
        return len(self.secs)

    def cut(self, size: int) -> Iterator[_Rows]:
        for k in range(0, len(self), size):
            yield _Rows(self.ids[k : k + size], self.secs[k : k + size], self.cells[k : k + size])

    def probe(self, bins: np.ndarray) -> None:
        """At each lag the segment's cells in some bins, about their means, and the length of the rest, of a whole of length 1: products of two rows are no less than their correlation. flat: rows of which nothing varies in the segment."""
        seg = self.cells[:, PROBED].astype(np.float32)
        others = np.setdiff1d(np.arange(BINS), bins)
        self.probes, self.flat = [], ~np.ptp(self.cells[:, PROBED], axis=1).any(axis=1)
        for lag in range(-LAG, LAG + 1):
            x = seg[:, max(0, -lag) : FRAMES - max(0, lag)]
            x = x * x.shape[1] - x.sum(axis=1, keepdims=True)  # whole numbers
            some, rest = x[:, :, bins].reshape(len(x), -1), x[:, :, others].reshape(len(x), -1)
            squares = np.einsum("nk,nk->n", rest, rest)
            size = np.sqrt(np.einsum("nk,nk->n", some, some) + squares)
            self.probes.append(np.column_stack([some, np.sqrt(squares)]) / np.where(size > 0, size, 1)[:, None])


def _met(a: _Rows, b: _Rows, tolerance: float, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, distance) of the rows of both that are near; same: b is a, and i < j.

    As the other segments correlate by 1 at most, one below 1 less three thresholds tells that a pair is further; so does what is never less, products over some bins. What is left is measured in double precision, or block by block where much is left.
    """
    if not (len(a) and len(b)) or b.secs[0] - a.secs[-1] > tolerance or a.secs[0] - b.secs[-1] > tolerance:
        return
    least, many = 1 - SEGMENTS * threshold, max(BLOCK, len(a) * len(b) // 50)
    may = np.ones((len(a), len(b)), bool)
    if least > SLACK:
        best = product = None
        for x, y in zip(a.probes, reversed(b.probes)):
            if best is None:
                best = x @ y.T
                product = np.empty_like(best)
            else:
                np.maximum(best, np.matmul(x, y.T, out=product), out=best)
        may = best >= least - SLACK
        may |= a.flat[:, None]
        may |= b.flat[None, :]
    if same:
        may = np.triu(may, 1)
    if np.count_nonzero(may) <= many:
        i, j = np.nonzero(may)
        near = np.abs(a.secs[i] - b.secs[j]) <= tolerance
        i, j = i[near], j[near]
        for k in range(0, len(i), BLOCK):
            p, q = i[k : k + BLOCK], j[k : k + BLOCK]
            probed = _bests(a.cells[p, PROBED : PROBED + 1], b.cells[q, PROBED : PROBED + 1])[:, 0]
            left = ~(probed < least - SLACK)
            p, q = p[left], q[left]
            best = _bests(a.cells[p], b.cells[q])
            told = ~np.isnan(best)
            with np.errstate(invalid="ignore"):
                kept = (d := 1 - np.where(told, best, 0).sum(axis=1) / told.sum(axis=1)) <= threshold
            yield p[kept], q[kept], d[kept]
    else:
        cells = a.cells.astype(float)
        for k in range(0, len(b), BLOCK):
            part = slice(k, k + BLOCK)
            i, j, d = _near(cells, b.cells[part].astype(float), threshold, may[:, part] & (np.abs(a.secs[:, None] - b.secs[None, part]) <= tolerance))
            yield i, j + k, d


def _compare(tolerance: float, threshold: float, once: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of rows (slot, part, passes, id, sec, print) sorted in this order the pairs inside each slot and part."""

    def pairs(held: list[_Rows], passing: _Rows, same: int | None) -> Iterator[pa.RecordBatch]:
        for n, a in enumerate(held if same is None else held[: same + 1]):
            for i, j, d in _met(a, passing, tolerance, threshold, n == same):
                if len(i):
                    x, y = a.ids.take(pa.array(i)), passing.ids.take(pa.array(j))
                    if once:
                        less = pc.less(x, y)
                        x, y = pc.if_else(less, x, y), pc.if_else(less, y, x)
                    yield pa.RecordBatch.from_arrays([x, y, pa.array(d)], ["a_id", "b_id", "distance"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, read, held, waiting, bins = None, [], [], [], None

        def hold() -> Iterator[pa.RecordBatch]:
            nonlocal read, held, bins
            if not read:
                return
            rows, read = _Rows.of(read), []
            bins = np.sort(np.argsort(-rows.cells[:BLOCK, PROBED].var(axis=1).mean(axis=0))[:PROBE_BINS])
            held = list(rows.cut(BLOCK))
            if once and len(rows) > 1:
                for n, block in enumerate(held):
                    block.probe(bins)
                    yield from pairs(held, block, n)
            if not once or len(rows) == 1:
                for block in held:
                    block.probe(bins)

        def meet() -> Iterator[pa.RecordBatch]:
            nonlocal waiting
            rows, waiting = waiting, []
            for part in _Rows.of(rows).cut(PASSING) if rows and held else ():
                part.probe(bins)
                yield from pairs(held, part, None)

        for batch in batches:
            keys = np.stack([batch[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("slot", "part", "passes")])
            ends = [*(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1), batch.num_rows]
            begin = 0
            for end in ends:
                if end == begin:
                    continue
                if at != (key := (keys[0, begin], keys[1, begin])):
                    yield from hold()
                    yield from meet()
                    at, held = key, []
                rows = batch.slice(begin, end - begin).select(["id", "sec", "print"])
                if keys[2, begin]:
                    yield from hold()
                    if held:
                        waiting.append(rows)
                        if sum(map(len, waiting)) >= PASSING:
                            yield from meet()
                else:
                    read.append(rows)
                begin = end
        yield from hold()
        yield from meet()

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        few = []
        for batch in run(batches):
            few.append(batch)
            if sum(map(len, few)) >= BLOCK or len(few) >= BLOCK:
                yield from pa.Table.from_batches(few).combine_chunks().to_batches()
                few = []
        if few:
            yield from pa.Table.from_batches(few).combine_chunks().to_batches()

    return gathered


def alike(left: DataFrame, right: DataFrame, tolerance: float = TOLERANCE_SEC, threshold: float = THRESHOLD, once: bool = False) -> DataFrame:
    """(a_id, b_id, distance) of rows of both sides (id, sec, print: bytes) whose lengths and fingerprints are near; once: both sides are the same table, each pair is told once.

    Rows whose lengths differ by no more than the tolerance lie in one slot of that width or in neighbouring ones. The rows of a slot on the left are held by one task; those of a large slot, above a 16th of all or ``HELD``, by one for each part, by hash. The rows on the right pass by all parts of their slot and of its neighbours. With once they pass by the parts before their own and by the slot before alone, so a row is sent twice, and once more for each part that a slot has beyond one.
    """
    n = left.count()
    m = n if once else right.count()
    most = min(HELD, max(BLOCK, n // 16))
    slot = F.floor(F.greatest(F.lit(-9e18), F.least(F.lit(9e18), F.col("sec") / (tolerance * (1 + 1e-9))))).alias("slot")  # no narrower than the tolerance by the last bits
    rows = lambda df: df.where("print IS NOT NULL").select(slot, "id", F.col("sec").cast("double").alias("sec"), "print")
    large = left.select(slot).groupBy("slot").agg(F.ceil(F.count("*") / most).cast("int").alias("parts")).where("parts > 1")
    parted = lambda df: df.join(F.broadcast(large), "slot", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("id"), "parts").cast("int"))
    held = parted(rows(left)).select("slot", F.col("own").alias("part"), F.lit(0).alias("passes"), "id", "sec", "print")
    ways = (0, -1) if once else (0, -1, 1)
    passing = parted(rows(right).withColumn("way", F.explode(F.array(*map(F.lit, ways)))).withColumn("slot", F.col("slot") + F.col("way")))
    passing = passing.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    if once:
        passing = passing.where("way <> 0 OR part < own")
    both = held.unionByName(passing.select("slot", "part", F.lit(1).alias("passes"), "id", "sec", "print"))
    tasks = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), (n + m) // 4_096)  # by the work, not by the bytes, as slots take long
    kind = left.schema["id"].dataType.simpleString()
    dealt = both.repartition(tasks, "slot", "part").sortWithinPartitions("slot", "part", "passes", "sec")
    pairs = dealt.mapInArrow(_compare(tolerance, threshold, once), f"a_id {kind}, b_id {kind}, distance double")
    return pairs.where("a_id <> b_id") if once else pairs


def _mark(column: str) -> Column:
    """Tells equal fingerprints in 32 bytes."""
    return F.unhex(F.sha2(column, 256)).alias("mark")


def _usable(recordings: DataFrame, *others: str, kept: bool = True) -> DataFrame:
    """(id, sec, print: bytes, mark) of recordings that have all, and other columns; kept: written once. A length that is NaN or infinite is near none."""
    of = recordings.select("id", F.col("duration_sec").alias("sec"), _bytes(F.col("fingerprint")).alias("print"), *others).select("*", _mark("print"))
    of = _kept(of) if kept else of  # before the filter, which would make the fingerprints a second time
    return of.where("id IS NOT NULL AND print IS NOT NULL AND abs(sec) < double('Infinity')")


def duplicate_pairs(recordings: DataFrame, tolerance: float = TOLERANCE_SEC, threshold: float = THRESHOLD) -> DataFrame:
    """(a_id, b_id, distance), a_id < b_id, of recordings (id, duration_sec, fingerprint) that sound alike.

    Equal fingerprints of one length are one recording to compare, so a recording stored very often does not meet itself pair by pair: its copies are tied to the first. recordings are read once.
    """
    return _pairs(_usable(recordings), tolerance, threshold)


def _pairs(usable: DataFrame, tolerance: float, threshold: float) -> DataFrame:
    kinds = _kept(usable.groupBy("sec", "print").agg(F.min("id").alias("id"), F.count("*").alias("n")))
    far = alike(kinds, kinds, tolerance, threshold, once=True)
    several = kinds.where("n > 1").where(_varies("print")).select("sec", _mark("print"), F.col("id").alias("a_id"))
    copies = usable.select("sec", "mark", F.col("id").alias("b_id")).join(several, ["sec", "mark"]).where("a_id <> b_id")
    return far.unionByName(copies.select("a_id", "b_id", F.lit(0.0).alias("distance")).where(F.col("distance") <= threshold))


def components(pairs: DataFrame) -> DataFrame:
    """(id, group_id) of all ids in pairs (a_id, b_id); group_id is the least id connected. Labels go to neighbours and jump to their label's label until none changes; each round is written to the checkpoint folder."""
    edges = _kept(pairs.select(F.col("a_id").alias("x"), F.col("b_id").alias("y")).union(pairs.select("b_id", "a_id")).distinct())
    labels = _kept(edges.groupBy("x").agg(F.least(F.first("x"), F.min("y")).alias("c")))
    while True:
        near = edges.join(labels.select(F.col("x").alias("y"), "c"), "y").groupBy("x").agg(F.min("c").alias("m"))
        moved = labels.join(near, "x").select("x", F.least("c", "m").alias("n"), "c")
        jump = moved.select(F.col("x").alias("n"), F.col("n").alias("j"))
        after = _kept(moved.join(jump, "n").select("x", F.least("n", "j").alias("c"), (F.least("n", "j") != F.col("c")).alias("changed")))
        labels = after.select("x", "c")
        if after.where("changed").isEmpty():
            break
    return labels.select(F.col("x").alias("id"), F.col("c").alias("group_id"))


def _kept(df: DataFrame) -> DataFrame:
    from ..sources.files import checkpointed

    return checkpointed(df)


def duplicate_groups(recordings: DataFrame, tolerance: float = TOLERANCE_SEC, threshold: float = THRESHOLD, pairs: DataFrame | None = None, groups: DataFrame | None = None) -> DataFrame:
    """(id, group_id, distance): recordings in groups of two or more; distance is the least in the group. pairs, groups: what duplicate_pairs and components gave, where they are known."""
    pairs = _kept(duplicate_pairs(recordings, tolerance, threshold)) if pairs is None else pairs
    groups = components(pairs) if groups is None else groups
    nearest = pairs.join(groups.withColumnRenamed("id", "a_id"), "a_id").groupBy("group_id").agg(F.min("distance").alias("distance"))
    return groups.join(nearest, "group_id").select("id", "group_id", "distance")


def duplicate_verdicts(recordings: DataFrame, tolerance: float = TOLERANCE_SEC, threshold: float = THRESHOLD, pairs: DataFrame | None = None, groups: DataFrame | None = None) -> DataFrame:
    """(group_id, n, verdict): different-master if any pair that sounds alike differs by more than 2.5 dB or .12 of compression, else same-master. recordings also has loudness_db and compression.

    All recordings of one length and fingerprint match each other, and all of one such class match all of a class that sounds alike. So the least and greatest values of classes tell whether any pair differs, without listing the pairs. Values that are null or NaN differ from none.
    """
    usable = _usable(recordings, "loudness_db", "compression", kept=pairs is None)
    pairs = _kept(_pairs(usable, tolerance, threshold)) if pairs is None else pairs
    groups = components(pairs) if groups is None else groups
    limits = {"loudness_db": REMASTER_DB, "compression": REMASTER_COMPRESSION}
    value = lambda c: F.when(~F.isnan(c), F.col(c).cast("double"))
    ends = [f(value(c)).alias(f"{p}_{c}") for c in limits for f, p in ((F.min, "lo"), (F.max, "hi"))]
    kinds = _kept(usable.groupBy("sec", "mark").agg(F.min("id").alias("id"), F.count("*").alias("copies"), *ends).join(groups, "id").drop("sec", "mark"))
    beyond = lambda hi, lo, limit: F.coalesce(~F.isnan(hi - lo) & (hi - lo > limit), F.lit(False))
    inside = kinds.where("copies > 1").select("group_id", F.greatest(*(beyond(F.col(f"hi_{c}"), F.col(f"lo_{c}"), x) for c, x in limits.items())).alias("d"))
    side = lambda p: kinds.select(*(F.col(c).alias(f"{p}_{c}") for c in kinds.columns))
    told = pairs.join(side("b"), "b_id").join(side("a"), "a_id")  # a copy of a class's first is no b_id here
    across = told.select(F.col("a_group_id").alias("group_id"), F.greatest(*(beyond(F.col(f"{p}_hi_{c}"), F.col(f"{q}_lo_{c}"), x) for c, x in limits.items() for p, q in ("ab", "ba"))).alias("d"))
    any_ = inside.unionByName(across).groupBy("group_id").agg(F.max("d").alias("d"))
    return groups.groupBy("group_id").agg(F.count("*").alias("n")).join(any_, "group_id").select("group_id", "n", F.when(F.col("d"), "different-master").otherwise("same-master").alias("verdict"))


def propose_names(tracks: DataFrame, tolerance: float = TOLERANCE_SEC, threshold: float = THRESHOLD) -> DataFrame:
    """(id, source, artist, title, album, track_no, from_id, distance) for files without artist or title.

    From the nearest copy that has both (by distance, then length, then id), else from the path if that tells an artist. Fields that the file has stay null.
    """
    no = {f: names.blank(F.col(f)) for f in ("artist", "title", "album")}
    orphan = no["artist"] | no["title"]
    lost, donors = tracks.where(orphan), tracks.where(~orphan & F.col("fingerprint").isNotNull() & F.col("duration_sec").isNotNull())
    fields = ("artist", "title", "album", "track_no")
    # rows of one length and fingerprint are equally far from everything: one of them is compared
    of = [F.col("duration_sec").alias("sec"), F.col("fingerprint").alias("print")]
    heard = _kept(lost.where("fingerprint IS NOT NULL AND duration_sec IS NOT NULL").groupBy(*of).agg(F.min("id").alias("id")))
    lent = _kept(donors.groupBy(*of).agg(F.min(F.struct("id", *fields)).alias("b")).select(F.col("b.id").alias("id"), "sec", "print", "b"))
    prints = lambda df: df.select("id", "sec", _bytes(F.col("print")).alias("print"))
    pairs = alike(prints(heard), prints(lent), tolerance, threshold)
    told = pairs.join(lent.select(F.col("id").alias("b_id"), F.col("sec").alias("b_sec"), *(F.col("b")[f].alias(f"b_{f}") for f in fields)), "b_id")
    first = told.groupBy("a_id").agg(F.min_by(F.struct("b_id", "distance", *(f"b_{f}" for f in fields)), F.struct(F.round("distance", 9), "b_sec", "b_id")).alias("b"))
    best = lost.select("id", *of).join(heard.select("sec", "print", F.col("id").alias("a_id")), ["sec", "print"]).join(first, "a_id").select(F.col("id").alias("a_id"), "b")
    path = names.from_path(F.col("rel_path"))
    rows = lost.join(best, lost.id == best.a_id, "left").withColumn("p", path)
    by_sound = F.col("b").isNotNull()
    pick = lambda f: F.when(no[f] if f in no else F.col(f).isNull(), F.when(by_sound, F.col(f"b.b_{f}")).otherwise(F.col(f"p.{f}")))
    got = rows.select("id", F.when(by_sound, "sound").otherwise("path").alias("source"), *(pick(f).alias(f) for f in fields), F.col("b.b_id").alias("from_id"), F.col("b.distance").alias("distance"))
    return got.where("(source = 'sound' AND (artist IS NOT NULL OR title IS NOT NULL)) OR (source = 'path' AND artist IS NOT NULL)")


def listed_groups(groups: DataFrame, recordings: DataFrame) -> DataFrame:
    """groups (id, group_id, distance) in the order of a report: nearest first, inside a group the file that has been there longest (last_modified)."""
    return groups.join(recordings.select("id", "last_modified"), "id").orderBy("distance", "group_id", "last_modified", "id")


def listed_proposals(proposals: DataFrame, tracks: DataFrame) -> DataFrame:
    """proposals in the order of a report: those by sound first, nearest first, then those by path, by file name."""
    by_path = F.when(F.col("source") == "path", F.lower("file_name"))
    return proposals.join(tracks.select("id", "file_name"), "id").orderBy((F.col("source") == "path").cast("int"), "distance", by_path, "id")


def accepted(given: DataFrame, proposals: DataFrame) -> DataFrame:
    """given names (id, artist, title, album, track_no) after proposals are accepted: a row for each recording, later proposals over earlier names, field by field."""
    fields = ("artist", "title", "album", "track_no")
    new = proposals.select("id", *(F.col(f).alias(f"new_{f}") for f in fields))
    return given.join(new, "id", "full_outer").select("id", *(F.coalesce(f"new_{f}", f).alias(f) for f in fields))


def accepted_counts(proposals: DataFrame) -> DataFrame:
    """One row (by_sound, by_path): how many names were accepted from each source."""
    return proposals.agg(F.count_if(F.col("source") == "sound").alias("by_sound"), F.count_if(F.col("source") == "path").alias("by_path"))


def with_given(tracks: DataFrame, given: DataFrame) -> DataFrame:
    """tracks whose blank tags are filled from accepted names (id, artist, title, album, track_no); tags win."""
    g = given.select("id", *(F.col(f).alias(f"given_{f}") for f in ("artist", "title", "album", "track_no")))
    rows = tracks.join(g, "id", "left")
    filled = {f: F.when(names.blank(F.col(f)), F.col(f"given_{f}")).otherwise(F.col(f)) for f in ("artist", "title", "album")} | {"track_no": F.coalesce("track_no", "given_track_no")}
    return rows.withColumns(filled).select(*tracks.columns)
