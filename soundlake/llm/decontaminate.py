"""Benchmark passages in training texts: winnowing.

Words are runs of digits, letters a-z (A-Z in lower case) and bytes of other
scripts. A window is ``WINDOW`` consecutive words of an item; a shorter item is
one window as a whole. Each window keeps the least hash among its k-grams as its
fingerprint: equal windows keep the same one, so every shared span of a window's
length is found. Fingerprints of training texts meet those of the benchmark; the
windows of the hits are then extended to their full width and compared as
128-bit hashes.

The benchmark's distinct fingerprints go to all tasks as one sorted array if they
are counted to be no more than ``max_broadcast``; above that, the fingerprints of
the training texts are shuffled to them instead, one for each run of windows that
share it, and only the texts of documents with hits are read again.

Nulls: a null text has no words. A null item_id marks words but is not named
among the items; rows that repeat an item_id are one item. Rows that repeat a
doc_id with the same text get the same result. A document without words, or an
empty benchmark, has no hits. Texts of any length are read whole; other columns
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import LOWER, NULL_ID, Block, Spans, blocks, byte_set, cover, grams, id_column, words
from .shared import checkpointed, id_and_text, row_key

WINDOW, GRAM = 10, 5
MAX_BROADCAST = 1 << 20
WORD = byte_set((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))


def _least(values: np.ndarray, n: int) -> np.ndarray:
    out = values
    for j in range(1, n):
        out = np.minimum(out[: len(values) - j], values[j:])
    return out


class Cut:
    def __init__(self, block: Block):
        self.low = Block(block.ids, LOWER[block.data], block.offsets)
        self.w = words(self.low, WORD)
        self.hashes = [Spans(self.low.data, lane)(self.w.starts, self.w.ends) for lane in (0, 1)]

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(starts, fingerprints) of all windows of n words."""
        if len(self.w) < n:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        k = min(GRAM, n)
        prints = _least(grams(self.hashes[0], k), n - k + 1)
        starts = np.flatnonzero(self.w.row[: len(self.w) - n + 1] == self.w.row[n - 1 :])
        return starts, prints[starts]

    def whole(self, starts: np.ndarray, n: int) -> list[np.ndarray]:
        # the lanes of a 128-bit hash, which also tells lengths apart
        return [(grams(h, n)[starts] + np.uint64(n) if len(starts) else np.empty(0, np.uint64)).view(np.int64) for h in self.hashes]


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        items = batch.column(2)
        for b in blocks(batch):
            cut = Cut(b)
            sizes = np.diff(cut.w.first)
            for n in {*np.minimum(sizes[sizes > 0], WINDOW).tolist()}:
                starts, prints = cut.windows(n)
                rows = cut.w.row[starts]
                mine = np.minimum(sizes[rows], WINDOW) == n
                starts, prints, rows = starts[mine], prints[mine], rows[mine]
                yield pa.RecordBatch.from_arrays([items.take(pa.array(rows + b.lo)), pa.array(np.full(len(rows), n)), pa.array(prints.view(np.int64)), *map(pa.array, cut.whole(starts, n))], names=["item", "n", "print", "w0", "w1"])


_FOUND = "doc_id long, row_key long, start long, n long, w0 long, w1 long"


def _extended(cut: Cut, ids: np.ndarray, keys: np.ndarray, starts: np.ndarray, n: int) -> pa.RecordBatch:
    rows = cut.w.row[starts]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[rows], keys[rows], starts - cut.w.first[rows], np.full(len(rows), n), *cut.whole(starts, n))], names=["doc_id", "row_key", "start", "n", "w0", "w1"])


def _hits(sizes: list[int], prints: np.ndarray):
    """Windows of training texts whose fingerprint the benchmark has."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(2).to_numpy()
            for b in blocks(batch):
                cut = Cut(b)
                for n in sizes:
                    starts, own = cut.windows(n)
                    at = np.minimum(np.searchsorted(prints, own), len(prints) - 1)
                    yield _extended(cut, b.ids, keys[b.lo : b.hi], starts[prints[at] == own], n)

    return scan


def _runs(sizes: list[int]):
    """Runs of windows that share a fingerprint: a row where the least hash changes."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(2).to_numpy()
            for b in blocks(batch):
                cut = Cut(b)
                for n in sizes:
                    starts, own = cut.windows(n)
                    rows = cut.w.row[starts]
                    new = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (rows[1:] != rows[:-1]))) if len(own) else np.empty(0, np.int64)
                    size, r = np.diff(np.append(new, len(own))), rows[new]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (own[new].view(np.int64), b.ids[r], keys[b.lo : b.hi][r], starts[new] - cut.w.first[r], size, np.full(len(new), n))], names=["print", "doc_id", "row_key", "start", "size", "n"])

    return scan


def _again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of the runs (array of start, size, n) of each document."""
    for batch in batches:
        keys, runs = batch.column(2).to_numpy(), batch.column(3).to_pylist()
        for b in blocks(batch):
            cut = Cut(b)
            mine = runs[b.lo : b.hi]
            for n in sorted({r["n"] for x in mine for r in x}):
                starts = [cut.w.first[i] + np.arange(r["start"], r["start"] + r["size"]) for i, x in enumerate(mine) for r in x if r["n"] == n]
                yield _extended(cut, b.ids, keys[b.lo : b.hi], np.concatenate(starts), n)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in blocks(batch):
            w = words(Block(b.ids, LOWER[b.data], b.offsets), WORD)
            yield pa.RecordBatch.from_arrays([id_column(b.ids), batch.column(2).slice(b.lo, len(b)), pa.array(np.diff(w.first))], names=["doc_id", "row_key", "n_words"])


def hits(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """(doc_id, row_key, windows, items) of the documents that hold windows of items; a null doc_id stands as the largest long.

    windows: array of (start, n), in words; items: the item_ids as strings, sorted.
    """
    spark = docs.sparkSession
    named = items.select(F.monotonically_increasing_id().alias("at"), items[item_text].cast("string").alias("text"), items[item_id].cast("string").alias("item"))
    windows = checkpointed(named.mapInArrow(_item_windows, "item string, n long, print long, w0 long, w1 long").distinct())
    sizes = sorted(r.n for r in windows.select("n").distinct().collect())  # at most WINDOW rows
    rows = id_and_text(docs, doc_id, text)
    rows = rows.select("doc_id", "text", row_key(rows.text).alias("row_key"))
    prints = windows.select("print").distinct()
    if prints.count() <= max_broadcast:
        known = np.sort(np.array([r.print for r in prints.collect()], np.int64).view(np.uint64))  # no more than max_broadcast
        found = rows.mapInArrow(_hits(sizes if len(known) else [], known), _FOUND)
    else:
        runs = rows.mapInArrow(_runs(sizes), "print long, doc_id long, row_key long, start long, size long, n long").join(prints, "print", "left_semi")
        of_doc = runs.groupBy("doc_id", "row_key").agg(F.collect_set(F.struct("start", "size", "n")).alias("runs"))  # no more than a document's windows
        once = rows.withColumn("doc_id", F.coalesce("doc_id", F.lit(NULL_ID))).dropDuplicates(["doc_id", "row_key"])
        found = once.join(of_doc, ["doc_id", "row_key"]).select("doc_id", "text", "row_key", "runs").mapInArrow(_again, _FOUND)
    return (
        found.join(windows.select("item", "n", "w0", "w1"), ["n", "w0", "w1"])
        .groupBy("doc_id", "row_key")
        .agg(F.collect_set(F.struct("start", "n")).alias("windows"), F.array_sort(F.collect_set("item")).alias("items"))
    )


def decontaminate(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """Per document: words, words hit, items with occurring windows and their digest, and whether any word is hit."""
    rows = id_and_text(docs, doc_id, text)
    found = hits(rows, items, item_id=item_id, item_text=item_text, max_broadcast=max_broadcast)
    counts = rows.select("doc_id", "text", row_key(rows.text).alias("row_key")).mapInArrow(_counts, "doc_id long, row_key long, n_words long")
    both = counts.join(found.withColumnsRenamed({"doc_id": "__id", "row_key": "__key"}), (F.coalesce(counts.doc_id, F.lit(NULL_ID)) == F.col("__id")) & (counts.row_key == F.col("__key")), "left")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = batch.to_pydict()
            n_hit = []
            for size, got in zip(c["n_words"], c["windows"], strict=True):
                hit = np.zeros(size, bool)
                for n in {w["n"] for w in got or ()}:
                    hit |= cover(np.array([w["start"] for w in got if w["n"] == n]), n, size)
                n_hit.append(int(hit.sum()))
            sums = [hashlib.sha256(",".join(x or ()).encode()).hexdigest() for x in c["items"]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), pa.array(n_hit, pa.int64()), pa.array([len(x or ()) for x in c["items"]], pa.int64()), pa.array(sums, pa.string()), pa.array([x > 0 for x in n_hit], pa.bool_())], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return both.select("doc_id", "n_words", "windows", "items").mapInArrow(digest, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")
