"""Removal of lines that an earlier document has, by one range-partitioned sort.

Texts are cut at line feeds. A line's key is the line without ASCII white space
at its ends, A-Z in lower case; only keys of ``min_chars`` code points count.
Hashes of the keys, with document and line number, are partitioned by range over
(hash, document, line) and sorted inside the partitions, so a line that very many
documents have spreads over as many partitions as it needs. A task streams its
rows and keeps only the current run's first document; where a run began in an
earlier partition, that document comes from a summary of one row per partition.
Lines of later documents are dropped. Results are compressed bitmaps per
document; texts move only in ``apply_bitmaps``.

Nulls: a null text is one empty line; a null doc_id sorts after all others.
Rows that repeat a doc_id are one document. Extra columns are kept, whatever their
names. Texts and lines of any length are read whole. Empty tables give empty
results.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import LOWER, NULL_ID, SPACE, Spans, blocks
from .shared import checkpointed, id_and_text, row_key, unused

MIN_CHARS = 10
_LINES = "h0 long, h1 long, doc_id long, row_key long, line long, n_lines long"
_LINES_ARROW = pa.schema([(n, pa.int64()) for n in ("h0", "h1", "doc_id", "row_key", "line", "n_lines")])
_BITMAPS_ARROW = pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("keep", pa.binary())])


def _lines(min_chars: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row_keys = batch.column(2).to_numpy()
            for b in blocks(batch):
                feeds = np.flatnonzero(b.data == 0x0A)
                starts = np.sort(np.concatenate([b.offsets[:-1], feeds + 1]))  # as many as lines
                row = np.repeat(np.arange(len(b)), np.diff(np.searchsorted(feeds, b.offsets)) + 1)
                ends = np.append(starts[1:], len(b.data) + 1) - 1
                tail = np.append(row[1:] != row[:-1], True) if len(row) else np.empty(0, bool)
                ends[tail] = b.offsets[1:]
                ink = np.flatnonzero(~SPACE[b.data])
                lo, hi = np.searchsorted(ink, starts), np.searchsorted(ink, ends)
                some = hi > lo
                s, e, r, at = ink[lo[some]], ink[hi[some] - 1] + 1, row[some], np.flatnonzero(some)
                points = np.concatenate([[0], np.cumsum((b.data & 0xC0) != 0x80)])
                long = points[e] - points[s] >= min_chars
                s, e, r, at = s[long], e[long], r[long], at[long]
                n_lines = np.bincount(row, minlength=len(b))
                first = np.cumsum(n_lines) - n_lines
                low = LOWER[b.data]
                keys = [Spans(low, lane)(s, e).view(np.int64) for lane in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*keys, b.ids[r], row_keys[b.lo : b.hi][r], at - first[r], n_lines[r])], schema=_LINES_ARROW)

    return cut


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for a partition: its first and last key, and the document with which the last key's run begins in it."""
    first = last = None
    for batch in batches:
        h0, h1, doc = (batch.column(i).to_numpy() for i in range(3))
        if not len(h0):
            continue
        new = np.flatnonzero((h0[1:] != h0[:-1]) | (h1[1:] != h1[:-1]))
        at = new[-1] + 1 if len(new) else 0
        key = (int(h0[at]), int(h1[at]))
        if first is None:
            first = (int(h0[0]), int(h1[0]))
        if last is None or last[:2] != key:
            last = (*key, int(doc[at]))
    if last:
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (TaskContext.get().partitionId(), *first, *last)], names=["part", "f0", "f1", "l0", "l1", "doc"])


def _later(carried: dict[int, tuple[int, int, int]]):
    """Rows of lines that an earlier document has. carried: for a partition that goes on with an earlier one's run, the key and its document."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = carried.get(TaskContext.get().partitionId())
        for batch in batches:
            h0, h1, doc = (batch.column(i).to_numpy() for i in range(3))
            if not len(h0):
                continue
            new = np.ones(len(h0), bool)
            new[1:] = (h0[1:] != h0[:-1]) | (h1[1:] != h1[:-1])
            at = np.flatnonzero(new)
            owner = doc[at]
            if run and run[:2] == (h0[0], h1[0]):
                owner[0] = run[2]
            run = (int(h0[at[-1]]), int(h1[at[-1]]), int(owner[-1]))
            yield batch.filter(pa.array(doc != owner[np.cumsum(new) - 1])).select(["doc_id", "row_key", "line", "n_lines"])

    return stream


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pydict()
        maps = []
        for n, gone in zip(rows["n_lines"], rows["gone"], strict=True):
            keep = np.ones(n, bool)
            keep[gone] = False
            maps.append(zlib.compress(np.packbits(keep).tobytes(), 1))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row_key"), batch.column("n_lines"), pa.array([len(g) for g in rows["gone"]], pa.int64()), pa.array(maps, pa.binary())], schema=_BITMAPS_ARROW)


def line_bitmaps(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, row_key, n_lines, n_dropped, keep) of the documents that lose lines; a null doc_id stands as the largest long."""
    rows = id_and_text(docs, doc_id, text)
    order = ["h0", "h1", "doc_id", "line"]
    lines = checkpointed(rows.select("doc_id", "text", row_key(rows.text).alias("row_key")).mapInArrow(_lines(min_chars), _LINES).repartitionByRange(*order).sortWithinPartitions(*order))
    carried, run = {}, None
    for e in sorted(lines.mapInArrow(_edges, "part long, f0 long, f1 long, l0 long, l1 long, doc long").collect()):  # a row for each partition, whatever the data
        if run and run[:2] == (e.f0, e.f1):
            carried[e.part] = run
        run = run if run and run[:2] == (e.l0, e.l1) else (e.l0, e.l1, e.doc)
    return (
        lines.mapInArrow(_later(carried), "doc_id long, row_key long, line long, n_lines long")
        .groupBy("doc_id", "row_key", "n_lines")
        .agg(F.collect_set("line").alias("gone"))  # no more than a document's lines
        .mapInArrow(_bitmaps, "doc_id long, row_key long, n_lines long, n_dropped long, keep binary")
    )


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, str, str]:
    """(docs with two more columns, their names: bitmap and number of lines dropped); both null where nothing goes."""
    names = [unused(n, docs.columns) for n in ("keep", "n_dropped")]
    b = bitmaps.select(bitmaps["doc_id"].alias("__id"), bitmaps["row_key"].alias("__key"), bitmaps["keep"].alias("__keep"), bitmaps["n_dropped"].alias("__n"))
    same = (F.coalesce(docs[doc_id].cast("long"), F.lit(NULL_ID)) == b["__id"]) & (row_key(docs[text].cast("string")) == b["__key"])
    return docs.join(b, same, "left").select(*(docs[c] for c in docs.columns), b["__keep"].alias(names[0]), b["__n"].alias(names[1])), *names


def kept_lines(text: str | None, keep: bytes | None) -> str:
    text = text or ""
    if keep is None:
        return text
    lines = text.split("\n")
    mask = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines))
    return "\n".join([x for x, k in zip(lines, mask, strict=True) if k])


def line_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """Per document: lines, lines dropped, and the digest of what stays."""
    rows = id_and_text(docs, doc_id, text)
    marked, keep, n_dropped = apply_bitmaps(rows, line_bitmaps(rows, min_chars=min_chars))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keeps = batch.column("text").to_pylist(), batch.column(keep).to_pylist()
            sums = [hashlib.sha256(kept_lines(t, k).encode()).hexdigest() for t, k in zip(texts, keeps, strict=True)]
            counts = [(t or "").count("\n") + 1 for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), batch.column(n_dropped).fill_null(0), pa.array(sums, pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    return marked.mapInArrow(digest, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")
