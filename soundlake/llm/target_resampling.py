"""Importance resampling towards a target distribution over hashed features.

Features are runs of 1 to ``n`` consecutive words. A first pass writes each pack of
documents (about 2 MB of text) as a stream of packed uint16 buckets with the places
at which its documents begin. Counts come from the written streams: a task sorts
each stream, run-length encodes it and adds the runs up, so it gives out at most a
row for each bucket, and these are summed. Gains, one number for each bucket, then
go to all tasks, which gather them along the streams and add them up for each
document by ``np.add.reduceat``. All documents count, and all texts of the target.

``draw`` ranks documents by range partitions over (score, doc_id): no task sees more
than its range, and equal rows are dealt over several.

Nulls: a null text has no words; a null doc_id is hashed as the empty string and
comes last among equal scores. Rows that share a doc_id are drawn each on its own.
Texts of any length are read in pieces of PIECE bytes. Other columns are not read.
Empty tables: no documents give no rows; without a target all t are 0.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import LOWER, NULL_ID, blocks, byte_set, id_column
from .shared import checkpointed, id_and_text

PIECE = 1 << 20
_WORD = byte_set((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
#: Lower-cases A-Z and blanks whatever is in no word; UTF-8 keeps other characters in bytes from 0x80.
_CLEAN = np.where(_WORD, LOWER, 0x20).astype(np.uint8).tobytes()
_PACK = pa.schema([("ids", pa.binary()), ("words", pa.binary()), ("offsets", pa.binary()), ("stream", pa.binary())])


def _hashed(text: bytes, n: int, n_buckets: int) -> tuple[int, list[np.ndarray]]:
    """(words, buckets of all runs) of a text."""
    text, lo, n_words, held = text.translate(_CLEAN), 0, 0, []
    out: list[np.ndarray] = []
    while lo < len(text):
        hi = text.find(b" ", lo + PIECE)
        hi = len(text) if hi < 0 else hi
        words = text[lo:hi].split()
        lo, n_words = hi, n_words + len(words)
        sums = [np.fromiter(map(zlib.crc32, words), np.uint32, len(words))]
        if n > 1:
            seq = held + words
            for k in range(2, n + 1):
                begin = max(len(held) - k + 1, 0)
                sums.append(np.array([zlib.crc32(b" ".join(seq[i : i + k])) for i in range(begin, len(seq) - k + 1)], np.uint32))
            held = seq[1 - n :]
        out += [(x % np.uint32(n_buckets)).astype(np.uint16) for x in sums]
    return n_words, out


def bucket_streams(docs: DataFrame, n: int = 1, n_buckets: int = 10_000, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Written packs: ids, words of each document, offsets into the stream (one more than documents) and the stream, as packed integers of 64, 64, 64 and 16 bits."""
    if not 0 < n_buckets <= 1 << 16:
        raise ValueError("a bucket must fit 16 bits")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch):
                counts, sizes, stream = [], [], []
                for row in range(len(block)):
                    n_words, parts = _hashed(block.text(row), n, n_buckets)
                    counts.append(n_words)
                    sizes.append(sum(map(len, parts)))
                    stream += parts
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
                row = (block.ids, np.array(counts, np.int64), offsets, np.concatenate(stream) if stream else np.empty(0, np.uint16))
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in row], schema=_PACK)

    return checkpointed(id_and_text(docs, doc_id, text).mapInArrow(pack, "ids binary, words binary, offsets binary, stream binary"))


def bucket_counts(streams: DataFrame, n_buckets: int = 10_000) -> np.ndarray:
    """How often each bucket occurs in all streams."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_buckets, np.int64)
        for batch in batches:
            for raw in batch.column("stream"):
                values = np.sort(np.frombuffer(raw.as_buffer(), np.uint16))
                at = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.empty(0, np.int64)
                total[values[at]] += np.diff(np.append(at, len(values)))
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(total[found])], names=["bucket", "n"])

    counts = np.zeros(n_buckets, np.int64)
    rows = streams.select("stream").mapInArrow(runs, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # n_buckets rows at most
    for r in rows:
        counts[r.bucket] = r.n
    return counts


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The log-ratio of the smoothed target to the smoothed raw share of each bucket, in thousandths, rounded down."""
    extra = float(len(raw))
    s_all, t_all = float(raw.sum()) + extra, float(target.sum()) + extra
    return np.array([math.floor(1000 * math.log((float(t) + 1) * s_all / ((float(s) + 1) * t_all))) for s, t in zip(raw, target, strict=True)], np.int64)


def gumbel(doc_id: int | None, seed: int) -> int:
    """A Gumbel number of the document in thousandths, rounded down."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(streams: DataFrame, gains: np.ndarray, seed: int = 2024) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every document."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, words, offsets = (np.frombuffer(row[c], np.int64) for c in ("ids", "words", "offsets"))
                stream, sizes = np.frombuffer(row["stream"], np.uint16), np.diff(offsets)
                weight, some = np.zeros(len(ids), np.int64), sizes > 0  # reduceat gives an empty slice the next value
                if some.any():
                    weight[some] = np.add.reduceat(gains[stream], offsets[:-1][some])
                score = weight + np.array([gumbel(None if i == NULL_ID else i, seed) for i in ids.tolist()], np.int64)
                yield pa.RecordBatch.from_arrays([id_column(ids), pa.array(words), pa.array(sizes), pa.array(weight), pa.array(score)], names=["doc_id", "n_words", "n_features", "weight", "score"])

    return streams.mapInArrow(gather, "doc_id long, n_words long, n_features long, weight long, score long")


def draw(scored: DataFrame, percent: int = 10, min_words: int = 20) -> DataFrame:
    """scored with rank: 1, 2, 3 ... for the highest scores, percent of the documents that have min_words, null for the others; smaller doc_id first among equals."""
    rows = checkpointed(scored.withColumn("_row", F.monotonically_increasing_id()))
    able = F.col("n_words") >= min_words
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("_row")]
    ordered = checkpointed(rows.where(able).repartitionByRange(*order).sortWithinPartitions(*order).drop("_row"))
    sizes = {r.part: r.n for r in ordered.groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n")).collect()}  # a row a partition
    base, n = {}, 0
    for part in sorted(sizes):
        base[part], n = n, n + sizes[part]
    k = n * percent // 100

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = base.get(TaskContext.get().partitionId(), 0)
        for batch in batches:
            rank = np.arange(at + 1, at + 1 + len(batch))
            at += len(batch)
            yield batch.append_column("rank", pa.array(rank, mask=rank > k))

    return ordered.mapInArrow(ranked, "doc_id long, n_words long, n_features long, weight long, score long, rank long").unionByName(rows.where(~able).drop("_row").withColumn("rank", F.lit(None).cast("long")))


def target_resampling(docs: DataFrame, target: DataFrame, n: int = 1, n_buckets: int = 10_000, percent: int = 10, min_words: int = 20, seed: int = 2024) -> DataFrame:
    """Every document with its weight, score and rank."""
    streams = bucket_streams(docs, n, n_buckets)
    gains = bucket_gains(bucket_counts(streams, n_buckets), bucket_counts(bucket_streams(target.select(F.lit(0).alias("doc_id"), "text"), n, n_buckets), n_buckets))
    return draw(weigh(streams, gains, seed), percent, min_words)
