"""Packing into length buckets of least padding.

A global histogram of token counts goes to the driver: a row for each length that
occurs, so its size is bounded by the longest text and not by the number of
documents. Dynamic programming picks the bucket boundaries of least total padding,
over the lower envelope of lines, in time proportional to buckets x lengths. Inside
a bucket, batches hold as many documents as fit a token budget when padded to the
bucket's boundary. Places in a bucket come from counts of (bucket, shard), with
shards of bounded size, so no task sees a whole bucket.

A token is a run of letters, digits and bytes of other scripts, or one other byte
that is not white space; ``pack`` takes any other lengths as well, and carries
further columns (texts, token ids) to the batches. Nulls: a null text has no
tokens and goes to the first bucket, as does a null length; a null doc_id is kept.
Repeated rows are packed each on their own. A document longer than the budget is a
batch of its own; none is cut or dropped. Columns of the lengths that are named as
one of the result are left out. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import SPACE, blocks, byte_set, id_column
from .shared import checkpointed, id_and_text

BUCKETS, TOKEN_BUDGET, SHARD_ROWS = 16, 65_536, 20_000
_WORD = byte_set((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))


def token_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """(doc_id, n_tokens) for each row, and its text if asked for."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch):
                word = _WORD[b.data]
                token = ~SPACE[b.data] & ~word
                head = word.copy()
                head[1:] &= ~word[:-1]
                starts = b.offsets[:-1][np.diff(b.offsets) > 0]
                head[starts] = word[starts]
                sums = np.concatenate([[0], np.cumsum(token | head)])
                columns = {"doc_id": id_column(b.ids), "n_tokens": pa.array(np.diff(sums[b.offsets]))}
                if with_text:
                    columns["text"] = batch.column(1).slice(b.lo, len(b))
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return id_and_text(docs, doc_id, text).mapInArrow(count, "doc_id long, n_tokens long" + (", text string" if with_text else ""))


def boundaries(longest: np.ndarray, counts: np.ndarray, n_buckets: int) -> list[int]:
    """The upper ends, out of ``longest`` (ascending), of at most n_buckets buckets with the least padding of ``counts`` rows.

    A choice costs the padded size of all rows, since their own tokens are the same
    in any. With one bucket more, the rows up to end j cost L[j] R[j] + min over
    i < j of best[i] - L[j] R[i], R being the number of rows so far: lines of
    falling slope asked at rising places.
    """
    size, rows = [int(x) for x in longest], [int(x) for x in np.cumsum(counts)]
    n = len(size)
    if not n:
        return []
    best, back = [x * r for x, r in zip(size, rows, strict=True)], []
    for _ in range(1, min(n_buckets, n)):
        now, come, lines, at = list(best), [-1] * n, [], 0
        for j in range(1, n):
            i = j - 1
            while len(lines) - at >= 2:
                a, b = lines[-2], lines[-1]
                # b never is the least if i passes a before b does
                if (best[i] - best[a]) * (rows[b] - rows[a]) > (best[b] - best[a]) * (rows[i] - rows[a]):
                    break
                lines.pop()
            lines.append(i)
            while len(lines) - at >= 2 and best[lines[at + 1]] - size[j] * rows[lines[at + 1]] <= best[lines[at]] - size[j] * rows[lines[at]]:
                at += 1
            cost = best[lines[at]] + size[j] * (rows[j] - rows[lines[at]])
            if cost < now[j]:
                now[j], come[j] = cost, lines[at]
        best = now
        back.append(come)
    ends, j = [n - 1], n - 1
    for come in reversed(back):
        if come[j] >= 0:
            j = come[j]
            ends.append(j)
    return [size[j] for j in reversed(ends)]


RESULT = ("doc_id", "n_tokens", "bucket", "bucket_len", "batch", "slot", "padding")


def pack(lengths: DataFrame, n_buckets: int = BUCKETS, token_budget: int = TOKEN_BUDGET, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """lengths (doc_id, n_tokens) with bucket, bucket_len, batch, slot and padding; further columns follow."""
    more = [c for c in lengths.columns if c.lower() not in RESULT]
    carried = F.struct(*(lengths[c] for c in more)) if more else F.lit(None).cast("int")
    rows = checkpointed(lengths.select(lengths["doc_id"].alias("doc_id"), F.coalesce(lengths["n_tokens"].cast("long"), F.lit(0).cast("long")).alias("n_tokens"), carried.alias("more"), F.monotonically_increasing_id().alias("uid")))
    cells = rows.groupBy("n_tokens").agg(F.count("*").alias("c")).collect()  # a row for each length that occurs
    cells.sort(key=lambda r: r.n_tokens)
    ends = boundaries(np.array([r.n_tokens for r in cells], np.int64), np.array([r.c for r in cells], np.int64), n_buckets)
    shards = max(1, -(-sum(r.c for r in cells) // shard_rows))
    bucket, length = F.lit(0), F.lit(ends[0] if ends else 0)
    for i, end in enumerate(ends[:-1]):
        bucket = F.when(F.col("n_tokens") > end, i + 1).otherwise(bucket)
        length = F.when(F.col("n_tokens") > end, ends[i + 1]).otherwise(length)
    rows = rows.withColumns({"bucket": bucket.cast("int"), "bucket_len": length.cast("long"), "shard": F.pmod(F.xxhash64("uid"), F.lit(shards))})
    before = Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("bucket", "shard").count().select("bucket", "shard", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    place = F.col("offset") + F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("uid")) - 1
    each = F.greatest(F.lit(1), F.expr(f"{token_budget} div greatest(bucket_len, 1)"))
    placed = rows.join(offsets, ["bucket", "shard"]).withColumn("place", place)
    return placed.select("doc_id", "n_tokens", "bucket", "bucket_len", F.floor(F.col("place") / each).cast("long").alias("batch"), F.pmod("place", each).cast("long").alias("slot"), (F.col("bucket_len") - F.col("n_tokens")).alias("padding"), *(F.col("more")[c].alias(c) for c in more))
