"""Questions that packs of documents put to the whole corpus.

Documents are gathered, in the order in which tasks read them, into packs of
about 2 MB, kept compressed in the checkpoint folder. A pack asks questions about
keys (hashes) that occur in it: each key goes once per pack, whatever the number
of its documents that hold it, to the bucket of its leading bits, and the bucket
answers each key and pack. A key that a third of all documents hold thus costs
one entry per pack, buckets stay even because keys are hashes, and no text moves
except to meet its answers. A text longer than 2 MB is a pack of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .blocks import BLOCK_BYTES, Block, blocks_of, id_values, text_buffers
from .shared import checkpointed, id_and_text

PACK = pa.schema([("pack_id", pa.int64()), ("ids", pa.binary()), ("sizes", pa.binary()), ("texts", pa.binary())])
ASK = pa.schema([("question", pa.int32()), ("bucket", pa.int32()), ("pack_id", pa.int64()), ("columns", pa.list_(pa.binary()))])
ANSWER = pa.schema([("pack_id", pa.int64()), ("question", pa.int32()), ("bucket", pa.int32()), ("said", pa.binary())])
_SQL = {"PACK": "pack_id long, ids binary, sizes binary, texts binary", "ASK": "question int, bucket int, pack_id long, columns array<binary>", "ANSWER": "pack_id long, question int, bucket int, said binary"}

#: A pack's distinct keys in ascending order: two 64-bit lanes and a value each.
Keys = tuple[np.ndarray, np.ndarray, np.ndarray]
KEYS = (("u8", ()), ("u8", ()), ("i8", ()))


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task, n = TaskContext.get().partitionId(), 0
    squeeze = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        for b in blocks_of(id_values(batch.column(0)), *text_buffers(batch.column(1)), BLOCK_BYTES):
            row = [[(task << 32) + n], [b.ids.tobytes()], [np.diff(b.offsets).tobytes()], [squeeze.compress(b.data.tobytes())]]
            n += 1
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(row, PACK, strict=True)], schema=PACK)


def packs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    return checkpointed(id_and_text(docs, doc_id, text).mapInArrow(_gather, _SQL["PACK"]))


def block_of(row: dict) -> Block:
    sizes = np.frombuffer(row["sizes"], np.int64)
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["texts"], max_output_size=int(sizes.sum()) + 1), np.uint8)
    return Block(np.frombuffer(row["ids"], np.int64), data, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64))


def distinct(k0: np.ndarray, k1: np.ndarray, vals: np.ndarray | None = None) -> tuple[Keys, np.ndarray, np.ndarray]:
    """(distinct keys with their least value, how often each occurs, each entry's place among them)."""
    vals = np.zeros(len(k0), np.int64) if vals is None else vals
    order = np.lexsort((vals, k1, k0))
    a, b = k0[order], k1[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    at = np.flatnonzero(new)
    place = np.empty(len(a), np.int64)
    place[order] = np.cumsum(new) - 1
    return (a[at], b[at], vals[order][at]), np.diff(np.append(at, len(a))), place


def _buckets(k0: np.ndarray, n: int) -> np.ndarray:
    return ((k0 >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def _asked(pack_id: int, asked: dict[int, tuple[np.ndarray, ...]], n: int) -> pa.RecordBatch:
    """A row for each question and bucket; the first column of a question holds its keys, in ascending order."""
    rows: list[list] = [[], [], [], []]
    for question, columns in asked.items():
        bucket = _buckets(columns[0], n)
        ids, at = np.unique(bucket, return_index=True)
        ends = np.append(at, len(bucket))[1:]
        rows[0] += [question] * len(ids)
        rows[1] += ids.tolist()
        rows[2] += [pack_id] * len(ids)
        rows[3] += [[x[i:j].tobytes() for x in columns] for i, j in zip(at, ends, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(rows, ASK, strict=True)], schema=ASK)


def _tables(rows: DataFrame, answers: DataFrame | None, fn: Callable, schema: str) -> DataFrame:
    """fn(block, pack_id, answers by question) for each pack, together with the answers that it got."""
    if answers is None:

        def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    yield fn(block_of(row), row["pack_id"], {})

        return rows.mapInArrow(alone, schema)

    def together(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by([("question", "ascending"), ("bucket", "ascending")])
        said: dict[int, list[bytes]] = {}
        for q, x in zip(right["question"].to_pylist(), right["said"].to_pylist(), strict=True):
            said.setdefault(q, []).append(x)
        row = left.to_pylist()[0]
        return pa.Table.from_batches([fn(block_of(row), row["pack_id"], {q: np.frombuffer(b"".join(x), np.uint8) for q, x in said.items()})])

    return rows.groupBy("pack_id").cogroup(answers.groupBy("pack_id")).applyInArrow(together, schema)


def ask(rows: DataFrame, emit: Callable[[Block, dict], dict], answers_of: dict[int, tuple[tuple, Callable]], n_buckets: int, answers: DataFrame | None = None) -> DataFrame:
    """Puts each pack's questions to buckets.

    emit(block, answers so far) gives the columns of each question. answers_of has,
    for each question, the kinds of these columns and a function of all of a
    bucket's entries (the columns, then the pack), in the order of the packs, that
    gives an answer for each.
    """

    def reply(key: tuple, t: pa.Table) -> pa.Table:
        question = key[0].as_py()
        kinds, answer = answers_of[question]
        t = t.sort_by("pack_id")
        ids, cells = t["pack_id"].to_numpy(), t["columns"].to_pylist()
        columns = [np.frombuffer(b"".join(c[k] for c in cells), kind).reshape(-1, *shape) for k, (kind, shape) in enumerate(kinds)]
        counts = [len(c[0]) // 8 for c in cells]
        said = answer(*columns, np.repeat(ids, counts))
        cuts = np.cumsum([0, *counts])
        return pa.table([pa.array(ids), t["question"], t["bucket"], pa.array([said[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], schema=ANSWER)

    return _tables(rows, answers, lambda block, pack_id, said: _asked(pack_id, emit(block, said), n_buckets), _SQL["ASK"]).groupBy("question", "bucket").applyInArrow(reply, _SQL["ANSWER"])


def finish(rows: DataFrame, answers: DataFrame, fn: Callable[[Block, dict], pa.RecordBatch], schema: str) -> DataFrame:
    return _tables(rows, answers, lambda block, _, said: fn(block, said), schema)


def groups(*lanes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start of each group of equal entries in sorted lanes, each entry's group)."""
    new = np.ones(len(lanes[0]), bool)
    new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in lanes])
    return np.flatnonzero(new), np.cumsum(new) - 1


def by_key(answer: Callable) -> Callable:
    """Lets answer see entries sorted by key, value and pack."""

    def run(k0: np.ndarray, k1: np.ndarray, vals: np.ndarray, pack: np.ndarray) -> np.ndarray:
        order = np.lexsort((pack, vals, k1, k0))
        said = np.empty(len(k0), np.uint8)
        said[order] = answer(k0[order], k1[order], vals[order], pack[order])
        return said

    return run


def said_elsewhere(k0: np.ndarray, k1: np.ndarray, vals: np.ndarray, pack: np.ndarray) -> np.ndarray:
    """1 for keys that another pack holds too."""
    at, of = groups(k0, k1)
    return (np.diff(np.append(at, len(k0))) > 1)[of].astype(np.uint8)


def said_smaller(k0: np.ndarray, k1: np.ndarray, vals: np.ndarray, pack: np.ndarray) -> np.ndarray:
    """1 for keys that another pack holds with a smaller value."""
    at, of = groups(k0, k1)
    return (vals[at][of] < vals).astype(np.uint8)


def bucket_count(rows: DataFrame) -> int:
    """About four packs' keys to a bucket: a bucket's size stays the same as the corpus grows."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.count() // 4, 1)
