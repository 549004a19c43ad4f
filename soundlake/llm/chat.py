"""Chat formatting at token level.

Each turn's role and text are escaped, encoded on their own and framed with
reserved ids beyond the vocabulary: START role SEP text END. No text can yield a
reserved id. In the readable form the reserved ids stand as control strings, so
those are escaped inside texts: a backslash doubles, and a backslash breaks every
control string after its first character. The loss mask covers the tokens of
assistant texts; it is the running sum of +1 and -1 at their edges.

Turns are partitioned by range over (conversation, turn), so a conversation with a
third of all turns spreads over as many tasks as it needs, and each task encodes
its turns and gives out parts of bounded length, numbered in order. Reading back
decodes the parts wherever they are; only the digests of a whole conversation need
its decoded parts in one stream, which holds one part at a time. A turn is encoded
whole, whatever its length.

The tokenizer's file must lie under the same path on every executor.

Nulls: a null text or role is empty, a null turn comes first, a null conv_id is
a conversation of its own. Rows that repeat a turn all stay, ordered by role and
a hash of the text. Other columns are not read. Empty tables give empty results.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The published splitting pattern of this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CONTROL = ("<turn>", "<text>", "</turn>")
PART_TOKENS = 65_536
_ESCAPE = re.compile(r"\\|<(?=turn>|text>|/turn>)")
_codecs: dict = {}


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return re.sub(r"(\\|<)\\", r"\1", text)


class Codec:
    """Byte-level encoding from a file of ranks; reserved ids follow the vocabulary."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.codec = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.start, self.sep, self.end = (max(ranks.values()) + 1 + i for i in range(3))

    def encode(self, text: str) -> list[int]:
        return self.codec.encode_ordinary(text)

    def decode(self, ids: np.ndarray) -> str:
        return self.codec.decode_bytes(ids.tolist()).decode()


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


ORDER = ["conv_id", "turn", "role", "text_key"]


def encode_turns(turns: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(conv_id, turn, role, n_role, ids): each turn's framed ids as 32-bit integers, in order of conversation and turn; n_role ids are the role's."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer)
        for batch in batches:
            for lo in range(0, len(batch), 512):
                part, sizes, ids = batch.slice(lo, 512), [], []
                for role, text in zip(part.column("role").to_pylist(), part.column("text").to_pylist(), strict=True):
                    r = c.encode(escape(role))
                    sizes.append(len(r))
                    ids.append(np.array([c.start, *r, c.sep, *c.encode(escape(text)), c.end], np.int32).tobytes())
                yield pa.RecordBatch.from_arrays([*(part.column(x) for x in ORDER[:3]), pa.array(sizes, pa.int32()), pa.array(ids, pa.binary())], names=["conv_id", "turn", "role", "n_role", "ids"])

    some = F.coalesce(turns["text"].cast("string"), F.lit(""))
    rows = turns.select(turns["conv_id"].cast("long").alias("conv_id"), turns["turn"].cast("long").alias("turn"), F.coalesce(turns["role"].cast("string"), F.lit("")).alias("role"), F.xxhash64(some).alias("text_key"), some.alias("text"))
    return rows.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).mapInArrow(encode, "conv_id long, turn long, role string, n_role int, ids binary")


def format_conversations(turns: DataFrame, tokenizer: str = TOKENIZER, part_tokens: int = PART_TOKENS) -> DataFrame:
    """(conv_id, part, input_ids, loss_mask): conversations in parts of whole turns; a conversation's parts are numbered in order, with gaps."""

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, part, held, size = None, TaskContext.get().partitionId() << 32, [], 0

        def out() -> pa.RecordBatch:
            ids = np.concatenate([x for _, _, x in held])
            ends = np.cumsum([len(x) for _, _, x in held])
            edge = np.zeros(len(ids) + 1, np.int64)
            for (role, n_role, x), end in zip(held, ends, strict=True):
                if role == "assistant":
                    edge[end - len(x) + n_role + 2] += 1
                    edge[end - 1] -= 1
            mask = np.cumsum(edge[:-1]) > 0
            one = lambda x, kind: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, kind))
            return pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([part], pa.int64()), one(ids, pa.int32()), one(mask, pa.bool_())], names=["conv_id", "part", "input_ids", "loss_mask"])

        for batch in batches:
            for c, role, n_role, raw in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "role", "n_role", "ids")), strict=True):
                x = np.frombuffer(raw, np.int32)
                if held and (c != conv or size + len(x) > part_tokens):
                    yield out()
                    held, size, part = [], 0, part + 1
                conv = c
                held.append((role, n_role, x))
                size += len(x)
        if held:
            yield out()

    return encode_turns(turns, tokenizer).mapInArrow(assemble, "conv_id long, part long, input_ids array<int>, loss_mask array<boolean>")


def decode_parts(formatted: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(conv_id, part, n_turns, turns, loss, loss_chars, formatted_chars) of each part, from ids and masks alone: what the digests read, as bytes, and counts."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer)
        for batch in batches:
            rows: list[tuple] = []
            ids_column, mask_column = batch.column("input_ids"), batch.column("loss_mask")
            for i in range(len(batch)):
                ids = ids_column[i].values.to_numpy()
                mask = mask_column[i].values.to_numpy(zero_copy_only=False)
                starts, seps, ends = (np.flatnonzero(ids == x) for x in (c.start, c.sep, c.end))
                said, chars = [], 0
                for s, m, e in zip(starts, seps, ends, strict=True):
                    role, text = c.decode(ids[s + 1 : m]), c.decode(ids[m + 1 : e])
                    said += (unescape(role), unescape(text))
                    chars += len(role) + len(text) + sum(map(len, CONTROL))
                edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
                loss = "".join(unescape(c.decode(ids[lo:hi])) for lo, hi in zip(edge[::2], edge[1::2], strict=True))
                rows.append((len(starts), "".join(f"{x}\n" for x in said).encode(), loss.encode(), len(loss), chars))
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("part"), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], names=["conv_id", "part", "n_turns", "turns", "loss", "loss_chars", "formatted_chars"])

    return formatted.mapInArrow(decode, "conv_id long, part long, n_turns long, turns binary, loss binary, loss_chars long, formatted_chars long")


def read_back(formatted: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """Per conversation, from ids and masks alone: turns, loss text and their digests, and the readable form's length."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list | None = None

        def out(rows: list) -> pa.RecordBatch:
            cols = [[r[0] for r in rows], [r[1] for r in rows], [r[2].hexdigest() for r in rows], [r[3] for r in rows], [r[4].hexdigest() for r in rows], [r[5] for r in rows]]
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            done = []
            for r in batch.to_pylist():
                if now is None or now[0] != r["conv_id"]:
                    if now:
                        done.append(now)
                    now = [r["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                now[1] += r["n_turns"]
                now[2].update(r["turns"])
                now[3] += r["loss_chars"]
                now[4].update(r["loss"])
                now[5] += r["formatted_chars"]
            if done:
                yield out(done)
        if now:
            yield out([now])

    return decode_parts(formatted, tokenizer).repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
