"""Token ids in Parquet files: one list a document, in ascending order of documents.

``write_tokens`` sorts documents by range over their ids and encodes each range
straight into one file, the shard: a row holds doc_id, the shard, the list of ids,
and the places ``at`` and ``stop`` that the list has among the shard's ids. Lists are
dictionary-encoded (a dictionary holds the vocabulary once for a row group, and ids
take as many bits as it needs), doc_id, at and stop are delta-encoded, and all have
page indexes. As at and stop ascend, a reader that asks for a range of tokens or
some documents opens few files, row groups and pages, and one that asks for counts
reads no lists. ``shards`` gives each file's place in the whole from these counts.

Text is encoded between spaces, tabs and line ends, which the tokenizer drops and
no rule of it reaches across, so an id list is the same as that of the whole text;
chunks met before come from a cache of CACHED entries, of which the earlier half stays
when it is full. Words are parted from the marks after them where the file's own
pattern does so. A text is cut into pieces of
about PIECE characters at such places; a chunk without any is encoded whole. So a
text needs memory for its ids, not for the encoder's view of all of them.

Special strings in a text get the ids that the tokenizer's file gives them.
Nulls: a null text is empty, that is the end id alone; documents with a null doc_id
come last. Rows that share a doc_id all stay, by a hash of the text; a hot doc_id is
dealt over several shards. Other columns are not read. An empty table gives files
without rows. The tokenizer's file must lie under the same path on every executor.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import string
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import id_and_text, row_key, shared_folder

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
END_ID = 2
#: Characters of text that are encoded at a time, and chunks that a worker remembers.
PIECE, CACHED, LONGEST_CACHED = 1 << 20, 500_000, 64
#: Rows that a task gives out at a time, in ids.
BATCH_IDS = 1 << 20
#: Sizes of a row group and of a page in bytes, and rows of a page at most.
ROW_GROUP, PAGE, PAGE_ROWS = 64 << 20, 256 << 10, 4096
#: The tokenizer's pattern of token groups, and the end of the last token of each.
PATTERN, END = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+", "</w>"
#: Marks that may follow a word: of ASCII, all but the apostrophe, which begins groups with letters in them.
MARKS = string.punctuation.replace("'", "")
#: Marks between a letter or digit and white space; the mark comes first, so that the search for it is fast. Of letters, those of three scripts that stay one letter in lower case.
TAILS = re.compile(rf"[{re.escape(MARKS)}](?<=[A-Za-z0-9\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f\u0391-\u03a1\u03a3-\u03f5\u0400-\u0481\u048a-\u052f].)[{re.escape(MARKS)}]*(?=[ \n\t\r]|\Z)")
_codecs: dict = {}


class Codec:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {"": b""}
        self.several: set[str] = set()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.groups = all(json.dumps(x) in self.tokenizer.to_str() for x in (PATTERN, "Lowercase"))
        self.tails = self.groups and all("<|" in t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(END)]] = True

    def _each(self, chunks: list[str]) -> Iterator[bytes]:
        return (np.array(e.ids, np.int32).tobytes() for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False))

    def _joined(self, words: list[str]) -> Iterator[bytes]:
        """Ids of words that are one token group or more each, from one text: if there are as many ends of groups as words, each is one. Others, such as letters that lower case gives a mark, are noted."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.int32)
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(words):
            each = list(self._each(words))
            self.several.update(w for w, x in zip(words, each, strict=True) if self.ends[np.frombuffer(x, np.int32)].sum() != 1)
            return iter(each)
        raw, at = ids.tobytes(), (4 * np.append(0, ends)).tolist()
        return (raw[lo:hi] for lo, hi in zip(at[:-1], at[1:], strict=True))

    def _learn(self, chunks: set[str]) -> dict[str, bytes]:
        """Ids of new chunks. Letters, and the marks after them, are token groups of their own, so they are looked up apart."""
        words, odd, cut, known = [c for c in chunks if self.groups and c.isalpha()], [], [], self.known
        for c in chunks.difference(words):
            core = c.rstrip(MARKS) if self.groups else ""
            if not core.isalpha() or "<|" in c:
                odd.append(c)
            else:
                cut.append((c, core, c[len(core) :]))
        words += {x for pair in cut for x in pair[1:]}.difference(known, words)
        out: dict[str, bytes] = {}
        for lo in range(0, len(words), 4096):
            out.update(zip(words[lo : lo + 4096], self._joined(words[lo : lo + 4096]), strict=True))
        odd += [c for c, core, _ in cut if core in self.several]
        for lo in range(0, len(odd), 1024):
            out.update(zip(odd[lo : lo + 1024], self._each(odd[lo : lo + 1024]), strict=True))
        for c, core, tail in cut:
            if c not in out:
                out[c] = (out[core] if core in out else known[core]) + (out[tail] if tail in out else known[tail])
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as 32-bit integers."""
        lower = [t.lower() if self.groups and t.isascii() and "<|" not in t else t for t in texts]  # as the tokenizer does, for fewer chunks
        if self.tails:
            lower = [t if "<|" in t else TAILS.sub(r" \g<0>", t) for t in lower]
        cut = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in lower]
        if len(self.known) > CACHED:  # what is frequent was met early
            self.known = dict(itertools.islice(self.known.items(), CACHED // 2))
        new = self._learn(set().union(*cut).difference(self.known))
        long = {c: ids for c, ids in new.items() if len(c) > LONGEST_CACHED}
        for c in long:
            del new[c]
        known = self.known
        known.update(new)
        get = known.__getitem__ if not long else lambda c: known[c] if c in known else long[c]
        return [b"".join(map(get, chunks)) for chunks in cut]


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """The text in order, cut at white space after every ``size`` characters where there is some."""
    lo = 0
    while len(text) - lo > size:
        hi = min((i for i in (text.find(c, lo + size) for c in " \n\t\r") if i >= 0), default=len(text))
        yield text[lo:hi]
        lo = hi
    yield text[lo:]


_ROW = pa.schema([("doc_id", pa.int64()), ("shard", pa.int32()), ("at", pa.int64()), ("stop", pa.int64()), ("ids", pa.list_(pa.int32()))])


def encode_in_order(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """(doc_id, shard, at, stop, ids), a shard for each partition."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, shard, at, end = codec(tokenizer), TaskContext.get().partitionId(), 0, np.array([end_id], np.int32).tobytes()
        held: list[tuple[int | None, bytes]] = []

        def out() -> pa.RecordBatch:
            nonlocal at
            sizes = np.array([len(x) // 4 for _, x in held])
            edges = at + np.concatenate([[0], np.cumsum(sizes)])
            at = int(edges[-1])
            lists = pa.ListArray.from_arrays(pa.array(edges - edges[0], pa.int32()), pa.array(np.frombuffer(b"".join(x for _, x in held), np.int32)))
            ids = pa.array([i for i, _ in held], pa.int64())
            held.clear()
            return pa.RecordBatch.from_arrays([ids, pa.array(np.full(len(ids), shard, np.int32)), pa.array(edges[:-1]), pa.array(edges[1:]), lists], schema=_ROW)

        size = 0
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            lo = 0
            while lo < len(batch):  # short texts together, long ones in pieces
                hi, chars = lo, 0
                some: list[str] = []
                while hi < len(batch) and (hi == lo or chars < PIECE) and hi - lo < 512:
                    some.append(texts[hi].as_py())
                    chars += len(some[-1])
                    hi += 1
                encoded = [b"".join(c.encode([p])[0] for p in pieces(t)) for t in some] if chars > 2 * PIECE else c.encode(some)
                held += [(i, x + end) for i, x in zip(ids.slice(lo, hi - lo).to_pylist(), encoded, strict=True)]
                size += sum(map(len, encoded)) // 4
                if size >= BATCH_IDS:
                    yield out()
                    size = 0
                lo = hi
        if held:
            yield out()

    rows = id_and_text(docs)
    keyed = rows.select("doc_id", row_key(rows.text).alias("key"), F.monotonically_increasing_id().alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("key"), F.col("row")]
    return keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(encode, "doc_id long, shard int, at long, stop long, ids array<int>")


def write_tokens(docs: DataFrame, folder: str, tokenizer: str = TOKENIZER, end_id: int = END_ID, row_group: int = ROW_GROUP, page: int = PAGE, page_rows: int = PAGE_ROWS) -> None:
    """One file a shard; sizes in bytes steer row groups and pages."""
    options = {
        "compression": "zstd",
        "parquet.writer.version": "v2",
        "parquet.block.size": row_group,
        "parquet.page.size": page,
        "parquet.page.row.count.limit": page_rows,
        "parquet.enable.dictionary": "true",
    } | {f"parquet.enable.dictionary#{c}": "false" for c in ("doc_id", "at", "stop")}
    encode_in_order(docs, tokenizer, end_id).write.mode("error").options(**options).parquet(folder)


def shards(spark: SparkSession, folder: str) -> DataFrame:
    """(shard, base, n_tokens, n_docs): a row for each file, with the ids of all files before it; lists aren't read."""
    found = spark.read.parquet(folder).groupBy("shard").agg(F.max("stop").alias("n"), F.count("*").alias("docs")).orderBy("shard").collect()
    base = np.concatenate([[0], np.cumsum([r.n for r in found], dtype=np.int64)])
    return spark.createDataFrame([(r.shard, int(b), r.n, r.docs) for r, b in zip(found, base, strict=False)], "shard int, base long, n_tokens long, n_docs long")


def read_documents(spark: SparkSession, folder: str, which: Column | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of the documents that the condition on doc_id names, or of all."""
    rows = spark.read.parquet(folder)
    return (rows if which is None else rows.where(which)).join(F.broadcast(shards(spark, folder)).select("shard", "base"), "shard").select("doc_id", (F.col("base") + F.col("at")).alias("start"), (F.col("stop") - F.col("at")).alias("n_tokens"), "ids")


def read_range(spark: SparkSession, folder: str, first: int, last: int) -> DataFrame:
    """(doc_id, start, ids): the ids at places [first, last) of the whole, a row for each document that holds some; only files and pages that overlap are read."""
    met = shards(spark, folder).where((F.col("base") < last) & (F.col("base") + F.col("n_tokens") > first)).orderBy("base").collect()  # a row a file
    rows = spark.read.parquet(folder)
    if not met:
        return rows.select("doc_id", F.col("at").alias("start"), "ids").where("false")
    head, tail = met[0], met[-1]
    rows = rows.where(F.col("shard").between(head.shard, tail.shard) & ((F.col("shard") != head.shard) | (F.col("stop") > first - head.base)) & ((F.col("shard") != tail.shard) | (F.col("at") < last - tail.base)))
    rows = rows.join(F.broadcast(spark.createDataFrame([(s.shard, s.base) for s in met], "shard int, base long")), "shard")
    start = F.col("base") + F.col("at")
    skip = F.greatest(F.lit(first) - start, F.lit(0))
    take = F.least(F.col("base") + F.col("stop"), F.lit(last)) - start - skip
    return rows.select("doc_id", (start + skip).alias("start"), F.slice("ids", skip.cast("int") + 1, take.cast("int")).alias("ids"))


def digests(documents: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of what read_documents gives: the checksum of ids as 32-bit little-endian integers."""

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            values, edges = lists.values.to_numpy().astype("<i4", copy=False), lists.offsets.to_numpy()
            view = memoryview(np.ascontiguousarray(values)).cast("B")
            sums = [zlib.crc32(view[4 * lo : 4 * hi]) for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return documents.mapInArrow(crc, "doc_id long, start long, n_tokens long, ids_crc32 long")


def new_folder(spark: SparkSession) -> str:
    """A folder that doesn't exist yet, in the shared one."""
    return f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
