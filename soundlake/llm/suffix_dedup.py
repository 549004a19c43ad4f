"""Removal of bytes in 200-byte strings that occur again: prefix-free parsing.

Triggers. Each start of a 200-byte string takes as trigger the least rolling
hash of 12 bytes among the 128 places from it on (the last one on ties); starts
with the same trigger are one phrase. A trigger depends on the string alone, so
equal strings are cut alike wherever they stand, and no trigger is more than 128
bytes away, however regular the text.

Dictionary. A phrase with the bytes that its strings reach is an entry of the
dictionary, and the distinct entries are all that is sorted: highly repetitive
text has few. Entries that occur twice make all their strings repeated without
any sorting, and so do entries that are the only ones around their core (the 73
bytes from the trigger on that every string of the phrase holds) make none.
The others' suffixes are put into corpus order: entries are sorted from the
trigger on, with the lengths of common prefixes of neighbours, and the suffixes
that start d bytes before it follow by a stable sort of those of d - 1 by one more
byte. Neighbours in that order that share 200 bytes are repeated strings.

Parse. The parse is each document's list of entries. An entry reaches as far as
200 bytes from its last start, so the order of the parse's suffixes would only
tell strings apart beyond 200 bytes; what is combined here is, for each place of
the parse, the answers for its entry.

How it spreads. Cores and entries are counted in buckets of their own hashes, and
the dictionary is sorted in buckets of cores. Around a core that has more than
``MOST_SORTED`` different entries (a passage of 73 to 199 bytes in very many
surroundings), strings are compared by 128-bit hash instead, each in the bucket of
its own, so no bucket grows with such a core.

Nulls: a null text is empty. Rows are judged on their own, doc_id only names
them, so repeated rows repeat each other's strings. Empty tables give an empty
result; other columns are not read. Texts of any length are read whole.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import packs as P
from .blocks import Block, Spans, cover, id_column
from .shared import checkpointed

LENGTH, REACH, GRAM = 200, 128, 12
CORE = LENGTH - REACH + 1
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans binary"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.binary())])
#: What an entry's bucket says: once; again in other packs; again, and this pack's stands for it in the dictionary.
ONCE, AGAIN, SHOWN = range(3)
#: Of a core: one entry; several; more than are sorted.
SINGLE, VARIED, CROWDED = range(3)
MOST_SORTED = 4_096
CORES, ENTRIES, SORTED, STRINGS = range(4)
#: An entry in the dictionary: the bytes around the trigger, and the least and greatest distance of a start from it.
WIDTH = REACH - 1 + LENGTH


def triggers(block: Block, hashes: Spans) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first start, last start, trigger) of each phrase."""
    size = len(block.data)
    if size < LENGTH:
        return (np.empty(0, np.int64),) * 3
    low = np.uint64(0xFFFFFFFF)
    h = hashes.rolling(GRAM)
    least = (h & ~low) | (low - np.arange(len(h), dtype=np.uint64))
    step = 1
    while step < REACH:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    least = least[: size - LENGTH + 1]
    whole = np.zeros(size - LENGTH + 1, bool)
    for i, j in zip(block.offsets[:-1], block.offsets[1:], strict=True):
        if j - i >= LENGTH:
            whole[i : j - LENGTH + 1] = True
    starts = np.flatnonzero(whole)
    trigger = (low - (least[starts] & low)).astype(np.int64)
    at, _ = P.groups(trigger) if len(starts) else (np.empty(0, np.int64), None)
    return starts[at], starts[np.append(at[1:], len(starts)) - 1] if len(at) else starts, trigger[at]


class Parse:
    """The phrases of a pack and their distinct entries."""

    def __init__(self, block: Block):
        self.data = block.data
        self.lanes = Spans(block.data, 0), Spans(block.data, 1)
        self.p0, self.p1, self.t = triggers(block, self.lanes[0])
        core, entry = self.lanes[0](self.t, self.t + CORE), self.lanes[1](self.p0, self.p1 + LENGTH)
        self.keys, counts, self.of = P.distinct(core, entry)
        self.again = counts > 1
        self.first = np.zeros(len(self.keys[0]), np.int64)
        self.first[self.of[::-1]] = np.arange(len(self.of))[::-1]  # the phrase that an entry is read from
        self.by_entry = np.argsort(self.keys[1], kind="stable")

    def counted(self) -> dict:
        core, entry, _ = self.keys
        at, _ = P.groups(core)
        n = np.diff(np.append(at, len(core)))
        order = self.by_entry
        return {CORES: (core[at], entry[at], n), ENTRIES: (entry[order], core[order], self.again[order].astype(np.int64))}

    def states(self, said: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each entry: whether it occurs again; whether it goes to the dictionary; whether its core is crowded."""
        none = np.empty(0, np.uint8)
        core = said.get(CORES, none)[P.groups(self.keys[0])[1]]
        entry = np.empty(len(self.keys[0]), np.uint8)
        entry[self.by_entry] = said.get(ENTRIES, none)
        asks = (core != SINGLE) & (entry != AGAIN)
        return entry != ONCE, asks & (core == VARIED), asks & (core == CROWDED)

    def dictionary(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, least distance, greatest distance) of the chosen entries; bytes that they don't reach are 0."""
        phrase = self.first[chosen]
        lo, hi, t = self.p0[phrase], self.p1[phrase] + LENGTH, self.t[phrase]
        at = (t - REACH + 1)[:, None] + np.arange(WIDTH)
        inside = (at >= lo[:, None]) & (at < hi[:, None])
        return np.where(inside, self.data[np.where(inside, at, 0)], 0).astype(np.uint8), t - self.p1[phrase], t - lo

    def strings(self, chosen: np.ndarray) -> tuple[np.ndarray, P.Keys, np.ndarray, np.ndarray]:
        """Of the chosen entries: (starts, distinct keys, how often each occurs, each start's key)."""
        phrase = self.first[chosen]
        width = self.p1[phrase] - self.p0[phrase] + 1
        starts = np.repeat(self.p0[phrase] - np.cumsum(width) + width, width) + np.arange(width.sum())
        return starts, *P.distinct(*(x(starts, starts + LENGTH) for x in self.lanes))


def _count(block: Block, said: dict) -> dict:
    return Parse(block).counted()


def _of_cores(core: np.ndarray, entry: np.ndarray, n: np.ndarray, pack: np.ndarray, most: int = MOST_SORTED) -> np.ndarray:
    """SINGLE, VARIED or CROWDED (more than most entries); entry: a pack's first around the core; n: how many it has."""
    order = np.lexsort((entry, core))
    at, of = P.groups(core[order])
    if not len(at):
        return np.empty(0, np.uint8)
    ends = np.append(at, len(core))[1:] - 1
    varied = (entry[order][at] != entry[order][ends]) | (np.maximum.reduceat(n[order], at) > 1)
    said = np.empty(len(core), np.uint8)
    said[order] = np.where(varied, np.where(np.add.reduceat(n[order], at) > most, CROWDED, VARIED), SINGLE)[of]
    return said


def _of_entries(entry: np.ndarray, core: np.ndarray, twice: np.ndarray, pack: np.ndarray) -> np.ndarray:
    """ONCE, AGAIN or SHOWN; twice: whether the entry occurs twice in the pack."""
    order = np.lexsort((pack, core, entry))
    at, of = P.groups(entry[order], core[order])
    if not len(at):
        return np.empty(0, np.uint8)
    again = (np.diff(np.append(at, len(entry))) > 1) | (np.maximum.reduceat(twice[order], at) > 0)
    leads = np.zeros(len(entry), bool)
    leads[at] = True
    said = np.empty(len(entry), np.uint8)
    said[order] = np.where(again[of], np.where(leads, SHOWN, AGAIN), ONCE)
    return said


def corpus_order(body: np.ndarray, nearest: np.ndarray, farthest: np.ndarray):
    """Suffix arrays of dictionary entries, aligned at their triggers.

    Yields, for each distance d from the trigger, (d, entries in the order of what
    starts there, whether each shares 200 bytes with the one before it); only
    entries with a start at d take part.
    """
    n, centre = len(body), REACH - 1
    right = np.ascontiguousarray(body[:, centre:])
    order = np.argsort(right.view(f"S{LENGTH}").ravel(), kind="stable")  # compared over their whole width
    differ = right[order[1:]] != right[order[:-1]]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), LENGTH)  # with the one before
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    left = np.zeros(n, np.int64)  # entries with equal bytes from d to the trigger share a number
    for d in range(int(farthest.max()) + 1 if n else 0):
        if d:
            byte = body[:, centre - d]
            order = order[np.argsort(byte[order], kind="stable")]
            b, x = byte[order], left[order]
            left[order] = np.cumsum(np.append(0, (b[1:] != b[:-1]) | (x[1:] != x[:-1])))
        run = np.cumsum(np.append(0, common < LENGTH - d))  # of entries that agree in the bytes after the trigger
        here = order[(nearest[order] <= d) & (d <= farthest[order])]
        same = np.zeros(len(here), bool)
        a, b = here[:-1], here[1:]
        same[1:] = (left[a] == left[b]) & (run[rank[a]] == run[rank[b]])
        yield d, here, same


def _of_dictionary(core: np.ndarray, body: np.ndarray, nearest: np.ndarray, farthest: np.ndarray, pack: np.ndarray) -> np.ndarray:
    """A bit for each distance: whether another entry has the string that starts there."""
    told = np.zeros((len(core), REACH), bool)
    for d, here, same in corpus_order(body, nearest, farthest):
        told[here[same], d] = True
        told[here[:-1][same[1:]], d] = True
    return np.packbits(told, axis=1)


def _ask_strings(block: Block, said: dict) -> dict:
    parse = Parse(block)
    _, sorts, hashes = parse.states(said)
    chosen = np.flatnonzero(sorts)
    (k0, k1, _), counts, _ = parse.strings(np.flatnonzero(hashes))[1:]
    return {SORTED: (parse.keys[0][chosen], *parse.dictionary(chosen)), STRINGS: (k0, k1, np.zeros(len(k0), np.int64))}


def _last(block: Block, said: dict) -> pa.RecordBatch:
    parse = Parse(block)
    size = len(block.data)
    again = np.zeros(size + 1, np.int64)
    repeated, sorts, hashes = parse.states(said)
    whole = np.flatnonzero(repeated[parse.of])
    np.add.at(again, parse.p0[whole], 1)
    np.add.at(again, parse.p1[whole] + 1, -1)
    again = np.cumsum(again[:size]) > 0
    chosen = np.flatnonzero(sorts)
    if len(chosen):
        phrase = parse.first[chosen]
        told = np.unpackbits(said[SORTED].reshape(len(chosen), REACH // 8), axis=1).astype(bool)
        entry, d = np.nonzero(told)
        again[parse.t[phrase[entry]] - d] = True
    starts, _, counts, of = parse.strings(np.flatnonzero(hashes))
    if len(starts):
        again[starts[(said[STRINGS].astype(bool) | (counts > 1))[of]]] = True
    removed = cover(np.flatnonzero(again), LENGTH, size)
    sums = np.concatenate([[0], np.cumsum(removed)])
    lost = sums[block.offsets[1:]] - sums[block.offsets[:-1]]
    n_spans, digests, spans = [], [], []
    for i, (lo, hi) in enumerate(zip(block.offsets[:-1], block.offsets[1:], strict=True)):
        if not lost[i]:
            n_spans.append(0)
            digests.append(hashlib.sha256(block.text(i)).hexdigest())
            spans.append(b"")
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[False], removed[lo:hi], [False]]).astype(np.int8)))
        n_spans.append(len(edge) // 2)
        digests.append(hashlib.sha256(block.data[lo:hi][~removed[lo:hi]].tobytes()).hexdigest())
        spans.append(edge.astype("<i8").tobytes())
    return pa.RecordBatch.from_arrays([id_column(block.ids), pa.array(np.diff(block.offsets)), pa.array(lost), pa.array(n_spans, pa.int64()), pa.array(digests, pa.string()), pa.array(spans, pa.binary())], schema=_ARROW)


def suffix_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", most_sorted: int = MOST_SORTED) -> DataFrame:
    """Per document: bytes, bytes removed, removed runs, the digest of what stays, and the runs as pairs of 64-bit places."""
    rows = P.packs(docs, doc_id, text)
    n = P.bucket_count(rows)
    entries = checkpointed(P.ask(rows, _count, {CORES: (P.KEYS, partial(_of_cores, most=most_sorted)), ENTRIES: (P.KEYS, _of_entries)}, n))
    kinds = (("u8", ()), ("u1", (WIDTH,)), ("i8", ()), ("i8", ()))
    strings = P.ask(rows, _ask_strings, {SORTED: (kinds, _of_dictionary), STRINGS: (P.KEYS, P.by_key(P.said_elsewhere))}, n, entries)
    return P.finish(rows, entries.unionByName(strings), _last, SCHEMA)
