"""Removal of word windows that an earlier document has: difference-cover anchors.

A window is ``WINDOW`` consecutive words. Only places whose number in the text
is in the difference cover {0, 1, 3} modulo 7 get an anchor, the hash of the
seven words that start there. For any two places p and q some step below 7
brings both to cover positions, so two equal windows share an anchor that lies
inside both. Documents first learn which of their anchors other documents hold;
only windows with such an anchor are extended to their full width and compared
as 128-bit hashes, with the least doc_id of each.

Nulls: a null text has no words; a null doc_id counts as larger than all others,
so it loses words and never takes any. Rows that repeat a doc_id don't take from
each other. Empty tables give an empty result; other columns are not read. Texts
of any length are read whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import packs as P
from .blocks import NULL_ID, SPACE, Block, Spans, Words, cover, grams, id_column, words
from .shared import checkpointed

WINDOW = 13
PERIOD, COVER = 7, (0, 1, 3)
ANCHOR = WINDOW - PERIOD + 1
SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string, keep binary"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("keep", pa.binary())])


def _cut(block: Block) -> tuple[Words, np.ndarray, np.ndarray]:
    w = words(block, ~SPACE)
    return w, Spans(block.data, 0)(w.starts, w.ends), Spans(block.data, 1)(w.starts, w.ends)


def _whole(w: Words, n: int) -> np.ndarray:
    """Words at which n words of one text start."""
    return np.flatnonzero(w.row[: len(w) - n + 1] == w.row[n - 1 :]) if len(w) >= n else np.empty(0, np.int64)


def _anchors(block: Block, w: Words, h: np.ndarray) -> tuple[np.ndarray, P.Keys, np.ndarray, np.ndarray]:
    """(places of anchors, their distinct keys, whether two documents of the pack hold a key, each anchor's key)."""
    at = _whole(w, ANCHOR)
    at = at[np.isin(w.place()[at] % PERIOD, COVER)]
    keys = grams(h, ANCHOR)[at] if len(at) else np.empty(0, np.uint64)
    ids = block.ids[w.row[at]]
    uniq, _, of = P.distinct(keys, np.zeros(len(keys), np.uint64), ids)
    several = np.zeros(len(uniq[0]), bool)
    several[of[ids != uniq[2][of]]] = True
    return at, uniq, several, of


def _first(block: Block, said: dict) -> dict:
    w, h, _ = _cut(block)
    k0, k1, _ = _anchors(block, w, h)[1]
    return {0: (k0, k1, np.zeros(len(k0), np.int64))}


def _windows(block: Block, said: dict) -> tuple[Words, np.ndarray, P.Keys, np.ndarray]:
    """Windows that hold a shared anchor, with their distinct keys and least ids."""
    w, h0, h1 = _cut(block)
    at, _, several, of = _anchors(block, w, h0)
    shared = at[(said[0].astype(bool) | several)[of]] if len(at) else at
    starts = _whole(w, WINDOW)
    if len(starts):
        seen = np.concatenate([[0], np.cumsum(np.bincount(shared, minlength=len(w)))])
        starts = starts[seen[starts + PERIOD] > seen[starts]]
    k = [grams(h, WINDOW)[starts] if len(starts) else np.empty(0, np.uint64) for h in (h0, h1)]
    uniq, _, of = P.distinct(*k, block.ids[w.row[starts]])
    return w, starts, uniq, of


def _second(block: Block, said: dict) -> dict:
    return {1: _windows(block, {0: said.get(0, np.empty(0, np.uint8))})[2]}


def _last(block: Block, said: dict) -> pa.RecordBatch:
    w, starts, uniq, of = _windows(block, {0: said.get(0, np.empty(0, np.uint8))})
    earlier = said.get(1, np.empty(0, np.uint8)).astype(bool)
    gone = starts[earlier[of] | (block.ids[w.row[starts]] > uniq[2][of])] if len(starts) else starts
    removed = cover(gone, WINDOW, len(w))
    lost = np.concatenate([[0], np.cumsum(removed)])[w.first]
    sums, keeps = [], []
    for i in range(len(block)):
        lo, hi = w.first[i], w.first[i + 1]
        keep = ~removed[lo:hi]
        got = [block.data[w.starts[j] : w.ends[j]].tobytes() for j in np.flatnonzero(keep) + lo] if lost[i + 1] > lost[i] else block.text(i).split()
        sums.append(hashlib.sha256(b" ".join(got)).hexdigest())
        keeps.append(np.packbits(keep).tobytes())
    return pa.RecordBatch.from_arrays([id_column(block.ids), pa.array(np.diff(w.first)), pa.array(np.diff(lost)), pa.array(sums, pa.string()), pa.array(keeps, pa.binary())], schema=_ARROW)


def substring_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: how many words it has, how many go, the digest of those that stay, and a bitmap of them."""
    rows = P.packs(docs, doc_id, text)
    n = P.bucket_count(rows)
    anchors = checkpointed(P.ask(rows, _first, {0: (P.KEYS, P.by_key(P.said_elsewhere))}, n))
    windows = P.ask(rows, _second, {1: (P.KEYS, P.by_key(P.said_smaller))}, n, anchors)
    return P.finish(rows, anchors.unionByName(windows), _last, SCHEMA)
