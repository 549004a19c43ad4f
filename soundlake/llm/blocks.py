"""Text columns as byte arrays inside Arrow tasks.

A block is a run of rows whose texts lie end to end in one ``uint8`` array, so
that cutting into words and hashing are a few numpy passes instead of a Python
call per word. Null texts count as empty. A block holds about ``limit`` bytes,
or one text if that is longer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that a task works on at a time.
BLOCK_BYTES = 2 << 20
#: Stands for a null doc_id where ids are compared: after every other id.
NULL_ID = np.iinfo(np.int64).max

_U = np.uint64
_TABLES = np.random.Generator(np.random.PCG64(20240607)).integers(1, 2**64 - 1, (2, 256), dtype=np.uint64)
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_PRIME, _PRIME_BASES = _U(2**31 - 1), (1_540_483_477, 1_103_527_591)
_powers: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}


@dataclass
class Block:
    ids: np.ndarray  # int64, NULL_ID where null
    data: np.ndarray  # uint8, the texts end to end
    offsets: np.ndarray  # int64, one more than rows
    lo: int = 0  # rows of the batch that it was cut from
    hi: int = 0

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def text(self, row: int) -> bytes:
        return self.data[self.offsets[row] : self.offsets[row + 1]].tobytes()


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, int64 offsets) of a string or binary column."""
    column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_large_binary(column.type) else "")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def id_values(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(NULL_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def id_column(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == NULL_ID)


def blocks_of(ids: np.ndarray, data: np.ndarray, offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield Block(ids[lo:hi], data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], lo, hi)
        lo = hi


def blocks(batch: pa.RecordBatch, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Blocks of a batch whose first two columns are an id and a text."""
    return blocks_of(id_values(batch.column(0)), *text_buffers(batch.column(1)), limit)


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit values."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(29)
    x *= _U(0x9E6C63D0676A9A99)
    x ^= x >> _U(32)
    return x


def _remainder(x: np.ndarray) -> np.ndarray:
    """Modulo 2**31 - 1."""
    x = (x & _PRIME) + (x >> _U(31))
    x = (x & _PRIME) + (x >> _U(31))
    return np.where(x >= _PRIME, x - _PRIME, x)


def _prime_powers(base: int, size: int) -> np.ndarray:
    out, n = np.ones(size, np.uint32), 1
    while n < size:
        out[n : 2 * n] = _remainder(out[: min(n, size - n)] * _U(pow(base, n, int(_PRIME))))
        n *= 2
    return out


def _power(n: int, lane: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Powers of the lane's bases and of their inverses, modulo 2**64 and modulo the prime; n + 1 of each at least."""
    if lane not in _powers or len(_powers[lane][0]) <= n:
        size = n + 1 if n > BLOCK_BYTES else (1 << max(n - 1, 0).bit_length()) + 2  # as long as the longest block so far asks for, doubled as they grow
        out = []
        for base in (_BASES[lane], pow(_BASES[lane], -1, 2**64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        base = _PRIME_BASES[lane]
        _powers[lane] = (*out, _prime_powers(base, size), _prime_powers(pow(base, -1, int(_PRIME)), size))
    return _powers[lane]


class Spans:
    """Hashes of any spans of a byte array, 64 bits a lane, from running sums.

    Each joins two polynomials, modulo 2**64 and modulo the prime 2**31 - 1: the
    first alone is the same for certain regular texts of 1,024 bytes and more,
    whatever its base.
    """

    def __init__(self, data: np.ndarray, lane: int = 0):
        power, self.inverse, prime, self.prime_inverse = _power(len(data), lane)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_TABLES[lane][data] * power[: len(data)], out=self.sums[1:])
        terms = prime[: len(data)] * (data.astype(np.uint64) + _U(1))
        self.prime_sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_remainder(terms) if len(data) > 1 << 24 else terms, out=self.prime_sums[1:])  # below 2**63

    def _joined(self, wide: np.ndarray, narrow: np.ndarray, lo) -> np.ndarray:
        rest = _remainder(_remainder(narrow) * self.prime_inverse[lo])
        return mix(wide * self.inverse[lo] ^ rest * _U(0x9E3779B97F4A7C15))

    def __call__(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return self._joined(self.sums[hi] - self.sums[lo], self.prime_sums[hi] - self.prime_sums[lo], lo)

    def rolling(self, width: int) -> np.ndarray:
        """A hash of the few bytes at every start, by the first polynomial alone."""
        n = max(0, len(self.sums) - width)
        return mix((self.sums[width:] - self.sums[:n]) * self.inverse[:n]) if n else np.empty(0, np.uint64)


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, bool)
    for lo, hi in ranges:
        table[lo : hi + 1] = True
    return table


#: ASCII white space, and the map of A-Z to a-z.
SPACE = byte_set((0x20, 0x20), (0x09, 0x0D))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


@dataclass
class Words:
    starts: np.ndarray  # bytes of the block
    ends: np.ndarray
    row: np.ndarray  # of the block
    first: np.ndarray  # each row's first word; one more than rows

    def __len__(self) -> int:
        return len(self.starts)

    def place(self) -> np.ndarray:
        """Each word's place in its text."""
        return np.arange(len(self)) - self.first[self.row]


def words(block: Block, inside: np.ndarray) -> Words:
    """Maximal runs of the bytes marked in ``inside``; runs end where a text ends."""
    is_word = inside[block.data]
    before = np.zeros(len(is_word), bool)
    before[1:] = is_word[:-1]
    heads = block.offsets[:-1]
    before[heads[heads < len(is_word)]] = False
    after = np.zeros(len(is_word), bool)
    after[:-1] = is_word[1:]
    tails = block.offsets[1:] - 1
    after[tails[tails >= 0]] = False  # the tail of an empty text is that of the text before it
    starts, ends = np.flatnonzero(is_word & ~before), np.flatnonzero(is_word & ~after) + 1
    return Words(starts, ends, np.searchsorted(block.offsets, starts, "right") - 1, np.searchsorted(starts, block.offsets))


def ascending(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values, sorted, and how often each occurs."""
    values = np.sort(values)
    at = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.empty(0, np.int64)
    return values[at], np.diff(np.append(at, len(values)))


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n consecutive values."""
    size = len(hashes) - n + 1
    if size <= 0:
        return np.empty(0, np.uint64)
    out = hashes[n - 1 : n - 1 + size].copy()
    for j in range(n - 2, -1, -1):
        out *= _U(0xA0761D6478BD642F)
        out += hashes[j : j + size]
    return mix(out)


def cover(starts: np.ndarray, width: int, size: int) -> np.ndarray:
    """Which of ``size`` places lie in [start, start + width) for some start."""
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return np.cumsum(edge[:size]) > 0
