"""Images in binary columns: PNG files written and read with zlib and numpy, and perceptual hashes.

A file is the signature and chunks of (length, name, body, CRC-32); the reader
tests every checksum, joins and inflates the image data and undoes the filters
row by row, in runs of rows with one filter. Features are signs of the 8 x 8
lowest frequencies of the cosine transform of a 32 x 32 reduction, against their
median. 8-bit grey images are written; 8-bit grey, grey-alpha, RGB and RGBA are
read, without interlacing.

``store_texts`` puts the UTF-8 bytes of texts, with bytes 0 appended up to a
positive multiple of 64, into rows of 64 grey samples. A null text is empty; a
null doc_id is kept; equal texts, repeated rows too, give equal files. Texts of
any length are stored whole, about 2 MB of them at a time. A damaged file raises
ValueError in ``decode_png`` and gives nulls in ``describe``. Empty tables give
empty results; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .blocks import blocks, id_column
from .shared import id_and_text

SIGNATURE = b"\x89PNG\r\n\x1a\n"
ROW = 64
#: Samples of a pixel by colour type: grey, RGB, grey with alpha, RGBA.
SAMPLES = {0: 1, 2: 3, 4: 2, 6: 4}


def _chunk(name: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))


def encode_png(image: np.ndarray, level: int = 1) -> bytes:
    """An 8-bit grey image (rows x columns) as a file; the filter, none, left or above, is the one of least absolute differences."""
    left, above = image.copy(), image.copy()
    left[:, 1:] -= image[:, :-1]
    above[1:] -= image[:-1]
    kinds = (image, left, above)
    kind = int(np.argmin([np.abs(x.view(np.int8).astype(np.int16)).sum() for x in kinds]))
    lines = np.empty((image.shape[0], image.shape[1] + 1), np.uint8)
    lines[:, 0], lines[:, 1:] = kind, kinds[kind]
    header = struct.pack(">IIBBBBB", image.shape[1], image.shape[0], 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def _undo_neighbours(kind: int, rows: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """Undoes filters that look left and up in rows of one kind: pixels whose left and upper neighbours are known go together, so all on one diagonal."""
    height, width = len(rows), rows.shape[1] // step
    out = np.zeros((height + 1, width + 1, step), np.int16)  # a row above and a column before
    out[0, 1:] = above.reshape(width, step)
    pixels = rows.reshape(height, width, step)
    for s in range(height + width - 1):
        y = np.arange(max(0, s - width + 1), min(height, s + 1))
        x = s - y
        a, b, c = out[y + 1, x], out[y, x + 1], out[y, x]
        if kind == 3:
            guess = (a + b) >> 1
        else:
            p, q, r = np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)
            guess = np.where((p <= q) & (p <= r), a, np.where(q <= r, b, c))
        out[y + 1, x + 1] = (pixels[y, x] + guess) & 255
    return out[1:, 1:].astype(np.uint8).reshape(height, -1)


def _unfilter(kinds: np.ndarray, lines: np.ndarray, step: int) -> np.ndarray:
    """Undoes the row filters 0 to 4; step: bytes of a pixel."""
    height, width = lines.shape
    out = np.zeros((height + 1, width), np.uint8)  # the row above the first is 0
    edges = np.flatnonzero(np.diff(kinds)) + 1
    for lo, hi in zip([0, *edges], [*edges, height], strict=True):
        kind, rows = kinds[lo], lines[lo:hi]
        if kind == 0:
            out[lo + 1 : hi + 1] = rows
        elif kind == 1:
            out[lo + 1 : hi + 1] = np.cumsum(rows.reshape(hi - lo, -1, step), axis=1, dtype=np.uint8).reshape(hi - lo, width)
        elif kind == 2:
            out[lo + 1 : hi + 1] = np.cumsum(np.vstack([out[lo : lo + 1], rows]), axis=0, dtype=np.uint8)[1:]
        elif kind in (3, 4):
            out[lo + 1 : hi + 1] = _undo_neighbours(kind, rows, out[lo], step)
        else:
            raise ValueError("unknown filter")
    return out[1:]


def decode_png(data: bytes) -> np.ndarray:
    """The samples, rows x columns (x samples of a pixel if several)."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG file")
    at, header, body, ended = 8, None, [], False
    while at < len(data) and not ended:
        if at + 12 > len(data):
            raise ValueError("cut off")
        (size,), name = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        if at + 12 + size > len(data) or zlib.crc32(data[at + 4 : at + 8 + size]) != struct.unpack_from(">I", data, at + 8 + size)[0]:
            raise ValueError("wrong checksum")
        part = data[at + 8 : at + 8 + size]
        if name == b"IHDR":
            header = struct.unpack(">IIBBBBB", part)
        elif name == b"IDAT":
            body.append(part)
        ended = name == b"IEND"
        at += 12 + size
    if header is None or not ended or header[2] != 8 or header[3] not in SAMPLES or any(header[4:]):
        raise ValueError("incomplete, or of a kind that isn't read")
    width, height, step = header[0], header[1], SAMPLES[header[3]]
    try:
        lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8)
    except zlib.error as e:
        raise ValueError("image data don't inflate") from e
    if len(lines) != height * (width * step + 1):
        raise ValueError("wrong size")
    lines = lines.reshape(height, -1)
    out = _unfilter(lines[:, 0], lines[:, 1:], step)
    return out if step == 1 else out.reshape(height, width, step)


def _cosines(n: int = 32, low: int = 8) -> np.ndarray:
    return np.cos(np.pi / n * (np.arange(n)[None, :] + 0.5) * np.arange(low)[:, None])


_COSINES = _cosines()


def _reduced(image: np.ndarray, n: int = 32) -> np.ndarray:
    """n x n means of (nearly) even cells."""
    for _ in range(2):  # rows, then columns
        size = image.shape[0]
        lo = np.arange(n) * size // n
        hi = np.maximum(lo + 1, (np.arange(1, n + 1) * size + n - 1) // n)
        sums = np.vstack([np.zeros((1, image.shape[1])), np.cumsum(image, axis=0, dtype=np.float64)])
        image = ((sums[hi] - sums[lo]) / (hi - lo)[:, None]).T
    return image


def cosine_hash(image: np.ndarray) -> str:
    """64 bits in hex."""
    grey = image if image.ndim == 2 else image[..., : max(1, image.shape[2] - (image.shape[2] % 2 == 0))].mean(axis=2)
    low = np.round(_COSINES @ _reduced(grey) @ _COSINES.T, 6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes().hex()


def store_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text as an image file."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch):
                files = []
                for i in range(len(b)):
                    raw = b.data[b.offsets[i] : b.offsets[i + 1]]
                    image = np.zeros((max(1, -(-len(raw) // ROW)), ROW), np.uint8)
                    image.ravel()[: len(raw)] = raw
                    files.append(encode_png(image))
                yield pa.RecordBatch.from_arrays([id_column(b.ids), pa.array(np.diff(b.offsets)), pa.array(files, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return id_and_text(docs, doc_id, text).mapInArrow(write, "doc_id long, n_bytes long, media binary")


def describe(stored: DataFrame) -> DataFrame:
    """Reads the files of (doc_id, n_bytes, media) back: sizes, digests and features."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for media in batch.column("media").to_pylist():
                try:
                    image = decode_png(media) if media is not None else None
                except ValueError:
                    image = None
                if image is None:
                    rows.append((None, None, None, None if media is None else len(media), None if media is None else hashlib.sha256(media).hexdigest(), None))
                else:
                    payload = image.tobytes()
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), cosine_hash(image)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *columns], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return stored.mapInArrow(read, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
