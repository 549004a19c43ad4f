"""WAV files as chunks of samples.

A task reads one file at a time, as Spark's binary source hands it out, and gives
out its channels in chunks, so what follows never holds a whole signal.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 65_536
#: Format tags of whole numbers, of floats, and of the extended header that names one of them.
PCM, FLOAT, EXTENDED = 1, 3, 0xFFFE
KINDS = {(PCM, 8): "u1", (PCM, 16): "<i2", (PCM, 24): "u1", (PCM, 32): "<i4", (FLOAT, 32): "<f4", (FLOAT, 64): "<f8"}


def wav_layout(data: bytes) -> tuple[int, int, int, int, int, int]:
    """(kind of samples, channels, rate, bits, where the samples begin, their bytes); ValueError for what is no such file. A data part that is cut off counts as far as it goes."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, head, body = 12, None, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"fmt " and at + 24 <= len(data) and size >= 16:
            head = (*struct.unpack_from("<HHIIHH", data, at + 8), data[at + 8 : at + 8 + size])
        elif name == b"data":
            body = (at + 8, min(size, len(data) - at - 8))
        at += 8 + size + size % 2
    if head is None or body is None:
        raise ValueError("no format or no data")
    tag, channels, rate, _, _, bits, part = head
    if tag == EXTENDED and len(part) >= 26:
        tag = struct.unpack_from("<H", part, 24)[0]
    if (tag, bits) not in KINDS or not channels or not rate:
        raise ValueError("a kind of samples that isn't read")
    return tag, channels, rate, bits, *body


def decode_wav(data: bytes, seconds: float | None = None) -> tuple[int, np.ndarray]:
    """(rate, samples x channels from -1 to 1), of the middle seconds alone if so many are wanted."""
    tag, channels, rate, bits, at, size = wav_layout(data)
    width = channels * bits // 8
    n = size // width
    wanted = n if seconds is None else min(n, int(seconds * rate + 0.5))
    at += (n - wanted) // 2 * width
    raw = np.frombuffer(data[at : at + wanted * width], KINDS[tag, bits])
    if tag == FLOAT:
        x = raw.astype(np.float64)
    elif bits == 8:
        x = (raw.astype(np.float64) - 128) / 128
    elif bits == 24:
        three = raw.reshape(-1, 3).astype(np.int32)
        x = ((three[:, 0] << 8 | three[:, 1] << 16 | three[:, 2] << 24) >> 8) / float(1 << 23)
    else:
        x = raw / float(1 << (bits - 1))
    return rate, x.reshape(-1, channels)


def decoded(files: DataFrame, chunk: int = CHUNK, seconds: float | None = None) -> DataFrame:
    """(path, rate, channel, pos, samples, error) of WAV files (path, content), or of their middle seconds alone; a file that can't be read is one row with an error and no samples."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["path", "rate", "channel", "pos", "samples", "error"]
        for batch in batches:
            for path, data in zip(batch["path"], batch["content"], strict=True):
                try:
                    rate, x = decode_wav(data, seconds)
                except ValueError as e:
                    yield pd.DataFrame([(path, None, None, None, None, str(e))], columns=columns)
                    continue
                for lo in range(0, max(1, len(x)), chunk):
                    yield pd.DataFrame([(path, float(rate), c, lo, x[lo : lo + chunk, c], None) for c in range(x.shape[1])], columns=columns)

    return files.select("path", "content").mapInPandas(decode, "path string, rate double, channel int, pos long, samples array<double>, error string")


def lengths(files: DataFrame) -> DataFrame:
    """(path, duration_sec) of WAV files (path, content), from their heads; null for what can't be read."""

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            told = []
            for path, data in zip(batch["path"], batch["content"], strict=True):
                try:
                    _, channels, rate, bits, _, size = wav_layout(data)
                    told.append((path, size // (channels * bits // 8) / rate))
                except ValueError:
                    told.append((path, None))
            yield pd.DataFrame(told, columns=["path", "duration_sec"]).astype({"duration_sec": "float64"})

    return files.select("path", "content").mapInPandas(measure, "path string, duration_sec double")


def read_wav(spark: SparkSession, folder: str, chunk: int = CHUNK) -> DataFrame:
    """The same of the WAV files below a folder."""
    return decoded(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[wW][aA][vV]").load(folder), chunk)


def downmixed(chunks: DataFrame) -> DataFrame:
    """(path, rate, pos, samples): the mean of the channels."""
    together = chunks.where("error IS NULL").groupBy("path", "rate", "pos").agg(F.collect_list("samples").alias("c"))  # a chunk of each channel
    total = F.aggregate(F.slice("c", F.lit(2), F.size("c")), F.col("c")[0], lambda a, x: F.zip_with(a, x, lambda p, q: p + q))
    return together.select("path", "rate", "pos", F.transform(total, lambda v: v / F.size("c")).alias("samples"))


def channel(chunks: DataFrame, number: int) -> DataFrame:
    """(path, rate, pos, samples) of one channel."""
    return chunks.where((F.col("channel") == number) & F.col("error").isNull()).select("path", "rate", "pos", "samples")
