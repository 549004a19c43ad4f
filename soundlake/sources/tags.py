"""What files say about themselves: tags of MP3, FLAC, Ogg, MP4 and WAV files.

A task reads one file at a time, as Spark's binary source hands it out, and a small
parser for each container turns its head into names and numbers. Nothing raises: what
can't be read is null, and the column ``tag_error`` tells why. Files above MAX_BYTES
are not opened; they come as rows without tags.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files

#: A row holds a file, and Spark's rows have 2 GB at most.
MAX_BYTES = 1 << 30
#: Names of the fields in each container.
ID3 = {"TIT2": "title", "TT2": "title", "TPE1": "artist", "TP1": "artist", "TPE2": "album_artist", "TP2": "album_artist", "TALB": "album", "TAL": "album", "TYER": "year", "TYE": "year", "TDRC": "year", "TRCK": "track_no", "TRK": "track_no", "TCON": "genre", "TCO": "genre", "APIC": "cover", "PIC": "cover"}
COMMENTS = {"TITLE": "title", "ARTIST": "artist", "ALBUMARTIST": "album_artist", "ALBUM": "album", "DATE": "year", "YEAR": "year", "TRACKNUMBER": "track_no", "GENRE": "genre", "METADATA_BLOCK_PICTURE": "cover"}
ATOMS = {b"\xa9nam": "title", b"\xa9ART": "artist", b"aART": "album_artist", b"\xa9alb": "album", b"\xa9day": "year", b"trkn": "track_no", b"\xa9gen": "genre", b"covr": "cover"}
INFO = {b"INAM": "title", b"IART": "artist", b"IPRD": "album", b"ICRD": "year", b"ITRK": "track_no", b"IGNR": "genre"}
ENCODINGS = ("latin-1", "utf-16", "utf-16-be", "utf-8")
#: Names that genres have by number in the oldest tags.
GENRES = (
    "Blues", "Classic Rock", "Country", "Dance", "Disco", "Funk", "Grunge", "Hip-Hop", "Jazz", "Metal", "New Age", "Oldies", "Other", "Pop", "R&B", "Rap", "Reggae", "Rock", "Techno", "Industrial",
    "Alternative", "Ska", "Death Metal", "Pranks", "Soundtrack", "Euro-Techno", "Ambient", "Trip-Hop", "Vocal", "Jazz+Funk", "Fusion", "Trance", "Classical", "Instrumental", "Acid", "House", "Game", "Sound Clip", "Gospel", "Noise",
)
TEXTS, NUMBERS = ("title", "artist", "album_artist", "album", "genre"), ("year", "track_no")
Found = dict[str, str]


def _plain_sync(data: bytes) -> bytes:
    return data.replace(b"\xff\x00", b"\xff")


def _seven(raw: bytes) -> int:
    """A number of seven bits a byte."""
    n = 0
    for b in raw:
        n = n << 7 | b & 127
    return n


def _text(body: bytes) -> str:
    return body[1:].decode(ENCODINGS[body[0]] if body and body[0] < 4 else "latin-1", "replace").split("\0")[0]


def id3_frames(data: bytes) -> Iterator[tuple[str, bytes]]:
    """(name, body) of a tag at the beginning of data; a frame that is cut off ends it."""
    version, flags, size = data[3], data[5], _seven(data[6:10])
    body = data[10 : 10 + size]
    if flags & 0x80 and version < 4:
        body = _plain_sync(body)
    at = 0
    if flags & 0x40 and version > 2:  # a further header, which counts itself from the fourth version on
        at = _seven(body[:4]) if version > 3 else 4 + int.from_bytes(body[:4], "big")
    wide = 3 if version == 2 else 4
    while at + wide * 2 <= len(body) and body[at : at + 1] != b"\0":
        name = body[at : at + wide].decode("latin-1")
        raw = body[at + wide : at + 2 * wide]
        n = _seven(raw) if version > 3 else int.from_bytes(raw, "big")
        at += 2 * wide
        mark = 0
        if wide == 4:
            mark = body[at + 1] if at + 1 < len(body) else 0
            at += 2
        part = body[at : at + n]
        if len(part) < n:
            return
        at += n
        if version > 3:
            part = part[4:] if mark & 1 else part
            part = _plain_sync(part) if mark & 2 or flags & 0x80 else part
        yield name, part


def _id3(data: bytes) -> Found:
    found: Found = {}
    for name, body in id3_frames(data):
        if name in ID3:
            found.setdefault(ID3[name], "yes" if ID3[name] == "cover" else _text(body))
    return found


def _oldest(data: bytes) -> Found:
    """The tag of fixed places in the last 128 bytes."""
    tail = data[-128:]
    cut = lambda lo, hi: tail[lo:hi].split(b"\0")[0].decode("latin-1")
    found = {"title": cut(3, 33), "artist": cut(33, 63), "album": cut(63, 93), "year": cut(93, 97), "genre": str(tail[127])}
    return found | ({"track_no": str(tail[126])} if tail[125] == 0 and tail[126] else {})


def _comments(data: bytes) -> Found:
    """Pairs NAME=value behind the name of a program, each with its length before it."""
    found: Found = {}
    at = 4 + struct.unpack_from("<I", data)[0]
    count = struct.unpack_from("<I", data, at)[0]
    at += 4
    for _ in range(count):
        n = struct.unpack_from("<I", data, at)[0]
        name, _, value = data[at + 4 : at + 4 + n].decode("utf-8", "replace").partition("=")
        at += 4 + n
        if name.upper() in COMMENTS:
            found.setdefault(COMMENTS[name.upper()], value)
    return found


def _flac(data: bytes) -> Found:
    found: Found = {}
    at, last = 4, False
    while not last and at + 4 <= len(data):
        last, kind, n = bool(data[at] & 128), data[at] & 127, int.from_bytes(data[at + 1 : at + 4], "big")
        if kind == 4:
            found = _comments(data[at + 4 : at + 4 + n]) | found
        elif kind == 6:
            found["cover"] = "yes"
        at += 4 + n
    return found


def _ogg(data: bytes) -> Found:
    """The second packet; pages hold pieces of up to 255 bytes, and a shorter one ends a packet."""
    packets, now, at = [], [], 0
    while len(packets) < 2 and data[at : at + 4] == b"OggS":
        sizes = data[at + 27 : at + 27 + data[at + 26]]
        at += 27 + len(sizes)
        for n in sizes:
            now.append(data[at : at + n])
            at += n
            if n < 255:
                packets.append(b"".join(now))
                now = []
    second = packets[1]
    for head in (b"\x03vorbis", b"OpusTags"):
        if second.startswith(head):
            return _comments(second[len(head) :])
    return {}


def _atoms(data: bytes, lo: int, hi: int) -> Iterator[tuple[bytes, int, int]]:
    while lo + 8 <= hi:
        n, head = int.from_bytes(data[lo : lo + 4], "big"), 8
        if n == 1:
            n, head = int.from_bytes(data[lo + 8 : lo + 16], "big"), 16
        end = hi if n == 0 else min(hi, lo + n)
        if end < lo + head:
            return
        yield data[lo + 4 : lo + 8], lo + head, end
        lo = end


def _mp4(data: bytes) -> Found:
    def inside(path: tuple[bytes, ...], lo: int, hi: int) -> Iterator[tuple[int, int]]:
        for name, a, b in _atoms(data, lo, hi):
            if name == path[0]:
                a += 4 if name == b"meta" else 0  # a version comes before its atoms
                yield from inside(path[1:], a, b) if len(path) > 1 else ((a, b),)

    found: Found = {}
    for lo, hi in inside((b"moov", b"udta", b"meta", b"ilst"), 0, len(data)):
        for name, a, b in _atoms(data, lo, hi):
            for kind, c, d in _atoms(data, a, b):
                if kind == b"data" and (name in ATOMS or name == b"gnre"):
                    value = data[c + 8 : d]
                    if name == b"gnre":
                        found.setdefault("genre", str(int.from_bytes(value, "big") - 1))
                    elif name == b"trkn":
                        found.setdefault("track_no", str(int.from_bytes(value[2:4], "big")))
                    else:
                        found.setdefault(ATOMS[name], "yes" if name == b"covr" else value.decode("utf-8", "replace"))
    return found


def _wav(data: bytes) -> Found:
    found: Found = {}
    at = 12
    while at + 8 <= len(data):
        name, n = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"LIST" and data[at + 8 : at + 12] == b"INFO":
            lo, hi = at + 12, min(len(data), at + 8 + n)
            while lo + 8 <= hi:
                key, m = data[lo : lo + 4], struct.unpack_from("<I", data, lo + 4)[0]
                if key in INFO:
                    found.setdefault(INFO[key], data[lo + 8 : lo + 8 + m].split(b"\0")[0].decode("utf-8", "replace"))
                lo += 8 + m + m % 2
        elif name in (b"id3 ", b"ID3 "):
            found |= _id3(data[at + 8 : at + 8 + n])
        at += 8 + n + n % 2
    return found


def _container(data: bytes) -> Callable[[bytes], Found] | None:
    if data[:3] == b"ID3":
        after = 10 + _seven(data[6:10])
        return (lambda d: _flac(d[after:]) | _id3(d)) if data[after : after + 4] == b"fLaC" else _id3
    if data[:4] == b"RIFF" and data[8:12] == b"WAVE":
        return _wav
    for head, at, parse in ((b"fLaC", 0, _flac), (b"OggS", 0, _ogg), (b"ftyp", 4, _mp4)):
        if data[at : at + 4] == head:
            return parse
    return _oldest if data[-128:-125] == b"TAG" and len(data) >= 128 else None


def _genre(text: str) -> str:
    """The name of a genre that is a number, alone or in brackets before a name."""
    number, name = re.fullmatch(r"\(?(\d+)\)?\s*(.*)|(?:.*)", text, re.S).groups()
    if number is None or text[:1] != "(" and name:
        return text
    return name or (GENRES[int(number)] if int(number) < len(GENRES) else "")


def tags_of(data: bytes | None) -> tuple:
    """(title, artist, album_artist, album, genre, year, track_no, has_cover_art, tag_error) of a file's bytes: no_tags for a kind without any, damaged where a parser gave up."""
    error, found = None, {}
    try:
        parse = _container(data or b"")
        found, error = (parse(data), None) if parse else ({}, "no_tags")
    except (ValueError, IndexError, struct.error):
        error = "damaged"
    texts = {k: found.get(k, "").strip().replace("\0", "") for k in TEXTS}
    texts["genre"] = _genre(texts["genre"])
    number = {k: re.search(r"\d{4}" if k == "year" else r"\d{1,6}", found.get(k, "")) for k in NUMBERS}
    counted = [int(m[0]) if m and int(m[0]) > 0 else None for m in number.values()]
    return (*(texts[k] or None for k in TEXTS), *counted, "cover" in found, error)


_COLUMNS = [*TEXTS, *NUMBERS, "has_cover_art", "tag_error"]
_TYPES = ", ".join([*(f"{c} string" for c in TEXTS), *(f"{c} int" for c in NUMBERS), "has_cover_art boolean", "tag_error string"])


def with_tags(rows: DataFrame, content: str = "content") -> DataFrame:
    """rows with the tags of their column of bytes in its place."""
    kept = [c for c in rows.columns if c != content]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            told = pd.DataFrame([tags_of(x) for x in batch[content]], columns=_COLUMNS, index=batch.index)
            yield pd.concat([batch[kept], told.astype({c: "Int64" for c in NUMBERS})], axis=1)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*kept).schema), _TYPES])
    return rows.mapInPandas(read, schema)


def scan_tagged(spark: SparkSession, folder: str, most: int = MAX_BYTES) -> DataFrame:
    """What scan_folder gives, with tags, from one reading of each file; a file above ``most`` bytes has a null id and the error too_large."""
    found = files.audio_files(spark, folder)
    named = lambda rows: rows.select(*files.described(folder))
    read = found.where(F.col("length") <= most)  # the source opens only these
    small = with_tags(read.select(files.content_id(F.col("content"), F.col("length")).alias("id"), *files.described(folder), "content"))
    large = named(found.where(F.col("length") > most)).select(F.lit(None).cast("string").alias("id"), "*", F.lit("too_large").alias("tag_error"))
    return small.unionByName(large, allowMissingColumns=True)
