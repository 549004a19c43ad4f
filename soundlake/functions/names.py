"""Names and paths: folding, splitting, reading names out of folders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What marks featured artists, and words that name an edition. ASCII word edges, so accents never end a word.
_FEATURING = r"\s*[(\[]?\s*(?<![A-Za-z0-9_])(?:feat|ft|featuring|with)(?![A-Za-z0-9_])\.?\s+[^)\]]*[)\]]?"
_EDITION = r"(?<![A-Za-z0-9_])(remaster(?:ed)?(?:\s+\d{4})?|\d{4}\s+remaster(?:ed)?|radio\s+edit|single\s+version|album\s+version|original\s+mix|digital\s+remaster(?:ed)?|deluxe(?:\s+edition)?|bonus\s+track|explicit|clean|mono|stereo|remaster)(?![A-Za-z0-9_])"
_APOSTROPHES = "['‘’ʼ`]"
_SPACE = r"[\s ﻿ -     　]"
_LEADING = r"^\s*(?:(?:\d{1,2})[-_.\s]+)?(\d{1,3})\s*[-_.)\s]+\s*(?=\S)"
AUDIO = r"\.(mp3|m4a|aac|ogg|opus|wav|flac)$"


def _without_accents(name: Column) -> Column:
    """Decomposed (NFD) by the ICU library that comes with Spark, without the combining marks U+0300 to U+036F; name is not null."""
    parts = F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("decompose"), name, F.lit(False))
    return F.regexp_replace(parts, r"[\u0300-\u036F]", "")


def trimmed(text: Column) -> Column:
    """Without any white space at both ends."""
    return F.regexp_replace(text, f"^{_SPACE}+|{_SPACE}+$", "")


def blank(text: Column) -> Column:
    return text.isNull() | (trimmed(text) == "")


def fold(text: Column) -> Column:
    """The form on which two spellings of a name agree; empty if nothing is left. The word "with" also opens a featured artist."""
    plain = F.when(text.rlike(r"[^\x00-\x7F]"), _without_accents(text)).otherwise(text)  # only names that need it
    x = F.regexp_replace(F.lower(plain), "&", " and ")
    x = F.regexp_replace(F.regexp_replace(x, _FEATURING, " "), _EDITION, " ")
    x = F.regexp_replace(F.regexp_replace(x, _APOSTROPHES, ""), r"[^\p{L}\p{N}]+", " ")
    return F.trim(x)


def split_name(line: Column) -> tuple[Column, Column]:
    """(artist or null, title) of an "Artist - Title" line; the first spaced dash divides."""
    x = trimmed(line)
    pattern = "^(.+?)\\s+[-–—]\\s+(.+)$"
    split = x.rlike(pattern)
    return F.when(split, trimmed(F.regexp_extract(x, pattern, 1))), F.when(split, trimmed(F.regexp_extract(x, pattern, 2))).otherwise(x)


def _folder(path: Column, back: int) -> Column:
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    return F.try_element_at(parts, F.lit(-back))


def from_path(path: Column) -> Column:
    """struct(artist, album, title, track_no) as the folders and the file name tell them; nulls where they don't."""
    stem = F.regexp_replace(F.coalesce(_folder(path, 1), path), r"\.[^.]+$", "")
    number = F.regexp_extract(stem, _LEADING, 1)
    file_artist, file_title = split_name(F.regexp_replace(F.regexp_replace(stem, _LEADING, ""), "_", " "))
    parent = _folder(path, 2)
    parent_artist, parent_title = split_name(parent)
    track_no = F.try_to_number(F.when(number != "", number), F.lit("999")).cast("int")
    return F.struct(
        F.coalesce(file_artist, parent_artist, _folder(path, 3)).alias("artist"),
        F.when(parent_artist.isNull(), parent).otherwise(parent_title).alias("album"),
        F.when(file_title == "", stem).otherwise(file_title).alias("title"),
        F.when(track_no > 0, track_no).alias("track_no"),
    )


def leading_number(file_name: Column) -> Column:
    """The number a file name starts with, after an optional disc number; null if none."""
    n = F.regexp_extract(file_name, r"^\s*(?:\d{1,2}[-_.\s]+)?(\d{1,3})(?!\d)", 1)
    return F.try_to_number(F.when(n != "", n), F.lit("999")).cast("int")


def natural(file_name: Column) -> Column:
    """A sort key in which runs of digits count as numbers of up to 12 digits."""
    wide = F.regexp_replace(F.lower(file_name), r"(\d+)", "000000000000$1")
    return F.regexp_replace(wide, r"0*(\d{12})(?!\d)", "$1")


def decoded(path: Column) -> Column:
    """Forward slashes, and percent signs decoded if all of them can be."""
    slashed = F.translate(path, "\\", "/")
    return F.coalesce(F.try_url_decode(F.replace(slashed, F.lit("+"), F.lit("%2B"))), slashed)


def is_audio(file_name: Column) -> Column:
    return F.lower(file_name).rlike(AUDIO)


def display(artist: Column, title: Column, file_name: Column) -> Column:
    return F.when(blank(title), file_name).when(blank(artist), title).otherwise(F.concat_ws(" - ", artist, title))


def title_of(title: Column, file_name: Column) -> Column:
    """The title, or else the file's name without its ending."""
    return F.coalesce(title, F.regexp_replace(file_name, r"\.[^.]+$", ""))


def full_title(artist: Column, title: Column, file_name: Column, dash: str = " - ") -> Column:
    """For a line that somebody reads; lists on screens have a long dash."""
    return F.concat_ws(dash, artist, title_of(title, file_name))


def label(artist: Column, title: Column, file_name: Column, size: Column, duration_sec: Column) -> Column:
    """With what the file weighs a second, where that is known."""
    kbps = F.when(duration_sec > 0, F.concat(F.lit(" · "), F.floor(size * 8 / duration_sec / 1000 + 0.5).cast("string"), F.lit("k")))
    return F.concat(full_title(artist, title, file_name, " — "), F.coalesce(kbps, F.lit("")))


def proposed(artist: Column, title: Column, own_artist: Column, own_title: Column) -> Column:
    """A proposal as one line; what it leaves out is the recording's own."""
    return F.concat_ws(" — ", F.coalesce(artist, own_artist), F.coalesce(title, own_title, F.lit("")))


def tempo_and_key(bpm: Column, code: Column) -> Column:
    """The two numbers that a move turns on; empty without a key, that is for what isn't analysed."""
    tempo = F.when(bpm > 0, F.floor(bpm + 0.5).cast("string")).otherwise("--")
    return F.coalesce(F.concat(tempo, F.lit(" · "), code), F.lit(""))


def dated(kind: str, at_ms: Column, ending: str) -> Column:
    """A name for a file that is written, with the day (in UTC) of a time in ms."""
    return F.concat(F.lit(f"{kind}-"), F.date_format(F.to_utc_timestamp(F.timestamp_millis(at_ms), F.current_timezone()), "yyyy-MM-dd"), F.lit(f".{ending}"))


def duration_words(seconds: Column) -> Column:
    """Hours and minutes, or minutes alone below an hour."""
    hours, minutes = F.floor(seconds / 3600), F.floor((seconds % 3600) / 60)
    return F.when(hours > 0, F.concat(hours.cast("string"), F.lit(" h "), minutes.cast("string"), F.lit(" min"))).otherwise(F.concat(minutes.cast("string"), F.lit(" min")))
