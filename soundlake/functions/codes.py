"""Short texts for bytes, counts, histograms and settings: base 64 with - and _, never padded with =."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The alphabet, and the forms of codes.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"
SHAPE_VERSION, TEMPO_SLOTS, KEY_SLOTS = "S1", 14, 24
FINGERPRINT_BYTES, FINGERPRINT_CHARS = 720, 960
VIBE_VERSION, VIBE_FIELDS, CURVES = "1", ("energy", "brightness", "danceability", "familiarity", "coherence"), ("flat", "rise", "arc", "winddown")


def bytes_to_hex(values: Column) -> Column:
    return F.array_join(F.transform(values, lambda v: F.lpad(F.hex(v.cast("long")), 2, "0")), "")


def bytes_to_text(values: Column, count: int) -> Column:
    """The text of ``count`` byte values in an array; zero bytes fill the last group of three."""
    padded = F.rpad(bytes_to_hex(values), (count + 2) // 3 * 6, "0")
    return F.translate(F.regexp_replace(F.base64(F.unhex(padded)), r"[\r\n]", ""), "+/", "-_")


def text_to_bytes(text: Column, count: int) -> Column:
    """The ``count`` byte values in a text; null if it has another length or other characters."""
    right = text.rlike(f"^[A-Za-z0-9_-]{{{(count + 2) // 3 * 4}}}$")
    digits = F.hex(F.unbase64(F.when(right, F.translate(text, "-_", "+/"))))
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.conv(F.substring(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("int"))


def number_to_text(value: Column, width: int) -> Column:
    """A number in base 64 of fixed width, capped at what fits."""
    capped = F.greatest(F.lit(0), F.least(F.lit(64**width - 1), F.floor(value)))
    return F.concat(*(F.substring(F.lit(ALPHABET), (F.floor(capped / 64**k) % 64 + 1).cast("int"), F.lit(1)) for k in reversed(range(width))))


def text_to_number(text: Column, width: int) -> Column:
    digits = [F.instr(F.lit(ALPHABET), F.substring(text, k + 1, 1)) - 1 for k in range(width)]
    total = F.lit(0)
    for d in digits:
        total = total * 64 + d
    return F.when(text.rlike(f"^[A-Za-z0-9_-]{{{width}}}$"), total)


def scaled(counts: Column) -> Column:
    """Counts as bytes, the largest being 255; zeros if all are 0."""
    top = F.array_max(counts)
    return F.transform(counts, lambda c: F.when(top > 0, F.floor(c / top * 255 + 0.5)).otherwise(0).cast("int"))


def shares(values: Column) -> Column:
    """Parts of their sum; zeros if it is 0."""
    total = F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    return F.transform(values, lambda v: F.when(total > 0, v / total).otherwise(0.0))


def shape_code(analysed: Column, tempo: Column, keys: Column) -> Column:
    return F.concat(F.lit(SHAPE_VERSION), number_to_text(analysed, 3), bytes_to_text(F.concat(scaled(tempo), scaled(keys)), TEMPO_SLOTS + KEY_SLOTS))


def shape_of(code: Column) -> Column:
    """struct(analysed, tempo, keys), shares of 14 tempo and 24 key slots; null if the text is no such code."""
    values = text_to_bytes(F.substring(code, 6, 10_000), TEMPO_SLOTS + KEY_SLOTS)
    number = text_to_number(F.substring(code, 3, 3), 3)
    out = F.struct(number.alias("analysed"), shares(F.slice(values, 1, TEMPO_SLOTS)).alias("tempo"), shares(F.slice(values, TEMPO_SLOTS + 1, KEY_SLOTS)).alias("keys"))
    return F.when(code.startswith(SHAPE_VERSION) & number.isNotNull() & values.isNotNull(), out)


def fingerprint_text(values: Column) -> Column:
    return F.when(F.size(values) == FINGERPRINT_BYTES, bytes_to_text(values, FINGERPRINT_BYTES))


def fingerprint_bytes(text: Column) -> Column:
    return text_to_bytes(text, FINGERPRINT_BYTES)


def vibe_code(target: dict[str, Column], curve: Column) -> Column:
    """Twelve characters: version, five settings as hex bytes, curve."""
    byte = lambda v: F.lpad(F.lower(F.hex(F.when(F.isnan(v) | v.isNull(), 128).otherwise(F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)) * 255 + 0.5)).cast("long"))), 2, "0")
    index = F.greatest(F.lit(0), F.array_position(F.array(*map(F.lit, CURVES)), curve) - 1)
    return F.concat(F.lit(VIBE_VERSION), *(byte(target[f].cast("double")) for f in VIBE_FIELDS), index.cast("string"))


def vibe_of(code: Column) -> Column:
    """struct of the five settings and the curve; null if the text is no such code."""
    right = code.rlike(f"^{VIBE_VERSION}[0-9a-fA-F]{{10}}[0-3]$")
    field = lambda i: F.conv(F.substring(code, 2 + 2 * i, 2), 16, 10).cast("double") / 255
    curve = F.try_element_at(F.array(*map(F.lit, CURVES)), F.try_to_number(F.when(right, F.substring(code, 12, 1)), F.lit("9")).cast("int") + 1)
    return F.when(right, F.struct(*(field(i).alias(f) for i, f in enumerate(VIBE_FIELDS)), curve.alias("curve")))


def vibe_link(base: Column, code: Column) -> Column:
    return F.concat(base, F.when(base.contains("?"), "&").otherwise("?"), F.lit("vibe="), code)


def vibe_from_url(url: Column) -> Column:
    return vibe_of(F.try_parse_url(url, F.lit("QUERY"), F.lit("vibe")))
