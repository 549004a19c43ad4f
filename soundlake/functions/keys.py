"""Keys on the wheel of 24 codes, 1A to 12B.

A place is a number from 0 to 23 in wheel order (1A, 1B, 2A, ...): the relative
key is the other one of a pair, the fifths are two places away.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PLACES = 24
#: Distances of same, relative, neighbouring and second-next codes.
SAME, RELATIVE, ONE_STEP, TWO_STEPS, FAR = 0.0, 0.15, 0.25, 0.55, 1.0


def place(root: Column, scale: Column) -> Column:
    """The place of a tonic (0 for C to 11 for B) and a mode: C major is 8B, A minor 8A, and a fifth is a step."""
    return F.pmod(7 * root + F.when(scale == "major", 7).otherwise(4), F.lit(12)) * 2 + F.when(scale == "major", 1).otherwise(0)


def code(at: Column) -> Column:
    return F.concat((F.floor(at / 2) + 1).cast("string"), F.when(at % 2 == 0, "A").otherwise("B"))


def parse(text: Column) -> Column:
    """The place of a code in either case, null for anything else."""
    clean = F.upper(F.trim(text))
    number = F.regexp_extract(clean, "^([1-9]|1[0-2])([AB])$", 1)
    return F.when(number != "", (F.try_to_number(number, F.lit("99")).cast("int") - 1) * 2 + F.when(clean.endswith("B"), 1).otherwise(0))


def compatible(at: Column) -> Column:
    """The places that mix well, nearest first: the relative key, one step up, one step down."""
    return F.array(at + 1 - 2 * (at % 2), (at + 2) % PLACES, (at + PLACES - 2) % PLACES)


def distance(a: Column, b: Column) -> Column:
    """0 to 1 between two places; 1 if either is unknown."""
    apart = F.abs(F.floor(a / 2) - F.floor(b / 2))
    steps = F.least(apart, 12 - apart)
    same_mode = a % 2 == b % 2
    return (
        F.when(a.isNull() | b.isNull(), FAR)
        .when(a == b, SAME)
        .when(steps == 0, RELATIVE)
        .when(same_mode & (steps == 1), ONE_STEP)
        .when(same_mode & (steps == 2), TWO_STEPS)
        .otherwise(FAR)
    )


def relation(a: Column, b: Column) -> Column:
    d = distance(a, b)
    return F.when(d == SAME, "same").when(d == RELATIVE, "relative").when(d == ONE_STEP, "neighbour").when(d == TWO_STEPS, "two-steps").otherwise("distant")


def relation_label(name: Column) -> Column:
    # fixed values: the wording of each relation
    labels = {"same": "same key", "relative": "relative", "neighbour": "one step", "two-steps": "two steps", "distant": "key jump", "unknown": "key unsure"}
    return F.create_map(*(F.lit(x) for pair in labels.items() for x in pair))[name]
