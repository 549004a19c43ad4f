"""Costs of going from one recording to another, as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import keys

#: Tempo tolerance, the ramp of a key's reliability, weights of a candidate's cost, the curve's reach.
BPM_TOLERANCE, KEY_FLOOR, KEY_CEILING = 0.08, 0.4, 0.7
TRAVEL, ARC_HEIGHT, SAME_ARTIST = 0.5, 0.45, 0.4


def clamp(x: Column) -> Column:
    """x inside 0 to 1; 0 if it is null or not a number."""
    return F.when(x.isNull() | F.isnan(x.cast("double")), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def js_round(x: Column) -> Column:
    """Halves go up, also below 0."""
    return F.floor(x + 0.5)


@dataclass(frozen=True)
class Weights:
    bpm: float = 0.25
    key: float = 0.20
    energy: float = 0.30
    timbre: float = 0.15
    novelty: float = 0.10

    def bent(self, coherence: float) -> Weights:
        """More weight on tempo and key the more coherence is asked for; the sum stays."""
        m = 2 * coherence
        parts = [self.bpm * m, self.key * m, self.energy * (2 - m), self.timbre * (2 - m), self.novelty * (2 - m)]
        total, had = sum(parts), self.bpm + self.key + self.energy + self.timbre + self.novelty
        return Weights(*(p * had / total for p in parts)) if total > 0 else self


@dataclass(frozen=True)
class Target:
    energy: float = 0.5
    brightness: float = 0.5
    danceability: float = 0.5
    familiarity: float = 0.5
    coherence: float = 0.6


#: Name, target (energy, brightness, danceability, familiarity, coherence), curve.
PRESETS = (
    ("warmup", Target(0.3, 0.4, 0.45, 0.7, 0.7), "rise"),
    ("peak", Target(0.85, 0.75, 0.85, 0.6, 0.8), "flat"),
    ("dig", Target(0.55, 0.5, 0.55, 0.1, 0.25), "arc"),
    ("late", Target(0.3, 0.2, 0.3, 0.5, 0.6), "winddown"),
)


def tempo_distance(a: Column, b: Column) -> Column:
    """Relative to a, with b also at half and double time; null if either is unknown."""
    apart = lambda x: F.abs(x - a) / a
    return F.when((a > 0) & (b > 0), F.least(apart(b), apart(b * 0.5), apart(b * 2)))


def tempo_cost(a: Column, b: Column) -> Column:
    return F.coalesce(F.least(F.lit(1.0), tempo_distance(a, b) / BPM_TOLERANCE), F.lit(1.0))


def key_reliability(strength: Column) -> Column:
    return clamp((strength - KEY_FLOOR) / (KEY_CEILING - KEY_FLOOR))


def surer(a: Column, b: Column) -> Column:
    """The lesser of two confidences; one that is unknown is 0."""
    return F.least(F.coalesce(a, F.lit(0.0)), F.coalesce(b, F.lit(0.0)))


def faded(cost: Column, confidence: Column) -> Column:
    """Towards the neutral half as confidence goes."""
    return cost * confidence + 0.5 * (1 - confidence)


def novelty(recent_artist: Column, recent_album: Column, recent: Column, frequency: Column, familiarity: float) -> Column:
    part = lambda c, v: F.when(F.coalesce(c, F.lit(False)), v).otherwise(0.0)
    return part(recent_artist, 0.6) + part(recent_album, 0.3) + part(recent, 1.0) + F.abs(F.coalesce(frequency, F.lit(0.0)) - min(1.0, max(0.0, familiarity)))


def pair_costs(a: dict[str, Column], b: dict[str, Column]) -> tuple[Column, Column]:
    """(tempo, key) costs of a and b, columns bpm, bpm_confidence, place and key_strength."""
    tempo = faded(tempo_cost(a["bpm"], b["bpm"]), surer(a["bpm_confidence"], b["bpm_confidence"]))
    key = faded(keys.distance(a["place"], b["place"]), F.least(key_reliability(a["key_strength"]), key_reliability(b["key_strength"])))
    return tempo, key


def timbre_cost(b: dict[str, Column], target: Target) -> Column:
    return 0.6 * F.abs(b["brightness"] - target.brightness) + 0.4 * F.abs(b["danceability"] - target.danceability)


def candidate_cost(a: dict[str, Column], b: dict[str, Column], target: Target, energy: Column | float, novelty_cost: Column, weights: Weights) -> Column:
    """What it costs to play b after a: tempo and key against a, energy and timbre against the target."""
    tempo, key = pair_costs(a, b)
    timbre = timbre_cost(b, target)
    return weights.bpm * tempo + weights.key * key + weights.energy * F.abs(b["energy"] - energy) + weights.timbre * timbre + weights.novelty * novelty_cost


def target_energy(shape: str, position: Column, start: Column) -> Column:
    """Energy asked for at a position from 0 to 1 of a flat, rising, falling or arched curve."""
    at = clamp(position)
    move = {"flat": F.lit(0.0), "rise": TRAVEL * at, "winddown": -TRAVEL * at, "arc": ARC_HEIGHT * F.sin(F.pi() * at)}[shape]
    return clamp(start + move)


def step_cost(a: dict[str, Column], b: dict[str, Column], tolerance: float) -> Column:
    """A route's move: no half or double time, and the same artist twice in a row costs more."""
    tempo = F.when((a["bpm"] > 0) & (b["bpm"] > 0), F.least(F.lit(1.0), F.abs(b["bpm"] - a["bpm"]) / a["bpm"] / tolerance)).otherwise(0.5)
    tempo = faded(tempo, surer(a["bpm_confidence"], b["bpm_confidence"]))
    key = faded(keys.distance(a["place"], b["place"]), F.least(key_reliability(a["key_strength"]), key_reliability(b["key_strength"])))
    return 0.55 * tempo + 0.45 * key + F.when(a["artist"] == b["artist"], SAME_ARTIST).otherwise(0.0)


def scaled_tempo(bpm: Column) -> Column:
    return F.when(bpm > 0, clamp((bpm - 60) / 140)).otherwise(0.5)


def past(x: Column, period: Column) -> Column:
    """What whole periods leave of x, by a division that rounds: 0, not nearly a period, where x is a multiple but for the last bits."""
    return x - F.floor(x / period) * period


def alignment(period_out: Column, next_out: Column, period_in: Column, next_in: Column) -> Column:
    """struct(skip_sec, drift, holds_for_beats): how far to move the incoming grid so that beats fall together. Times to the next beat, periods, in seconds."""
    raw = past(next_in - next_out, period_in)
    apart = F.abs(period_in - period_out)
    return F.struct(
        F.when((raw < 0.001) | (period_in - raw < 0.001), 0.0).otherwise(raw).alias("skip_sec"),
        (F.abs(60 / period_in - 60 / period_out) / (60 / period_out)).alias("drift"),
        F.when(apart == 0, F.lit(float("inf"))).otherwise(period_in / 20 / apart).alias("holds_for_beats"),
    )


def aligned_start(at_sec: Column, skip_sec: Column, duration_sec: Column) -> Column:
    """Where to move the incoming recording from at_sec so that beats fall together; null if there is nothing to skip or the skip runs past its end."""
    moved = at_sec + skip_sec
    return F.when((skip_sec > 0) & (duration_sec.isNull() | F.isnan(duration_sec) | (moved < duration_sec)), moved)


def until_beat(phase: Column, period: Column, at: Column) -> Column:
    """Time from ``at`` to the next beat, more than 0 and at most a period."""
    return period - past(at - phase, period)
