"""What to play next: scored candidates, queues, routes, and what each move means.

A queue is planned from one scan. What a recording costs after another depends on
the step only through tempo, key and energy; the rest is the same at every step.
So recordings are put into cells of key, tempo and energy, and of each cell the
``POOL`` cheapest by that rest come to the driver: a bounded number, as there are at
most 2,400 cells. The steps then run over this pool. A recording left out costs at
least the rest of the last one taken from its cell, plus the least that tempo, key
and energy can cost anywhere in the cell; if that is more than the dozenth of the
shortlist for every cell with rows left out, the shortlist is the one of all rows.
Where it is not, the step is done by a scan of all rows, which ends in a bounded
top-k.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import replace
from math import log

import numpy as np
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..functions import keys, scores
from ..functions.scores import Target, Weights, js_round
from ..operators import history
from ..sources.files import checkpointed

#: Shortlist, rows needed, tempo prefilter and from how many rows on it applies; route length, beam, shortlist, pull, slack.
SHORTLIST, LEAST_ROWS, NEAR_TEMPO, MANY_ROWS = 12, 30, 0.15, 2_000
STEPS, BEAM, ROUTE_SHORTLIST, PULL, SLACK = 6, 8, 150, 2.5, 1.5
QUEUE_LENGTH, HANDED = 20, 2
#: Rows kept of a cell; tempo cells grow by this factor between two ends, beyond which all are one; cells of energy.
POOL, TEMPO_STEP, SLOWEST, FASTEST, ENERGY_CELLS = 96, 1.15, 40.0, 240.0, 5
FIELDS = ("id", "artist", "bpm", "bpm_confidence", "place", "key_strength", "energy", "brightness", "danceability")


def side(prefix: str = "") -> dict[str, Column]:
    return {f: F.col(prefix + f) for f in FIELDS}


def literals(row: Row) -> dict[str, Column]:
    """The fields of one known recording as constants."""
    kinds = {"id": "string", "artist": "string", "place": "int"}
    return {f: F.lit(row[f]).cast(kinds.get(f, "double")) for f in FIELDS}


def candidates(tracks: DataFrame) -> DataFrame:
    """Playable rows with the fields that scoring needs; context columns are filled where missing, and unknown descriptors are in the middle."""
    place = keys.place(F.col("key_root"), F.col("key_scale"))
    plain = {"recent_artist": F.lit(False), "recent_album": F.lit(False), "recent": F.lit(False), "frequency": F.lit(0.5)}
    rows = tracks.where("analysed AND status = 'done'").withColumn("place", place.cast("int"))
    known = {f: F.coalesce(F.nanvl(F.col(f), F.lit(None)), F.lit(0.5)) for f in ("energy", "brightness", "danceability")}
    return rows.withColumns(known).select(*FIELDS, *(F.col(c) if c in tracks.columns else v.alias(c) for c, v in plain.items()))


def is_ready(tracks: DataFrame) -> bool:
    return tracks.where("analysed AND status = 'done'").limit(LEAST_ROWS).count() >= LEAST_ROWS


def scored(rows: DataFrame, current: dict[str, Column], target: Target, energy: float, weights: Weights) -> DataFrame:
    """rows with their cost after the current recording."""
    new = scores.novelty(F.col("recent_artist"), F.col("recent_album"), F.col("recent"), F.col("frequency"), target.familiarity)
    return rows.withColumn("cost", scores.candidate_cost(current, side(), target, energy, new, weights))


def curve(shape: str, position: float, start: float) -> float:
    """Energy asked for at a position of a queue; the same as functions.scores.target_energy, for one number."""
    from math import pi, sin

    at = min(1.0, max(0.0, position))
    move = {"flat": 0.0, "rise": scores.TRAVEL * at, "winddown": -scores.TRAVEL * at, "arc": scores.ARC_HEIGHT * sin(pi * at)}[shape]
    return min(1.0, max(0.0, start + move))


def _near(bpm: Column) -> Column:
    return F.coalesce((F.col("bpm") > 0) & (scores.tempo_distance(bpm, F.col("bpm")) <= NEAR_TEMPO), F.lit(False))


def _shortlist(rows: DataFrame, many: bool) -> list[Row]:
    """The dozen cheapest rows (with cost and near); of a large collection only those near in tempo, if there are a dozen."""
    if many:
        short = rows.orderBy(F.desc("near"), "cost", "id").limit(SHORTLIST).collect()
        if len(short) == SHORTLIST and all(r.near for r in short):
            return short
    return rows.orderBy("cost", "id").limit(SHORTLIST).collect()


def _tempo_cell(bpm: Column) -> Column:
    return F.when(bpm >= SLOWEST, F.floor(F.log(F.least(F.lit(FASTEST), bpm) / SLOWEST) / log(TEMPO_STEP))).when(bpm > 0, -1).otherwise(-99)


class _Pool:
    """The cheapest rows of each cell by what no step changes, and bounds for those left out."""

    def __init__(self, rows: DataFrame, target: Target, weights: Weights, seed_id: str, most: int):
        new = scores.novelty(F.col("recent_artist"), F.col("recent_album"), F.col("recent"), F.col("frequency"), target.familiarity)
        rest = weights.timbre * scores.timbre_cost(side(), target) + weights.novelty * new
        cell = {"at": F.coalesce("place", F.lit(-1)), "slot": _tempo_cell(F.col("bpm")).cast("int"), "level": F.least(F.lit(ENERGY_CELLS - 1), F.greatest(F.lit(0), F.floor(F.col("energy") * ENERGY_CELLS))).cast("int")}
        priced = rows.withColumns({"rest": rest, **cell}).select(*FIELDS, "rest", *cell)
        cheap = priced.withColumn("n", F.row_number().over(Window.partitionBy(*cell).orderBy("rest", "id"))).where(F.col("n") <= most)  # cut in each task before rows move
        seed = priced.where(F.col("id") == seed_id).withColumn("n", F.lit(0))
        kept = cheap.unionByName(seed).toPandas()  # most of each cell
        kept = kept[~kept["id"].duplicated()].reset_index(drop=True)
        self.rows, self.weights = kept, weights
        self.ids = kept["id"].to_numpy(object)
        number = lambda c: kept[c].to_numpy(np.float64, na_value=np.nan)
        self.bpm, self.energy, self.rest = number("bpm"), number("energy"), number("rest")
        self.confidence, self.strength = np.nan_to_num(number("bpm_confidence")), _unit((np.nan_to_num(number("key_strength"), nan=-np.inf) - scores.KEY_FLOOR) / (scores.KEY_CEILING - scores.KEY_FLOOR))
        self.place = kept["at"].to_numpy(int)
        self.by_id = np.argsort(self.ids, kind="stable")
        self.free = np.ones(len(kept), bool)
        full = kept[kept["n"] == most]  # cells that may have rows left out
        self.cell_place, self.cell_rest = full["at"].to_numpy(int), full["rest"].to_numpy(float)
        slot, level = full["slot"].to_numpy(float), full["level"].to_numpy(float)
        self.slow, self.fast = (np.where(slot < -98, np.nan, SLOWEST * TEMPO_STEP ** (slot + k)) for k in (0, 1))
        self.slow[slot == -1] = 0.0
        self.fast[self.fast > FASTEST] = np.inf
        self.low = np.where(level == 0, -np.inf, level / ENERGY_CELLS)
        self.high = np.where(level == ENERGY_CELLS - 1, np.inf, (level + 1) / ENERGY_CELLS)

    def row(self, i: int) -> Row:
        return Row(**{f: None if x is None or x != x else x for f, x in zip(FIELDS, self.rows.loc[i, list(FIELDS)], strict=True)})

    def add(self, row: Row) -> int:
        """Takes in a row that was left out, as what plays now."""
        place, strength = -1 if row.place is None else row.place, scores.KEY_FLOOR if row.key_strength is None else row.key_strength
        self.rows.loc[len(self.rows)] = {**{c: None for c in self.rows.columns}, **row.asDict()}
        self.ids = np.append(self.ids, row.id)
        for name, value in (("bpm", row.bpm if row.bpm is not None else np.nan), ("energy", row.energy), ("rest", np.inf), ("confidence", row.bpm_confidence or 0.0), ("strength", float(_unit(np.float64((strength - scores.KEY_FLOOR) / (scores.KEY_CEILING - scores.KEY_FLOOR))))), ("place", place), ("free", False)):
            setattr(self, name, np.append(getattr(self, name), value))
        self.by_id = np.argsort(self.ids, kind="stable")
        return len(self.ids) - 1

    def shortlist(self, current: int, energy: float, many: bool) -> list[tuple[int, float]] | None:
        """(row, cost) of the dozen; None if rows left out may belong to it."""
        w, bpm = self.weights, self.bpm[current]
        apart = _apart(bpm, self.bpm, self.bpm)
        tempo = _faded(np.where(np.isnan(apart), 1.0, np.minimum(1.0, apart / scores.BPM_TOLERANCE)), np.minimum(self.confidence[current], self.confidence))
        key = _faded(_KEYS[self.place[current], self.place], np.minimum(self.strength[current], self.strength))
        cost = w.bpm * tempo + w.key * key + w.energy * np.abs(self.energy - energy) + self.rest
        order = self.by_id[np.argsort(cost[self.by_id], kind="stable")]
        order = order[self.free[order]]
        # the least that tempo, key and energy cost in each cell; a cost fades towards a half, so it can't fall below the lesser of both
        away = _apart(bpm, self.slow, self.fast)
        least = w.bpm * np.minimum(0.5, np.where(np.isnan(away), 1.0, away / scores.BPM_TOLERANCE)) + w.key * np.minimum(0.5, _KEYS[self.place[current], self.cell_place]) + w.energy * np.maximum(0, np.maximum(self.low - energy, energy - self.high)) + self.cell_rest
        if many:
            near = order[apart[order] <= NEAR_TEMPO][:SHORTLIST]
            inside = away <= NEAR_TEMPO + 1e-9
            if len(near) == SHORTLIST:
                return None if (least[inside] <= cost[near[-1]] + 1e-9).any() else [(int(i), float(cost[i])) for i in near]
            if inside.any():
                return None
        short = order[:SHORTLIST]
        if len(least) and (len(short) < SHORTLIST or (least <= cost[short[-1]] + 1e-9).any()):
            return None
        return [(int(i), float(cost[i])) for i in short]


def _unit(x: np.ndarray) -> np.ndarray:
    return np.minimum(1.0, np.maximum(0.0, x))


def _faded(cost: np.ndarray, confidence: np.ndarray) -> np.ndarray:
    return cost * confidence + 0.5 * (1 - confidence)


def _apart(bpm: float, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Relative distance of a tempo from the nearest in a range, its half or its double; NaN if either is unknown."""
    if not bpm > 0:
        return np.full(len(low), np.nan)
    with np.errstate(invalid="ignore"):
        gaps = [np.maximum(0, np.maximum(k * low - bpm, bpm - k * high)) / bpm for k in (1, 0.5, 2)]
        return np.where(high > 0, np.minimum.reduce(gaps), np.nan)


def _key_table() -> np.ndarray:
    """Distances of all places; the last row and column stand for an unknown key."""
    out = np.full((keys.PLACES + 1, keys.PLACES + 1), keys.FAR)
    for a in range(keys.PLACES):
        for b in range(keys.PLACES):
            steps = min(abs(a // 2 - b // 2), 12 - abs(a // 2 - b // 2))
            same_mode = a % 2 == b % 2
            out[a, b] = keys.SAME if a == b else keys.RELATIVE if steps == 0 else keys.ONE_STEP if same_mode and steps == 1 else keys.TWO_STEPS if same_mode and steps == 2 else keys.FAR
    return out


_KEYS = _key_table()


def draw(costs: list[float], random: Callable[[], float]) -> int:
    """The place in a shortlist that is taken, the likelier the lower its cost."""
    odds = [1 / (c + 0.05) for c in costs]
    left = random() * sum(odds)
    for i, odd in enumerate(odds):
        left -= odd
        if left <= 0:
            return i
    return 0  # a sliver that rounding leaves


def plan_queue(tracks: DataFrame, seed_id: str, length: int = QUEUE_LENGTH, target: Target | None = None, shape: str = "arc", exclude: Iterable[str] | DataFrame = (), random: Callable[[], float] = lambda: 0.0, weights: Weights | None = None, start_energy: float | None = None, pool: int = POOL, near_first: bool = True) -> DataFrame:
    """(step, id, cost, target_energy): the queue after a seed. random gives numbers from 0 to 1; 0 always takes the cheapest, ties going by id. exclude: ids, or a table of them. near_first: of a large collection those near in tempo come first, whatever others cost."""
    target = target or Target()
    weights = weights or Weights().bent(target.coherence)
    spark, planned = tracks.sparkSession, []
    rows = candidates(tracks)
    barred = exclude.select("id") if isinstance(exclude, DataFrame) else spark.createDataFrame([(x,) for x in exclude], "id string")
    rows = rows.join(barred.where(F.col("id") != seed_id), "id", "left_anti")
    held = _Pool(rows, target, weights, seed_id, max(1, pool))
    at = np.flatnonzero(held.ids == seed_id)
    out = "step int, id string, cost double, target_energy double"
    if not len(at):
        return spark.createDataFrame([], out)
    current, seed, used, scanned = int(at[0]), held.row(int(at[0])), {seed_id}, False
    held.free[current] = False
    left = len(held.ids) - 1
    if near_first and len(held.cell_place) and left < MANY_ROWS + length:
        left = rows.limit(MANY_ROWS + length + 1).count() - 1
    for step in range(length):
        energy = curve(shape, 0 if length <= 1 else (step + 1) / length, target.energy if start_energy is None else start_energy)
        many = near_first and (seed.bpm or 0) > 0 and left - step >= MANY_ROWS
        short = held.shortlist(current, energy, many)
        if short is None:
            if not scanned:
                rows, scanned = checkpointed(rows), True
            gone = spark.createDataFrame([(x,) for x in sorted(used)], "id string")
            free = scored(rows.join(F.broadcast(gone), "id", "left_anti"), literals(seed), replace(target, energy=energy), energy, weights)  # no more than the queue's length
            got = _shortlist(free.withColumn("near", _near(F.lit(seed.bpm).cast("double"))), many)
            if not got:
                break
            chosen = got[draw([r.cost for r in got], random)]
            seed, cost = Row(**{f: chosen[f] for f in FIELDS}), chosen.cost
            at = np.flatnonzero(held.ids == seed.id)
            current = int(at[0]) if len(at) else held.add(seed)
        elif not short:
            break
        else:
            current, cost = short[draw([c for _, c in short], random)]
            seed = held.row(current)
        held.free[current] = False
        used.add(seed.id)
        planned.append((step + 1, seed.id, float(cost), energy))
    return spark.createDataFrame(planned, out)


def queue_for(tracks: DataFrame, plays: DataFrame, seed_id: str, reachable: DataFrame | None = None, now: DataFrame | None = None, held: Iterable[str] = (), **plan) -> DataFrame:
    """The queue after a seed against the play history, or nothing below thirty playable recordings.

    Recordings that the player holds already are not planned. Those that reachable (id) lacks are dropped after planning, so the queue gets shorter and its steps keep their numbers.
    """
    if not is_ready(tracks):
        return tracks.sparkSession.createDataFrame([], "step int, id string, cost double, target_energy double")
    got = plan_queue(history.context(plays, tracks, now, seed_id), seed_id, exclude=tuple(held), **plan)
    return got if reachable is None else got.join(reachable.select("id").distinct(), "id", "left_semi").select(*got.columns)


def first_seed(tracks: DataFrame, playing_id: str | None = None) -> str | None:
    """What to plan from: what is playing, if it is analysed, else the analysed recording of least id."""
    analysed = tracks.where("analysed")
    found = analysed.where(F.col("id") == playing_id).select("id").first() if playing_id is not None else None
    return found.id if found else analysed.agg(F.min("id").alias("id")).first().id


def hand_over(queue: DataFrame, remaining: int, most: int = HANDED) -> tuple[DataFrame, DataFrame]:
    """(steps to give to the player, steps that stay planned): the first of the queue, so that the player has ``most`` to come."""
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("step"))  # one queue
    rows, give = queue.withColumn("place", place), max(0, most - remaining)
    return rows.where(F.col("place") <= give).drop("place"), rows.where(F.col("place") > give).drop("place")


def without_played(handed: DataFrame, playing_id: str) -> DataFrame:
    """What was handed over (step, id), without what plays now and everything before it; all of it if that is none of these."""
    started = handed.where(F.col("id") == playing_id).agg(F.min("step").alias("from"))  # one row
    return handed.crossJoin(started).where(F.col("from").isNull() | (F.col("step") > F.col("from"))).drop("from")


def near_share(tracks: DataFrame, queue: DataFrame, seed_id: str, within: float = 0.1) -> DataFrame:
    """One row (moves, near): moves of a queue, the seed's first, and the part of them whose tempos lie within a tenth."""
    rows = candidates(tracks).join(F.broadcast(queue.select("step", "id").unionByName(tracks.sparkSession.createDataFrame([(0, seed_id)], "step int, id string"))), "id")
    apart = scores.tempo_distance(F.lag("bpm").over(Window.partitionBy(F.lit(0)).orderBy("step")), F.col("bpm"))  # one queue
    moves = rows.select("step", apart.alias("d")).where("step > 0")
    return moves.agg(F.count("*").alias("moves"), F.avg(F.when(F.col("d") < within, 1.0).otherwise(0.0)).alias("near"))


def plan_route(tracks: DataFrame, from_id: str, to_id: str, steps: int = STEPS, exclude: Iterable[str] = ()) -> DataFrame:
    """(step, id, progress): a route of ``steps`` recordings between two, both included; no row if there is none.

    A beam of eight routes is extended by the 150 recordings nearest to each point of the way; both are bounded, so only the nearest-150 search runs over the collection.
    """
    spark, steps = tracks.sparkSession, max(1, steps)
    none = spark.createDataFrame([], "step int, id string, progress double")
    rows = candidates(tracks)
    ends = {r.id: r for r in rows.where(F.col("id").isin(from_id, to_id)).collect()}
    if len(ends) < 2:
        return none
    a, b = ends[from_id], ends[to_id]
    pool = rows.where(~F.col("id").isin(from_id, to_id, *exclude))
    if pool.limit(steps).count() < steps:
        return none
    known = (a.bpm or 0) > 0 and (b.bpm or 0) > 0
    tolerance = max(scores.BPM_TOLERANCE, abs(b.bpm - a.bpm) / (steps + 1) / a.bpm * SLACK) if known else scores.BPM_TOLERANCE
    point = lambda r: (r.energy, r.brightness, r.danceability, min(1.0, max(0.0, (r.bpm - 60) / 140)) if (r.bpm or 0) > 0 else 0.5)
    here = (F.col("energy"), F.col("brightness"), F.col("danceability"), scores.scaled_tempo(F.col("bpm")))
    last = [f"last_{f}" for f in FIELDS]
    kinds = "id string, artist string, bpm double, bpm_confidence double, place int, key_strength double, energy double, brightness double, danceability double"
    schema = "used array<string>, total double, " + ", ".join(f"last_{k.strip()}" for k in kinds.split(","))
    routes = [([from_id], 0.0, *(a[f] for f in FIELDS))]
    for step in range(1, steps + 1):
        goal = [x + (y - x) * step / (steps + 1) for x, y in zip(point(a), point(b), strict=True)]
        away = sum(F.abs(h - g) for h, g in zip(here, goal, strict=True)) / 4
        near = pool.withColumn("away", away).orderBy("away", "id").limit(ROUTE_SHORTLIST)
        beam = spark.createDataFrame(routes, schema)
        pairs = near.crossJoin(F.broadcast(beam)).where(~F.array_contains("used", F.col("id")))  # eight by 150
        cost = F.col("total") + scores.step_cost(side("last_"), side(), tolerance) + PULL * F.col("away")
        best = pairs.withColumn("cost", cost).withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("cost", F.array_join("used", ",")))).where("r = 1")
        got = best.orderBy("cost", "id").limit(BEAM).select(F.array_append("used", F.col("id")).alias("used"), F.col("cost").alias("total"), *FIELDS).collect()
        if not got:
            return none
        routes = [tuple(r) for r in got]
    final = spark.createDataFrame(routes, schema).withColumn("total", F.col("total") + scores.step_cost(side("last_"), literals(b), tolerance))
    path = [*final.orderBy("total", last[0]).first().used, to_id]
    return spark.createDataFrame([(i, x, i / (len(path) - 1)) for i, x in enumerate(path)], "step int, id string, progress double")


def explain(rows: DataFrame, order: str = "step", by: str | None = None) -> DataFrame:
    """rows (candidates' fields and an order) with what the move from the row before means: columns bpm_delta, key_relation, energy_delta, summary; null for the first."""
    w = (Window.partitionBy(by) if by else Window.partitionBy(F.lit(0))).orderBy(order)  # the rows of one queue
    fields = ("bpm", "place", "key_strength", "energy")
    p = {f: F.lag(f).over(w).alias(f) for f in fields}
    rows = rows.withColumn("p", F.struct(*p.values())).withColumn("moves", F.lag("id").over(w).isNotNull())
    tempo_known = (F.col("p.bpm") > 0) & (F.col("bpm") > 0)
    key_known = (scores.key_reliability(F.col("p.key_strength")) > 0) & (scores.key_reliability(F.col("key_strength")) > 0)
    delta = F.when(tempo_known, js_round(F.col("bpm")) - js_round(F.col("p.bpm"))).otherwise(0).cast("long")
    relation = F.when(key_known, keys.relation(F.col("p.place"), F.col("place"))).otherwise("unknown")
    energy = F.col("energy") - F.col("p.energy")
    signed = lambda x: F.concat(F.when(x > 0, "+").otherwise(""), x.cast("long").cast("string"))
    parts = (
        F.when(tempo_known, F.concat(signed(delta), F.lit(" bpm"))).otherwise("tempo unsure"),
        F.when(key_known, F.concat(keys.code(F.col("p.place")), F.lit("→"), keys.code(F.col("place")), F.lit(" "), keys.relation_label(relation))).otherwise(keys.relation_label(F.lit("unknown"))),
        F.concat(F.lit("energy "), signed(js_round(energy * 100))),
    )
    said = {"bpm_delta": delta, "key_relation": relation, "energy_delta": energy, "summary": F.concat_ws(" · ", *parts)}
    return rows.withColumns({n: F.when(F.col("moves"), c) for n, c in said.items()}).drop("p", "moves")


def set_sheet(tracks: DataFrame, queue: DataFrame, now_id: str | None = None) -> DataFrame:
    """(step, id, ...) of what plays now, if anything, and the queue, each row with the move into it."""
    steps = queue.select("step", "id")
    if now_id is not None:
        steps = tracks.sparkSession.createDataFrame([(0, now_id)], "step int, id string").unionByName(steps)
    return explain(candidates(tracks).join(F.broadcast(steps), "id"))  # a queue's length
