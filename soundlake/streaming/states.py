"""Streams with a state for each key: what plays, how jobs stand, how long their stages take, what a queue hands over.

Changes of one key come in any order and in any batch. They wait in a list state until
the watermark has passed them, then a small function takes them in order of time and of
number, one by one, from the state before to the state after, and gives rows out. So
the rows are the same however the stream was cut.

Between Spark and the state a row costs far more than a step, so changes go there in
packs: those of one key in one part of a batch are one row, at most PACK changes, and
the rows given out come back as lists. Spark drops a pack when the watermark has passed
all of it before; inside a pack, a change goes that its key's state has left behind.
What the watermark has not passed yet waits in the state.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.merge import MAX_ATTEMPTS

#: How long a job may take in ms, recordings that a player holds ahead, recordings of a plan.
JOB_MS, AHEAD, PLAN_LENGTH = 60_000, 2, 20
#: How late changes may come.
LATE = "4 hours"
#: Changes of a pack and rows given out at a time, and bytes of changes that a task holds to pack.
PACK, HELD_BYTES = 4096, 32 << 20
State = tuple
Step = Callable[[State, Row], tuple[State, list[tuple]]]


@dataclass
class Machine:
    """A state's columns and first value, a change's columns beside (at, number), the rows given out, and the step; deadline and expire where a state ends by itself."""

    state: str
    first: State
    change: str
    out: str
    step: Step
    deadline: Callable[[State], int | None] | None = None
    expire: Callable[[State], tuple[State, list[tuple]]] | None = None

    def run(self, now: State, changes: list[Row], until: int | None = None) -> tuple[State, list[tuple]]:
        """The state after changes in order, and the rows; a deadline that lies before a change, or before ``until``, is met first."""
        out: list[tuple] = []

        def overdue(at: int | None) -> None:
            nonlocal now
            while self.deadline is not None and at is not None and (due := self.deadline(now)) is not None and due <= at:
                now, rows = self.expire(now)
                out.extend(rows)

        for change in changes:
            overdue(change["at"])
            now, rows = self.step(now, change)
            out.extend(rows)
        overdue(until)
        return now, out


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, _time, at, number, ...) as (key, _time, body): the changes of a key, and the last of their times."""

    def packs(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        rows = rows.take(pc.sort_indices(rows, [("key", "ascending"), ("_time", "ascending")])).combine_chunks()
        key = rows["key"]
        new = np.flatnonzero(pc.not_equal(key[1:], key[:-1]).to_numpy()) + 1
        edges = np.unique(np.concatenate([[0], new, *(np.arange(lo, hi, PACK) for lo, hi in zip(np.append(0, new), np.append(new, len(rows)), strict=True) if hi - lo > PACK), [len(rows)]])).astype(np.int64)
        bodies: list[bytes] = []
        for some in np.array_split(edges[:-1], 1 + len(rows) // 65_536):  # few changes at a time as Python's values
            if not len(some):
                continue
            lo, stops = int(some[0]), edges[np.searchsorted(edges, some) + 1]
            columns = [c.to_pylist() for c in rows.slice(lo, int(stops[-1]) - lo).columns[2:]]
            bodies += [pickle.dumps([c[i:j] for c in columns], 5) for i, j in zip((some - lo).tolist(), (stops - lo).tolist(), strict=True)]
        found = rows.select(["key", "_time"]).take(edges[1:] - 1).append_column("body", pa.array(bodies, pa.binary()))
        return found.combine_chunks().to_batches()[0]

    held, size = [], 0
    for batch in batches:
        if len(batch):
            held.append(batch)
            size += batch.nbytes
        if size >= HELD_BYTES:
            yield packs(held)
            held, size = [], 0
    if held:
        yield packs(held)


class _InOrder(StatefulProcessor):
    def __init__(self, machine: Machine, names: list[str]):
        self.machine, self.names = machine, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", f"_passed long, {self.machine.state}")
        self.waiting = handle.getListState("waiting", "body binary")
        self.fields = Row("at", "number", *(c.split()[0] for c in _columns(self.machine.change)))
        self.given = Row(*self.names)

    def _rows(self, key: tuple, rows: list[tuple]) -> Iterator[Row]:
        return iter([self.given(key[0], *map(list, zip(*rows[lo : lo + PACK], strict=True))) for lo in range(0, len(rows), PACK)])

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        some = [r["body"] for r in rows]
        self.waiting.appendList([(bytes(x),) for x in some])
        self.handle.registerTimer(min(min(pickle.loads(x)[0]) for x in some))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        passed, fields = timerValues.getCurrentWatermarkInMs(), self.fields
        held = sorted((r for (x,) in self.waiting.get() for r in zip(*pickle.loads(x), strict=True)), key=lambda r: r[:2])
        before, *now = self.now.get() or (None, *self.machine.first)
        ready, rest = [fields(*r) for r in held if r[0] <= passed and (before is None or r[0] > before)], [r for r in held if r[0] > passed]
        now, out = self.machine.run(tuple(now), ready, passed)
        self.now.update((passed, *now))
        if rest:
            self.waiting.put([(pickle.dumps(list(zip(*rest[lo : lo + PACK], strict=True)), 5),) for lo in range(0, len(rest), PACK)])
        else:
            self.waiting.clear()
        due = self.machine.deadline(now) if self.machine.deadline else None
        for at in {t for t in (rest[0][0] if rest else None, due) if t is not None}:
            self.handle.registerTimer(at)
        return self._rows(key, out)


def _columns(ddl: str) -> list[str]:
    return [c.strip() for c in ddl.split(", ")]


def followed(changes: DataFrame, key: str, at: str, number: str, machine: Machine, late: str = LATE) -> DataFrame:
    """The rows of a machine for each key of a stream; at: a column of timestamps. Spark's state store must be RocksDB (``ready``)."""
    kind = changes.schema[key].dataType.simpleString()
    wanted = [c.split()[0] for c in _columns(machine.change)]
    rows = changes.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(F.col(key).alias("key"), F.col(at).cast("timestamp").alias("_time"), F.unix_millis(at).alias("at"), F.col(number).cast("long").alias("number"), *wanted)
    packs = rows.repartition("key").mapInArrow(_packed, f"key {kind}, _time timestamp, body binary").withWatermark("_time", late)
    told = [c.split(" ", 1) for c in _columns(machine.out)]
    schema = ", ".join([f"{key} {kind}", *(f"{name} array<{type_}>" for name, type_ in told)])
    names = [name for name, _ in told]
    got = packs.groupBy("key").transformWithState(_InOrder(machine, [key, *names]), schema, "append", "EventTime")
    return got.select(key, F.inline(F.arrays_zip(*names)))


def ready(spark) -> None:
    """The store of states that these streams need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


# --- a play is recorded when a player moves to another recording ---


def _changed(now: State, r: Row) -> tuple[State, list[tuple]]:
    if r["track_id"] is None or r["track_id"] == now[0]:
        return now, []
    return (r["track_id"],), [(r["track_id"], r["at"], r["number"])]


CHANGES = Machine("track_id string", (None,), "track_id string", "track_id string, at_ms long, event_id long", _changed)


# --- the stages of jobs ---


def _timed(now: State, r: Row) -> tuple[State, list[tuple]]:
    """Entering a stage closes the one before; the end closes the last; a failure forgets it."""
    stage, since = now
    told = [] if stage is None or r["kind"] == "failed" else [(stage, since, r["at"] - since)]
    return ((r["stage"], r["at"]) if r["kind"] == "stage" else (None, None)), told


STAGES = Machine("stage string, since long", (None, None), "kind string, stage string", "stage string, at_ms long, ms long", _timed)


# --- the state of a file ---


def _moved(now: State, r: Row) -> tuple[State, list[tuple]]:
    """found, taken, decoded, saved, failed and unreadable are the kinds of changes; those that the state doesn't allow change nothing."""
    status, attempts, _ = now
    kind, at = r["kind"], r["at"]
    error = None
    if kind == "found" and status is None:
        new = ("pending", 0, None)
    elif kind == "taken" and (status == "pending" or status == "failed" and attempts < MAX_ATTEMPTS):
        new = ("decoding", attempts, at)
    elif kind == "decoded" and status == "decoding":
        new = ("analyzing", attempts, at)
    elif kind == "saved" and status == "analyzing":
        new = ("done", attempts, None)
    elif kind in ("failed", "unreadable") and status in ("decoding", "analyzing"):
        new, error = ("failed" if kind == "failed" else "unsupported", attempts + 1, None), r["message"]
    else:
        return now, []
    return new, [(at, new[0], new[1], error)]


def files(job_ms: int = JOB_MS) -> Machine:
    """A job that takes longer than job_ms has failed, and may be taken again while it has tries left."""

    def stuck(now: State) -> tuple[State, list[tuple]]:
        return ("failed", now[1] + 1, None), [(now[2] + job_ms, "failed", now[1] + 1, "timeout")]

    return Machine("status string, attempts int, since long", (None, 0, None), "kind string, message string", "at_ms long, status string, attempts int, error string", _moved, lambda now: None if now[2] is None else now[2] + job_ms, stuck)


# --- what a queue hands to a player ---


def _remaining(held: list, playing) -> int:
    return len(held) - held.index(playing) - 1 if playing in held else len(held)


def _topped(now: State) -> tuple[State, list]:
    """Hands over what the player lacks, or asks for a plan where this one is too short."""
    playing, at, plan, held, handed, short = now
    need = AHEAD - _remaining(held, at)
    if need <= 0:
        return now, []
    if len(plan) < need and not short:
        return (playing, at, plan, held, handed, True), []
    give = plan[:need]
    return (playing, at, plan[need:], held + give, handed + give, False), give


def _queued(now: State, r: Row) -> tuple[State, list[tuple]]:
    """Kinds of changes: holds (ids: the player's list), moved (track_id: what plays now) and planned (ids: a new plan, which keeps what was handed over)."""
    playing, at, plan, held, handed, short = now
    plan, held, handed = list(plan), list(held), list(handed)
    given: list = []
    played = None
    if r["kind"] == "holds":
        now = (playing, at, plan, list(r["ids"] or ()), [], short)
    elif r["kind"] == "planned":
        now = (playing, at, [i for i in r["ids"] or () if i not in held][:PLAN_LENGTH], held, handed, short)
        if short:  # the plan that was asked for; what it has is handed over, however little
            now, given = _topped(now)
            now = (*now[:5], False)
    else:
        moved = r["track_id"]
        if moved is not None and moved != playing:
            playing = played = moved
            handed = handed[handed.index(moved) + 1 :] if moved in handed else handed
        now, given = _topped((playing, moved, plan, held, handed, False))
    return now, [(r["at"], r["number"], played, given, now[5], now[4] + now[2])]


QUEUE = Machine(
    "playing string, place string, plan array<string>, held array<string>, handed array<string>, short boolean",
    (None, None, [], [], [], False),
    "kind string, track_id string, ids array<string>",
    "at_ms long, number long, played string, given array<string>, wants_plan boolean, upcoming array<string>",
    _queued,
)
