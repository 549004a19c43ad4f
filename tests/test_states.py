"""Streams with a state for each key, against plain loops, however the stream is cut."""

import pickle
import random

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from soundlake.operators import history
from soundlake.streaming import plays, states

HOUR = 3_600_000
SCHEMA = "player long, event_id long, at timestamp, track_id string"


def cut(spark, folder, rows, schema, parts):
    """A stream that finds the rows in so many batches; file times follow the parts."""
    size = -(-len(rows) // parts)
    for i in range(parts):
        spark.createDataFrame(rows[i * size : (i + 1) * size], schema).coalesce(1).write.parquet(f"{folder}/{i:03d}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))


@pytest.mark.parametrize("parts", [1, 5])
def test_changes_from_many_batches(spark, tmp_path, parts):
    rng = random.Random(parts)
    base = pd.Timestamp("2024-05-01")
    rows = [(rng.randint(0, 3), i, (base + pd.Timedelta(minutes=10 * i)).to_pydatetime(), rng.choice(["a", "b", None])) for i in range(400)]
    late = [(9, 1000, base.to_pydatetime(), "z")]  # of the first moment, but arrives last
    rows = [r for lo in range(0, 400, 12) for r in rng.sample(rows[lo : lo + 12], len(rows[lo : lo + 12]))]  # two hours of disorder
    states.ready(spark)
    stream = cut(spark, tmp_path / "in", rows + (late if parts > 1 else []), SCHEMA, parts)
    changes = states.followed(stream, "player", "at", "event_id", states.CHANGES)
    plays.append_plays(changes, str(tmp_path / "plays"), str(tmp_path / "marks"))
    got = {(r.player, r.event_id, r.track_id) for r in spark.read.parquet(str(tmp_path / "plays")).collect()}
    table = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("at", "played_at")
    whole = history.without_repeats(table, "player").where(F.col("played_at") <= (base + pd.Timedelta(minutes=10 * 399 - 240)).to_pydatetime())
    assert got == {(r.player, r.event_id, r.track_id) for r in whole.collect()}


def test_a_stream_that_goes_on(spark, tmp_path):
    """State outlives a run: the second part knows what played in the first."""
    base = pd.Timestamp("2024-05-01")
    at = lambda h: (base + pd.Timedelta(hours=h)).to_pydatetime()
    states.ready(spark)

    def run(i, rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        plays.append_plays(states.followed(stream, "player", "at", "event_id", states.CHANGES), f"{tmp_path}/plays", f"{tmp_path}/marks")
        return sorted((r.event_id, r.track_id) for r in spark.read.parquet(f"{tmp_path}/plays").collect())

    assert run(0, [(1, 1, at(0), "a"), (1, 2, at(1), "a"), (2, 9, at(6), "x")]) == [(1, "a")]
    assert run(1, [(1, 3, at(7), "a"), (1, 4, at(8), "b"), (2, 10, at(20), "x")]) == [(1, "a"), (4, "b"), (9, "x")]


def test_changes_go_to_states_in_packs():
    """A row for each key and 4,096 changes of it, with the last of their times; nothing is lost."""
    rng = random.Random(5)
    rows = [(k, i, i // 3, f"t{i % 7}") for i, k in enumerate(rng.choices("abc", [1, 40, 400], k=12_000))]
    batches = [pa.record_batch([pa.array(c) for c in zip(*[(k, pd.Timestamp(at, unit="ms"), at, n, t) for k, at, n, t in rows[lo : lo + 500]], strict=True)], names=["key", "_time", "at", "number", "track_id"]) for lo in range(0, len(rows), 500)]
    got = [r for b in states._packed(iter(batches)) for r in b.to_pylist()]
    back = [(r["key"], *c) for r in got for c in zip(*pickle.loads(r["body"]), strict=True)]
    assert sorted(back) == sorted(rows) and len(got) == sum(-(-sum(r[0] == k for r in rows) // 4096) for k in "abc")
    assert all(r["_time"] == pd.Timestamp(max(pickle.loads(r["body"])[0]), unit="ms").to_pydatetime() for r in got)
    assert not list(states._packed(iter([batches[0].slice(0, 0)])))


def test_a_player_with_very_many_changes(spark, tmp_path):
    """More than a pack takes, and a late change in one pack with new ones."""
    base = pd.Timestamp("2024-05-01")
    at = lambda i: (base + pd.Timedelta(seconds=i)).to_pydatetime()
    rows = [(1, i, at(3 * i), f"t{i}") for i in range(10_000)]
    random.Random(3).shuffle(rows)
    others = lambda n, t: [(2, n + i, at(t), "x") for i in range(10_000)]
    last = [(1, 50_000, at(5), "late"), (1, 50_001, at(40_000), "new"), (1, 50_002, at(60_000), "last"), *others(60_000, 60_000)[3:]]
    states.ready(spark)
    stream = cut(spark, tmp_path / "in", rows + others(20_000, 31_000) + last, SCHEMA, 3)
    got = plays.run_once(states.followed(stream, "player", "at", "event_id", states.CHANGES)).collect()
    assert sorted(r.event_id for r in got) == [*range(10_000), 20_000, 50_001]


def change(machine, at, *values):
    names = ["at", "number", *(c.split()[0] for c in machine.change.split(", "))]
    return Row(*names)(at, at, *values)


def test_stage_times():
    """A failed opening leaves nothing behind."""
    m = states.STAGES
    _, out = m.run(m.first, [change(m, 0, "stage", "decode"), change(m, 400, "failed", None), change(m, 1000, "stage", "decode"), change(m, 1010, "stage", "measure"), change(m, 1030, "done", None), change(m, 1040, "done", None)])
    assert out == [("decode", 1000, 10), ("measure", 1010, 20)]


def test_files_are_tried_three_times():
    m = states.files(60)
    told = lambda *cs, until=None: [(r[1], r[2], r[3]) for r in m.run(m.first, [change(m, *c) for c in cs], until)[1]]
    assert told((0, "found", None), (1, "found", None), (2, "taken", None), (3, "decoded", None), (4, "saved", None), (5, "taken", None)) == [("pending", 0, None), ("decoding", 0, None), ("analyzing", 0, None), ("done", 0, None)]
    tries = [c for k in range(5) for c in ((10 * k + 1, "taken", None), (10 * k + 2, "failed", "no"))]
    assert told((0, "found", None), *tries) == [("pending", 0, None), *[x for k in (1, 2, 3) for x in (("decoding", k - 1, None), ("failed", k, "no"))]]
    assert told((0, "found", None), (1, "taken", None), (2, "unreadable", "bad"), (3, "taken", None)) == [("pending", 0, None), ("decoding", 0, None), ("unsupported", 1, "bad")]
    assert told((0, "found", None), (1, "taken", None), (100, "decoded", None), (101, "taken", None)) == [("pending", 0, None), ("decoding", 0, None), ("failed", 1, "timeout"), ("decoding", 1, None)]
    assert told((0, "found", None), (1, "taken", None), until=60) == [("pending", 0, None), ("decoding", 0, None)]
    assert told((0, "found", None), (1, "taken", None), until=61)[-1] == ("failed", 1, "timeout")


def test_stuck_jobs_come_back_by_themselves(spark, tmp_path):
    """A timer, not a further change of the file, ends a job that hangs."""
    base = pd.Timestamp("2024-05-01")
    at = lambda h: (base + pd.Timedelta(hours=h)).to_pydatetime()
    rows = [("f", 1, at(0), "found", None), ("f", 2, at(1), "taken", None), ("g", 3, at(2), "found", None), ("g", 4, at(30), "taken", None)]
    states.ready(spark)
    stream = cut(spark, tmp_path / "in", rows, "id string, number long, at timestamp, kind string, message string", 4)
    got = plays.run_once(states.followed(stream, "id", "at", "number", states.files())).collect()
    assert sorted((r.id, r.status, r.attempts) for r in got) == [("f", "decoding", 0), ("f", "failed", 1), ("f", "pending", 0), ("g", "pending", 0)]


class Session:
    """A plain loop over a player's changes."""

    def __init__(self):
        self.playing, self.place, self.plan, self.held, self.handed, self.short = None, None, [], [], [], False

    def need(self):
        rest = len(self.held) - self.held.index(self.place) - 1 if self.place in self.held else len(self.held)
        return 2 - rest

    def give(self, n):
        out, self.plan = self.plan[:n], self.plan[n:]
        self.held += out
        self.handed += out
        return out

    def take(self, kind, track, ids):
        played, given = None, []
        if kind == "holds":
            self.held, self.handed = list(ids), []
        elif kind == "planned":
            self.plan = [i for i in ids if i not in self.held][:20]
            if self.short and self.need() > 0:
                given = self.give(self.need())
            self.short = False
        else:
            if track is not None and track != self.playing:
                self.playing = played = track
                if track in self.handed:
                    del self.handed[: self.handed.index(track) + 1]
            self.place, self.short = track, False
            if self.need() > 0:
                if len(self.plan) < self.need():
                    self.short = True
                else:
                    given = self.give(self.need())
        return played, given, self.short, self.handed + self.plan


def test_queue_against_a_plain_loop():
    rng = random.Random(11)
    m = states.QUEUE
    for _ in range(200):
        loop, now = Session(), m.first
        for i in range(40):
            kind = rng.choice(["holds", "planned", "planned", "moved", "moved", "moved", "moved"])
            track, ids = rng.choice([None, *"abcdefgh"]), [rng.choice("abcdefgh") for _ in range(rng.randint(0, 5))]
            now, out = m.run(now, [change(m, i, kind, track, ids)])
            assert out[0][2:] == loop.take(kind, track, ids)


def test_a_made_session():
    m = states.QUEUE
    steps = [("holds", None, []), ("moved", None, None), ("planned", None, list("abcdefg")), ("moved", "a", None), ("moved", "b", None), ("moved", "b", None), ("planned", None, list("xbyz")), ("moved", "d", None)]
    _, out = m.run(m.first, [change(m, i, *s) for i, s in enumerate(steps)])
    assert [(r[2], r[3], r[4]) for r in out] == [(None, [], False), (None, [], True), (None, ["a", "b"], False), ("a", ["c"], False), ("b", ["d"], False), (None, [], False), (None, [], False), ("d", ["x", "y"], False)]
    assert out[-1][5] == ["x", "y", "z"]
