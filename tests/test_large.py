"""What shows only in large tables."""

import base64
import random
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from soundlake.functions import names, scores
from soundlake.operators import identity, wants
from soundlake.plans import queue
from soundlake.queries import catalog
from soundlake.streaming import plays


def test_on_a_beat_the_next_is_a_period_away(spark):
    """The remainder of -100.4 by 0.4 falls short of a whole period by the last bits."""
    df = spark.createDataFrame([(0.4, 200.4), (0.5, 200.0), (0.5, 200.2)], "period double, beat double")
    got = [r.left for r in df.select(scores.until_beat(F.col("beat"), F.col("period"), F.lit(100)).alias("left")).collect()]
    assert [round(x, 9) for x in got] == [0.4, 0.5, 0.2]


def test_a_shape_code_beside_a_count_beyond_its_digits(spark, monkeypatch):
    tracks = spark.range(64**3 + 5).select(F.lit(True).alias("analysed"), F.lit(100.0).alias("bpm"), F.lit(0.9).alias("bpm_confidence"), F.lit(0).alias("key_root"), F.lit("major").alias("key_scale"), F.lit(0.9).alias("key_strength"), F.lit(1.0).alias("duration_sec"))
    monkeypatch.setattr(catalog.R, "tracks", lambda *_: tracks)
    got = catalog.QUERIES["shape_code"](spark, "").first()
    assert got.analysed == 64**3 + 5 and got.code.startswith("S1AAF")


def test_a_queue_of_the_cheapest_of_all(spark):
    """Of 2,100 recordings all are near in tempo and far in energy, but for one that is the other way round, its tempo unsure."""
    rows = [(f"t{i:04}", f"a{i}", "done", True, 100.0, 1.0, 0, "major", 0.9, 0.0, 0.5, 0.5) for i in range(2_100)]
    rows[7] = (*rows[7][:4], 150.0, 0.0, *rows[7][6:9], 0.9, *rows[7][10:])
    t = spark.createDataFrame(rows, "id string, artist string, status string, analysed boolean, bpm double, bpm_confidence double, key_root int, key_scale string, key_strength double, energy double, brightness double, danceability double")
    weights = scores.Weights(bpm=0.1, key=0.1, energy=0.6, timbre=0.1, novelty=0.1)
    plan = lambda **how: queue.plan_queue(t, "t0000", 1, weights=weights, start_energy=0.9, shape="flat", **how).first().id
    for pool in (1, queue.POOL):
        assert plan(near_first=False, pool=pool) == "t0007" and plan(pool=pool) == "t0001"


def test_blocks_in_single_precision_lose_nothing():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, 256, (120, 720)).astype(float) for _ in "ab")
    b[:30] = np.clip(a[50:80] + rng.normal(0, 1, (30, 720)) * np.linspace(0, 90, 30)[:, None], 0, 255).round()
    a[5], b[6], a[8, :240], a[11] = 7, 9, 3, np.nan  # nothing varies, in all or in one segment; no fingerprint
    b[9], b[40] = a[8], np.roll(a[30].reshape(3, 20, 12), 2, axis=1).ravel()
    a, b = (x.reshape(-1, 3, 20, 12) for x in (a, b))
    far = identity._distances(a, b)
    able = rng.random(far.shape) < 0.9
    for threshold in (0.12, 0.4, 1.1):
        i, j, d = identity._near(a, b, threshold, able)
        with np.errstate(invalid="ignore"):
            want = np.nonzero(able & (far <= threshold))
        assert np.array_equal(i, want[0]) and np.array_equal(j, want[1]) and np.abs(d - far[want]).max() < 1e-12


def test_only_ticks_that_are_due_reach_the_states(spark, tmp_path):
    schema = "player string, seq long, track_id string, elapsed_sec double, duration_sec double, sound_end_sec double, fade_sec double, joined boolean, has_next boolean"
    rows = [(p, n, "t", 51.0 if n == 3 and p == "p" else 1.0, 54.0, None, 4.0, False, True) for n in range(9) for p in "pq"]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "t"))
    moves = plays.moves(spark.readStream.schema(schema).parquet(str(tmp_path / "t")))
    assert "due#" not in moves._jdf.queryExecution().analyzed().toString()
    assert [tuple(r) for r in plays.run_once(moves).collect()] == [("p", "t", 51.0)]


def test_names_are_folded_without_python(spark):
    """Every stage that folds names had Python workers of a hundred MB each, idle ones included."""
    folds = ["Café", "ĐỆ", "Ångström ﬁ", "강남", "Й Ё", "plain", None]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(folds)], "i int, s string").repartition(2).select("i", names.fold(F.col("s")).alias("f"))
    want = [None if s is None else "".join(c for c in unicodedata.normalize("NFD", s) if not "̀" <= c <= "ͯ").lower() for s in folds]
    assert [r.f for r in df.orderBy("i").collect()] == want
    tracks = spark.createDataFrame([("t1", "Björk", "Jóga"), ("t2", "Beyonce", "Halo")], "id string, artist string, title string")
    wanted = spark.createDataFrame([(1, "Bjork", "Joga"), (2, "Someone, Beyoncé", "Halo"), (3, None, "halo")], "ord int, artist string, title string")
    found = wants.match_wants(wanted, tracks)
    assert sorted((r.ord, r.id) for r in found.collect()) == [(1, "t1"), (2, "t2"), (3, "t2")]
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()


def _written(spark):
    """Bytes that all stages so far wrote for shuffles."""
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_recordings_are_sent_about_twice(spark):
    """Three full slots of length side by side: a recording went to every block around its own, on both sides."""
    rng = random.Random(7)
    rows = [(f"{i:05}", 150 + i % 90 / 20, base64.urlsafe_b64encode(rng.randbytes(720)).decode()) for i in range(6_000)]
    rows += [(f"x{i:04}", rows[i][1] + 1.5, rows[i][2]) for i in range(0, 6_000, 100)]
    df = spark.createDataFrame(rows, "id string, duration_sec double, fingerprint string").cache()
    df.count()
    before = _written(spark)
    got = {(r.a_id, r.b_id) for r in identity.duplicate_pairs(df).collect()}
    assert got == {(f"{i:05}", f"x{i:04}") for i in range(0, 6_000, 100)}
    assert (_written(spark) - before) / len(rows) < 4_500


@pytest.mark.parametrize("threshold", [0.12, 0.3, 0.4])
def test_pairs_of_what_is_held_and_what_passes_by(monkeypatch, threshold):
    """Blocks of 8 in batches of 7, so that groups are cut anywhere; some alike, some without anything that varies in a segment or at all."""
    monkeypatch.setattr(identity, "BLOCK", 8)
    monkeypatch.setattr(identity, "PASSING", 16)
    rng = np.random.default_rng(4)
    cells = rng.integers(0, 256, (150, 3, 20, 12))
    for i in range(0, 150, 3):  # copies with noise, some far off
        cells[i] = np.clip(cells[rng.integers(150)] + rng.normal(0, 1, cells[i].shape) * i / 2, 0, 255).round()
    cells[60:110] = np.clip(cells[60] + rng.normal(0, 9, cells[60:110].shape), 0, 255).round()
    cells[[5, 17, 140]], cells[[8, 30, 100], 1], cells[[9, 31], 0], cells[12, 1, 1:] = 7, 3, 2, cells[12, 1, 1]
    secs, prints = np.sort(rng.integers(0, 90, 150) / 20), cells.astype(np.uint8)
    far = identity._distances(prints.astype(float), prints.astype(float))
    with np.errstate(invalid="ignore"):
        near = (far <= threshold) & (np.abs(secs[:, None] - secs) <= 1.5)
    names_ = [f"{i * 7 % 150:03}" for i in range(150)]
    for once in (True, False):
        rows = []
        for i in range(150):
            slot = int(secs[i] // 1.5)
            for way in (0, -1) if once else (0, -1, 1):
                rows += [(slot + way, part, 1, secs[i], i) for part in (0, 1) if way or not once or part < i % 2]
            rows.append((slot, i % 2, 0, secs[i], i))
        slots, parts, passes, sec, at = zip(*sorted(rows))
        table = pa.table({"slot": slots, "part": parts, "passes": pa.array(passes, pa.int32()), "id": [names_[i] for i in at], "sec": sec, "print": [prints[i].tobytes() for i in at]})
        got = [(r["a_id"], r["b_id"], r["distance"]) for b in identity._compare(1.5, threshold, once)(iter(table.to_batches(max_chunksize=7))) for r in b.to_pylist()]
        want = {(names_[i], names_[j]): far[i, j] for i, j in zip(*np.nonzero(near)) if not once or names_[i] < names_[j]}
        assert len(got) == len(want) and all(abs(want[a, b] - d) < 1e-12 for a, b, d in got)


def test_lengths_that_are_no_numbers_are_near_none(spark):
    text = base64.urlsafe_b64encode(random.Random(8).randbytes(720)).decode()
    rows = [(f"{n}{k}", sec, text) for n, sec in enumerate((float("nan"), float("inf"), 1e300, 100.0)) for k in "ab"]
    got = identity.duplicate_pairs(spark.createDataFrame(rows, "id string, duration_sec double, fingerprint string")).collect()
    assert sorted(map(tuple, got)) == [("2a", "2b", 0.0), ("3a", "3b", 0.0)]


@pytest.mark.parametrize("query", ["duplicate_groups", "duplicate_verdicts"])
def test_recordings_are_read_once(spark, query):
    """They were written whole, or made again, for each step."""
    read = spark.sparkContext.accumulator(0)

    @F.pandas_udf("string")
    def told(texts: pd.Series) -> pd.Series:
        read.add(len(texts))
        return texts

    rng = random.Random(9)
    rows = [(f"{i:03}", 100.0, base64.urlsafe_b64encode(rng.randbytes(720)).decode(), float(i % 4), 0.5) for i in range(40)]
    rows += [(f"x{r[0]}", *r[1:3], 9.0, 0.5) for r in rows[:10]]
    df = spark.createDataFrame(rows, "id string, duration_sec double, fingerprint string, loudness_db double, compression double").withColumn("fingerprint", told("fingerprint"))
    got = getattr(identity, query)(df).collect()
    assert len({r.group_id for r in got}) == 10 and read.value == len(rows)


def test_texts_that_are_no_fingerprints_are_like_none(spark):
    good = base64.urlsafe_b64encode(random.Random(10).randbytes(720)).decode()
    texts = [good, good, good[:-1] + "\n", good[:-1] + "\n", good[:-1] + "=", good[:-1] + "é", good + "A", good[:-4], "", None]
    df = spark.createDataFrame([(i, 100, t) for i, t in enumerate(texts)], "id long, duration_sec int, fingerprint string")
    assert [tuple(r) for r in identity.duplicate_pairs(df).collect()] == [(0, 1, 0.0)]
