"""Rules that no query shows: long chains, nulls, imports, orders, names accepted, changes and job marks."""

import pytest
from pyspark.sql import functions as F

from soundlake.functions import codes, keys, scores
from soundlake.operators import catalogue, compare, health, history, identity, merge, shape, statistics, wants
from soundlake.sources import files


def test_islands_of_long_chains(spark):
    held = "1A 2A 3A 3B 4B 5B 5A 6A 7A 7B 8B 9B 9A 10A 11A".split()
    place = {f"{p // 2 + 1}{'AB'[p % 2]}": p for p in range(24)}
    of = {r.p: (r.root, r.scale) for r in spark.range(12).crossJoin(spark.createDataFrame([("major",), ("minor",)], "scale string")).select(F.col("id").cast("int").alias("root"), "scale", keys.place(F.col("id").cast("int"), F.col("scale")).alias("p")).collect()}
    rows = [(*of[place[c]], 0.9, True) for c in held]
    t = spark.createDataFrame(rows, "key_root int, key_scale string, key_strength double, analysed boolean")
    assert [(r.ord, r.n) for r in shape.key_islands(t).collect()] == [(0, 15)]
    apart = spark.createDataFrame([(*of[place[c]], 0.9, True) for c in ("1A", "3A", "3A")], t.schema)
    assert [(r.island, r.n) for r in shape.key_islands(apart).orderBy("ord").collect()] == [("3A", 2), ("1A", 1)]
    assert [r.camelot for r in shape.key_bridges(apart).collect()] == ["2A"]


def test_unknown_confidence_is_none(spark):
    got = spark.range(1).select(scores.clamp(F.lit(None).cast("double")).alias("a"), scores.key_reliability(F.lit(None).cast("double")).alias("b"), scores.surer(F.lit(0.9), F.lit(None).cast("double")).alias("c"), scores.clamp(F.lit(float("nan"))).alias("d")).first()
    assert tuple(got) == (0, 0, 0, 0)


def test_imports_keep_the_local_row(spark):
    schema = "id string, rel_path string, artist string, given_title string, analysed boolean, version int, bpm double, duration_sec double, status string, attempts int"
    old = spark.createDataFrame([("a", "here/a", "A", "given", True, 5, 100.0, 9.0, "done", 1), ("b", "here/b", "B", None, None, None, None, 3.0, "pending", 0), ("c", "here/c", "C", None, True, 6, 90.0, 1.0, "done", 0)], schema)
    new = spark.createDataFrame([("a", "there/a", "X", None, True, 6, 120.0, None, "done", 2), ("b", "there/b", "X", None, True, 6, 80.0, 4.0, "done", 0), ("c", "there/c", "X", None, True, 6, 1.0, 1.0, "done", 0), ("d", "there/d", "D", None, True, 5, 70.0, 2.0, "done", 0), ("d", "there/d2", "D", None, True, 6, 71.0, 2.0, "done", 0)], schema)
    got = {r.id: tuple(r)[1:] for r in merge.merged(old, new).collect()}
    assert got == {
        "a": ("here/a", "A", "given", True, 6, 120.0, 9.0, "done", 2),
        "b": ("here/b", "B", None, True, 6, 80.0, 4.0, "done", 0),
        "c": ("here/c", "C", None, True, 6, 90.0, 1.0, "done", 0),
        "d": ("there/d2", "D", None, True, 6, 71.0, 2.0, "done", 0),
    }
    assert sorted(r.action for r in merge.import_actions(old, new).collect()) == ["added", "added", "improved", "improved", "unchanged"]


def test_failures_without_message(spark):
    t = spark.createDataFrame([("a", "done", 0, None), ("b", "pending", None, "old")], "id string, status string, attempts int, error string")
    f = spark.createDataFrame([("b", None, False)], "id string, message string, retryable boolean")
    assert {tuple(r) for r in merge.with_failures(t, f).collect()} == {("a", "done", 0, None), ("b", "unsupported", 1, None)}
    assert [r.a for r in spark.createDataFrame([("algorithm", 2), ("algorithm", 3), ("decode", 0)], "c string, n int").select(merge.retryable(F.col("c"), F.col("n")).alias("a")).collect()] == [True, False, False]


def test_order_of_reports(spark):
    g = spark.createDataFrame([("b", "a", 0.1), ("a", "a", 0.1), ("d", "c", 0.05), ("c", "c", 0.05)], "id string, group_id string, distance double")
    age = spark.createDataFrame([("a", 9), ("b", 1), ("c", 3), ("d", 4)], "id string, last_modified long")
    assert [r.id for r in identity.listed_groups(g, age).collect()] == ["c", "d", "b", "a"]
    p = spark.createDataFrame([("a", "path", None), ("b", "sound", 0.1), ("c", "path", None), ("d", "sound", 0.01)], "id string, source string, distance double")
    t = spark.createDataFrame([("a", "z.mp3"), ("b", "a.mp3"), ("c", "B.mp3"), ("d", "q.mp3")], "id string, file_name string")
    assert [r.id for r in identity.listed_proposals(p, t).collect()] == ["d", "b", "c", "a"]
    counts = identity.accepted_counts(p).first()
    assert (counts.by_sound, counts.by_path) == (2, 2)


def test_accepted_and_given_names(spark):
    kind = "id string, artist string, title string, album string, track_no int"
    given = spark.createDataFrame([("a", "A", "old", None, 1)], kind)
    new = spark.createDataFrame([("a", None, "new", None, None), ("b", "B", None, None, None)], kind)
    assert {tuple(r) for r in identity.accepted(given, new).collect()} == {("a", "A", "new", None, 1), ("b", "B", None, None, None)}
    t = spark.createDataFrame([("a", " ", None, "Tag", 7), ("b", "Own", "T", None, None)], kind)
    got = {tuple(r) for r in identity.with_given(t, identity.accepted(given, new)).collect()}
    assert got == {("a", "A", "new", "Tag", 7), ("b", "Own", "T", None, None)}
    named = merge.forget_names(t.withColumn("given_title", F.lit("x")))
    assert {r.given_title for r in named.collect()} == {None}
    assert [r.id for r in merge.lookup(t, ["b", "none", "a"]).collect()] == ["b", "a"]


def test_changes_and_marks(spark):
    e = spark.createDataFrame([(1, "x", 10), (2, "x", 20), (3, "y", 30), (4, None, 35), (5, "x", 40), (6, "x", 50)], "event_id long, track_id string, played_at long")
    assert [r.event_id for r in history.without_repeats(e.withColumn("who", F.lit(1)), "who").orderBy("event_id").collect()] == [1, 3, 5]
    m = [(1, "decode", "stage", 0), (1, "measure", "stage", 5), (1, None, "done", 30), (2, "decode", "stage", 3), (3, "decode", "stage", 0), (3, None, "failed", 400), (3, "decode", "stage", 1000), (3, None, "done", 1010)]
    times = history.job_times(spark.createDataFrame([(*r, i) for i, r in enumerate(m)], "job long, stage string, kind string, at long, number long"))
    assert sorted((r.job, r.stage, r.ms) for r in times.collect()) == [(1, "decode", 5), (1, "measure", 25), (3, "decode", 10)]
    assert [(r.stage, r.n, r.mean_ms) for r in history.stage_times(times).collect()] == [("measure", 1, 25), ("decode", 2, 7.5)]
    f = spark.createDataFrame([(i, i * 10) for i in range(30)], "id long, at long")
    assert [r.id for r in history.last_failures(f, 3).collect()] == [29, 28, 27]


def test_seed_counts_as_recent(spark):
    t = spark.createDataFrame([(str(i), f"A{i}", f"B{i}", True) for i in range(20)], "id string, artist string, album string, analysed boolean")
    plays = spark.createDataFrame([(i, str(i), 1_700_000_000 + i * 60) for i in range(1, 15)] + [(0, "19", 1_600_000_000)], "event_id long, track_id string, s long").select("event_id", "track_id", F.timestamp_seconds("s").alias("played_at"))
    names = [r.name for r in history.recent_names(plays, t, "artist", "0").orderBy("ord").collect()]
    assert names == ["A0"] + [f"A{i}" for i in range(1, 10)]
    c = {r.id: r for r in history.context(plays, t, seed_id="0").collect()}
    assert c["0"].recent_artist and not c["0"].recent and c["9"].recent_album and not c["10"].recent_artist and c["10"].recent and c["19"].frequency == 1


def test_starts_and_sliders(spark):
    got = spark.createDataFrame([(10.0, 0.5, 60.0), (10.0, 0.0, 60.0), (10.0, None, 60.0), (10.0, 0.5, 10.2), (10.0, 0.5, None)], "at double, skip double, d double").select(scores.aligned_start(F.col("at"), F.col("skip"), F.col("d")).alias("s")).collect()
    assert [r.s for r in got] == [10.5, None, None, None, 10.5]


def test_names_given_and_proposed_are_matched(spark):
    kind = "id string, artist string, title string"
    t = spark.createDataFrame([("1", None, None), ("2", "Beyoncé", "Halo"), ("3", None, "Only"), ("4", "X", "Twice"), ("5", "Y", "Twice")], kind)
    given = spark.createDataFrame([("1", "Abba", "Gold", "sound")], kind + ", source string")
    asked = spark.createDataFrame([(0, "ABBA", "gold"), (1, "beyonce", "Halo (Remastered 2009)"), (2, None, "only"), (3, None, "Twice"), (4, "Nobody; Y", "twice")], "ord long, artist string, title string")
    got = {r.ord: (r.id, r.via) for r in wants.match_wants(asked, t, given).collect()}
    assert got == {0: ("1", "sound"), 1: ("2", "tags"), 2: ("3", "tags"), 3: (None, None), 4: ("5", "tags")}


def test_blind_spots_and_growth(spark):
    t = spark.createDataFrame([(True, 6, None, 0.0), (True, 6, 0.2, 0.1), (False, 0, None, None)], "analysed boolean, version int, side_ratio double, clipped_ratio double")
    got = health.blind_spots(t).first()
    assert got.mono_files and got.one_channel_faults and got.resampled_clipping
    assert spark.createDataFrame([("http://x/?vibe=1ffffffffff0",), ("http://x/",)], "u string").select(codes.vibe_from_url(F.col("u"))["curve"].alias("c")).collect()[0].c == "flat"
    mine, theirs = (compare.own_shape(spark.createDataFrame([(True, 0.9, b, 0, "major", 0.9, 1.0)], "analysed boolean, bpm_confidence double, bpm double, key_root int, key_scale string, key_strength double, duration_sec double")) for b in (100.0, 150.0))
    assert [r.finding for r in compare.findings(mine, theirs).orderBy("ord").collect()] == ["Their 1 against your 1: 0% of the tempo curve is shared, and 100% of the wheel.", "There is no tempo you are both at home in.", "100% of theirs is between 150 and 160 BPM, where you have next to nothing."]


def test_long_titles_in_playlists(spark):
    text = "#EXTM3U\n#EXTINF:12,A - " + "b" * 20_000 + "\nx.mp3\n"
    got = files.wants_from_m3u(spark.createDataFrame([(1, text)], "list_id int, text string")).first()
    assert got.artist == "A" and got.title == "b" * 20_000


def test_full_slots(spark):
    """All recordings in one slot of length, more than a block holds."""
    import base64
    import random

    rng = random.Random(6)
    rows = [(f"{i:05}", 100.0, base64.urlsafe_b64encode(rng.randbytes(720)).decode()) for i in range(1_500)]
    rows += [(f"x{i:04}", 100.5, rows[i][2]) for i in range(0, 1_500, 100)]
    got = identity.duplicate_pairs(spark.createDataFrame(rows, "id string, duration_sec double, fingerprint string")).collect()
    assert {(r.a_id, r.b_id) for r in got} == {(f"{i:05}", f"x{i:04}") for i in range(0, 1_500, 100)}


def test_wants_of_an_artist_in_a_lesser_island(spark):
    rows = [(str(i), "Big", f"t{i}", 0, "major", 0.9, True, 100.0, 0.9) for i in range(3)] + [("9", "Small", "t", 6, "major", 0.9, True, 120.0, 0.9)]
    t = spark.createDataFrame(rows, "id string, artist string, title string, key_root int, key_scale string, key_strength double, analysed boolean, bpm double, bpm_confidence double")
    asked = spark.createDataFrame([(0, "small", "none"), (1, "big", "none"), (2, "Big", "t1")], "ord long, artist string, title string")
    got = {r.ord: r for r in wants.with_notes(wants.match_wants(asked, t), t).collect()}
    assert (got[0].owned, got[0].median_bpm, got[0].island_n) == (1, 120, 1) and got[1].owned == 3 and got[1].island_n is None and got[2].owned is None


@pytest.mark.parametrize("count", [49, 50])
def test_provisional_below_fifty(spark, count):
    t = spark.range(count).select(F.lit(True).alias("analysed"), (F.col("id") / 100).alias("loudness"), F.lit(1000.0).alias("brightness_hz"), F.lit(5.0).alias("crest"), F.lit(0.5).alias("dance_raw"))
    assert {r.provisional for r in statistics.rerank(t).collect()} == {count < 50}


def test_settings_and_names(spark):
    s = spark.createDataFrame([("a", "1"), ("b", None)], "key string, value string")
    s = catalogue.write_setting(catalogue.write_setting(s, "a", "2"), "c", "3")
    assert [catalogue.read_setting(s, k, "d") for k in "abcx"] == ["2", None, "3", "d"] and s.count() == 3
    t = spark.createDataFrame([("1", "A", "Song", "x.mp3", True), ("2", "A", "Song", "y.mp3", True), ("3", None, None, "z.w.mp3", True), ("4", "B", "No", "q.mp3", False)], "id string, artist string, title string, file_name string, analysed boolean")
    named = catalogue.labels(t)
    assert {r.id: r.label for r in named.collect()} == {"1": "A - Song", "2": "A - Song (y.mp3)", "3": "z.w"}
    asked = spark.createDataFrame([(0, "A - Song"), (1, "song"), (2, "Z."), (3, " ")], "ord long, text string")
    assert {r.ord: r.id for r in catalogue.find(named, asked).collect()} == {0: "1", 1: None, 2: "3", 3: None}
    assert [r.id for r in catalogue.shown(named, "SONG").collect()] == ["1", "2"]


def test_changes_of_status(spark):
    t = spark.createDataFrame([("a", "pending", "old"), ("b", "pending", None), ("c", "done", None)], "id string, status string, error string")
    c = spark.createDataFrame([("a", "decoding", None), ("c", "failed", "why")], "id string, status string, message string")
    assert {tuple(r) for r in merge.with_status(t, c).collect()} == {("a", "decoding", None), ("b", "pending", None), ("c", "failed", "why")}
    assert [r.id for r in merge.waiting(t, spark.createDataFrame([("a",)], "id string"), 5).collect()] == ["b"]
