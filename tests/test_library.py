"""Lists, files, merges, fingerprints, kernels and streams on small made cases."""

import base64
import itertools
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from soundlake.functions import codes, keys, names, scores
from soundlake.operators import health, identity, merge, recordings, shape, signals, statistics, wants
from soundlake.plans import queue
from soundlake.sources import audio, files
from soundlake.streaming import analysis
from soundlake.streaming import plays as streams


def test_m3u_remarks_and_lengths(spark):
    text = "#EXTM3U\r\n#EXTINF:-1,A - B\n# a remark\nx/y.mp3\n\nz.mp3\n#EXTINF:210.4,C, D\n#EXTINF:5,E\nq.mp3\n"
    got = files.parse_m3u(spark.createDataFrame([("l", text), ("e", ""), ("n", None)], "list_id string, text string")).orderBy("ord").collect()
    assert [(r.ord, r.path, r.title, r.length_sec) for r in got] == [(0, "x/y.mp3", "A - B", None), (1, "z.mp3", None, None), (2, "q.mp3", "E", 5.0)]


def test_want_lists(spark, tmp_path):
    t = spark.createDataFrame([("l", "Artist – Title\n\n# no\nJust a title\n")], "list_id string, text string")
    assert [(r.artist, r.title) for r in files.wants_from_lines(t).orderBy("ord").collect()] == [("Artist", "Title"), (None, "Just a title")]
    p = tmp_path / "w.csv"
    p.write_text('Track Name,"Artist Name(s)"\n"One, ""two""","A,B"\n"three\nlines",C\n,D\n')
    got = files.wants_from_csv(spark, str(p)).collect()
    assert [(r.artist, r.title) for r in got] == [("A", 'One, "two"'), ("C", "three\nlines")]
    kinds = spark.createDataFrame([("#EXTM3U\na",), ("Title,Artist\nx,y",), ("a, b - c",), ("",)], "t string").select(files.kind_of_list(F.col("t")).alias("k"))
    assert [r.k for r in kinds.collect()] == ["m3u", "csv", "lines", "lines"]


def test_scan_and_export(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "b" / "x.MP3").write_bytes(b"abc")
    (tmp_path / "a" / "note.txt").write_text("no")
    (r,) = files.scan_folder(spark, str(tmp_path)).collect()
    import hashlib

    assert (r.id, r.rel_path, r.size) == (hashlib.sha256(b"abc:3").hexdigest(), "a/b/x.MP3", 3)
    tracks = spark.createDataFrame([("1", 2.5, None)], "id string, bpm double, artist string")
    plays = spark.createDataFrame([("1", None, 3.0)], "track_id string, played_at timestamp, played_sec double")
    rows = files.export_rows(tracks, plays)
    t, p = files.import_rows(rows, tracks._jdf.schema().toDDL())
    assert t.collect() == tracks.collect() and p.count() == 1
    with pytest.raises(ValueError):
        files.import_rows(rows.where("kind <> 'head'"), "id string")


def test_names(spark):
    cases = {"Björk & Friends (feat. X)": "bjork and friends", "Song (2011 Remaster)": "song", "Dancing with Myself": "dancing", "Don’t": "dont", "": ""}
    got = spark.createDataFrame([(k,) for k in cases], "s string").select("s", names.fold(F.col("s")).alias("f")).collect()
    assert {r.s: r.f for r in got} == cases


def test_codes_round_trip(spark):
    rng = random.Random(1)
    rows = [([rng.randrange(256) for _ in range(38)], rng.randrange(64**3)) for _ in range(20)]
    df = spark.createDataFrame(rows, "b array<int>, n int")
    got = df.select("b", "n", codes.bytes_to_text(F.col("b"), 38).alias("t"), codes.number_to_text(F.col("n"), 3).alias("m"))
    got = got.select("*", codes.text_to_bytes(F.col("t"), 38).alias("b2"), codes.text_to_number(F.col("m"), 3).alias("n2")).collect()
    for r in got:
        assert r.b == r.b2 and r.n == r.n2 and len(r.t) == 52
        assert r.t == base64.urlsafe_b64encode(bytes(r.b) + b"\0").decode()


def test_keys(spark):
    got = spark.createDataFrame([(0, "major"), (9, "minor")], "r int, s string").select(keys.code(keys.place(F.col("r"), F.col("s"))).alias("c")).collect()
    assert [r.c for r in got] == ["8B", "8A"]


def _print(rng, base=None, noise=0):
    v = [rng.randrange(256) for _ in range(720)] if base is None else [min(255, max(0, x + rng.randint(-noise, noise))) for x in base]
    return v, base64.urlsafe_b64encode(bytes(v)).decode()


def test_duplicates_against_all_pairs(spark):
    rng = random.Random(3)
    rows = []
    for g in range(12):
        base, _ = _print(rng)
        for c in range(rng.choice((1, 1, 3))):
            rows.append((f"{g:02}{c}", 100.0 + g * 0.9 + c * 0.2, _print(rng, base, rng.choice((0, 20)))[1]))
    rows += [("n1", None, rows[0][2]), ("n2", 100.0, None), ("bad", 100.0, "x")]
    df = spark.createDataFrame(rows, "id string, duration_sec double, fingerprint string")

    def distance(a, b):
        a, b = (np.frombuffer(base64.urlsafe_b64decode(x), np.uint8).reshape(3, 20, 12).astype(float) for x in (a, b))
        best = []
        for s in range(3):
            rs = []
            for lag in range(-3, 4):
                x, y = a[s, max(0, -lag) : 20 - max(0, lag)], b[s, max(0, lag) : 20 + min(0, lag)]
                x, y = x - x.mean(0), y - y.mean(0)
                rs.append((x * y).sum() / np.sqrt((x * x).sum() * (y * y).sum()))
            best.append(max(rs))
        return 1 - sum(best) / 3

    good = [r for r in rows if r[1] is not None and r[2] and len(r[2]) == 960]
    want = {tuple(sorted((a[0], b[0]))) for a, b in itertools.combinations(good, 2) if abs(a[1] - b[1]) <= 1.5 and distance(a[2], b[2]) <= 0.12}
    assert want and {(r.a_id, r.b_id) for r in identity.duplicate_pairs(df).collect()} == want
    groups = {r.id: r.group_id for r in identity.duplicate_groups(df).collect()}
    assert set(groups) == {x for p in want for x in p} and all(groups[a] == groups[b] for a, b in want)
    assert identity.duplicate_groups(df.where("false")).count() == 0


def test_verdicts_against_all_pairs(spark):
    rng = random.Random(5)
    prints = []
    for _ in range(30):  # every second one sounds like the one before
        base, text = _print(rng)
        prints += [text, _print(rng, base, 10)[1]]
    rows = []
    for g, text in enumerate(prints):
        for _ in range(rng.choice((1, 2, 3, 4))):
            rows.append((f"{rng.random():.12f}", 100.0 + g // 2 * 4 + g % 2, text, rng.choice((0.0, 2.0, -2.0, None, float("nan"), -float("inf"))) if g < 30 else rng.choice((0.0, 1.0, 2.0)), 0.5 + rng.choice((0, 0.1, -0.1)) * (g > 45)))
    three = _print(rng)[1]
    rows += [(f"x{i}", 900.0, three, db, 0.5) for i, db in enumerate((0.0, 2.0, -2.0))]
    df = spark.createDataFrame(rows, "id string, duration_sec double, fingerprint string, loudness_db double, compression double")
    want = {}
    for key in {int(r[1] // 4) for r in rows}:
        group = [r for r in rows if r[1] // 4 == key]
        differ = any((a[3] is not None and b[3] is not None and abs(a[3] - b[3]) > 2.5) or abs(a[4] - b[4]) > 0.12 for a, b in itertools.combinations(group, 2))
        if len(group) > 1:
            want[min(r[0] for r in group)] = (len(group), "different-master" if differ else "same-master")
    got = {r.group_id: (r.n, r.verdict) for r in identity.duplicate_verdicts(df).collect()}
    assert got == want and got["x0"] == (3, "different-master") and len({v for _, v in want.values()}) == 2
    assert identity.duplicate_verdicts(df.where("false")).count() == 0


def test_merge_and_failures(spark):
    t = spark.createDataFrame([("a", True, 5, "done", 0, None), ("b", False, 0, "pending", 2, None)], "id string, analysed boolean, version int, status string, attempts int, error string")
    new = spark.createDataFrame([("a", True, 6, "done", 0, None), ("b", False, 0, "done", 0, None), ("c", True, 6, "done", 0, None)], t.schema)
    assert {r.id: r.version for r in merge.merged(t, new).collect()} == {"a": 6, "b": 0, "c": 6}
    f = spark.createDataFrame([("b", "no", True)], "id string, message string, retryable boolean")
    assert {(r.id, r.status, r.attempts) for r in merge.with_failures(t, f).collect()} == {("a", "done", 0), ("b", "failed", 3)}


def test_playlist_tiers(spark):
    t = spark.createDataFrame([("1", "m/a/x.mp3", "x.mp3"), ("2", "m/b/y.mp3", "y.mp3"), ("3", "m/c/z.mp3", "z.mp3")], "id string, rel_path string, file_name string")
    e = spark.createDataFrame([(0, "m\\a\\x.mp3"), (1, "b/y.mp3"), (2, "else/z.mp3"), (3, "none.mp3"), (4, "/home/m/b/y%2Emp3")], "pos int, path string")
    got = {r.pos: (r.id, r.tier) for r in wants.match_playlist(e, t).collect()}
    assert got == {0: ("1", "path"), 1: ("2", "suffix"), 2: ("3", "file"), 3: (None, None), 4: ("2", "suffix")}


@pytest.mark.parametrize("bpm", [90, 128])
def test_tempo_of_clicks(bpm):
    rate = 8_000
    x = np.zeros(rate * 20)
    rng = np.random.default_rng(1)
    for at in np.arange(0, 20, 60 / bpm):
        i = int(at * rate)
        x[i : i + 240] += rng.normal(size=len(x[i : i + 240])) * np.linspace(1, 0, len(x[i : i + 240]))
    got, confidence = signals.tempo(*signals.envelope(x, rate))
    assert abs(got - bpm) / bpm < 0.01 and confidence > 0.5
    assert signals.tempo(*signals.envelope(np.zeros(rate * 20), rate)) == (0.0, 0.0)


def test_extraction(spark):
    rate = 16_000
    t = np.arange(rate * 4) / rate
    chord = sum(np.sin(2 * np.pi * 440 * 2 ** ((m - 69) / 12) * t) for m in (60, 64, 67, 72)) / 4
    quiet = np.concatenate([np.zeros(rate), chord, np.zeros(rate)])
    rows = [("chord", rate, quiet.tolist()), ("none", None, None), ("empty", rate, []), ("short", rate, [0.5] * 100), ("rate", 0, [0.5] * 100_000)]
    chunks = recordings.chunked(spark.createDataFrame(rows, "id string, rate int, samples array<double>"), 7_001)
    got = {r.id: r for r in recordings.extract(chunks).collect()}
    c = got["chord"]
    assert {r.id: r.status for r in got.values()} == {"chord": "ok", "none": "bad_input", "empty": "bad_input", "short": "too_short", "rate": "bad_input"}
    assert (c.key.root, c.key.scale) == (0, "major") and abs(c.sound_start_sec - 1) < 0.06 and abs(c.sound_end_sec - 5) < 0.06 and c.cutoff_hz <= 1_000
    level = np.sqrt((quiet**2).mean())
    assert abs(c.rms - level) < 1e-9 and abs(c.crest - np.abs(quiet).max() / level) < 1e-9 and abs(c.loudness_db - 20 * np.log10(level)) < 1e-9
    assert c.head_ratio == c.tail_ratio == c.clipped_ratio == 0 and c.side_ratio is None and c.intro_beat_sec is None
    assert all(got[i].rms is None and got[i].key is None for i in ("none", "short", "rate"))


def test_extraction_by_windows(spark):
    """A recording above 35 seconds is measured in three windows, its tempo in 30 seconds, its ends as they are."""
    rate = 4_000
    rng = np.random.default_rng(4)
    x = rng.normal(size=rate * 60) * 0.05
    at = [(min(round(p * len(x)), len(x) - 10 * rate), 10 * rate) for p in (0.15, 0.5, 0.8)]
    for i, (o, n) in enumerate(at):
        x[o : o + n] = np.sin(np.arange(n) * (i + 1) * 0.1) * (i + 1) / 10
    x[-rate // 4 :] = 0.9
    x[1_000:1_004], x[2_000:2_002] = 1.0, 1.0
    left = recordings.chunked(spark.createDataFrame([("a", rate, x.tolist())], "id string, rate int, samples array<double>"), 1_002)  # cuts the run of four
    right = recordings.chunked(spark.createDataFrame([("a", rate, (x * 0.5).tolist())], "id string, rate int, samples array<double>"), 1_002)
    r = recordings.extract(left, recordings.side_ratios(left, right)).first()
    levels = [np.sqrt((x[o : o + n] ** 2).mean()) for o, n in at]
    joined = np.concatenate([x[o : o + n] for o, n in at])
    assert abs(r.rms - np.mean(levels)) < 1e-9 and abs(r.crest - np.abs(joined).max() / np.sqrt((joined**2).mean())) < 1e-9
    assert abs(r.tail_ratio - np.sqrt((x[-rate // 4 :] ** 2).mean()) / np.mean(levels)) < 1e-9 and abs(r.clipped_ratio - 4 / len(x)) < 1e-12
    assert abs(r.side_ratio - 1 / 3) < 1e-9 and r.fingerprint is None and r.duration_sec == 60
    zcr = [((x[o + 1 : o + n] >= 0) != (x[o : o + n - 1] >= 0)).mean() for o, n in at]
    assert abs(r.zcr - np.mean(zcr)) < 1e-12


def test_wav_files(spark, tmp_path):
    rng = np.random.default_rng(7)
    x = rng.uniform(-1, 1, (5_000, 2))
    (tmp_path / "in").mkdir()
    for bits, kind in ((8, "u1"), (16, "<i2"), (24, None), (32, "<i4")):
        top = 1 << (bits - 1)
        whole = np.round(x * (top - 1)).astype(np.int64)
        body = (whole + 128).astype("u1").tobytes() if bits == 8 else b"".join(int(v).to_bytes(3, "little", signed=True) for v in whole.ravel()) if bits == 24 else whole.astype(kind).tobytes()
        head = struct.pack("<HHIIHH", 1, 2, 16_000, 16_000 * 2 * bits // 8, 2 * bits // 8, bits)
        (tmp_path / "in" / f"{bits}.wav").write_bytes(b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVE" + b"fmt " + struct.pack("<I", 16) + head + b"LIST\x03\0\0\0abc\0" + b"data" + struct.pack("<I", len(body)) + body)
    (tmp_path / "bad.WAV").write_bytes(b"RIFFxxxxWAVE")
    got = audio.read_wav(spark, str(tmp_path), 1_000).cache()
    assert [r.path.endswith("bad.WAV") for r in got.where("error IS NOT NULL").collect()] == [True]
    for bits in (8, 16, 24, 32):
        mine = got.where(F.col("path").endswith(f"/{bits}.wav"))
        rows = mine.where("channel = 1").orderBy("pos").collect()
        assert [r.pos for r in rows] == [0, 1_000, 2_000, 3_000, 4_000] and rows[0].rate == 16_000
        assert np.abs(np.concatenate([r.samples for r in rows]) - x[:, 1]).max() < 2.1 / (1 << (bits - 1))
        mean = np.concatenate([r.samples for r in audio.downmixed(mine).orderBy("pos").collect()])
        assert np.abs(mean - x.mean(axis=1)).max() < 2.1 / (1 << (bits - 1))


def test_analysis_of_arriving_files(spark, tmp_path):
    """Files are measured once, in batches; what comes later is measured by the next run."""
    rate, x = 8_000, np.sin(np.arange(8_000 * 4) * 0.3)

    def put(name, y):
        body = np.round(np.column_stack([y, y / 2]) * 32_767).astype("<i2").tobytes()
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_bytes(b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 2, rate, rate * 4, 4, 16) + b"data" + struct.pack("<I", len(body)) + body)

    def run():
        analysis.analyse(analysis.arriving(spark, str(tmp_path / "in"), 2), str(tmp_path / "out"), str(tmp_path / "marks"))
        return {r.id.rsplit("/", 1)[1]: r for r in analysis.results(spark, str(tmp_path / "out")).collect()}

    put("a.wav", x)
    (tmp_path / "in" / "b.wav").write_bytes(b"no sound")
    put("c.wav", x[:100])
    got = run()
    assert {k: r.status for k, r in got.items()} == {"a.wav": "ok", "b.wav": "undecodable", "c.wav": "too_short"}
    assert abs(got["a.wav"].side_ratio - 1 / 3) < 1e-3 and abs(got["a.wav"].rms - 0.75 * np.sqrt(0.5)) < 1e-2
    put("d.wav", x)
    assert len(run()) == 4


def test_analysis_loop(spark):
    """Pending files are measured, saved and ranked."""
    rate = 8_000
    t = spark.createDataFrame([("a", "pending", False, 0, None, None, None, None, None, None, None), ("b", "pending", False, 0, None, None, None, None, None, None, None), ("c", "done", True, 6, 3.0, 100.0, 0.1, 900.0, 4.0, 0.5, None)], "id string, status string, analysed boolean, version int, duration_sec double, bpm double, loudness double, brightness_hz double, crest double, dance_raw double, error string")
    x = np.sin(np.arange(rate * 5) * 0.3) * 0.25
    sounds = spark.createDataFrame([("a", rate, x.tolist()), ("b", rate, [0.1] * 10)], "id string, rate int, samples array<double>")
    todo = merge.pending(t, 10)
    measured = recordings.extract(recordings.chunked(sounds.join(todo.select("id"), "id", "left_semi")))
    got = {r.id: r for r in merge.with_results(t, measured).collect()}
    assert got["a"].status == "done" and got["a"].version == 6 and got["a"].analysed and abs(got["a"].loudness - np.sqrt((x * x).mean())) < 1e-9 and got["a"].duration_sec == 5
    assert got["b"].status == "unsupported" and got["b"].error == "too_short" and not got["b"].analysed and got["c"].bpm == 100
    assert {r.provisional for r in statistics.rerank(merge.with_results(t, measured)).where("analysed").collect()} == {True}


def test_beats_and_prints(spark):
    rate, bpm = 8_000, 120
    x = np.zeros(rate * 40)
    rng = np.random.default_rng(2)
    for at in np.arange(0.25, 40, 60 / bpm):
        i = int(at * rate)
        x[i : i + 240] += rng.normal(size=len(x[i : i + 240])) * np.linspace(1, 0, len(x[i : i + 240]))
    strength, own, peakiness = signals.envelope(x, rate)
    phase, strong = signals.beat_grid(strength, own, bpm, signals.LEAD_FRAMES * signals.ONSET_FRAME / rate)
    assert abs(phase - 0.25) < 0.03 and strong > 0.4
    assert abs(signals.onset_density(strength, own) - 2) < 0.3
    assert signals.beat_grid(strength, own, 30) is None
    long = rng.normal(size=16_000 * 40)
    rows = [("clicks", rate, x.tolist()), ("noise", 16_000, long.tolist()), ("brief", 16_000, long[:100_000].tolist()), ("thirds", 16_000, long[: 16_000 * 20].tolist())]
    got = {r.id: r for r in recordings.extract(recordings.chunked(spark.createDataFrame(rows, "id string, rate int, samples array<double>"))).collect()}
    first, last = got["clicks"].intro_beat_sec, got["clicks"].outro_beat_sec
    assert abs(got["clicks"].bpm - 120) < 1.2 and abs(first - 0.25) < 0.03 and last > 20 and abs((last - 0.25) % 0.5 - 0.25) > 0.2
    assert len(got["noise"].fingerprint) == len(got["thirds"].fingerprint) == 960 and got["brief"].fingerprint is None
    plans = spark.createDataFrame([(16_000 * 100,), (16_000 * 20,), (16_000,)], "n long").select("n", signals.plan_windows(F.col("n"), F.lit(16_000)).alias("p")).collect()
    got = {r.n: r.p and ([tuple(w) for w in r.p.descriptor], tuple(r.p.tempo)) for r in plans}
    assert got == {1_600_000: ([(240_000, 160_000), (800_000, 160_000), (1_280_000, 160_000)], (400_000, 480_000)), 320_000: ([(0, 320_000)], (0, 320_000)), 16_000: None}


def test_clipped(spark):
    x = [0.0, 1.0, 1.0, 0.2, 1.0, -1.0, 1.0, 1.0, 0.0]
    assert spark.createDataFrame([(x,)], "x array<double>").select(signals.clipped(F.col("x")).alias("c")).first().c == 4 / 9


def plays_of(spark):
    return spark.createDataFrame([(1, "t003", 1_700_000_000)], "event_id long, track_id string, s long").select("event_id", "track_id", F.timestamp_seconds("s").alias("played_at"))


def test_queue_draws_and_routes(spark):
    rng = random.Random(5)
    rows = [(f"t{i:03}", f"a{i % 7}", "done", True, 70.0 + rng.randrange(100), 0.9, rng.randrange(12), rng.choice(("major", "minor")), 0.8, rng.random(), rng.random(), rng.random()) for i in range(80)]
    t = spark.createDataFrame(rows, "id string, artist string, status string, analysed boolean, bpm double, bpm_confidence double, key_root int, key_scale string, key_strength double, energy double, brightness double, danceability double")
    assert queue.is_ready(t)
    got = [r.id for r in queue.plan_queue(t, "t000", 6, random=random.Random(2).random, exclude=["t001"]).collect()]
    assert len(set(got)) == 6 and not {"t000", "t001"} & set(got)
    path = [r.id for r in queue.plan_route(t, "t000", "t079", 4).orderBy("step").collect()]
    assert len(set(path)) == 6 and (path[0], path[-1]) == ("t000", "t079")
    assert queue.plan_route(t, "t000", "t000", 4).count() == queue.plan_route(t, "t000", "no", 4).count() == queue.plan_queue(t, "no").count() == 0
    ranked = [tuple(r) for r in queue.plan_queue(t, "t000", 8).collect()]
    for pool in (1, 2, 5):  # small pools: rows left out are looked up, with the same queue
        assert [tuple(r)[:2] for r in queue.plan_queue(t, "t000", 8, pool=pool).collect()] == [r[:2] for r in ranked]
    assert queue.queue_for(t.limit(20), plays_of(spark), "t000").count() == 0
    some = t.where("id < 't040'").select("id")
    heard = queue.queue_for(t.withColumn("album", F.lit("x")), plays_of(spark), "t000", reachable=some, length=6)
    assert all(r.id < "t040" for r in heard.collect())
    given, left = queue.hand_over(queue.plan_queue(t, "t000", 5), remaining=1)
    assert [r.step for r in given.collect()] == [1] and left.count() == 4
    assert [r.step for r in queue.without_played(left, left.orderBy("step").collect()[1].id).collect()] == [4, 5] and queue.without_played(left, "none").count() == 4
    assert queue.first_seed(t, "t005") == "t005" and queue.first_seed(t, "none") == "t000" and queue.first_seed(t) == "t000"
    w = scores.Weights().bent(0.9)
    assert abs(w.bpm + w.key + w.energy + w.timbre + w.novelty - 1) < 1e-9


def test_few_rows_are_provisional(spark):
    t = spark.createDataFrame([(True, 0.25, 2500.0, 8.25, 0.5), (False, None, None, None, None)], "analysed boolean, loudness double, brightness_hz double, crest double, dance_raw double")
    got = statistics.rerank(t).collect()
    assert [r.energy for r in got if r.analysed] == [0.5] and all(r.energy is None for r in got if not r.analysed)
    assert shape.tempo_histogram(t.where("false").withColumns({"bpm": F.lit(1.0), "bpm_confidence": F.lit(1.0)})).count() == 14


def test_moves_fire_once(spark, tmp_path):
    schema = "player string, seq long, track_id string, elapsed_sec double, duration_sec double, sound_end_sec double, fade_sec double, joined boolean, has_next boolean"
    tick = lambda seq, track, at, length=100.0, end=None, joined=False, more=True: ("p", seq, track, at, length, end, 4.0, joined, more)
    rows = [tick(0, "a", 10.0), tick(1, "a", 96.5), tick(2, "a", 97.0), tick(3, "b", 91.0, end=95.0), tick(4, "c", 9.0, 10.0), tick(5, "c", 9.8, 10.0, joined=True), tick(6, "d", 99.0, more=False), tick(7, "e", 1.0, 0.0)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "t"))
    got = streams.run_once(streams.moves(spark.readStream.schema(schema).parquet(str(tmp_path / "t")))).collect()
    assert sorted((r.track_id, r.elapsed_sec) for r in got) == [("a", 96.5), ("b", 91.0), ("c", 9.8)]


def test_deep_scan_stops_and_goes_on(spark, tmp_path):
    """Cutoffs of files of different rates, a batch at a time; what was measured is not measured again."""
    (tmp_path / "in").mkdir()
    rng = np.random.default_rng(3)

    def put(name, rate, top, seconds):
        n = rate * seconds
        spectrum = np.fft.rfft(rng.normal(size=n))
        spectrum[np.arange(len(spectrum)) * rate / n > top] = 0
        y = np.fft.irfft(spectrum, n)
        body = np.round(y / np.abs(y).max() * 30_000).astype("<i2").tobytes()
        (tmp_path / "in" / name).write_bytes(b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate * 2, 2, 16) + b"data" + struct.pack("<I", len(body)) + body)

    put("a.wav", 44_100, 15_800, 33)
    put("b.wav", 48_000, 20_300, 3)
    put("c.wav", 8_000, 9_000, 3)
    (tmp_path / "in" / "d.wav").write_bytes(b"no sound")
    where = (str(tmp_path / "readings"), str(tmp_path / "marks"))
    analysis.deep_scan(analysis.arriving(spark, str(tmp_path / "in"), 1), *where, batches=1)
    first = spark.read.parquet(where[0]).count()
    assert 1 <= first < 4
    analysis.deep_scan(analysis.arriving(spark, str(tmp_path / "in"), 1), *where)
    readings = spark.read.parquet(where[0])
    names_ = {r.id: r.file_name for r in files.scan_folder(spark, str(tmp_path / "in")).collect()}
    got = {names_[r.id]: r for r in readings.collect()}
    assert len(got) == readings.count() == 4
    assert 15_500 < got["a.wav"].cutoff_hz <= 16_500 and 20_000 < got["b.wav"].cutoff_hz <= 21_000 and got["c.wav"].cutoff_hz <= 4_000
    assert got["d.wav"].cutoff_hz is None and got["a.wav"].duration_sec == pytest.approx(33)
    verdicts = {names_[r.id]: r.verdict for r in health.cutoff_report(readings).collect()}
    assert verdicts == {"a.wav": "transcode", "b.wav": "full", "c.wav": "lossy", "d.wav": None}
