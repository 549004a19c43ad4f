"""The whole report, the lists' first rows, names on display, and growing histograms."""

import os

import pytest
from pyspark.sql import functions as F

from soundlake.functions import names
from soundlake.operators import catalogue, identity, statistics
from soundlake.queries import relations as R
from soundlake.queries import signals as Q
from soundlake.streaming import plays as streams

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_report_from_pairs_made_once(spark, monkeypatch):
    tracks = R.tracks(spark, SF)
    recordings = Q.fingerprints(spark, SF).limit(400)
    made = []
    pairs = identity.duplicate_pairs
    monkeypatch.setattr(identity, "duplicate_pairs", lambda *a, **k: made.append(1) or pairs(*a, **k))
    told = catalogue.report(tracks, recordings)
    counts = {k: df.count() for k, df in told.items()}
    assert made == [1]
    assert counts["totals"] == 1 and counts["keys"] == 24 and counts["catalogue"] == tracks.where("analysed").count()
    assert counts["verdicts"] == told["duplicates"].select("group_id").distinct().count()
    monkeypatch.undo()
    own = identity.duplicate_groups(recordings)
    assert sorted(map(tuple, told["duplicates"].collect())) == sorted(map(tuple, own.collect()))
    assert catalogue.first(told["catalogue"], "queue").count() == 4 and catalogue.first(told["catalogue"], "wants", 2).count() == 2


def test_too_many_texts(spark, monkeypatch):
    monkeypatch.setattr(catalogue, "MOST_ASKED", 2)
    asked = spark.createDataFrame([(i, "a") for i in range(3)], "ord long, text string")
    with pytest.raises(ValueError):
        catalogue.find(spark.createDataFrame([("1", "a")], "id string, label string"), asked)


def test_names_on_display(spark):
    rows = spark.createDataFrame([("A", "T", "f.mp3"), (None, "T", "f.mp3"), ("A", " ", "f.mp3"), (None, None, "a.b.mp3")], "a string, t string, f string")
    a, t, f = F.col("a"), F.col("t"), F.col("f")
    assert [r[0] for r in rows.select(names.display(a, t, f)).collect()] == ["A - T", "T", "f.mp3", "a.b.mp3"]
    assert [r[0] for r in rows.select(names.title_of(t, f)).collect()] == ["T", "T", " ", "a.b"]
    assert [r[0] for r in rows.select(names.proposed(F.lit(None).cast("string"), F.lit("New"), a, t)).collect()] == ["A — New", "New", "A — New", "New"]
    assert spark.range(1).select(names.dated("set", F.lit(86_400_000), "m3u")).first()[0] == "set-1970-01-02.m3u"


def test_growing_histograms(spark, tmp_path):
    t = R.tracks(spark, SF).select("id", "analysed", "loudness", "brightness_hz", "crest", "dance_raw")
    t.repartition(3).write.parquet(str(tmp_path / "t"))
    stream = spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "t"))
    got = streams.run_once(streams.growing_histograms(stream), "complete")
    want = statistics.histograms(t)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))


def test_folding_of_mixed_names(spark):
    rows = spark.createDataFrame([("Café",), ("CAFE",), (None,), ("名前 (feat. X)",), ("plain & simple",)], "n string")
    assert [r[0] for r in rows.select(names.fold(F.col("n"))).collect()] == ["cafe", "cafe", None, "名前", "plain and simple"]
