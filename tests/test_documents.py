"""Whole libraries as one JSON document."""

import json
import random

import pytest
from pyspark.sql import functions as F

from soundlake.sources import documents

SCHEMA = "id string, title string, bpm double, tags array<string>, analysis struct<key:string,note:string>"


def library(n, seed=3):
    rng = random.Random(seed)
    odd = lambda: "".join(rng.choice(['a', '"', "\\", "{", "}", "[", "]", ",", ":", "é", "\n", " "]) for _ in range(rng.randint(0, 12)))
    tracks = [{"id": f"t{i:05d}", "title": rng.choice([None, odd()]), "bpm": rng.choice([None, 120.5]), "tags": [odd() for _ in range(rng.randint(0, 3))], "analysis": rng.choice([None, {"key": odd(), "note": "}"}])} for i in range(n)]
    plays = [{"trackId": f"t{rng.randint(0, 9):05d}", "playedAt": 1_700_000_000_000 + 1000 * i, "playedSec": 1.5} for i in range(n // 2)]
    return {"format": documents.EXPORT_FORMAT, "version": documents.EXPORT_VERSION, "exportedAt": 1_700_000_000_123, "analysisVersion": 6, "tracks": tracks, "playHistory": plays}


def plain(rows):
    return sorted(json.dumps(r.asDict(True), sort_keys=True) for r in rows.select("id", "title", "bpm", "tags", "analysis").collect())


@pytest.mark.parametrize(("n", "indent", "size"), [(0, None, None), (1, None, None), (300, None, 700), (300, 2, 997), (40, 1, 50)])
def test_documents_of_other_writers(spark, tmp_path, n, indent, size):
    """One line or many, whole or cut anywhere into splits."""
    doc = library(n)
    path = tmp_path / "x.json"
    path.write_text(json.dumps(doc, indent=indent, ensure_ascii=n % 2 == 0) + ("\n" if indent == 2 else ""))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        if size:
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        head, tracks, plays = documents.read_document(spark, str(path), SCHEMA)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert head == {"exportedAt": doc["exportedAt"], "analysisVersion": 6}
    assert plain(tracks) == sorted(json.dumps(t, sort_keys=True) for t in doc["tracks"])
    assert sorted((r.track_id, r.at) for r in plays.select("track_id", F.unix_millis("played_at").alias("at")).collect()) == sorted((p["trackId"], p["playedAt"]) for p in doc["playHistory"])


def test_export_import_export(spark, tmp_path):
    doc = library(200)
    tracks = spark.createDataFrame([(t["id"], t["title"], t["bpm"], t["tags"], t["analysis"]) for t in doc["tracks"]], SCHEMA)
    plays = spark.createDataFrame([(p["trackId"], p["playedAt"], p["playedSec"]) for p in doc["playHistory"]], "track_id string, at long, played_sec double").select("track_id", F.timestamp_millis("at").alias("played_at"), "played_sec")
    plays = plays.unionByName(plays.limit(1))  # equal rows stay
    texts = []
    for name in ("a", "b"):
        folder = str(tmp_path / name)
        documents.write_document(tracks, plays, folder, 99, 6)
        texts.append("".join(p.read_text() for p in sorted((tmp_path / name).glob("part-*"))))
        whole = json.loads(texts[-1])
        assert len(whole["tracks"]) == 200 and len(whole["playHistory"]) == 101 and whole["exportedAt"] == 99
        _, tracks, plays = documents.read_document(spark, folder, SCHEMA)
    assert texts[0] == texts[1]
    none = str(tmp_path / "none")
    documents.write_document(tracks.where("false"), plays.where("false"), none, 1, 6)
    assert documents.read_document(spark, none, SCHEMA)[1].collect() == []


@pytest.mark.parametrize(("change", "message"), [({"version": 2}, "version 2"), ({"tracks": None}, "no tracks"), ({"tracks": {"a": {}}}, "no tracks"), ({"format": "other"}, "not an export")])
def test_refused(spark, tmp_path, change, message):
    (tmp_path / "x.json").write_text(json.dumps(library(3) | change))
    with pytest.raises(ValueError, match=message):
        documents.read_document(spark, str(tmp_path / "x.json"), SCHEMA)


@pytest.mark.parametrize("text", ["", "not json", "[1, 2", '{"format": '])
def test_no_json(spark, tmp_path, text):
    (tmp_path / "x.json").write_text(text)
    with pytest.raises(ValueError):
        documents.read_document(spark, str(tmp_path / "x.json"), SCHEMA)
