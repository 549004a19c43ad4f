"""Queries over samples, fingerprints, lists and streams of the derived relations."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import codes, levels
from ..operators import history, identity, recordings, signals
from ..sources import files
from ..streaming import plays as streams
from . import relations as R
from .catalog import query


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- samples: each embedding is a frame of 64 samples, and the frames of a label are a recording ---

_X = "list_transform(embedding, lambda v: cast(v AS double))"
_FRAMES = f", f AS (SELECT vec_id, label, {_X} AS x FROM embeddings)"


@query(_FRAMES + ", s AS (SELECT vec_id, x, sqrt(list_sum(list_transform(x, lambda v: v * v)) / 64) AS r, list_max(list_transform(x, lambda v: abs(v))) AS p FROM f) SELECT vec_id, round(r, 6) AS rms, round(p, 6) AS peak, round(CASE WHEN r > 0 THEN p / r ELSE 0 END, 6) AS crest, round(list_sum(list_transform(range(1, 64), lambda i: CASE WHEN (x[i] >= 0) <> (x[i + 1] >= 0) THEN 1.0::DOUBLE ELSE 0 END)) / 63, 6) AS zcr FROM s")
def frame_levels(spark, sf_dir):
    x = _table(spark, sf_dir, "embeddings").select("vec_id", signals.doubles(F.col("embedding")).alias("x"))
    return x.select("vec_id", signals.rms(F.col("x")).alias("rms"), signals.peak(F.col("x")).alias("peak"), signals.crest(F.col("x")).alias("crest"), signals.zero_crossings(F.col("x")).alias("zcr"))


@query(_FRAMES + " SELECT a.vec_id, round(sqrt(list_sum(list_transform(range(1, 65), lambda i: (a.x[i] - b.x[i]) * (a.x[i] - b.x[i]))) / list_sum(list_transform(range(1, 65), lambda i: (a.x[i] + b.x[i]) * (a.x[i] + b.x[i])))), 6) AS side FROM f a JOIN f b ON b.vec_id = a.vec_id + 1")
def stereo_side(spark, sf_dir):
    x = _table(spark, sf_dir, "embeddings").select("vec_id", signals.doubles(F.col("embedding")).alias("x"))
    other = x.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y"))
    return x.join(other, "vec_id").select("vec_id", signals.side_ratio(F.col("x"), F.col("y")).alias("side"))


@query(_FRAMES + ", s AS (SELECT vec_id, unnest(range(48)) AS i, x FROM f), r AS (SELECT *, i / 0.75 AS pos, cast(floor(i / 0.75 + 1e-9) AS int) AS lo FROM s) SELECT vec_id, cast(i AS int) AS i, round(x[lo + 1] + (x[least(63, lo + 1) + 1] - x[lo + 1]) * (pos - lo), 6) AS v FROM r")
def resampled(spark, sf_dir):
    x = _table(spark, sf_dir, "embeddings").select("vec_id", signals.resample(signals.doubles(F.col("embedding")), 16_000, 12_000).alias("x"))
    return x.select("vec_id", F.posexplode("x").alias("i", "v"))


_FOLDED = _FRAMES + ", folded AS (SELECT label, (i - 1) % 12 AS pc, sum(x[i] * x[i]) AS e FROM (SELECT label, x, unnest(range(1, 65)) AS i FROM f) GROUP BY 1, 2)"
_PROFILES = ", profiles AS (" + " UNION ALL ".join(f"SELECT {m} AS minor, unnest(range(12)) AS i, unnest({list(p)}::DOUBLE[]) AS w" for m, p in enumerate((signals.MAJOR, signals.MINOR))) + ")"


@query(_FOLDED + _PROFILES + ", fits AS (SELECT label, t.root, minor, corr(e, w) AS r FROM folded CROSS JOIN (SELECT unnest(range(12)) AS root) t JOIN profiles ON i = (pc - t.root + 12) % 12 GROUP BY 1, 2, 3), best AS (SELECT label, root, minor, r, row_number() OVER (PARTITION BY label ORDER BY r DESC, root, minor) AS n FROM fits) SELECT b.label, cast(b.root AS int) AS root, CASE b.minor WHEN 0 THEN 'major' ELSE 'minor' END AS scale, round(least(1, greatest(0, b.r)), 6) AS strength, round(least(1, greatest(0, b.r - (SELECT max(r) FROM fits o WHERE o.label = b.label AND o.minor <> b.minor))), 6) AS margin FROM best b WHERE n = 1")
def key_estimate(spark, sf_dir):
    cells = _table(spark, sf_dir, "embeddings").select("label", F.posexplode(signals.doubles(F.col("embedding"))).alias("i", "v"))
    folded = cells.groupBy("label", (F.col("i") % 12).alias("pc")).agg(F.sum(F.col("v") * F.col("v")).alias("e"))
    chroma = folded.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pc", "e"))), lambda s: s["e"]).alias("c"))  # 12 classes
    return chroma.select("label", signals.key_of(F.col("c")).alias("k")).select("label", "k.root", "k.scale", "k.strength", "k.margin")


_HOURS = ", n AS (SELECT event_type, cast(floor(epoch(ts) / 3600) AS bigint) AS h, count(*) AS c FROM events GROUP BY 1, 2), ends AS (SELECT min(h) AS lo, max(h) AS hi FROM n), env AS (SELECT e.event_type, s.h, coalesce(c, 0) AS c FROM (SELECT DISTINCT event_type FROM events) e CROSS JOIN (SELECT unnest(range(lo, hi + 1)) AS h FROM ends) s LEFT JOIN n ON n.event_type = e.event_type AND n.h = s.h)"


def _hourly(spark, sf_dir):
    """(event_type, h, c): counts of every hour and kind, zeros included."""
    n = _table(spark, sf_dir, "events").groupBy("event_type", F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600).alias("h")).agg(F.count("*").alias("c"))
    ends = n.groupBy("event_type").agg(F.lit(1).alias("one")).crossJoin(F.broadcast(n.agg(F.min("h").alias("lo"), F.max("h").alias("hi"))))  # one row
    return ends.select("event_type", F.explode(F.sequence("lo", "hi")).alias("h")).join(n, ["event_type", "h"], "left").select("event_type", "h", F.coalesce("c", F.lit(0)).alias("c"))


@query(_HOURS + " SELECT event_type, h, round(avg(c) OVER (PARTITION BY event_type ORDER BY h ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 6) AS smooth FROM env")
def onset_smooth(spark, sf_dir):
    rows = _hourly(spark, sf_dir).groupBy("event_type").agg(F.array_sort(F.collect_list(F.struct("h", "c"))).alias("e"))  # an hour each
    values = F.transform("e", lambda s: s["c"].cast("double"))
    return rows.select("event_type", F.posexplode(F.arrays_zip(F.transform("e", lambda s: s["h"]).alias("h"), signals.moving_average(values, 3).alias("smooth"))).alias("i", "s")).select("event_type", "s.h", "s.smooth")


#: Of a thousand embeddings in a row, of 64 samples each, five recordings are made: (kind, first, behind the last, gain, rate); samples are held between -1 and 1. One has 40 seconds, so three windows, one clips, one is silent, one too short.
_PER, _SOUNDS = 1_000, (("a", 0, 1_000, 1.0, 1_600), ("b", 0, 200, 0.5, 1_600), ("c", 200, 500, 60.0, 4_800), ("d", 500, 700, 0.0, 1_600), ("e", 700, 725, 1.0, 1_600))
_SAMPLES = (
    f", kinds(kind, first, behind, gain, hz) AS (VALUES {', '.join(f"('{k}', {a}, {b}, {g}::DOUBLE, {hz})" for k, a, b, g, hz in _SOUNDS)})"
    f", s AS MATERIALIZED (SELECT concat(cast(vec_id // {_PER} AS varchar), kind) AS id, hz, (vec_id % {_PER} - first) * 64 + i - 1 AS p, greatest(-1.0::DOUBLE, least(1.0::DOUBLE, x[i] * gain)) AS v FROM (SELECT vec_id, x, unnest(range(1, 65)) AS i FROM f) JOIN kinds ON vec_id % {_PER} >= first AND vec_id % {_PER} < behind)"
    ", m AS (SELECT id, any_value(hz) AS hz, max(p) + 1 AS n FROM s GROUP BY 1)"
)
_LEVELS = (
    ", w AS (SELECT id, k, CASE WHEN n >= 35 * hz THEN least(cast(floor(n * share + 0.5) AS bigint), n - 10 * hz) ELSE 0 END AS lo, CASE WHEN n >= 35 * hz THEN 10 * hz ELSE n END AS len FROM m, (VALUES (0, 0.15::DOUBLE), (1, 0.5::DOUBLE), (2, 0.8::DOUBLE)) t(k, share) WHERE n >= 3 * hz AND (k = 0 OR n >= 35 * hz))"
    ", ws AS (SELECT id, k, sum(v * v) AS ss, count(*) AS c, max(abs(v)) AS peak, sum(CASE WHEN (v >= 0) <> (before >= 0) THEN 1 ELSE 0 END) / (count(*) - 1) AS zcr FROM (SELECT s.id, k, v, lag(v) OVER (PARTITION BY s.id, k ORDER BY p) AS before FROM s JOIN w ON w.id = s.id AND p >= lo AND p < lo + len) GROUP BY 1, 2)"
    ", wl AS (SELECT id, avg(sqrt(ss / c)) AS rms, CASE WHEN sum(ss) > 0 THEN max(peak) / sqrt(sum(ss) / sum(c)) ELSE 0 END AS crest, avg(zcr) AS zcr FROM ws GROUP BY 1)"
    ", e AS (SELECT id, sqrt(avg(v * v) FILTER (p < least(n, s.hz // 4))) AS head, sqrt(avg(v * v) FILTER (p >= n - least(n, s.hz // 4))) AS tail FROM s JOIN m USING (id) GROUP BY 1)"
    ", full_ AS (SELECT id, p - row_number() OVER (PARTITION BY id ORDER BY p) AS run FROM s WHERE abs(v) >= 0.98), clip AS (SELECT id, sum(c) AS c FROM (SELECT id, run, count(*) AS c FROM full_ GROUP BY 1, 2 HAVING count(*) >= 3) GROUP BY 1)"
    ", lv AS (SELECT id, p // (s.hz // 20) AS f, sqrt(sum(v * v) / any_value(s.hz // 20)) AS level FROM s JOIN m USING (id) WHERE p // (s.hz // 20) < n // (s.hz // 20) GROUP BY 1, 2), l AS (SELECT id, f, CASE WHEN level > avg(level) OVER (PARTITION BY id) * 0.01 THEN 1 ELSE 0 END AS loud FROM lv), o AS (SELECT id, f, loud = 1 AND sum(loud) OVER a * 2 >= count(*) OVER a AS opens, loud = 1 AND sum(loud) OVER b * 2 >= count(*) OVER b AS closes FROM l WINDOW a AS (PARTITION BY id ORDER BY f ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING), b AS (PARTITION BY id ORDER BY f ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)), g AS (SELECT id, min(f) FILTER (opens) AS a, max(f) FILTER (closes) AS b FROM o GROUP BY 1)"
)


def _chunks(spark, sf_dir) -> DataFrame:
    """(id, rate, pos, samples): chunks of 64."""
    e = _table(spark, sf_dir, "embeddings").select("vec_id", (F.col("vec_id") % _PER).alias("at"), signals.doubles(F.col("embedding")).alias("x"))
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(a).alias("first"), F.lit(b).alias("behind"), F.lit(g).alias("gain"), F.lit(float(hz)).alias("hz")) for k, a, b, g, hz in _SOUNDS))
    rows = e.withColumn("k", F.explode(kinds)).where((F.col("at") >= F.col("k.first")) & (F.col("at") < F.col("k.behind")))
    held = F.transform("x", lambda v: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v * F.col("k.gain"))))
    return rows.select(F.concat(F.floor(F.col("vec_id") / _PER).cast("string"), F.col("k.kind")).alias("id"), F.col("k.hz").alias("rate"), ((F.col("at") - F.col("k.first")) * 64).alias("pos"), held.alias("samples"))


_MEASURES = (("rms", "rms"), ("loudness_db", "CASE WHEN rms > 0 THEN 20 * log10(greatest(rms, 1e-300)) END"), ("crest", "crest"), ("zcr", "zcr"), ("head_ratio", "CASE WHEN rms > 0 THEN head / rms ELSE 0 END"), ("tail_ratio", "CASE WHEN rms > 0 THEN tail / rms ELSE 0 END"), ("sound_start_sec", "a * (hz // 20) / hz"), ("sound_end_sec", "(b + 1) * (hz // 20) / hz"), ("clipped_ratio", "coalesce(clip.c, 0) / n"))


@query(_FRAMES + _SAMPLES + _LEVELS + " SELECT m.id, CASE WHEN n < 3 * hz THEN 'too_short' ELSE 'ok' END AS status, round(n / hz, 6) AS duration_sec, " + ", ".join(f"CASE WHEN n >= 3 * hz THEN round({x}, 6) END AS {c}" for c, x in _MEASURES) + " FROM m LEFT JOIN wl USING (id) LEFT JOIN e USING (id) LEFT JOIN clip USING (id) LEFT JOIN g USING (id)")
def recording_levels(spark, sf_dir):
    """Of recordings of one window and of three, a clipping, a silent and a short one; silence has no level in decibels."""
    got = recordings.measured_levels(_chunks(spark, sf_dir))
    return got.withColumn("loudness_db", F.when(F.col("loudness_db") > float("-inf"), F.col("loudness_db")))


_TO = 3_000


@query(_FRAMES + _SAMPLES + f", r AS (SELECT id, hz, unnest(range(greatest(1, n * {_TO} // hz))) AS i FROM m) SELECT r.id, i, round(a.v + (coalesce(b.v, a.v) - a.v) * ((i * r.hz % {_TO}) / {_TO}), 6) AS v FROM r JOIN s a ON a.id = r.id AND a.p = i * r.hz // {_TO} LEFT JOIN s b ON b.id = r.id AND b.p = i * r.hz // {_TO} + 1")
def resampled_chunks(spark, sf_dir):
    """Recordings of two rates at one between them, sample by sample, from chunks of 64."""
    got = recordings.resampled(_chunks(spark, sf_dir), _TO)
    return got.select("id", "pos", F.posexplode("samples").alias("k", "v")).select("id", (F.col("pos") + F.col("k")).alias("i"), "v")


#: A transform by its definition: windows as lists, whole frames under a Hann window, and a sine and a cosine for each bin.
_WINDOWS = ", win AS (SELECT w.id, w.k, any_value(s.hz) AS hz, list(v ORDER BY p) AS x FROM s JOIN w ON w.id = s.id AND p >= lo AND p < lo + len GROUP BY 1, 2)"


def _transform(size: int, hop: int, bins: str) -> str:
    return (
        f", fr AS (SELECT id, k, hz, unnest(range((len(x) - {size}) // {hop} + 1)) AS f, x FROM win WHERE len(x) >= {size})"
        f", hann AS (SELECT list_transform(range({size}), lambda i: 0.5::DOUBLE * (1 - cos(2 * pi() * i / {size}))) AS h)"
        f", framed AS (SELECT id, k, hz, f, list_transform(list_zip(x[f * {hop} + 1:f * {hop} + {size}], h), lambda z: z[1] * z[2]) AS y FROM fr, hann)"
        f", dft AS MATERIALIZED (SELECT b, list_transform(range({size}), lambda i: cos(2 * pi() * (b * i % {size}) / {size})) AS c, list_transform(range({size}), lambda i: sin(2 * pi() * (b * i % {size}) / {size})) AS s FROM range({size} // 2 + 1) t(b))"
        f", mag AS MATERIALIZED (SELECT id, k, hz, f, b, b * hz / {size}::DOUBLE AS freq, sqrt(pow(list_dot_product(y, c), 2) + pow(list_dot_product(y, dft.s), 2)) AS m FROM framed, dft{bins})"
    )


_SPECTRA = (
    ", fs AS (SELECT id, k, f, sum(m * freq) / nullif(sum(m), 0) AS centroid, sum(m * m) FILTER (freq <= 200) / nullif(sum(m * m), 0) AS low, sum(m) AS mass FROM mag GROUP BY 1, 2, 3)"
    ", ro AS (SELECT id, k, f, count(*) FILTER (so_far < 0.85 * mass) * any_value(hz) / 2048 AS rolloff FROM (SELECT mag.*, mass, sum(m) OVER (PARTITION BY id, k, f ORDER BY b) AS so_far FROM mag JOIN fs USING (id, k, f)) GROUP BY 1, 2, 3)"
    ", fl AS (SELECT id, k, sum(greatest(0, m - before)) / greatest(1, max(f)) AS flux FROM (SELECT *, lag(m) OVER (PARTITION BY id, k, b ORDER BY f) AS before FROM mag) GROUP BY 1, 2)"
    ", ws_ AS (SELECT win.id, win.k, coalesce(avg(coalesce(centroid, 0)), 0) AS centroid, coalesce(avg(rolloff), 0) AS rolloff, coalesce(avg(coalesce(low, 0)), 0) AS low FROM win LEFT JOIN fs USING (id, k) LEFT JOIN ro ON ro.id = win.id AND ro.k = win.k AND ro.f = fs.f GROUP BY 1, 2)"
)


@query(_FRAMES + _SAMPLES + _LEVELS + _WINDOWS + _transform(2_048, 1_024, "") + _SPECTRA + " SELECT id, round(avg(centroid), 6) AS centroid_hz, round(avg(rolloff), 6) AS rolloff_hz, round(avg(low), 6) AS low_band, round(avg(coalesce(flux, 0)), 6) AS flux FROM ws_ LEFT JOIN fl USING (id, k) GROUP BY 1")
def spectral_levels(spark, sf_dir):
    """Centroid, rolloff, the part below 200 Hz and flux of recordings, against transforms by their definition."""
    return recordings.spectral(_windows(spark, sf_dir)).select("id", "centroid_hz", "rolloff_hz", "low_band", "flux")


def _windows(spark, sf_dir) -> DataFrame:
    chunks = files.checkpointed(_chunks(spark, sf_dir))
    return recordings.cut_out(chunks, recordings.pieces(recordings.plans(chunks)).where("kind = 'window'"))


_CHROMA = (
    ", pit AS (SELECT id, k, m * m AS e, 69 + 12 * log2(freq / 440) AS pitch FROM mag)"
    ", cls AS (SELECT id, k, cast(floor(pitch) AS bigint) % 12 AS pc, e * (1 - (pitch - floor(pitch))) AS e FROM pit UNION ALL SELECT id, k, (cast(floor(pitch) AS bigint) + 1) % 12, e * (pitch - floor(pitch)) FROM pit)"
    ", sums AS (SELECT id, k, pc, sum(e) AS e FROM cls GROUP BY 1, 2, 3), tops AS (SELECT id, k, max(e) AS top FROM sums GROUP BY 1, 2 HAVING max(e) > 0)"
)


@query(_FRAMES + _SAMPLES + _LEVELS + _WINDOWS + _transform(4_096, 4_096, " WHERE b * hz / 4096::DOUBLE >= 80 AND b * hz / 4096::DOUBLE <= 5000") + _CHROMA + " SELECT ids.id, pcs.pc, round(coalesce(avg(e / top), 0), 6) AS share FROM (SELECT DISTINCT id FROM w) ids CROSS JOIN (SELECT unnest(range(12)) AS pc) pcs LEFT JOIN (sums JOIN tops USING (id, k)) ON sums.id = ids.id AND sums.pc = pcs.pc GROUP BY 1, 2")
def chroma_levels(spark, sf_dir):
    """Shares of the twelve pitch classes of recordings, against transforms by their definition."""
    return recordings.spectral(_windows(spark, sf_dir)).select("id", F.posexplode("chroma").alias("pc", "share"))


@query()
def extracted_features(spark, sf_dir):
    """Every descriptor of the recordings, which have different rates, at one rate; the cutoff at their own."""
    sounds = _chunks(spark, sf_dir)
    got = recordings.extract(recordings.resampled(sounds), cutoff=recordings.cutoffs(sounds))
    return got.select("id", "status", "duration_sec", "rms", "crest", "zcr", "centroid_hz", "rolloff_hz", "low_band", "flux", "bpm", "bpm_confidence", "onset_density", "danceability", "cutoff_hz", F.col("key.root").alias("root"), F.col("key.scale").alias("scale"), "fingerprint")


# --- fingerprints: each document is a recording, 20 characters to a second ---


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _cells(texts: pd.Series) -> pd.Series:
    """60 frames of 12 counts of letters, each frame's largest being 255; null below 720 characters."""

    def one(text: str | None):
        if text is None or len(text) < 720:
            return None
        code = np.frombuffer(text.encode("utf-32-le"), np.uint32) | 32
        at = np.flatnonzero((code >= 97) & (code <= 122))
        frame = np.searchsorted(np.arange(1, 61) * len(code) // 60, at, "right")
        counts = np.bincount(frame * 12 + code[at] % 12, minlength=720).reshape(60, 12)
        return np.floor(counts / np.maximum(counts.max(axis=1, keepdims=True), 1) * 255 + 0.5).astype(np.int32).ravel()

    return texts.map(one)


def fingerprints(spark, sf_dir) -> DataFrame:
    """(id, duration_sec, fingerprint, rel_path, artist, title, ...) of documents; texts below 720 characters have no fingerprint."""
    d = _table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.length("text").alias("n"), codes.fingerprint_text(_cells("text")).alias("fingerprint"))
    lost = F.col("doc_id") % 5 == 0
    return d.select(
        F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 10, "0")).alias("id"),
        (F.col("n") / 20).alias("duration_sec"),
        "fingerprint",
        F.concat_ws("/", F.lit("music"), "source", F.concat(F.lit("01 - "), "lang", F.lit(".mp3"))).alias("rel_path"),
        F.when(~lost, F.col("source")).alias("artist"),
        F.when(~lost, F.concat(F.lit("title "), F.col("n").cast("string"))).alias("title"),
        F.col("lang").alias("album"),
        F.lit(1).alias("track_no"),
        (-F.pmod(F.col("doc_id"), F.lit(9)).cast("double")).alias("loudness_db"),
        F.lit(0.5).alias("compression"),
    )


_CLASSES = ["[" + "".join(c + c.upper() for c in "abcdefghijklmnopqrstuvwxyz" if ord(c) % 12 == b) + "]" for b in range(12)]
_COUNTS = ", ".join(f"len(frame) - len(regexp_replace(frame, '{c}', '', 'g'))" for c in _CLASSES)
#: Recordings with their cells, classes of one length and print, centred windows of 20 frames less a lag, and the distances of classes.
_PRINTS = (
    ", docs AS (SELECT doc_id, concat('d', lpad(cast(doc_id AS varchar), 10, '0')) AS id, text, length(text) AS n, length(text) / 20 AS sec, source, lang FROM documents)"
    f", cells AS (SELECT id, list(v ORDER BY f) AS print FROM (SELECT id, f, list_transform(c, lambda x: floor(x / greatest(list_max(c), 1) * 255 + 0.5)) AS v FROM (SELECT id, f, [{_COUNTS}] AS c FROM (SELECT id, f, substring(text, f * n // 60 + 1, (f + 1) * n // 60 - f * n // 60) AS frame FROM (SELECT *, unnest(range(60)) AS f FROM docs WHERE n >= 720)))) GROUP BY 1)"
    ", held AS MATERIALIZED (SELECT docs.* EXCLUDE (text), print, first_value(id) OVER (PARTITION BY sec, print ORDER BY id) AS kind FROM docs JOIN cells USING (id))"
    ", flat AS (SELECT id, f // 20 AS seg, f % 20 AS f, b, print[f + 1][b + 1] AS v FROM (SELECT id, print, f, unnest(range(12)) AS b FROM (SELECT id, print, unnest(range(60)) AS f FROM held WHERE id = kind)))"
    ", windows AS (SELECT unnest([0, 0, 0, 0, 1, 2, 3]) AS st, unnest([0, 1, 2, 3, 1, 2, 3]) AS cut)"
    ", centred AS MATERIALIZED (SELECT id, seg, st, cut, list((v - m) / sqrt(s) ORDER BY f, b) AS x FROM (SELECT *, sum((v - m) * (v - m)) OVER (PARTITION BY id, seg, st, cut) AS s FROM (SELECT *, avg(v) OVER (PARTITION BY id, seg, st, cut, b) AS m FROM flat JOIN windows ON f >= st AND f < st + 20 - cut)) WHERE s > 0 GROUP BY 1, 2, 3, 4)"
    ", near AS (SELECT a.id AS a, b.id AS b FROM held a JOIN held b ON a.id = a.kind AND b.id = b.kind AND abs(a.sec - b.sec) <= 1.5 AND a.id <= b.id)"
    ", probes AS MATERIALIZED (SELECT a, b, seg, x, concat(b, '/', seg, '/', cut, '/', CASE WHEN st = 0 THEN cut ELSE 0 END) AS other FROM near JOIN centred ON id = a)"
    ", fits AS (SELECT a, b, p.seg, max(list_inner_product(p.x, y.x)) AS r FROM probes p JOIN (SELECT concat(id, '/', seg, '/', cut, '/', st) AS own, x FROM centred) y ON own = other GROUP BY 1, 2, 3)"
    ", alike AS MATERIALIZED (SELECT a, b, 1 - avg(greatest(-1, least(1, r))) AS d FROM fits WHERE r IS NOT NULL GROUP BY 1, 2 HAVING 1 - avg(greatest(-1, least(1, r))) <= 0.12)"
    ", pairs AS (SELECT a AS a_id, b AS b_id, d FROM alike WHERE a < b UNION ALL SELECT kind, id, d FROM held JOIN alike ON a = kind AND b = kind WHERE id <> kind)"
)
_GROUPS = _PRINTS + ", edges AS (SELECT a_id AS x, b_id AS y FROM pairs UNION SELECT b_id, a_id FROM pairs), reach(x, y) AS (SELECT x, y FROM edges UNION SELECT r.x, e.y FROM reach r JOIN edges e ON e.x = r.y), groups AS (SELECT x AS id, least(x, min(y)) AS group_id FROM reach GROUP BY x), least_d AS (SELECT group_id, min(d) AS d FROM pairs JOIN groups ON id = a_id GROUP BY 1)"


@query(_PRINTS + " SELECT a_id, b_id, round(d, 6) + 0.0 AS distance FROM pairs")
def duplicate_pairs(spark, sf_dir):
    return identity.duplicate_pairs(fingerprints(spark, sf_dir))


@query(_GROUPS + " SELECT id, group_id, round(d, 6) + 0.0 AS distance FROM groups JOIN least_d USING (group_id)")
def duplicate_groups(spark, sf_dir):
    return identity.duplicate_groups(fingerprints(spark, sf_dir))


@query(_GROUPS + ", louder AS (SELECT DISTINCT g.group_id FROM alike JOIN held p ON p.kind = a JOIN held q ON q.kind = b JOIN groups g ON g.id = p.id WHERE p.id <> q.id AND abs(p.doc_id % 9 - q.doc_id % 9) > 2.5) SELECT group_id, count(*) AS n, CASE WHEN group_id IN (SELECT group_id FROM louder) THEN 'different-master' ELSE 'same-master' END AS verdict FROM groups GROUP BY 1")
def duplicate_verdicts(spark, sf_dir):
    return identity.duplicate_verdicts(fingerprints(spark, sf_dir))


@query(_PRINTS + ", ways AS (SELECT a, b, d FROM alike UNION SELECT b, a, d FROM alike), lent AS (SELECT o.id, arg_min(struct_pack(id := p.id, d := d, source := p.source, n := p.n), (round(d, 9), p.sec, p.id)) AS b FROM held o JOIN ways ON ways.a = o.kind JOIN held p ON p.kind = ways.b AND p.doc_id % 5 <> 0 WHERE o.doc_id % 5 = 0 GROUP BY 1) SELECT docs.id, CASE WHEN b IS NULL THEN 'path' ELSE 'sound' END AS source, CASE WHEN b IS NULL THEN 'music' ELSE b.source END AS artist, CASE WHEN b IS NULL THEN lang ELSE concat('title ', b.n) END AS title, NULL::VARCHAR AS album, NULL::INT AS track_no, b.id AS from_id, round(b.d, 6) + 0.0 AS distance FROM docs LEFT JOIN lent USING (id) WHERE doc_id % 5 = 0")
def orphan_proposals(spark, sf_dir):
    return identity.propose_names(files.checkpointed(fingerprints(spark, sf_dir)))


# --- lists ---


@query("SELECT folder AS list_id, cast(row_number() OVER (PARTITION BY folder ORDER BY k) - 1 AS bigint) AS ord, rel_path AS path, coalesce(title, rel_path) AS title, cast(floor(duration_sec + 0.5) AS double) AS length_sec FROM tracks")
def m3u_roundtrip(spark, sf_dir):
    t = R.tracks(spark, sf_dir)
    entries = t.select(F.col("folder").alias("list_id"), F.col("k").alias("ord"), F.col("rel_path").alias("path"), "title", F.col("duration_sec").alias("length_sec"), F.lit("a note\nin two lines").alias("note"))
    return files.parse_m3u(files.build_m3u(entries)).select("list_id", F.col("ord").cast("long").alias("ord"), "path", "title", "length_sec")


@query("SELECT 1 + (SELECT count(*) FROM tracks) + (SELECT count(*) FROM plays) AS n, (SELECT count(*) FROM tracks) AS tracks, (SELECT count(*) FROM plays) AS plays")
def export_counts(spark, sf_dir):
    """Of an export."""
    rows = files.export_rows(R.tracks(spark, sf_dir), R.plays(spark, sf_dir))
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "track").alias("tracks"), F.count_if(F.col("kind") == "play").alias("plays"))


@query("SELECT id, rel_path, artist, title, track_no, round(bpm, 6) AS bpm, analysed, version, status FROM tracks")
def export_roundtrip(spark, sf_dir):
    """What comes back of an export of every recording."""
    t = R.tracks(spark, sf_dir)
    kept = ["id", "rel_path", "artist", "title", "track_no", "bpm", "analysed", "version", "status"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in t.select(*kept).schema)
    return files.import_rows(files.export_rows(t, R.plays(spark, sf_dir)), schema)[0]


@query("SELECT p.track_id, p.played_at, p.event_id FROM (SELECT *, lag(track_id) OVER (PARTITION BY user_id ORDER BY played_at, event_id) AS before FROM (SELECT p.*, e.user_id FROM plays p JOIN events e USING (event_id))) p WHERE before IS NULL OR before <> track_id")
def changes_of_track(spark, sf_dir):
    """Plays recorded when a listener's player moves to another recording."""
    by = R.plays(spark, sf_dir).join(_table(spark, sf_dir, "events").select("event_id", "user_id"), "event_id")
    return history.without_repeats(by, "user_id").select("track_id", "played_at", "event_id")


# --- streams ---


def _stream(spark, sf_dir, with_k: bool = False) -> DataFrame:
    events = spark.readStream.schema("event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string").option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    if with_k:
        return events.select("event_id", "user_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"), F.col("ts").cast("timestamp").alias("played_at"))
    return events.select("event_id", "user_id", "event_type", F.concat(F.lit("t"), F.col("user_id").cast("string")).alias("track_id"), F.col("ts").cast("timestamp").alias("played_at"), F.col("value").alias("played_sec"))


@query("SELECT concat('t', cast(user_id AS varchar)) AS id, count(*) AS plays FROM events GROUP BY 1")
def stream_plays(spark, sf_dir):
    return streams.run_once(streams.play_counts(_stream(spark, sf_dir)), "complete")


_WM = "(SELECT max(ts) - INTERVAL 4 HOUR FROM events)"


@query(f"SELECT date_trunc('hour', ts) AS start, count(*) AS plays, round(sum(value), 4) AS seconds FROM events WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= {_WM} GROUP BY 1")
def stream_hourly(spark, sf_dir):
    """The windows that the watermark has closed."""
    got = streams.run_once(streams.hourly(_stream(spark, sf_dir)))
    return got.select(F.col("start").cast("timestamp_ntz").alias("start"), "plays", F.round("seconds", 4).alias("seconds"))


_GAPS = ", g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS i FROM g)"


@query(_GAPS + f' SELECT user_id, min(ts) AS "start", max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS plays FROM s GROUP BY user_id, i HAVING max(ts) + INTERVAL 30 MINUTE <= {_WM}')
def stream_sessions(spark, sf_dir):
    """The sessions that the watermark has closed."""
    got = streams.run_once(streams.sessions(_stream(spark, sf_dir), "user_id"))
    return got.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "plays")


@query("SELECT DISTINCT concat('t', cast(user_id AS varchar)) AS track_id, ts AS played_at FROM events")
def stream_once(spark, sf_dir):
    got = streams.run_once(streams.once(_stream(spark, sf_dir)))
    return got.select("track_id", F.col("played_at").cast("timestamp_ntz").alias("played_at"))


@query("SELECT user_id AS player, concat(event_type, '') AS track_id, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events WHERE value > 50) GROUP BY 1, 2")
def stream_moves(spark, sf_dir):
    """When players move on: each kind of event plays as a track of 60 seconds, its value being the time elapsed."""
    e = _stream(spark, sf_dir)
    ticks = e.select(F.concat_ws("-", F.col("user_id").cast("string"), "event_type").alias("player"), F.col("event_id").alias("seq"), F.col("event_type").alias("track_id"), F.col("played_sec").alias("elapsed_sec"), F.lit(54.0).alias("duration_sec"), F.lit(None).cast("double").alias("sound_end_sec"), F.lit(4.0).alias("fade_sec"), F.lit(False).alias("joined"), (F.col("played_sec") > 50).alias("has_next"))
    got = streams.run_once(streams.moves(ticks))
    return got.select(F.substring_index("player", "-", 1).cast("long").alias("player"), "track_id").groupBy("player", "track_id").agg(F.count("*").alias("n"))


@query("SELECT event_type AS stage, count(*) AS n, round(avg(value), 6) AS mean_ms FROM events GROUP BY 1")
def stage_times(spark, sf_dir):
    return history.stage_times(_table(spark, sf_dir, "events").select(F.col("event_type").alias("stage"), F.col("value").alias("ms")))


@query("SELECT id, round(-greatest(0, greatest(key_margin * 10 - 3, 2 - key_margin * 10)), 6) AS headroom_db FROM tracks WHERE analysed")
def equaliser_headroom(spark, sf_dir):
    gains = F.array(F.col("key_margin") * 10 - 3, 2 - F.col("key_margin") * 10)
    return R.tracks(spark, sf_dir).where("analysed").select("id", levels.equaliser_headroom(gains).alias("headroom_db"))
