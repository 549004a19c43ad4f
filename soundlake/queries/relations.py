"""Relations derived from the test tables: recordings, plays, frames, fingerprints, wants.

One SQL text per relation serves both engines; names in braces are the tables.
Sums are of scaled integers, so that no order of summation matters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TRACKS = """
WITH sums AS (
  SELECT l_partkey AS k, count(*) AS n, cast(sum(cast(round(l_quantity) AS bigint)) AS bigint) AS q,
    cast(sum(cast(round(l_discount * 100) AS bigint)) AS bigint) AS disc,
    cast(sum(cast(round(l_tax * 100) AS bigint)) AS bigint) AS tax,
    cast(sum(cast(round(l_extendedprice * 100) AS bigint)) AS bigint) AS px,
    cast(sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS bigint) AS a,
    cast(sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS bigint) AS f
  FROM {lineitem} GROUP BY l_partkey),
suppliers AS (SELECT count(*) AS m FROM {supplier}),
parts AS (
  SELECT p.p_partkey AS k, p.p_name, concat(p.p_brand, ' ', p.p_type) AS album, p.p_partkey % s.m AS sk,
    coalesce(n, 0) AS n, coalesce(q, 0) AS q, coalesce(disc, 0) AS disc, coalesce(tax, 0) AS tax, coalesce(px, 0) AS px, coalesce(a, 0) AS a, coalesce(f, 0) AS f
  FROM {part} p CROSS JOIN suppliers s LEFT JOIN sums ON sums.k = p.p_partkey),
named AS (
  SELECT parts.*, s_name, row_number() OVER (PARTITION BY sk, album ORDER BY parts.k) AS track_no,
    CASE WHEN parts.k % 23 = 0 THEN 'pending' WHEN parts.k % 29 = 0 THEN 'failed' WHEN parts.k % 31 = 0 THEN 'unsupported' ELSE 'done' END AS status
  FROM parts LEFT JOIN {supplier} ON s_suppkey = sk),
base AS (
  SELECT k, concat('t', lpad(cast(k AS varchar(20)), 8, '0')) AS id,
    CASE WHEN k % 17 = 0 THEN NULL ELSE s_name END AS artist,
    CASE WHEN k % 19 = 0 THEN NULL ELSE concat(p_name, ' ', cast(k AS varchar(20))) END AS title,
    album, cast(track_no AS int) AS track_no,
    concat('Artist ', cast(sk AS varchar(20)), '/', album) AS folder,
    concat(lpad(cast(track_no AS varchar(20)), 2, '0'), ' - ', p_name, '.mp3') AS file_name,
    CASE WHEN k % 11 = 0 THEN NULL ELSE cast(1950 + k % 75 AS int) END AS year,
    1000000 + px % 9000000 AS size, 1000 * k AS last_modified,
    (1200 + (37 * q + k) % 4800) / 10E0 AS duration_sec, status,
    CASE WHEN k % 7 = 0 THEN 2 WHEN k % 5 = 0 THEN 4 ELSE 6 END AS version,
    status = 'done' AS analysed, n, q, disc, tax, px, a, f
  FROM named)
SELECT k, id, artist, title, album, track_no, folder, file_name, concat(folder, '/', file_name) AS rel_path, year, size, last_modified, duration_sec, status,
  CASE WHEN analysed THEN version ELSE 0 END AS version, analysed,
  CASE WHEN analysed THEN CASE WHEN k % 37 = 0 THEN 0E0 ELSE 60 + (7 * q % 1400) / 10E0 END END AS bpm,
  CASE WHEN analysed THEN (floor(px / 100E0) % 1000) / 1000E0 END AS bpm_confidence,
  CASE WHEN analysed THEN cast(q % 12 AS int) END AS key_root,
  CASE WHEN analysed THEN CASE WHEN f % 2 = 0 THEN 'major' ELSE 'minor' END END AS key_scale,
  CASE WHEN analysed THEN (30 + 17 * tax % 61) / 100E0 END AS key_strength,
  CASE WHEN analysed THEN (q % 50) / 100E0 END AS key_margin,
  CASE WHEN analysed THEN CASE WHEN k % 41 = 0 THEN 0.001E0 ELSE greatest(disc, 1) / (20E0 * greatest(n, 1)) END END AS loudness,
  CASE WHEN analysed THEN px / (2000E0 * greatest(n, 1)) END AS brightness_hz,
  CASE WHEN analysed THEN (3 * n + 3 * tax) / (2E0 * greatest(n, 1)) END AS crest,
  CASE WHEN analysed THEN a / (1E0 * greatest(n, 1)) END AS dance_raw,
  CASE WHEN analysed THEN (13 * disc % 100) / 100E0 END AS tail_ratio,
  CASE WHEN analysed THEN (29 * tax % 100) / 100E0 END AS head_ratio,
  CASE WHEN analysed THEN CASE WHEN q % 23 = 0 THEN (px % 50) / 10000E0 ELSE 0E0 END END AS clipped_ratio,
  CASE WHEN analysed AND px % 11 <> 0 THEN CASE WHEN px % 13 = 0 THEN 0E0 ELSE (px % 70) / 100E0 END END AS side_ratio,
  CASE WHEN analysed AND k % 41 <> 0 THEN (q % 40) / 10E0 END AS sound_start_sec,
  CASE WHEN analysed AND k % 41 <> 0 THEN duration_sec - (tax % 30) / 10E0 END AS sound_end_sec,
  CASE WHEN analysed AND k % 37 <> 0 AND (floor(px / 100E0) % 1000) / 1000E0 >= 0.3E0 THEN (q % 60) / 100E0 END AS intro_beat_sec,
  CASE WHEN analysed AND k % 37 <> 0 AND (floor(px / 100E0) % 1000) / 1000E0 >= 0.3E0 THEN duration_sec - 20 + (px % 60) / 100E0 END AS outro_beat_sec
FROM base"""

#: Plays, and the time of the last one, which stands for now.
PLAYS = """
SELECT event_id, concat('t', lpad(cast((13 * user_id + cast({json} AS bigint)) % (SELECT count(*) FROM {part}) AS varchar(20)), 8, '0')) AS track_id,
  cast(ts AS timestamp) AS played_at, value AS played_sec
FROM {events}"""
_JSON = {"spark": "get_json_object(props, '$.k')", "duckdb": "json_extract_string(props, '$.k')"}

WANTS = """
SELECT k AS ord,
  CASE k % 5 WHEN 0 THEN upper(artist) WHEN 1 THEN CASE WHEN artist IS NOT NULL THEN concat('Nobody Else, ', artist) END WHEN 3 THEN NULL ELSE artist END AS artist,
  CASE k % 5 WHEN 0 THEN upper(title) WHEN 1 THEN concat(title, ' (2011 Remaster)') WHEN 2 THEN concat(title, ' feat. Someone') WHEN 4 THEN concat(title, ' Zzz') ELSE title END AS title
FROM {tracks} WHERE title IS NOT NULL"""

_TABLES = ("part", "lineitem", "supplier", "events")


def _tables(spark: SparkSession, sf_dir: str, sql: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _TABLES if "{" + t + "}" in sql}


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(TRACKS, **_tables(spark, sf_dir, TRACKS))


def plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = PLAYS.replace("{json}", _JSON["spark"])
    return spark.sql(sql, **_tables(spark, sf_dir, sql))


def wants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(WANTS, tracks=tracks(spark, sf_dir))


def oracle(sql: str) -> str:
    """DuckDB SQL whose relations tracks, plays and wants are the ones above."""
    names = {t: t for t in _TABLES}
    ctes = {
        "tracks": TRACKS.format(**names),
        "plays": PLAYS.format(json=_JSON["duckdb"], **names),
        "wants": WANTS.format(tracks="tracks"),
    }
    return "WITH RECURSIVE " + ",\n".join(f"{name} AS MATERIALIZED ({text})" for name, text in ctes.items() if name in sql or name == "tracks") + ("" if sql.lstrip().startswith(",") else "\n") + sql
