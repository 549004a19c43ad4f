"""Queries over changes to a collection: failures, states, accepted names, lookups, settings, orders of reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codes, keys, scores
from ..operators import catalogue, history, identity, merge, wants
from ..plans import queue
from . import relations as R
from .catalog import ANALYSED, query


def _failing(t):
    """(id, message, retryable): some recordings fail once, some twice."""
    one = t.where("k % 7 = 0").select("id", F.when(F.col("k") % 14 == 0, F.concat(F.lit("broken "), F.col("k").cast("string"))).alias("message"), (F.col("k") % 3 == 0).alias("retryable"))
    return one.unionByName(t.where("k % 21 = 0").select("id", F.lit("again").alias("message"), F.lit(True).alias("retryable")))


_FAIL = ", f AS (SELECT id, CASE WHEN k % 14 = 0 THEN concat('broken ', k) END AS message, k % 3 = 0 AS retryable FROM tracks WHERE k % 7 = 0 UNION ALL SELECT id, 'again', true FROM tracks WHERE k % 21 = 0), g AS (SELECT id, max(message) AS message, bool_or(retryable) AS again FROM f GROUP BY 1)"


@query(_FAIL + " SELECT t.id, CASE WHEN g.id IS NULL THEN status WHEN again THEN 'failed' ELSE 'unsupported' END AS status, cast(k % 4 + CASE WHEN g.id IS NULL THEN 0 ELSE 1 END AS int) AS attempts, CASE WHEN g.id IS NULL THEN concat('old ', k) ELSE message END AS error, CASE WHEN g.id IS NULL THEN false ELSE again AND k % 4 + 1 < 3 END AS tried_again FROM tracks t LEFT JOIN g USING (id)")
def recorded_failures(spark, sf_dir):
    """The collection after failures, and which of them are tried again."""
    t = R.tracks(spark, sf_dir)
    failures = _failing(t)
    rows = t.select("id", "status", (F.col("k") % 4).cast("int").alias("attempts"), F.concat(F.lit("old "), F.col("k").cast("string")).alias("error"))
    got = merge.with_failures(rows, failures)
    hit = failures.groupBy("id").agg(F.bool_or("retryable").alias("again"))
    code = F.when(F.col("again"), "algorithm").otherwise("undecodable")
    return got.join(hit, "id", "left").withColumn("tried_again", F.coalesce(merge.retryable(code, F.col("attempts")) & F.col("again").isNotNull(), F.lit(False))).drop("again")


@query("SELECT id, CASE WHEN k % 5 = 0 THEN 'analyzing' ELSE status END AS status, CASE WHEN k % 10 = 0 THEN 'note' WHEN k % 5 = 0 THEN NULL ELSE 'old' END AS error FROM tracks")
def changed_states(spark, sf_dir):
    t = R.tracks(spark, sf_dir)
    changes = t.where("k % 5 = 0").select("id", F.lit("analyzing").alias("status"), F.when(F.col("k") % 10 == 0, "note").alias("message"))
    return merge.with_status(t.select("id", "status", F.lit("old").alias("error")), changes)


@query("SELECT id FROM tracks WHERE status = 'pending' AND k % 2 = 1 ORDER BY id LIMIT 32")
def next_batch(spark, sf_dir):
    """The recordings that are analysed next; every second file can't be reached."""
    t = R.tracks(spark, sf_dir)
    return merge.waiting(t, t.where("k % 2 = 0"), 32).select("id")


@query("SELECT t.id, CASE WHEN artist IS NULL OR trim(artist) = '' THEN concat('Given ', k) ELSE artist END AS artist, CASE WHEN title IS NULL OR trim(title) = '' THEN CASE WHEN k % 2 = 0 THEN concat('Later ', k) ELSE concat('First ', k) END ELSE title END AS title, track_no FROM tracks t")
def names_accepted(spark, sf_dir):
    """Blank tags filled from names that were accepted, of which later ones count; tags win."""
    t = R.tracks(spark, sf_dir)
    text = lambda word: F.concat(F.lit(f"{word} "), F.col("k").cast("string"))
    none = F.lit(None).cast("string")
    first = t.select("id", text("Given").alias("artist"), text("First").alias("title"), none.alias("album"), F.lit(None).cast("int").alias("track_no"))
    later = t.where("k % 2 = 0").select("id", none.alias("artist"), text("Later").alias("title"), none.alias("album"), F.lit(None).cast("int").alias("track_no"))
    return identity.with_given(t, identity.accepted(first, later)).select("id", "artist", "title", "track_no")


@query("SELECT count(*) FILTER (k % 3 = 0) AS by_sound, count(*) FILTER (k % 3 = 1) AS by_path FROM tracks")
def names_counted(spark, sf_dir):
    source = F.when(F.col("k") % 3 == 0, "sound").when(F.col("k") % 3 == 1, "path").otherwise("other")
    return identity.accepted_counts(R.tracks(spark, sf_dir).select("id", source.alias("source")))


@query("SELECT cast(k - 1 AS bigint) AS pos, id, title FROM tracks WHERE k BETWEEN 1 AND 40")
def looked_up(spark, sf_dir):
    """Recordings by their ids, in the order asked."""
    t = R.tracks(spark, sf_dir)
    ids = [r.id for r in t.where("k BETWEEN 1 AND 40").orderBy("k").select("id").collect()]
    return merge.lookup(t.select("id", "title"), ids).select("pos", "id", "title")


_PLACE = "CASE WHEN key_root IS NOT NULL THEN ((7 * key_root + CASE key_scale WHEN 'major' THEN 7 ELSE 4 END) % 12) * 2 + CASE key_scale WHEN 'major' THEN 1 ELSE 0 END END"


@query(f"SELECT id, cast(CASE k % 4 WHEN 3 THEN NULL ELSE {_PLACE} END AS int) AS place FROM tracks WHERE analysed")
def keys_read(spark, sf_dir):
    """Places of keys from their codes, in either case, with blanks, and with letters that are none."""
    at = keys.code(keys.place(F.col("key_root"), F.col("key_scale")))
    text = F.when(F.col("k") % 4 == 0, at).when(F.col("k") % 4 == 1, F.lower(at)).when(F.col("k") % 4 == 2, F.concat(F.lit("  "), at, F.lit(" "))).otherwise(F.concat(at, F.lit("x")))
    return R.tracks(spark, sf_dir).where("analysed").select("id", keys.parse(text).cast("int").alias("place"))


_HEX = "lpad(lower(hex(cast(floor({} * 255 + 0.5) AS bigint))), 2, '0')"


@query("SELECT id, concat('https://x.test/', CASE WHEN k % 2 = 0 THEN '?a=1&' ELSE '?' END, 'vibe=1', " + ", ".join(_HEX.format("key_margin") for _ in codes.VIBE_FIELDS) + f", cast(k % 4 AS varchar)) AS link, round(floor(key_margin * 255 + 0.5) / 255, 6) AS first, ['flat', 'rise', 'arc', 'winddown'][k % 4 + 1] AS curve {ANALYSED}")
def vibe_links(spark, sf_dir):
    """Settings in links, and read back from them."""
    t = R.tracks(spark, sf_dir).where("analysed")
    curve = F.element_at(F.array(*map(F.lit, codes.CURVES)), (F.col("k") % 4).cast("int") + 1)
    link = codes.vibe_link(F.when(F.col("k") % 2 == 0, "https://x.test/?a=1").otherwise("https://x.test/"), codes.vibe_code({f: F.col("key_margin") for f in codes.VIBE_FIELDS}, curve))
    return t.select("id", link.alias("link")).withColumn("v", codes.vibe_from_url(F.col("link"))).select("id", "link", F.col(f"v.{codes.VIBE_FIELDS[0]}").alias("first"), "v.curve")


@query("SELECT event_id AS id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def newest_failures(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("id"), F.col("ts").alias("at"), "user_id", "event_type")
    return history.last_failures(e).select("id", "user_id", "event_type")


@query("SELECT id, round(CASE WHEN intro_beat_sec > 0 AND 0.5 + intro_beat_sec < duration_sec THEN 0.5 + intro_beat_sec END, 6) AS start_sec FROM tracks")
def aligned_starts(spark, sf_dir):
    """Where recordings are moved to so that their first beat falls on the moment they come in."""
    return R.tracks(spark, sf_dir).select("id", scores.aligned_start(F.lit(0.5), F.col("intro_beat_sec"), F.col("duration_sec")).alias("start_sec"))


_SHARE = ", q AS (SELECT k - 1 AS step, bpm FROM tracks WHERE k BETWEEN 1 AND 60 AND analysed), d AS (SELECT step, bpm, lag(bpm) OVER (ORDER BY step) AS before FROM q), a AS (SELECT step, CASE WHEN bpm > 0 AND before > 0 THEN least(abs(bpm - before), abs(bpm * 0.5 - before), abs(bpm * 2 - before)) / before END AS apart FROM d WHERE step > 0)"


@query(_SHARE + " SELECT count(*) AS moves, round(avg(CASE WHEN apart < 0.1 THEN 1.0 ELSE 0.0 END), 6) AS near FROM a")
def near_moves(spark, sf_dir):
    """How many moves of a queue stay near in tempo."""
    t = R.tracks(spark, sf_dir).withColumns({c: F.lit(0.5) for c in ("energy", "brightness", "danceability", "compression")})
    steps = t.where("k BETWEEN 1 AND 60 AND analysed").select((F.col("k") - 1).cast("int").alias("step"), "id")
    seed = steps.where("step = 0").select("id").first()
    return queue.near_share(t, steps.where("step > 0"), seed.id if seed else "t00000001")


@query("SELECT concat('t', lpad(cast(k AS varchar), 8, '0')) AS id, key, value FROM (SELECT k, concat('key ', k % 7) AS key, CASE WHEN k % 7 = 3 THEN 'new' ELSE concat('v', k) END AS value FROM tracks WHERE k BETWEEN 1 AND 7 UNION ALL SELECT 8, 'other', 'added')")
def settings_written(spark, sf_dir):
    """A table of settings after one is set anew and one is added, and read by key."""
    t = R.tracks(spark, sf_dir).where("k BETWEEN 1 AND 7")
    settings = t.select(F.concat(F.lit("key "), (F.col("k") % 7).cast("string")).alias("key"), F.concat(F.lit("v"), F.col("k").cast("string")).alias("value"))
    after = catalogue.write_setting(catalogue.write_setting(settings, "key 3", "new"), "other", catalogue.read_setting(settings, "none", "added"))
    ids = t.select("id", F.concat(F.lit("key "), (F.col("k") % 7).cast("string")).alias("key"))
    return after.join(ids, "key", "left").select(F.coalesce("id", F.lit("t00000008")).alias("id"), "key", "value")


@query("SELECT id, artist_key, title_key, via FROM (SELECT id, trim(regexp_replace(lower(coalesce(artist, '')), '[^a-z0-9]+', ' ', 'g')) AS artist_key, trim(regexp_replace(lower(coalesce(title, '')), '[^a-z0-9]+', ' ', 'g')) AS title_key, 'tags' AS via FROM tracks UNION ALL SELECT id, trim(regexp_replace(lower(coalesce(artist, '')), '[^a-z0-9]+', ' ', 'g')), concat('named ', cast(k AS varchar)), 'given' FROM tracks WHERE k % 4 = 0) WHERE title_key <> ''")
def names_indexed(spark, sf_dir):
    """Every name that recordings go by: tags, and names that were given."""
    t = R.tracks(spark, sf_dir)
    given = t.where("k % 4 = 0").select("id", F.lit(None).cast("string").alias("artist"), F.concat(F.lit("Named "), F.col("k").cast("string")).alias("title"), F.lit("given").alias("source"))
    return wants.name_index(t, given).select("id", "artist_key", "title_key", "via")


@query("SELECT row_number() OVER (ORDER BY distance, group_id, last_modified, id) AS place, id, group_id FROM (SELECT id, concat('g', cast(k % 50 AS varchar)) AS group_id, last_modified, (k % 50) % 6 / 100 AS distance FROM tracks)")
def groups_in_order(spark, sf_dir):
    """Groups of duplicates as a report lists them."""
    t = R.tracks(spark, sf_dir)
    groups = t.select("id", F.concat(F.lit("g"), (F.col("k") % 50).cast("string")).alias("group_id"), ((F.col("k") % 50) % 6 / 100).alias("distance"))
    return _numbered(identity.listed_groups(groups, t)).select("place", "id", "group_id")


@query("SELECT row_number() OVER (ORDER BY source = 'path', distance, CASE WHEN source = 'path' THEN lower(file_name) END, id) AS place, id, source FROM (SELECT id, file_name, CASE WHEN k % 3 = 0 THEN 'path' ELSE 'sound' END AS source, CASE WHEN k % 3 > 0 THEN k % 10 / 100 END AS distance FROM tracks)")
def proposals_in_order(spark, sf_dir):
    """Proposals of names as a report lists them."""
    t = R.tracks(spark, sf_dir)
    rows = t.select("id", F.when(F.col("k") % 3 == 0, "path").otherwise("sound").alias("source"), F.when(F.col("k") % 3 > 0, F.col("k") % 10 / 100).alias("distance"))
    return _numbered(identity.listed_proposals(rows, t)).select("place", "id", "source")


def _numbered(ordered):
    """Places of rows in a table that is in order: those of its partitions before, and then its own."""
    from ..sources.files import checkpointed

    rows = checkpointed(ordered.withColumn("n", F.monotonically_increasing_id()).withColumn("part", F.spark_partition_id()))
    sizes = {r.part: r["count"] for r in rows.groupBy("part").count().collect()}  # a row a partition
    base, total = {}, 0
    for part in sorted(sizes):
        base[part], total = total, total + sizes[part]
    start = F.create_map(*(F.lit(x) for pair in base.items() for x in pair)) if base else F.create_map(F.lit(0), F.lit(0))
    return rows.withColumn("place", (start[F.col("part")] + F.col("n") - F.shiftleft(F.col("part").cast("long"), 33) + 1).cast("long"))
