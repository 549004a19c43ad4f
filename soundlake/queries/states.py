"""Queries over streams with a state for each key, made of the events table, and over tags of made files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import names
from ..operators import history, statistics
from ..plans import playback
from ..sources import files, tags
from ..streaming import plays as streams
from ..streaming import states
from . import catalog
from . import relations as R
from .catalog import query
from .signals import _stream

_K = "cast(json_extract_string(props, '$.k') AS bigint)"
_EV = f", ev AS MATERIALIZED (SELECT event_id, user_id, event_type, {_K} AS k, (epoch_us(ts) // 1000) AS at_ms, row_number() OVER (PARTITION BY user_id ORDER BY (epoch_us(ts) // 1000), event_id) AS i FROM events), wm AS (SELECT (epoch_us(max(ts)) // 1000) - 4 * 3600 * 1000 AS wm FROM events)"


def _followed(spark: SparkSession, sf_dir: str, columns: dict[str, Column], machine: states.Machine) -> DataFrame:
    states.ready(spark)
    return streams.run_once(states.followed(_stream(spark, sf_dir, True).withColumns(columns), "user_id", "played_at", "event_id", machine))


@query(_EV + " SELECT user_id, concat('t', cast(k % 3 AS varchar)) AS track_id, at_ms, event_id FROM (SELECT *, lag(k % 3) OVER (PARTITION BY user_id ORDER BY i) AS before FROM ev WHERE k % 5 <> 4), wm WHERE at_ms <= wm AND (before IS NULL OR before <> k % 3)")
def stream_changes(spark, sf_dir):
    """Plays recorded as players move to other recordings; a player that names none changes nothing."""
    return _followed(spark, sf_dir, {"track_id": F.when(F.col("k") % 5 != 4, F.concat(F.lit("t"), (F.col("k") % 3).cast("string")))}, states.CHANGES)


_MARKS = ", m AS (SELECT user_id, event_type AS stage, at_ms, i, CASE event_type WHEN 'signup' THEN 'done' WHEN 'error' THEN 'failed' ELSE 'stage' END AS kind FROM ev), t AS (SELECT user_id, stage, at_ms, kind, lead(at_ms) OVER w - at_ms AS ms, lead(kind) OVER w AS next, lead(at_ms) OVER w AS until FROM m WINDOW w AS (PARTITION BY user_id ORDER BY i))"


def _kind() -> Column:
    return F.when(F.col("event_type") == "signup", "done").when(F.col("event_type") == "error", "failed").otherwise("stage")


@query(_EV + _MARKS + " SELECT user_id AS job, stage, ms FROM t WHERE kind = 'stage' AND next <> 'failed'")
def job_times(spark, sf_dir):
    """Times in stages of jobs, some of which fail."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return history.job_times(e.select(F.col("user_id").alias("job"), F.col("event_type").alias("stage"), _kind().alias("kind"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("number")))


@query(_EV + _MARKS + " SELECT user_id, stage, at_ms, ms FROM t, wm WHERE kind = 'stage' AND next <> 'failed' AND until <= wm")
def stream_job_times(spark, sf_dir):
    """The same from a stream, as far as the watermark has come."""
    return _followed(spark, sf_dir, {"kind": _kind(), "stage": F.col("event_type")}, states.STAGES)


_JOB_MS = 12 * 3600 * 1000
_FILES = (
    ", r AS (SELECT user_id, i, at_ms, CASE event_type WHEN 'signup' THEN 'found' WHEN 'view' THEN 'taken' WHEN 'click' THEN 'decoded' WHEN 'purchase' THEN 'saved' ELSE CASE WHEN k % 9 = 0 THEN 'unreadable' ELSE 'failed' END END AS kind, cast(k AS varchar) AS message FROM ev, wm WHERE at_ms <= wm)"
    ", s(user_id, i, status, attempts, since, late, moved, at_ms, error) AS (SELECT DISTINCT user_id, cast(0 AS bigint), cast(NULL AS varchar), cast(0 AS bigint), cast(NULL AS bigint), cast(NULL AS bigint), false, cast(NULL AS bigint), cast(NULL AS varchar) FROM r UNION ALL"
    " SELECT user_id, i, CASE WHEN moved THEN new ELSE status END, CASE WHEN moved AND new = 'pending' THEN 0 ELSE attempts + CASE WHEN moved AND new IN ('failed', 'unsupported') THEN 1 ELSE 0 END END, CASE WHEN NOT moved THEN since WHEN new IN ('decoding', 'analyzing') THEN at_ms END, late, moved, at_ms, CASE WHEN moved AND new IN ('failed', 'unsupported') THEN message END FROM ("
    "  SELECT *, CASE kind WHEN 'found' THEN status IS NULL WHEN 'taken' THEN coalesce(status = 'pending' OR status = 'failed' AND attempts < 3, false) WHEN 'decoded' THEN coalesce(status = 'decoding', false) WHEN 'saved' THEN coalesce(status = 'analyzing', false) ELSE coalesce(status IN ('decoding', 'analyzing'), false) END AS moved, CASE kind WHEN 'found' THEN 'pending' WHEN 'taken' THEN 'decoding' WHEN 'decoded' THEN 'analyzing' WHEN 'saved' THEN 'done' WHEN 'failed' THEN 'failed' ELSE 'unsupported' END AS new FROM ("
    f"   SELECT r.user_id, r.i, r.at_ms, r.kind, r.message, CASE WHEN s.since + {_JOB_MS} <= r.at_ms THEN 'failed' ELSE s.status END AS status, s.attempts + CASE WHEN s.since + {_JOB_MS} <= r.at_ms THEN 1 ELSE 0 END AS attempts, CASE WHEN s.since + {_JOB_MS} > r.at_ms THEN s.since END AS since, CASE WHEN s.since + {_JOB_MS} <= r.at_ms THEN s.since + {_JOB_MS} END AS late FROM s JOIN r ON r.user_id = s.user_id AND r.i = s.i + 1)))"
    ", p AS (SELECT *, lag(attempts) OVER (PARTITION BY user_id ORDER BY i) AS had, lag(since) OVER (PARTITION BY user_id ORDER BY i) AS was, row_number() OVER (PARTITION BY user_id ORDER BY i DESC) AS back FROM s)"
    " SELECT user_id, at_ms, status, attempts, error FROM s WHERE moved UNION ALL SELECT user_id, late, 'failed', had + 1, 'timeout' FROM p WHERE late IS NOT NULL"
    f" UNION ALL SELECT user_id, since + {_JOB_MS}, 'failed', attempts + 1, 'timeout' FROM p, wm WHERE back = 1 AND since + {_JOB_MS} <= wm"
)


@query(_EV + _FILES)
def stream_file_states(spark, sf_dir):
    """Every change of state of files that are found, taken, decoded and saved, fail or take longer than half a day."""
    kind = F.when(F.col("event_type") == "signup", "found").when(F.col("event_type") == "view", "taken").when(F.col("event_type") == "click", "decoded").when(F.col("event_type") == "purchase", "saved").when(F.col("k") % 9 == 0, "unreadable").otherwise("failed")
    return _followed(spark, sf_dir, {"kind": kind, "message": F.col("k").cast("string")}, states.files(_JOB_MS)).withColumn("attempts", F.col("attempts").cast("long"))


_QUEUE = (
    ", r AS (SELECT user_id, i, at_ms, event_id, CASE WHEN event_type = 'purchase' THEN 'planned' WHEN event_type = 'error' AND k % 4 = 0 THEN 'holds' ELSE 'moved' END AS kind, CASE WHEN event_type = 'signup' THEN NULL ELSE concat('t', cast(k % 7 AS varchar)) END AS track_id, list_transform(range(1, 1 + k % 5), lambda x: concat('t', cast((k + 2 * x) % 7 AS varchar))) AS ids FROM ev, wm WHERE at_ms <= wm)"
    ", s(user_id, i, playing, place, plan, held, handed, short, at_ms, event_id, played, given) AS (SELECT DISTINCT user_id, cast(0 AS bigint), cast(NULL AS varchar), cast(NULL AS varchar), cast([] AS varchar[]), cast([] AS varchar[]), cast([] AS varchar[]), false, cast(NULL AS bigint), cast(NULL AS bigint), cast(NULL AS varchar), cast([] AS varchar[]) FROM r UNION ALL"
    " SELECT user_id, i, playing, place, plan[len(given) + 1:], list_concat(held, given), list_concat(handed, given), CASE kind WHEN 'moved' THEN need > len(plan) WHEN 'planned' THEN false ELSE short END, at_ms, event_id, played, given FROM ("
    "  SELECT *, CASE WHEN need > 0 AND (kind = 'moved' AND len(plan) >= need OR kind = 'planned' AND short) THEN plan[1:need] ELSE cast([] AS varchar[]) END AS given FROM ("
    "   SELECT *, 2 - CASE WHEN list_contains(held, place) THEN len(held) - list_position(held, place) ELSE len(held) END AS need FROM ("
    "    SELECT r.user_id, r.i, r.kind, r.at_ms, r.event_id, s.short, CASE WHEN r.kind = 'moved' THEN coalesce(r.track_id, s.playing) ELSE s.playing END AS playing, CASE WHEN r.kind = 'moved' THEN r.track_id ELSE s.place END AS place, CASE WHEN r.kind = 'moved' AND r.track_id IS DISTINCT FROM s.playing THEN r.track_id END AS played,"
    "     CASE WHEN r.kind = 'planned' THEN list_filter(r.ids, lambda x: NOT list_contains(s.held, x)) ELSE s.plan END AS plan, CASE WHEN r.kind = 'holds' THEN r.ids ELSE s.held END AS held,"
    "     CASE WHEN r.kind = 'holds' THEN cast([] AS varchar[]) WHEN r.kind = 'moved' AND r.track_id IS DISTINCT FROM s.playing AND list_contains(s.handed, r.track_id) THEN s.handed[list_position(s.handed, r.track_id) + 1:] ELSE s.handed END AS handed FROM s JOIN r ON r.user_id = s.user_id AND r.i = s.i + 1))))"
    " SELECT user_id, at_ms, event_id AS number, played, array_to_string(given, ',') AS given, short AS wants_plan, array_to_string(list_concat(handed, plan), ',') AS upcoming FROM s WHERE i > 0"
)


@query(_EV + _QUEUE)
def stream_queue(spark, sf_dir):
    """What players are handed, and what they have to come, as they move on and plans arrive."""
    t = lambda x: F.concat(F.lit("t"), (x % 7).cast("string"))
    kind = F.when(F.col("event_type") == "purchase", "planned").when((F.col("event_type") == "error") & (F.col("k") % 4 == 0), "holds").otherwise("moved")
    ids = F.when(F.col("k") % 5 > 0, F.transform(F.sequence(F.lit(1).cast("long"), F.greatest(F.lit(1), F.col("k") % 5)), lambda x: t(F.col("k") + 2 * x))).otherwise(F.array().cast("array<string>"))
    got = _followed(spark, sf_dir, {"kind": kind, "track_id": F.when(F.col("event_type") != "signup", t(F.col("k"))), "ids": ids}, states.QUEUE)
    return got.withColumns({c: F.array_join(c, ",") for c in ("given", "upcoming")})


@query("SELECT id, title, artist, album, year, CASE WHEN track_no > 0 THEN track_no END AS track_no, cast(k % 2 = 0 AS boolean) AS has_cover_art FROM tracks")
def tags_roundtrip(spark, sf_dir):
    """Tags written as bytes of three kinds of files, and read back."""
    t = R.tracks(spark, sf_dir)
    let = lambda value, f: F.transform(F.array(value), f)[0]
    size = lambda n, digits: F.unhex(F.lpad(F.hex(n), digits, "0"))
    little = lambda n: F.reverse(F.array(*(F.substring(F.lpad(F.hex(n), 8, "0"), 2 * i + 1, 2) for i in range(4))))
    small = lambda n: F.unhex(F.array_join(little(n), ""))
    put = lambda name, value: F.coalesce(let(value, lambda b: F.concat(F.encode(F.lit(name), "US-ASCII"), size(F.length(b), 8), F.unhex(F.lit("0000")), b)), F.unhex(F.lit("")))
    wide = lambda c: F.concat(F.unhex(F.lit("01")), F.encode(F.col(c).cast("string"), "UTF-16"))
    narrow = lambda c: F.concat(F.unhex(F.lit("03")), F.encode(F.col(c).cast("string"), "UTF-8"))
    seven = lambda n: F.concat(*(F.unhex(F.lpad(F.hex(F.shiftright(n, s).bitwiseAND(127)), 2, "0")) for s in (21, 14, 7, 0)))

    def id3(version: int, text) -> Column:
        cover = F.when(F.col("k") % 2 == 0, F.unhex(F.lit("00")))
        body = F.concat(put("TIT2", text("title")), put("TPE1", text("artist")), put("TALB", text("album")), put("TDRC" if version == 4 else "TYER", text("year")), put("TRCK", text("track_no")), put("APIC", cover))
        return let(body, lambda b: F.concat(F.encode(F.lit("ID3"), "US-ASCII"), F.unhex(F.lit(f"0{version}0000")), seven(F.length(b)), b, F.unhex(F.lit("FFFB9000"))))

    def flac() -> Column:
        line = lambda name, c: F.concat(F.lit(f"{name}="), F.col(c).cast("string"))
        lines = F.filter(F.array(line("TITLE", "title"), line("Artist", "artist"), line("ALBUM", "album"), line("date", "year"), line("TRACKNUMBER", "track_no"), F.when(F.col("k") % 2 == 0, F.lit("METADATA_BLOCK_PICTURE=AA"))), lambda x: x.isNotNull())
        framed = let(lines, lambda all_: F.concat(small(F.lit(0)), small(F.size(all_)), F.aggregate(all_, F.unhex(F.lit("")), lambda a, x: F.concat(a, small(F.length(F.encode(x, "UTF-8"))), F.encode(x, "UTF-8")))))
        return let(framed, lambda b: F.concat(F.encode(F.lit("fLaC"), "US-ASCII"), F.unhex(F.lit("84")), size(F.length(b), 6), b))

    made = (id3(3, wide), id3(4, narrow), flac())
    some = [t.where(F.col("k") % 3 == i).select("id", c.alias("content")) for i, c in enumerate(made)]
    return tags.with_tags(some[0].unionByName(some[1]).unionByName(some[2])).select("id", "title", "artist", "album", "year", "track_no", "has_cover_art")


@query("SELECT folder AS list_id, cast(k AS varchar) AS want, CASE min(k) OVER (PARTITION BY folder) % 3 WHEN 0 THEN concat('A\"', cast(k AS varchar)) ELSE concat('A', cast(k AS varchar)) END AS artist, title FROM tracks WHERE title IS NOT NULL")
def wants_pasted(spark, sf_dir):
    """Lists of three forms, a table with quoted cells and line ends, a playlist and plain lines, read as one table of texts."""
    t = R.tracks(spark, sf_dir).where("title IS NOT NULL").select("folder", "k", "title", (F.min("k").over(Window.partitionBy("folder")) % 3).alias("form"))  # the recordings of one folder
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    artist = F.concat(F.when(F.col("form") == 0, 'A"').otherwise("A"), F.col("k").cast("string"))
    cells = F.concat_ws(",", quoted(F.concat(artist, F.lit(", someone else"))), quoted(F.lit("a note,\r\nin two lines")), quoted(F.col("title")))
    line = F.concat_ws(" - ", artist, "title")
    each = F.when(F.col("form") == 0, cells).when(F.col("form") == 1, F.concat(F.lit("#EXTINF:1,"), line, F.lit("\nsome/path.mp3"))).otherwise(line)
    texts = t.groupBy(F.col("folder").alias("list_id"), "form").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", each.alias("line")))), lambda s: s["line"]), "\r\n").alias("body"))
    head = F.when(F.col("form") == 0, "Artist Name(s),Remark,Track Name\r\n").when(F.col("form") == 1, "#EXTM3U\n").otherwise("# a list\n")
    got = files.wants_of(texts.select("list_id", F.concat(head, "body").alias("text")))
    return got.select("list_id", F.regexp_extract("artist", r"(\d+)$", 1).alias("want"), "artist", "title")


_SIDE = "lead(struct_pack(id := id, n := track_no, head := head_ratio, tail := tail_ratio, f := file_name, album := {0}, l := {1})) OVER w".format(catalog._FOLDED, catalog._LEADING)


@query(
    catalog.REFERENCE
    + f", p AS (SELECT *, {_SIDE} AS nx, lead(id) OVER w AS next_id, count(*) OVER (PARTITION BY folder) - row_number() OVER w AS remaining, {catalog._FOLDED} AS album_, {catalog._LEADING} AS l_, 20 * log10(loudness) AS level, (SELECT db FROM reference) AS db FROM tracks WINDOW w AS (PARTITION BY folder ORDER BY k))"
    " SELECT folder AS list_id, k AS pos, id, coalesce(title, file_name) AS title, coalesce(artist, '') AS artist, round(duration_sec, 6) AS duration_sec, CASE WHEN bpm > 0 AND intro_beat_sec IS NOT NULL THEN round(bpm, 6) END AS intro_bpm, CASE WHEN bpm > 0 THEN round(outro_beat_sec, 6) END AS outro_beat_sec,"
    " CASE WHEN analysed THEN round(CASE WHEN least(12, greatest(-12, db - level)) <= 0 THEN least(12, greatest(-12, db - level)) WHEN crest > 0 THEN greatest(0, least(least(12, db - level), -(level + 20 * log10(crest)) - 2)) ELSE 0 END, 6) ELSE 0 END AS trim_db, sound_end_sec, next_id, remaining,"
    " coalesce(analysed AND tail_ratio > 0.5 AND nx.head > 0.5 AND file_name <> nx.f AND (coalesce(track_no + 1 = nx.n AND album_ = nx.album AND album_ <> '', false) OR coalesce(l_ + 1 = nx.l, false)), false) AS joined FROM p"
)
def playback_rows(spark, sf_dir):
    """Folders as playlists: what a player needs of each position."""
    t = R.tracks(spark, sf_dir)
    got = playback.playback(t.select(F.col("folder").alias("list_id"), F.col("k").alias("pos"), "id"), t, statistics.reference_level(t))
    return got.select("list_id", "pos", "id", "title", "artist", "duration_sec", F.col("intro.bpm").alias("intro_bpm"), F.col("outro.beat_sec").alias("outro_beat_sec"), "trim_db", "sound_end_sec", "next_id", "remaining", "joined")


_STEM = "coalesce(title, regexp_replace(file_name, '\\.[^.]+$', ''))"


@query(f"SELECT id, concat_ws(' - ', artist, {_STEM}) AS full_title, concat(concat_ws(' — ', artist, {_STEM}), CASE WHEN duration_sec > 0 THEN concat(' · ', cast(floor(size * 8 / duration_sec / 1000 + 0.5) AS bigint), 'k') ELSE '' END) AS label, CASE WHEN analysed THEN concat(CASE WHEN bpm > 0 THEN cast(cast(floor(bpm + 0.5) AS bigint) AS varchar) ELSE '--' END, ' · ', key_scale) ELSE '' END AS tempo_and_key, concat('set-', strftime(make_timestamp(last_modified * 86400000), '%Y-%m-%d'), '.m3u') AS file FROM tracks")
def display_names(spark, sf_dir):
    """How recordings are called in lines, lists and files."""
    c = F.col
    return R.tracks(spark, sf_dir).select("id", names.full_title(c("artist"), c("title"), c("file_name")).alias("full_title"), names.label(c("artist"), c("title"), c("file_name"), c("size"), c("duration_sec")).alias("label"), names.tempo_and_key(c("bpm"), c("key_scale")).alias("tempo_and_key"), names.dated("set", c("last_modified") * 86_400, "m3u").alias("file"))
