"""Analysis of files as they come: batches of 32, each measured, saved and never measured twice, and put into the stored collection.

A batch's results go to a folder of their own, so a batch that is repeated after a
failure replaces itself, and a stream that starts again goes on where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import merge, recordings, signals, statistics
from ..sources import audio, store
from ..sources import files as files_

#: Fixed value: files of a batch.
BATCH = 32
#: Columns that ranks take in a stored collection.
RANKS = ("energy", "brightness", "compression", "danceability", "provisional")


def arriving(spark: SparkSession, folder: str, files: int = BATCH) -> DataFrame:
    """(path, id, content) of WAV files that come to lie below a folder, as a stream."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[wW][aA][vV]").option("maxFilesPerTrigger", files).load(folder).select("path", files_.content_id(F.col("content"), F.col("length")).alias("id"), "content")


def _measured(batch: DataFrame, own: str) -> DataFrame:
    """(id, status and descriptors) of files (own, content); own names them."""
    chunks = audio.decoded(batch.select(F.col(own).alias("path"), "content")).persist()  # both channels and their mean are made of it
    left, right = (audio.channel(chunks, c).withColumnRenamed("path", "id") for c in (0, 1))
    known = audio.downmixed(chunks).withColumnRenamed("path", "id").persist()
    got = recordings.extract(recordings.resampled(known), recordings.side_ratios(left, right), recordings.cutoffs(known))
    failed = chunks.where("error IS NOT NULL").select(F.col("path").alias("id"), F.lit("undecodable").alias("status"))
    return got.unionByName(failed, allowMissingColumns=True)


def ranked(tracks: DataFrame) -> DataFrame:
    """A collection with ranks made anew, if it has any."""
    ranks = [c for c in RANKS if c in tracks.columns]
    return statistics.rerank(tracks.drop(*ranks)).select(*tracks.columns) if ranks else tracks


def with_batch(tracks: DataFrame, measured: DataFrame) -> DataFrame:
    """The collection after a batch's results; ranks are made anew when it passes the number below which they are provisional."""
    rows = merge.with_results(tracks, measured)
    before, now = (t.agg(F.count_if("analysed").alias("n")).first().n for t in (tracks, rows))
    return ranked(rows) if before < statistics.LEAST_FOR_RANKS <= now else rows


def analyse(stream: DataFrame, results: str, checkpoint: str, table: str | None = None) -> None:
    """Measures all files of a stream (path, id, content) that are there now, at 16 kHz, but for the cutoff and the sides, which need the file's own rate; results lie in ``results``, a folder for each batch.

    table: a stored collection (``store``), into which each batch goes once, whatever is
    repeated after a failure, and whose ranks are made anew at the end. Results then go
    by the id of a file's content, else by its path.
    """
    spark, own = stream.sparkSession, "path" if table is None else "id"
    saved: list[int] = []

    def save(batch: DataFrame, number: int) -> None:
        files = batch.persist()
        _measured(files, own).write.mode("overwrite").parquet(f"{results}/batch={number}")
        if table is not None:
            measured = spark.read.parquet(f"{results}/batch={number}")
            saved.append(store.change(spark, table, lambda tracks: with_batch(tracks, measured), note=f"{checkpoint} {number}"))
        files.unpersist()

    stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    if saved:
        store.change(spark, table, ranked)


def deep_scan(stream: DataFrame, readings: str, checkpoint: str, batches: int | None = None) -> None:
    """Measures where the spectra of all files of a stream (path, id, content) end, from their middle 30 seconds; stops after so many batches, and goes on there when it is called again.

    readings: a folder for each batch, with (id, cutoff_hz, size, duration_sec), as health.cutoff_report takes them; a file that can't be read has no cutoff.
    """
    done: list[int] = []

    def save(batch: DataFrame, number: int) -> None:
        files = batch.select(F.col("id").alias("path"), "content").persist()
        cut = recordings.cutoffs(audio.downmixed(audio.decoded(files, seconds=signals.CUTOFF_SEC)).withColumnRenamed("path", "id"))
        rows = files.select(F.col("path").alias("id"), F.length("content").cast("long").alias("size")).join(audio.lengths(files).withColumnRenamed("path", "id"), "id").join(cut, "id", "left")
        rows.select("id", "cutoff_hz", "size", "duration_sec").write.mode("overwrite").parquet(f"{readings}/batch={number}")
        files.unpersist()
        done.append(number)

    query = stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    while not query.awaitTermination(1):
        if batches is not None and len(done) >= batches:
            query.stop()  # between batches or inside one, which is then measured again


def results(spark: SparkSession, folder: str) -> DataFrame:
    """The newest result of each file."""
    rows = spark.read.option("mergeSchema", "true").parquet(folder)
    return rows.groupBy("id").agg(F.max_by(F.struct(*(c for c in rows.columns if c != "id")), "batch").alias("r")).select("id", "r.*")
