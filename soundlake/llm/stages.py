"""Stages of the corpus pipeline; each keeps the columns of its input, the last one adds its own.

Nulls: a row with a null text or doc_id passes all stages; a null text stays null.
Rows that repeat a doc_id and text stay or go together. Extra columns pass,
whatever their names, up to the last stage, which returns texts and places only.
Empty tables pass as empty tables. Texts of any length are read whole. Each stage cuts
Arrow batches by bytes, so that what its Python workers hold doesn't follow the width of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import NULL_ID
from .decontaminate import hits
from .length_buckets import pack, token_counts
from .line_dedup import apply_bitmaps, kept_lines, line_bitmaps
from .near_dedup import near_dedup
from .quality import resample
from .shared import row_key, small_batches, table


def _same_row(docs: DataFrame, other: DataFrame):
    """docs' rows and those of other (__id, __key), nulls as the largest long."""
    return (F.coalesce(docs["doc_id"].cast("long"), F.lit(NULL_ID)) == other["__id"]) & (row_key(docs["text"]) == other["__key"])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes."""
    small_batches(spark)
    taken = resample(docs, table(spark, sf_dir, "labels")).select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("__id"), F.col("row_key").alias("__key")).distinct()
    return docs.join(taken, _same_row(docs, taken), "left_semi")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that an earlier one has."""
    small_batches(spark)
    marked, keep, n_dropped = apply_bitmaps(docs, line_bitmaps(docs))
    order = docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t if k is None else kept_lines(t, k) for t, k in zip(batch.column("text").to_pylist(), batch.column(keep).to_pylist(), strict=True)]
            columns = {name: batch.column(name) for name in order}
            columns["text"] = pa.array(texts, batch.column("text").type)
            if "n_chars" in columns:
                dropped = batch.column(n_dropped).is_valid().to_pylist()
                columns["n_chars"] = pa.array([len(t or "") if d else n for t, d, n in zip(texts, dropped, columns["n_chars"].to_pylist(), strict=True)], columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return marked.mapInArrow(cut, docs.schema)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    small_batches(spark)
    gone = near_dedup(docs).where("not kept").select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["__id"], "left_anti")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    small_batches(spark)
    gone = hits(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("__id"), F.col("row_key").alias("__key"))
    return docs.join(gone, _same_row(docs, gone), "left_anti")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's place in a batch, and its text."""
    small_batches(spark)
    return pack(token_counts(docs, with_text=True))
