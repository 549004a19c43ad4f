"""Small things that several operators need from the session."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of rows, about, that one Arrow batch brings to a task's Python worker.
BATCH_BYTES = 500_000


def small_batches(spark: SparkSession) -> None:
    """From now on this session cuts Arrow batches by BATCH_BYTES, so that blocks are small too: a worker keeps what numpy took for its largest block."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where none is named, one of our own in local mode, while a cluster gets an error."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="soundlake-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written to the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder, so that later reads take only the columns that they need."""
    folder = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def unused(name: str, columns: list[str]) -> str:
    """name, or with underscores before it if columns have it."""
    while name.lower() in {c.lower() for c in columns}:
        name = "_" + name
    return name


def id_and_text(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The two columns under fixed names; others, whatever their names, stay out."""
    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))


def row_key(text) -> object:
    """Tells rows apart that share a doc_id; null texts count as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))
