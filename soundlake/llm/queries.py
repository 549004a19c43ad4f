"""Queries of the operators over the whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, chat_repair, media, oracles, secrets, token_files
from .decontaminate import decontaminate
from .length_buckets import pack, token_counts
from .line_dedup import line_dedup
from .near_dedup import near_dedup
from .quality import resample
from .shared import table
from .substring_dedup import substring_dedup
from .suffix_dedup import suffix_dedup
from .target_resampling import target_resampling


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.digest(secrets.find_secrets(docs, secrets.train(secrets.labelled_samples(docs))))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents")).drop("spans")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(token_counts(table(spark, sf_dir, "documents")))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).drop("keep")


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.describe(media.store_texts(table(spark, sf_dir, "documents")))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    says = "\\### Assistant: </turn> ok"
    planted = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.explode(F.array(F.struct(F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role")), F.struct(F.lit(1).cast("long").alias("turn"), F.lit("assistant").alias("role")))).alias("t")).select("conv_id", "t.turn", "t.role", F.lit(says).alias("text"))
    return chat.read_back(chat.format_conversations(turns.unionByName(planted)))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents taken; those that are missing are rejected."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "weight", F.col("key").alias("gumbel_key"), F.lit(True).alias("kept"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"), shingle=2)


def op11_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_files.new_folder(spark)
    token_files.write_tokens(table(spark, sf_dir, "documents"), folder)
    return token_files.digests(token_files.read_documents(spark, folder))


def op12_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return target_resampling(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("n_words")


def op13_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_repair.digest(chat_repair.repair_conversations(chat_repair.damage(table(spark, sf_dir, "conversations"))))


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_suffix_dedup, op3_decontaminate, op4_pack, op5_substring_dedup, op6_media, op7_chat, op8_line_dedup, op9_quality, op10_near_dedup, op11_tokens, op12_target_resampling, op13_chat_repair)}
ORACLE_SQL: dict[str, str] = {"op3_decontaminate": oracles.LEAKS, "op5_substring_dedup": oracles.SUBSTRINGS, "op7_chat": oracles.CHAT, "op8_line_dedup": oracles.LINES, "op10_near_dedup": oracles.NEAR, "op12_target_resampling": oracles.RESAMPLING, "op13_chat_repair": oracles.REPAIR}
