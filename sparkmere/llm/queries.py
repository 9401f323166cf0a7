"""One registered query for each operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontamination, hpylm, mixing, neardup, quality, repeats, secrets, sharding, sql, tokens


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hpylm.score_corpus(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id")
    return sharding.assign_shards(docs).select("doc_id", "shard_slot", "shard")


def op3_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, rows = tokens.write_all_shards(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return tokens.read_shards(rows, path).withColumnRenamed("id", "doc_id")


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeated_passages(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    joined = lambda keep: F.array_join(F.transform(F.filter("spans", keep), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, secrets.KINDS), F.sha2(joined(lambda s: s["kind"] != "format").cast("binary"), 256).alias("base_sha256"), joined(lambda s: F.lit(True)).alias("spans"), "n_candidates")


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    said = F.lit(chat.END + chat.START + "assistant ok")
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    rows = rows.unionByName(own).withColumn("record", F.to_json(F.struct("conv_id", "turn", "role", "text"), {"ignoreNullFields": "false"}))
    turns = chat.canonical_turns(rows, "record", "conv_id", "turn")
    return chat.digest(chat.format_turns(turns)).withColumnRenamed("key", "conv_id")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return quality.apply_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark")
    return decontamination.find_contained(docs, items)


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = mixing.mix(docs)
    return mixed.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), F.col("mix_taken").alias("taken"), F.col("mix_copies").alias("copies"), F.col("mix_part").alias("part"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_score": op1_lm_score,
    "op2_shard": op2_shard,
    "op3_tokens": op3_tokens,
    "op4_repeats": op4_repeats,
    "op5_secrets": op5_secrets,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_chat": op7_chat,
    "op8_quality": op8_quality,
    "op9_decontaminate": op9_decontaminate,
    "op10_mix": op10_mix,
}

ORACLE_SQL: dict[str, str] = {
    "op2_shard": sql.shard_sql(),
    "op4_repeats": sql.REPEATS,
    "op7_chat": sql.CHAT,
    "op8_quality": sql.QUALITY,
    "op9_decontaminate": sql.DECONTAMINATE,
    "op10_mix": sql.MIX,
}
