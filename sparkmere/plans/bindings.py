"""The test tables bound to the entities of a retrieval dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmere.operators.metrics import Classes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as (doc_id, title, text): ids lead with the source, every fifth title is blank."""
    title = F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.split_part("text", F.lit("\n"), F.lit(1)))
    return table(spark, sf_dir, "documents").select(F.concat_ws("_", "source", "doc_id").alias("doc_id"), title.alias("title"), "text")


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as pairs (pair_id, query, positive, positive_id, positive_title); ids lead with doc_id % 100."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("pair_id"), F.lit("q").alias("query"), F.col("text").alias("positive"), F.concat_ws("_", F.col("doc_id") % 100, "doc_id").alias("positive_id"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("positive_title"))


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """benchmark items as passages wiki_N_0; every tenth has the first line of document N as its title."""
    b = table(spark, sf_dir, "benchmark")
    titles = table(spark, sf_dir, "documents").where("doc_id % 10 = 0").select(F.col("doc_id").alias("item_id"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"))
    return b.join(titles, "item_id", "left").select(F.concat(F.lit("wiki_"), "item_id", F.lit("_0")).alias("doc_id"), F.coalesce("title", F.lit("")).alias("title"), "text")


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("qid"), F.col("text").alias("query"))


def qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels as judgements of 50 queries, in the order of doc_id; those with doc_id % 7 = 3 are of passages that don't exist."""
    source = table(spark, sf_dir, "documents").select("doc_id", "source")
    lab = table(spark, sf_dir, "labels").join(source, "doc_id")
    missing = F.when(F.col("doc_id") % 7 == 3, F.concat(F.lit("none_"), "doc_id")).otherwise(F.concat_ws("_", "source", "doc_id"))
    return lab.select((F.col("doc_id") % 50).cast("string").alias("qid"), missing.alias("doc_id"), F.col("quality").cast("double").alias("rel"), (F.col("quality") > 0).alias("positive"), F.col("doc_id").alias("ord"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """benchmark items as questions on documents: (pair_id, query, positive_id, category)."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.concat_ws("_", "source", "doc_id").alias("positive_id"))
    kind = F.element_at(F.array(*[F.lit(x) for x in ("natural", "vocab_gap", "inflected")]), (F.col("item_id") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "benchmark").join(d, "item_id").select(F.col("item_id").cast("string").alias("pair_id"), F.col("text").alias("query"), "positive_id", kind.alias("category"))


def exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("source IN ('src3', 'src4')").select(F.col("source").alias("article_id")).distinct()


def stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stand-in stem dictionary: the corpus's words without a few endings."""
    from sparkmere.functions.text import tokens

    words = table(spark, sf_dir, "documents").select(F.explode(tokens(F.col("text"))).alias("word")).distinct()
    return words.select("word", F.regexp_replace("word", "(tion|ing|er|en|es|ed)$", "").alias("stem")).where("stem <> ''")


def vectors(spark: SparkSession, sf_dir: str, dims: int = 64) -> tuple[DataFrame, DataFrame, Classes, DataFrame]:
    """Queries, passages, judgements (a query's are the passages of its label) and categories of the embeddings, on their
    first `dims` places: every vector whose id is divisible by 100 against all vectors."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.slice("embedding", 1, dims).alias("vec"), "label")
    q, p = e.where("vec_id % 100 = 0"), e
    rel = Classes(q.select(F.col("vec_id").alias("qid"), "label"), p.select(F.col("vec_id").alias("doc_id"), "label"))
    kind = F.element_at(F.array(*[F.lit(x) for x in ("natural", "inflected", "vocab_gap")]), (F.col("vec_id") % 3 + 1).cast("int"))
    return q.select(F.col("vec_id").alias("qid"), "vec"), p.select(F.col("vec_id").alias("doc_id"), "vec"), rel, q.select(F.col("vec_id").alias("qid"), kind.alias("category"))
