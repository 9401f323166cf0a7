"""Training files from ids: texts joined last, unions, triplets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def expand_ids(ids: DataFrame, corpus: DataFrame, key: str = "pair_id") -> DataFrame:
    """(key, query, positive, negatives[], category, miss_neg) from (key, query, positive_id, negative_ids[], category).

    A pair whose positive has no text goes; negatives without a text go one by one, the others keep their order.
    """
    texts = corpus.where("text <> ''").select("doc_id", "text")
    rows = ids.select(key, F.posexplode("negative_ids").alias("pos", "doc_id")).join(texts, "doc_id", "left")
    lists = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("pos", "text")))).alias("n"), F.count_if(F.col("text").isNull()).alias("miss_neg"))
    lists = lists.select(key, F.transform("n", lambda x: x.text).alias("negatives"), "miss_neg")
    pos = ids.drop("positive").join(texts.select(F.col("doc_id").alias("positive_id"), F.col("text").alias("positive")), "positive_id")
    out = pos.drop("negatives").join(lists, key, "left")
    return out.select(key, "query", "positive", F.coalesce("negatives", F.array().cast("array<string>")).alias("negatives"), "category", F.coalesce("miss_neg", F.lit(0)).alias("miss_neg"))


def union_training(*parts: DataFrame) -> DataFrame:
    """All rows of all parts, repeats too; columns that a part lacks are null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def filter_then_take(values: Column, k: int) -> Column:
    """The first `k` of the texts that aren't empty."""
    return F.slice(F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != "")), 1, k)


def take_then_filter(values: Column, k: int) -> Column:
    """Those of the first `k` texts that aren't empty."""
    return F.filter(F.slice(F.coalesce(values, F.array().cast("array<string>")), 1, k), lambda x: x.isNotNull() & (x != ""))


def examples(train: DataFrame, max_neg: int = 4) -> DataFrame:
    """(anchor, positive, negative): one row a negative, or one with a null negative where a pair has none."""
    ok = train.where("query <> '' AND positive <> ''")
    keep = [c for c in ok.columns if c not in ("query", "positive", "negatives", "negative")]
    return ok.select(*keep, F.col("query").alias("anchor"), "positive", F.explode_outer(filter_then_take(F.col("negatives"), max_neg)).alias("negative"))


def triplets(train: DataFrame, max_neg: int = 4) -> DataFrame:
    return examples(train, max_neg).where("negative IS NOT NULL")


def plain_pairs(train: DataFrame, max_neg: int = 4) -> DataFrame:
    return examples(train, max_neg).where("negative IS NULL").drop("negative")


def train_stats(train: DataFrame, max_neg: int = 4, batch_size: int = 128, epochs: int = 2, warmup_ratio: float = 0.1) -> DataFrame:
    """One row: n_triplets, n_pairs, steps_per_epoch (at least one), total_steps, warmup_steps."""
    got = examples(train, max_neg).agg(F.count("negative").alias("n_triplets"), F.count_if(F.col("negative").isNull()).alias("n_pairs"))
    steps = F.greatest(F.lit(1), F.ceil((F.col("n_triplets") + F.col("n_pairs")) / F.lit(float(batch_size)))).cast("long")
    return got.withColumn("steps_per_epoch", steps).withColumn("total_steps", F.col("steps_per_epoch") * epochs).withColumn("warmup_steps", F.floor(F.col("total_steps") * F.lit(float(warmup_ratio))).cast("long"))
