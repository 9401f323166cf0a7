"""Candidate pools and hard negatives."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkmere.functions.text import article_id, first_present, seeded_order, tokens

from .lexical import Analyzer, bm25_topk

POOL, N_NEG, RANK_START, TOP_K, SEED = 80_000, 4, 2, 50, 13


def seeded_sample(rows: DataFrame, n: int, seed: int = SEED, key: str = "doc_id") -> DataFrame:
    """`n` rows by a reproducible shuffle."""
    return rows.orderBy(seeded_order(seed, F.col(key)), key).limit(n)


def without_articles(corpus: DataFrame, exclude: DataFrame) -> DataFrame:
    return corpus.withColumn("article_id", article_id(F.col("doc_id"))).join(exclude.select("article_id"), "article_id", "left_anti").select(*corpus.columns)


def candidate_pool(corpus: DataFrame, pairs: DataFrame, exclude: DataFrame, pool_sample: int = POOL, seed: int = SEED) -> DataFrame:
    """The pairs' positives that the corpus has, excluded or not, topped up to `pool_sample` with other allowed passages."""
    pos = pairs.select(F.col("positive_id").alias("doc_id")).distinct()
    own = corpus.join(pos, "doc_id", "left_semi")
    rest = without_articles(corpus, exclude).join(pos, "doc_id", "left_anti")
    return own.unionByName(seeded_sample(rest, max(0, pool_sample - own.count()), seed))


def with_positive_id(pairs: DataFrame) -> DataFrame:
    if "passage_id" not in pairs.columns:
        return pairs.withColumn("positive_id", F.coalesce("positive_id", F.lit("")))
    old = F.col("positive_id") if "positive_id" in pairs.columns else F.lit(None).cast("string")
    return pairs.withColumn("positive_id", F.coalesce(first_present(old, F.col("passage_id")), F.lit("")))


def mine_negatives(pairs: DataFrame, pool: DataFrame, n_neg: int = N_NEG, rank_start: int = RANK_START, top_k: int = TOP_K, analyzer: Analyzer = tokens, stems: DataFrame | None = None, key: str = "pair_id") -> DataFrame:
    """(key, negative_id, rank, pos): each pair's hard negatives in order, pos from 1, rank the raw one from 0.

    Of a query's `top_k` passages the first `rank_start` are passed over whatever they are; of the others those count that
    are neither the positive nor of its article.
    """
    p = with_positive_id(pairs)
    ranked = bm25_topk(p.select(F.col(key).alias("qid"), "query"), pool, top_k, analyzer, stems)
    rows = ranked.join(p.select(F.col(key).alias("qid"), "positive_id"), "qid").withColumn("raw", F.col("rank") - 1)
    ok = (F.col("raw") >= rank_start) & (F.col("doc_id") != F.col("positive_id")) & (article_id(F.col("doc_id")) != article_id(F.col("positive_id")))
    pos = F.row_number().over(Window.partitionBy("qid").orderBy("raw"))
    got = rows.where(ok).withColumn("pos", pos).where(F.col("pos") <= n_neg)
    return got.select(F.col("qid").alias(key), F.col("doc_id").alias("negative_id"), F.col("raw").alias("rank"), "pos")


def with_negatives(pairs: DataFrame, mined: DataFrame, pool: DataFrame | None = None, key: str = "pair_id") -> DataFrame:
    """`pairs` with negative_ids[] and, from `pool`, negatives[] in order."""
    m = mined
    if pool is not None:
        m = m.join(pool.select(F.col("doc_id").alias("negative_id"), "text"), "negative_id")
    fields = ["pos", "negative_id"] + (["text"] if pool is not None else [])
    lists = m.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("n"))
    cols = [F.transform("n", lambda x: x.negative_id).alias("negative_ids")] + ([F.transform("n", lambda x: x.text).alias("negatives")] if pool is not None else [])
    lists = lists.select(key, *cols)
    out = with_positive_id(pairs).drop("negatives", "negative_ids").join(lists, key, "left")
    none = F.array().cast("array<string>")
    for c in lists.columns[1:]:
        out = out.withColumn(c, F.coalesce(c, none))
    return out
