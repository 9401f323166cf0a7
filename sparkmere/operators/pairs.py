"""Training pairs from topics, judgements and passages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_NEGATIVES = 8


def build_pairs(corpus: DataFrame, topics: DataFrame, qrels: DataFrame, max_neg: int = MAX_NEGATIVES, split: str = "train") -> DataFrame:
    """One row a judged positive that has a query and a text: query, positive, negatives[], query_id, positive_id,
    negative_ids[], positive_title, split, ord.

    A query's negatives are its first `max_neg` in file order, and only then are those without a text left out; every
    positive of the query carries the same list. Texts are joined to the few judged ids, never to ranked or copied lists.
    """
    texts = corpus.where("text <> ''").select("doc_id", "title", "text")
    queries = topics.where("query <> ''").select("qid", "query")
    negatives = negative_lists(texts, qrels, max_neg)
    positives = qrels.where("positive").select("qid", "doc_id", "ord")
    rows = positives.join(queries, "qid").join(texts, "doc_id").join(negatives, "qid", "left")
    none = F.array().cast("array<string>")
    return rows.select("query", F.col("text").alias("positive"), F.coalesce("negatives", none).alias("negatives"), F.col("qid").alias("query_id"), F.col("doc_id").alias("positive_id"), F.coalesce("negative_ids", none).alias("negative_ids"), F.col("title").alias("positive_title"), F.lit(split).alias("split"), "ord")


def first_negatives(qrels: DataFrame, max_neg: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("ord", "doc_id"))
    return qrels.where("NOT positive").select("qid", "doc_id", rank.alias("rank")).where(F.col("rank") <= max_neg)


def negative_lists(texts: DataFrame, qrels: DataFrame, max_neg: int) -> DataFrame:
    got = first_negatives(qrels, max_neg).join(texts.select("doc_id", "text"), "doc_id")
    got = got.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "text"))).alias("n"))
    return got.select("qid", F.transform("n", lambda x: x.text).alias("negatives"), F.transform("n", lambda x: x.doc_id).alias("negative_ids"))


def pair_stats(corpus: DataFrame, topics: DataFrame, qrels: DataFrame, max_neg: int = MAX_NEGATIVES) -> DataFrame:
    """One row: queries, missing_query (queries without text), missing_pos_doc, missing_neg_doc, pairs, neg_total (negatives over all pairs), with_negatives."""
    have = corpus.where("text <> ''").select("doc_id", F.lit(1).alias("has"))
    per = qrels.groupBy("qid").agg(F.count_if("positive").alias("n_pos"))
    per = per.join(topics.where("query <> ''").select("qid", F.lit(1).alias("asked")), "qid", "left")
    pos = qrels.where("positive").join(have, "doc_id", "left").groupBy("qid").agg(F.count("has").alias("pos_found"), F.count_if(F.col("has").isNull()).alias("pos_missing"))
    neg = first_negatives(qrels, max_neg).join(have, "doc_id", "left").groupBy("qid").agg(F.count("has").alias("neg_found"), F.count_if(F.col("has").isNull()).alias("neg_missing"))
    rows = per.join(pos, "qid", "left").join(neg, "qid", "left").na.fill(0, ["pos_found", "pos_missing", "neg_found", "neg_missing"])
    ok = F.col("asked").isNotNull()
    total = lambda x: F.coalesce(F.sum(F.when(ok, x)), F.lit(0)).cast("long")
    return rows.agg(F.count("*").alias("queries"), F.count_if(~ok).alias("missing_query"), total(F.col("pos_missing")).alias("missing_pos_doc"), total(F.col("neg_missing")).alias("missing_neg_doc"), total(F.col("pos_found")).alias("pairs"), total(F.col("pos_found") * F.col("neg_found")).alias("neg_total"), total(F.when(F.col("neg_found") > 0, F.col("pos_found")).otherwise(0)).alias("with_negatives"))
