"""Reciprocal rank fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


def rrf(*runs: DataFrame, k: int = RRF_K, top_k: int = 10) -> DataFrame:
    """(qid, doc_id, score, rank): score is the sum of 1 / (k + rank) over the runs (qid, doc_id, rank from 1).

    Ties keep the order of the first run, then of the second, and so on, then ids.
    """
    parts = [r.select("qid", "doc_id", *[(F.col("rank") if i == j else F.lit(None).cast("int")).alias(f"r{j}") for j in range(len(runs))]) for i, r in enumerate(runs)]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    places = [f"r{j}" for j in range(len(runs))]
    rows = rows.groupBy("qid", "doc_id").agg(*[F.min(c).alias(c) for c in places])
    score = sum(F.coalesce(F.lit(1.0) / (F.lit(float(k)) + F.col(c)), F.lit(0.0)) for c in places)
    rows = rows.withColumn("score", score)
    order = Window.partitionBy("qid").orderBy(F.col("score").desc(), *[F.col(c).asc_nulls_last() for c in places], "doc_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k).select("qid", "doc_id", "score", "rank")
