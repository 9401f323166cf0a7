"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialise


def components(nodes: DataFrame, links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, class_id) for each of `nodes` (id): class_id is the least id that links (a, b) reach.

    Large-star and small-star steps in turn (Kiveris et al. 2014): every round links nodes to the least node they see, so
    chains shrink by half and stars are done in a round. A table is written each round; a hub's links are aggregated
    before they meet, and the join on a hub is one that the engine can split.
    """
    edges = materialise(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.where("u <> v")
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = materialise(small, "links")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    roots = edges.groupBy("u").agg(F.min("v").alias("class_id")).withColumnRenamed("u", "id")
    return nodes.select("id").join(roots, "id", "left").select("id", F.coalesce("class_id", "id").alias("class_id"))
