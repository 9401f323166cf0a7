"""Synthetic questions: passage pool, prompt batches, a provider's replies, questions as rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkmere.functions.text import is_question, json_list, seeded_order

from .mining import seeded_sample, without_articles

#: The kinds of question that a reply has for each passage.
KINDS = ("natural", "vocab_gap", "inflected")
MIN_CHARS, N_PASSAGES, BATCH, SEED = 200, 14_000, 5, 13


def passage_pool(corpus: DataFrame, exclude: DataFrame, done: DataFrame, n: int = N_PASSAGES, min_chars: int = MIN_CHARS, seed: int = SEED) -> DataFrame:
    """Up to `n` passages of `min_chars` characters or more, of no excluded article and not done (passage_id) before."""
    long = corpus.where(F.length("text") >= min_chars)
    todo = without_articles(long, exclude).join(done.select(F.col("passage_id").alias("doc_id")), "doc_id", "left_anti")
    return seeded_sample(todo, n, seed)


def batches(pool: DataFrame, batch: int = BATCH, seed: int = SEED) -> DataFrame:
    """(batch_id, j, doc_id, title, text): consecutive chunks in the seeded order. The pool is bounded by its limit."""
    rn = F.row_number().over(Window.orderBy(seeded_order(seed, F.col("doc_id")), "doc_id")) - 1
    return pool.withColumn("_n", rn).withColumn("batch_id", F.floor(F.col("_n") / batch).cast("long")).withColumn("j", F.pmod("_n", F.lit(batch)).cast("int")).drop("_n")


def prompts(rows: DataFrame, head: str = "") -> DataFrame:
    """(batch_id, n, prompt): the head and the passages as "[j] text" lines."""
    got = rows.groupBy("batch_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("j", "text"))).alias("t"))
    return got.select("batch_id", "n", F.concat(F.lit(head), F.array_join(F.transform("t", lambda x: F.format_string("[%d] %s", x.j, x.text)), "\n")).alias("prompt"))


def ask(prompts: DataFrame, provider: Callable[[str], str]) -> DataFrame:
    """(batch_id, reply): null where the provider failed, so the batch's passages come again in the next run."""
    import pandas as pd

    def run(frames):
        for f in frames:
            out = []
            for p in f["prompt"]:
                try:
                    out.append(provider(p))
                except Exception:
                    out.append(None)
            yield pd.DataFrame({"batch_id": f["batch_id"], "reply": out})

    return prompts.select("batch_id", "prompt").mapInPandas(run, "batch_id long, reply string")


def offline_provider(prompt: str) -> str:
    """A stand-in without a network: each passage's first words as questions."""
    import json
    import re

    items = re.findall(r"^\[(\d+)\] (.*)", prompt, re.M)
    return json.dumps([{"i": int(i), "natural": f"{t[:40]}?", "vocab_gap": f"What of {t[:30]}?", "inflected": f"About {t[:30]}?"} for i, t in items], ensure_ascii=False)


def parse_replies(replies: DataFrame) -> DataFrame:
    """(batch_id, j, natural, vocab_gap, inflected) of the replies' items; the last item of an index counts, and an index
    that is no number in the JSON, a text say, is none."""
    found = replies.select("batch_id", json_list(F.col("reply")).alias("l")).where("l IS NOT NULL AND try_parse_json(l) IS NOT NULL")
    each = found.select("batch_id", F.posexplode(F.from_json("l", "array<string>")).alias("p", "raw"))
    field = lambda k: F.expr(f"try_variant_get(try_parse_json(raw), '$.{k}', 'string')")
    number = F.expr("schema_of_variant(variant_get(try_parse_json(raw), '$.i')) = 'BIGINT'")
    items = each.where(number).select("batch_id", field("i").try_cast("int").alias("j"), "p", *[field(k).alias(k) for k in KINDS])
    return items.groupBy("batch_id", "j").agg(*[F.max_by(k, "p").alias(k) for k in KINDS])


def questions(items: DataFrame, rows: DataFrame) -> DataFrame:
    """(query, positive, category, passage_id, positive_title): an item's questions as rows, those too short left out."""
    both = rows.join(items, ["batch_id", "j"])
    flat = both.unpivot(["doc_id", "title", "text"], list(KINDS), "category", "query")
    return flat.where(is_question(F.col("query"))).select(F.regexp_replace("query", r"(?U)^\s+|\s+$", "").alias("query"), F.col("text").alias("positive"), "category", F.col("doc_id").alias("passage_id"), F.col("title").alias("positive_title"))
