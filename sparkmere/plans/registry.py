"""The registered queries and their SQL (in ``oracles``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkmere.functions import text as X
from sparkmere.operators import assemble, dense, fusion, lexical, metrics, mining, overlap, pairs, synth
from sparkmere.operators.metrics import Classes
from sparkmere.sources import readers, writers

from . import bindings as T
from . import files, oracles

NEAR = 0.1


def tokenize_docs(s: SparkSession, d: str) -> DataFrame:
    t = T.table(s, d, "documents").select("doc_id", X.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct"))


def shingle_counts(s: SparkSession, d: str) -> DataFrame:
    t = T.table(s, d, "documents").select("doc_id", X.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size(X.shingle_hashes(F.col("t"))).alias("n_shingles"))


def scalar_functions(s: SparkSession, d: str) -> DataFrame:
    p = T.table(s, d, "pages").select("page_id", "url", F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"))
    return p.select("page_id", X.cache_key(F.col("url")).alias("cache_key"), X.norm_title(F.concat(F.lit("  "), "title", F.lit(" \t "))).alias("norm"), X.is_question(F.col("title")).alias("is_question"), X.is_trivial(F.split_part("url", F.lit("/"), F.lit(5))).alias("trivial"), X.first_present(F.when(F.col("page_id") % 2 == 0, ""), F.col("title")).alias("first"))


def norm_titles_overlap(s: SparkSession, d: str) -> DataFrame:
    p = T.table(s, d, "pages").select("page_id", F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"))
    return overlap.title_hits(p.where("page_id % 2 = 1"), p.where("page_id % 2 = 0"), "page_id", "title")


def article_id_overlap(s: SparkSession, d: str) -> DataFrame:
    return overlap.article_hits(T.numbered(s, d), T.benchmark(s, d)).withColumnRenamed("pair_id", "doc_id")


def near_dup_benchmark(s: SparkSession, d: str) -> DataFrame:
    got = overlap.near_duplicates(T.numbered(s, d), T.benchmark(s, d), NEAR)
    return got.select("pair_id", "doc_id", F.round("jaccard", 6).alias("jaccard"))


def near_dup_best(s: SparkSession, d: str) -> DataFrame:
    got = overlap.best_match(T.numbered(s, d), T.benchmark(s, d), NEAR)
    return got.select("pair_id", F.round("jaccard", 6).alias("jaccard"))


def _judged(s: SparkSession, d: str) -> DataFrame:
    return overlap.with_reason(T.numbered(s, d), T.benchmark(s, d), NEAR, drop_by_article_id=True)


def overlap_cascade(s: SparkSession, d: str) -> DataFrame:
    return _judged(s, d).select("pair_id", "article_hit", "reason")


def overlap_report(s: SparkSession, d: str) -> DataFrame:
    return overlap.report(_judged(s, d), T.benchmark(s, d))


def clean_negatives(s: SparkSession, d: str) -> DataFrame:
    n = T.numbered(s, d)
    lists = n.groupBy(F.floor(F.col("pair_id") / 10).alias("pair_id")).agg(F.array_sort(F.collect_list(F.struct("pair_id", "positive", "positive_id"))).alias("l"))
    p = lists.select("pair_id", F.transform("l", lambda x: x.positive).alias("negatives"), F.transform("l", lambda x: x.positive_id).alias("negative_ids"))
    got = overlap.clean_negatives(p, T.benchmark(s, d), NEAR, drop_by_article_id=True)
    return got.select("pair_id", F.array_join("negative_ids", ",").alias("negative_ids"), F.size("negatives").alias("n_kept"), "n_stripped")


def build_pairs(s: SparkSession, d: str) -> DataFrame:
    got = pairs.build_pairs(T.corpus(s, d), T.topics(s, d), T.qrels(s, d))
    return got.select("query_id", "positive_id", "positive_title", F.length("query").alias("q_chars"), F.length("positive").alias("p_chars"), F.array_join("negative_ids", ",").alias("negative_ids"), F.size("negatives").alias("n_neg"))


def pair_stats(s: SparkSession, d: str) -> DataFrame:
    return pairs.pair_stats(T.corpus(s, d), T.topics(s, d), T.qrels(s, d))


def corpus_last_wins(s: SparkSession, d: str) -> DataFrame:
    c = T.table(s, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ord"), "role", "text")
    return readers.last_wins(c, "doc_id", ["role", "text"], ["ord"])


def qrels_split(s: SparkSession, d: str) -> DataFrame:
    q, doc, rel = (F.col("doc_id") % 50).cast("string"), F.concat(F.lit("d"), "doc_id"), F.col("quality").cast("string")
    kinds = [F.concat_ws(" ", q, F.lit("0"), doc, rel), F.concat_ws("\t", q, doc, rel), F.concat_ws("  ", q, doc), F.concat_ws(" ", q, F.lit("0"), doc, F.lit("x")), F.concat_ws(" ", q, F.lit("0"), doc, F.lit("-1.5")), doc]
    line = F.element_at(F.array(*kinds), (F.col("doc_id") % 6 + 1).cast("int"))
    lines = T.table(s, d, "labels").select(line.alias("value"), F.lit("f").alias("file"), F.col("doc_id").alias("line_ord"))
    return readers.parse_qrels(lines).select("qid", "doc_id", "rel", "positive")


def loader_lines(s: SparkSession, d: str) -> DataFrame:
    """Corpus lines of both formats, later records of an id replacing earlier ones."""
    t = T.table(s, d, "conversations").select((F.col("conv_id") % 40).alias("c"), F.col("conv_id"), "turn", F.regexp_replace("text", r"[\t\n\"\\]", " ").alias("text"))
    json = F.concat(F.lit('{"docid": '), "c", F.lit(', "heading": "h'), "turn", F.lit('", "contents": "'), "text", F.lit('"}'))
    tsv = F.concat_ws("\t", "c", F.concat(F.lit("h"), "turn"), "text", F.lit("rest"))
    line = F.when(F.col("conv_id") % 5 == 4, "{bad").when(F.col("conv_id") % 2 == 0, json).otherwise(tsv)
    name = F.when((F.col("conv_id") % 2 == 0) | (F.col("conv_id") % 5 == 4), "a.jsonl").otherwise("b.tsv")
    lines = t.select(line.alias("value"), name.alias("file"), (F.col("conv_id") * 100 + F.col("turn")).alias("line_ord"))
    return readers.parse_corpus(lines)


def candidate_pool(s: SparkSession, d: str) -> DataFrame:
    return mining.candidate_pool(T.corpus(s, d), T.questions(s, d), T.exclusions(s, d)).select("doc_id")


def resume_filter(s: SparkSession, d: str) -> DataFrame:
    done = T.corpus(s, d).where(F.length("text") % 2 == 0).select(F.col("doc_id").alias("passage_id"))
    return synth.passage_pool(T.corpus(s, d), T.exclusions(s, d), done).select("doc_id")


def _batches(s: SparkSession, d: str) -> DataFrame:
    none = T.corpus(s, d).where("false").select(F.col("doc_id").alias("passage_id"))
    return synth.batches(synth.passage_pool(T.corpus(s, d), T.exclusions(s, d), none))


def prompt_batches(s: SparkSession, d: str) -> DataFrame:
    return synth.prompts(_batches(s, d)).select("batch_id", "n", F.md5(F.col("prompt").cast("binary")).alias("prompt_md5"))


def synth_unpivot(s: SparkSession, d: str) -> DataFrame:
    """Questions from literal replies: fenced, with chatter, an item of a text index, a short question, a broken reply."""
    rows = _batches(s, d)
    item = lambda j, k: F.concat(F.lit('{"i": '), j, F.lit(', "natural": " What is '), k, F.lit('? ", "vocab_gap": "'), F.when(F.col("batch_id") % 3 == 0, F.lit("abc")).otherwise(F.concat(F.lit("Say of "), k)), F.lit('", "inflected": "On '), k, F.lit('?!"}'))
    listed = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda j: item(F.when(j == 4, F.concat(F.lit('"'), j, F.lit('"'))).otherwise(j.cast("string")), F.concat(F.col("batch_id"), F.lit("x"), j))), ",")
    reply = F.when(F.col("batch_id") % 7 == 6, "no list").when(F.col("batch_id") % 2 == 0, F.concat(F.lit("```json\n["), listed, F.lit("]\n```"))).otherwise(F.concat(F.lit("Here: ["), listed, F.lit("] done")))
    replies = rows.select("batch_id").distinct().select("batch_id", reply.alias("reply"))
    return synth.questions(synth.parse_replies(replies), rows).select("passage_id", "category", "query")


def term_df(s: SparkSession, d: str) -> DataFrame:
    return lexical.term_counts(T.corpus(s, d)).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def doc_stats(s: SparkSession, d: str) -> DataFrame:
    return lexical.doc_stats(T.corpus(s, d)).withColumn("avgdl", F.round("avgdl", 6))


def idf_table(s: SparkSession, d: str) -> DataFrame:
    return lexical.idf_table(T.corpus(s, d)).withColumn("idf", F.round("idf", 6))


def _ranked(df: DataFrame) -> DataFrame:
    return df.select("qid", "rank", "doc_id", F.round("score", 6).alias("score"))


def bm25_topk(s: SparkSession, d: str) -> DataFrame:
    return _ranked(lexical.bm25_topk(T.topics(s, d), T.corpus(s, d), 10))


def bm25_stemmed_topk(s: SparkSession, d: str) -> DataFrame:
    return _ranked(lexical.bm25_topk(T.topics(s, d), T.corpus(s, d), 10, stems=T.stems(s, d)))


def _mined(s: SparkSession, d: str) -> DataFrame:
    pool = mining.candidate_pool(T.corpus(s, d), T.questions(s, d), T.exclusions(s, d))
    return mining.mine_negatives(T.questions(s, d), pool)


def mine_negatives(s: SparkSession, d: str) -> DataFrame:
    return _mined(s, d)


def mined_ids_artifact(s: SparkSession, d: str) -> DataFrame:
    got = writers.ids_only(mining.with_negatives(T.questions(s, d).withColumn("passage_id", F.col("positive_id")).withColumn("positive_id", F.lit("")), _mined(s, d)))
    return got.select(F.length("query").alias("q_chars"), "positive_id", F.array_join("negative_ids", ",").alias("negative_ids"), "category")


def _train(s: SparkSession, d: str) -> DataFrame:
    ids = mining.with_negatives(T.questions(s, d), _mined(s, d))
    made = assemble.expand_ids(ids, T.corpus(s, d)).select("pair_id", "query", "positive", "negatives", "category")
    gold = pairs.build_pairs(T.corpus(s, d), T.topics(s, d), T.qrels(s, d)).select(F.concat(F.lit("g"), "positive_id").alias("pair_id"), "query", "positive", "negatives")
    return assemble.union_training(made, gold)


def assemble_train(s: SparkSession, d: str) -> DataFrame:
    return _train(s, d).select("pair_id", "category", F.length("query").alias("q_chars"), F.length("positive").alias("p_chars"), F.size("negatives").alias("n_neg"), F.md5(F.array_join("negatives", "|").cast("binary")).alias("neg_md5"))


def triplets(s: SparkSession, d: str) -> DataFrame:
    t = assemble.triplets(_train(s, d), 2)
    return t.select("pair_id", F.md5(F.col("positive").cast("binary")).alias("positive_md5"), F.md5(F.col("negative").cast("binary")).alias("negative_md5"))


def train_pairs(s: SparkSession, d: str) -> DataFrame:
    return assemble.plain_pairs(_train(s, d), 2).select("pair_id", F.length("anchor").alias("a_chars"), F.length("positive").alias("p_chars"))


def train_stats(s: SparkSession, d: str) -> DataFrame:
    return assemble.train_stats(_train(s, d), 4, 128)


def dense_topk(s: SparkSession, d: str) -> DataFrame:
    q, p, _, _ = T.vectors(s, d)
    return _ranked(dense.dense_topk(q, p, 100))


def _runs(s: SparkSession, d: str, *names: str) -> tuple[dict[str, DataFrame], Classes, DataFrame]:
    """Runs of these names, and what they need: vectors are searched as a run is made."""
    _, _, rel, cats = T.vectors(s, d)
    need = {*names, *(("full", "short") if "fused" in names else ())}
    runs = {x: dense.dense_topk(*T.vectors(s, d, dims)[:2], 100) for x, dims in (("full", 64), ("short", 16), ("tiny", 8)) if x in need}
    if "fused" in names:
        runs["fused"] = fusion.rrf(runs["full"], runs["short"])
    return {x: runs[x] for x in names}, rel, cats


def rrf_fusion(s: SparkSession, d: str) -> DataFrame:
    return _ranked(_runs(s, d, "fused")[0]["fused"])


def ndcg_mrr_recall_by_slice(s: SparkSession, d: str) -> DataFrame:
    runs, rel, cats = _runs(s, d, "full")
    return metrics.evaluate(runs["full"], rel, cats).select("scope", "n", *[F.round(c, 6).alias(c) for c in ("ndcg", "rr", "recall")])


def paired_bootstrap(s: SparkSession, d: str) -> DataFrame:
    runs, rel, cats = _runs(s, d, "short", "full")
    got = metrics.paired_bootstrap(metrics.per_query(runs["short"], rel), metrics.per_query(runs["full"], rel), cats)
    return got.select("scope", "n", F.round("delta", 6).alias("delta"), F.round("p_value", 6).alias("p_value"), (F.col("p_value") < 0.05).alias("significant"))


def eval_table(s: SparkSession, d: str) -> DataFrame:
    runs, rel, cats = _runs(s, d, "full", "short", "tiny", "fused")
    return metrics.eval_table(runs, rel, cats).select("scope", *[F.round(c, 6).alias(c) for c in runs])


def tier_counts(s: SparkSession, d: str) -> DataFrame:
    return T.vectors(s, d)[3].groupBy("category").agg(F.count("*").alias("n")).orderBy("category")


def model_ranking(s: SparkSession, d: str) -> DataFrame:
    t = T.table(s, d, "events").groupBy(F.col("event_type").alias("model")).agg(F.round(F.sum("value"), 4).alias("value"))
    t = t.withColumn("value", F.when(F.col("model") != "click", F.col("value")))
    place = F.row_number().over(Window.orderBy(F.col("value").desc_nulls_last(), "model"))
    return metrics.rank_models(t, "value").select("model", "value", place.alias("place"))


_ALL = (tokenize_docs, shingle_counts, scalar_functions, norm_titles_overlap, article_id_overlap, near_dup_benchmark, near_dup_best, overlap_cascade, overlap_report, clean_negatives, build_pairs, pair_stats, corpus_last_wins, qrels_split, loader_lines, candidate_pool, resume_filter, prompt_batches, synth_unpivot, term_df, doc_stats, idf_table, bm25_topk, bm25_stemmed_topk, mine_negatives, mined_ids_artifact, assemble_train, triplets, train_pairs, train_stats, dense_topk, rrf_fusion, ndcg_mrr_recall_by_slice, paired_bootstrap, eval_table, tier_counts, model_ranking)
QUERIES = {f.__name__: f for f in _ALL} | files.QUERIES
ORACLE_SQL = oracles.ORACLE_SQL | files.SQL
