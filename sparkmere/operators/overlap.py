"""Overlap of training pairs with a benchmark: titles, near-duplicate passages, article ids; report and cleansing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkmere.functions.text import BENCHMARK_ID, article_id, benchmark_article_id, first_present, norm_title, shingle_hashes, shingles, tokens

SHINGLE, JACCARD = 5, 0.5


def title_hits(pairs: DataFrame, benchmark: DataFrame, key: str = "pair_id", title: str = "positive_title") -> DataFrame:
    """Keys of pairs whose normalised title is a benchmark passage's; empty titles match nothing."""
    titles = benchmark.select(norm_title(F.col("title")).alias("t")).where("t <> ''").distinct()
    return pairs.select(key, norm_title(F.col(title)).alias("t")).where("t <> ''").join(titles, "t", "left_semi").select(key)


def article_hits(pairs: DataFrame, benchmark: DataFrame, key: str = "pair_id", doc_id: str = "positive_id", pattern: str = BENCHMARK_ID) -> DataFrame:
    articles = benchmark.select(benchmark_article_id(F.col("doc_id"), pattern).alias("a")).where("a <> ''").distinct()
    return pairs.select(key, article_id(F.col(doc_id)).alias("a")).join(articles, "a", "left_semi").select(key)


def _exploded(rows: DataFrame, key: str, text: str, n: int, names: tuple[str, str, str]) -> DataFrame:
    """(row number, key, size, s): a row for each different shingle of a text; texts without a token have none."""
    number, own, size = names
    sh = rows.select(F.col(key).alias(own), tokens(F.col(text)).alias("w")).select(own, shingle_hashes(F.col("w"), n).alias("sh"))
    numbered = sh.where(F.size("sh") > 0).withColumn(number, F.monotonically_increasing_id())
    return numbered.select(number, own, F.size("sh").alias(size), F.explode("sh").alias("s"))


def _probed(texts: DataFrame, benchmark: DataFrame, n: int, probe: int, key: str, text: str, other: str) -> DataFrame:
    """(key, other) of texts and passages that share one of the `probe` least shingles of each."""
    least = lambda rows, own, t: rows.select(F.col(own).alias(own), F.explode(F.slice(F.array_sort(shingles(tokens(F.col(t)), n)), 1, probe)).alias("_s"))
    return least(texts, key, text).join(least(benchmark, other, "text"), "_s").select(key, other).distinct()


def near_duplicates(texts: DataFrame, benchmark: DataFrame, threshold: float = JACCARD, n: int = SHINGLE, key: str = "pair_id", text: str = "positive", other: str = "doc_id", probe: int | None = None) -> DataFrame:
    """(key, other, jaccard) of the texts and benchmark passages whose shingle sets are alike by `threshold` or more.

    Texts without a token match nothing. Each shingle of a text is looked up among the passages' as it is made; only hits
    are counted by pair, in the task that makes them first, so neither texts nor their shingles are shuffled where the
    benchmark is small. Exact; with `probe`, pairs count only if they share one of that many least shingles of each.
    """
    left, right = _exploded(texts, key, text, n, ("_k", "k", "nk")), _exploded(benchmark, other, "text", n, ("_b", "b", "nb"))
    hits = left.join(right, "s").where(F.least("nb", "nk") >= F.lit(float(threshold)) * F.greatest("nb", "nk"))
    both = hits.groupBy("_k", "k", "nk", "_b", "b", "nb").agg(F.count("*").alias("inter"))
    jaccard = F.col("inter") / (F.col("nk") + F.col("nb") - F.col("inter"))
    got = both.select(F.col("k").alias(key), F.col("b").alias(other), jaccard.alias("jaccard")).where(F.col("jaccard") >= threshold)
    return got if probe is None else got.join(_probed(texts, benchmark, n, probe, key, text, other), [key, other], "left_semi")


def _alike(texts: DataFrame, benchmark: DataFrame, threshold: float, n: int, key: str, text: str, probe: int | None) -> DataFrame:
    """Keys of the texts with a near duplicate; a threshold of 0 or less takes every text with a token."""
    if threshold <= 0:
        return texts.where(F.size(tokens(F.col(text))) > 0).select(key).distinct()
    return near_duplicates(texts, benchmark, threshold, n, key, text, probe=probe).select(key).distinct()


def best_match(pairs: DataFrame, benchmark: DataFrame, threshold: float = JACCARD, n: int = SHINGLE, key: str = "pair_id", text: str = "positive") -> DataFrame:
    """(key, jaccard): the best similarity of each text that has a near duplicate."""
    return near_duplicates(pairs, benchmark, threshold, n, key, text).groupBy(key).agg(F.max("jaccard").alias("jaccard"))


def has_titles(benchmark: DataFrame) -> DataFrame:
    """One row: whether any passage has a title; without one, titles settle nothing."""
    return benchmark.agg(F.coalesce(F.bool_or(norm_title(F.col("title")) != ""), F.lit(False)).alias("has_titles"))


def with_reason(pairs: DataFrame, benchmark: DataFrame, threshold: float = JACCARD, n: int = SHINGLE, drop_by_article_id: bool = False, key: str = "pair_id", pattern: str = BENCHMARK_ID, probe: int | None = None) -> DataFrame:
    """`pairs` with article_hit and reason: title, near_dup, article_id or null (kept); the first that applies.

    Positive ids fall back to passage ids. Pairs that a title settles aren't shingled.
    """
    pos = first_present(F.col("positive_id"), F.col("passage_id")) if "passage_id" in pairs.columns else F.col("positive_id")
    p = pairs.withColumn("positive_id", F.coalesce(pos, F.lit("")))
    titled = title_hits(p, benchmark, key).withColumn("_t", F.lit(True))
    articled = article_hits(p, benchmark, key, pattern=pattern).withColumn("_a", F.lit(True))
    p = p.join(titled, key, "left").join(articled, key, "left")
    near = _alike(p.where("_t IS NULL").select(key, "positive"), benchmark, threshold, n, key, "positive", probe).withColumn("_n", F.lit(True))
    reason = F.when(F.col("_t"), "title").when(F.col("_n"), "near_dup")
    if drop_by_article_id:
        reason = reason.when(F.col("_a"), "article_id")
    return p.join(near, key, "left").withColumn("article_hit", F.coalesce("_a", F.lit(False))).withColumn("reason", reason).drop("_t", "_a", "_n")


def clean_negatives(pairs: DataFrame, benchmark: DataFrame, threshold: float = JACCARD, n: int = SHINGLE, drop_by_article_id: bool = False, key: str = "pair_id", pattern: str = BENCHMARK_ID, probe: int | None = None) -> DataFrame:
    """`pairs` with the negatives that the benchmark knows taken out of negatives and negative_ids (cut to the shorter
    list), order kept, and n_stripped."""
    size = F.least(F.size(F.coalesce("negatives", F.array())), F.size(F.coalesce("negative_ids", F.array())))
    zipped = F.slice(F.arrays_zip("negatives", "negative_ids"), 1, F.greatest(size, F.lit(0)))
    rows = pairs.select(key, F.posexplode(zipped).alias("pos", "z")).select(key, "pos", F.col("z.negatives").alias("text"), F.col("z.negative_ids").alias("id"))
    distinct = rows.groupBy(F.md5(F.col("text").cast("binary")).alias("th")).agg(F.first("text").alias("text"))
    bad = _alike(distinct, benchmark, threshold, n, "th", "text", probe).withColumn("_n", F.lit(True))
    rows = rows.withColumn("th", F.md5(F.col("text").cast("binary"))).join(bad, "th", "left")
    drop = F.coalesce("_n", F.lit(False))
    if drop_by_article_id:
        articles = benchmark.select(benchmark_article_id(F.col("doc_id"), pattern).alias("a")).where("a <> ''").distinct().withColumn("_a", F.lit(True))
        rows = rows.withColumn("a", article_id(F.col("id"))).join(articles, "a", "left")
        drop = drop | F.coalesce("_a", F.lit(False))
    rows = rows.withColumn("drop", drop)
    kept = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.when(~F.col("drop"), F.struct("pos", "text", "id")))).alias("n"), F.count_if("drop").alias("n_stripped"))
    kept = kept.select(key, F.transform("n", lambda x: x.text).alias("negatives"), F.transform("n", lambda x: x.id).alias("negative_ids"), "n_stripped")
    none = F.array().cast("array<string>")
    return pairs.drop("negatives", "negative_ids").join(kept, key, "left").withColumn("negatives", F.coalesce("negatives", none)).withColumn("negative_ids", F.coalesce("negative_ids", none)).na.fill(0, ["n_stripped"])


def report(judged: DataFrame, benchmark: DataFrame, negatives_stripped: int | None = None, pattern: str = BENCHMARK_ID, **params) -> DataFrame:
    """One row of counts: pairs_in, pairs_kept, pairs_dropped, a count for each reason (zero too), article_id_overlap over
    all pairs, and the benchmark's passages and articles."""
    reason = lambda r: F.count_if(F.col("reason") == r)
    got = judged.agg(F.count("*").alias("pairs_in"), F.count_if(F.col("reason").isNull()).alias("pairs_kept"), F.count_if(F.col("reason").isNotNull()).alias("pairs_dropped"), reason("title").alias("dropped_title"), reason("near_dup").alias("dropped_near_dup"), reason("article_id").alias("dropped_article_id"), F.count_if("article_hit").alias("article_id_overlap"))
    article = F.nullif(benchmark_article_id(F.col("doc_id"), pattern), F.lit(""))
    sides = benchmark.agg(F.count("*").alias("benchmark_passages"), F.countDistinct(article).alias("benchmark_articles"))
    for c in sides.columns:
        got = got.withColumn(c, sides.select(c).scalar())
    if negatives_stripped is not None:
        got = got.withColumn("negatives_stripped", F.lit(negatives_stripped).cast("long"))
    return got.withColumns({k: F.lit(v) for k, v in params.items()})
