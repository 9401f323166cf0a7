"""Term statistics and BM25."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkmere.functions.text import is_trivial, tokens

K1, B = 1.5, 0.75
Analyzer = Callable[[Column], Column]


def term_counts(docs: DataFrame, terms: DataFrame | None = None, analyzer: Analyzer = tokens, stems: DataFrame | None = None) -> DataFrame:
    """(doc_id, term, tf); only of `terms` (term), if given, which are sought before anything is shuffled.

    stems (word, stem): tokens are looked up there; what isn't found, and trivial tokens, stand for themselves.
    """
    rows = docs.select("doc_id", F.explode(analyzer(F.col("text"))).alias("term"))
    if stems is not None:
        known = stems.where(~is_trivial(F.col("word"))).select(F.col("word").alias("term"), "stem")
        rows = rows.join(known, "term", "left").select("doc_id", F.coalesce("stem", "term").alias("term"))
    if terms is not None:
        rows = rows.join(terms.select("term").distinct(), "term", "left_semi")
    return rows.groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def doc_lengths(docs: DataFrame, analyzer: Analyzer = tokens) -> DataFrame:
    return docs.select("doc_id", F.size(analyzer(F.col("text"))).cast("long").alias("dl"))


def doc_stats(docs: DataFrame, analyzer: Analyzer = tokens) -> DataFrame:
    """One row: n_docs (empty ones too), n_tokens, avgdl (0 without documents)."""
    got = doc_lengths(docs, analyzer).agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("dl"), F.lit(0)).alias("n_tokens"))
    return got.withColumn("avgdl", F.coalesce(F.try_divide("n_tokens", "n_docs"), F.lit(0.0)))


def idf(df: Column, n_docs: Column) -> Column:
    half = F.lit(0.5)
    return F.log(F.lit(1.0) + (n_docs - df + half) / (df + half))


def idf_table(docs: DataFrame, analyzer: Analyzer = tokens, stems: DataFrame | None = None) -> DataFrame:
    """(term, df, idf)."""
    df = term_counts(docs, None, analyzer, stems).groupBy("term").agg(F.count("*").alias("df"))
    return df.withColumn("idf", idf(F.col("df"), docs.agg(F.count("*").alias("n")).scalar()))


def bm25_topk(queries: DataFrame, docs: DataFrame, top_k: int = 50, analyzer: Analyzer = tokens, stems: DataFrame | None = None, k1: float = K1, b: float = B) -> DataFrame:
    """(qid, doc_id, score, rank): each query's best documents by score (rounded to 9 places), then id; rank from 1.

    A term counts once a query. Only documents that share a term are scored, and only the queries' terms are counted: a
    document's tokens meet the words that stand for those terms as they are made, with its length. Texts are tokenised twice,
    for that and for the two corpus figures.
    """
    asked = term_counts(queries.select(F.col("qid").alias("doc_id"), F.col("query").alias("text")), None, analyzer, stems).select(F.col("doc_id").alias("qid"), "term")
    words = asked.select("term").distinct()
    forms = words.select(F.col("term").alias("word"), "term")
    if stems is not None:
        # A term is met as any word whose stem it is, and as itself unless it has a stem of its own.
        known = stems.where(~is_trivial(F.col("word"))).select("word", F.col("stem").alias("term"))
        forms = known.join(words, "term", "left_semi").select("word", "term").unionByName(forms.join(known.select("word"), "word", "left_anti"))
    rows = docs.select("doc_id", analyzer(F.col("text")).alias("_t")).select("doc_id", F.size("_t").cast("long").alias("dl"), F.explode("_t").alias("word"))
    tf = rows.join(forms, "word").groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf"))
    stats = doc_stats(docs, analyzer)
    n, avgdl = stats.select("n_docs").scalar(), stats.select("avgdl").scalar()
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    weights = df.select("term", idf(F.col("df"), n).alias("idf"))
    f, dl = F.col("tf").cast("double"), F.col("dl").cast("double")
    part = F.col("idf") * (f * F.lit(k1 + 1)) / (f + F.lit(float(k1)) * (F.lit(1.0 - b) + F.lit(float(b)) * dl / avgdl))
    scored = tf.join(weights, "term").select("doc_id", "term", part.alias("part")).join(asked, "term").groupBy("qid", "doc_id").agg(F.round(F.sum("part"), 9).alias("score"))
    return top(scored, top_k)


def top(scored: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("score").desc(), "doc_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def missing_words(docs: DataFrame, stems: DataFrame, analyzer: Analyzer = tokens) -> DataFrame:
    """(word): the different tokens that the stem dictionary lacks and that are worth asking a stemmer for."""
    words = docs.select(F.explode(analyzer(F.col("text"))).alias("word")).distinct()
    return words.where(~is_trivial(F.col("word"))).join(stems, "word", "left_anti")


def extend_stems(docs: DataFrame, stems: DataFrame, stem_batch: Callable[[list[str]], dict[str, str]], batch: int = 1000, analyzer: Analyzer = tokens) -> DataFrame:
    """`stems` with what `stem_batch` (a remote service, say) says of the missing words. A failed batch is tried in halves;
    a word that fails alone stands for itself, as does an empty answer."""
    import pandas as pd

    def ask(words: list[str]) -> dict[str, str]:
        try:
            return stem_batch(words)
        except PermissionError:
            raise
        except Exception:
            if len(words) == 1:
                return {}
            half = len(words) // 2
            return ask(words[:half]) | ask(words[half:])

    def run(frames):
        for f in frames:
            words = f["word"].tolist()
            for i in range(0, len(words), batch):
                part = words[i : i + batch]
                got = ask(part)
                yield pd.DataFrame({"word": part, "stem": [got.get(w) or w for w in part]})

    return stems.unionByName(missing_words(docs, stems, analyzer).mapInPandas(run, "word string, stem string"))
