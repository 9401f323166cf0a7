"""Quality rules of a document and of its host."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .places import field, located, quoted, unpacked, with_side, write_side
from .store import materialise, maybe_broadcast

SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 50, 50, 3
HOST_LIMIT, HOST_SURE = 0.5, 2.0
RULES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def measure(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text; null counts as empty.

    Words are runs without the six ASCII white-space characters. A duplicate line has a word and equals an earlier line.
    n_repeat_words: words in windows of three words that occur twice or more, the first included.
    """
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    chars = len(text or "") - sum(raw.count(c) for c in (b" ", b"\t", b"\n", b"\v", b"\f", b"\r"))
    symbols = sum(raw.count(c.encode()) for c in SYMBOLS)
    n = len(words)
    repeated = 0
    if n > WINDOW:
        seen: dict = {}
        twice = set()
        for i, key in enumerate(zip(words, words[1:], words[2:], strict=False)):
            if seen.setdefault(key, i) != i:
                twice.add(key)
        if twice:
            reach = 0
            for i, key in enumerate(zip(words, words[1:], words[2:], strict=False)):
                if key in twice:
                    repeated += i + WINDOW - max(i, reach)
                    reach = i + WINDOW
    lines = raw.split(b"\n")
    if len(lines) == len(set(lines)):
        return n, chars, symbols, 0, repeated
    met, dup = set(), 0
    for line in lines:
        if line in met:
            dup += bool(line.split())
        else:
            met.add(line)
    return n, chars, symbols, dup, repeated


def _measure_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = [measure(x.as_py()) for x in batch.column("_text")]
        kept = [c for c in batch.schema.names if c != "_text"]
        cols = list(zip(*got, strict=True)) if got else [[]] * 5
        names = [x.split()[0] for x in RULES.split(", ")]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array(c, pa.int64()) for c in cols)], names=[*kept, *names])


def host_verdicts(counts: DataFrame, limit: float = HOST_LIMIT, sure: float = HOST_SURE) -> DataFrame:
    """Hosts (host, n_docs, n_failed) with their shrunk failure rate and verdict.

    The rates of all hosts give a beta prior by their mean and variance (each host counts once; hosts of one document
    tell nothing of the spread, so the prior's weight is one document at least). A host's rate is its posterior mean
    (failed + a) / (docs + a + b). A host is bad if the mean, less `sure` posterior standard deviations, is above
    `limit`: a small host can't be condemned by a few documents.
    """
    raw = F.col("n_failed") / F.col("n_docs")
    prior = counts.agg(F.avg(raw).alias("mu"), F.coalesce(F.var_samp(raw), F.lit(0.0)).alias("var"))
    t = counts.withColumn("mu", prior.select("mu").scalar()).withColumn("var", prior.select("var").scalar())
    spread = F.col("mu") * (1 - F.col("mu"))
    weight = F.greatest(F.lit(1.0), F.least(F.lit(1000.0), F.when((F.col("var") > 0) & (spread > 0), spread / F.col("var") - 1).otherwise(F.lit(1000.0))))
    t = t.withColumn("weight", weight).withColumn("rate", (F.col("n_failed") + F.col("mu") * F.col("weight")) / (F.col("n_docs") + F.col("weight")))
    low = F.col("rate") - F.lit(float(sure)) * F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n_docs") + F.col("weight") + 1))
    return t.select("host", "n_docs", "n_failed", "rate", (low > F.lit(float(limit))).alias("host_bad"))


def _failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _verdicts(measured: DataFrame, limit: float, sure: float) -> DataFrame:
    """(_host, host_rate, host_bad) of the hosts in `measured` (host, base_failed), counted before anything is shuffled."""
    counts = measured.groupBy("host").agg(F.count("*").alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))
    counts = materialise(counts, "quality-counts")
    found = materialise(host_verdicts(counts, limit, sure), "quality-hosts")
    return maybe_broadcast(found.select(F.col("host").alias("_host"), F.col("rate").alias("host_rate"), "host_bad"))


def apply_rules(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", limit: float = HOST_LIMIT, sure: float = HOST_SURE) -> DataFrame:
    """One row a document: id_col, host, the measures, base_failed, host_rate, host_bad, kept.

    base_failed: fewer than 50 words, or more than half the words in repeated windows. kept: neither base_failed nor
    from a bad host. Null and empty texts have no words and fail. A null host is a host of its own. Repeated rows each
    count and each get a row; ids may be of any type, null too. Other columns don't matter, whatever their names. An empty
    table gives an empty result. The hosts' counts are aggregated before they are shuffled, so a hot host costs a row for
    each task; verdicts, a row a host, are broadcast if they are small, by their measured bytes.
    """
    rows = docs.select(quoted(id_col).alias("_id"), quoted(host_col).cast("string").alias("host"), quoted(text_col).alias("_text"))
    kind = dict(rows.dtypes)["_id"]
    measured = rows.mapInArrow(_measure_batches, f"_id {kind}, host string, {RULES}")
    measured = materialise(measured.withColumn("base_failed", _failed()), "quality")
    out = measured.join(_verdicts(measured, limit, sure), F.col("host").eqNullSafe(F.col("_host")), "left").drop("_host")
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("host_bad")).withColumnRenamed("_id", id_col)


def keep_good(docs: DataFrame, *, text_col: str = "text", host_col: str = "source", limit: float = HOST_LIMIT, sure: float = HOST_SURE) -> DataFrame:
    """The rows of `docs`, all columns, that pass the document's rules and come from no bad host. Needs no id.

    Texts are measured once; verdicts reach the documents where they lie, by narrow rows. Nulls, repeated rows and empty
    tables as in `apply_rules`; columns keep their names, whatever they are.
    """
    rows = located(docs)
    narrow = rows.select("file", "row", field(host_col).cast("string").alias("host"), field(text_col).alias("_text"))
    measured = narrow.mapInArrow(_measure_batches, f"file long, row long, host string, {RULES}")
    measured = materialise(measured.select("file", "row", "host", _failed().alias("base_failed")), "quality")
    judged = measured.join(_verdicts(measured, limit, sure), F.col("host").eqNullSafe(F.col("_host")), "left")
    marks = judged.select("file", "row", F.when(~F.col("base_failed") & ~F.col("host_bad"), F.lit(1).cast("long")).alias("value"))
    return unpacked(with_side(rows, write_side(marks, "quality-keep")), docs.columns)
