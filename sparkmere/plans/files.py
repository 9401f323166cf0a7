"""Registered queries that write files of each format from the test tables and read them back, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmere.operators import metrics, overlap, pairs
from sparkmere.sources import readers, writers
from sparkmere.sources.scratch import new_folder
from sparkmere.streaming import resume

from . import bindings as T
from .oracles import BENCH, JACCARD, ORACLE_SQL, TOK

FLAT = r"regexp_replace(coalesce({}, ''), '[\t\n\r]', ' ', 'g')".format
PROBE = 48


def _flat(name: str) -> Column:
    return F.regexp_replace(F.coalesce(name, F.lit("")), "[\t\n\r]", " ")


def _md5(c: str) -> Column:
    return F.md5(F.col(c).cast("binary")).alias(f"{c}_md5")


def _json(*cols: Column, nulls: bool = False) -> Column:
    return F.to_json(F.struct(*cols), {"ignoreNullFields": "false" if nulls else "true"})


def _tabbed(*cols) -> Column:
    return F.concat_ws("\t", *cols)


def _one(lines: DataFrame, order: str) -> DataFrame:
    """One file, where the format has one for each list, its lines in order."""
    return lines.coalesce(1).sortWithinPartitions(order)


def _items(s: SparkSession, d: str) -> DataFrame:
    return T.table(s, d, "benchmark").select(F.col("item_id").alias("i"), _flat("text").alias("t"))


def corpus_files(s: SparkSession, d: str) -> DataFrame:
    """documents as gzipped JSON lines and as tab-separated text in folders beside a file of another kind."""
    t, top = T.table(s, d, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("heading"), _flat("text").alias("contents")), new_folder(s, "corpus")
    writers.write_named(t.where("doc_id % 2 = 0").select(_json(F.col("doc_id"), F.col("heading"), F.col("contents")).alias("value")), f"{top}/a", "part.jsonl.gz")
    writers.write_named(t.where("doc_id % 2 = 1").select(_tabbed("doc_id", "heading", "contents").alias("value")), f"{top}/b", "part.tsv")
    writers.write_named(t.select(F.lit("no record").alias("value")).limit(1), top, "notes.md")
    return readers.read_corpus(s, readers.data_files(s, top)).select("doc_id", "title", _md5("text"))


def corpus_globs(s: SparkSession, d: str) -> DataFrame:
    """documents in two folders, found by two patterns, one of them twice."""
    t, top = T.table(s, d, "documents").select("doc_id", _flat("text").alias("t")), new_folder(s, "globs")
    for k in (0, 1):
        writers.write_named(t.where(f"doc_id % 2 = {k}").select(_tabbed("doc_id", "t").alias("value")), f"{top}/{k}", "texts.tsv")
    files = readers.resolve_files(s, [f"{top}/0/*.tsv", f"{top}/*/texts-*", f"{top}/0/t*"])
    return readers.read_corpus(s, files).select("doc_id", "title", _md5("text"))


def split_files(s: SparkSession, d: str) -> DataFrame:
    """labels as the judgements of two splits, found by a part of the file's name; a third split has no file."""
    t, top = T.table(s, d, "labels"), new_folder(s, "qrels")
    for k, name in enumerate(("qrels_TRAIN.txt", "qrels_Dev.tsv")):
        lines = t.where(f"doc_id % 2 = {k}").select("doc_id", F.concat_ws(" ", F.col("doc_id") % 50, F.lit("0"), "doc_id", "quality").alias("value"))
        writers.write_named(_one(lines, "doc_id"), top, name)
    files = readers.data_files(s, top)
    found = [(split, f) for split in ("train", "dev", "test") if (f := readers.split_file(files, split))]
    read = [readers.read_qrels(s, [f]).select(F.lit(split).alias("split"), "qid", "doc_id", "rel", "positive") for split, f in found]
    return read[0].unionByName(read[1])


def topics_files(s: SparkSession, d: str) -> DataFrame:
    """Topics as JSON lines, then as tab-separated ones that replace some, also by empty queries."""
    t, top = _items(s, d), new_folder(s, "topics")
    text = F.when(F.col("i") % 4 == 3, "").otherwise(F.col("t"))
    writers.write_named(t.select(_json(F.col("i").alias("question_id"), text.alias("question")).alias("value")), top, "a.jsonl")
    again = F.when(F.col("i") % 10 == 0, "").otherwise(F.concat(F.lit("again "), "t"))
    writers.write_named(t.where("i % 5 = 0").select(_tabbed("i", again).alias("value")), top, "z.tsv")
    return readers.read_topics(s, readers.data_files(s, top)).select("qid", _md5("query"))


def benchmark_files(s: SparkSession, d: str) -> DataFrame:
    """Benchmark passages under several names of their fields, a null id, and broken lines."""
    t, top, i, x = _items(s, d), new_folder(s, "benchmark"), F.col("i"), F.col("t")
    wiki = F.concat(F.lit("wiki_"), i, F.lit("_0"))
    plain = _json(wiki.alias("id"), F.lit("one").alias("title"), x.alias("text"))
    other = _json(wiki.alias("_id"), F.lit("").alias("title"), F.lit("two").alias("wiki_title"), x.alias("body"))
    null = _json(F.lit(None).cast("string").alias("id"), wiki.alias("doc_id"), x.alias("contents"), nulls=True)
    value = F.when(i % 7 == 6, "{bad").when(i % 3 == 0, plain).when(i % 3 == 1, other).otherwise(null)
    writers.write_named(t.select(value.alias("value")), top, "bench.jsonl")
    return readers.read_benchmark(s, readers.data_files(s, top)).select("doc_id", "title", _md5("text"))


def ood_passages(s: SparkSession, d: str) -> DataFrame:
    t, top, i = T.table(s, d, "pages").select("page_id", "url"), new_folder(s, "ood"), F.col("page_id")
    value = F.when(i % 5 == 4, _json(i.alias("id"), F.lit("").alias("text"))).when(i % 2 == 0, _json(i.alias("passage_id"), F.col("url").alias("passage"))).otherwise(_json(i.alias("_id"), F.col("url").alias("text"), F.lit("s").alias("source")))
    writers.write_named(t.select(value.alias("value")), top, "passages.jsonl")
    return readers.read_ood_passages(s, readers.data_files(s, top))


def ood_queries(s: SparkSession, d: str) -> DataFrame:
    """Queries with a type, none, or a null one; every fourth id comes again."""
    t, top, i = _items(s, d), new_folder(s, "ood"), F.col("i")
    kind = F.when(i % 3 == 0, "factoid")
    first = F.when(i % 3 == 1, _json(i.alias("query_id"), F.col("t").alias("query"))).otherwise(_json(i.alias("id"), F.col("t").alias("text"), kind.alias("type"), nulls=True))
    again = _json(i.alias("id"), F.concat(F.lit("again "), "t").alias("query"), F.lit("paraphrase").alias("type"))
    lines = t.select("i", first.alias("value")).unionByName(t.where("i % 4 = 0").select((F.lit(1 << 40) + i).alias("i"), again.alias("value")))
    writers.write_named(_one(lines, "i"), top, "queries.jsonl")
    return readers.read_ood_queries(s, readers.data_files(s, top)).select("qid", "category", _md5("query"))


def ood_qrels(s: SparkSession, d: str) -> DataFrame:
    """Judgements of relevance 0 or 1, text, NaN or none; each line twice."""
    t, top, i = T.table(s, d, "labels"), new_folder(s, "ood"), F.col("doc_id")
    value = lambda rel: _json((i % 50).cast("string").alias("query_id"), i.cast("string").alias("passage_id"), rel.alias("relevance"))
    line = F.when(i % 7 == 0, value(F.lit("x"))).when(i % 7 == 1, value(F.lit("NaN"))).when(i % 7 == 2, value(F.lit(None).cast("int"))).otherwise(value(F.col("quality")))
    lines = t.select(line.alias("value"))
    writers.write_named(lines.unionByName(lines), top, "qrels.jsonl")
    return readers.read_ood_qrels(s, readers.data_files(s, top))


def query_file(s: SparkSession, d: str) -> DataFrame:
    """Queries whose records hold their relevant ids, one of them twice."""
    t, top, i = _items(s, d), new_folder(s, "queries"), F.col("i")
    ids = F.array(*[F.concat(F.lit(p), i) for p in "aba"])
    writers.write_named(t.select(_json(i.alias("query_id"), F.col("t").alias("query"), F.when(i % 2 == 0, "natural").alias("category"), ids.alias("relevant_ids")).alias("value")), top, "queries.jsonl")
    q, rel = readers.read_query_file(s, readers.data_files(s, top))
    return q.join(rel, "qid").select("qid", "category", "doc_id", _md5("query"))


def exclusion_file(s: SparkSession, d: str) -> DataFrame:
    """Article ids with blanks around them, empty lines between, and some twice."""
    top = new_folder(s, "exclusions")
    value = F.explode(F.array(F.concat(F.lit(" "), "source", F.lit("\t")), F.lit(" "), F.col("source")))
    writers.write_named(T.table(s, d, "documents").where("source IS NOT NULL").select("source").distinct().select(value.alias("value")), top, "ids.txt")
    return readers.read_exclusions(s, top).unionByName(readers.read_exclusions(s, f"{top}/none"))


def resumed_sink(s: SparkSession, d: str) -> DataFrame:
    """A stream of passages into a sink that has every third, and a broken line, already; run again after its end."""
    c, top = T.table(s, d, "documents").select(F.col("doc_id").cast("string").alias("passage_id"), F.length("text").alias("n")), new_folder(s, "sink")
    old = c.where("passage_id % 3 = 0").select(F.to_json(F.struct("passage_id", "n")).alias("value"))
    writers.write_named(old.unionByName(s.range(1).select(F.lit("{bad").alias("value"))), f"{top}/out", "old.json")
    writers.write_jsonl(c, f"{top}/in")
    for _ in range(2):
        stream = s.readStream.schema("passage_id string, n long").json(f"{top}/in")
        resume.resumable_sink(stream, f"{top}/out", f"{top}/cp").awaitTermination()
    got = s.read.schema("passage_id string, n long").json(f"{top}/out").where("passage_id IS NOT NULL")
    return got.groupBy("passage_id").agg(F.count("*").alias("times"), F.max("n").alias("n"))


def done_ids(s: SparkSession, d: str) -> DataFrame:
    """Ids of a sink whose lines are partly broken; each id is there twice."""
    c, top, i = T.table(s, d, "documents"), new_folder(s, "done"), F.col("doc_id").cast("string")
    value = F.when(F.col("doc_id") % 4 == 3, F.concat(F.lit('{"passage_id": "'), i)).otherwise(_json(i.alias("passage_id")))
    lines = c.select(value.alias("value"))
    writers.write_named(lines.unionByName(lines), top, "out.jsonl")
    return readers.read_done_ids(s, top)


def stem_cache(s: SparkSession, d: str) -> DataFrame:
    """A cache of stems, one JSON object, of the benchmark's words."""
    from sparkmere.functions.text import tokens

    top = new_folder(s, "stems")
    words = _items(s, d).select(F.explode(tokens(F.col("t"))).alias("w")).distinct().select("w", F.regexp_replace("w", "(tion|ing|er|en|es|ed)$", "").alias("stem"))
    entries = F.map_from_entries(F.collect_list(F.struct("w", "stem")))
    writers.write_named(words.agg(F.to_json(entries).alias("value")), top, "stems.json")
    return readers.read_stems(s, top)


def inspect_files(s: SparkSession, d: str) -> DataFrame:
    """Sizes and first lines of two files."""
    t, top = _items(s, d), new_folder(s, "inspect")
    for k, name in enumerate(("even.tsv", "odd.tsv")):
        writers.write_named(_one(t.where(f"i % 2 = {k}").select("i", _tabbed("i", "t").alias("value")), "i"), top, name)
    got = readers.inspect(s, top)
    return got.select(F.regexp_extract("path", r"/(\w+)-\d+\.tsv$", 1).alias("name"), F.round("megabytes", 6).alias("megabytes"), "line_no", _md5("line"))


def _pair_files(s: SparkSession, d: str) -> str:
    """Synthetic pairs and, with other fields, gold ones, as JSON lines."""
    t, top, i = _items(s, d), new_folder(s, "pairs"), F.col("i").cast("string")
    writers.write_jsonl(t.where("i % 2 = 0").select(F.concat(F.lit("q"), i).alias("query"), F.col("t").alias("positive"), F.lit("natural").alias("category"), i.alias("passage_id")), f"{top}/synth")
    writers.write_jsonl(t.where("i % 2 = 1").select(F.concat(F.lit("g"), i).alias("query"), F.col("t").alias("positive"), F.array(F.lit("x"), i).alias("negatives"), i.alias("positive_id"), F.col("i").alias("score")), f"{top}/gold")
    return top


def pair_files(s: SparkSession, d: str) -> DataFrame:
    """Pairs from several files read as one, fields that only some have kept."""
    got = readers.read_pairs(s, readers.data_files(s, _pair_files(s, d)))
    return got.select("query", _md5("positive"), F.coalesce("passage_id", "positive_id").alias("id"), "category", F.array_join("negatives", ",").alias("negatives"), "score")


def gold_verbatim(s: SparkSession, d: str) -> DataFrame:
    """Lines added to a folder of pairs as they stand: odd spacing, repeated keys, order of keys."""
    t, top, i = T.table(s, d, "benchmark").select("item_id"), new_folder(s, "gold"), F.col("item_id")
    line = F.concat(F.lit('{ "z":'), i, F.lit(',"query" : "q'), i, F.lit('", "z": 1.50}'))
    writers.write_named(t.select(line.alias("value")).unionByName(t.select(F.lit("  ").alias("value"))), f"{top}/in", "gold.jsonl")
    writers.write_jsonl(t.select(F.concat(F.lit("s"), i).alias("query")), f"{top}/out")
    writers.append_verbatim(s, readers.data_files(s, f"{top}/in"), f"{top}/out")
    return s.read.text(f"{top}/out").select(F.col("value").alias("line"))


def report_file(s: SparkSession, d: str) -> DataFrame:
    """The counts of the pairs, written as a report and read back."""
    report, top = pairs.pair_stats(T.corpus(s, d), T.topics(s, d), T.qrels(s, d)), new_folder(s, "report")
    writers.write_report(report, top)
    return s.read.schema(report.schema).option("multiLine", True).json(top)


def console_lines(s: SparkSession, d: str) -> DataFrame:
    """Shares of events by type as lines of a table."""
    share = lambda cond: F.count_if(F.expr(cond)) / (F.count("*") + F.lit(0.37))
    t = T.table(s, d, "events").groupBy(F.col("event_type").alias("scope")).agg(share("user_id % 2 = 0").alias("a"), share("user_id % 3 = 0").alias("b"), share("event_id % 20 = 0").alias("p_value"))
    return writers.console_table(t.select("scope", "a", "b", (F.col("b") - F.col("a")).alias("delta"), "p_value"))


def compact_runs(s: SparkSession, d: str) -> DataFrame:
    """Results by model without their ranked lists."""
    t = T.table(s, d, "events").groupBy(F.col("event_type").alias("model")).agg(F.count("*").alias("n"), F.collect_set("user_id").alias("run"))
    return metrics.compact(t)


def has_titles(s: SparkSession, d: str) -> DataFrame:
    return overlap.has_titles(T.benchmark(s, d))


def near_dup_probed(s: SparkSession, d: str) -> DataFrame:
    """Near duplicates among the pairs that share one of the least shingles of each."""
    got = overlap.near_duplicates(T.numbered(s, d), T.benchmark(s, d), 0.1, probe=PROBE)
    return got.select("pair_id", "doc_id", F.round("jaccard", 6).alias("jaccard"))


_ALL = (corpus_files, corpus_globs, split_files, topics_files, benchmark_files, ood_passages, ood_queries, ood_qrels, query_file, exclusion_file, resumed_sink, done_ids, stem_cache, inspect_files, pair_files, gold_verbatim, report_file, console_lines, compact_runs, has_titles, near_dup_probed)
QUERIES = {f.__name__: f for f in _ALL}

ITEMS = f"items AS (SELECT item_id AS i, CAST(item_id AS VARCHAR) AS s, {FLAT('text')} AS t FROM benchmark)"
_EVENTS = "count(*) FILTER ({}) / (count(*) + 0.37::DOUBLE)".format
SQL = {
    "corpus_files": f"SELECT CAST(doc_id AS VARCHAR) AS doc_id, coalesce(source, '') AS title, md5({FLAT('text')}) AS text_md5 FROM documents",
    "corpus_globs": f"SELECT CAST(doc_id AS VARCHAR) AS doc_id, '' AS title, md5({FLAT('text')}) AS text_md5 FROM documents",
    "split_files": "SELECT CASE WHEN doc_id % 2 = 0 THEN 'train' ELSE 'dev' END AS split, CAST(doc_id % 50 AS VARCHAR) AS qid, CAST(doc_id AS VARCHAR) AS doc_id, quality::DOUBLE AS rel, quality > 0 AS positive FROM labels",
    "topics_files": f"WITH {ITEMS} SELECT s AS qid, md5(CASE WHEN i % 10 = 0 THEN '' WHEN i % 5 = 0 THEN 'again ' || t ELSE t END) AS query_md5 FROM items WHERE i % 5 = 0 OR (i % 4 <> 3 AND t <> '')",
    "benchmark_files": f"WITH {ITEMS} SELECT CASE WHEN i % 3 = 2 THEN 'None' ELSE 'wiki_' || s || '_0' END AS doc_id, ['one', 'two', ''][i % 3 + 1] AS title, md5(t) AS text_md5 FROM items WHERE i % 7 <> 6",
    "ood_passages": "SELECT CAST(page_id AS VARCHAR) AS doc_id, url AS text FROM pages WHERE page_id % 5 <> 4 AND url <> ''",
    "ood_queries": f"WITH {ITEMS} SELECT s AS qid, CASE WHEN i % 4 = 0 THEN 'paraphrase' ELSE ['factoid', '?', 'None'][i % 3 + 1] END AS category, md5(CASE WHEN i % 4 = 0 THEN 'again ' || t ELSE t END) AS query_md5 FROM items WHERE t <> '' OR i % 4 = 0",
    "ood_qrels": "SELECT CAST(doc_id % 50 AS VARCHAR) AS qid, CAST(doc_id AS VARCHAR) AS doc_id FROM labels WHERE doc_id % 7 > 2 AND quality > 0",
    "query_file": f"WITH {ITEMS} SELECT s AS qid, CASE WHEN i % 2 = 0 THEN 'natural' ELSE '?' END AS category, p || s AS doc_id, md5(t) AS query_md5 FROM items, (SELECT unnest(['a', 'b']) AS p)",
    "exclusion_file": "SELECT DISTINCT source AS article_id FROM documents WHERE source IS NOT NULL",
    "resumed_sink": "SELECT CAST(doc_id AS VARCHAR) AS passage_id, 1::BIGINT AS times, length(text) AS n FROM documents",
    "done_ids": "SELECT CAST(doc_id AS VARCHAR) AS passage_id FROM documents WHERE doc_id % 4 <> 3",
    "stem_cache": f"WITH {ITEMS} SELECT DISTINCT w AS word, regexp_replace(w, '(tion|ing|er|en|es|ed)$', '') AS stem FROM (SELECT unnest({TOK('t')}) AS w FROM items)",
    "inspect_files": f"""WITH {ITEMS}, l AS (SELECT CASE WHEN i % 2 = 0 THEN 'even' ELSE 'odd' END AS name, i, s || chr(9) || t AS line FROM items),
p AS (SELECT name, line, row_number() OVER (PARTITION BY name ORDER BY i) AS line_no, sum(strlen(line) + 1) OVER (PARTITION BY name) AS size FROM l)
SELECT name, round(size / 1e6::DOUBLE, 6) AS megabytes, CAST(line_no AS INTEGER) AS line_no, md5(substring(line, 1, 200)) AS line_md5 FROM p WHERE line_no <= 2""",
    "pair_files": f"WITH {ITEMS} SELECT CASE WHEN i % 2 = 0 THEN 'q' ELSE 'g' END || s AS query, md5(t) AS positive_md5, s AS id, CASE WHEN i % 2 = 0 THEN 'natural' END AS category, CASE WHEN i % 2 = 1 THEN 'x,' || s END AS negatives, CASE WHEN i % 2 = 1 THEN i END AS score FROM items",
    "gold_verbatim": """SELECT '{"query":"s' || item_id || '"}' AS line FROM benchmark UNION ALL SELECT '{ "z":' || item_id || ',"query" : "q' || item_id || '", "z": 1.50}' FROM benchmark""",
    "report_file": ORACLE_SQL["pair_stats"],
    "console_lines": f"""WITH t AS (SELECT event_type AS scope, {_EVENTS('user_id % 2 = 0')} AS a, {_EVENTS('user_id % 3 = 0')} AS b, {_EVENTS('event_id % 20 = 0')} AS p FROM events GROUP BY 1)
SELECT rpad(scope, 16, ' ') || lpad(printf('%.3f', a), 9, ' ') || lpad(printf('%.3f', b), 9, ' ') || lpad(printf('%+.3f', b - a), 9, ' ') || lpad(printf('%.3f', p), 8, ' ') || CASE WHEN p < 0.05 THEN '*' ELSE ' ' END AS line FROM t""",
    "compact_runs": "SELECT event_type AS model, count(*) AS n FROM events GROUP BY 1",
    "has_titles": f"WITH {BENCH} SELECT bool_or(trim(title) <> '') AS has_titles FROM bench",
    "near_dup_probed": f"""WITH {JACCARD}, lp AS (SELECT k, s FROM ps QUALIFY row_number() OVER (PARTITION BY k ORDER BY s) <= {PROBE}), lb AS (SELECT k, s FROM bs QUALIFY row_number() OVER (PARTITION BY k ORDER BY s) <= {PROBE})
SELECT pair_id, doc_id, round(jaccard, 6) AS jaccard FROM near WHERE (pair_id, doc_id) IN (SELECT (lp.k, lb.k) FROM lp JOIN lb USING (s))""",
}
