"""Readers of passages, topics, relevance judgements, pairs and lists from JSON lines, tab- or space-separated text, gzip or plain.

Every reader keeps a line's place (file name, then line) where a later record replaces an earlier one of the same id.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkmere.functions.text import first_present

#: File name patterns, and the names under which fields are found, first match first.
PATTERNS = ("*.jsonl", "*.json", "*.tsv", "*.txt", "*.csv", "*.jsonl.gz", "*.tsv.gz", "*.csv.gz")
JSON_SUFFIXES = (".jsonl", ".json", ".jsonl.gz")
ID_KEYS = ("id", "_id", "doc_id", "docid", "pid", "passage_id")
TITLE_KEYS = ("title", "article_title", "wiki_title", "heading")
TEXT_KEYS = ("text", "contents", "passage", "body", "content", "document")
TOPIC_ID_KEYS = ("id", "_id", "qid", "query_id", "question_id")
TOPIC_TEXT_KEYS = ("text", "query", "question", "title")


def _fs(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def data_files(spark: SparkSession, folder: str | None) -> list[str]:
    """Data files under a folder, at any depth, sorted; none if there is no such folder. Works on any Hadoop file system."""
    if not folder:
        return []
    fs, path = _fs(spark, folder)
    if not fs.exists(path):
        return []
    suffixes = tuple(p.lstrip("*") for p in PATTERNS)
    found, it = set(), fs.listFiles(path, True)
    while it.hasNext():
        name = it.next().getPath().toString()
        if name.endswith(suffixes):
            found.add(name)
    return sorted(found)


def split_file(files: Sequence[str], split: str) -> str | None:
    """The first file whose name has `split` in it, in any case."""
    return next((f for f in sorted(files) if split.lower() in f.rsplit("/", 1)[-1].lower()), None)


def resolve_files(spark: SparkSession, patterns: Sequence[str]) -> list[str]:
    """Files that match any of the patterns, each once, sorted; a pattern without a match is an error."""
    out: set[str] = set()
    for pattern in patterns:
        fs, path = _fs(spark, pattern)
        got = [s.getPath().toString() for s in (fs.globStatus(path) or [])]
        if not got:
            raise FileNotFoundError(f"no file matches {pattern}")
        out.update(got)
    return sorted(out)


def inspect(spark: SparkSession, folder: str) -> DataFrame:
    """(path, megabytes, line_no, line): each data file's size and first two lines, cut to 200 characters."""
    files = data_files(spark, folder)
    if not files:
        return spark.createDataFrame([], "path string, megabytes double, line_no int, line string")
    sizes = spark.read.format("binaryFile").load(files).select("path", (F.col("length") / 1e6).alias("megabytes"))
    from pyspark.sql import Window

    got = _lines(spark, files)
    top = got.withColumn("line_no", F.row_number().over(Window.partitionBy("file").orderBy("line_ord"))).where("line_no <= 2")
    return sizes.join(top.select(F.col("file").alias("path"), "line_no", F.substring("value", 1, 200).alias("line")), "path", "left")


def _lines(spark: SparkSession, files: Sequence[str]) -> DataFrame:
    """(value, file, line_ord) of the non-empty lines. Within a file line_ord grows with the line."""
    if not files:
        return spark.createDataFrame([], "value string, file string, line_ord long")
    rows = spark.read.text(list(files)).select(F.regexp_replace("value", "\r$", "").alias("value"), F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("_id"))
    return rows.where("value <> ''").select("value", "file", F.col("_id").alias("line_ord"))


def is_json_file(name: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.lower(name).endswith(s) for s in JSON_SUFFIXES])


def _field(value: Column, key: str) -> Column:
    """A field of a JSON object as text, the last of a repeated key; true and false as "True" and "False"."""
    entries = F.filter(F.map_entries(F.from_json(value, "map<string,string>")), lambda e: e.key == key)
    got = F.try_element_at(entries, F.lit(-1)).getField("value")
    bare = value.rlike(f'"{key}"\\s*:\\s*(true|false)\\s*[,}}]')
    return F.when(got.isin("true", "false") & bare, F.initcap(got)).otherwise(got)


def _fields(value: Column, keys: Sequence[str]) -> list[Column]:
    return [_field(value, k) for k in dict.fromkeys(keys)]


def _json_ok(value: Column) -> Column:
    """Whether a line is a JSON object, also one that repeats a key."""
    return F.from_json(value, "map<string,string>").isNotNull()


def last_wins(rows: DataFrame, key: str, values: Sequence[str], order: Sequence[str] = ("file", "line_ord")) -> DataFrame:
    """One row a key: the values of the last record in order. Aggregated before the shuffle."""
    best = F.max_by(F.struct(*values), F.struct(*order)).alias("v")
    return rows.groupBy(key).agg(best).select(key, *[f"v.{c}" for c in values])


def parse_corpus(lines: DataFrame) -> DataFrame:
    """(doc_id, title, text) of lines (value, file, line_ord)."""
    v = F.col("value")
    json = lines.where(is_json_file(F.col("file")) & _json_ok(v)).select("file", "line_ord", first_present(*_fields(v, ID_KEYS)).alias("doc_id"), F.coalesce(first_present(*_fields(v, TITLE_KEYS)), F.lit("")).alias("title"), F.coalesce(first_present(*_fields(v, TEXT_KEYS)), F.lit("")).alias("text"))
    part = F.split(v, "\t")
    tsv = lines.where(~is_json_file(F.col("file")) & (F.size(part) >= 2)).select("file", "line_ord", part[0].alias("doc_id"), F.when(F.size(part) >= 3, part[1]).otherwise("").alias("title"), F.when(F.size(part) >= 3, F.get(part, 2)).otherwise(part[1]).alias("text"))
    return last_wins(json.unionByName(tsv).where("doc_id IS NOT NULL"), "doc_id", ["title", "text"])


def read_corpus(spark: SparkSession, files: Sequence[str]) -> DataFrame:
    return parse_corpus(_lines(spark, files))


def parse_topics(lines: DataFrame) -> DataFrame:
    """(qid, query): JSON records count if both are there; a tab-separated line always does, also one whose query is empty."""
    v = F.col("value")
    json = lines.where(is_json_file(F.col("file")) & _json_ok(v)).select("file", "line_ord", first_present(*_fields(v, TOPIC_ID_KEYS)).alias("qid"), first_present(*_fields(v, TOPIC_TEXT_KEYS)).alias("query"))
    part = F.split(v, "\t")
    tsv = lines.where(~is_json_file(F.col("file")) & (F.size(part) >= 2)).select("file", "line_ord", part[0].alias("qid"), part[1].alias("query"))
    return last_wins(json.where("qid <> '' AND query <> ''").unionByName(tsv), "qid", ["query"])


def read_topics(spark: SparkSession, files: Sequence[str]) -> DataFrame:
    return parse_topics(_lines(spark, files))


def parse_qrels(lines: DataFrame) -> DataFrame:
    """(qid, doc_id, rel, positive, ord): fields by white space, 2 to 4 of them; a relevance that is no number drops the
    line; anything not above 0, NaN too, is a negative. Repeats stay."""
    part = F.split(F.regexp_replace("value", r"(?U)^\s+|\s+$", ""), r"(?U)\s+")
    size = F.size(part)
    number = F.when(F.get(part, size - 1).rlike(r"^[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|inf|infinity|nan|(?i:inf|infinity|nan))$"), F.get(part, size - 1).try_cast("double"))
    rows = lines.where(size.between(2, 4)).select("file", "line_ord", part[0].alias("qid"), F.when(size == 4, F.get(part, F.lit(2))).otherwise(part[1]).alias("doc_id"), F.when(size == 2, F.lit(1.0)).otherwise(number).alias("rel"))
    rows = rows.where("rel IS NOT NULL")
    return rows.select("qid", "doc_id", "rel", ((F.col("rel") > 0) & ~F.isnan("rel")).alias("positive"), F.struct("file", "line_ord").alias("ord"))


def read_qrels(spark: SparkSession, files: Sequence[str]) -> DataFrame:
    return parse_qrels(_lines(spark, files))


def read_benchmark(spark: SparkSession, files: Sequence[str]) -> DataFrame:
    """(doc_id, title, text): the first id key that is there, even if null ("None"); the first non-empty title and text."""
    v = F.col("value")
    rows = _lines(spark, files).where(_json_ok(v))
    raw = [F.expr(f"try_variant_get(try_parse_json(value), '$.{k}', 'string')") for k in ID_KEYS]
    there = [F.expr(f"array_contains(json_object_keys(value), '{k}')") for k in ID_KEYS]
    doc_id = F.coalesce(*[F.when(t, F.coalesce(r, F.lit("None"))) for t, r in zip(there, raw, strict=True)])
    return rows.select(F.coalesce(doc_id, F.lit("")).alias("doc_id"), F.coalesce(first_present(*_fields(v, TITLE_KEYS)), F.lit("")).alias("title"), F.coalesce(first_present(*_fields(v, TEXT_KEYS)), F.lit("")).alias("text"))


def read_ood_passages(spark: SparkSession, files: Sequence[str]) -> DataFrame:
    v = F.col("value")
    rows = _lines(spark, files).select(first_present(*_fields(v, ("id", "passage_id", "_id"))).alias("doc_id"), first_present(*_fields(v, ("text", "passage"))).alias("text"))
    return rows.where("doc_id IS NOT NULL AND text IS NOT NULL")


def read_ood_queries(spark: SparkSession, files: Sequence[str]) -> DataFrame:
    """(qid, query, category): the category is "?" only where there is no type at all."""
    v = F.col("value")
    kind = F.when(F.array_contains(F.json_object_keys(v), "type"), F.coalesce(F.get_json_object(v, "$.type"), F.lit("None"))).otherwise("?")
    rows = _lines(spark, files).select("file", "line_ord", first_present(*_fields(v, ("query_id", "id"))).alias("qid"), first_present(*_fields(v, ("query", "text"))).alias("query"), kind.alias("category"))
    return last_wins(rows.where("qid IS NOT NULL AND query IS NOT NULL"), "qid", ["query", "category"])


def read_ood_qrels(spark: SparkSession, files: Sequence[str]) -> DataFrame:
    v = F.col("value")
    rel = F.coalesce(F.get_json_object(v, "$.relevance").try_cast("double"), F.lit(0.0))
    rows = _lines(spark, files).select(F.get_json_object(v, "$.query_id").alias("qid"), F.get_json_object(v, "$.passage_id").alias("doc_id"), rel.alias("rel"))
    return rows.where("rel > 0 AND NOT isnan(rel) AND qid IS NOT NULL AND doc_id IS NOT NULL").select("qid", "doc_id").distinct()


def read_query_file(spark: SparkSession, files: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Queries (qid, query, category) and judgements (qid, doc_id) from a file whose records embed their relevant ids."""
    v = F.col("value")
    rows = _lines(spark, files).where(_json_ok(v))
    ids = F.coalesce(*[F.from_json(F.get_json_object(v, f"$.{k}"), "array<string>") for k in ("relevant_ids", "relevant", "positive_ids")])
    got = rows.select(first_present(*_fields(v, ("query_id", *TOPIC_ID_KEYS))).alias("qid"), first_present(*_fields(v, ("query", "text", "question"))).alias("query"), F.coalesce(first_present(*_fields(v, ("category", "type"))), F.lit("?")).alias("category"), ids.alias("ids")).where("qid IS NOT NULL")
    return got.select("qid", "query", "category"), got.select("qid", F.explode("ids").alias("doc_id")).distinct()


def read_exclusions(spark: SparkSession, path: str | None) -> DataFrame:
    """(article_id): one a line, trimmed, blanks skipped; a missing file is an empty list."""
    empty = spark.createDataFrame([], "article_id string")
    if not path:
        return empty
    fs, jpath = _fs(spark, path)
    if not fs.exists(jpath):
        return empty
    return spark.read.text(path).select(F.regexp_replace("value", r"(?U)^\s+|\s+$", "").alias("article_id")).where("article_id <> ''").distinct()


PAIR_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("query", "positive", "query_id", "positive_id", "passage_id", "positive_title", "category", "split")] + [T.StructField(c, T.ArrayType(T.StringType())) for c in ("negatives", "negative_ids")])


def read_pairs(spark: SparkSession, files: Sequence[str]) -> DataFrame:
    """Pair records with all their fields, those of PAIR_SCHEMA and whatever else the files have, which are looked through
    for it first; a line that is not JSON is fatal."""
    found = spark.read.option("mode", "FAILFAST").json(list(files)).schema
    more = [f for f in found if f.name not in PAIR_SCHEMA.names]
    return spark.read.schema(T.StructType([*PAIR_SCHEMA, *more])).option("mode", "FAILFAST").json(list(files))


def read_done_ids(spark: SparkSession, path: str, key: str = "passage_id") -> DataFrame:
    """Ids that a sink of JSON lines already has; broken lines are passed over, a missing sink is empty."""
    fs, jpath = _fs(spark, path)
    if not fs.exists(jpath):
        return spark.createDataFrame([], f"{key} string")
    return spark.read.text(path).select(F.get_json_object("value", f"$.{key}").alias(key)).where(f"{key} IS NOT NULL").distinct()


def read_stems(spark: SparkSession, path: str) -> DataFrame:
    """(word, stem) of a JSON object of words."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", "map<string,string>")).alias("word", "stem"))
