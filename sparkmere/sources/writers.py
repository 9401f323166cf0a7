"""Writers of JSON lines, reports and tables for the console."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Folder of JSON lines; null fields are left out, characters beyond ASCII stand as they are."""
    df.write.mode(mode).json(path)


def write_report(report: DataFrame, path: str) -> None:
    """A report of one row as indented JSON, as one file in a folder."""
    report.select(F.to_json(F.struct(*report.columns), {"pretty": "true"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def append_verbatim(spark, files: list[str], path: str) -> None:
    """The lines of `files`, blank ones aside, added to a folder of JSON lines as they stand."""
    spark.read.text(files).where(F.trim("value") != "").write.mode("append").text(path)


def ids_only(mined: DataFrame) -> DataFrame:
    """Mined pairs without their texts: (query, positive_id, negative_ids, category)."""
    from sparkmere.functions.text import first_present

    pos = first_present(F.col("positive_id"), F.col("passage_id")) if "passage_id" in mined.columns else first_present(F.col("positive_id"))
    return mined.select("query", F.coalesce(pos, F.lit("")).alias("positive_id"), "negative_ids", "category" if "category" in mined.columns else F.lit(None).cast("string").alias("category"))


def console_table(rows: DataFrame, p_col: str = "p_value", delta_col: str = "delta") -> DataFrame:
    """Lines of fixed width: scope, numbers to three places, and a star where p < 0.05."""
    nums = [c for c, t in rows.dtypes if t == "double" and c not in (p_col, delta_col)]
    parts = [F.rpad("scope", 16, " "), *[F.lpad(F.format_number(c, 3), 9, " ") for c in nums]]
    if delta_col in rows.columns:
        parts += [F.lpad(F.format_string("%+.3f", F.col(delta_col)), 9, " ")]
    if p_col in rows.columns:
        parts += [F.lpad(F.format_string("%.3f", F.col(p_col)), 8, " "), F.when(F.col(p_col) < 0.05, "*").otherwise(" ")]
    return rows.select(F.concat(*parts).alias("line"))


def write_named(lines: DataFrame, folder: str, name: str) -> None:
    """Lines (value) as data files under a name that readers go by, numbered before its suffixes; one a partition, gzipped
    if the name says so."""
    spark = lines.sparkSession
    stem, _, suffix = name.partition(".")
    own = f"{folder}/_{stem}"
    lines.select("value").write.option("compression", "gzip" if name.endswith(".gz") else "none").text(own)
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(own).getFileSystem(spark._jsc.hadoopConfiguration())
    parts = sorted(n for f in fs.listStatus(path(own)) if (n := f.getPath().getName()).startswith("part-"))
    for k, part in enumerate(parts):
        if not fs.rename(path(f"{own}/{part}"), path(f"{folder}/{stem}-{k:05d}.{suffix}")):
            raise OSError(f"{folder}/{stem}-{k:05d}.{suffix} can't be written")
    fs.delete(path(own), True)
