"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

A short item of n shingles inside a document of m has a Jaccard similarity of n / m at most, so a banded Jaccard index
loses just the cases sought: no number of bands finds 30 shingles in 20,000. The containment form of MinHash has no
such limit. For a random hash, the item's least shingle is in the document with a probability equal to the containment
|Q & X| / |Q|, whatever |X| is. Each item therefore is sketched by its least shingle under each of `k` hashes, and every
shingle of every document is looked up among those. At containment 0.8 and k = 16 an item stays unseen with a
probability of 0.2^16, 7e-12. Items are partitioned by size: those of at most `k` shingles are their own sketch, and
a document is a candidate only for classes whose smallest items it is long enough to hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .places import field, quoted, unpacked, whole
from .store import materialise, maybe_broadcast

SHINGLE, THRESHOLD, HASHES = 5, 0.8, 16
SEPARATORS = r"[^\p{L}\p{N}]+"


def norm_words(text: Column) -> Column:
    """Lower-case runs of letters and digits; null text has none."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def shingle_array(words: Column, n: int = SHINGLE) -> Column:
    """64-bit hashes of the runs of `n` words, repeats included; fewer words have none."""
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - F.lit(n - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(words, i, n)))).otherwise(F.array().cast("array<bigint>"))


def item_shingles(items: DataFrame, item_col: str, text_col: str, n: int) -> DataFrame:
    """(_item, width, item_sh, n_item): an item under `n` words has one shingle, of all its words."""
    words = items.select(quoted(item_col).alias("_item"), norm_words(quoted(text_col)).alias("w"))
    found = F.when(F.size("w") >= n, F.array_distinct(shingle_array(F.col("w"), n))).otherwise(F.array(F.xxhash64("w")))
    got = words.where(F.col("_item").isNotNull() & (F.size("w") > 0)).select("_item", F.least(F.size("w"), F.lit(n)).alias("width"), found.alias("item_sh"))
    return got.withColumn("n_item", F.size("item_sh").cast("long"))


def sketches(items: DataFrame, k: int = HASHES) -> DataFrame:
    """Rows (size_class, _item, n_item, s): the shingles by which an item is sought. size_class is the power of 2 below n_item."""
    least = [F.array_min(F.transform("item_sh", lambda s, i=i: F.struct(F.xxhash64(s, F.lit(i)).alias("h"), s.alias("s")))).getField("s") for i in range(k)]
    picked = F.when(F.col("n_item") <= k, F.col("item_sh")).otherwise(F.array_distinct(F.array(*least)))
    return items.select(F.floor(F.log2("n_item")).cast("int").alias("size_class"), "_item", "n_item", F.explode(picked).alias("s"))


def find_contained(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = THRESHOLD, n: int = SHINGLE, k: int = HASHES) -> DataFrame:
    """Pairs (id_col, item_col, n_shared, n_item, containment) with containment >= `threshold`, one row a pair.

    Null or empty texts match nothing. An item under `n` words is one shingle of all its words, sought among runs of as many
    words. Rows with a null id are not reported; rows that repeat an id count as one document with the union of their
    matches, the best one given. Ids may be of any type. Extra columns are ignored, whatever their names. Whole texts are
    searched. An empty table on either side gives an empty result.

    The sketch and the candidates are broadcast if they take up to 64 MB, as measured, and are joined by a shuffle beyond.
    """
    known = materialise(item_shingles(items, item_col, item_text_col, n), "decon-items")
    probes = materialise(sketches(known, k), "decon-sketch").withColumn("needs", F.ceil(F.lit(float(threshold)) * F.pow(F.lit(2.0), F.col("size_class"))))
    short = sorted(r.width for r in known.where(F.col("width") < n).select("width").distinct().collect())
    d = docs.where(quoted(id_col).isNotNull())
    words = d.select(quoted(id_col).alias("_doc"), norm_words(quoted(text_col)).alias("w")).where(F.size("w") >= min([*short, n]))
    runs = shingle_array(F.col("w"), n) if not short else F.concat(*[shingle_array(F.col("w"), m) for m in [*short, n]])
    size = F.greatest(F.size("w") - (n - 1), F.lit(1)).alias("m")
    found = words.select("_doc", size, F.explode(runs).alias("s")).join(maybe_broadcast(probes), "s").where(F.col("m") >= F.col("needs"))
    candidates = materialise(found.select("_doc", "_item").distinct(), "decon-candidates")
    texts = words.join(maybe_broadcast(materialise(candidates.select("_doc").distinct(), "decon-ids")), "_doc", "left_semi")
    texts = texts.select("_doc", F.array_distinct(runs).alias("doc_sh"))
    pairs = texts.join(maybe_broadcast(candidates), "_doc").join(maybe_broadcast(known), "_item")
    shared = F.size(F.array_intersect("doc_sh", "item_sh")).cast("long")
    pairs = pairs.select("_doc", "_item", "n_item", shared.alias("n_shared")).where(F.col("n_shared") >= F.col("n_item") * F.lit(float(threshold)))
    best = pairs.groupBy("_doc", "_item").agg(F.max("n_shared").alias("n_shared"), F.max("n_item").alias("n_item"))
    return best.select(F.col("_doc").alias(id_col), F.col("_item").alias(item_col), "n_shared", "n_item", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def decontaminate(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", **how) -> DataFrame:
    """The rows of `docs` that hold no item; rows with a null id stay. Columns stay, whatever their names."""
    bad = materialise(find_contained(docs, items, id_col=id_col, **how).select(quoted(id_col).alias("_bad")).distinct(), "decon-bad")
    rows = docs.select(whole(docs))
    return unpacked(rows.join(maybe_broadcast(bad), field(id_col) == F.col("_bad"), "left_anti"), docs.columns)
