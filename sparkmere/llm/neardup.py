"""MinHash near-dedup: improved consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard.

The weight of a shingle (five words) in a text is its count times a smoothed idf = ln(1000 / share of the documents that
have it): what is commoner (boilerplate) weighs less, and what all have weighs half of what one in a thousand has, so that
near copies in groups of thousands, whose common shingles are frequent, remain alike. See `Idf` for the sketch.

Steps: exact copies become one class each; every class's text is sampled 36 times (the same shingle and step come out with
a probability equal to the weighted Jaccard similarity), 12 bands of 3; texts that share a band are candidates. At
similarity 0.8 a pair shares no band with a probability of (1 - 0.8^3)^12 = 0.0002. Candidates in small buckets are all
tried; in large ones see `_links_in_large`. Every link kept has been verified over whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .places import field, located, marked, unpacked, with_side, write_side
from .store import materialise
from .words import U64, groups, mix, shingles, word_hashes

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 12, 3
#: Cells of a row of the sketch of document frequencies; idf's constant; the least share that is told from lesser ones.
CELLS, SMOOTH, LEAST = 1 << 21, 1000.0, 0.001
#: Texts are worked on in groups of so many bytes; so many words' hashes are remembered between groups.
GROUP, MEMO = 1 << 20, 100_000
#: Buckets of up to so many texts have all pairs tried.
SMALL = 12
#: A shingle that at most so many of the texts in large buckets have is rare.
RARE = 8
#: A pair is verified only if this many of its samples agree; at similarity 0.8 fewer do with a probability of 1e-5.
AGREE = BANDS * ROWS * 4 // 9


def _features(raws: list[bytes], memo: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, 44-bit shingle, count) of the texts' different shingles, sorted."""
    h, n = word_hashes([r.lower() for r in raws], memo)
    of, s = shingles(h, n, SHINGLE)
    key = np.sort((of.astype(U64) << U64(44)) | (s >> U64(20)))
    if not len(key):
        return np.zeros(0, np.int64), key, np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    count = np.diff(np.append(first, len(key)))
    key = key[first]
    return (key >> U64(44)).astype(np.int64), key & U64((1 << 44) - 1), count


def _cells(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    m = mix(s)
    return (m & U64(CELLS - 1)).astype(np.int64), ((m >> U64(32)) & U64(CELLS - 1)).astype(np.int64)


class Idf:
    """idf = ln(SMOOTH / share), share the part of all documents that have the shingle.

    The shares come from a count-min sketch: two rows of CELLS counts, the lesser of which counts. A shingle's count is too
    large by what else falls in its cell: on the mean shingles / CELLS, so the share's error is the mean number of
    different shingles a document over CELLS, whatever the corpus's size. Shares below twice that, or LEAST, count as that.
    """

    def __init__(self, table: np.ndarray, n: int):
        self.floor = max(LEAST, 2 * float(table[0].sum()) / max(n, 1) / CELLS)
        self.table = np.log(SMOOTH / np.clip(table / max(n, 1), self.floor, 1)).astype(np.float32)

    def of(self, s: np.ndarray) -> np.ndarray:
        a, b = _cells(s)
        return np.maximum(self.table[0][a], self.table[1][b])


def document_frequencies(texts: DataFrame) -> Idf:
    """The idf of hashed shingles over all rows of `texts` (_text). A task gives its 2 * CELLS counts, compressed; they are
    added up in two steps, so the driver gets one table of that size."""
    parts, salts = 64, 32

    def cut(table: np.ndarray) -> list[bytes]:
        return [zstandard.compress(x.tobytes(), 1) for x in table.reshape(parts, -1)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, n, memo = np.zeros((2, CELLS), np.uint32), 0, {}
        for batch in batches:
            for _, raws in groups(batch, "_text", GROUP):
                _, s, _ = _features(raws, memo)
                for row, cell in enumerate(_cells(s)):
                    np.add.at(table[row], cell, np.uint32(1))
                n += len(raws)
                if len(memo) > MEMO:
                    memo.clear()
        if n:
            salt = TaskContext.get().partitionId() % salts
            yield pa.RecordBatch.from_arrays([pa.array(range(parts + 1), pa.int32()), pa.array([salt] * (parts + 1), pa.int32()), pa.array([*cut(table), np.int64(n).tobytes()], pa.binary())], names=["part", "salt", "counts"])

    def add(key: tuple, table: pa.Table) -> pa.Table:
        part, column = key[0].as_py(), table.column("counts")
        if part == parts:
            got = np.int64(sum(int.from_bytes(x.as_py(), "little") for x in column)).tobytes()
        else:
            total = None
            for x in column:
                more = np.frombuffer(zstandard.decompress(x.as_py()), np.uint32)
                total = more.astype(np.int64) if total is None else total + more
            got = zstandard.compress(np.minimum(total, (1 << 32) - 1).astype(np.uint32).tobytes(), 1)
        return pa.table({"part": pa.array([part], pa.int32()), "counts": pa.array([got], pa.binary())})

    schema = "part int, counts binary"
    got = texts.select("_text").mapInArrow(count, "part int, salt int, counts binary")
    got = got.groupBy("part", "salt").applyInArrow(add, schema).groupBy("part").applyInArrow(add, schema)
    found = {r.part: bytes(r.counts) for r in got.collect()}
    if not found:
        return Idf(np.zeros((2, CELLS), np.uint32), 0)
    table = np.concatenate([np.frombuffer(zstandard.decompress(found[i]), np.uint32) for i in range(parts)]).reshape(2, CELLS)
    return Idf(table, int.from_bytes(found[parts], "little"))


def _weights(s: np.ndarray, count: np.ndarray, idf: Idf) -> np.ndarray:
    return count * idf.of(s).astype(np.float64)


def sample(of: np.ndarray, s: np.ndarray, w: np.ndarray, n_docs: int) -> np.ndarray:
    """Improved consistent weighted samples: a 32-bit hash of the chosen (shingle, step) for each text and k.

    For shingle s and k: r, c ~ Gamma(2, 1), beta ~ U(0, 1), all from hashes of (s, k); step t = floor(ln w / r + beta),
    ln y = r (t - beta), ln a = ln c - ln y - r; the least a wins. Texts without words get zeros.
    """
    out = np.zeros((n_docs, BANDS * ROWS), np.uint32)
    if not len(s):
        return out
    first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
    docs, runs = of[first], np.diff(np.append(first, len(of)))
    log_w = np.log(w).astype(np.float32)
    unit = np.float32(1 / 65536)
    for k in range(BANDS * ROWS):
        z = mix(s + U64((0x9E3779B97F4A7C15 * (k + 1)) & (2**64 - 1)))
        u = z.view(np.uint16).reshape(-1, 4).astype(np.float32)
        u += np.float32(0.5)
        u *= unit
        beta = (mix(z) >> U64(40)).astype(np.float32) * np.float32(2.0**-24)
        r = -np.log(u[:, 0] * u[:, 1])
        t = np.floor(log_w / r + beta)
        a = np.log(-np.log(u[:, 2] * u[:, 3])) - r * (t - beta) - r
        least = np.repeat(np.minimum.reduceat(a, first), runs)
        at = np.flatnonzero(a == least)
        at = at[np.searchsorted(at, first)]
        out[docs, k] = (mix(s[at] ^ (t[at].astype(np.int64).astype(U64) << U64(48))) >> U64(32)).astype(np.uint32)
    return out


def signatures(texts: DataFrame, side: tuple[str, str], idf) -> DataFrame:
    """(id, sig binary) of the texts (file, row, _text) that `side` gives an id and that have words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        for batch in marked(batches, side):
            for first, raws in groups(batch, "_text", GROUP):
                of, s, count = _features(raws, memo)
                if len(memo) > MEMO:
                    memo.clear()
                sig = sample(of, s, _weights(s, count, idf.value), len(raws))
                has = np.unique(of)
                yield pa.RecordBatch.from_arrays([batch.column("value").slice(first, len(raws)).take(pa.array(has)), pa.array([sig[i].tobytes() for i in has], pa.binary())], names=["id", "sig"])

    return texts.mapInArrow(run, "id long, sig binary")


def buckets(sigs: DataFrame) -> DataFrame:
    """(bucket, id): each text in its bands' buckets, those with two texts or more, with their size n."""
    band = [F.xxhash64(F.lit(b), F.substring("sig", 4 * ROWS * b + 1, 4 * ROWS)) for b in range(BANDS)]
    rows = sigs.select("id", F.explode(F.array(*band)).alias("bucket"))
    full = rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    return rows.join(full, "bucket")


def agreeing(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """The different pairs (a, b), a < b, whose samples agree often enough to be worth verifying."""
    hexed = F.hex("sig")
    same = sum((F.substring(F.col("sa"), 8 * k + 1, 8) == F.substring(F.col("sb"), 8 * k + 1, 8)).cast("int") for k in range(BANDS * ROWS))
    got = pairs.join(sigs.select(F.col("id").alias("a"), hexed.alias("sa")), "a").join(sigs.select(F.col("id").alias("b"), hexed.alias("sb")), "b")
    return got.where(same >= AGREE).select("a", "b")


class Corpus:
    """The documents with their places, and for every row its text's hash and node.

    A node is a different text: its key is that of the first row that has it. Rows with a null id have none.
    """

    def __init__(self, docs: DataFrame, id_col: str, text_col: str):
        text = F.coalesce(field(text_col).cast("string"), F.lit(""))
        self.rows = located(docs)
        self.texts = self.rows.select("file", "row", text.alias("_text"))
        narrow = self.rows.select("file", "row", field(id_col).alias("id"), F.md5(text.cast("binary")).alias("code"), F.monotonically_increasing_id().alias("nid"))
        self.coded = materialise(narrow, "neardup-codes")
        known = self.coded.where("id IS NOT NULL")
        first = materialise(known.groupBy("code").agg(F.min("nid").alias("node"), F.min("id").alias("copy_of")), "neardup-different")
        self.nodes = materialise(known.join(first, "code"), "neardup-nodes")
        self.first = self.nodes.where("nid = node").select("node", "copy_of")

    def side_of(self, ids: DataFrame | None, name: str) -> tuple[str, str]:
        """The nodes `ids` (id), or all, beside the rows that stand for them."""
        own = self.nodes.where("nid = node").select("nid", "node")
        if ids is not None:
            own = own.join(ids.select(F.col("id").alias("node")), "node", "left_semi")
        marks = self.coded.select("file", "row", "nid").join(own, "nid", "left").select("file", "row", F.col("node").alias("value"))
        return write_side(marks, name)

    def texts_of(self, ids: DataFrame, name: str) -> DataFrame:
        """(id, _text) of the nodes `ids` (id): read where they lie."""
        return with_side(self.texts, self.side_of(ids, name)).select(F.col("value").alias("id"), "_text")


def verify(pairs: DataFrame, texts: DataFrame, idf, threshold: float) -> DataFrame:
    """Pairs (a, b, similarity) of weighted Jaccard similarity `threshold` or more, over whole texts."""
    joined = pairs.join(texts.select(F.col("id").alias("a"), F.col("_text").alias("ta")), "a").join(texts.select(F.col("id").alias("b"), F.col("_text").alias("tb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        for batch in batches:
            for first, left in groups(batch, "ta", GROUP):
                right = [(x.as_py() or "").encode() for x in batch.column("tb").slice(first, len(left))]
                sides = []
                for raws in (left, right):
                    of, s, count = _features(raws, memo)
                    sides.append(((of.astype(U64) << U64(44)) | s, _weights(s, count, idf.value), of))
                (ka, wa, oa), (kb, wb, ob) = sides
                _, ia, ib = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
                low = np.bincount(oa[ia], np.minimum(wa[ia], wb[ib]), len(left))
                both = np.bincount(oa, wa, len(left)) + np.bincount(ob, wb, len(left))
                sim = low / np.maximum(both - low, 1e-300)
                ok = np.flatnonzero(sim >= threshold)
                if len(memo) > MEMO:
                    memo.clear()
                part = batch.slice(first, len(left)).take(pa.array(ok))
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(sim[ok])], names=["a", "b", "similarity"])

    return joined.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long, similarity double")


def own_mass(texts: DataFrame, idf) -> tuple[DataFrame, DataFrame]:
    """(id, total, shared): a text's weight, and the weight of its shingles that more than RARE of these texts have; and
    the pairs (a, b) of texts that have a rarer shingle in common, at most RARE texts a shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        for batch in batches:
            for first, raws in groups(batch, "_text", GROUP):
                of, s, count = _features(raws, memo)
                w = _weights(s, count, idf.value)
                if len(memo) > MEMO:
                    memo.clear()
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(first, len(raws)).take(pa.array(of)), pa.array(s.astype(np.int64)), pa.array(w)], names=["id", "s", "w"])

    rows = texts.mapInArrow(run, "id long, s long, w double")
    rows = materialise(rows, "neardup-mass")
    seen = rows.groupBy("s").agg(F.count("*").alias("n"), F.max("id").alias("id"), F.max("w").alias("w")).where(F.col("n") <= RARE)
    seen = materialise(seen, "neardup-rare")
    rare = materialise(rows.join(seen.where("n > 1").select("s"), "s"), "neardup-rare-rows")
    few = seen.where("n = 1").select("id", "w").unionByName(rare.select("id", "w")).groupBy("id").agg(F.sum("w").alias("few"))
    total = rows.groupBy("id").agg(F.sum("w").alias("total"))
    mass = total.join(few, "id", "left").select("id", "total", (F.col("total") - F.coalesce("few", F.lit(0.0))).alias("shared"))
    pairs = rare.select("s", F.col("id").alias("a")).join(rare.select("s", F.col("id").alias("b")), "s").where("a < b").select("a", "b").distinct()
    return mass, pairs


def _links_in_large(large: DataFrame, sigs: DataFrame, corpus: Corpus, idf, threshold: float) -> DataFrame:
    """All links that join buckets of more than SMALL texts need for their classes, without all pairs.

    Pairs that have a rare shingle in common are few and all tried. Any other link's common weight is at most what either
    text has in shingles that aren't rare, so its similarity is at most m / (Wa + Wb - m), m the less of those weights:
    texts much of whose weight is their own have no such link, exactly. Each bucket's leader, the text with the least share of its own, is tried with all others. What is linked so is one
    class and needs no more; the bucket's other texts are then tried with all texts of other classes, as far as the bound
    allows a link. In a group of near copies the leader is next to the original, and few if any are left.
    """
    ids = materialise(large.select("id").distinct(), "neardup-large-ids")
    texts = materialise(corpus.texts_of(ids, "neardup-large-side"), "neardup-large-texts")
    mass, rare = own_mass(texts, idf)
    mass = materialise(mass.where(F.col("shared") >= F.lit(threshold) * F.col("total")), "neardup-bounds")
    rows = materialise(large.join(mass, "id"), "neardup-large")
    order = F.struct((F.col("total") - F.col("shared")) / F.col("total"), F.col("id"))
    lead = rows.groupBy("bucket").agg(F.min(F.struct(order.alias("o"), "id", "total", "shared")).alias("m")).select("bucket", F.col("m.id").alias("lid"), F.col("m.total").alias("lt"), F.col("m.shared").alias("ls"))

    # A table of its own: the join after it is then of two plain inputs, so that the rows of a hot bucket can be split.
    lead = materialise(lead, "neardup-leaders")

    def bounded(wa, sa, wb, sb):
        m = F.least(sa, sb)
        return m >= F.lit(threshold) * (wa + wb - m) * F.lit(1 - 1e-9)

    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    stars = rows.join(lead, "bucket").where((F.col("id") != F.col("lid")) & bounded(F.col("total"), F.col("shared"), F.col("lt"), F.col("ls"))).select(*pair(F.col("id"), F.col("lid"))).unionByName(rare).distinct()
    stars = materialise(agreeing(stars, sigs), "neardup-stars")
    links = materialise(verify(stars, texts, idf, threshold), "neardup-star-links")
    classes = components(ids, links)
    rows = materialise(rows.join(classes.withColumnRenamed("class_id", "cls"), "id"), "neardup-classed")
    main = rows.groupBy("bucket").agg(F.count("*").alias("size"), F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo < hi")
    main = materialise(main.select("bucket"), "neardup-mixed")
    rows = materialise(rows.join(main, "bucket"), "neardup-open")
    best = rows.groupBy("bucket", "cls").agg(F.count("*").alias("k")).groupBy("bucket").agg(F.max(F.struct("k", "cls")).alias("m")).select("bucket", F.col("m.cls").alias("main"))
    best = materialise(best, "neardup-main")
    rest = rows.join(best, "bucket").where(F.col("cls") != F.col("main")).select("bucket", F.col("id").alias("x"), F.col("cls").alias("xc"), F.col("main"), F.col("total").alias("xt"), F.col("shared").alias("xs"))
    rest = materialise(rest, "neardup-others")
    open_ = rest.join(rows, "bucket").where((F.col("cls") != F.col("xc")) & ((F.col("cls") == F.col("main")) | (F.col("id") < F.col("x"))) & bounded(F.col("total"), F.col("shared"), F.col("xt"), F.col("xs")))
    more = materialise(agreeing(open_.select(*pair(F.col("id"), F.col("x"))).distinct(), sigs), "neardup-rest")
    return links.unionByName(verify(more, texts, idf, threshold))


def classify(docs: DataFrame, id_col: str, text_col: str, threshold: float) -> tuple[Corpus, DataFrame]:
    """The corpus, and (nid, id, code, copy_of, class_id) of its rows with an id."""
    corpus = Corpus(docs, id_col, text_col)
    idf = docs.sparkSession.sparkContext.broadcast(document_frequencies(corpus.texts))
    sigs = materialise(signatures(corpus.texts, corpus.side_of(None, "neardup-side"), idf), "neardup-sigs")
    bucketed = materialise(buckets(sigs).distinct(), "neardup-buckets")
    small = bucketed.where(F.col("n") <= SMALL).select("bucket", "id")
    pairs = small.alias("x").join(small.alias("y"), "bucket").where("x.id < y.id").select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    pairs = materialise(agreeing(pairs, sigs), "neardup-pairs")
    tried = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    texts = materialise(corpus.texts_of(tried, "neardup-pair-side"), "neardup-texts")
    links = materialise(verify(pairs, texts, idf, threshold), "neardup-links").select("a", "b")
    large = bucketed.where(F.col("n") > SMALL).select("bucket", "id")
    if large.limit(1).count():
        links = links.unionByName(_links_in_large(large, sigs, corpus, idf, threshold).select("a", "b"))
    # A repeated id links the nodes of its texts.
    ids = corpus.nodes.groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("hi")).where("a < hi")
    chain = corpus.nodes.join(ids.select("id", "a"), "id").where("node > a").select("a", F.col("node").alias("b"))
    links = materialise(links.unionByName(chain).distinct(), "neardup-all-links")
    classes = materialise(components(corpus.first.select(F.col("node").alias("id")), links), "neardup-classes").withColumnRenamed("id", "node")
    least = corpus.first.join(classes, "node").groupBy("class_id").agg(F.min("copy_of").alias("least"))
    named = classes.join(least, "class_id").select("node", F.col("least").alias("class_id"))
    return corpus, corpus.nodes.join(named, "node").select("nid", "id", "code", "copy_of", "class_id")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id_col, class_id, copy_of) for every row of `docs`: rows of one class are exact or near copies, directly or in a chain.

    class_id is the least id of the class, copy_of the least id with exactly this text; ids may be of any type that has an
    order. Null and empty texts are copies of each other; texts of white space alone are like only their exact copies.
    Texts under five words have one shingle of all their words. Letters A-Z count as lower case. Each different text is a
    node, however often its row or id is repeated; the classes of a repeated id's texts are one. Rows with a null id have
    null class and copy_of. Other columns don't matter, whatever their names. An empty table gives an empty result.
    """
    corpus, found = classify(docs, id_col, text_col, threshold)
    nothing = corpus.coded.where("id IS NULL").select("id", F.col("id").alias("class_id"), F.col("id").alias("copy_of"))
    return found.select("id", "class_id", "copy_of").unionByName(nothing).withColumnRenamed("id", id_col)


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """`docs` with one document of each class, the one of the least id; of rows that repeat that id the one of the least
    text hash, then place. Rows with a null id stay. The documents are read where they lie and not shuffled."""
    corpus, found = classify(docs, id_col, text_col, threshold)
    best = found.where(F.col("id") == F.col("class_id")).groupBy("class_id").agg(F.min(F.struct("code", "nid")).alias("m")).select(F.col("m.nid").alias("nid"), F.lit(1).cast("long").alias("_w"))
    marks = corpus.coded.join(best, "nid", "left").select("file", "row", F.when(F.col("id").isNull(), F.lit(0).cast("long")).otherwise(F.col("_w")).alias("value"))
    return unpacked(with_side(corpus.rows, write_side(marks, "neardup-keep")), docs.columns)
