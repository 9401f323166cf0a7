"""Repeated passages by a sparse suffix array.

Of all suffixes (a text from one of its words on) those are retained that start at minimiser positions: of every 25
positions in a row, the one whose leading 26 words have the least hash. Two texts that share a passage of 50 words or
more share a retained suffix's leading 26 words, as the passage's first 25 positions and their 26 words lie within it.

The retained suffixes are sorted by their leading words (a hash stands for them: any order that puts equal ones side by
side will do), and neighbours are compared: a run of equal ones in which the documents change is shared. From each shared
suffix the match is extended, to the left by up to 24 words and to the right as far as 50 are full: the suffixes that start
there are sorted and compared likewise, by all of their 50 words. Those that another document has join to maximal spans.
Fifty words are compared by two independent hashes of 64 bits, so that 1e13 windows have a false match with a probability of
1e-12.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .places import field, located, marked, write_side
from .store import materialise, maybe_broadcast
from .words import U64, groups, mix, window_hashes, word_hashes

MIN_WORDS = 50
LEAD = 26
SPAN = MIN_WORDS - LEAD + 1
#: Turns a word's hash into a second one.
_OTHER = U64(0x9FB21C651E98DF25)


def minimisers(keys: np.ndarray, span: int = SPAN) -> np.ndarray:
    """Positions that hold the least of some `span` keys in a row (the leftmost of equal ones)."""
    n = len(keys)
    if n < span:
        return np.zeros(0, np.int64)
    pad = -n % span
    k = np.concatenate((keys, np.full(pad, np.iinfo(np.uint64).max, np.uint64))).reshape(-1, span)
    before = np.minimum.accumulate(k, axis=1).ravel()
    after = np.minimum.accumulate(k[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(after[: n - span + 1], before[span - 1 : n])
    own = np.flatnonzero(np.isin(keys, least)) if n < 64 else _hits(keys, least, span)
    return own


def _hits(keys: np.ndarray, least: np.ndarray, span: int) -> np.ndarray:
    """Positions whose key is the least of a window over them: equal keys in one window all count."""
    n = len(keys)
    change = np.concatenate(([True], least[1:] != least[:-1]))
    starts = np.flatnonzero(change)
    ends = np.append(starts[1:], len(least))
    value, lo, hi = least[starts], starts, ends - 1 + span
    order = np.argsort(keys, kind="stable")
    at = keys[order]
    a, b = np.searchsorted(at, value), np.searchsorted(at, value, "right")
    single = b - a == 1
    found = [order[a[single]]]
    for i in np.flatnonzero(~single):
        p = order[a[i] : b[i]]
        found.append(p[(p >= lo[i]) & (p < hi[i])])
    return np.unique(np.concatenate(found)) if n else np.zeros(0, np.int64)


def _emit(keys: list, more: list, owners: list, places: list) -> pa.RecordBatch:
    flat = lambda x, t: np.concatenate(x).astype(t, copy=False)
    own = np.concatenate(owners)
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(more).view(np.int64)), pa.array(own[:, 0]), pa.array(own[:, 1]), pa.array(flat(places, np.int32))], names=["key", "key2", "doc", "node", "pos"])


_ROWS = "key long, key2 long, doc long, node long, pos int"


def _read(batches: Iterator[pa.RecordBatch], side: tuple[str, str], least: int) -> Iterator[list[tuple[np.ndarray, np.ndarray]]]:
    """Groups of (word hashes, side value) of the texts of `least` words or more that have a value."""
    memo: dict = {}
    for batch in marked(batches, side):
        for first, raws in groups(batch, "_text"):
            h, n = word_hashes(raws, memo)
            if len(memo) > 500_000:
                memo.clear()
            value = batch.column("value").slice(first, len(raws))
            flat, at = value.values.to_numpy(), value.offsets.to_numpy()
            ends = np.cumsum(n)
            yield [(h[ends[i] - n[i] : ends[i]], flat[at[i] : at[i + 1]]) for i in np.flatnonzero(n >= least)]


def suffixes(texts: DataFrame, side: tuple[str, str]) -> DataFrame:
    """Retained suffixes (key, key2 = 0, doc, node, pos) of the texts (file, row, _text) whose value in `side` is [doc, node]."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _read(batches, side, MIN_WORDS):
            keys, owners, places = [], [], []
            for h, own in found:
                k = window_hashes(h, LEAD)
                p = minimisers(k)
                keys.append(k[p])
                owners.append(np.broadcast_to(own, (len(p), 2)))
                places.append(p)
            if keys:
                yield _emit(keys, [np.zeros(len(k), U64) for k in keys], owners, places)

    return texts.mapInArrow(run, _ROWS)


def extensions(texts: DataFrame, side: tuple[str, str]) -> DataFrame:
    """The suffixes (key and key2 of their first 50 words, doc, node, pos) around the shared ones of the texts (file, row,
    _text) whose value in `side` is [doc, node, positions ...]."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _read(batches, side, MIN_WORDS):
            keys, more, owners, places = [], [], [], []
            for h, own in found:
                last = len(h) - MIN_WORDS + 1
                edge = np.zeros(len(h) + 1, np.int64)
                np.add.at(edge, np.clip(own[2:] - (MIN_WORDS - LEAD), 0, last), 1)
                np.add.at(edge, np.clip(own[2:] + 1, 0, last), -1)
                on = np.flatnonzero(np.cumsum(edge[:last]) > 0)
                keys.append(window_hashes(h, MIN_WORDS)[on])
                more.append(window_hashes(mix(h ^ _OTHER), MIN_WORDS)[on])
                owners.append(np.broadcast_to(own[:2], (len(on), 2)))
                places.append(on)
            if keys:
                yield _emit(keys, more, owners, places)

    return texts.mapInArrow(run, _ROWS)


SHARED, OPEN, EDGE = range(3)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbours of sorted suffixes (key, key2, doc, node, pos): those of runs in which the documents change (SHARED), those
    of a partition's first and last run whose partition knows one document only (OPEN), and for these two runs the least and
    greatest document (EDGE, in doc and node). Beside a batch only the end of a run of one document is held."""
    names = ["key", "key2", "doc", "node", "pos"]
    held = [np.zeros(0, np.int64) for _ in names]
    # Of the run that goes on: its key, its first document, whether another was met, whether it is the partition's first.
    key, low, high, mixed, first = None, 0, 0, False, True

    def rows(cols: list[np.ndarray], state: int) -> pa.RecordBatch:
        cols = [*cols[:4], cols[4].astype(np.int32), np.full(len(cols[0]), state, np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=[*names, "state"])

    def edge() -> pa.RecordBatch:
        return rows([np.array([x], np.int64) for x in (*key, low, high, 0)], EDGE)

    def one(i: slice, cols: list[np.ndarray]) -> list[np.ndarray]:
        return [c[i] for c in cols]

    for batch in batches:
        if not len(batch):
            continue
        cols = [batch.column(c).to_numpy().astype(np.int64) for c in names]
        if len(held[0]):
            cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            held = [c[:0] for c in cols]
        new = np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])) + 1
        begins, ends = np.append(0, new), np.append(new, len(cols[0]))
        lo, hi = cols[2][begins], cols[2][ends - 1]
        state = np.where(lo != hi, SHARED, -1)
        at = 0
        if key is not None and (cols[0][0], cols[1][0]) == key:
            # The first run goes on from the batch before.
            mixed = mixed or low != hi[0]
            high = hi[0]
            state[0] = SHARED if mixed else -1
            at = 1
        elif key is not None:
            if first:
                yield edge()
            first = False
        if len(begins) > 1:
            # All runs but the last end in this batch.
            if first:
                if at == 0:
                    key, low, high = (cols[0][0], cols[1][0]), lo[0], hi[0]
                yield edge()
                if state[0] != SHARED:
                    yield rows(one(slice(0, ends[0]), cols), OPEN)
                    state[0] = -1
                first = False
            key, low, high, mixed = (cols[0][-1], cols[1][-1]), lo[-1], hi[-1], bool(lo[-1] != hi[-1])
        elif at == 0:
            key, low, high, mixed = (cols[0][0], cols[1][0]), lo[0], hi[0], bool(lo[0] != hi[0])
        if not mixed:
            held = one(slice(begins[-1], None), cols)
        hits = np.repeat(state == SHARED, ends - begins)
        if hits.any():
            yield rows([c[hits] for c in cols], SHARED)
    if key is not None:
        yield edge()
        if len(held[0]):
            yield rows(held, OPEN)


def shared_suffixes(rows: DataFrame, name: str) -> DataFrame:
    """The rows of `rows` (a table) whose suffix another document has.

    They are sorted by range, (key, key2, doc, node, pos), so that also a key that a third of all documents have is dealt
    over partitions, and neighbours are compared. Runs that cross partitions are settled by a row or two for each partition.
    """
    order = ["key", "key2", "doc", "node", "pos"]
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    found = materialise(sorted_rows.mapInArrow(_compare, f"{_ROWS}, state int"), name)
    across = found.where(F.col("state") == EDGE).groupBy("key", "key2").agg(F.min("doc").alias("lo"), F.max("node").alias("hi")).where("lo < hi")
    across = maybe_broadcast(materialise(across.select("key", "key2"), f"{name}-edges"))
    late = found.where(F.col("state") == OPEN).join(across, ["key", "key2"])
    return found.where(F.col("state") == SHARED).unionByName(late.select(*found.columns)).select("doc", "node", "pos")


def repeated_passages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, start, stop, n_words): the spans of words, of 50 or more, made of 50-word windows that another document has
    too, overlapping or touching ones joined. start and stop count words, stop exclusive; words are runs without ASCII
    white space, as they stand.

    Null, empty and short texts have no span; a passage that only its own document repeats is none either. Exact copies
    have their whole texts as spans. Rows with a null id are left out; rows that repeat an id are one document, their
    spans given each once. Ids may be of any type that has an order. Other columns don't matter, whatever their names. An
    empty table gives an empty result. Texts are searched whole, and read where they lie: none is shuffled.
    """
    rows = located(docs)
    text = F.coalesce(field(text_col).cast("string"), F.lit(""))
    texts = rows.select("file", "row", text.alias("_text"))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    coded = materialise(rows.select("file", "row", field(id_col).alias("id"), F.md5(text.cast("binary")).alias("code"), words.alias("m"), F.monotonically_increasing_id().alias("nid")), "repeats-codes")
    known = coded.where((F.col("id").isNotNull()) & (F.col("m") >= MIN_WORDS))
    # A node is a different text. One that several documents have is covered whole, and counts as a document of its own:
    # whoever else has a passage of it, another document has it too.
    nodes = materialise(known.groupBy("code").agg(F.min("nid").alias("node"), F.min("id").alias("lo"), F.max("id").alias("hi")), "repeats-nodes")
    copied, single = nodes.where("lo < hi"), nodes.where("lo = hi")
    whole = known.join(copied.select("code"), "code").select("id", F.lit(0).alias("start"), F.col("m").cast("int").alias("stop")).distinct()
    docs_of = single.groupBy("lo").agg(F.min("node").alias("doc"))
    single = materialise(single.join(docs_of, "lo").select("node", "doc", F.col("lo").alias("id")), "repeats-single")
    own = single.select("node", "doc").unionByName(copied.select("node", F.col("node").alias("doc")))

    def side(marks: DataFrame, name: str) -> tuple[str, str]:
        return write_side(coded.select("file", "row", F.col("nid").alias("node")).join(marks, "node", "left").select("file", "row", "value"), name)

    found = materialise(suffixes(texts, side(own.select("node", F.array("doc", "node").alias("value")), "repeats-side")), "repeats-suffixes")
    starts = shared_suffixes(found, "repeats-neighbours").groupBy("doc", "node").agg(F.collect_set("pos").alias("p"))
    starts = starts.select("node", F.concat(F.array("doc", "node"), F.transform("p", lambda x: x.cast("long"))).alias("value"))
    wins = materialise(extensions(texts, side(starts, "repeats-starts")), "repeats-extensions")
    hits = shared_suffixes(wins, "repeats-windows")
    w = hits.groupBy("node").agg(F.array_sort(F.collect_set("pos")).alias("p"))
    gap = F.filter(F.sequence(F.lit(0), F.size("p") - 1), lambda i: (i == 0) | (F.get("p", i) - F.get("p", i - 1) > MIN_WORDS))
    spans = w.withColumn("first", gap).select("node", F.posexplode(F.transform("first", lambda i, j: F.struct(F.get("p", i).alias("start"), F.get("p", F.coalesce(F.get("first", j + 1), F.size("p")) - 1).alias("last")))).alias("k", "s"))
    spans = spans.join(single.select("node", "id"), "node").select("id", F.col("s.start").alias("start"), (F.col("s.last") + MIN_WORDS).alias("stop"))
    out = whole.unionByName(spans).distinct()
    return out.select(F.col("id").alias(id_col), F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"), (F.col("stop") - F.col("start")).cast("long").alias("n_words"))
