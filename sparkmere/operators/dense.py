"""Dense retrieval over given embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lexical import top

#: A task passes over its passages once for so many query vectors; it holds them and their best so far.
QUERY_BLOCK = 16_384
#: Queries and passages that are scored at once.
QUERY_TILE, PASSAGE_TILE = 2048, 1024


def _unit(rows: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norm, out=np.zeros_like(rows), where=norm > 0)


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length, from their flat values."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    return np.concatenate([c.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(c), -1) for c in chunks if len(c)])


class _Best:
    """The passages that may be among the `k` best of each of n queries, of those seen so far. Scores fall to the k-th best;
    what ties with it is kept, ranks are given in the end, unless ties are many: then the least ids are kept."""

    def __init__(self, n: int, k: int):
        self.n, self.k, self.least = n, k, np.full(n, -np.inf)
        self.parts: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []
        self.size, self.most = 0, 2 * n * k

    def add(self, score: np.ndarray, ids: pa.Array) -> None:
        """Scores, not yet rounded, of the queries by the passages of these ids."""
        at = ~(score < self.least[:, None] - 1e-9)
        if score.shape[1] > self.k and np.isneginf(self.least).any():
            # No k passages seen: the tile's own best will do. NaN counts as the greatest, as in sorts.
            cut = np.partition(score, score.shape[1] - self.k, axis=1)[:, score.shape[1] - self.k]
            at &= ~(score < cut[:, None] - 1e-9)
        q_at, p_at = np.divmod(np.flatnonzero(at), score.shape[1])
        if len(q_at):
            self.parts.append((q_at.astype(np.int32), np.round(score[q_at, p_at], 9), ids.take(pa.array(p_at))))
            self.size += len(q_at)
            if self.size > self.most:
                self.settle()

    def settle(self) -> None:
        """Drops what is below the k-th best of its query."""
        if not self.parts:
            return
        q_at, score = (np.concatenate([p[i] for p in self.parts]) for i in (0, 1))
        ids = pa.concat_arrays([p[2] for p in self.parts])
        order = np.argsort(q_at.astype(np.uint16), kind="stable")  # a tile has fewer queries than 65,536
        times = np.bincount(q_at, minlength=self.n)
        if times.max() > 8 * self.k:
            # Many ties, maybe: settled in the order of the ranks.
            key = np.where(np.isnan(score), np.inf, score)
            rows = pa.table({"q": q_at, "score": key, "id": ids})
            order = pc.sort_indices(rows, sort_keys=[("q", "ascending"), ("score", "descending"), ("id", "ascending")], null_placement="at_start").to_numpy()
            place = np.arange(len(order)) - np.repeat(np.cumsum(times) - times, times)
            keep = np.sort(order[place < self.k])
            last = order[place == self.k - 1]
            self.least[q_at[last]] = key[last]
        else:
            place = np.arange(len(order)) - np.repeat(np.cumsum(times) - times, times)
            grid = np.full((self.n, max(int(times.max()), self.k)), -np.inf)
            grid[q_at[order], place] = np.where(np.isnan(score), np.inf, score)[order]
            self.least = np.partition(grid, grid.shape[1] - self.k, axis=1)[:, grid.shape[1] - self.k]
            keep = np.flatnonzero(~(score < self.least[q_at]))
        self.parts = [(q_at[keep], score[keep], ids.take(pa.array(keep)))]
        self.size = len(keep)
        self.most = 2 * max(self.size, self.n * self.k)


def dense_topk(queries: DataFrame, passages: DataFrame, top_k: int = 100) -> DataFrame:
    """(qid, doc_id, score, rank) by cosine (rounded to 9 places), then id, from (qid, vec) and (doc_id, vec).

    Exact. Passages stream past each block of queries, scored a tile of both at a time; a task sends on only what reaches its
    `top_k` for each query, so neither its memory nor what is shuffled grows with its passages. Vectors that are null are
    left out, zero vectors score 0.
    """
    q = queries.where("vec IS NOT NULL").select("qid", "vec").toArrow()
    out = None
    for a in range(0, q.num_rows, QUERY_BLOCK):
        part = q.slice(a, QUERY_BLOCK)
        ids, matrix = part.column("qid").combine_chunks(), _unit(_matrix(part.column("vec")))
        sent = queries.sparkSession.sparkContext.broadcast((ids, matrix))

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, matrix = sent.value
            best = [_Best(len(matrix[b : b + QUERY_TILE]), top_k) for b in range(0, len(matrix), QUERY_TILE)]
            for batch in batches:
                for c in range(0, len(batch), PASSAGE_TILE):
                    tile = batch.slice(c, PASSAGE_TILE)
                    vec = _unit(_matrix(tile.column("vec"))).T
                    for b, own in enumerate(best):
                        own.add(matrix[b * QUERY_TILE : (b + 1) * QUERY_TILE] @ vec, tile.column("doc_id"))
            for b, own in enumerate(best):
                own.settle()
                for q_at, score, doc_ids in own.parts:
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(q_at + b * QUERY_TILE)), doc_ids, pa.array(score)], names=["qid", "doc_id", "score"])
                own.parts = []

        kinds = dict(queries.dtypes)["qid"], dict(passages.dtypes)["doc_id"]
        got = passages.where("vec IS NOT NULL").select("doc_id", "vec").mapInArrow(search, f"qid {kinds[0]}, doc_id {kinds[1]}, score double")
        out = got if out is None else out.unionByName(got)
    if out is None:
        out = queries.select("qid").join(passages.select("doc_id"), F.lit(False)).withColumn("score", F.lit(0.0))
    return top(out, top_k)
