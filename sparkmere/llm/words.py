"""Whole texts as arrays of word hashes, for operators that work in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

U64 = np.uint64
#: A batch is worked on in groups of documents of about so many bytes of text (one document at least).
GROUP_BYTES = 4 << 20
_MULT = U64(0x9E3779B97F4A7C15)
_INVERSE = pow(0x9E3779B97F4A7C15, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def word_hashes(raws: list[bytes], memo: dict[bytes, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hashes of all words (runs without the six ASCII white-space characters), and each text's number of words."""
    memo = {} if memo is None else memo
    flat, n = [], np.zeros(len(raws), np.int64)
    for i, raw in enumerate(raws):
        words = raw.split()
        n[i] = len(words)
        flat += words
    for w in set(flat).difference(memo):
        memo[w] = xxhash.xxh64_intdigest(w)
    return np.fromiter(map(memo.__getitem__, flat), U64, len(flat)), n


def groups(batch: pa.RecordBatch, column: str, most: int = GROUP_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts as UTF-8) of the groups of rows of a batch; null is empty."""
    first, held, size = 0, [], 0
    for i, x in enumerate(batch.column(column)):
        raw = (x.as_py() or "").encode()
        if held and size + len(raw) > most:
            yield first, held
            first, held, size = i, [], 0
        held.append(raw)
        size += len(raw)
    if held:
        yield first, held


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of `width` words in `h`, in order; none if there are fewer."""
    if len(h) < width:
        return np.zeros(0, U64)
    powers = _powers(len(h))
    with np.errstate(over="ignore"):
        total = np.concatenate(([U64(0)], np.cumsum(h * powers, dtype=U64)))
        back = _inverse_powers(len(h))
        return mix((total[width:] - total[:-width]) * back[: len(h) - width + 1])


_cache: dict[str, np.ndarray] = {}


def _grown(name: str, base: int, n: int) -> np.ndarray:
    if name not in _cache or len(_cache[name]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        with np.errstate(over="ignore"):
            _cache[name] = np.multiply.accumulate(np.full(size, U64(base)))
    return _cache[name][:n]


def _powers(n: int) -> np.ndarray:
    return _grown("up", int(_MULT), n)


def _inverse_powers(n: int) -> np.ndarray:
    return _grown("down", _INVERSE, n)


def shingles(h: np.ndarray, n: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of `width` words within each text as (text index, hash); a text of fewer words, but one, has one run of all."""
    doc = np.repeat(np.arange(len(n)), n)
    ends = np.cumsum(n)
    runs = np.maximum(n - width + 1, 0)
    if len(h) >= width:
        w = window_hashes(h, width)
        at = np.arange(len(w))
        ok = doc[: len(w)] == doc[width - 1 :]
        found, of = w[ok], doc[at[ok]]
    else:
        found, of = np.zeros(0, U64), np.zeros(0, np.int64)
    short = np.flatnonzero((n > 0) & (runs == 0))
    if len(short):
        extra = [window_hashes(h[ends[i] - n[i] : ends[i]], int(n[i]))[0] for i in short]
        found, of = np.concatenate((found, np.array(extra, U64))), np.concatenate((of, short))
    return of, found
