"""Language-model scoring by a hierarchical Pitman-Yor model of word pairs.

Every word (and a text's start) is a restaurant of the words that follow it; all these restaurants share one parent, the
restaurant of single words, whose base is uniform over the training vocabulary and one unknown word. Each table of a word in
a context's restaurant is a customer of the word in the parent. A sweep draws the tables of all words in all contexts, given
the parent's probabilities as its present seating has them, then the parent's own tables, given what the contexts sent it;
the next sweep sees the new parent. All dishes of a sweep are drawn side by side, each given the state before the sweep.
After BURN sweeps the predictive probabilities of SAMPLES states are averaged. See `seating` for the draw.

How it is dealt out. Texts are cut into blocks of words, coded by the block's own vocabulary. A dictionary, in parts by the
words' hashes, numbers all words. A block sends its different pairs with their counts to ranges, dealt by a hash of the pair,
so no context, however common, is in one place. A range keeps its pairs and their tables in files of the shared folder. A
sweep is two exchanges: ranges send the tables of each word they know, as a context and as a follower, to the word's
dictionary part; that adds them up, seats the word in the parent and answers with the sums. In the end the ranges answer the
blocks with a probability for each pair. A message holds what one block or range has for one other, so messages are no more
than pairs; a task holds one block, range or part. Nothing but sums reaches the driver. There is a range for so many words
of the corpus, and random numbers are hashes of the words' numbers, so partitions don't change a result.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .places import quoted
from .seating import draw_tables
from .store import drop_path, new_path, put_file, read_file, write_worked
from .words import U64, mix

BLOCK_TOKENS, RANGE_TOKENS = 2_000_000, 2_000_000
DISCOUNT, STRENGTH = (0.7, 0.8), (1.0, 1.0)
SAMPLES, BURN = 3, 2
END, START = 0, 1
#: The number of a text's start, as a context.
NO_WORD = 1 << 40
_END, _START = b" end ", b" start "


def _planes(x):
    """Arrays by planes of bytes: the high bytes of numbers, mostly alike, lie together and take little room."""
    if isinstance(x, np.ndarray) and x.ndim == 1 and x.itemsize > 1:
        return _PLANES, x.dtype.str, np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes()
    return type(x)(map(_planes, x)) if isinstance(x, (list, tuple)) and any(isinstance(y, (np.ndarray, tuple)) for y in x) else x


def _joined(x):
    if isinstance(x, tuple) and len(x) == 3 and isinstance(x[0], str) and x[0] == _PLANES:
        kind = np.dtype(x[1])
        return np.ascontiguousarray(np.frombuffer(x[2], np.uint8).reshape(kind.itemsize, -1).T).view(kind).ravel()
    return type(x)(map(_joined, x)) if isinstance(x, (list, tuple)) and any(isinstance(y, tuple) for y in x) else x


_PLANES = "planes"


def pack(*arrays) -> bytes:
    return zstandard.compress(pickle.dumps(_planes(arrays), protocol=5), 1)


def unpack(raw: bytes) -> tuple:
    return _joined(pickle.loads(zstandard.decompress(raw)))


def _small(x: np.ndarray) -> np.ndarray:
    """Counts in as few bytes as they need."""
    most = int(x.max()) if len(x) else 0
    return x.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.uint64)


def held_out(id_col: Column) -> Column:
    """Whether a row takes no part in the training: crc32 of the id as text, mod 7, is 2; a null id counts as empty."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(7)) == 2


def make_blocks(rows: DataFrame, path: str) -> DataFrame:
    """(block, n_tokens), a written table, of rows (id string, held boolean, text); a block's contents are the file block-N under `path`:
    ids, held, tokens a text, tokens as indices of the vocabulary (0 end, 1 start), the vocabulary's hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0

        def start():
            return {_END: END, _START: START}, [], [], [], []

        def flush(vocab, ids, held, n, toks):
            nonlocal number
            block = (TaskContext.get().partitionId() << 24) | number
            number += 1
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, vocab), U64, len(vocab))
            tokens = np.concatenate(toks)
            put_file(path, f"block-{block}", [pack(ids, np.array(held, bool), np.array(n, np.int64), tokens, hashes)])
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([len(tokens)], pa.int64())], names=["block", "n_tokens"])

        state, size = start(), 0
        for batch in batches:
            for i, h, text in zip(batch.column("id").to_pylist(), batch.column("held").to_pylist(), batch.column("text"), strict=True):
                vocab, ids, held, n, toks = state
                words = (text.as_py() or "").encode().lower().split()
                words.append(_END)
                put = vocab.setdefault
                toks.append(np.fromiter((put(w, len(vocab)) for w in words), np.uint32, len(words)))
                ids.append(i)
                held.append(h)
                n.append(len(words))
                size += len(words)
                if size >= BLOCK_TOKENS:
                    yield flush(*state)
                    state, size = start(), 0
        if state[1]:
            yield flush(*state)

    return write_worked(rows, run, "block long, n_tokens long", "lm-blocks")[0]


def part_of(h: np.ndarray, n: int) -> np.ndarray:
    """Which of n ranges or dictionary parts a hash falls in."""
    return (mix(h + U64(0x632BE59BD9B4E019)) % U64(n)).astype(np.int64)


def pair_hash(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Of words' numbers."""
    return mix(mix(u.astype(U64)) + w.astype(U64))


def _steps(x: np.ndarray) -> np.ndarray:
    """Rising numbers by what each adds to the one before."""
    return _small(np.diff(x, prepend=0))


def _cuts(part: np.ndarray) -> Iterator[tuple[int, slice]]:
    """(part, its slice) of a sorted array of parts, those that there are."""
    first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(part) else np.zeros(0, np.int64)
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(part)], strict=True):
        yield int(part[a]), slice(a, b)


class Block:
    """A block's texts, and once it knows its words' numbers its different pairs, in the order in which they are sent and
    answered: by range, then number of the context and of the word."""

    def __init__(self, path: str, block: int, n_ranges: int):
        self.n_ranges = n_ranges
        self.ids, self.held, self.n, self.tokens, self.vocab = unpack(read_file(path, f"block-{block}"))
        self.train = np.repeat(~self.held, self.n)
        words = np.flatnonzero(np.arange(len(self.vocab)) != START)
        of = part_of(self.vocab[words], n_ranges)
        by = np.argsort(of, kind="stable")
        self.words, self.word_part = words[by], of[by]

    def pair_up(self, numbers: np.ndarray) -> None:
        """numbers: of `words`. A text's start has a number of its own, beyond the others."""
        number = np.full(len(self.vocab), NO_WORD, np.int64)
        number[self.words] = numbers
        rank = np.argsort(number, kind="stable")
        place = np.empty(len(rank), np.int64)
        place[rank] = np.arange(len(rank))
        token = place[self.tokens]
        context = np.empty(len(token), np.int64)
        context[1:] = token[:-1]
        context[np.cumsum(self.n) - self.n] = place[START]
        pairs, self.pair = np.unique(context * len(rank) + token, return_inverse=True)
        del context, token
        self.count = np.bincount(self.pair, self.train, len(pairs)).astype(np.int64)
        u, w = np.divmod(pairs, len(rank))
        self.u, self.w = number[rank][u], number[rank][w]
        of = part_of(pair_hash(self.u, self.w), self.n_ranges)
        self.order = np.argsort(of, kind="stable")
        self.range = of[self.order]


SENT = "kind int, to long, src long, payload binary"
PAIRS, WORDS, TABLES, SUMS, PAIR_REPLY, NUMBERS, TOTALS = range(7)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["kind", "to", "src", "payload"])


def _in_batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[3])
        if size > 8 << 20 or len(held) >= 5000:
            yield _batch(held)
            held, size = [], 0
    if held:
        yield _batch(held)


def _by_target(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """(to, its messages (kind, src, payload) in order) of sorted messages."""
    to, held = None, []
    for batch in batches:
        for k, t, s, x in zip(*(batch.column(c).to_pylist() for c in ("kind", "to", "src")), batch.column("payload"), strict=True):
            if t != to:
                if held:
                    yield to, held
                to, held = t, []
            held.append((k, s, x.as_py()))
    if held:
        yield to, held


def deliver(sent: DataFrame, n: int, numbered: bool = True) -> DataFrame:
    """Messages sorted by target, whole targets to a task; numbered: targets are 0 to n - 1, and so dealt evenly."""
    sent = sent.where("to >= 0")
    dealt = sent.repartitionById(n, F.col("to").cast("int")) if numbered and n < 1 << 20 else sent.repartition(min(max(n, 1), 1 << 20), "to")
    return dealt.sortWithinPartitions("to", "kind", "src")


Work = Callable[[int, list[tuple]], Iterator[tuple]]


def _worked(work: Work) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _in_batches(row for to, held in _by_target(batches) for row in work(to, held))

    return run


def exchange(sent: DataFrame, n: int, work: Work, numbered: bool = True) -> DataFrame:
    """What `work` (target, its messages) sends on, for each of n targets."""
    return deliver(sent, n, numbered).mapInArrow(_worked(work), SENT)


def exchange_to(name: str, sent: DataFrame, n: int, work: Work) -> tuple[DataFrame, str]:
    """`exchange` to numbered targets, its messages written as a table; its path too."""
    return write_worked(deliver(sent, n), _worked(work), SENT, name)


def parent_probability(customers, tables, all_customers: int, all_tables: int, n_vocab: int, discount: float, strength: float):
    """The parent's predictive probability of words with these customers and tables; of the unknown word with none."""
    rest = customers - discount * tables
    return (rest + (strength + discount * all_tables) / (n_vocab + 1)) / (strength + all_customers)


def predict(c, t, all_c, all_t, parent, discount: float, strength: float):
    """A context's predictive probability of words with c customers at t tables, of all_c at all_t."""
    return (c - discount * t + (strength + discount * all_t) * parent) / (strength + all_c)


class Sampler:
    """The tasks of a model: each reads its state from the shared folder and gives messages."""

    def __init__(self, path: str, n: int, discount: tuple[float, float], strength: tuple[float, float], seed: int, burn: int, samples: int):
        self.path, self.n, self.seed, self.burn, self.samples = path, n, seed, burn, samples
        (self.d0, self.d1), (self.s0, self.s1) = discount, strength

    def _of(self, sweep: int) -> str:
        """The folder of the state after so many sweeps."""
        return f"{self.path}/sweep-{sweep}"

    def _salted(self, h: np.ndarray) -> np.ndarray:
        return mix(h ^ U64((self.seed * 0x9E3779B97F4A7C15) & (2**64 - 1)))

    def words_of(self, block: int) -> Iterator[tuple]:
        """A block's words and how often they are in training, to the dictionary."""
        b = Block(self.path, block, self.n)
        times = np.bincount(b.tokens, b.train, len(b.vocab)).astype(np.int64)
        for q, cut in _cuts(b.word_part):
            yield WORDS, q, block, pack(b.vocab[b.words[cut]], _small(times[b.words[cut]]))

    def number(self, q: int, messages: list[tuple]) -> Iterator[tuple]:
        """A dictionary part numbers its words: place in the order of their hashes, times the parts, plus the part."""
        parts = [unpack(x) for _, _, x in messages]
        words, index = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        times = np.bincount(index, np.concatenate([p[1] for p in parts]), len(words)).astype(np.int64)
        at = 0
        for (_, block, _), p in zip(messages, parts, strict=True):
            k = index[at : at + len(p[0])]
            at += len(k)
            yield NUMBERS, block, q, pack(_small(k), _small(times[k]))
        yield TOTALS, -1, q, pack(np.array([int((times > 0).sum()), int(times.sum())]))

    def pairs_of(self, block: int, messages: list[tuple]) -> Iterator[tuple]:
        """A block, told its words' numbers, keeps them and sends its pairs to their ranges."""
        b = Block(self.path, block, self.n)
        parts = [(q, *unpack(x)) for _, q, x in messages]
        numbers = np.concatenate([k.astype(np.int64) * self.n + q for q, k, _ in parts])
        put_file(self.path, f"numbers-{block}", [pack(numbers, _small(np.concatenate([t for _, _, t in parts])))])
        b.pair_up(numbers)
        for r, cut in _cuts(b.range):
            at = b.order[cut]
            yield PAIRS, r, block, pack(_steps(b.u[at]), _small(b.w[at]), _small(b.count[at]))

    def gather(self, r: int, messages: list[tuple]) -> Iterator[tuple]:
        """A range's pairs from all blocks, in order of their words' numbers."""
        parts = [unpack(x) for _, _, x in messages]
        u = np.concatenate([np.cumsum(p[0].astype(np.int64)) for p in parts])
        w = np.concatenate([p[1].astype(np.int64) for p in parts])
        words, place = np.unique(np.concatenate((u, w)), return_inverse=True)
        pairs, kind = np.unique(place[: len(u)] * len(words) + place[len(u) :], return_inverse=True)
        del u, w, place
        c = np.bincount(kind, np.concatenate([p[2] for p in parts]), len(pairs)).astype(np.int64)
        u, w = np.divmod(pairs, len(words))
        at, asked = 0, []
        for (_, block, _), p in zip(messages, parts, strict=True):
            asked.append((block, _steps(kind[at : at + len(p[0])])))
            at += len(p[0])
        put_file(self.path, f"range-{r}", [pack(words, _steps(u), _small(w), _small(c))])
        put_file(self.path, f"asked-{r}", [pack(asked)])
        start = (c > 0).astype(np.int64)
        put_file(self._of(0), f"tables-{r}", [pack(_small(start))])
        yield from self._tell(r, words, u, w, start, c)

    def _by_part(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of the words by dictionary part, and the parts; the start of texts has part 0."""
        of = np.where(words == NO_WORD, 0, words % self.n)
        by = np.argsort(of, kind="stable")
        return by, of[by]

    def _tell(self, r: int, words, u, w, t, c=None) -> Iterator[tuple]:
        """A range's tables by word, those in its restaurant and those that it sends the parent; at first its customers and
        the words too."""
        n = len(words)
        own, sent = np.bincount(u, t, n).astype(np.int64), np.bincount(w, t, n).astype(np.int64)
        all_c = None if c is None else np.bincount(u, c, n).astype(np.int64)
        by, of = self._by_part(words)
        for q, cut in _cuts(of):
            at = by[cut]
            first = () if c is None else (_steps(words[at]), _small(all_c[at]))
            yield TABLES, q, r, pack(_small(own[at]), _small(sent[at]), *first)

    def add_up(self, q: int, messages: list[tuple], sweep: int, before: tuple[int, int]) -> Iterator[tuple]:
        """A dictionary part: sums by word, the words seated in the parent, and answers."""
        parts = [unpack(x) for _, _, x in messages]
        if sweep == 0:
            words, index = np.unique(np.concatenate([np.cumsum(p[2].astype(np.int64)) for p in parts]), return_inverse=True)
            ends = np.cumsum([len(p[0]) for p in parts]).tolist()
            index = [index[b - len(p[0]) : b] for p, b in zip(parts, ends, strict=True)]
            all_c = np.zeros(len(words), np.int64)
            for p, i in zip(parts, index, strict=True):
                all_c[i] += p[3]
            put_file(self.path, f"dictionary-{q}", [pack(words, [(m[1], _steps(i)) for m, i in zip(messages, index, strict=True)])])
        else:
            words, places = unpack(read_file(self.path, f"dictionary-{q}"))
            if [s for s, _ in places] != [m[1] for m in messages]:
                raise RuntimeError("a range's message is missing")
            index = [np.cumsum(i.astype(np.int64)) for _, i in places]
        own, sent = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        for p, i in zip(parts, index, strict=True):
            own[i] += p[0]
            sent[i] += p[1]
        tables = (sent > 0).astype(np.int64)
        if sweep:
            # The words' tables in the parent, given the other words'. The base is uniform.
            n_vocab, total = before
            live = np.flatnonzero(sent)
            last = np.clip(unpack(read_file(self._of(sweep - 1), f"words-{q}"))[0][live], 1, sent[live]).astype(np.int64)
            theta = self.s0 + self.d0 * np.maximum(total - last, 0)
            tables[live] = draw_tables(sent[live], last, theta, np.full(len(live), 1 / (n_vocab + 1)), self.d0, self._salted(mix(words[live].astype(U64) + U64(1))), sweep - 1)
        put_file(self._of(sweep), f"words-{q}", [pack(_small(tables))])
        for m, i in zip(messages, index, strict=True):
            yield SUMS, m[1], q, pack(_small(own[i]), _small(sent[i]), _small(tables[i]), *((_small(all_c[i]),) if sweep == 0 else ()))
        yield TOTALS, -1, q, pack(np.array([sent.sum(), tables.sum()]))

    def draw(self, r: int, messages: list[tuple], sweep: int, totals: tuple[int, int], n_vocab: int) -> Iterator[tuple]:
        """A range's part of a sweep. The state before it, `sweep` sweeps old, is whole now, and kept if it is one of the last
        that count; then tables are drawn anew. After the last sweep the blocks get their answers instead."""
        words, u, w, c = unpack(read_file(self.path, f"range-{r}"))
        u, w, c = np.cumsum(u.astype(np.int64)), w.astype(np.int64), c.astype(np.int64)
        parts = [unpack(x) for _, _, x in messages]
        by, _ = self._by_part(words)
        sums = [np.concatenate([p[i] for p in parts]).astype(np.int64) for i in range(4 if sweep == 0 else 3)]
        if any(len(x) != len(words) for x in sums):
            raise RuntimeError("a dictionary part's message is missing")
        for x in sums:
            x[by] = x.copy()
        if sweep == 0:
            put_file(self.path, f"contexts-{r}", [pack(_small(sums[3]))])
        if sweep > self.burn:
            put_file(self._of(sweep), f"state-{r}", [pack(totals, *map(_small, sums[:3]))])
        if sweep == self.burn + self.samples:
            log = self._answer(r, u, w, c, n_vocab)
            for block, kind in unpack(read_file(self.path, f"asked-{r}"))[0]:
                yield PAIR_REPLY, block, r, pack(log[np.cumsum(kind.astype(np.int64))])
            return
        own, sent, tables = sums[:3]
        parent = parent_probability(sent, tables, *totals, n_vocab, self.d0, self.s0)
        t = unpack(read_file(self._of(sweep), f"tables-{r}"))[0].astype(np.int64)
        some = np.flatnonzero(c > 1)
        theta = self.s1 + self.d1 * (own[u[some]] - t[some])
        t[some] = draw_tables(c[some], t[some], theta, parent[w[some]], self.d1, self._salted(pair_hash(words[u[some]], words[w[some]])), sweep)
        put_file(self._of(sweep + 1), f"tables-{r}", [pack(_small(t))])
        yield from self._tell(r, words, u, w, t)

    def _answer(self, r: int, u, w, c, n_vocab: int) -> np.ndarray:
        """log10 of the range's pairs' probabilities, averaged over the states that count."""
        all_c = unpack(read_file(self.path, f"contexts-{r}"))[0].astype(np.int64)
        total = np.zeros(len(c))
        for sweep in range(self.burn + 1, self.burn + self.samples + 1):
            totals, *sums = unpack(read_file(self._of(sweep), f"state-{r}"))
            own, sent, tables = (x.astype(np.int64) for x in sums)
            t = unpack(read_file(self._of(sweep), f"tables-{r}"))[0].astype(np.int64)
            parent = parent_probability(sent, tables, *totals, n_vocab, self.d0, self.s0)
            total += predict(c, t, all_c[u], own[u], parent[w], self.d1, self.s1)
        return np.log10(total / self.samples).astype(np.float32)

    def score(self, block: int, messages: list[tuple], n_vocab: int, trained: int) -> pa.RecordBatch:
        b = Block(self.path, block, self.n)
        numbers, seen = unpack(read_file(self.path, f"numbers-{block}"))
        b.pair_up(numbers)
        log, times = np.empty(len(b.order)), np.zeros(len(b.vocab))
        log[b.order] = np.concatenate([unpack(x)[0] for _, _, x in messages])
        times[b.words] = seen
        first = np.cumsum(b.n) - b.n
        base = np.log10((times + 1) / (trained + n_vocab + 1))
        add = lambda x: np.add.reduceat(x, first)
        cols = [pa.array(b.ids, pa.string()), pa.array(b.held), pa.array(b.n), pa.array(add((times > 0)[b.tokens].astype(np.int64))), pa.array(np.full(len(b.n), trained, np.int64)), pa.array(add(base[b.tokens])), pa.array(add(log[b.pair]))]
        return pa.RecordBatch.from_arrays(cols, names=NAMES)


NAMES = ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


def score_corpus(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", discount: tuple[float, float] = DISCOUNT, strength: tuple[float, float] = STRENGTH, seed: int = 11, burn: int = BURN, samples: int = SAMPLES) -> DataFrame:
    """(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity), one row a row of `docs`.

    Letters A-Z are lower-cased; words are runs without ASCII white space, and each text has one end token. Null text is
    empty: its end alone is scored. base_score: add-one unigrams in log10. score: log10 of the averaged predictive
    probabilities, summed. perplexity: 10 ** (-score / n_tokens). Repeated rows each count in training. Ids may be of any
    type that has a text form; a null id counts as an empty one for the hold-out. Other columns don't matter, whatever
    their names. With no training row the vocabulary is empty and every token is the unknown word. An empty table gives an
    empty result. Reruns agree, however the input is partitioned.
    """
    spark = docs.sparkSession
    path = new_path(spark, "lm")
    rows = docs.select(quoted(id_col).cast("string").alias("id"), held_out(quoted(id_col)).alias("held"), quoted(text_col).alias("text"))
    kind = dict(docs.select(quoted(id_col).alias("id")).dtypes)["id"]
    blocks = make_blocks(rows, path)
    total, n_blocks = blocks.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.count("*")).first()
    n = max(1, -(-total // RANGE_TOKENS))
    task = Sampler(path, n, discount, strength, seed, burn, samples)

    def send_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _in_batches(row for batch in batches for block in batch.column("block").to_pylist() for row in task.words_of(block))

    def sums(sent: DataFrame) -> tuple[int, int]:
        """One row of two sums for each part or range."""
        got = np.zeros(2, np.int64)
        for row in sent.where(F.col("kind") == TOTALS).select("payload").toLocalIterator():
            got += unpack(bytes(row.payload))[0]
        return int(got[0]), int(got[1])

    words = blocks.repartition(max(1, n_blocks), "block").mapInArrow(send_words, SENT)
    told, told_path = exchange_to("lm-numbers", words, n, task.number)
    n_vocab, trained = sums(told)
    # The pairs aren't written beside the shuffle that brings them to their ranges.
    up, up_path = exchange_to("lm-up", exchange(told, n_blocks, task.pairs_of, numbered=False), n, task.gather)
    drop_path(spark, told_path)
    totals = (0, 0)
    for sweep in range(burn + samples + 1):
        before = n_vocab, totals[1]
        down, down_path = exchange_to("lm-down", up, n, lambda q, m, k=sweep, b=before: task.add_up(q, m, k, b))
        totals = sums(down)
        drop_path(spark, up_path)
        draw = lambda r, m, k=sweep, a=totals: task.draw(r, m, k, a, n_vocab)
        if sweep == burn + samples:
            up = exchange(down, n, draw)
        else:
            up, up_path = exchange_to("lm-up", down, n, draw)
            drop_path(spark, down_path)
            if 0 < sweep <= burn:
                drop_path(spark, task._of(sweep - 1))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, held in _by_target(batches):
            yield task.score(block, held, n_vocab, trained)

    # A narrow table: whoever writes the result does so from few files, beside no model.
    scored, _ = write_worked(deliver(up, n_blocks, numbered=False), score, "id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double", "lm-scores")
    drop_path(spark, down_path)
    drop_path(spark, path)
    return scored.select(F.col("id").cast(kind).alias(id_col), *NAMES[1:], F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
