r"""Secret scans: base patterns, and formats learnt from labelled credentials by grammar inference.

Fixed values: the patterns of the base kinds.
assign  (password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+), letters of the name in either case, group 2 of 12 characters or more
access  AKIA[A-Z0-9]+, 18 characters or more
hex     [0-9a-f]+, 16 characters or more

What the base patterns find are the labelled credentials. They are parted by kind and shape (which of lower case, upper
case, digits and each sign occur), and each shape with enough of them gives an automaton: the prefix tree of its values,
states merged where their frequencies are compatible. Letters and digits take the same step, so a tree has the places of
signs and the lengths, and each state how often each class of characters comes there. Every run of 12 characters or more is
scored by all automata against a model of ordinary long words; the words are dealt into two halves by their hashes, and each
word is judged by the model of the half that it isn't in.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .places import quoted
from .store import materialise

KINDS = ("assign", "access", "hex", "format")
_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
_NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_ACCESS, _HEX = re.compile(rb"AKIA[A-Z0-9]+"), re.compile(rb"[0-9a-f]+")
_VALUE = np.zeros(256, bool)
_VALUE[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"]] = True
MIN_CANDIDATE = 12
#: Labelled credentials of a shape from which an automaton is learnt, and ordinary long words of each half: at most so many,
#: of at most so many characters. The sample is the values with the least hashes of the whole corpus.
SAMPLE, WORDS, SAMPLE_CHARS = 400, 4000, 256
#: Shapes with fewer labelled values have no automaton.
LEAST_LABELS = 8
ALPHA, MARGIN = 0.05, 0.35

_CLASSES = ("abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "0123456789", "+", "/", "_", ".", "=", "-")
_CLASS = {ord(c): k for k, cs in enumerate(_CLASSES) for c in cs}
_SIZE = [len(c) for c in _CLASSES]
#: The step that a class takes in an automaton: letters and digits the same, each sign its own.
_STEP = [max(k - 4, 0) for k in range(len(_CLASSES))]
_ALNUM = "".join(_CLASSES[:5]).encode()
_SHAPE = {c: "l" if chr(c).islower() else "u" if chr(c).isupper() else "d" if chr(c).isdigit() else chr(c) for c in _CLASS}


def candidates(raw: bytes) -> list[tuple[int, int]]:
    """Byte spans of the runs of 12 value characters or more."""
    on = np.concatenate(([False], _VALUE[np.frombuffer(raw, np.uint8)], [False]))
    edge = np.flatnonzero(on[1:] != on[:-1])
    a, b = edge[::2], edge[1::2]
    long = b - a >= MIN_CANDIDATE
    return list(zip(a[long].tolist(), b[long].tolist(), strict=True))


def base_spans(raw: bytes, runs: list[tuple[int, int]] | None = None) -> list[tuple[int, int, int, bytes]]:
    """(start, end, kind, value) in bytes, by start and kind. Access keys and hex runs are parts of candidate runs."""
    found = []
    low = raw.lower()
    if any(x in low for x in _NAMES):
        found += [(m.start(), m.end(), 0, m[2]) for m in _ASSIGN.finditer(raw) if len(m[2]) >= 12]
    for a, b in candidates(raw) if runs is None else runs:
        part = raw[a:b]
        found += [(a + m.start(), a + m.end(), 1, m[0]) for m in _ACCESS.finditer(part) if len(m[0]) >= 18]
        found += [(a + m.start(), a + m.end(), 2, m[0]) for m in _HEX.finditer(part) if len(m[0]) >= 16]
    return sorted(found)


def shape(value: bytes) -> str:
    return "".join(sorted({_SHAPE[c] for c in value}))


class Automaton:
    """A probabilistic automaton from state merging by the Hoeffding test (ALERGIA)."""

    def __init__(self, words: Iterable[bytes], alpha: float = ALPHA):
        words = list(words)
        self.signs = frozenset(b"".join(words).translate(None, _ALNUM))
        self.to: list[dict[int, int]] = [{}]
        self.pass_: list[int] = [0]
        self.stop: list[int] = [0]
        self.count: list[dict[int, int]] = [{}]
        for w in sorted(words):
            s = 0
            self.pass_[0] += 1
            for c in w:
                k = _CLASS[c]
                self.count[s][k] = self.count[s].get(k, 0) + 1
                if _STEP[k] not in self.to[s]:
                    self.to[s][_STEP[k]] = len(self.to)
                    for x, new in ((self.to, {}), (self.pass_, 0), (self.stop, 0), (self.count, {})):
                        x.append(new)
                s = self.to[s][_STEP[k]]
                self.pass_[s] += 1
            self.stop[s] += 1
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge()

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return bool(n1 and n2) and abs(f1 / n1 - f2 / n2) > self.bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def _compatible(self, a: int, b: int) -> bool:
        todo, met = [(a, b)], set()
        while todo:
            a, b = todo.pop()
            if (a, b) in met:
                continue
            met.add((a, b))
            if self._differ(self.stop[a], self.pass_[a], self.stop[b], self.pass_[b]):
                return False
            for k in self.count[a].keys() | self.count[b].keys():
                if self._differ(self.count[a].get(k, 0), self.pass_[a], self.count[b].get(k, 0), self.pass_[b]):
                    return False
            todo += [(t, self.to[b][k]) for k, t in self.to[a].items() if k in self.to[b]]
        return True

    def _fold(self, a: int, b: int) -> None:
        """Adds the tree under b to a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.pass_[a] += self.pass_[b]
            self.stop[a] += self.stop[b]
            for k, n in self.count[b].items():
                self.count[a][k] = self.count[a].get(k, 0) + n
            for k, t in self.to[b].items():
                if k in self.to[a]:
                    todo.append((self.to[a][k], t))
                else:
                    self.to[a][k] = t

    def _merge(self) -> None:
        red = [0]
        while blue := sorted((-self.pass_[t], r, k) for r in red for k, t in self.to[r].items() if t not in red):
            _, r, k = blue[0]
            t = self.to[r][k]
            fit = next((x for x in red if self._compatible(x, t)), None)
            if fit is None:
                red.append(t)
            else:
                self.to[r][k] = fit
                self._fold(fit, t)
        place = {s: i for i, s in enumerate(red)}
        n = len(_CLASSES) + 1
        self.next = [[place.get(self.to[s].get(_STEP[k]), -1) for k in range(n - 1)] for s in red]
        self.log = []
        for s in red:
            total = self.pass_[s] + 0.05 * n
            self.log.append([math.log((self.count[s].get(k, 0) + 0.05) / total / _SIZE[k]) for k in range(n - 1)] + [math.log((self.stop[s] + 0.05) / total)])
        for x in ("to", "pass_", "stop", "count"):
            delattr(self, x)

    def score(self, word: bytes) -> float:
        """The natural log of the word's probability; a step that no credential took goes to the first state."""
        s, total = 0, 0.0
        for c in word:
            k = _CLASS[c]
            total += self.log[s][k]
            s = max(self.next[s][k], 0)
        return total + self.log[s][-1]


class Ordinary:
    """A model of ordinary long words: characters after characters, the unseen by how often a character comes at all."""

    def __init__(self, words: Iterable[bytes]):
        pairs: dict[int, Counter] = defaultdict(Counter)
        letters: Counter = Counter()
        for w in words:
            for a, b in zip(b"\0" + w, w + b"\0", strict=True):
                pairs[a][b] += 1
                letters[b] += 1
        total = sum(letters.values())
        chars = [0, *_CLASS]
        back = {b: (letters[b] + 0.5) / (total + 0.5 * len(chars)) for b in chars}
        self.log = {(a, b): math.log((pairs[a][b] + 5 * back[b]) / (sum(pairs[a].values()) + 5)) for a in chars for b in chars}

    def score(self, word: bytes) -> float:
        return sum(map(self.log.__getitem__, zip(b"\0" + word, word + b"\0", strict=True)))


def half_of(word: bytes) -> int:
    """Which half of the ordinary words a word is in."""
    return hashlib.md5(b"half:" + word).digest()[0] & 1


class Formats:
    """Automata of the labelled shapes against models of the two halves of the ordinary long words.

    labelled: values by kind and shape ("hex/dl"); words: those of each half.
    """

    def __init__(self, labelled: dict[str, list[bytes]], words: tuple[list[bytes], list[bytes]]):
        self.automata = {k: Automaton(v) for k, v in sorted(labelled.items()) if len(v) >= LEAST_LABELS}
        self.ordinary = [Ordinary(w) for w in words]

    def margin(self, word: bytes) -> tuple[float, str | None]:
        """The best automaton's log-likelihood over the ordinary model's, a character, and the label it was learnt from.
        An automaton whose values lack a sign of the word (a dot, say) isn't its format."""
        fit = [(a.score(word), k) for k, a in self.automata.items() if a.signs.issuperset(word.translate(None, _ALNUM))]
        if not fit:
            return -math.inf, None
        best, label = max(fit)
        return (best - self.ordinary[1 - half_of(word)].score(word)) / (len(word) + 1), label


def _least(label: str, value: bytes) -> str:
    return hashlib.md5(label.encode() + b":" + value).hexdigest()


def _limit(label: str, sample: int, words: int) -> int:
    return words if label.startswith("word/") else sample


def apart(runs: list[tuple[int, int]], spans: list[tuple[int, int, int, bytes]]) -> list[tuple[int, int]]:
    """The runs that touch no span; both by start, so one pass over both."""
    out, reach, j = [], 0, 0
    for a, b in runs:
        while j < len(spans) and spans[j][0] < b:
            reach = max(reach, spans[j][1])
            j += 1
        if reach <= a:
            out.append((a, b))
    return out


def fit(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE, words: int = WORDS) -> Formats:
    """Learn the formats from the credentials that the base patterns label, all of `docs` considered.

    Each task keeps the values of the least hashes for each label, and these are thinned out in three steps. There are three
    kinds of at most 512 shapes and two halves of words, so the driver gets at most a bounded number of values of at most
    256 characters, whatever the input.
    """

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[str, dict[bytes, str]] = defaultdict(dict)

        def add(label: str, value: bytes) -> None:
            if len(value) <= SAMPLE_CHARS:
                heap, most = heaps[label], _limit(label, sample, words)
                heap[value] = _least(label, value)
                if len(heap) >= 4 * most:
                    heaps[label] = dict(heapq.nsmallest(most, heap.items(), key=lambda x: x[1]))

        for batch in batches:
            for text in batch.column(0):
                raw = (text.as_py() or "").encode()
                runs = candidates(raw)
                spans = base_spans(raw, runs)
                for _, _, kind, value in spans:
                    add(f"{KINDS[kind]}/{shape(value)}", value)
                for a, b in apart(runs, spans):
                    add(f"word/{half_of(raw[a:b])}", raw[a:b])
        rows = [(k, TaskContext.get().partitionId(), h, v) for k, d in heaps.items() for v, h in heapq.nsmallest(_limit(k, sample, words), d.items(), key=lambda x: x[1])]
        cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.binary())], names=["label", "salt", "h", "value"])

    def thin(key: tuple, table: pa.Table) -> pa.Table:
        table = pa.Table.from_batches(table.to_batches()).group_by(["label", "h"]).aggregate([("value", "min"), ("salt", "min")]).rename_columns(["label", "h", "value", "salt"])
        return table.sort_by("h").slice(0, _limit(key[0].as_py(), sample, words)).select(["label", "salt", "h", "value"])

    schema = "label string, salt int, h string, value binary"
    picked = docs.select(quoted(text_col).alias("_text")).mapInArrow(pick, schema)
    for salts in (4096, 64, 1):
        picked = picked.withColumn("salt", F.pmod("salt", F.lit(salts)).cast("int")).groupBy("label", "salt").applyInArrow(thin, schema)
    got: dict[str, list[bytes]] = defaultdict(list)
    for r in materialise(picked, "secrets-sample").collect():
        got[r.label].append(bytes(r.value))
    return Formats({k: v for k, v in got.items() if not k.startswith("word/")}, (got["word/0"], got["word/1"]))


def scan(docs: DataFrame, formats: Formats | None = None, *, id_col: str = "doc_id", text_col: str = "text", margin: float = MARGIN) -> DataFrame:
    """One row a document: id_col, spans (array of kind, start, end in code points, end exclusive, score), n_candidates.

    Null and empty texts have no span. Base spans stay as they are. Every run of 12 value characters or more is a candidate,
    also one that touches base spans; those that an automaton finds likelier than an ordinary word, by `margin` nats a
    character, become spans of kind ``format``. Ids may be of any type, null and repeated too; repeated rows each get a row.
    Other columns don't matter, whatever their names. An empty table gives an empty result. The broadcast automata are
    bounded by the sample.
    """
    formats = fit(docs, text_col) if formats is None else formats
    model = docs.sparkSession.sparkContext.broadcast(formats)
    rows = docs.select(quoted(id_col).alias("_id"), quoted(text_col).alias("_text"))
    kind = dict(rows.dtypes)["_id"]
    struct = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, n = [], []
            for text in batch.column("_text"):
                raw = (text.as_py() or "").encode()
                runs = candidates(raw)
                found = [(s, e, k, None) for s, e, k, _ in base_spans(raw, runs)]
                for a, b in runs:
                    score, _ = model.value.margin(raw[a:b])
                    if score > margin:
                        found.append((a, b, 3, score))
                if found and not raw.isascii():
                    at = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
                    point = lambda i: int(at[i - 1]) if i else 0
                    found = [(point(s), point(e), k, x) for s, e, k, x in found]
                out.append([{"kind": KINDS[k], "start": s, "end": e, "score": x} for s, e, k, x in sorted(found, key=lambda r: (r[0], r[2]))])
                n.append(len(runs))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(out, struct), pa.array(n, pa.int64())], names=["_id", "spans", "n_candidates"])

    found = rows.mapInArrow(find, f"_id {kind}, spans array<struct<kind:string,start:bigint,end:bigint,score:double>>, n_candidates long")
    return found.withColumnRenamed("_id", id_col)
