"""Token-ID output in training order: every sequence gets a global slot by a keyed permutation.

Texts become token IDs of a public byte-level vocabulary, each text with an end token, cut into sequences of a fixed
length, the last one padded. Sequences are numbered in the order of (id, part); a Feistel permutation with
cycle-walking takes number to slot. Slots are dealt to shards by range, so a shard is a run of fixed-stride records:
record r of shard s is at byte r * stride, and a reader that knows its slot resumes there. A manifest beside the shards says
how many sequences there are, their stride, the key and the vocabulary.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .places import quoted
from .store import drop_path, materialise, new_path, put_file, read_file, run_and_sum, write_table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END_ID, PAD_ID = 50_256, 65_535
SEQ_LEN, SHARD_RECORDS = 1024, 4096
ROUNDS, KEY = 6, "sparkmere-order"
#: Pieces of texts that a worker remembers; the memory is emptied when it holds more.
MEMO = 1_000_000
#: A space after white space, or a zero character.
_ODD = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}] |\x00"
BATCH_BYTES = 8 << 20
#: Runs of slots in which shards are written, one after the other.
WAVES = 4


def load_encoding(vocabulary: str = VOCABULARY):
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """Whole texts to IDs. A token never spans the place between a character other than white space and a space after it.
    A text where every space follows such a character is encoded by the pieces between its spaces, each different piece
    once; new pieces are encoded together and cut apart again by the tokens' lengths. Other texts are encoded whole."""

    def __init__(self, vocabulary: str = VOCABULARY):
        self.encoding, self.memo = load_encoding(vocabulary), {}
        self.length = np.array([len(self.encoding.decode_single_token_bytes(i)) for i in range(self.encoding.n_vocab)])

    def _learn(self, pieces: list[str]) -> None:
        """A piece is kept with its leading space, a text's first piece with a zero character for it."""
        new = [p for p in pieces if p not in self.memo]
        joint = [p for p in new if p[-1:].strip() and p[0] != "\0"]
        for p in new:
            if not p[-1:].strip() or p[0] == "\0":
                self.memo[p] = self.whole(p[1:] if p[:1] == "\0" else f" {p}")
        if joint:
            ids = np.frombuffer(self.whole(" " + " ".join(joint)), np.uint16)
            ends = np.searchsorted(np.cumsum(self.length[ids]), np.cumsum([len(p.encode()) + 1 for p in joint])) + 1
            raw, at = ids.tobytes(), 0
            for p, end in zip(joint, (2 * ends).tolist(), strict=True):
                self.memo[p] = raw[at:end]
                at = end

    def whole(self, text: str) -> bytes:
        return np.array(self.encoding.encode_ordinary(text), np.uint16).tobytes()

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All IDs of the texts (null: empty), one after the other, and how many each text has."""
        text = lambda x: pa.scalar(x, pa.large_string())
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if len(self.memo) > MEMO:
            self.memo.clear()
        odd = pc.match_substring_regex(texts, _ODD)
        pieces = pc.split_pattern(pc.binary_join_element_wise(text("\0"), pc.if_else(odd, text(""), texts), text("")), " ")
        coded = pieces.flatten().dictionary_encode()
        names = coded.dictionary.to_pylist()
        self._learn(names)
        ids = pa.array(map(self.memo.__getitem__, names), pa.large_binary()).take(coded.indices)
        at = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1, 8 * ids.offset)
        ends = at[pieces.offsets.to_numpy() - pieces.offsets[0].as_py()] // 2
        flat = np.frombuffer(ids.buffers()[2], np.uint16)[ends[0] : ends[-1]]
        if not pc.any(odd).as_py():
            return flat, np.diff(ends)
        got = np.split(flat, (ends - ends[0])[1:-1])
        for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)):
            got[i] = np.frombuffer(self.whole(texts[int(i)].as_py()), np.uint16)
        return np.concatenate(got), np.array([len(x) for x in got])

    def decode(self, ids: list[int]) -> str:
        return self.encoding.decode([i for i in ids if i < END_ID])


@lru_cache(maxsize=1)
def worker_encoder(vocabulary: str) -> Encoder:
    """One encoder for each Python worker, whose memory of segments serves its later tasks too."""
    return Encoder(vocabulary)


def sequences(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", seq_len: int = SEQ_LEN, vocabulary: str = VOCABULARY) -> DataFrame:
    """Rows (dealt, row, doc, hash, id, part, n_tokens, ids): ids is little-endian uint16, `seq_len` of them, padded with
    65535; dealt is the partition that a row comes from, row its place there, doc its text's place there, hash the text's."""
    kind = dict(docs.select(quoted(id_col).alias("id")).dtypes)["id"]
    names = ["dealt", "row", "doc", "hash", "id", "part", "n_tokens", "ids"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, dealt, done, docs_done = worker_encoder(vocabulary), TaskContext.get().partitionId(), 0, 0
        for whole in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(whole.column("_text")), 0).to_numpy(zero_copy_only=False))
            cuts = np.unique(np.append(np.searchsorted(sizes, np.arange(1, sizes[-1] // BATCH_BYTES + 1) * BATCH_BYTES) + 1, len(whole))) if len(whole) else []
            for a, b in zip([0, *cuts], cuts, strict=False):
                batch = whole.slice(a, b - a)
                flat, n = encoder.batch(batch.column("_text"))
                parts = (n + seq_len) // seq_len
                base = np.cumsum(parts) - parts
                out = np.full(int(parts.sum()) * seq_len, PAD_ID, "<u2")
                out[np.repeat(base * seq_len - (np.cumsum(n) - n), n) + np.arange(len(flat))] = flat
                out[base * seq_len + n] = END_ID
                part = np.arange(int(parts.sum())) - np.repeat(base, parts)
                tokens = np.minimum(np.repeat(n + 1, parts) - part * seq_len, seq_len)
                ids = pa.Array.from_buffers(pa.binary(2 * seq_len), int(parts.sum()), [None, pa.py_buffer(out)]).cast(pa.binary())
                row = done + np.arange(len(part))
                done += len(part)
                own = np.repeat(np.arange(len(batch)), parts)
                doc = docs_done + own
                docs_done += len(batch)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), dealt, np.int64)), pa.array(row), pa.array(doc), *(batch.column(c).take(pa.array(own)) for c in ("_hash", "_id")), pa.array(part), pa.array(tokens), ids], names=names)

    rows = docs.select(quoted(id_col).alias("_id"), quoted(text_col).alias("_text"), F.xxhash64(F.coalesce(quoted(text_col), F.lit(""))).alias("_hash"))
    return rows.mapInArrow(encode, f"dealt long, row long, doc long, hash long, id {kind}, part long, n_tokens long, ids binary")


def round_keys(key: str = KEY, rounds: int = ROUNDS) -> list[int]:
    return [int(hashlib.md5(f"{key}:{r}".encode()).hexdigest()[:8], 16) & 0x7FFFFFFF for r in range(rounds)]


def feistel(number: Column, half_bits: int, keys: list[int]) -> Column:
    """A balanced Feistel network over 2 * half_bits bits."""
    mask = F.lit((1 << half_bits) - 1)
    left, right = F.shiftrightunsigned(number, half_bits), number.bitwiseAND(mask)
    for k in keys:
        left, right = right, left.bitwiseXOR(F.xxhash64(right, F.lit(k)).bitwiseAND(mask))
    return F.shiftleft(left, half_bits).bitwiseOR(right)


def permute(numbers: DataFrame, n: int, number_col: str = "number", key: str = KEY) -> DataFrame:
    """`numbers` with slot, a permutation of 0..n-1 keyed by `key`.

    The network permutes a power of 4 not below n, under 4 n. A value that falls outside is passed through again until it
    is inside (cycle-walking), which keeps the whole a permutation: three of four steps at worst miss, so half the values
    are inside after two steps, and the walk is done in steps of one pass over what is still outside. SQL has no loop, so
    the walk is an aggregate over a fixed sequence that stops changing once inside; 200 steps fail with (3/4)^200, 1e-25, and
    that raises an error.
    """
    half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
    keys = round_keys(key)
    step = lambda x: feistel(x, half, keys)
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(200)), step(F.col(number_col)), lambda x, _: F.when(x < F.lit(n), x).otherwise(step(x)))
    first = numbers.withColumn("slot", step(F.col(number_col)))
    again = F.when(F.col("slot") < F.lit(n), F.col("slot")).otherwise(walked)
    inside = F.when(F.col("slot") < F.lit(n), F.col("slot")).otherwise(F.raise_error(F.lit("the walk did not come inside")).cast("long"))
    return first.withColumn("slot", again).withColumn("slot", inside)


def place_sequences(seqs: DataFrame, *, shard_records: int = SHARD_RECORDS, key: str = KEY) -> tuple[DataFrame, int]:
    """Rows (dealt, row, id, part, n_tokens, number, slot, shard, record) of `seqs` (materialised), and how many.

    Numbers are places in the order of (id, hash of the text, part); only rows that repeat an id and a text are told apart
    by where they come from, and they are alike. The payload isn't read: narrow rows are range-partitioned, sorted and
    counted, and one sum a partition is carried on.
    """
    from pyspark.sql import Window

    order = ["id", "hash", "dealt", "doc", "part"]
    narrow = seqs.select(*order, "row", "n_tokens")
    parts = max(int(seqs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-seqs.count() // 500_000))
    at = F.monotonically_increasing_id()
    ranked, ranked_path = write_table(narrow.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", at), "tokens-ranked")
    ranked = ranked.withColumn("_p", F.shiftrightunsigned("_at", 33)).withColumn("_i", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    ahead = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = materialise(ranked.groupBy("_p").agg(F.count("*").alias("_n")).select("_p", "_n", ahead.alias("_base")), "tokens-partitions")
    n = sums.agg(F.sum("_n")).first()[0] or 0
    numbered = ranked.join(F.broadcast(sums.drop("_n")), "_p").withColumn("number", (F.col("_base") + F.col("_i")).cast("long"))
    placed = permute(numbered.select("dealt", "row", "id", "part", "n_tokens", "number"), n, "number", key)
    placed = placed.withColumn("shard", F.floor(F.col("slot") / shard_records).cast("long")).withColumn("record", F.pmod("slot", F.lit(shard_records)).cast("long"))
    placed = materialise(placed, "tokens-places")
    drop_path(seqs.sparkSession, ranked_path)
    return placed, n


def write_places(placed: DataFrame) -> str:
    """Numbers and slots as one small file for each partition that the sequences come from, in the shared folder, which
    executors open with pyarrow: so they reach the payload where it lies and no join shuffles it."""
    path = new_path(placed.sparkSession, "tokens-files")

    def write(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("row")
        put_file(path, f"{key[0].as_py()}.bin", [np.stack([table.column(c).to_numpy() for c in ("number", "slot")]).astype("<i8").tobytes()])
        return pa.table({"dealt": [key[0].as_py()], "n": [len(table)]})

    run_and_sum(placed.select("dealt", "row", "number", "slot").groupBy("dealt").applyInArrow(write, "dealt long, n long"), "n")
    return path


def with_places(seqs: DataFrame, path: str, columns: tuple[str, ...], first: int = 0, last: int = 1 << 62) -> DataFrame:
    """`columns` of `seqs` with number and slot from the files of `write_places`; rows of slots from `first` to before `last`."""
    kinds = dict(seqs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, table = None, np.zeros((2, 0), np.int64)
        for whole in batches:
            dealt = whole.column("dealt").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(dealt)) + 1).tolist(), len(dealt)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if have != dealt[a]:
                    have = dealt[a]
                    table = np.frombuffer(read_file(path, f"{have}.bin"), "<i8").reshape(2, -1)
                batch = whole.slice(a, b - a)
                number, slot = table[:, batch.column("row").to_numpy()]
                keep = np.flatnonzero((slot >= first) & (slot < last))
                part = batch.select(list(columns)).take(pa.array(keep))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(number[keep]), pa.array(slot[keep])], names=[*columns, "number", "slot"])

    schema = ", ".join(f"{c} {kinds[c]}" for c in columns)
    return seqs.select("dealt", "row", *columns).mapInArrow(run, f"{schema}, number long, slot long")


def by_slot(rows: DataFrame, n: int, shard_records: int = SHARD_RECORDS) -> DataFrame:
    """`rows` dealt by ranges of slots, as many as there are shuffle partitions but none of over 4 shards, and sorted. The
    bounds are known (slots are 0..n-1, each once), so every range has the same number of rows and nothing is sampled."""
    parts = max(1, -(-n // (4 * shard_records)), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    size = max(1, -(-n // parts))
    return rows.repartitionById(max(1, -(-n // size)), F.floor(F.col("slot") / size).cast("int")).sortWithinPartitions("slot")


def training_order(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", seq_len: int = SEQ_LEN, shard_records: int = SHARD_RECORDS, key: str = KEY, vocabulary: str = VOCABULARY) -> DataFrame:
    """Rows (id, part, n_tokens, ids, number, slot, shard, record), range-partitioned and sorted by slot.

    The same documents, key and lengths give the same slots, however the input is partitioned: see `place_sequences`. Ids may
    be of any type that has an order; a null id comes first. Other columns don't matter, whatever their names. Null text is the empty text: a sequence with the end token alone. Null and repeated ids, and
    repeated rows, are kept like others. An empty table gives an empty result. The payload is shuffled once.
    """
    seqs = materialise(sequences(docs, id_col=id_col, text_col=text_col, seq_len=seq_len, vocabulary=vocabulary), "tokens")
    placed, n = place_sequences(seqs, shard_records=shard_records, key=key)
    rows = with_places(seqs, write_places(placed), ("id", "part", "n_tokens", "ids"))
    rows = rows.withColumn("shard", F.floor(F.col("slot") / shard_records).cast("long")).withColumn("record", F.pmod("slot", F.lit(shard_records)).cast("long"))
    return by_slot(rows, n, shard_records)


def runs_of_slots(n: int, shard_records: int = SHARD_RECORDS) -> list[tuple[int, int]]:
    """(first, end) of at most WAVES runs of whole shards, each about twice the next.

    A run's shuffle lies on disk beside all shards up to its end. So even if a shuffle takes as much as its shards, shards
    and shuffle together never take more than all the shards and a fifteenth (and what rounding to whole shards adds); of
    equal runs the last would add a fourth.
    """
    shards, whole = -(-n // shard_records), (1 << WAVES) - 1
    ends = [min(n, -(-shards * (whole + 1 - (1 << (WAVES - k))) // whole) * shard_records) for k in range(WAVES + 1)]
    return [(a, b) for a, b in zip(ends, ends[1:], strict=False) if a < b]


def write_all_shards(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", seq_len: int = SEQ_LEN, shard_records: int = SHARD_RECORDS, key: str = KEY, vocabulary: str = VOCABULARY) -> tuple[str, DataFrame]:
    """Write the whole training order as raw shards with a manifest in the shared folder. Returns their path and the rows
    (id, part, n_tokens, number, slot, shard, record) by slot, without the payload.

    Shards are written in runs of slots (`runs_of_slots`), so a shuffle holds only so large a part of the payload at a time.
    The sequences' table goes when all shards are written.
    """
    spark = docs.sparkSession
    seqs, seqs_path = write_table(sequences(docs, id_col=id_col, text_col=text_col, seq_len=seq_len, vocabulary=vocabulary), "tokens")
    placed, n = place_sequences(seqs, shard_records=shard_records, key=key)
    places, path = write_places(placed), new_path(spark, "tokens-shards")
    for first, end in runs_of_slots(n, shard_records):
        rows = with_places(seqs, places, ("ids",), first, end).select("slot", "ids")
        written = run_and_sum(write_raw_shards(rows, path, n, first=first, last=end, shard_records=shard_records, seq_len=seq_len), "n_records")
        if written != end - first:
            raise ValueError(f"{written} records of {end - first} were written")
    for done in (seqs_path, places):
        drop_path(spark, done)
    write_manifest(path, n, seq_len=seq_len, shard_records=shard_records, key=key, vocabulary=vocabulary)
    return path, by_slot(placed.drop("dealt", "row"), n, shard_records)


def write_manifest(path: str, n: int, *, seq_len: int, shard_records: int, key: str, vocabulary: str) -> None:
    """What a reader has to know, as JSON; an order is the same if its manifest and documents are."""
    with open(vocabulary, "rb") as f:
        digest = hashlib.md5(f.read()).hexdigest()
    what = {"sequences": n, "shards": -(-n // shard_records), "shard_records": shard_records, "seq_len": seq_len, "stride": 2 * seq_len, "type": "uint16 little-endian", "end_id": END_ID, "pad_id": PAD_ID, "key": key, "rounds": ROUNDS, "numbered_by": "id, text hash, part", "vocabulary": vocabulary.rsplit("/", 1)[-1], "vocabulary_md5": digest}
    put_file(path, "manifest.json", [json.dumps(what, indent=1).encode()])


def read_manifest(path: str) -> dict:
    return json.loads(read_file(path, "manifest.json"))


def read_on(path: str, slot: int = 0) -> Iterator[tuple[int, np.ndarray]]:
    """(slot, IDs) from `slot` on, in order: a reader that stopped goes on there. Shards are read one after the other."""
    from pyarrow import fs

    m = read_manifest(path)
    system, top = fs.FileSystem.from_uri(path)
    while slot < m["sequences"]:
        k, record = divmod(slot, m["shard_records"])
        with system.open_input_file(f"{top}/shard-{k:08d}.bin") as f:
            f.seek(record * m["stride"])
            while slot < min((k + 1) * m["shard_records"], m["sequences"]):
                ids = np.frombuffer(f.read(m["stride"]), "<u2")
                yield slot, ids[ids != m["pad_id"]]
                slot += 1


def read_shards(rows: DataFrame, path: str, *, seq_len: int = SEQ_LEN) -> DataFrame:
    """`rows` (by slot) with read_tokens and ids_md5 of the records in the shard files, each read at record * stride."""
    stride, names = 2 * seq_len, rows.columns

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, top = fs.FileSystem.from_uri(path)
        for batch in batches:
            shard, record = batch.column("shard").to_numpy(), batch.column("record").to_numpy()
            live: list = [None] * len(batch)
            for k in np.unique(shard):
                mine = np.flatnonzero(shard == k)
                low, high = int(record[mine].min()), int(record[mine].max()) + 1
                with system.open_input_file(f"{top}/shard-{k:08d}.bin") as f:
                    f.seek(low * stride)
                    blob = f.read((high - low) * stride)
                if len(blob) != (high - low) * stride:
                    raise ValueError(f"shard {k} ends before record {high - 1}")
                for i in mine:
                    x = np.frombuffer(blob, "<u2", seq_len, (int(record[i]) - low) * stride)
                    live[i] = x[x != PAD_ID]
            sums = [hashlib.md5(x.tobytes()).hexdigest() for x in live]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([len(x) for x in live], pa.int64()), pa.array(sums, pa.string())], names=[*names, "read_tokens", "ids_md5"])

    return rows.mapInArrow(read, ", ".join(f"`{c}` {k}" for c, k in rows.dtypes) + ", read_tokens long, ids_md5 string")


def write_token_shards(ordered: DataFrame, path: str, *, shard_records: int = SHARD_RECORDS, seq_len: int = SEQ_LEN) -> None:
    """Write `ordered` (of training_order) as Parquet, one file or more a shard folder, rows by slot: (slot, record, id,
    part, n_tokens, ids). `ids` has a fixed stride, so a shard's column is the concatenation of its records."""
    ordered.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").mode("overwrite").parquet(path)


def write_raw_shards(rows: DataFrame, path: str, n: int, *, first: int = 0, last: int | None = None, shard_records: int = SHARD_RECORDS, seq_len: int = SEQ_LEN) -> DataFrame:
    """Write raw fixed-stride files ``shard-K.bin`` under `path`, a file system that executors can open with pyarrow.

    `rows` (slot, ids) has each slot from `first`, a shard's first, to before `last` (default: `n`) once. They are dealt by
    ranges of slots, whole shards to a task, sorted, and written as they come. A shard is written under a name of its task's
    own and then renamed, so a repeated task leaves the same file. Returns (shard, n_records, bytes).
    """
    last = n if last is None else last
    shards = -(-(last - first) // shard_records)
    each = max(1, -(-shards // 20_000))
    span = each * shard_records

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        at = None
        for batch in batches:
            for slot, ids in zip(batch.column("slot").to_pylist(), batch.column("ids"), strict=True):
                if slot != at and (at is not None or slot % shard_records):
                    raise ValueError(f"slot {slot} comes where {at} should")
                held.append(ids.as_py())
                at = slot + 1
                if at % shard_records == 0 or at == last:
                    k = slot // shard_records
                    put_file(path, f"shard-{k:08d}.bin", held)
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([len(held)], pa.int64()), pa.array([len(held) * 2 * seq_len], pa.int64())], names=["shard", "n_records", "bytes"])
                    held = []
        if held:
            raise ValueError(f"the shard of slot {at - 1} lacks its end")

    dealt = rows.select("slot", "ids").repartitionById(max(1, -(-(last - first) // span)), F.floor((F.col("slot") - first) / span).cast("int"))
    return dealt.sortWithinPartitions("slot").mapInArrow(write, "shard long, n_records long, bytes long")


def read_record(path: str, slot: int, *, shard_records: int = SHARD_RECORDS, seq_len: int = SEQ_LEN) -> np.ndarray:
    """The IDs at `slot`, by seeking."""
    from pyarrow import fs

    system, top = fs.FileSystem.from_uri(path)
    with system.open_input_file(f"{top}/shard-{slot // shard_records:08d}.bin") as f:
        f.seek(slot % shard_records * 2 * seq_len)
        ids = np.frombuffer(f.read(2 * seq_len), "<u2")
    return ids[ids != PAD_ID]
