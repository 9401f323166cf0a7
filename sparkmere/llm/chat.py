"""Chat formatting: schema fingerprints select declarative mappings; a reversible template with a loss mask."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, NEWLINE = "<|im_start|>", "<|im_end|>", "<|nl|>"
LOSS_ROLES = ("assistant",)


@dataclass(frozen=True)
class Mapping:
    """How a layout's fields become turns.

    needs: nested field paths that a record of this layout has; a list's elements are written ``[]``.
    each: the field with a list of messages, or None; then role and text name fields of its elements.
    turns: for flat layouts, (role, fields) pairs; the fields' non-empty texts are joined by an empty line.
    row: the record is one turn of a conversation that other records go on with.
    """

    name: str
    needs: frozenset[str]
    each: str | None = None
    role: str = "role"
    text: str = "content"
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()
    row: bool = False
    roles: dict[str, str] = field(default_factory=dict)


def _flat(name: str, *turns: tuple[str, tuple[str, ...]], needs: tuple[str, ...]) -> Mapping:
    return Mapping(name, frozenset(needs), turns=turns)


_SPOKEN = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
MAPPINGS: tuple[Mapping, ...] = (
    Mapping("messages", frozenset({"messages[].role", "messages[].content"}), each="messages"),
    Mapping("from_value", frozenset({"conversations[].from", "conversations[].value"}), each="conversations", role="from", text="value", roles=_SPOKEN),
    Mapping("turn_rows", frozenset({"turn", "role", "text"}), text="text", row=True),
    _flat("instruction_input_output", ("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)), needs=("instruction", "output")),
    _flat("instruction_response", ("system", ("system",)), ("user", ("instruction", "context")), ("assistant", ("response",)), needs=("instruction", "response")),
    _flat("prompt_completion", ("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",)), needs=("prompt", "completion")),
    _flat("prompt_response", ("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)), needs=("prompt", "response")),
    _flat("question_answer", ("system", ("system",)), ("user", ("question",)), ("assistant", ("answer",)), needs=("question", "answer")),
)


def field_paths(value: object, at: str = "") -> set[str]:
    """The nested paths of a parsed record, list elements as ``[]``; null and text leaves look alike."""
    if isinstance(value, dict):
        return set().union(*(field_paths(v, f"{at}.{k}" if at else k) for k, v in value.items())) if value else {at}
    if isinstance(value, list):
        return set().union(*(field_paths(v, f"{at}[]") for v in value)) if value else {f"{at}[]"}
    return {at}


def fingerprint(paths: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def select_mapping(paths: set[str], mappings: tuple[Mapping, ...] = MAPPINGS) -> Mapping | None:
    """The mapping whose needed paths are all there, the one that needs most; ties by order."""
    fit = [m for m in mappings if m.needs <= paths]
    return max(fit, key=lambda m: len(m.needs), default=None)


def _text(value: object) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def to_turns(record: dict, m: Mapping) -> list[tuple[str, str]]:
    if m.row:
        return [(m.roles.get(r := _text(record.get(m.role)), r), _text(record.get(m.text)))]
    if m.each:
        return [(m.roles.get(r := _text(x.get(m.role)), r), _text(x.get(m.text))) for x in record[m.each] if isinstance(x, dict)]
    got = [(role, "\n\n".join(t for f in names if (t := _text(record.get(f))))) for role, names in m.turns]
    return [(role, text) for role, text in got if text or role != "system"]


def canonical_turns(df: DataFrame, record_col: str, key_col: str, order_col: str | None = None, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """Rows (key, ord, sub, role, text, schema_id, layout), one a turn, from records in JSON.

    The fingerprint of a record's field paths is looked up; the first record of each new fingerprint in a task is matched
    with the mappings. Extra fields change the fingerprint but not the mapping. Records that are null, not JSON objects or
    of no known layout give one row with a null role, null text and layout null, so none is lost silently.
    """
    kind = dict(df.dtypes)[key_col]
    order = F.col(order_col).cast("long") if order_col else F.lit(0).cast("long")
    rows = df.select(F.col(key_col).alias("key"), order.alias("ord"), F.col(record_col).alias("_record"))

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Mapping | None] = {}
        seen: dict[tuple, tuple[str, Mapping | None]] = {}
        for batch in batches:
            take, sub, roles, texts, ids, layouts = [], [], [], [], [], []
            for i, raw in enumerate(batch.column("_record")):
                try:
                    record = json.loads(raw.as_py() or "null")
                except ValueError:
                    record = None
                fp, m = None, None
                if isinstance(record, dict):
                    flat = None if any(isinstance(v, (dict, list)) for v in record.values()) else tuple(record)
                    if flat is None or flat not in seen:
                        paths = field_paths(record)
                        fp = fingerprint(paths)
                        if fp not in known:
                            known[fp] = select_mapping(paths, mappings)
                        m = known[fp]
                        if flat is not None:
                            seen[flat] = fp, m
                    else:
                        fp, m = seen[flat]
                turns = to_turns(record, m) if m else [(None, None)]
                for j, (role, text) in enumerate(turns):
                    for to, x in ((take, i), (sub, j), (roles, role), (texts, text), (ids, fp), (layouts, m.name if m else None)):
                        to.append(x)
            pick = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pick), batch.column("ord").take(pick), pa.array(sub, pa.int64()), *(pa.array(x, pa.string()) for x in (roles, texts, ids, layouts))], names=["key", "ord", "sub", "role", "text", "schema_id", "layout"])

    return rows.mapInArrow(convert, f"key {kind}, ord long, sub long, role string, text string, schema_id string, layout string")


def escape(text: Column) -> Column:
    r"""``<|``, ``<\|``, ``<\\|`` ... get one more backslash, so no ``<|`` is left and the way back is plain."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def format_turns(turns: DataFrame, loss_roles: tuple[str, ...] = LOSS_ROLES) -> DataFrame:
    """`turns` with segment, loss_from and loss_to (code points within the segment, null where there is no loss).

    A conversation's output is its segments in the order (ord, sub). Null roles and texts count as empty.
    """
    role = F.regexp_replace(escape(F.coalesce("role", F.lit(""))), "\n", NEWLINE)
    head, body = F.concat(F.lit(START), role, F.lit("\n")), escape(F.coalesce("text", F.lit("")))
    loss = F.col("role").isin(*loss_roles)
    t = turns.withColumn("_head", head).withColumn("_body", body)
    return t.select(*turns.columns, F.concat("_head", "_body", F.lit(f"{END}\n")).alias("segment"), F.when(loss, F.length("_head").cast("long")).alias("loss_from"), F.when(loss, (F.length("_head") + F.length("_body")).cast("long")).alias("loss_to"))


def assemble(formatted: DataFrame) -> DataFrame:
    """One row a conversation: key, formatted, loss_spans (array of structs of code points). A conversation has to fit a row."""
    got = formatted.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("ord", "sub", "role", "segment", "loss_from", "loss_to"))).alias("t"))
    step = F.aggregate("t", F.struct(F.lit(0).cast("long").alias("n"), F.array().cast("array<struct<start:bigint,stop:bigint>>").alias("s")), lambda a, x: F.struct((a.n + F.length(x.segment)).alias("n"), F.when(x.loss_from.isNotNull(), F.concat(a.s, F.array(F.struct((a.n + x.loss_from).alias("start"), (a.n + x.loss_to).alias("stop"))))).otherwise(a.s).alias("s")))
    return got.select("key", F.array_join(F.transform("t", lambda x: x.segment), "").alias("formatted"), step.s.alias("loss_spans"))


_SEGMENT = re.compile(r"<\|im_start\|>(.*)\n([\s\S]*)<\|im_end\|>\n")


def read_segment(segment: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    m = _SEGMENT.fullmatch(segment)
    if m is None or START in m[2] or END in m[2]:
        raise ValueError("not one formatted turn")
    return unescape(m[1].replace(NEWLINE, "\n")), unescape(m[2])


def digest(formatted: DataFrame) -> DataFrame:
    """Conversations' figures, read back from the segments: key, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Segments are sorted by conversation and order and streamed, so the longest conversation needs no memory of its own.
    """
    kind = dict(formatted.dtypes)["key"]
    rows = formatted.select("key", "ord", "sub", "role", "segment", "loss_from", "loss_to").repartition("key").sortWithinPartitions("key", "ord", "sub", "role", "segment")
    names = ["key", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key_type, key, state, out = None, None, None, []

        def flush():
            got = list(zip(*out, strict=True))
            types = [key_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(got, types, strict=True)], names=names)

        def close():
            out.append((key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        for batch in batches:
            key_type = batch.schema.field("key").type
            for k, segment, a, b in zip(*(batch.column(c).to_pylist() for c in ("key", "segment", "loss_from", "loss_to")), strict=True):
                if state is None or k != key:
                    if state is not None:
                        close()
                    key, state = k, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = read_segment(segment)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[4] += len(segment)
                if a is not None:
                    under = unescape(segment[a:b])
                    state[2] += len(under)
                    state[3].update(under.encode())
            if len(out) >= 1000:
                yield flush()
                out.clear()
        if state is not None:
            close()
        if out:
            yield flush()

    return rows.mapInArrow(stream, f"key {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
