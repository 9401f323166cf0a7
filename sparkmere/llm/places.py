"""Where rows lie, and decisions that reach rows where they lie, so that whole documents are never shuffled.

A row's place is (file, row): a hash of its Parquet file's path and its number in that file, which don't depend on how the
file is split. An operator decides on narrow rows (place, id, hash), writes its decisions as small files, one for each
65,536 rows of an input file, and the next scan of the documents looks each row up in the file of its own block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import materialise, new_path, put_file, read_file

BLOCK_BITS = 16
#: Rows of a batch that are filtered, and so copied, at a time.
SLICE = 1024
_SCANS = {"Project", "Filter", "SubqueryAlias", "LogicalRelation"}


def quoted(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole(docs: DataFrame) -> Column:
    """All columns as one struct, so that no name of theirs meets one of an operator's own."""
    return F.struct(*[quoted(c).alias(c) for c in docs.columns]).alias("_doc")


def field(name: str) -> Column:
    return F.col("_doc").getField(name)


def unpacked(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The documents' own columns again."""
    return rows.select(*[field(c).alias(c) for c in columns])


def _plain_scan(docs: DataFrame) -> bool:
    """Whether `docs` is a table with columns picked and rows filtered, no more, so that each row has a place of its own."""
    plan = docs._jdf.queryExecution().analyzed()
    todo = [plan]
    while todo:
        node = todo.pop()
        if node.nodeName() not in _SCANS:
            return False
        kids = node.children()
        todo += [kids.apply(i) for i in range(kids.size())]
    return plan.deterministic()


def located(docs: DataFrame) -> DataFrame:
    """(_doc, file, row): `docs` with places. What isn't a scan of Parquet files is written in the shared folder first."""
    place = F.xxhash64(F.col("_metadata.file_path")).alias("file"), F.col("_metadata.row_index").alias("row")
    if "_metadata" not in {c.lower() for c in docs.columns} and _plain_scan(docs):
        try:
            return docs.select(whole(docs), *place)
        except AnalysisException:
            pass
    return materialise(docs.select(whole(docs)), "located").select("_doc", *place)


def _name(file: int, block: int) -> str:
    return f"{file & (2**64 - 1):016x}-{block}.arrow"


def write_side(marks: DataFrame, name: str) -> tuple[str, str]:
    """Write `marks` (file, row, value) beside the documents; gives (path, the value's type).

    `marks` has a row for every row of the documents, with a null value where there is nothing to say, so that a block
    without a file is an error and not an empty one. At most 65,536 rows come together in a task.
    """
    kind, path = dict(marks.dtypes)["value"], new_path(marks.sparkSession, name)

    def write(key: tuple, table: pa.Table) -> pa.Table:
        t = table.select(["row", "value"]).filter(table.column("value").is_valid()).sort_by("row").combine_chunks()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_file(sink, t.schema) as out:
            out.write_table(t)
        put_file(path, _name(key[0].as_py(), key[1].as_py()), [sink.getvalue()])
        return pa.table({"file": pa.array([key[0].as_py()], pa.int64()), "n": pa.array([len(t)], pa.int64())})

    rows = marks.select("file", F.shiftright("row", BLOCK_BITS).alias("block"), "row", "value")
    materialise(rows.groupBy("file", "block").applyInArrow(write, "file long, n long"), f"{name}-written")
    return path, kind


class _Side:
    """Looks places up in the files of `write_side`, one block's file at a time."""

    def __init__(self, path: str):
        self.path, self.have, self.rows, self.values = path, None, np.zeros(0, np.int64), None

    def look(self, files: np.ndarray, rows: np.ndarray) -> pa.Array:
        """The values of these places, null where there is none."""
        out, blocks = [], rows >> BLOCK_BITS
        cuts = (np.flatnonzero((files[1:] != files[:-1]) | (blocks[1:] != blocks[:-1])) + 1).tolist()
        for a, b in zip([0, *cuts], [*cuts, len(files)], strict=True):
            key = int(files[a]), int(blocks[a])
            if key != self.have:
                table = pa.ipc.open_file(read_file(self.path, _name(*key))).read_all().combine_chunks()
                self.have, self.rows, self.values = key, table.column("row").to_numpy(), table.column("value")
            want = np.searchsorted(self.rows, rows[a:b])
            hit = np.append(self.rows, -1)[want] == rows[a:b]
            out += self.values.take(pa.array(want, pa.int64(), mask=~hit)).chunks
        return pa.concat_arrays(out)


def with_side(rows: DataFrame, side: tuple[str, str]) -> DataFrame:
    """`rows` (located) that have a value in `side`, with it."""
    path, kind = side

    def look(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        found = _Side(path)
        for files, numbers in batches:
            yield found.look(files.to_numpy(zero_copy_only=False), numbers.to_numpy(zero_copy_only=False)) if len(files) else files

    # Not deterministic for the optimizer, so that it is worked out once a row.
    value = F.arrow_udf(look, kind).asNondeterministic()
    return rows.withColumn("value", value("file", "row")).where("value IS NOT NULL")


def marked(batches: Iterator[pa.RecordBatch], side: tuple[str, str]) -> Iterator[pa.RecordBatch]:
    """`with_side` inside a task that takes the rows (file, row, ...) in Arrow anyway: the rows that have a value, with it."""
    found = _Side(side[0])
    for whole_batch in batches:
        for first in range(0, len(whole_batch), SLICE):
            batch = whole_batch.slice(first, SLICE)
            value = found.look(batch.column("file").to_numpy(), batch.column("row").to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns, value], names=[*batch.schema.names, "value"]).filter(value.is_valid())
