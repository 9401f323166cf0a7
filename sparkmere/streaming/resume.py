"""Appending sinks that pick up where they stopped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery

from sparkmere.sources.readers import read_done_ids


def append_new(batch: DataFrame, out: str, key: str = "passage_id", produce: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Append what `produce` makes of the rows of `batch` whose key the sink does not have yet. A repeated batch adds nothing."""
    todo = batch.join(read_done_ids(batch.sparkSession, out, key), key, "left_anti")
    (produce(todo) if produce else todo).write.mode("append").json(out)


def resumable_sink(stream: DataFrame, out: str, checkpoint: str, key: str = "passage_id", produce: Callable[[DataFrame], DataFrame] | None = None, **trigger) -> StreamingQuery:
    """A streaming source to an appending JSON sink, batch by batch; on a restart neither done batches nor done keys come again."""
    write = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: append_new(df, out, key, produce))
    return write.trigger(**(trigger or {"availableNow": True})).start()
