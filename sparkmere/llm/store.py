"""Where intermediate tables go: the folder that the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is marked for broadcast if it takes up to so many bytes, which are measured first.
BROADCAST_BYTES = 64 << 20
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a temporary folder only where none is set and all runs on one machine, as in tests."""
    sc = spark.sparkContext
    got = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not got:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        got = f"file://{tempfile.mkdtemp(prefix='sparkmere-')}"
        sc.setCheckpointDir(got)
        spark.conf.set("spark.checkpoint.dir", got)
    return f"{got.rstrip('/')}/sparkmere-{sc.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    with suppress(Exception):
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


_told: set[str] = set()


@contextmanager
def _early_cleanup(spark: SparkSession):
    """Shuffle files of the jobs inside go as soon as each job has ended, where this Spark can do so."""
    before = None
    with suppress(Exception):
        before = spark.conf.get(_CLEANUP)
        spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        with suppress(Exception):
            if before is not None:
                spark.conf.set(_CLEANUP, before)


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else has. The files go when the application ends."""
    top = shared_dir(spark)
    if top not in _told:
        _told.add(top)
        atexit.register(_delete, spark, top)
    return f"{top}/{name}-{uuid.uuid4().hex[:12]}"


def write_table(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write `df` as a table in the shared folder and read it back: cuts lineage and survives lost executors. Gives its path
    too; the files go when the application ends, or before by `drop_path`."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with _early_cleanup(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def write_worked(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, name: str) -> tuple[DataFrame, str]:
    """The rows that `work` makes of the batches of `df`, as a table in the shared folder, and its path, as of `write_table`.

    The Python tasks write the files, each one under its partition's number, so a repeated task leaves the same file. For
    files and folders of its own the JVM starts a process each (chmod), which shares all of the JVM's memory until it runs.
    """
    spark = df.sparkSession
    path = new_path(spark, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs, parquet

        system, top = fs.FileSystem.from_uri(path)
        part, out = f"part-{TaskContext.get().partitionId():08d}.parquet", None
        own = f"{top}/.{part}.{uuid.uuid4().hex}"
        for batch in work(batches):
            if out is None:
                system.create_dir(top, recursive=True)
                file = system.open_output_stream(own)
                out = parquet.ParquetWriter(file, batch.schema, compression="zstd", use_dictionary=False, write_statistics=False)
            out.write_batch(batch)
        if out is not None:
            out.close()
            file.close()
            system.move(own, f"{top}/{part}")
        yield pa.RecordBatch.from_pydict({"n": pa.array([int(out is not None)], pa.int64())})

    with _early_cleanup(spark):
        files = df.mapInArrow(run, "n long").agg(F.sum("n")).first()[0]
    return spark.read.schema(schema).parquet(path) if files else spark.createDataFrame([], schema), path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """`write_table` without the path."""
    return write_table(df, name)[0]


def run_and_sum(df: DataFrame, column: str) -> int:
    """Run `df`, whose Python tasks leave files of their own, and give the sum of `column`. No table is written for it."""
    with _early_cleanup(df.sparkSession):
        return df.agg(F.sum(column)).first()[0] or 0


def measured_bytes(df: DataFrame) -> int:
    """What the rows of `df` take in memory: 16 bytes a row, 8 a number, and the lengths of texts and arrays."""
    flat, long = 0, F.lit(0).cast("long")
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("string", "binary"):
            long = long + F.coalesce(F.octet_length(c), F.lit(0))
        elif kind.startswith("array"):
            long = long + 8 * F.greatest(F.size(c), F.lit(0))
        else:
            flat += 8
    n, more = df.agg(F.count("*"), F.coalesce(F.sum(long), F.lit(0))).first()
    return n * (flat + 16) + more


def maybe_broadcast(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """`df` (a materialised table, cheap to measure) marked for broadcast if it takes at most `most` bytes, else as it is:
    the engine then joins by a shuffle, or by a broadcast that it has measured itself."""
    return df.hint("broadcast") if measured_bytes(df) <= most else df


def put_file(path: str, name: str, pieces: list) -> None:
    """Write a file under a name of the task's own and then rename it, so a repeated task leaves the same file. Executors
    open `path` with pyarrow."""
    from pyarrow import fs

    system, top = fs.FileSystem.from_uri(path)
    system.create_dir(top, recursive=True)
    own = f"{top}/.{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(own) as f:
        for x in pieces:
            f.write(x)
    system.move(own, f"{top}/{name}")


def read_file(path: str, name: str) -> bytes:
    from pyarrow import fs

    system, top = fs.FileSystem.from_uri(path)
    with system.open_input_file(f"{top}/{name}") as f:
        return f.read()


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a table or folder of the shared folder that nothing will read again."""
    _delete(spark, path)
