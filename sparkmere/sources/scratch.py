"""Folders for files that a query writes: in the folder that the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import suppress

from pyspark.sql import SparkSession

_told: set[str] = set()


def delete(spark: SparkSession, path: str) -> None:
    with suppress(Exception):
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def new_folder(spark: SparkSession, name: str) -> str:
    """A path that nothing else has; its files go when the application ends. A temporary folder stands in only where no
    shared one is set and all runs on one machine."""
    sc = spark.sparkContext
    top = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        top = f"file://{tempfile.mkdtemp(prefix='sparkmere-')}"
        spark.conf.set("spark.checkpoint.dir", top)
    own = f"{top.rstrip('/')}/sparkmere-files-{sc.applicationId}"
    if own not in _told:
        _told.add(own)
        atexit.register(delete, spark, own)
    return f"{own}/{name}-{uuid.uuid4().hex[:12]}"
