"""Shared scratch space for intermediate tables that several jobs read."""
from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_folders: dict[int, str] = {}  # of the threads that are in a block of scratch(); a plain table, which functions sent to workers may carry


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the folder named by ``spark.checkpoint.dir``.

    Only a session in one process (tests, a laptop) that has no such setting gets a temporary folder of its own. On a
    cluster a missing setting is an error: each machine would write to its own disk, and a read would give a part.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        root = tempfile.mkdtemp(prefix="modelscout-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{_folders.get(threading.get_ident()) or root.rstrip('/')}/modelscout-{label}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing reads any more."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that :func:`scratch_path` names within this block are deleted when it ends.

    What is wanted of them must have been written elsewhere by then: frames that still read them fail afterwards.
    """
    folder = scratch_path(spark, "scope")
    thread = threading.get_ident()
    before = _folders.get(thread)
    _folders[thread] = folder
    try:
        yield
    finally:
        if before is None:
            del _folders[thread]
        else:
            _folders[thread] = before
        remove(spark, folder)


def materialize(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write ``df`` once to the shared folder, with the writer's ``options``, and read it back.

    The lineage ends at the files, so a lost executor costs a re-read and not a re-computation.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
