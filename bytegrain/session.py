"""Staged tables: lineage is cut by writing a table to the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """Folder for staged tables: `spark.checkpoint.dir`, or the context's checkpoint folder.

    Only a local session without either gets a folder of its own; on a cluster a
    machine-local folder would be lost with its machine, so that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    root = tempfile.mkdtemp(prefix="bytegrain-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


BATCH_BYTES = 1 << 23  # of an Arrow batch of a staged table
BATCH_OPTION = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Tables written inside hand Arrow functions batches of about BATCH_BYTES instead of
    10,000 rows or 64 MB, of which a task holds several. A session's own setting stays."""
    if spark.conf.get(BATCH_OPTION, None) is not None:
        yield
        return
    spark.conf.set(BATCH_OPTION, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.unset(BATCH_OPTION)


_scopes: list[list[Stage]] = []


@contextmanager
def scratch() -> Iterator[None]:
    """Drop all tables staged inside when the block ends, also by an error.

    For jobs that write their result; a lazy result still reads its staged tables.
    """
    _scopes.append([])
    try:
        yield
    finally:
        for stage in _scopes.pop():
            stage.drop()


class Stage:
    """A table written to the shared folder and read back with a one-step lineage."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = f"{shared_root(self.spark)}/bytegrain/{name}-{uuid.uuid4().hex}"
        self._schema = df.schema
        if _scopes:
            _scopes[-1].append(self)
        with small_batches(self.spark):
            df.write.mode("errorifexists").parquet(self.path)

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self._schema).parquet(self.path)

    def drop(self) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def any_file(spark: SparkSession, pattern: str) -> bool:
    """Whether a path of this glob pattern exists in its file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return found is not None and len(found) > 0
