"""Intermediate tables in the folder that the cluster shares.

A table written here cuts lineage and survives the loss of an executor. The
folder is the session's ``spark.checkpoint.dir``; only where that is unset and
the master is local (as in tests) a temporary folder is made and recorded in
the session.

Tables belong to the owner in whose block they are made. An operator opens one,
keeps what its result reads, and the rest is deleted; so nothing that another
result reads is touched. What is kept passes to the owner around it, the last
of which is the process.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
#: Bytes of a row group; writers and readers hold about one at a time.
ROW_GROUP = 32 << 20
#: Lets a write's shuffle files go as soon as it has ended; a stage that is tried again makes them anew.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Tables:
    """The scratch tables of one owner."""

    def __init__(self) -> None:
        self.paths: dict[str, SparkSession] = {}

    def keep(self, *tables: DataFrame) -> None:
        """Delete this owner's tables but these, all of whose readers must have been written."""
        for path in self.paths.keys() - {t.scratch_path for t in tables}:
            _delete(self.paths.pop(path), path)


_process = Tables()
_owner: ContextVar[Tables] = ContextVar("owner", default=_process)


@contextmanager
def owner() -> Iterator[Tables]:
    """Tables made in this block belong to the owner given; those left at its end pass to the one around it.

    An error deletes them all.
    """
    around, mine = _owner.get(), Tables()
    token = _owner.set(mine)
    try:
        yield mine
    except BaseException:
        mine.keep()
        raise
    finally:
        _owner.reset(token)
        around.paths |= mine.paths


def shared_root(spark: SparkSession) -> str:
    """The shared folder; on a local master one of our own where the session names none."""
    root = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError(f"set {_KEY} to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set(_KEY, root)
    return root.rstrip("/")


def materialize(df: DataFrame, tag: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return the table read back.

    Shuffle files of the write go when it has ended.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/tessera-{tag}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd").option("parquet.block.size", str(ROW_GROUP))
    if partition_by:
        writer = writer.partitionBy(partition_by)
    before = spark.conf.get(_CLEAN)
    spark.conf.set(_CLEAN, "true")
    try:
        writer.parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    _owner.get().paths[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(table: DataFrame) -> None:
    """Delete a table made by ``materialize`` that nothing will read again."""
    path = table.scratch_path
    for tables in (_owner.get(), _process):
        if path in tables.paths:
            _delete(tables.paths.pop(path), path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _at_exit() -> None:
    for path, spark in list(_process.paths.items()):
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001 - the JVM may be gone already
            return
