"""Tables that cut lineage, in the shared folder the cluster names in spark.checkpoint.dir.

Unlike localCheckpoint these survive the loss of an executor, and unlike cache() they are
never recomputed, so what a task numbered at random or by its position stays as it was.
"""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_default: str | None = None
_made: list[tuple[SparkSession, str]] = []
_scope: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("scope", default=None)


def root(spark: SparkSession) -> str:
    """The cluster's shared folder; where none is set one of this process, which only a local master can read."""
    global _default
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir names no folder that all executors share")
    if _default is None:
        _default = tempfile.mkdtemp(prefix="tessera-")
    return _default


def place(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, deleted when the driver ends."""
    path = f"{root(spark)}/tessera-{tag}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    if (own := _scope.get()) is not None:
        own.append(path)
    return path


def keep(df: DataFrame, tag: str, *, packed: bool = False) -> DataFrame:
    """Writes df and reads it again; the files go when the driver ends, or with drop(). What is packed already is not compressed."""
    spark = df.sparkSession
    path = place(spark, tag)
    df.write.parquet(path, compression="none" if packed else None)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows by key over all shuffle partitions. Spark would join partitions of few bytes into one, where a group of few bytes can be long work."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder of the shared file system, if it is there."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """What a folder of the shared file system holds; nothing, if it isn't there."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in files.listStatus(at)) if files.exists(at) else []


def _forget(path: str) -> None:
    for x in [x for x in _made if x[1] == path]:
        _made.remove(x)
        remove(*x)


def drop(*frames: DataFrame) -> None:
    """Deletes tables of keep() that nothing reads any more."""
    for df in frames:
        _forget(df._tessera_path)


@contextlib.contextmanager
def scope() -> Iterator[None]:
    """For steps whose results are written elsewhere, or are numbers: what keep() makes inside goes at the end."""
    own: list[str] = []
    token = _scope.set(own)
    try:
        yield
    finally:
        _scope.reset(token)
        for path in own:
            _forget(path)


@atexit.register
def _sweep() -> None:
    for spark, path in _made:
        try:
            remove(spark, path)
        except Exception:  # the JVM may be gone already; the folder is the cluster's to clean
            return
