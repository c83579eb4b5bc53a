"""Tables written to the cluster's shared folder, to cut lineage and to give joins measured sizes."""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from ledgerleaf.sources.shared import shared_dir


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/ledgerleaf-{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    """Staged tables live as long as the application, as their readers are lazy."""
    try:
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)
    except Exception:  # the JVM is gone already
        pass


#: The paths of the tables staged in the innermost open ``scope`` of this thread.
_SCOPE: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("scope", default=None)


@contextlib.contextmanager
def scope() -> Iterator[list[str]]:
    """Gathers what this thread stages inside, for ``settled``; what is left at the end belongs to the scope around, if any."""
    own: list[str] = []
    outer = _SCOPE.get()
    token = _SCOPE.set(own)
    try:
        yield own
    finally:
        _SCOPE.reset(token)
        if outer is not None:
            outer.extend(own)


def staged(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder, with the writer's ``options``, and read it back.

    A lost executor then costs a read, not the work before it, and joins on
    the result see the table's true size.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(**{"compression": "zstd"} | (options or {})).parquet(path)
    own = _SCOPE.get()
    if own is not None:
        own.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def drop(table: DataFrame) -> None:
    """Delete a staged table that nothing reads any more."""
    _remove(table.sparkSession, table._staged_path)
    own = _SCOPE.get()
    if own is not None and table._staged_path in own:
        own.remove(table._staged_path)


def settled(df: DataFrame, name: str, own: list[str]) -> DataFrame:
    """``staged``, after which the other tables of the scope ``own`` are deleted, as only ``df`` read them."""
    out = staged(df, name)
    for path in own:
        if path != out._staged_path:
            _remove(df.sparkSession, path)
    own[:] = [out._staged_path]
    free_shuffles(df.sparkSession)
    return out


def free_shuffles(spark: SparkSession) -> None:
    """Have the driver collect garbage: Spark deletes a shuffle's files on all executors once its plan is collected, which a large heap delays."""
    spark._jvm.System.gc()
