"""Cutting lineage through storage that every executor can read."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
#: Folder within the application's, in which tables are written now.
_FOLDER: ContextVar[str] = ContextVar("folder", default="")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where the session leaves that setting unset, a local session takes a
    temporary folder; on a cluster, whose machines don't share one, it is a
    folder in the warehouse. The choice is written back to the session.
    """
    base = spark.conf.get(_SETTING, None)
    if not base:
        if spark.sparkContext.master.startswith("local"):
            base = "file://" + tempfile.mkdtemp(prefix="quern-checkpoint-")
        else:
            base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_quern_scratch"
        spark.conf.set(_SETTING, base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder, grouped by application."""
    app = spark.sparkContext.applicationId
    return f"{shared_dir(spark)}/{app}/{_FOLDER.get()}{label}-{uuid.uuid4().hex}"


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextlib.contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables that ``materialize`` writes within are deleted at the end: what they gave must be written elsewhere by then."""
    folder = f"{_FOLDER.get()}passing-{uuid.uuid4().hex}/"
    held = _FOLDER.set(folder)
    try:
        yield
    finally:
        _FOLDER.reset(held)
        _delete(spark, f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{folder}")


def materialize(df: DataFrame, label: str = "table", path: str | None = None) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder, or at ``path``, and read it back.

    The result has no lineage before the files, so a lost executor costs a
    re-read and not a recomputation, and random or unordered steps upstream
    are frozen.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession) -> None:
    """Delete everything this application materialized."""
    _delete(spark, f"{shared_dir(spark)}/{spark.sparkContext.applicationId}")
