"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark's own setting by which a query's shuffle files go when it ends; a staged table's are of no use once it is written.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_open = threading.local()


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a temporary folder that this process removes; on a cluster, where only one machine would see it, an error."""
    base = spark.conf.get("spark.checkpoint.dir", "")
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = os.environ.get("TIDEWELL_STAGES") or ""
        if not base:
            base = os.environ["TIDEWELL_STAGES"] = tempfile.mkdtemp(prefix="tidewell-")
            atexit.register(shutil.rmtree, base, True)
    return base.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder as Parquet and read again: lineage ends here, nothing upstream runs twice."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stages/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    if scopes := getattr(_open, "scopes", None):
        scopes[-1].tables[path] = out
    return out


def discard(*tables: DataFrame | None) -> None:
    """Deletes staged tables that nothing will read again; other tables and None are left alone."""
    for df in tables:
        path = getattr(df, "_staged_at", None)
        if path:
            _delete(df, path)
            for scope in getattr(_open, "scopes", None) or ():
                scope.tables.pop(path, None)


def _delete(df: DataFrame, path: str) -> None:
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class Scope:
    """Tables staged within a block, and those of them that outlive it."""

    def __init__(self) -> None:
        self.tables: dict[str, DataFrame] = {}
        self.kept: set[str] = set()

    def keep(self, df: DataFrame) -> DataFrame:
        """df stays after the block; an enclosing block, if any, deletes it at its own end."""
        self.kept.add(df._staged_at)
        return df


@contextmanager
def scratch() -> Iterator[Scope]:
    """Tables staged within the block are deleted at its end, but for those that it keeps."""
    if not hasattr(_open, "scopes"):
        _open.scopes = []
    scope = Scope()
    _open.scopes.append(scope)
    try:
        yield scope
    finally:
        _open.scopes.pop()
        for path, df in scope.tables.items():
            if path not in scope.kept:
                _delete(df, path)
            elif _open.scopes:
                _open.scopes[-1].tables[path] = df
