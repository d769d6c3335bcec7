"""The shared folder for intermediate tables, and small helpers that several operators use."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session; where it is unset, on a local master only (tests), a new one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.getCheckpointDir() is None:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


_collecting: ContextVar[list[str] | None] = ContextVar("collecting", default=None)


@contextmanager
def tables() -> Iterator[list[str]]:
    """Collects the paths of the tables that `cut` writes inside; `delete` them once the result made from them is written."""
    paths: list[str] = []
    token = _collecting.set(paths)
    try:
        yield paths
    finally:
        _collecting.reset(token)


def cut(df: DataFrame, by: str | None = None, compression: str = "snappy") -> DataFrame:
    """Write df as a table in the shared folder and read it again: lineage ends there, and a lost executor loses nothing.

    With `by` the table is in folders by that column. It stays until its user deletes it (see `tables`).
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).option("compression", compression).parquet(path)
    if (paths := _collecting.get()) is not None:
        paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, paths: list[str]) -> None:
    jvm = spark.sparkContext._jvm
    while paths:
        path = jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))
