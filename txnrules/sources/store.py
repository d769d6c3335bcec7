"""Tables that several queries of a session read, written once for each state of their input."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}
_written: dict[tuple, str] = {}


def shared_folder(spark: SparkSession) -> str | None:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, on a local master only, a new folder that goes with the process; else None."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        return None
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        atexit.register(shutil.rmtree, _local[app], ignore_errors=True)
    return _local[app]


def state_of(spark: SparkSession, paths: list[str]) -> tuple:
    """What changes when files under the paths change: their number, their bytes and the time of the last change."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found = []
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        fs = path.getFileSystem(conf)
        summary = fs.getContentSummary(path)
        found.append((p, summary.getFileCount(), summary.getLength(), fs.getFileStatus(path).getModificationTime()))
    return tuple(found)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is run inside leaves no shuffle files: Spark removes them when a query ends, not when the driver happens to collect garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def folder_once(spark: SparkSession, name: str, paths: list[str], write: Callable[[str], None]) -> str | None:
    """A folder that `write` has filled from the tables at `paths`: once a session, and anew if they have changed. None where no folder is shared."""
    base = shared_folder(spark)
    if base is None:
        return None
    key = (spark.sparkContext.applicationId, base, name, state_of(spark, paths))
    if key not in _written:
        folder = f"{base}/{name}-{uuid.uuid4().hex}"
        with shuffles_removed(spark):
            write(folder)
        _written[key] = folder
    return _written[key]


def table_once(spark: SparkSession, name: str, paths: list[str], build: Callable[[], DataFrame], by: str | None = None) -> DataFrame:
    """The DataFrame that `build` makes from the tables at `paths`, written once and read back. By a column `by` it is written in folders of evened-out files, for which all rows are shuffled."""
    made = build()
    folder = folder_once(spark, name, paths, lambda f: (made.hint("rebalance", by).write.partitionBy(by) if by else made.write).option("compression", "zstd").parquet(f))
    return spark.read.schema(made.schema).parquet(folder) if folder else made
