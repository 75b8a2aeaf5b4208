"""Written intermediate tables in the folder that the whole cluster shares.

A stage that several later stages read, or that ends an iteration, is written
as Parquet and read back: lineage is cut, nothing expensive runs twice, and a
lost executor only costs the tasks that read the files again.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")
_KEY = "spark.checkpoint.dir"
_LOCAL: dict[str, str] = {}
#: Spark's setting by which a query's shuffles are deleted with its end, not when the driver collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset, a temporary one of this machine if Spark runs on it alone (tests)."""
    named = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"{_KEY} must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="spark-ravelin-", dir="/tmp")
    return "file://" + _LOCAL[app]


def file_system(spark: SparkSession, name: str):
    """A path, and the file system that it lies in."""
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def together(spark: SparkSession, *steps: Callable[[], T]) -> list[T]:
    """The results of a few steps that don't need each other, whose jobs share the cluster; an error of one is raised when all have ended."""
    with ThreadPoolExecutor(len(steps)) as pool:
        made = [pool.submit(inheritable_thread_target(spark)(step)) for step in steps]
    return [one.result() for one in made]


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffles of the queries that are run inside don't outlive them."""
    was = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if was is None else spark.conf.set(_CLEANUP, was)


class Scratch:
    """A folder of written tables that belong to one call of an operator."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
        path, fs = file_system(spark, self.root)
        fs.deleteOnExit(path)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return the written table."""
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Delete a table that nothing reads any more."""
        path, fs = file_system(self.spark, f"{self.root}/{name}".rstrip("/"))
        fs.delete(path, True)

    def clear(self) -> None:
        """Delete all tables."""
        self.drop("")
