"""Parquet tables of a data folder, read through Spark only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ravelin.scratch import file_system


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """``<folder>/<name>.parquet`` on any file system Spark knows."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over as many tasks as the cluster runs at once, if its scan has fewer (small files are a single task); large scans are left alone."""
    tasks = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df


def listing(spark: SparkSession, folder: str) -> tuple[str, ...]:
    """Names, sizes and times of the files of a data folder's tables: another listing means other data."""
    at, fs = file_system(spark, folder.rstrip("/"))
    tables = [s for s in fs.listStatus(at) if s.getPath().getName().endswith(".parquet")]
    files = [f for s in tables for f in (fs.listStatus(s.getPath()) if s.isDirectory() else [s])]
    return tuple(sorted(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}" for f in files))
