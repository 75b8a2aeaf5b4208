"""Places and running totals within groups of any size, without a task for each group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ravelin.scratch import Scratch


def running(rows: DataFrame, by: list[str], order: list[str], amount: str | None = None, most: int | None = None) -> DataFrame:
    """``rows`` with n (the place in its group, from 1) and, of an ``amount``, total (its sum up to the row); with ``most`` only the first of each group.

    ``by`` has no nulls, and ``order`` tells all rows of a group apart.  Rows are sorted over parts of
    even size; each part numbers and adds up its own, and what a group has in
    the parts before is added, so that a large group is many tasks.  Parts that
    begin after the ``most`` first rows of a group are left out at once.
    """
    scratch = Scratch(rows.sparkSession)
    dealt = scratch.table(rows.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()), "dealt")
    value = F.col(amount) if amount else F.lit(0)
    past = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy(*by, "_part").agg(F.count("*").alias("_n"), F.sum(value).alias("_sum"))
    sums = sums.select(*by, "_part", F.coalesce(F.sum("_n").over(past), F.lit(0)).alias("_n"), F.coalesce(F.sum("_sum").over(past), F.lit(0)).alias("_sum"))
    if most is not None:
        sums = sums.where(F.col("_n") < most)
    inside = Window.partitionBy(*by, "_part").orderBy(*order)
    met = dealt.join(sums, [*by, "_part"]).withColumn("n", F.col("_n") + F.row_number().over(inside))
    if amount:
        met = met.withColumn("total", F.col("_sum") + F.sum(value).over(inside))
    met = met.drop("_part", "_n", "_sum")
    return met if most is None else met.where(F.col("n") <= most)
