"""What a reader asked and was told."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def recent_questions(turns: DataFrame, most: int = 5) -> DataFrame:
    """conv_id, question and place of the last distinct questions of each conversation, newest first."""
    asked = turns.where("role = 'user'").select("conv_id", "turn", F.trim("text").alias("question")).where("question <> ''")
    last = asked.groupBy("conv_id", "question").agg(F.max("turn").alias("turn"))
    order = Window.partitionBy("conv_id").orderBy(F.desc("turn"), "question")
    return last.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def last_answers(turns: DataFrame) -> DataFrame:
    """conv_id and text of the last assistant turn of each conversation."""
    return turns.where("role = 'assistant'").groupBy("conv_id").agg(F.max_by("text", F.struct("turn", "text")).alias("text"))
