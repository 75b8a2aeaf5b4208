"""Multi-party perspective rotation of dialogues.

For every participant of a conversation the whole dialogue is rendered once
with that speaker as the assistant and the others as named users.  The result
has one row for each conversation, perspective and turn: the rendered segment,
its place in the rendered dialogue, and the span of it that is trained on (the
assistant's words and end mark).  Segments in order of ``position`` make up
the dialogue; no conversation is ever gathered in one row or task.

Places are prefix sums in two steps: the turns are range-partitioned and
written, each part of a conversation is summed by itself, and the totals of
its parts are summed before them.

Edge cases: a null role speaks as ``unknown``, a null text as an empty one; a
null turn comes first; ties of turn are ordered by role, then text; repeated
rows are separate turns; rows with a null conv_id are one conversation with a
null id; turns of ``system_roles`` are shown in every perspective and have no
perspective of their own, so a conversation of such turns alone gives no rows;
an empty table gives an empty result; other columns are ignored; very long
texts are segments of their own and never joined.  Names and texts are written
as they are: ones that hold the marks (``<|..|>``) can't be told from markup by
reading the rendered string alone, so training takes its spans from the columns
start, length, mask_start and mask_length, which are right for any text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ravelin.scratch import Scratch
from ravelin.sources.tables import table

SYSTEM = ("system",)
END = "<|end|>"


def rotate(turns: DataFrame, system_roles: tuple[str, ...] = SYSTEM, end: str = END) -> DataFrame:
    """conv_id, perspective, position, speaker, role, name, segment, start, length, mask, mask_start, mask_length."""
    scratch = Scratch(turns.sparkSession)
    speaker = F.coalesce("role", F.lit("unknown"))
    rows = turns.select("conv_id", "turn", speaker.alias("speaker"), F.coalesce("text", F.lit("")).alias("text"))
    order = ["conv_id", "turn", "speaker", "text"]
    dealt = rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    dealt = scratch.table(dealt, "turns")
    people = dealt.where(~F.col("speaker").isin(*system_roles)).select(F.col("conv_id").alias("_conv"), F.col("speaker").alias("perspective")).distinct()
    people = scratch.table(people, "people")
    shown = dealt.join(people, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    own = F.col("speaker") == F.col("perspective")
    role = F.when(F.col("speaker").isin(*system_roles), "system").when(own, "assistant").otherwise("user")
    shown = shown.withColumn("role", role).withColumn("name", F.when(F.col("role") == "user", F.col("speaker")))
    head = F.concat(F.lit("<|"), "role", F.coalesce(F.concat(F.lit(" name="), "name"), F.lit("")), F.lit("|>\n"))
    shown = shown.withColumn("head", head).withColumn("segment", F.concat("head", "text", F.lit(f"{end}\n"))).withColumn("length", F.char_length("segment").cast("bigint"))

    parts = shown.groupBy("conv_id", "perspective", "part").agg(F.count("*").alias("n"), F.sum("length").alias("chars"))
    before = Window.partitionBy("conv_id", "perspective").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        F.col("conv_id").alias("_conv"),
        F.col("perspective").alias("_perspective"),
        F.col("part").alias("_part"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"),
        F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("chars_before"),
    )
    inside = Window.partitionBy("conv_id", "perspective", "part").orderBy("turn", "speaker", "text")
    shown = shown.withColumn("k", F.row_number().over(inside) - 1).withColumn("c", F.sum("length").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length"))
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("perspective") == F.col("_perspective")) & (F.col("part") == F.col("_part"))
    placed = shown.join(parts, same)
    trained = F.col("role") == "assistant"
    start = F.col("c") + F.col("chars_before")
    return placed.select(
        "conv_id",
        "perspective",
        (F.col("k") + F.col("n_before")).cast("bigint").alias("position"),
        "speaker",
        "role",
        "name",
        "segment",
        start.alias("start"),
        "length",
        trained.alias("mask"),
        F.when(trained, start + F.char_length("head")).alias("mask_start"),
        F.when(trained, F.char_length("text") + len(end)).otherwise(0).cast("bigint").alias("mask_length"),
    )


def op1_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate(table(spark, sf_dir, "conversations"))


ORACLE = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text FROM conversations),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'),
s AS (SELECT t.*, p.perspective,
             CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS role
      FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
h AS (SELECT *, CASE WHEN role = 'user' THEN speaker END AS name, '<|' || role || CASE WHEN role = 'user' THEN ' name=' || speaker ELSE '' END || '|>' || chr(10) AS head FROM s),
g AS (SELECT *, head || text || '{END}' || chr(10) AS segment FROM h),
o AS (SELECT *, row_number() OVER w - 1 AS position, sum(length(segment)) OVER (w ROWS UNBOUNDED PRECEDING) - length(segment) AS start
      FROM g WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, text))
SELECT conv_id, perspective, CAST(position AS BIGINT) AS position, speaker, role, name, segment, CAST(start AS BIGINT) AS start,
       CAST(length(segment) AS BIGINT) AS length, role = 'assistant' AS mask,
       CASE WHEN role = 'assistant' THEN CAST(start + length(head) AS BIGINT) END AS mask_start,
       CAST(CASE WHEN role = 'assistant' THEN length(text) + {len(END)} ELSE 0 END AS BIGINT) AS mask_length
FROM o
"""
