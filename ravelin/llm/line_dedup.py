"""Line deduplication over overlapping windows of three consecutive lines.

Every window is hashed; the first occurrence of a window over the whole table,
by (doc_id, position), stays and every later one is removed.  A line goes if
any removed window covers it.  The first place of each hash comes from a
grouped minimum with partial aggregation, so a very common window costs one
row for each task.  First places are then gathered by document; what a
document has besides them are later occurrences.

Edge cases: lines end at a line feed only and are compared as they are; a text
of fewer than ``size`` lines has no window and stays; a null text stays null
and has no lines; an empty text is one empty line; a null doc_id comes last;
rows that repeat doc_id and text are one document and get the same result;
an empty table gives an empty result; other columns are kept as they are; very
long texts and lines are compared whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.llm.common import digest
from ravelin.sources.tables import table

SIZE = 3


def dedup_lines(docs: DataFrame, size: int = SIZE, counts: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """``docs`` with ``text`` without the removed lines, and the numbers of lines and removed lines under the names ``counts`` (which replace columns of these names)."""
    lines = F.split("text", "\n", -1)
    # the id's place in the order goes through hashes as they are compared: nulls last
    keys = digest(F.col("doc_id").isNull(), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text"))
    spread = docs.where("text is not null").select("doc_id", *keys, lines.alias("lines")).where(F.size("lines") >= size)
    at = spread.select("doc_id", "k1", "k2", "lines", F.posexplode("lines").alias("i", "line"))
    own = [F.get("lines", F.col("i") + x) for x in range(size)]
    at = at.where(F.col("i") + size <= F.size("lines")).select("doc_id", "k1", "k2", "i", F.xxhash64(*own).alias("w1"), F.xxhash64(F.lit("second"), *own).alias("w2"))
    place = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id"), F.col("k1"), F.col("k2"), F.col("i"))
    first = at.groupBy("w1", "w2").agg(F.min(place).alias("at"))
    first = first.groupBy("at.k1", "at.k2").agg(F.collect_list("at.i").alias("first"))

    left = docs.select(*(F.col(c).alias(f"_{x}") for x, c in enumerate(docs.columns)), *keys)
    text = f"_{docs.columns.index('text')}"
    joined = left.join(first, ["k1", "k2"], "left").withColumn("lines", F.split(text, "\n", -1))
    n = F.size("lines")
    windows = F.when(n >= size, F.sequence(F.lit(0), n - size)).otherwise(F.array().cast("array<int>"))
    later = F.array_except(windows, F.coalesce("first", F.array().cast("array<int>")))
    covered = F.flatten(F.transform(later, lambda i: F.array(*(i + x for x in range(size)))))
    judged = joined.withColumn("covered", F.array_distinct(covered)).withColumn("kept", F.array_except(F.sequence(F.lit(0), n - 1), F.col("covered")))
    removed = F.size("covered")
    out = F.when(removed > 0, F.array_join(F.transform("kept", lambda i: F.get("lines", i)), "\n")).otherwise(F.col(text))
    names = [c for c in docs.columns if c not in counts]
    cols = [out.alias(c) if c == "text" else F.col(f"_{docs.columns.index(c)}").alias(c) for c in names]
    numbers = [F.when(F.col("lines").isNull(), 0).otherwise(x).cast("bigint").alias(c) for x, c in zip((n, removed), counts, strict=True)]
    return judged.select(*cols, *numbers)


def drop_repeated_lines(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """``docs`` with its own columns alone, without the removed lines and without documents of which no line is left."""
    free = "n"
    while any(c.startswith(free) for c in docs.columns):
        free += "_"
    made = dedup_lines(docs, size, (f"{free}lines", f"{free}removed"))
    return made.where((F.col(f"{free}removed") < F.col(f"{free}lines")) | (F.col(f"{free}removed") == 0)).select(*docs.columns)


def op4_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return dedup_lines(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", "text")


ORACLE = f"""
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - {SIZE - 2})) AS i FROM l WHERE len(w) >= {SIZE}),
s AS (SELECT doc_id, i, array_to_string(w[i:i + {SIZE - 1}], chr(10)) AS s FROM p),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM s),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + {SIZE})) AS i FROM r WHERE k > 1),
a AS (SELECT doc_id, unnest(w) AS line, unnest(range(1, len(w) + 1)) AS i FROM l),
k AS (SELECT a.doc_id, count(*) FILTER (WHERE c.i IS NOT NULL) AS n_removed, count(*) AS n_lines,
             coalesce(string_agg(a.line, chr(10) ORDER BY a.i) FILTER (WHERE c.i IS NULL), '') AS kept
      FROM a LEFT JOIN c USING (doc_id, i) GROUP BY a.doc_id)
SELECT l.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CASE WHEN l.text IS NULL THEN NULL ELSE kept END AS text
FROM l LEFT JOIN k USING (doc_id)
"""
