"""Exact nearest vectors: matrix products in Arrow batches, a bounded number of hits from each task."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ravelin.scratch import Scratch
from ravelin.sources.tables import spread

#: Queries that are broadcast at once; more are taken in blocks of about so many.
BLOCK = 10_000
#: Distances that are worked out at once, and hits that a task holds before it keeps the best of each query.
CELLS, HELD = 1 << 22, 1 << 20


def matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and vectors of the rows that have ``dim`` finite numbers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(sizes == dim)
    values = pc.list_flatten(column.take(pa.array(at))).to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), dim)
    good = np.isfinite(values).all(1)  # nulls have become nan
    return at[good], values[good]


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows of ``a`` and rows of ``b``, up to rounding."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T), 0)


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of pairs of rows, summed in order and rounded to nine digits."""
    out = np.empty(len(a))
    for k in range(0, len(a), 65_536):
        step = slice(k, k + 65_536)
        out[step] = np.round(np.cumsum((a[step] - b[step]) ** 2, 1)[:, -1] if a.shape[1] else 0.0, 9)
    return out


def best_of(table: pa.Table, most: int, by: str) -> pa.Table:
    """Of each query (q) the rows with the least (score, by), nulls of ``by`` first."""
    table = table.take(pc.sort_indices(table, sort_keys=[("q", "ascending"), ("score", "ascending"), (by, "ascending")], null_placement="at_start"))
    q = table.column("q").to_numpy()
    starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.empty(0, np.int64)
    place = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
    return table.filter(pa.array(place < most))


def _hits(vectors: DataFrame, ids: np.ndarray, asked: np.ndarray, most: int, by: str) -> DataFrame:
    """q, score and the columns of ``vectors`` but v: each task's best of every query."""
    shared = vectors.sparkSession.sparkContext.broadcast((ids, asked))
    rest = [c for c in vectors.columns if c != "v"]
    place = vectors.columns.index("v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, asked = shared.value
        dim, norms = asked.shape[1], (asked * asked).sum(1)
        bound = np.full(len(ids), np.inf)  # the worst score of each query that can still count
        held: list[pa.Table] = []
        rows = max(1, CELLS // max(1, len(ids)))

        def kept() -> list[pa.Table]:
            table = best_of(pa.concat_tables(held), most, by)
            q, score = (table.column(c).to_numpy() for c in ("q", "score"))
            n = np.bincount(q, minlength=len(ids))
            last = np.cumsum(n) - 1
            full = n >= most
            bound[full] = score[last[full]]
            return [table]

        for batch in batches:
            at, values = matrix(batch.column(place), dim)
            plain = pa.Table.from_batches([batch]).drop_columns(["v"])
            for k in range(0, len(at), rows):
                part, where = values[k : k + rows], at[k : k + rows]
                far = squared(part, asked)
                limit = bound
                if len(part) > most:
                    limit = np.minimum(bound, np.partition(far, most - 1, 0)[most - 1])
                slack = 1e-9 * (1 + norms + (part * part).sum(1).max(initial=0))
                r, q = np.nonzero(far <= limit + slack)
                if len(r):
                    found = plain.take(pa.array(where[r]))
                    held.append(found.append_column("q", pa.array(q.astype(np.int64))).append_column("score", pa.array(exact(part[r], asked[q]))))
                if sum(t.num_rows for t in held) > HELD:
                    held = kept()
        if held:
            table = kept()[0]
            yield from table.set_column(table.schema.get_field_index("q"), "q", pa.array(ids[table.column("q").to_numpy()])).combine_chunks().to_batches()

    schema = ", ".join(f"`{c}` {vectors.schema[c].dataType.simpleString()}" for c in rest)
    return vectors.mapInArrow(run, f"{schema}, q bigint, score double")


def nearest(queries: DataFrame, vectors: DataFrame, k: int | None = None, by: str = "id", block: int = BLOCK) -> DataFrame:
    """q_id, the columns of ``vectors`` but v, score (squared distance, nine digits) and rank of the best of each query.

    ``queries`` has q_id, qv and, where k is None, top_k.  Ties go to the smaller
    ``by``.  Vectors are never shuffled, but to deal few parts over all cores; a
    task keeps its best of each query of a block, as many as the largest top_k,
    and only these are ranked.  A vector counts for the queries of its dimension
    alone; null vectors and those with components that aren't finite for none.
    """
    scratch, found = Scratch(queries.sparkSession), []
    numbered = queries.withColumn("q", F.monotonically_increasing_id())
    asked = scratch.table(numbered if k is None else numbered.withColumn("top_k", F.lit(k)), "asked")
    sizes = asked.groupBy(F.size("qv").alias("dim")).agg(F.count("*").alias("n"), F.max("top_k").alias("most")).where("dim >= 0").collect()
    vectors = spread(vectors)
    for dim, n, most in sorted(sizes):
        blocks = max(1, -(-n // block))
        for b in range(blocks):
            mine = asked.where((F.size("qv") == dim) & (F.pmod(F.xxhash64("q"), F.lit(blocks)) == b))
            held = mine.select("q", "qv").toArrow()  # a block
            at, values = matrix(held.column("qv"), dim)
            if not len(at):
                continue
            hits = _hits(vectors, held.column("q").to_numpy()[at], values, max(1, int(most or 1)), by)
            ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("score", by))).where(F.col("rank") <= int(most or 1))
            found.append(ranked if blocks == 1 and len(sizes) == 1 else scratch.table(ranked, f"block-{dim}-{b}"))
    if not found:
        bare = vectors.select(*(c for c in vectors.columns if c != "v"), F.lit(0).cast("bigint").alias("q"), F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
        found.append(bare)
    met = reduce(DataFrame.unionByName, found).join(asked.select("q", "q_id", "top_k"), "q")
    return met.where(F.col("rank") <= F.col("top_k")).drop("q", "top_k")
