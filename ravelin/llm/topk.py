"""Exact top-k search by distributed histogram selection.

Vectors become whole numbers, so that inner products are exact.  For a block
of queries every pass scores all vectors and counts the scores of a range that
is narrowed to the bin that holds the k-th value, until the k-th score is
known.  Where more rows tie at that score than are wanted, the ids of the tied
rows are narrowed in the same way.  A last pass keeps what is above, so that
exactly k rows for each query are ranked.  A task reports only its highest
bins that hold k scores, since the k-th score overall isn't below its own.

A query block is of bounded size and reaches the tasks as a broadcast; vectors
are never shuffled.  The more queries a block has, the fewer bins each has in a
pass, so that a task's histograms stay of one size: eight times the queries take one
more pass, not eight times as many.  Whole-number vectors, the queries by block and each block's
result are written once, so that the last plan doesn't grow with the blocks.

Edge cases: vectors that are null or hold null or non-finite components, and
rows with a null id, take no part; a vector is scored against queries of its
own length only; an empty vector scores 0; a query's id on other rows: none of
them is its candidate, and of several query rows with one id the least vector
is taken; fewer than k candidates are all returned; repeated rows of another
id count each, and are ranked in any order; products are exact while scaled
sums stay below 2 ** 63; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ravelin.scratch import Scratch
from ravelin.sources.tables import table

K = 10
SCALE = 1024
EVERY = 100
#: Queries of a block, about; bins of a pass at most and at least; cells of a task's histograms, and scores that it works out at once.
BLOCK = 8192
BINS, FEWEST = 4096, 64
CELLS = 1 << 22


def whole_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and v (array of longs) of the rows that take part."""
    x = F.col("embedding")
    good = F.coalesce(F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))
    scaled = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("bigint"))
    return vectors.where(good & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("bigint").alias("vec_id"), scaled.alias("v"))


def _scored(state: dict, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Query rows, ids and exact scores of parts of a batch; the query's own id is marked by the least long."""
    ids, lists = batch.column(0).to_numpy(), batch.column(1)
    sizes, flat = pc.list_value_length(lists).to_numpy(zero_copy_only=False), pc.list_flatten(lists).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    for dim in np.unique(sizes):
        rows = np.flatnonzero(state["dims"] == dim)
        mine = np.flatnonzero(sizes == dim)
        if not len(rows) or not len(mine):
            continue
        q = np.array([state["v"][r] for r in rows], np.int64).reshape(len(rows), dim)
        for part in np.array_split(mine, -(-len(mine) // max(1, CELLS // len(rows)))):
            v = flat[(ends[part] - dim)[:, None] + np.arange(dim)].astype(np.int64).reshape(len(part), dim)
            bound = float(dim) * np.abs(v.astype(float)).max(initial=0) * np.abs(q.astype(float)).max(initial=0)
            score = (q.astype(float) @ v.T.astype(float)).astype(np.int64) if bound < 2**53 else q @ v.T
            score[state["ids"][rows][:, None] == ids[part][None, :]] = np.iinfo(np.int64).min
            yield rows, ids[part], score


def _count(vectors: DataFrame, state: dict, select: Callable, bins: int) -> DataFrame:
    """q, bin and number of what ``select`` picks: (picked, bin) from rows, ids and scores; the highest bins first."""
    shared = vectors.sparkSession.sparkContext.broadcast(state)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = shared.value
        total = np.zeros((len(state["ids"]), bins), np.int64)
        for batch in batches:
            for rows, ids, score in _scored(state, batch):
                picked, at = select(state, rows, ids, score)
                r, c = np.nonzero(picked)
                total += np.bincount(rows[r] * bins + at[r, c], minlength=total.size).reshape(total.shape)
        over = total[:, ::-1].cumsum(1)[:, ::-1] - total
        q, b = np.nonzero((total > 0) & (over < state["need"][:, None]))
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(b, pa.int32()), pa.array(total[q, b], pa.int64())], names=["q", "bin", "n"])

    return vectors.mapInArrow(run, "q int, bin int, n bigint").groupBy("q", "bin").agg(F.sum("n").alias("n"))


def _chosen(counted: DataFrame, need: np.ndarray) -> dict[int, tuple[int, int, int]]:
    """Of each query: the bin that holds the wanted rank, its number and the number above it (a row for each query)."""
    wanted = counted.sparkSession.createDataFrame([(i, int(n)) for i, n in enumerate(need)], "q int, need bigint")
    order = Window.partitionBy("q").orderBy(F.desc("bin"))
    upto = counted.withColumn("upto", F.sum("n").over(order)).join(F.broadcast(wanted), "q")  # at most BLOCK rows
    hit = upto.where((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("n") < F.col("need")))
    return {r["q"]: (r["bin"], r["n"], r["upto"] - r["n"]) for r in hit.collect()}


def _narrow(vectors: DataFrame, base: dict, low: np.ndarray, high: np.ndarray, need: np.ndarray, value: Callable, bins: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each query the range [low, high] that its wanted rank from above lies in, so narrow that it is one value or wanted whole.

    Returns low, the number wanted in the range, the number that is there, and
    whether there are fewer than wanted at all.  Queries that want none are left alone.
    """
    low, high, need = low.copy(), high.copy(), need.copy()
    live, there, few = need > 0, np.zeros(len(need), np.int64), np.zeros(len(need), bool)
    while live.any():
        width = np.array([(int(b) - int(a)) // bins + 1 for a, b in zip(low, high, strict=True)], np.int64)
        state = base | {"low": low, "high": high, "width": width, "need": np.where(live, need, 0)}

        def select(state: dict, rows: np.ndarray, ids: np.ndarray, score: np.ndarray):
            x, held = value(state, rows, ids, score)
            lo, hi = state["low"][rows][:, None], state["high"][rows][:, None]
            picked = held & (state["need"][rows] > 0)[:, None] & (x >= lo) & (x <= hi)
            return picked, (np.where(picked, x, lo) - lo) // state["width"][rows][:, None]

        found = _chosen(_count(vectors, state, select, bins), state["need"])
        low, high = low.copy(), high.copy()
        for q in np.flatnonzero(live):
            if q not in found:
                few[q], live[q] = True, False
                continue
            b, there[q], above = found[q]
            low[q] += b * width[q]
            high[q] = min(int(high[q]), int(low[q]) + int(width[q]) - 1)
            need[q] -= above
            live[q] = width[q] > 1 and there[q] > need[q]
    return low, need, there, few


def _by_score(state: dict, rows: np.ndarray, ids: np.ndarray, score: np.ndarray):
    return score, score > np.iinfo(np.int64).min


def _by_id(state: dict, rows: np.ndarray, ids: np.ndarray, score: np.ndarray):
    """Among the rows that tie at the k-th score, the smaller id is the higher value."""
    return np.broadcast_to(~ids, score.shape), score == state["tied"][rows][:, None]


def search_block(vectors: DataFrame, queries: list, k: int, longest: float, least_id: int, most_id: int, bins: int | None = None) -> DataFrame:
    """query_id, vec_id, score of the best of one block of queries (rows of vec_id and v), by ``bins`` bins in a pass (None: by the number of queries)."""
    bins = bins or max(FEWEST, min(BINS, CELLS // len(queries)))
    base = {"ids": np.array([r["vec_id"] for r in queries], np.int64), "v": [r["v"] for r in queries], "dims": np.array([len(r["v"]) for r in queries])}
    norms = np.array([np.sqrt(np.square(np.array(v, float)).sum()) for v in base["v"]])
    top = np.minimum(np.ceil(norms * longest * (1 + 1e-9)) + 1, 2.0**61).astype(np.int64)
    low, need, there, few = _narrow(vectors, base, -top, top, np.full(len(queries), k, np.int64), _by_score, bins)
    least = np.where(few, np.iinfo(np.int64).min + 1, low)
    tied = ~few & (there > need)
    ends = [np.full(len(queries), ~x, np.int64) for x in (most_id, least_id)]
    last = _narrow(vectors, base | {"tied": low}, *ends, np.where(tied, need, 0), _by_id, bins)[0]
    upto = np.where(tied, ~last, np.iinfo(np.int64).max)
    shared = vectors.sparkSession.sparkContext.broadcast(base | {"least": least, "upto": upto})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = shared.value
        for batch in batches:
            for rows, ids, score in _scored(state, batch):
                edge = state["least"][rows][:, None]
                r, c = np.nonzero((score > edge) | ((score == edge) & (ids[None, :] <= state["upto"][rows][:, None])))
                yield pa.RecordBatch.from_arrays([pa.array(state["ids"][rows[r]]), pa.array(ids[c]), pa.array(score[r, c])], names=["query_id", "vec_id", "score"])

    return vectors.mapInArrow(run, "query_id bigint, vec_id bigint, score bigint")


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score of the k best of every query (rows whose id is divisible by ``every``)."""
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession)
    whole = scratch.table(whole_vectors(vectors, scale), "vectors")
    square = F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c)
    ends = whole.agg(F.max(F.sqrt(square)), F.min("vec_id"), F.max("vec_id"), F.sum((F.col("vec_id") % every == 0).cast("bigint"))).first()
    blocks = -(-(ends[3] or 0) // block)
    asked = whole.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(max(blocks, 1))).cast("int"))
    asked.repartition("block").write.partitionBy("block").parquet(f"{scratch.root}/queries")
    queries = spark.read.schema(asked.schema).parquet(f"{scratch.root}/queries")
    for b in range(blocks):
        mine = queries.where(F.col("block") == b).collect()  # about ``block`` rows
        if mine:
            found = search_block(whole, mine, k, *ends[:3])
            found.write.parquet(f"{scratch.root}/found/block={b}")
    if not blocks:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    out = spark.read.schema("query_id bigint, vec_id bigint, score bigint").parquet(f"{scratch.root}/found")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = out.withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_histogram_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


ORACLE = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % {EVERY} = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= {K}
"""
