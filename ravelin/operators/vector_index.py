"""An inverted file with product-quantised codes: approximate nearest vectors without reading all of them.

The centres of the cells and the codebooks are fitted in numpy on a bounded
sample; every vector is then given its nearest cell and a code of its
difference from the centre, a byte for each four dimensions.  A search takes for each
query the ``probes`` nearest cells, meets their codes by an equi-join on the
cell, keeps the ``refine`` x k best by the codes, and ranks these by their exact
distances.  How many cells and candidates that takes depends on the data (on
vectors without clusters it is a good part of them): the model tries rows of
its sample as queries and takes as many as miss few of their nearest.  Cells
are dealt in parts of bounded size, and the queries of a cell in blocks, so
that a cell that holds a large share of the rows, or is asked for by all
queries, is no single task's.

A vector of another dimension, without numbers or null isn't indexed and never
found.  ``nearest.nearest`` is the exact way.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ravelin.functions.vectors import squared_distance
from ravelin.operators.nearest import matrix, squared
from ravelin.scratch import Scratch

#: Rows that the cells and the codes are fitted on at most, cells at most, dimensions of a code's byte, and rounds of k-means.
SAMPLE, CODED, CELLS, WIDTH, ROUNDS = 65_536, 16_384, 4096, 4, 8
#: Codes and queries that meet in one group at most (about; they are dealt by hashes).
PART, QUERIES = 50_000, 1000
#: Sampled rows that stand for queries, nearest of each, and the share of these that cells and codes may miss by the sample.
TRIED, NEAR, MISSED = 256, 10, 0.02


def kmeans(rows: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Centres of k groups; a group that loses all its rows takes a row of the largest."""
    rng = np.random.default_rng(seed)
    centres = rows[rng.permutation(len(rows))[:k]].copy()
    for _ in range(ROUNDS):
        group = closest(rows, centres)
        n = np.bincount(group, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, group, rows)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        for empty in np.flatnonzero(n == 0):
            centres[empty] = rows[rng.choice(np.flatnonzero(group == n.argmax()))]
    return centres


def closest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row."""
    step = max(1, (1 << 22) // len(centres))
    return np.concatenate([squared(rows[k : k + step], centres).argmin(1) for k in range(0, len(rows), step)]) if len(rows) else np.empty(0, np.int64)


@dataclass(frozen=True)
class Model:
    """Centres of the cells, for each stretch of ``WIDTH`` dimensions the values that a byte stands for, and the cells and candidates for each hit that searches take."""

    centres: np.ndarray
    books: np.ndarray
    probes: int = 1
    refine: int = 1

    @property
    def dim(self) -> int:
        return self.centres.shape[1]

    def padded(self, rows: np.ndarray) -> np.ndarray:
        """Rows by stretches of dimensions, the last one filled up with zeros."""
        room = len(self.books) * WIDTH - rows.shape[1]
        return np.pad(rows, ((0, 0), (0, room))).reshape(len(rows), len(self.books), WIDTH)

    def coded(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell and code of each row."""
        cell = closest(rows, self.centres)
        rest = self.padded(rows - self.centres[cell])
        code = np.stack([closest(rest[:, s], book) for s, book in enumerate(self.books)], 1) if len(rows) else np.empty((0, len(self.books)))
        return cell, code.astype(np.uint8)

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, centres=self.centres, books=self.books, sizes=np.array([self.probes, self.refine]))
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> Model:
        with np.load(io.BytesIO(data)) as held:
            return cls(held["centres"], held["books"], *map(int, held["sizes"]))


def fit(vectors: DataFrame, dim: int, by: str = "id", sample: int = SAMPLE) -> Model:
    """A model of the vectors (``by``, v) of a dimension, fitted on about ``sample`` of them at most, which a hash of ``by`` picks."""
    rows = vectors.where(F.size("v") == dim)
    n = rows.count()
    share = max(1, n // sample)
    held = rows.where(F.pmod(F.xxhash64(by), F.lit(share)) == 0).select("v").limit(2 * sample).toArrow()
    found = matrix(held.column("v"), dim)[1]
    if not len(found):
        found = np.zeros((1, dim))
    centres = kmeans(found, min(CELLS, len(found), max(1, round(2 * n**0.5))))
    stretches = -(-dim // WIDTH)
    bare = Model(centres, np.zeros((stretches, 1, WIDTH)))
    some = found[:CODED]
    rest = bare.padded(some - centres[closest(some, centres)])
    books = np.stack([kmeans(rest[:, s], min(256, len(some)), s) for s in range(stretches)])
    return tuned(Model(centres, books), found, n)


def tuned(model: Model, rows: np.ndarray, n: int) -> Model:
    """The model with as many probes and candidates as the sample ``rows`` of n vectors asks for."""
    asked = rows[:: max(1, len(rows) // TRIED)][:TRIED]
    near = np.argsort(squared(asked, rows), 1, kind="stable")[:, :NEAR]
    cell, code = model.coded(rows)
    # how many cells are nearer than that of each near row
    far = squared(asked, model.centres)
    place = (far[:, None, :] < np.take_along_axis(far, cell[near], 1)[:, :, None]).sum(2)
    probes = int(np.quantile(place, 1 - MISSED)) + 1
    # how many rows their codes put before each near row; a sample stands for n / len(rows) as many
    known = model.centres[cell] + model.books[np.arange(len(model.books)), code].reshape(len(rows), -1)[:, : model.dim]
    guess = squared(asked, known)
    before = [(g < g[own][:, None]).sum(1) for g, own in zip(guess, near, strict=True)]
    refine = int(np.quantile(before, 1 - MISSED) * max(1, n / len(rows)) / NEAR) + 2
    return Model(model.centres, model.books, min(probes, len(model.centres)), refine)


def codes(vectors: DataFrame, model: Model) -> DataFrame:
    """The columns of ``vectors`` but v, with cell and code."""
    shared = vectors.sparkSession.sparkContext.broadcast(model)
    rest, place = [c for c in vectors.columns if c != "v"], vectors.columns.index("v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, values = matrix(batch.column(place), shared.value.dim)
            cell, code = shared.value.coded(values)
            plain = pa.Table.from_batches([batch]).drop_columns(["v"]).take(pa.array(at))
            yield from plain.append_column("cell", pa.array(cell, pa.int32())).append_column("code", pa.array([c.tobytes() for c in code], pa.binary())).combine_chunks().to_batches()

    schema = ", ".join(f"`{c}` {vectors.schema[c].dataType.simpleString()}" for c in rest)
    return vectors.mapInArrow(run, f"{schema}, cell int, code binary")


def _probes(asked: DataFrame, model: Model, probes: int) -> DataFrame:
    """q, qv and cell: the nearest cells of each query."""
    shared = asked.sparkSession.sparkContext.broadcast(model.centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, values = matrix(batch.column(1), shared.value.shape[1])
            near = np.argpartition(squared(values, shared.value), probes - 1, 1)[:, :probes] if len(at) else np.empty((0, probes), np.int64)
            rows = pa.array(np.repeat(at, near.shape[1]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(near.ravel(), pa.int32())], names=["q", "qv", "cell"])

    return asked.select("q", F.col("qv").cast("array<double>").alias("qv")).mapInArrow(run, "q bigint, qv array<double>, cell int")


def search(queries: DataFrame, vectors: DataFrame, coded: DataFrame, model: Model, k: int | None = None, by: str = "id", probes: int | None = None, refine: int | None = None) -> DataFrame:
    """As ``nearest``, of the vectors whose cells a query looks into: q_id, the columns of ``vectors`` but v, score and rank.

    ``coded`` holds ``by``, cell and code of the vectors; ``by`` is their key.
    """
    spark, scratch = queries.sparkSession, Scratch(queries.sparkSession)
    cells = len(model.centres)
    probes = min(cells, probes or model.probes)
    numbered = queries.withColumn("q", F.monotonically_increasing_id())
    asked = scratch.table(numbered if k is None else numbered.withColumn("top_k", F.lit(k)), "asked")
    most = int(asked.agg(F.max("top_k")).first()[0] or 1) * (refine or model.refine)
    looked = scratch.table(_probes(asked, model, probes), "looked")
    # parts of each cell and blocks of its queries, a number for each cell
    parts, blocks = np.ones(cells, np.int64), np.ones(cells, np.int64)
    for out, rows, size in ((parts, coded, PART), (blocks, looked, QUERIES)):
        for r in rows.groupBy("cell").agg(F.count("*").alias("n")).collect():  # as many as cells at most
            out[r["cell"]] = -(-r["n"] // size)
    dealt = spark.createDataFrame([(c, int(p), int(b)) for c, (p, b) in enumerate(zip(parts, blocks, strict=True))], "cell int, parts long, blocks long")
    span = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    left = coded.select(by, "cell", "code").join(F.broadcast(dealt), "cell").select(by, "cell", "code", F.pmod(F.xxhash64(by), F.col("parts")).alias("part"), span("blocks").alias("block"))
    right = looked.join(F.broadcast(dealt), "cell").select("q", "qv", "cell", span("parts").alias("part"), F.pmod(F.xxhash64("q"), F.col("blocks")).alias("block"))
    shared = spark.sparkContext.broadcast(model)

    def met(codes_: pa.Table, asked_: pa.Table) -> pa.Table:
        model, kind = shared.value, codes_.schema.field(by).type
        n, m = codes_.num_rows, asked_.num_rows
        out = ([], [], [])
        if n and m:
            code = np.frombuffer(b"".join(codes_.column("code").to_pylist()), np.uint8).reshape(n, len(model.books))
            values = matrix(asked_.column("qv"), model.dim)[1] - model.centres[codes_.column("cell")[0].as_py()]
            for q, row in zip(asked_.column("q").to_pylist(), model.padded(values), strict=True):
                table = ((row[:, None] - model.books) ** 2).sum(2)
                far = table[np.arange(len(table)), code].sum(1)
                near = np.argpartition(far, most - 1)[:most] if n > most else np.arange(n)
                for o, x in zip(out, (np.full(len(near), q), near, far[near]), strict=True):
                    o.append(x)
        q, near, far = (np.concatenate(o) if o else np.empty(0, np.int64) for o in out)
        return pa.table({"q": pa.array(q, pa.int64()), by: codes_.column(by).take(pa.array(near, pa.int64())).cast(kind), "far": pa.array(far, pa.float64())})

    keys = ["cell", "part", "block"]
    kind = coded.schema[by].dataType.simpleString()
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(met, f"q bigint, `{by}` {kind}, far double")
    best = found.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy("far", by))).where(F.col("n") <= most).select("q", by)
    best = scratch.table(best, "best")
    ranked = vectors.join(best, by).join(asked, "q").withColumn("score", F.round(squared_distance(F.col("qv"), F.col("v")), 9)).drop("v", "qv")
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("score", by))).where(F.col("rank") <= F.col("top_k"))
    return ranked.drop("q", "top_k")
