"""Toxicity scores by non-negative positive-unlabelled learning.

Confirmed toxic rows and unlabelled rows train a linear classifier over hashed
words and word beginnings.  The risk is that of positive-unlabelled learning:
``prior * E_p[l(g)] + max(0, E_u[l(-g)] - prior * E_p[l(-g)])`` with the
logistic loss; while the second part is negative its gradient is reversed.
The class prior is the share of toxic rows among all labelled training rows.

Bounded sample, a documented parameter: ``most_positive`` toxic rows and
``most_unlabelled`` other training rows, chosen by a hash of the id, reach the
driver as hashed feature numbers.  Scoring reads every text whole in Arrow
batches with the weights (one array of ``2 ** bits`` floats) broadcast.

Edge cases: a null or empty text has no features and gets the score of the
bias alone; a null id is never held out and never a training row; a null label
is no label; without toxic rows every score is 0; repeated rows are scored one
by one; an empty table gives an empty result; other columns are ignored; very
long texts are scored whole.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.llm.common import digest, small, small_batches
from ravelin.scratch import Scratch
from ravelin.sources.tables import table

BITS = 18
MOST_POSITIVE = 6000
MOST_UNLABELLED = 12000
#: A feature needs so many positive examples to get a weight.
LEAST_SEEN = 4
STEPS = 160
RATE = 0.5
#: Weight of the absolute values, which leaves most weights at zero.
SPARSE = 2e-4
#: Examples that a training step handles at once.
PART = 1000

_words = re.compile(r"[^\W\d_]+").findall


def features(text: str | None, bits: int = BITS) -> np.ndarray:
    """Sorted numbers of the hashed words and beginnings of words in a text."""
    if not text:
        return np.empty(0, np.int32)
    words = set(_words(text.lower()))
    parts = words | {"<" + w[:4] for w in words} | {"<" + w[:6] for w in words if len(w) > 6}
    mask = (1 << bits) - 1
    found = {zlib.crc32(p.encode()) & mask for p in parts}
    return np.sort(np.fromiter(found, np.int32, len(found)))


def remainder(name: str, by: int):
    """crc32 of the id as text, modulo ``by``."""
    return F.pmod(F.crc32(F.col(name).cast("string").cast("binary")), F.lit(by))


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, bits: int = BITS, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk (adaptive proximal gradient steps)."""
    weight = np.zeros(1 << bits)
    if not positive or not unlabelled or not prior > 0:
        return weight, -np.inf
    prior = min(prior, 0.95)
    seen = np.bincount(np.concatenate(positive), minlength=1 << bits)
    kept = np.flatnonzero(seen >= min(LEAST_SEEN, len(positive)))
    place = np.full(1 << bits, -1, np.int32)
    place[kept] = np.arange(len(kept))

    def parts(docs: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, slice]]:
        """Features and rows of parts of the documents, so that no step copies them all."""
        out = []
        for at in range(0, len(docs), PART):
            cols = [c[c >= 0] for c in (place[d] for d in docs[at : at + PART])]
            out.append((np.concatenate(cols), np.repeat(np.arange(len(cols), dtype=np.int32), [len(c) for c in cols]), slice(at, at + len(cols))))
        return out

    marked, other = parts(positive), parts(unlabelled)
    np_, nu = len(positive), len(unlabelled)
    w, b = np.zeros(len(kept)), float(np.log(prior / (1 - prior)))
    squares, bias_square = np.full(len(kept), 1e-8), 1e-8
    sigma = lambda g: 1 / (1 + np.exp(-np.clip(g, -40, 40)))
    logits = lambda rows: np.concatenate([b + np.bincount(r, w[c], at.stop - at.start) for c, r, at in rows])
    slopes = lambda rows, of: sum(np.bincount(c, of[at][r], len(kept)) for c, r, at in rows)
    for _ in range(steps):
        gp, gu = logits(marked), logits(other)
        rest = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        at_p, at_u = -prior * sigma(-gp) / np_, np.zeros(nu)
        if rest >= 0:
            at_p, at_u = at_p - prior * sigma(gp) / np_, sigma(gu) / nu
        else:  # only the part that must not be negative, the other way
            at_p, at_u = prior * sigma(gp) / np_, -sigma(gu) / nu
        slope = slopes(marked, at_p) + slopes(other, at_u)
        bias = at_p.sum() + at_u.sum()
        squares += slope * slope
        bias_square += bias * bias
        rate = RATE / np.sqrt(squares)
        w = w - rate * slope
        w = np.sign(w) * np.maximum(np.abs(w) - rate * SPARSE, 0)
        b -= RATE / np.sqrt(bias_square) * bias
    weight[kept] = w
    return weight, b


def _featured(docs: DataFrame, bits: int, most: int) -> DataFrame:
    """Features of the documents; of more than ``most``, where ids are repeated, those of the least hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [features(t, bits).tobytes() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["found"])

    found = docs.select("text").mapInArrow(run, "found binary")
    # a count of ids alone; sorted rows reach the driver as one piece, so they are sorted only where there are too many
    return found if docs.count() <= most else found.orderBy(F.xxhash64("found"), "found").limit(most)


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, bits: int = BITS, most_positive: int = MOST_POSITIVE, most_unlabelled: int = MOST_UNLABELLED) -> tuple[np.ndarray, float]:
    """Fit on training rows only (remainder by ``folds`` not 0)."""
    mine = remainder("doc_id", folds) != 0
    known = labels.where(mine & F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").cast("double").alias("toxic"))
    prior = known.agg(F.avg("toxic")).first()[0] or 0.0
    by = F.xxhash64("doc_id", F.lit("sample"))
    positive = known.where("toxic = 1").select("doc_id").distinct().orderBy(by, "doc_id").limit(most_positive)
    other = docs.where(mine).select("doc_id").orderBy(by, "doc_id").limit(most_unlabelled).distinct()
    picked = [docs.join(F.broadcast(x), "doc_id", "left_semi") for x in (positive, other)]
    bounds = (most_positive, most_unlabelled)
    found = [[np.frombuffer(r.as_buffer(), np.int32) for r in _featured(x, bits, n).toArrow().column(0)] for x, n in zip(picked, bounds, strict=True)]
    return fit(*found, prior, bits)


def score_documents(docs: DataFrame, model: tuple[np.ndarray, float], bits: int = BITS) -> DataFrame:
    """doc_id, score and predicted for every whole text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast((model[0].astype(np.float32), float(model[1])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, bias = shared.value
        for batch in batches:
            logit = np.array([bias + weight[features(t, bits)].sum(dtype=np.float64) for t in batch.column(1).to_pylist()], float)
            score = 1 / (1 + np.exp(-np.clip(logit, -700, 700))) if len(logit) else logit
            score = np.where(np.isneginf(logit), 0.0, score)
            out = [batch.column(0), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32), pa.int32())]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """Train, then score all documents: doc_id, held_out, score, predicted."""
    scored = score_documents(docs, train(docs, labels, folds))
    held = F.coalesce(remainder("doc_id", folds) == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted")


def toxic_texts(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """k1, k2 (text) of the distinct texts that are predicted toxic."""
    shared = docs.sparkSession.sparkContext.broadcast((model[0].astype(np.float32), float(model[1])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, bias = shared.value
        for batch in batches:
            gone = [not bias + weight[features(t)].sum(dtype=np.float64) < 0 for t in batch.column(2).to_pylist()]
            yield batch.select([0, 1]).filter(pa.array(gone, pa.bool_()))

    return docs.select(*digest(F.coalesce("text", F.lit(""))), "text").mapInArrow(run, "k1 bigint, k2 bigint").distinct()


def drop_toxic(docs: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """The rows of ``docs``, with all their columns, that are not predicted toxic.

    Python sees each text, but only the keys of toxic ones come back: whole
    rows sent there and back would be held several times by every task.
    """
    spark = docs.sparkSession
    with small_batches(spark):
        toxic = Scratch(spark).table(toxic_texts(docs, train(docs, labels, folds)), "toxic")
    names = docs.columns
    rows = docs.select(*(F.col(c).alias(f"_{x}") for x, c in enumerate(names)), *digest(F.coalesce("text", F.lit(""))))
    return rows.join(small(toxic), ["k1", "k2"], "left_anti").select(*(F.col(f"_{x}").alias(c) for x, c in enumerate(names)))


def op3_pu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
