"""Threshold-scaled sketches of texts: every shingle hash below a fixed fraction is kept.

A shingle is a string of ``SHINGLE`` code points (a shorter text is one
shingle); its hash has 48 bits and is kept where it is below one in
``SCALE``.  Whether a hash is kept doesn't depend on the text around it, so the
sketch of a union is the union of the sketches, and what a short text shares
with a very long one can be read off their sketches (``containment``), which
sketches of a fixed size can't tell.  Only where no hash of a text is below
the threshold is its least one kept, so that very short texts can be compared
too; a union drops it again as soon as it has a hash below the threshold.

A fingerprint is its sketch in ascending order, twelve hexadecimal digits for
each hash.  Equal texts have equal fingerprints, whatever machine makes them.

Texts are dealt over ranges of (doc_id, hash of the text) whose first rows are
known beforehand, and each range gets the first row of the next one as well,
so that a text meets its successor in one pass over sorted rows, with one
shuffle of the texts and two rows in hand.

Edge cases: a null text is empty; an empty text has the empty fingerprint; two
equal fingerprints have likeness 1, an empty one and another 0; null ids come
first; rows of one id are ordered by a hash of their texts; repeated rows are
rows of their own; a text that is alone follows itself; very long texts are
read in stretches of bounded size; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.llm.minhash import mixed
from ravelin.sources.tables import table

SHINGLE, SCALE, BITS, DIGITS = 16, 16, 48, 12
#: Code points that are hashed at once.
STRETCH = 1 << 18
#: Ranges of documents for each shuffle partition, so that the hash of a range deals them evenly.
RANGES = 4

_BASE = 0x9E3779B97F4A7C15
_LIMIT = np.uint64((1 << BITS) // SCALE)


def shingle_hashes(points: np.ndarray) -> np.ndarray:
    """48-bit hashes of all shingles of an array of code points, each hash made of those of its two halves."""
    made, width = points.astype(np.uint64) + np.uint64(1), 1
    if len(made) < SHINGLE:
        made = np.concatenate([made, np.zeros(SHINGLE - len(made), np.uint64)])
    while width < SHINGLE:
        made, width = made[:-width] * np.uint64(pow(_BASE, width, 1 << 64)) + made[width:], 2 * width
    return mixed(made) >> np.uint64(64 - BITS)


def sketch(text: str) -> np.ndarray:
    """The kept hashes of a text, ascending."""
    if not text:
        return np.empty(0, np.uint64)
    points, kept, least = np.frombuffer(text.encode("utf-32-le"), "<u4"), [], None
    for k in range(0, max(1, len(points) - SHINGLE + 1), STRETCH):
        hashes = shingle_hashes(points[k : k + STRETCH + SHINGLE - 1])
        kept.append(hashes[hashes < _LIMIT])
        least = hashes.min() if least is None else min(least, hashes.min())
    found = np.unique(np.concatenate(kept))
    return found if len(found) else np.array([least], np.uint64)


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of what two sketches stand for together."""
    both = np.union1d(a, b)
    below = both[both < _LIMIT]
    return below if len(below) else both[:1]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the hashes of either that both have."""
    if np.array_equal(a, b):
        return 1.0
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared)


def written(hashes: np.ndarray) -> str:
    """A sketch as fixed-width hexadecimal digits."""
    return hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - DIGITS // 2 :].tobytes().hex()


def hashes_of(fingerprint: Column) -> Column:
    """The hashes of a fingerprint, as an array of strings."""
    return F.regexp_extract_all(fingerprint, F.lit(f"([0-9a-f]{{{DIGITS}}})"), F.lit(1))


def containment(part: Column, whole: Column) -> Column:
    """Share of one fingerprint's hashes that another has: how much of the first text lies in the second; null where the first has none."""
    own = hashes_of(part)
    return F.when(F.size(own) > 0, F.size(F.array_intersect(own, hashes_of(whole))) / F.size(own))


def union_hashes(prints: DataFrame, by: str, fingerprint: str = "fingerprint") -> DataFrame:
    """``by`` and hash: the sketch of all texts of each group, a row for each hash, so that no group has to fit in a row."""
    rows = prints.select(by, F.explode(hashes_of(F.col(fingerprint))).alias("hash")).distinct()
    limit = f"{int(_LIMIT):0{DIGITS}x}"
    least = rows.groupBy(F.col(by).alias("_by")).agg(F.min("hash").alias("_least"))
    # a hash above the threshold stays only where the group has nothing below it
    return rows.join(least, F.col(by).eqNullSafe(F.col("_by"))).where((F.col("hash") < limit) | ((F.col("_least") >= limit) & (F.col("hash") == F.col("_least")))).select(by, "hash")


def _key(doc_id, mark: int) -> tuple:
    """A row's place among all: nulls first."""
    return (doc_id is not None, doc_id if doc_id is not None else 0, mark)


def in_order(docs: DataFrame) -> DataFrame:
    """bucket, follows, doc_id, mark, text: in each bucket a range of the documents in order, then (``follows`` 1) the one after them."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark"), "text")
    parts = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("doc_id", "mark").repartitionByRange(parts, "doc_id", "mark")
    found = dealt.groupBy(F.spark_partition_id().alias("part")).agg(F.min(F.struct("doc_id", "mark")).alias("first")).select("first.*").collect()  # a row for each part
    heads = sorted(_key(*r) for r in found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, bucket, follows = [], [], []
            for k, (doc_id, mark) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                key = _key(doc_id, mark)
                b = bisect_right(heads, key) - 1
                for place, after in [(b, 0), ((b - 1) % len(heads), 1)][: 1 + (key == heads[b])]:
                    at.append(k), bucket.append(place), follows.append(after)
            taken = pa.Table.from_batches([batch]).take(pa.array(at, pa.int64())).combine_chunks()
            columns = [pa.array(bucket, pa.int32()), pa.array(follows, pa.int32()), *taken.columns]
            yield from pa.table(columns, names=["bucket", "follows", "doc_id", "mark", "text"]).to_batches()

    kind = docs.schema["doc_id"].dataType.simpleString()
    made = rows.mapInArrow(run, f"bucket int, follows int, doc_id {kind}, mark bigint, text string")
    return made.repartition("bucket").sortWithinPartitions("bucket", "follows", "doc_id", "mark")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every text and of its edited form.

    The edited text has its last half replaced by as much of the beginning of
    the next text, as far as there is so much.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def compared(doc_id, text: str, own: np.ndarray, after: str, following: np.ndarray) -> tuple:
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        changed = sketch(edited)
        return doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), written(own), written(changed), likeness(own, changed), likeness(own, following)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            out = []
            for bucket, follows, doc_id, text in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 4)), strict=True):
                text = text or ""
                own = sketch(text)
                if before is not None and before[:2] == (bucket, 0):
                    out.append(compared(*before[2:], text, own))
                before = (bucket, follows, doc_id, text, own)
            kinds = [batch.schema.field(2).type, pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * len(kinds), kinds, strict=True)], names=names)

    return in_order(docs).mapInArrow(run, f"doc_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def sketched(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars and fingerprint of every text."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(1)]
            columns = [batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array([written(sketch(t)) for t in texts], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_chars", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_chars bigint, fingerprint string")


def op11_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
