"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables of so few rows (counted first) are broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 500_000

#: Spark's setting of the bytes of a batch for Python; an executor and its workers hold a few copies of a batch for each task.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of a batch where an operator writes tables; a longer text is a batch of its own.
BATCH_BYTES = 1 << 22

# The letters that are lower-cased, the characters that words are made of, and those between words once lower-cased.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows; ``df`` must be cheap to count (a written table)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings that hold for what is run inside."""
    was = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in was.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def small_batches(spark: SparkSession):
    """Batches of ``BATCH_BYTES`` for what is run inside, unless the session sets another size."""
    return settings(spark, {} if spark.conf.get(BATCH, None) else {BATCH: str(BATCH_BYTES)})


def few_rows(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, so that only so many texts are Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    """The words of a text in order; none for null."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAP), "")


def digest(*cols: Column) -> list[Column]:
    """128 bits that identify the values of ``cols``, as two longs k1 and k2."""
    return [F.xxhash64(*cols).alias("k1"), F.xxhash64(F.lit("second"), *cols).alias("k2")]


_SHIFT = "list_reduce(list_prepend({x}, [0, 1, 2, 3, 4, 5, 6, 7]), lambda y, z: CASE WHEN y % 2 = 1 THEN xor(y // 2, 3988292384) ELSE y // 2 END)"
_CODES = "list_transform(string_split({s}, ''), lambda c: CAST(ascii(c) AS BIGINT))"
#: CRC-32 of a string of ASCII characters in DuckDB, a byte at a time.
CRC32_SQL = f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {_CODES}), lambda a, b: {_SHIFT.format(x='xor(a, b)')}), 4294967295)"
