"""Keyed tables: merges and constraints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merged(rows: DataFrame, keys: list[str], seq: str, keep: str = "last") -> DataFrame:
    """One row for each key: the one with the largest (``last``) or smallest (``first``) ``seq``; ties go to the larger or smaller of the other columns."""
    rest = [c for c in rows.columns if c not in keys]
    order = F.struct(seq, *(c for c in rest if c != seq))
    pick = F.max_by if keep == "last" else F.min_by
    best = rows.groupBy(*keys).agg(pick(F.struct(*rest), order).alias("_best"))
    return best.select(*(F.col(c) if c in keys else F.col(f"_best.{c}").alias(c) for c in rows.columns))


def entity_nodes(names: DataFrame, keep: str = "last") -> DataFrame:
    """entity_id (the lower-cased name), name and type; which of several spellings stays is set by ``keep``."""
    pick = F.max_by if keep == "last" else F.min_by
    return names.groupBy(F.lower("name").alias("entity_id")).agg(pick("name", F.struct("seq", "name")).alias("name"), F.lit("TERM").alias("type"))


def linked(edges: DataFrame, chunks: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges whose two ends are there, each once.

    Repeated ones go where the edges lie by chunk already, so they aren't dealt out anew for that, nor sent on to their
    entities.
    """
    kept = edges.join(chunks.select("chunk_id"), "chunk_id", "left_semi").dropDuplicates(["chunk_id", "entity_id", "rel"])
    return kept.join(entities.select("entity_id"), "entity_id", "left_semi")


def broken_keys(table: DataFrame, keys: list[str]) -> DataFrame:
    """Keys on more than one row, with their number; empty when the constraint holds."""
    return table.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def dimension_errors(rows: DataFrame, dimension: int, vector: str = "v", provider: str | None = None) -> DataFrame:
    """``rows`` with error: null, or ``no_vector``, ``dimension`` or (where one is named) ``provider`` where a vector doesn't fit the store's."""
    error = F.when(F.col(vector).isNull(), "no_vector").when(F.size(vector) != dimension, "dimension")
    if provider is not None:
        error = error.when(~F.col("provider").eqNullSafe(F.lit(provider)), "provider")
    return rows.withColumn("error", error)
