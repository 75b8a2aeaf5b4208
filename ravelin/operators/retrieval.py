"""Vector, graph and hybrid retrieval for batches of questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ravelin.operators.graph import neighbourhood
from ravelin.operators.nearest import nearest

__all__ = ["dispatched", "graph_hits", "hybrid_hits", "insertion_order", "nearest"]

def insertion_order(queries: DataFrame, vectors: DataFrame, k: int, seq: str = "id") -> DataFrame:
    """The explicit fallback without a search: the first k stored rows for every query."""
    first = vectors.orderBy(seq).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(seq)))
    return queries.select("q_id").join(F.broadcast(first.drop("v")), F.lit(True)).withColumn("score", F.lit(0.0))


def graph_hits(plans: DataFrame, entities: DataFrame, about: DataFrame) -> DataFrame:
    """q_id, chunk_id, doc_id, ord, entity and rank by (entity, doc_id, ord); a chunk counts once for each entity.

    No question needs more of an entity's chunks than its top_k, so each
    neighbourhood is cut to the largest top_k before it is joined.
    """
    asked = entities.where("degree > 0").select("q_id", "entity").join(plans.select("q_id", "top_k"), "q_id")
    near = neighbourhood(about, plans.agg(F.max("top_k")).first()[0] or 0)
    order = Window.partitionBy("q_id").orderBy("entity", "doc_id", "ord")
    met = asked.join(near, "entity").where(F.col("place") <= F.col("top_k"))
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= F.col("top_k")).select("q_id", "chunk_id", "doc_id", "ord", "entity", "rank")


def hybrid_hits(vector: DataFrame, graph: DataFrame) -> DataFrame:
    """Vector hits that graph hits confirm; all vector hits of a question where none is."""
    confirmed = vector.join(graph.select("q_id", "chunk_id").distinct(), ["q_id", "chunk_id"], "left_semi")
    rest = vector.join(confirmed.select("q_id").distinct(), "q_id", "left_anti")
    return confirmed.unionByName(rest)


def dispatched(plans: DataFrame, vector: DataFrame, graph: DataFrame) -> DataFrame:
    """q_id, mode, source, chunk_id, doc_id, ord, score and rank by each question's mode; graph questions without hits take vector hits."""
    modes = plans.select("q_id", "mode")
    cols = ["q_id", "mode", "source", "chunk_id", "doc_id", "ord", "score", "rank"]
    by_graph = graph.join(modes.where("mode = 'GRAPH'"), "q_id").withColumn("score", F.lit(0.0)).withColumn("source", F.lit("graph")).select(*cols)
    bare = modes.where("mode = 'GRAPH'").join(graph.select("q_id").distinct(), "q_id", "left_anti")
    plain = modes.where("mode = 'VECTOR'").unionByName(bare)
    by_vector = vector.join(plain, "q_id").withColumn("source", F.lit("vector")).select(*cols)
    mixed = modes.where("mode = 'HYBRID'")
    by_both = hybrid_hits(vector.join(mixed, "q_id"), graph.join(mixed.select("q_id"), "q_id", "left_semi")).withColumn("source", F.lit("hybrid")).select(*cols)
    return by_graph.unionByName(by_vector).unionByName(by_both)
