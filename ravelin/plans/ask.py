"""Questions to a store: planned, retrieved from its graph and its vectors, cited and scored."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.config import EngineConfig
from ravelin.functions.vectors import embedder
from ravelin.operators import answer, planner, retrieval, vector_index
from ravelin.operators.versions import Snapshots
from ravelin.scratch import Scratch


@dataclass(frozen=True)
class Asked:
    """What was found for a batch of questions."""

    plans: DataFrame
    hits: DataFrame
    citations: DataFrame
    answers: DataFrame

    def replies(self, provider: str, config: EngineConfig = EngineConfig()) -> DataFrame:
        """q_id, provider, answer, error and latency_ms of what a provider makes of the questions and what was found."""
        lines = self.citations.select("q_id", "rank", answer.context_line().alias("line"))
        return answer.answered(answer.prompts(self.plans, lines), provider, config)


def ask(store: Snapshots, questions: DataFrame, config: EngineConfig = EngineConfig(), exact: bool = False) -> Asked:
    """Plans, hits, citations and answers of ``questions`` (q_id, question, top_k) from one version of a store.

    Questions are embedded by the store's own provider and dimension, so that
    vectors of two kinds never meet.  Vectors are searched by the index where
    there is one and ``exact`` isn't asked for; else all of them.
    """
    scratch, version = Scratch(store.spark), store.version()
    given = store.state(version)["properties"]["embedding"]
    read = lambda name: store.read(name, version)
    degree = read("entities").where("degree > 0").select("entity", "degree")
    asked = scratch.table(questions.select("q_id", "question", F.col("top_k").cast("int").alias("top_k")), "questions")
    entities = scratch.table(planner.question_entities(asked, degree), "entities")
    plans = scratch.table(planner.plan(asked, entities, config), "plans")
    graph = scratch.table(retrieval.graph_hits(plans, entities, read("about")), "graph")
    # questions that the graph answers need no vectors
    bare = plans.join(graph.select("q_id").distinct(), "q_id", "left_anti").where("mode = 'GRAPH'").select("q_id")
    needed = plans.where("mode <> 'GRAPH'").unionByName(plans.join(bare, "q_id", "left_semi"))
    embed = embedder(given["provider"], given["dimension"])
    wanted = needed.select("q_id", "top_k", embed(F.coalesce("question", F.lit(""))).alias("qv"))
    vectors, model = read("vectors"), read("index")
    if exact or model is None:
        near = retrieval.nearest(wanted, vectors, by="chunk_id")
    else:
        near = vector_index.search(wanted, vectors, read("codes"), vector_index.Model.from_bytes(model.first()["model"]), by="chunk_id")
    near = scratch.table(near, "near")
    hits = scratch.table(retrieval.dispatched(plans, near, graph), "hits")
    cited = scratch.table(answer.cited(hits, read("chunks"), read("documents")), "citations")
    return Asked(plans, hits, cited, answer.answers(plans, cited))
