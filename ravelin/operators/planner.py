"""Choice of the retrieval mode for a batch of questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravelin.config import EngineConfig
from ravelin.functions import text as T
from ravelin.functions.text import stripped

# Providers that a question may name, and those that may be switched to.
PROVIDERS = ("ollama", "groq", "stub", "llamacpp")
TOGGLES = ("ollama", "groq")


def question_entities(questions: DataFrame, degree: DataFrame) -> DataFrame:
    """q_id, entity, degree (0 for entities that aren't in the graph)."""
    asked = questions.select("q_id", F.explode(T.candidates(F.coalesce("question", F.lit("")))).alias("entity"))
    return asked.join(degree, "entity", "left").select("q_id", "entity", F.coalesce("degree", F.lit(0)).cast("bigint").alias("degree"))


def plan(questions: DataFrame, entities: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """q_id, question, mode, reason, top_k, max_degree and entities (of positive degree, in order) of each question."""
    named = F.array_sort(F.collect_list(F.when(F.col("degree") > 0, F.col("entity"))))
    known = entities.groupBy("q_id").agg(F.max("degree").alias("max_degree"), named.alias("entities"))
    both = questions.join(known, "q_id", "left").withColumn("max_degree", F.coalesce("max_degree", F.lit(0)))
    mode = F.when(F.col("max_degree") >= config.graph_degree, "GRAPH").when(F.col("max_degree") > 0, "HYBRID").otherwise("VECTOR")
    reason = F.when(F.col("mode") == "GRAPH", F.concat(F.lit("an entity has degree "), F.col("max_degree").cast("string"))).when(F.col("mode") == "HYBRID", "its entities are rare").otherwise("no entity is known")
    both = both.withColumn("mode", mode)
    top = F.greatest(F.coalesce("top_k", F.lit(config.top_k)), F.lit(1)).cast("int")
    return both.select("q_id", "question", "mode", reason.alias("reason"), top.alias("top_k"), F.col("max_degree").cast("bigint").alias("max_degree"), F.coalesce("entities", F.array().cast(T.NO_TEXTS)).alias("entities"))


def validated(questions: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """``questions`` with error: null, or the first rule that a request breaks."""
    size = F.octet_length(F.coalesce("question", F.lit("")))
    error = (
        F.when(size > config.ask_bytes, "too_large")
        .when(size == 0, "blank_question")
        .when(F.col("top_k") < 1, "top_k_below_1")
        .when(~_name("provider_override").isin(*PROVIDERS), "unknown_provider")
    )
    return questions.withColumn("error", error)


def _name(column: str) -> Column:
    """A provider's name as it is compared: without white space around it, in lower case."""
    return F.lower(stripped(F.col(column)))


def validated_urls(requests: DataFrame) -> DataFrame:
    """``requests`` to take in pages (url, max_depth, max_pages) with the address stripped and error: null, or the first rule that is broken."""
    url = stripped(F.coalesce("url", F.lit("")))
    error = (
        F.when(F.coalesce("url", F.lit("")) == "", "blank_url")
        .when(F.col("_url") == "", "empty_url")
        .when(~(F.startswith("_url", F.lit("http://")) | F.startswith("_url", F.lit("https://"))), "not_http")
        .when(F.col("max_depth") < 0, "max_depth_below_0")
        .when(F.col("max_pages") < 1, "max_pages_below_1")
    )
    made = requests.withColumn("_url", url).withColumn("error", error)
    return made.withColumn("url", F.when(F.col("error").isNull(), F.col("_url")).otherwise(F.col("url"))).drop("_url")


def validated_toggles(requests: DataFrame) -> DataFrame:
    """``requests`` to switch the provider with its name as it is taken and error: null, blank_provider or unknown_provider."""
    error = F.when(F.coalesce("provider", F.lit("")) == "", "blank_provider").when(~_name("provider").isin(*TOGGLES), "unknown_provider")
    return requests.withColumn("error", error).withColumn("provider", F.when(F.col("error").isNull(), _name("provider")).otherwise(F.col("provider")))
