"""Citations, prompt context and confidence of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravelin.config import EngineConfig
from ravelin.functions.present import excerpt, shortened
from ravelin.functions.text import stripped
from ravelin.operators.providers import generated

STUB_ANSWER = "No language model is connected; the cited passages hold what was found."
FAILED = "The model did not answer. "
HEADER = "Answer from the passages below and nothing else, and name the [document:chunk] tags that support it."
NOTHING = "(nothing was found)"


UNKNOWN = "unknown"


def cited(hits: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Hits with title and snippet (the whole chunk); hits without a stored chunk or document keep nulls there, those without a score have 0."""
    texts = chunks.select("chunk_id", F.col("text").alias("snippet"))
    titles = documents.select("doc_id", "title")
    both = hits.join(texts, "chunk_id", "left").join(titles, "doc_id", "left")
    return both.withColumn("score", F.coalesce(F.col("score").cast("double"), F.lit(0.0)))


def _doc_id() -> Column:
    return F.coalesce(F.col("doc_id").cast("string"), F.lit(UNKNOWN))


def _chunk_id() -> Column:
    return F.coalesce("chunk_id", F.lit(""))


def confidence(mean_score: Column) -> Column:
    """1 / (1 + mean score) within 0.1 and 0.99; 0.5 without citations."""
    return F.when(mean_score.isNull(), 0.5).otherwise(F.greatest(F.lit(0.1), F.least(F.lit(0.99), 1 / (1 + mean_score))))


def context_line(shorten: bool = True) -> Column:
    title = F.coalesce(F.nullif(F.col("title"), F.lit("")), _doc_id())
    flat = F.replace(stripped(F.coalesce("snippet", F.lit(""))), F.lit("\n"), F.lit(" "))
    return F.concat(F.lit("["), _doc_id(), F.lit(":"), _chunk_id(), F.lit("] "), title, F.lit(": "), shortened(flat) if shorten else flat)


def answers(plans: DataFrame, citations: DataFrame) -> DataFrame:
    """q_id, mode, n_citations, confidence and citations (in rank order) of every question."""
    item = F.struct("rank", _chunk_id().alias("chunk_id"), _doc_id().alias("doc_id"), "title", F.round("score", 6).alias("score"))
    by = citations.groupBy("q_id").agg(F.count("*").alias("n"), F.avg("score").alias("mean"), F.array_sort(F.collect_list(item)).alias("citations"))
    both = plans.select("q_id", "mode").join(by, "q_id", "left")
    return both.select("q_id", "mode", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_citations"), F.round(confidence(F.col("mean")), 6).alias("confidence"), "citations")


def prompts(plans: DataFrame, lines: DataFrame) -> DataFrame:
    """q_id and prompt: the header, the context lines by rank, and the question."""
    block = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), "\n")
    by = lines.groupBy("q_id").agg(block.alias("block"))
    both = plans.select("q_id", "question").join(by, "q_id", "left")
    return both.select("q_id", F.concat(F.lit(f"{HEADER}\n\n"), F.coalesce("block", F.lit(NOTHING)), F.lit("\n\nQuestion: "), stripped(F.col("question"))).alias("prompt"))


def shown(citations: DataFrame) -> DataFrame:
    """Citations as a reader sees them: id, title, quotes of 120 and 240 characters, and the score with two digits."""
    title = F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.lit("Untitled"))
    quote = lambda n: F.concat(F.lit("“"), excerpt(F.coalesce("snippet", F.lit("")), n), F.lit("”"))
    return citations.select("q_id", "rank", F.concat_ws(":", _doc_id(), _chunk_id()).alias("citation_id"), title.alias("title"), quote(120).alias("short_quote"), quote(240).alias("long_quote"), F.format_string("%.2f", "score").alias("relevance"))


def first_titles(questions: DataFrame, citations: DataFrame) -> DataFrame:
    """q_id and title: that of each question's first citation that has one, else Untitled."""
    named = citations.withColumn("title", stripped(F.coalesce("title", F.lit("")))).where("title <> ''")
    first = named.groupBy("q_id").agg(F.min_by("title", "rank").alias("title"))
    return questions.select("q_id").join(first, "q_id", "left").select("q_id", F.coalesce("title", F.lit("Untitled")).alias("title"))


def answered(prompts_: DataFrame, provider: str, config: EngineConfig = EngineConfig()) -> DataFrame:
    """q_id, provider, answer, error and latency_ms of prompts (q_id, prompt) that a provider answers: a failed one has the marked fallback and says why."""
    if provider == "stub":
        return replied(prompts_, None, provider).select("*", F.lit(None).cast("string").alias("error"), F.lit(0).cast("bigint").alias("latency_ms"))
    told = generated(prompts_, provider, config)
    text = F.nullif(stripped(F.col("reply")), F.lit(""))
    error = F.coalesce("error", F.when(text.isNull(), "empty"))
    return told.select("q_id", F.lit(provider).alias("provider"), F.coalesce(text, F.lit(FAILED + STUB_ANSWER)).alias("answer"), error.alias("error"), "latency_ms")


def replied(prompts_: DataFrame, replies: DataFrame | None, provider: str) -> DataFrame:
    """q_id, provider and answer: the stub's text, a provider's reply, or a marked fallback where it failed."""
    if provider == "stub" or replies is None:
        return prompts_.select("q_id", F.lit("stub").alias("provider"), F.lit(STUB_ANSWER).alias("answer"))
    both = prompts_.select("q_id").join(replies.select("q_id", "reply"), "q_id", "left")
    text = F.nullif(stripped(F.col("reply")), F.lit(""))
    return both.select("q_id", F.lit(provider).alias("provider"), F.coalesce(text, F.lit(FAILED + STUB_ANSWER)).alias("answer"))
