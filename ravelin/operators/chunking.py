"""Documents to chunks: windows of tokens with ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravelin.config import EngineConfig
from ravelin.functions import text as T


def accepted(docs: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """``docs`` with n_bytes and status: accepted, empty (nothing to write) or too_large (over the byte limit)."""
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint")
    status = F.when(F.col("n_bytes") > config.paste_bytes, "too_large").when(T.stripped(F.coalesce("text", F.lit(""))) == "", "empty").otherwise("accepted")
    return docs.withColumn("n_bytes", size).withColumn("status", status)


# The content types that an upload may have.
UPLOADS = ("application/pdf", "application/octet-stream")


def upload_status(content_type: Column, n_bytes: Column, config: EngineConfig = EngineConfig()) -> Column:
    """accepted, unsupported_type or too_large, in the order in which an upload is judged."""
    typed = F.coalesce(content_type.isin(*UPLOADS), F.lit(False))
    return F.when(~typed, "unsupported_type").when(n_bytes > config.paste_bytes, "too_large").otherwise("accepted")


def chunks(docs: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """chunk_id, doc_id, ord, text, window_tokens, approx_tokens; a document without tokens has no chunk."""
    size, overlap = config.window
    step = size - overlap
    cut = docs.select("doc_id", T.tokens(F.col("text")).alias("tk"))
    cut = cut.withColumn("n", T.window_count(F.size("tk"), size, overlap)).where("n > 0")
    cut = cut.select("doc_id", "tk", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("ord"))
    cut = cut.select("doc_id", "ord", F.slice("tk", F.col("ord") * step + 1, size).alias("w"))
    cut = cut.select("doc_id", "ord", F.array_join("w", " ").alias("text"), F.size("w").alias("window_tokens"))
    # a window's text is its tokens with a space between them, so they need not be counted again
    approx = F.greatest("window_tokens", F.floor(F.char_length("text") / 4).cast("int"))
    return cut.select(chunk_id().alias("chunk_id"), "doc_id", "ord", "text", "window_tokens", approx.alias("approx_tokens"))


def chunk_id() -> Column:
    """The id of a chunk by its document and place."""
    return F.concat_ws("-", "doc_id", "ord")


def chunk_texts(docs: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """doc_id and combined: the texts of all its chunks, a line each (what entities are looked for in)."""
    size, overlap = config.window
    return docs.select("doc_id", F.array_join(T.windows(T.tokens(F.col("text")), size, overlap), "\n").alias("combined"))
