"""Providers of answers, replies of model servers and the choice of a provider."""

from __future__ import annotations

import queue
import threading
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravelin.config import EngineConfig

#: Providers by name: what opens one, once for each task, and gives a function from a prompt to its reply. Any failure is an exception.
MODELS: dict[str, Callable[[EngineConfig], Callable[[str], str]]] = {}
#: Prompts that a task has under way at a time.
WIDTH = 8


def _asked(model: Callable[[str], str], prompts: list[str | None], deadline: float) -> list[tuple[str | None, str | None, int]]:
    """Reply, error and milliseconds of each prompt; one that takes longer than the deadline is given up, its thread left behind."""
    told: queue.SimpleQueue = queue.SimpleQueue()

    def ask(k: int, prompt: str) -> None:
        began = time.monotonic()
        try:
            reply, error = model(prompt), None
            if reply is not None and not isinstance(reply, str):
                reply, error = None, "TypeError"
        except Exception as failed:  # a provider may fail in any way
            reply, error = None, type(failed).__name__
        told.put((k, reply, error, int(1000 * (time.monotonic() - began))))

    out: list[tuple] = [(None, "timeout", int(1000 * deadline))] * len(prompts)
    for low in range(0, len(prompts), WIDTH):
        group = range(low, min(low + WIDTH, len(prompts)))
        for k in group:
            threading.Thread(target=ask, args=(k, prompts[k] or ""), daemon=True).start()
        ends, left = time.monotonic() + deadline, set(group)
        while left and (wait := ends - time.monotonic()) > 0:
            try:
                k, *result = told.get(timeout=wait)
            except queue.Empty:
                break
            if k in left:
                left.discard(k)
                out[k] = tuple(result)
    return out


def generated(prompts: DataFrame, provider: str, config: EngineConfig = EngineConfig()) -> DataFrame:
    """q_id, reply, error and latency_ms of prompts (q_id, prompt).

    The provider is opened once for each task.  A prompt that it fails on, or
    that takes longer than ``model_timeout_sec``, has an error and no reply, and
    so have all of a task where it can't be opened; no task fails for it.
    """
    if provider not in MODELS:
        raise ValueError(f"no provider named {provider!r}")
    opened, deadline = MODELS[provider], config.model_timeout_sec

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, broken = None, None
        for batch in batches:
            if model is None and broken is None:
                try:
                    model = opened(config)
                except Exception as failed:  # a provider may fail in any way
                    broken = type(failed).__name__
            given = batch.column(1).to_pylist()
            made = [(None, broken, 0)] * len(given) if model is None else _asked(model, given, deadline)
            reply, error, ms = (list(c) for c in zip(*made, strict=True)) if made else ([], [], [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(reply, pa.string()), pa.array(error, pa.string()), pa.array(ms, pa.int64())], names=["q_id", "reply", "error", "latency_ms"])

    kind = prompts.schema["q_id"].dataType.simpleString()
    return prompts.select("q_id", "prompt").mapInArrow(run, f"q_id {kind}, reply string, error string, latency_ms bigint")


# Where each kind of server puts its text, in the order in which they are tried.
PLACES = {
    "ollama": ["$.response"],
    "llamacpp": ["$.content", "$.text", "$.choices[0].text", "$.choices[0].message.content"],
    "groq": ["$.choices[0].delta.content", "$.choices[0].message.content", "$.message"],
}


def _string_at(body: Column, path: str) -> Column:
    """The value at a path if it is a string."""
    parsed = F.try_parse_json(body)
    return F.when(F.schema_of_variant(F.try_variant_get(parsed, path, "variant")) == "STRING", F.try_variant_get(parsed, path, "string"))


def reply_text(provider: Column, body: Column) -> Column:
    """The text of a reply without white space around it; null where there is none."""
    found = F.lit(None).cast("string")
    for name, paths in PLACES.items():
        found = F.when(provider == name, F.coalesce(*(_string_at(body, p) for p in paths))).otherwise(found)
    return F.nullif(F.trim(F.regexp_replace(found, r"^\s+|\s+$", "")), F.lit(""))


def reply_vectors(body: Column) -> Column:
    """The vectors of an embedding server's reply, one for each text; null where it holds none."""
    parsed = F.try_parse_json(body)
    many = F.try_variant_get(parsed, "$.data", "array<struct<embedding: array<double>>>")
    one = F.try_variant_get(parsed, "$.embedding", "array<double>")
    empty = F.array().cast("array<double>")
    return F.coalesce(F.transform(many, lambda x: F.coalesce(x["embedding"], empty)), F.when(one.isNotNull(), F.array(one)))


def model_names(body: Column) -> Column:
    """The names in a model server's list; empty for a reply of another form."""
    listed = F.try_variant_get(F.try_parse_json(body), "$.models", "array<variant>")
    names = F.transform(listed, lambda x: F.when(F.schema_of_variant(F.try_variant_get(x, "$.name", "variant")) == "STRING", F.try_variant_get(x, "$.name", "string")))
    return F.coalesce(F.filter(names, lambda x: x.isNotNull()), F.array().cast("array<string>"))


def resolved(requests: DataFrame, active: str = "stub") -> DataFrame:
    """``requests`` with provider (the override, else the active one; unknown names become the stub) and kind."""
    asked = F.lower(F.trim(F.coalesce("provider_override", F.lit(active))))
    name = F.when(asked.isin("auto", "local"), "ollama").when(asked == "hosted", "groq").when(asked.isin("ollama", "llamacpp", "groq", "stub"), asked).otherwise("stub")
    kind = F.when(F.col("provider").isin("ollama", "llamacpp"), "local").when(F.col("provider") == "groq", "hosted").otherwise("stub")
    return requests.withColumn("provider", name).withColumn("provider_kind", kind)


def preferred(wanted: DataFrame, installed: DataFrame) -> DataFrame:
    """host and model: of each host's installed models the most preferred (priority, name), whatever the case."""
    met = installed.join(wanted, F.lower(installed["name"]) == wanted["model"])
    return met.groupBy("host").agg(F.min_by("model", F.struct("priority", "model")).alias("model"))


def chosen(requests: DataFrame, tags: DataFrame, wanted: DataFrame) -> DataFrame:
    """``requests`` (provider_override, host) with model: the most preferred that the host lists (tags: host, body); local requests without one go to the stub."""
    listed = tags.select("host", F.explode(model_names(F.col("body"))).alias("name")).distinct()
    both = resolved(requests, "auto").join(preferred(wanted, listed), "host", "left")
    bare = (F.col("provider") == "ollama") & F.col("model").isNull()
    return both.select(*requests.columns, F.when(bare, "stub").otherwise(F.col("provider")).alias("provider"), F.when(bare, "stub").otherwise(F.col("provider_kind")).alias("provider_kind"), F.when(F.col("provider") == "ollama", F.col("model")).alias("model"))
