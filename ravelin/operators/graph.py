"""The graph of documents, chunks and entities as tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ravelin.config import EngineConfig
from ravelin.functions import text as T
from ravelin.operators.chunking import chunk_id, chunk_texts, chunks


def mentions(docs: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """doc_id and entity, each once."""
    return chunk_texts(docs, config).select("doc_id", F.explode(T.candidates(F.col("combined"))).alias("entity")).distinct()


#: Chunks of a document that are searched together for its entities; a longer document is several groups, with its entities in each.
SPAN = 64
#: Rows of a batch that are Python objects at once, and entities from which a batch of results is handed on.
ROWS, ENTITIES = 64, 50_000


def _few(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows of the batches, a few at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield from zip(*(column.to_pylist() for column in part.columns), strict=True)


def _in_batches(rows: Iterator[tuple], schema: pa.Schema, size: Callable[[tuple], int]) -> Iterator[pa.RecordBatch]:
    """Batches of rows that are handed on as soon as their sizes add up to ``ENTITIES``."""
    out, held = [], 0
    for row in rows:
        out.append(row)
        held += size(row)
        if held >= ENTITIES:
            yield _batch(out, schema)
            out, held = [], 0
    yield _batch(out, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _automaton(entities: list[str]) -> ahocorasick.Automaton:
    wanted = ahocorasick.Automaton()
    for entity in entities:
        wanted.add_word(entity, entity)
    wanted.make_automaton()
    return wanted


def links(docs: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """doc_id, ord, entities and n_new: the entities that each chunk holds, and of each document those that none of its chunks does (without ord).

    A document's mentions are the first ``n_new`` entities of its rows.  Entities
    come from a document's own text and are looked for in its own chunks, so
    they are worked out row by row, and nothing is shuffled; where several rows
    have one doc_id (or none), those meet by joins.
    """
    size, overlap = config.window
    kind = docs.schema["doc_id"].dataType
    schema = pa.schema([("doc_id", to_arrow_type(kind)), ("ord", pa.int32()), ("entities", pa.list_(pa.string())), ("n_new", pa.int32())])

    def linked(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text in rows:
            texts = T.window_texts(T.token_list(text), size, overlap)
            entities = T.candidate_list("\n".join(texts))
            if len(texts) == 1:  # holds all that was found in it
                yield doc_id, 0, entities, len(entities)
            elif entities:
                wanted, left = _automaton(entities), dict.fromkeys(entities)
                for n, held in enumerate(texts):
                    met = dict.fromkeys(entity for _, entity in wanted.iter(held.lower()))
                    new = [entity for entity in met if entity in left]
                    for entity in new:
                        del left[entity], met[entity]
                    if new or met:
                        yield doc_id, n, [*new, *met], len(new)
                if left:
                    yield doc_id, None, list(left), len(left)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _in_batches(linked(_few(batches)), schema, lambda row: len(row[2]))

    ids = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL").select(F.col("doc_id").alias("_id"))
    shape = f"doc_id {kind.simpleString()}, ord int, entities array<string>, n_new int"
    given = docs.select("doc_id", "text")
    if not ids.limit(1).count():
        return given.mapInArrow(run, shape)
    own = F.col("doc_id").eqNullSafe(F.col("_id"))
    several = given.join(ids, own, "left_semi")
    found, made = mentions(several, config), chunks(several, config)
    by = F.collect_list("entity").alias("entities")
    bare = found.groupBy("doc_id").agg(by).select("doc_id", F.lit(None).cast("int").alias("ord"), "entities", F.size("entities").alias("n_new"))
    held = about_edges(found, made).groupBy("doc_id", "ord").agg(by).select("doc_id", "ord", "entities", F.lit(0).alias("n_new"))
    return given.join(ids, own, "left_anti").mapInArrow(run, shape).unionByName(bare).unionByName(held)


def linked_mentions(linked: DataFrame) -> DataFrame:
    """doc_id and entity, each once, of ``links``."""
    return linked.select("doc_id", F.explode(F.slice("entities", 1, F.col("n_new"))).alias("entity"))


def linked_edges(linked: DataFrame) -> DataFrame:
    """chunk_id, doc_id, ord, entity of ``links``."""
    return linked.where("ord IS NOT NULL").select(chunk_id().alias("chunk_id"), "doc_id", "ord", F.explode("entities").alias("entity"))


def about_edges(found: DataFrame, chunks: DataFrame, span: int = SPAN) -> DataFrame:
    """chunk_id, doc_id, ord, entity for the chunks of a document that its entities occur in.

    The entities of a document make one automaton, which reads each of its
    chunks once and finds all of them at the same time, so that the rows that
    are joined are groups of chunks, not entities times chunks.
    """
    names = found.groupBy("doc_id").agg(F.collect_list("entity").alias("entities"))
    text = F.struct("chunk_id", "ord", F.lower("text").alias("lowered"))
    groups = chunks.groupBy("doc_id", F.floor(F.col("ord") / span).alias("part")).agg(F.collect_list(text).alias("texts"))
    kinds = {c: chunks.schema[c].dataType.simpleString() for c in ("chunk_id", "doc_id", "ord")}
    schema = pa.schema([*((c, to_arrow_type(chunks.schema[c].dataType)) for c in kinds), ("entity", pa.string())])

    def edges(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, texts, entities in rows:
            wanted = _automaton(entities)
            for chunk in texts:
                for entity in {entity for _, entity in wanted.iter(chunk["lowered"] or "")}:
                    yield chunk["chunk_id"], doc_id, chunk["ord"], entity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _in_batches(edges(_few(batches)), schema, lambda row: 1)

    both = groups.join(names, "doc_id").select("doc_id", "texts", "entities")
    return both.mapInArrow(run, f"chunk_id {kinds['chunk_id']}, doc_id {kinds['doc_id']}, ord {kinds['ord']}, entity string")


def degrees(about: DataFrame) -> DataFrame:
    """entity and degree: the number of its chunks."""
    return about.groupBy("entity").agg(F.count("*").alias("degree"))


def neighbourhood(about: DataFrame, most: int) -> DataFrame:
    """The first ``most`` chunks of every entity by (doc_id, ord), with their place."""
    order = Window.partitionBy("entity").orderBy("doc_id", "ord")
    return about.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def orphans(found: DataFrame, about: DataFrame) -> DataFrame:
    """Entities that no chunk holds."""
    return found.select("entity").distinct().join(about, "entity", "left_anti")


def has_chunk(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Edges between documents and chunks that are both there, each once."""
    return documents.select("doc_id").join(chunks.select("doc_id", "chunk_id"), "doc_id").distinct()


def entity_counts(found: DataFrame, about: DataFrame) -> DataFrame:
    """entity, n_docs and degree: the documents that name it and the chunks that hold it."""
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    rows = found.select("entity", one.alias("n_docs"), none.alias("degree")).unionByName(about.select("entity", none.alias("n_docs"), one.alias("degree")))
    return rows.groupBy("entity").agg(F.sum("n_docs").alias("n_docs"), F.sum("degree").alias("degree"))
