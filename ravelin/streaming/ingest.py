"""Incremental ingest: a stream of documents merged into the tables of a store."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ravelin.config import EngineConfig
from ravelin.functions.vectors import embedded, safe_embedder
from ravelin.operators import vector_index, web
from ravelin.operators.chunking import chunks
from ravelin.operators.graph import entity_counts, linked_edges, linked_mentions, links
from ravelin.operators.versions import Change, Snapshots
from ravelin.scratch import Scratch, shuffles_dropped, together
from ravelin.sources.tables import spread

DOC = ["doc_id"]
#: Versions of a store that a stream leaves to readers.
KEPT = 20


def embedding_of(config: EngineConfig) -> dict:
    """Provider (the built-in one where the named one can't be made) and dimension of the vectors that a configuration asks for."""
    taken = safe_embedder(config.embedding, config.embedding_dim)[1]
    return {"provider": "stub" if taken == "auto" else taken, "dimension": config.embedding_dim}


def chunk_vectors(made: DataFrame, given: dict) -> DataFrame:
    """chunk_id, doc_id, ord and v of the chunks that the provider gave a vector; others wait for ``embed_missing``."""
    rows = made.select("chunk_id", "doc_id", "ord", embedded(F.col("text"), given["provider"], given["dimension"]).alias("e"))
    return rows.where((F.col("e.provider") == given["provider"]) & F.col("e.v").isNotNull()).select("chunk_id", "doc_id", "ord", "e.v")


def ingest(store: Snapshots, docs: DataFrame, seq: int, config: EngineConfig = EngineConfig()) -> dict[str, int]:
    """Merge documents (doc_id, title, text); all tables change together. Numbers of documents taken, chunks, mentions and vectors, and the milliseconds it took.

    A document that comes again replaces all that was made of it, unless it is
    stored with a larger ``seq``: then all of it is left out.  Of several rows
    with one doc_id the last of the batch counts, alone.  A batch that is merged
    again gives the same tables.  Degrees of entities follow by signed amounts:
    what the new rows add less what the replaced ones had.  Where provider or
    dimension of the embeddings aren't the store's, all its chunks are embedded
    anew in the same version.
    """
    began = time.perf_counter()
    with shuffles_dropped(docs.sparkSession):
        counts = _ingested(store, docs, seq, config)
    return counts | {"latency_ms": int(1000 * (time.perf_counter() - began))}


def _ingested(store: Snapshots, docs: DataFrame, seq: int, config: EngineConfig) -> dict[str, int]:
    spark = docs.sparkSession
    scratch = Scratch(spark)
    at = docs.select("doc_id", F.struct("title", "text").alias("row"), F.monotonically_increasing_id().alias("at"))
    last = scratch.table(at.groupBy("doc_id").agg(F.max_by("row", "at").alias("row")).select("doc_id", "row.title", "row.text"), "last")
    given = embedding_of(config)
    dealt = spread(last)
    made, linked = together(spark, lambda: scratch.table(chunks(dealt, config), "chunks"), lambda: scratch.table(links(dealt, config), "links"))
    found, about = linked_mentions(linked), linked_edges(linked)
    vectors = scratch.table(chunk_vectors(made, given), "vectors")

    def change(to: Change) -> dict[str, int]:
        known = to.lookup("documents", last)
        late = known.where(F.col("seq") > seq).select("doc_id") if known is not None else last.select("doc_id").limit(0)
        late = scratch.table(late, f"late-{to.base}")
        keep = (lambda rows: rows.join(late, rows["doc_id"].eqNullSafe(late["doc_id"]), "left_anti")) if late.limit(1).count() else (lambda rows: rows)
        taken = keep(last.select("doc_id", "title"))
        before = together(spark, *(lambda n=n: to.lookup(n, taken) for n in ("mentions", "about")))
        amounts = entity_counts(keep(found), keep(about))
        if before[0] is not None:
            gone = entity_counts(*before).select("entity", (-F.col("n_docs")).alias("n_docs"), (-F.col("degree")).alias("degree"))
            amounts = amounts.unionByName(gone).groupBy("entity").agg(F.sum("n_docs").alias("n_docs"), F.sum("degree").alias("degree")).where("n_docs <> 0 OR degree <> 0")
        same = to.state["properties"].get("embedding") == given
        # vectors of all chunks are made of the chunks with those of this batch
        to.put("chunks", keep(made), taken, DOC, ["chunk_id"])
        together(
            spark,
            lambda: to.add("entities", amounts, ["entity"]),
            lambda: to.put("documents", taken.withColumn("seq", F.lit(seq).cast("bigint")), taken, DOC, DOC),
            lambda: to.put("mentions", keep(found), taken, DOC, ["doc_id", "entity"]),
            lambda: to.put("about", keep(about), taken, DOC, ["chunk_id", "entity"]),
            lambda: put_vectors(to, keep(vectors), taken) if same else embed_all(to, given),
        )
        rows = {"documents": taken, "chunks": keep(made), "mentions": keep(found), "vectors": keep(vectors)}
        return dict(zip(rows, together(spark, *(rows[n].count for n in rows)), strict=True))

    counts = store.commit(change)
    scratch.clear()
    return counts


def ingest_crawl(store: Snapshots, outcomes: DataFrame, seq: int, config: EngineConfig = EngineConfig()) -> dict[str, int]:
    """Ingest the pages that a crawl took (``web.crawl_outcomes``), each by its root and canonical address; numbers of pages, chunks, mentions and vectors, of addresses skipped, and the milliseconds it took (pages also as ``pages_ingested``)."""
    if not config.allow_urls:
        raise PermissionError("crawled pages aren't taken unless allow_urls is set")
    taken = web.taken_pages(outcomes).select(F.concat_ws(" ", "root", "url").alias("doc_id"), "title", F.col("content").alias("text"))
    made = ingest(store, taken, seq, config)
    skipped = web.skipped_addresses(outcomes).count()
    n = made.pop("documents")
    return {"pages": n, "pages_ingested": n, **made, "skipped": skipped}


def put_vectors(to: Change, vectors: DataFrame, given: DataFrame) -> None:
    """Vectors in place of those of the documents ``given``, with their codes where there is an index."""
    to.put("vectors", vectors, given, DOC, ["chunk_id"])
    if (model := to.read("index")) is not None:
        to.put("codes", vector_index.codes(vectors, vector_index.Model.from_bytes(model.first()["model"])).select("chunk_id", "doc_id", "cell", "code"), given, DOC, ["chunk_id"])


def embed_all(to: Change, given: dict) -> None:
    """Vectors of all chunks by the provider and dimension ``given``, in place of all others; an index of those goes."""
    to.write("vectors", chunk_vectors(to.read("chunks"), given), DOC, ["chunk_id"])
    to.drop("codes")
    to.drop("index")
    to.set("embedding", given)


def embed_missing(store: Snapshots) -> int:
    """Embed the chunks that have no vector, because the provider failed when they came; how many got one."""
    given = store.property("embedding")

    def change(to: Change) -> int:
        had = to.read("vectors")
        bare = to.read("chunks").join(had.select("chunk_id"), "chunk_id", "left_anti")
        scratch = Scratch(store.spark)
        made = scratch.table(chunk_vectors(bare, given), "made")
        # a document's vectors are replaced as a whole
        whole = scratch.table(made.unionByName(had.join(made.select("doc_id").distinct(), "doc_id", "left_semi")), "whole")
        put_vectors(to, whole, whole)
        return made.count()

    return store.commit(change)


def build_index(store: Snapshots) -> vector_index.Model:
    """Fit an index on a bounded sample of the stored vectors, and code all of them; later documents are coded as they come."""
    given = store.property("embedding")

    def change(to: Change) -> vector_index.Model:
        vectors = to.read("vectors")
        model = vector_index.fit(vectors, given["dimension"], "chunk_id")
        to.write("codes", vector_index.codes(vectors.select("chunk_id", "doc_id", "v"), model).select("chunk_id", "doc_id", "cell", "code"), DOC, ["chunk_id"])
        to.write("index", store.spark.createDataFrame([(0, model.to_bytes())], "id int, model binary"), ["id"], ["id"])
        return model

    return store.commit(change)


def start(spark: SparkSession, folder: str, schema: str, store: Snapshots, checkpoint: str, files_per_batch: int = 1, config: EngineConfig = EngineConfig()) -> StreamingQuery:
    """Follow a folder of Parquet files; every micro-batch is ingested. Batches replayed after a failure merge to the same rows.

    The store needs a path of its own that outlives the process as the
    checkpoint does; versions before the newest ``KEPT`` are deleted.
    """

    def merge(df: DataFrame, n: int) -> None:
        ingest(store, df, n, config)
        store.expire(KEPT)

    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return source.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
