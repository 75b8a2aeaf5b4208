"""Registered queries; their DuckDB counterparts are in ``oracle``."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ravelin.functions import present as P
from ravelin.functions import text as T
from ravelin.functions import urls as U
from ravelin.functions import vectors as V
from ravelin.operators import answer, chunking, graph, history, planner, providers, retrieval, store, vector_index, web
from ravelin.operators.versions import Snapshots
from ravelin.plans.corpus import Corpus
from ravelin.plans.oracle import ORACLE_SQL
from ravelin.streaming import ingest

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(make: Callable[[Corpus], DataFrame]) -> Callable[[Corpus], DataFrame]:
    QUERIES[make.__name__] = lambda spark, sf_dir: make(Corpus.of(spark, sf_dir))
    return make


# --- text, chunks and entities ---


@query
def chunk_windows(c: Corpus) -> DataFrame:
    return c.chunks.select("chunk_id", "doc_id", "ord", "window_tokens", F.md5("text").alias("text_md5"))


@query
def chunk_approx_tokens(c: Corpus) -> DataFrame:
    return c.chunks.select("chunk_id", "approx_tokens")


@query
def doc_size_guard(c: Corpus) -> DataFrame:
    return chunking.accepted(c.documents, c.config).select("doc_id", "n_bytes", "status")


@query
def page_count_formfeed(c: Corpus) -> DataFrame:
    return c.documents.select("doc_id", T.page_count(F.replace("text", F.lit("\n"), F.lit("\f"))).alias("n_pages"))


@query
def entity_phrases(c: Corpus) -> DataFrame:
    found = c.spread_documents.select("doc_id", F.explode(T.phrases(F.coalesce("text", F.lit("")))).alias("phrase"))
    return found.groupBy("phrase").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"))


@query
def entity_suffixes(c: Corpus) -> DataFrame:
    found = c.spread_documents.select("doc_id", F.explode(T.phrases(F.coalesce("text", F.lit("")))).alias("phrase"))
    made = found.select("doc_id", F.explode(T.suffixes(F.col("phrase"))).alias("suffix"))
    return made.groupBy("doc_id").agg(F.count("*").alias("n_suffixes"), F.countDistinct("suffix").alias("n_distinct"), F.max(F.char_length("suffix")).cast("bigint").alias("longest"))


@query
def entity_words(c: Corpus) -> DataFrame:
    found = c.spread_documents.select(F.explode(T.long_words(F.coalesce("text", F.lit("")))).alias("word"))
    return found.groupBy(F.lower("word").alias("word")).agg(F.count("*").alias("n"))


@query
def entity_candidates(c: Corpus) -> DataFrame:
    return c.mentions.groupBy("doc_id").agg(F.count("*").alias("n_entities"), F.min("entity").alias("first"), F.max("entity").alias("last"))


@query
def mention_edges(c: Corpus) -> DataFrame:
    return c.about.groupBy("chunk_id", "doc_id", "ord").agg(F.count("*").alias("n_edges"), F.min("entity").alias("first"), F.max("entity").alias("last"))


@query
def entity_degrees(c: Corpus) -> DataFrame:
    return c.degrees


@query
def entity_neighbours(c: Corpus) -> DataFrame:
    near = graph.neighbourhood(c.about.drop("chunk_id"), 3).withColumn("chunk_id", chunking.chunk_id()).join(c.documents.select("doc_id", "title"), "doc_id", "left")
    return near.select("entity", "place", "chunk_id", "doc_id", "title")


@query
def orphan_entities(c: Corpus) -> DataFrame:
    return graph.orphans(c.mentions, c.about).select(F.md5("entity").alias("entity_md5"), F.char_length("entity").cast("bigint").alias("n_chars"))


@query
def document_edges(c: Corpus) -> DataFrame:
    return graph.has_chunk(c.documents, c.chunks)


@query
def ingest_summary(c: Corpus) -> DataFrame:
    n_chunks = c.chunks.groupBy("doc_id").agg(F.count("*").alias("chunks"))
    n_entities = c.mentions.groupBy("doc_id").agg(F.count("*").alias("entities"))
    both = c.documents.select("doc_id", "text").join(n_chunks, "doc_id", "left").join(n_entities, "doc_id", "left")
    chunks, entities = F.coalesce("chunks", F.lit(0)), F.coalesce("entities", F.lit(0))
    pages = T.page_count(F.replace("text", F.lit("\n"), F.lit("\f")))  # line feeds stand for form feeds
    named = [chunks.alias("vector_count"), chunks.alias("chunks_ingested"), entities.alias("entities_linked"), chunks.alias("vectors_upserted"), pages.alias("pages_ingested")]
    return both.select("doc_id", chunks.alias("chunks"), entities.alias("entities"), *named)


@query
def ingest_totals(c: Corpus) -> DataFrame:
    one = ingest_summary(c).agg(F.count("*").alias("n_documents"), F.sum("chunks").alias("chunks"), F.sum("entities").alias("entities"), F.sum("vector_count").alias("vector_count"))
    return one.join(c.degrees.agg(F.count("*").alias("linked_entities"), F.max("degree").alias("max_degree")), F.lit(True))


# --- stores ---


def _batches(c: Corpus) -> DataFrame:
    """Every document twice: as it is, and a second write of those with an odd id under another title."""
    first = c.documents.select("doc_id", "title", F.lit(1).alias("seq"))
    return first.unionByName(c.documents.where("doc_id % 2 = 1").select("doc_id", F.concat("title", F.lit(" (new)")).alias("title"), F.lit(2).alias("seq")))


@query
def store_upsert_lww(c: Corpus) -> DataFrame:
    return store.merged(_batches(c), ["doc_id"], "seq")


@query
def store_first_name_wins(c: Corpus) -> DataFrame:
    found = c.spread_documents.select("doc_id", F.posexplode(T.phrases(F.coalesce("text", F.lit("")))).alias("at", "name"))
    return store.entity_nodes(found.select("name", F.struct("doc_id", "at").alias("seq")), keep="first")


@query
def store_linked_edges(c: Corpus) -> DataFrame:
    edges = c.about.select("chunk_id", F.col("entity").alias("entity_id"), F.lit("ABOUT").alias("rel"))
    known = c.degrees.where("degree >= 3").select(F.col("entity").alias("entity_id"))
    return store.linked(edges.unionByName(edges), c.chunks, known).groupBy("entity_id").agg(F.count("*").alias("n"))


@query
def ingest_entities(c: Corpus) -> DataFrame:
    """Documents in batches, every second one first with another text and every fifth again with an older number: entities as the changes leave them."""
    docs, odd = c.documents.select("doc_id", "title", "text"), F.col("doc_id") % 2 == 1
    old = docs.withColumn("text", F.when(odd, F.concat_ws(" ", F.lit("Old"), "title", F.lit("Words about Nothing"))).otherwise(F.col("text")))
    tables, config = Snapshots(c.spark), replace(c.config, embedding_dim=8)
    last = docs.where("doc_id % 5 = 0").withColumn("text", F.lit("Late Arrivals"))
    for seq, batch in ((1, old.where("doc_id % 2 = 1 OR doc_id % 3 = 0")), (2, docs.where(odd)), (3, docs.where("doc_id % 2 = 0 AND doc_id % 3 <> 0")), (0, last)):
        ingest.ingest(tables, batch, seq, config)
        tables.expire(1, grace=0)  # nothing else reads or writes this store
    return tables.read("entities").select("entity", "n_docs", "degree")


@query
def key_constraints(c: Corpus) -> DataFrame:
    checks = [("documents", c.documents, ["doc_id"]), ("chunks", c.chunks, ["chunk_id"]), ("entities", c.degrees, ["entity"]), ("edges", c.about, ["chunk_id", "entity"]), ("batches", _batches(c), ["doc_id"])]
    out = None
    for name, df, keys in checks:
        one = store.broken_keys(df, keys).agg(F.count("*").alias("n_broken")).select(F.lit(name).alias("table_name"), "n_broken")
        out = one if out is None else out.unionByName(one)
    return out


@query
def edge_label_sanitise(c: Corpus) -> DataFrame:
    kinds = c.table("events").select("event_type").unionByName(c.documents.select(F.concat("source", F.lit("-x")).alias("event_type")))
    return kinds.groupBy(F.coalesce("event_type", F.lit("")).alias("label")).agg(F.count("*").alias("n")).select("label", T.edge_label(F.col("label")).alias("rel"), "n")


@query
def upload_guard(c: Corpus) -> DataFrame:
    """Events stand for uploads of several content types and sizes."""
    kinds = F.array(*map(F.lit, ["application/pdf", "text/html", "application/octet-stream", None]))
    made = c.table("events").select("event_id", F.get(kinds, (F.col("event_id") % 4).cast("int")).alias("content_type"), (F.col("event_id") * 1000).alias("n_bytes"))
    return made.select("event_id", chunking.upload_status(F.col("content_type"), F.col("n_bytes"), c.config).alias("status"))


@query
def vector_dimension_guard(c: Corpus) -> DataFrame:
    """Every tenth vector is cut short, every eleventh is missing."""
    cut = F.when(F.col("vec_id") % 10 == 0, F.slice("v", 1, 3)).when(F.col("vec_id") % 11 == 0, F.lit(None)).otherwise(F.col("v"))
    rows = c.vector_rows.select("vec_id", cut.alias("v"))
    return store.dimension_errors(rows, rows.agg(F.max(F.size("v"))).first()[0] or 0).select("vec_id", "error")


# --- planning and retrieval ---


@query
def question_plan(c: Corpus) -> DataFrame:
    return c.plans.select("q_id", "mode", "reason", "top_k", "max_degree", F.size("entities").cast("bigint").alias("n_entities"), F.md5(F.array_join("entities", "|")).alias("entities_md5"))


@query
def question_validation(c: Corpus) -> DataFrame:
    turns = c.table("conversations")
    asked = turns.select(F.concat_ws("-", "conv_id", "turn").alias("q_id"), F.when(F.col("turn") % 7 == 6, "").otherwise(F.col("text")).alias("question"), (F.col("turn") - 1).cast("int").alias("top_k"), F.col("role").alias("provider_override"))
    asked = asked.withColumn("provider_override", F.when(F.col("provider_override") == "user", "stub").when(F.col("provider_override") == "assistant", None).otherwise(F.col("provider_override")))
    return planner.validated(asked, c.config).select("q_id", "top_k", "provider_override", "error")


@query
def url_request_validation(c: Corpus) -> DataFrame:
    """Addresses of pages in several states as requests to take pages in."""
    made = F.when(F.col("page_id") % 7 == 0, "").when(F.col("page_id") % 7 == 1, " ").when(F.col("page_id") % 7 == 2, F.concat(F.lit("ftp:"), "url")).otherwise(F.concat(F.lit(" "), "url", F.lit("\n")))
    asked = c.table("pages").select("page_id", made.alias("url"), (F.col("page_id") % 5 - 1).cast("int").alias("max_depth"), (F.col("page_id") % 4).cast("int").alias("max_pages"))
    return planner.validated_urls(asked)


@query
def provider_toggle_validation(c: Corpus) -> DataFrame:
    """Names in several states as requests to switch the provider."""
    names = F.array(*map(F.lit, ["ollama", " Groq ", "", "stub", "other", None]))
    return planner.validated_toggles(c.table("events").select("event_id", F.get(names, (F.col("event_id") % 6).cast("int")).alias("provider")))


@query
def vector_norms(c: Corpus) -> DataFrame:
    return c.vector_rows.select("vec_id", F.round(V.norm(F.col("v")), 6).alias("norm"))


@query
def vector_topk_batch(c: Corpus) -> DataFrame:
    asked = c.vector_rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q_id"), F.col("v").alias("qv"))
    stored = c.vector_rows.withColumnRenamed("vec_id", "id")
    return retrieval.nearest(asked, stored, c.config.top_k).select("q_id", F.col("id").alias("vec_id"), F.round("score", 6).alias("score"), "rank")


@query
def vector_index_topk(c: Corpus) -> DataFrame:
    """The same questions by the index: the tests hold its recall against the exact way."""
    stored = c.vector_rows.withColumnRenamed("vec_id", "id").where("v IS NOT NULL")
    model = vector_index.fit(stored, stored.agg(F.max(F.size("v"))).first()[0] or 0)
    coded = c.scratch.table(vector_index.codes(stored, model), "codes")
    asked = c.vector_rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q_id"), F.col("v").alias("qv"))
    return vector_index.search(asked, stored, coded, model, c.config.top_k).select("q_id", F.col("id").alias("vec_id"), F.round("score", 6).alias("score"), "rank")


@query
def vector_insertion_order(c: Corpus) -> DataFrame:
    asked = c.vector_rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q_id"))
    return retrieval.insertion_order(asked, c.vector_rows.withColumnRenamed("vec_id", "id"), c.config.top_k)


@query
def graph_topk(c: Corpus) -> DataFrame:
    return c.graph_hits


@query
def hybrid_topk(c: Corpus) -> DataFrame:
    mixed = c.plans.where("mode = 'HYBRID'").select("q_id")
    hits = retrieval.hybrid_hits(c.vector_hits.join(mixed, "q_id"), c.graph_hits.join(mixed, "q_id", "left_semi"))
    return hits.select("q_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query
def mode_dispatch(c: Corpus) -> DataFrame:
    return c.dispatched.withColumn("score", F.round("score", 6))


# --- answers ---


@query
def citations(c: Corpus) -> DataFrame:
    return c.citations.select("q_id", "rank", "chunk_id", "doc_id", "title", F.round("score", 6).alias("score"), F.md5("snippet").alias("snippet_md5"))


@query
def confidence(c: Corpus) -> DataFrame:
    return answer.answers(c.plans, c.citations).select("q_id", "mode", "n_citations", "confidence")


@query
def context_lines(c: Corpus) -> DataFrame:
    return c.citations.select("q_id", "rank", F.md5(answer.context_line(shorten=False)).alias("line_md5"))


@query
def prompt_text(c: Corpus) -> DataFrame:
    lines = c.citations.select("q_id", "rank", answer.context_line(shorten=False).alias("line"))
    made = answer.prompts(c.plans, lines)
    return made.select("q_id", F.char_length("prompt").cast("bigint").alias("n_chars"), F.md5("prompt").alias("prompt_md5"))


@query
def stub_answers(c: Corpus) -> DataFrame:
    return answer.replied(c.plans, None, "stub")


@query
def provider_fallback(c: Corpus) -> DataFrame:
    """Replies stand in for a provider's: benchmark questions get theirs, the others fail."""
    replies = c.questions.where("q_id like 'b-%'").select("q_id", F.concat(F.lit(" "), "question").alias("reply"))
    return answer.replied(c.plans, replies, "llamacpp").select("q_id", "provider", F.md5("answer").alias("answer_md5"))


@query
def shown_citations(c: Corpus) -> DataFrame:
    return answer.shown(c.citations)


@query
def first_titled_citation(c: Corpus) -> DataFrame:
    return answer.first_titles(c.plans, c.citations)


@query
def snippet_shorten(c: Corpus) -> DataFrame:
    return c.chunks.select("chunk_id", P.shortened(F.replace("text", F.lit("\n"), F.lit(" "))).alias("snippet"))


@query
def prompt_shortened(c: Corpus) -> DataFrame:
    lines = c.citations.select("q_id", "rank", answer.context_line().alias("line"))
    return answer.prompts(c.plans, lines)


@query
def hash_embeddings(c: Corpus) -> DataFrame:
    made = c.chunks.select("chunk_id", V.embedder("auto", c.config.embedding_dim)(F.col("text")).alias("v"))
    return made.select("chunk_id", F.size("v").alias("dim"), F.round(V.norm(F.col("v")), 6).alias("norm"), F.round(F.get("v", F.lit(0)), 9).alias("v0"))


# --- pages ---


@query
def url_normalise(c: Corpus) -> DataFrame:
    return c.table("pages").select("page_id", U.normalised(F.col("url")).alias("url"))


@query
def url_validate(c: Corpus) -> DataFrame:
    given = c.table("pages").select("page_id", F.when(F.col("page_id") % 10 == 0, F.concat(F.lit("ftp:"), "url")).when(F.col("page_id") % 10 == 1, F.lit("https:///path")).otherwise(F.col("url")).alias("url"))
    return given.select("page_id", U.valid_url(F.col("url")).alias("valid"))


@query
def same_origin_pages(c: Corpus) -> DataFrame:
    pages = c.table("pages").select(U.scheme(F.col("url")).alias("scheme"), U.authority(F.col("url")).alias("authority"))
    return pages.groupBy("scheme", "authority").agg(F.count("*").alias("n"))


@query
def page_title(c: Corpus) -> DataFrame:
    return c.read_pages.select("page_id", "title")


@query
def page_links(c: Corpus) -> DataFrame:
    """Links of all anchors, menus included (the captured pages have no others)."""
    return web.page_links(c.table("pages"), removed=())


@query
def page_content_links(c: Corpus) -> DataFrame:
    """Links outside the menus, of pages whose articles are given some."""
    return web.page_links(c.site)


@query
def page_main_text(c: Corpus) -> DataFrame:
    return c.read_pages.select("page_id", "content")


@query
def page_read(c: Corpus) -> DataFrame:
    return c.read_pages.select("page_id", "url", "canonical_url", F.size("links").alias("n_links"))


@query
def page_dedupe_sha1(c: Corpus) -> DataFrame:
    return web.first_by_content(c.read_pages.select("page_id", "content")).select("page_id", "sha1")


@query
def page_dedupe_canonical(c: Corpus) -> DataFrame:
    """One page in three names a canonical address that it shares with others."""
    return web.page_texts(c.site).groupBy("canonical_url").agg(F.min("page_id").alias("page_id"))


@query
def crawl_char_budget(c: Corpus) -> DataFrame:
    pages = c.read_pages.select("page_id", U.authority(F.col("url")).alias("host"), "content").where("content <> ''")
    return web.within_budget(pages, c.config).select("page_id", "host", "visit", "n_chars", "total_chars")


@query
def crawl_robots(c: Corpus) -> DataFrame:
    """Every host with pages in English disallows its French pages but those that begin with 1."""
    pages = c.table("pages").select("page_id", "url")
    robots = pages.where(F.contains("url", F.lit("/en/"))).select(U.authority(F.col("url")).alias("host"), F.lit("User-agent: other\nDisallow: /\n\nUser-agent: *\nAllow: /fr/1\nDisallow: /fr/\n").alias("robots")).distinct()
    return web.allowed(pages, robots).select("page_id")


@query
def crawl_pages(c: Corpus) -> DataFrame:
    """From the first page of each host over two links; addresses with a 7 are forbidden."""
    got = web.taken_pages(c.crawled)
    return got.select("root", "visit", "depth", "page_id", "url", "n_chars", F.md5("content").alias("content_md5"))


@query
def crawl_skipped(c: Corpus) -> DataFrame:
    return web.skipped_addresses(c.crawled).select("root", "depth", "address", "reason")


@query
def crawl_bfs(c: Corpus) -> DataFrame:
    """From the first page of each site over links to the next two pages of the site."""
    pages = c.table("pages").select("page_id", U.authority(F.col("url")).alias("host"))
    order = Window.partitionBy("host").orderBy("page_id")
    at = pages.select("host", "page_id", *(F.lead("page_id", k).over(order).alias(f"n{k}") for k in (1, 2)), F.row_number().over(order).alias("k"))
    links = at.select(F.col("page_id").alias("source"), F.explode(F.array("n1", "n2")).alias("target")).where("target is not null")
    return web.crawl(at.where("k = 1").select(F.col("page_id").alias("root")), links, 2)


# --- providers and presentation ---


@query
def provider_payload_parse(c: Corpus) -> DataFrame:
    turns = c.table("conversations").where("text is not null")
    shape = (F.col("conv_id") + F.col("turn")) % 8
    body = (
        F.when(shape == 0, F.to_json(F.struct(F.col("text").alias("response"))))
        .when(shape == 1, F.to_json(F.struct(F.col("text").alias("content"))))
        .when(shape == 2, F.to_json(F.struct(F.array(F.struct(F.col("text").alias("text"))).alias("choices"))))
        .when(shape == 3, F.to_json(F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("message"))).alias("choices"))))
        .when(shape == 4, F.to_json(F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("delta"))).alias("choices"))))
        .when(shape == 5, F.to_json(F.struct(F.col("turn").alias("content"), F.col("text").alias("text"))))
        .when(shape == 6, F.lit('{"response": "  "}'))
        .otherwise(F.lit("{not json"))
    )
    name = F.when(shape.isin(0, 6), "ollama").when(shape.isin(1, 2, 5), "llamacpp").otherwise("groq")
    made = turns.select("conv_id", "turn", name.alias("provider"), body.alias("body"))
    return made.select("conv_id", "turn", "provider", providers.reply_text(F.col("provider"), F.col("body")).alias("reply"))


@query
def provider_resolve(c: Corpus) -> DataFrame:
    asked = c.table("events").select("event_id", F.element_at(F.array(*map(F.lit, ["auto", "Groq", "stub", "llamacpp", "hosted", "other", None, "local"])), (F.col("event_id") % 8 + 1).cast("int")).alias("provider_override"))
    return providers.resolved(asked, "ollama")


@query
def provider_preference(c: Corpus) -> DataFrame:
    """Sources of documents stand for hosts, upper-cased languages for installed models."""
    wanted = c.spark.createDataFrame([(1, "es"), (2, "de"), (3, "en")], "priority int, model string")
    return providers.preferred(F.broadcast(wanted), c.documents.select(F.col("source").alias("host"), F.upper("lang").alias("name")).distinct())


@query
def embedding_reply_parse(c: Corpus) -> DataFrame:
    """Vectors in the forms of several servers' replies."""
    body = (
        F.when(F.col("vec_id") % 4 == 0, F.to_json(F.struct(F.array(F.struct(F.col("v").alias("embedding"))).alias("data"))))
        .when(F.col("vec_id") % 4 == 1, F.to_json(F.struct(F.col("v").alias("embedding"))))
        .when(F.col("vec_id") % 4 == 2, F.lit('{"data": [{"embedding": [1, 2.5]}, {}], "embedding": [3]}'))
        .otherwise(F.lit('{"error": "none"}'))
    )
    made = c.vector_rows.select("vec_id", providers.reply_vectors(body).alias("vectors"))
    return made.select("vec_id", F.size("vectors").alias("n"), F.round(F.aggregate(F.flatten("vectors"), F.lit(0.0), lambda a, x: a + x), 3).alias("total"))


@query
def model_choice(c: Corpus) -> DataFrame:
    """Hosts list their documents' languages as models."""
    langs = c.documents.groupBy(F.col("source").alias("host")).agg(F.array_sort(F.collect_set(F.upper("lang"))).alias("langs")).where("host is not null")
    tags = langs.select("host", F.to_json(F.struct(F.transform("langs", lambda x: F.struct(x.alias("name"))).alias("models"))).alias("body"))
    asked = langs.select("host", F.explode(F.array(F.lit("auto"), F.lit("groq"), F.lit("stub"))).alias("provider_override"))
    silent = tags.withColumn("body", F.when(F.char_length("host") % 2 == 0, F.lit('{"models": [{"name": 3}, "x"]}')).otherwise(F.col("body")))
    wanted = c.spark.createDataFrame([(1, "es"), (2, "de"), (3, "en")], "priority int, model string")
    return providers.chosen(asked, silent, F.broadcast(wanted))


@query
def hosted_models_url(c: Corpus) -> DataFrame:
    """Hosts of pages with the endings that an API's address may have."""
    ends = ["", "/", "/openai/v1", "/openai/v1/", "/openai/v1/chat/completions", "/openai/v1/other", "/v2/chat/completions"]
    given = c.table("pages").select("page_id", F.concat(U.scheme(F.col("url")), F.lit("://"), U.authority(F.col("url")), F.get(F.array(*map(F.lit, ends)), (F.col("page_id") % 7).cast("int"))).alias("api_url"))
    return given.select("page_id", U.models_url(F.col("api_url")).alias("models_url"))


@query
def answer_sanitise(c: Corpus) -> DataFrame:
    told = c.table("conversations").where("role = 'assistant'")
    text = F.concat("text", F.lit(" See [doc_id:1] and [abc:2] deadbeefdeadbeef00: end. This doc_id is known. The end ( ) , then - done."))
    return told.select("conv_id", "turn", P.sanitised(text).alias("answer"))


@query
def excerpts(c: Corpus) -> DataFrame:
    return c.table("conversations").select("conv_id", "turn", P.excerpt(F.col("text"), 120).alias("short"), P.excerpt(F.col("text"), 240).alias("long"))


@query
def last_summary(c: Corpus) -> DataFrame:
    return history.last_answers(c.table("conversations")).select("conv_id", P.last_summary(F.col("text")).alias("summary"))


@query
def recent_questions(c: Corpus) -> DataFrame:
    return history.recent_questions(c.table("conversations"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["confidence"](spark, sf_dir)
