import math
import random
import time

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ravelin.config import EngineConfig
from ravelin.functions import vectors as V
from ravelin.operators import answer, chunking, graph, planner, providers, retrieval, store
from ravelin.operators.versions import Snapshots
from ravelin.plans import catalogue
from ravelin.plans.corpus import Corpus, placed
from ravelin.scratch import Scratch, file_system


@pytest.fixture(scope="module")
def small(spark):
    chunks = spark.createDataFrame([("d1-0", 1, 0, "Alpha works with alphabet"), ("d1-1", 1, 1, "beta text"), ("d2-0", 2, 0, "Beta and Alpha")], "chunk_id string, doc_id long, ord int, text string")
    found = spark.createDataFrame([(1, "alpha"), (1, "beta"), (2, "beta"), (2, "alpha"), (2, "ghost\nword")], "doc_id long, entity string")
    return chunks, found


def test_edges_join_by_document_and_substring(small):
    chunks, found = small
    about = graph.about_edges(found, chunks)
    assert {(r.chunk_id, r.entity) for r in about.collect()} == {("d1-0", "alpha"), ("d1-1", "beta"), ("d2-0", "beta"), ("d2-0", "alpha")}
    assert {(r.entity, r.degree) for r in graph.degrees(about).collect()} == {("alpha", 2), ("beta", 2)}
    assert [r.entity for r in graph.orphans(found, about).collect()] == ["ghost\nword"]


def test_long_documents_meet_their_entities_in_parts(spark):
    words = ["north", "southern", "eastward", "the west"]
    texts = [(f"{d}-{k}", d, k, f"{words[k % 4].title()} of {words[(k * 7 + d) % 4]} {k}") for d, n in ((1, 200), (2, 3), (3, 64), (4, 65)) for k in range(n)]
    names = [(d, e) for d in (1, 2, 3, 4, 5) for e in ("north", "south", "west", "absent")]
    about = graph.about_edges(spark.createDataFrame(names, "doc_id long, entity string"), spark.createDataFrame(texts, "chunk_id string, doc_id long, ord int, text string"))
    want = sorted((c, d, k, e) for c, d, k, t in texts for i, e in names if i == d and e in t.lower())
    assert sorted(tuple(r) for r in about.collect()) == want
    bare = spark.createDataFrame([], "chunk_id string, doc_id long, ord int, text string")
    assert graph.about_edges(spark.createDataFrame(names, "doc_id long, entity string"), bare).count() == 0


def test_planner_modes(spark):
    questions = spark.createDataFrame([("a", "about Alpha", 4), ("b", "about Beta", None), ("c", "zzzz", None), ("d", None, 0)], "q_id string, question string, top_k int")
    degree = spark.createDataFrame([("alpha", 5), ("beta", 1)], "entity string, degree long")
    got = {r.q_id: r for r in planner.plan(questions, planner.question_entities(questions, degree)).collect()}
    assert [(got[q].mode, got[q].top_k, got[q].entities) for q in "abcd"] == [("GRAPH", 4, ["alpha"]), ("HYBRID", 6, ["beta"]), ("VECTOR", 6, []), ("VECTOR", 1, [])]


def test_vector_graph_hybrid_and_dispatch(spark, small):
    chunks, found = small
    about = graph.about_edges(found, chunks)
    vectors = spark.createDataFrame([("d1-0", "d1-0", 1, 0, [1.0, 0.0, 0.0]), ("d1-1", "d1-1", 1, 1, [0.8, 0.1, 0.0]), ("d2-0", "d2-0", 2, 0, [0.0, 1.0, 0.0])], "id string, chunk_id string, doc_id long, ord int, v array<double>")
    queries = spark.createDataFrame([("a", [1.0, 0.0, 0.0], 2), ("z", [0.0, 1.0, 0.0], 1)], "q_id string, qv array<double>, top_k int")
    near = retrieval.nearest(queries, vectors).drop("id")
    assert [(r.chunk_id, r.rank) for r in near.where("q_id = 'a'").orderBy("rank").collect()] == [("d1-0", 1), ("d1-1", 2)]
    plans = spark.createDataFrame([("a", "HYBRID", 2), ("z", "GRAPH", 1)], "q_id string, mode string, top_k int")
    entities = spark.createDataFrame([("a", "alpha", 2), ("a", "beta", 2), ("z", "none", 0)], "q_id string, entity string, degree long")
    hits = retrieval.graph_hits(plans, entities, about)
    assert [(r.chunk_id, r.entity) for r in hits.orderBy("rank").collect()] == [("d1-0", "alpha"), ("d2-0", "alpha")]
    assert [r.chunk_id for r in retrieval.hybrid_hits(near.where("q_id = 'a'"), hits).collect()] == ["d1-0"]
    sent = retrieval.dispatched(plans, near, hits).collect()
    assert {(r.q_id, r.source, r.chunk_id) for r in sent} == {("a", "hybrid", "d1-0"), ("z", "vector", "d2-0")}
    assert retrieval.insertion_order(queries, vectors, 2).count() == 4


def test_graph_hits_reach_the_largest_top_k(spark):
    about = spark.range(250).selectExpr("concat('d', id) AS chunk_id", "id AS doc_id", "0 AS ord", "'alpha' AS entity")
    plans = spark.createDataFrame([("a", "GRAPH", 180), ("b", "HYBRID", 2), ("c", "GRAPH", 300)], "q_id string, mode string, top_k int")
    entities = spark.createDataFrame([(q, "alpha", 250) for q in "abc"], "q_id string, entity string, degree long")
    hits = retrieval.graph_hits(plans, entities, about)
    assert {r.q_id: (r.n, r.last) for r in hits.groupBy("q_id").agg(F.count("*").alias("n"), F.max("doc_id").alias("last")).collect()} == {"a": (180, 179), "b": (2, 1), "c": (250, 249)}
    late = spark.createDataFrame([("a", "d150", 0.5, 1), ("a", "d240", 0.6, 2)], "q_id string, chunk_id string, score double, rank int")
    assert [r.chunk_id for r in retrieval.hybrid_hits(late, hits).collect()] == ["d150"]
    assert retrieval.graph_hits(plans.limit(0), entities, about).count() == 0


def test_gaps_in_vector_ids_lose_no_chunk(spark, small):
    ids = [7, 3, 900, 12, 45, 3, None]
    vectors = spark.createDataFrame([(x, [float(x or 0)]) for x in ids], "vec_id long, v array<double>")
    for parts in (1, 3):
        got = placed(vectors.repartition(parts), "vec_id", Scratch(spark)).collect()
        assert sorted((r.vec_id, r.place) for r in got) == [(3, 0), (7, 1), (12, 2), (45, 3), (900, 4)]
    corpus = Corpus(spark, "", EngineConfig())
    corpus.vector_rows, corpus.chunks = vectors.where("vec_id <> 3"), small[0]
    corpus.plans = spark.createDataFrame([("a", "VECTOR", 9, "x"), ("b", "HYBRID", 9, "xyz")], "q_id string, mode string, top_k int, question string")
    assert corpus.vector_hits.groupBy("q_id").count().orderBy("q_id").collect() == [("a", 3), ("b", 3)]


def test_retrieval_by_the_embedders_vectors(spark, small):
    embed = V.embedder("auto", 16)(F.col("text"))
    vectors = small[0].select(F.col("chunk_id").alias("id"), "chunk_id", "doc_id", "ord", embed.alias("v"))
    asked = spark.createDataFrame([("a", "beta text", 2), ("b", "Beta and Alpha", 1)], "q_id string, text string, top_k int").select("q_id", embed.alias("qv"), "top_k")
    best = {r.q_id: (r.chunk_id, r.score) for r in retrieval.nearest(asked, vectors).where("rank = 1").collect()}
    assert best == {"a": ("d1-1", 0.0), "b": ("d2-0", 0.0)}


def test_nearest_in_blocks_and_its_plan(spark):
    vectors = spark.createDataFrame([(i, [float(i % 7), float(i)]) for i in range(60)], "id long, v array<double>")
    asked = spark.createDataFrame([(f"q{i}", [float(i), 2.0 * i], 1 + i % 5) for i in range(23)], "q_id string, qv array<double>, top_k int")
    whole = retrieval.nearest(asked, vectors)
    assert "WindowGroupLimit" in whole._jdf.queryExecution().toString()
    rows = sorted(map(tuple, whole.collect()))
    assert rows == sorted(map(tuple, retrieval.nearest(asked, vectors, block=4).select(*whole.columns).collect())) and len(rows) == sum(1 + i % 5 for i in range(23))
    assert retrieval.nearest(asked.limit(0), vectors).count() == 0 and retrieval.nearest(asked, vectors.limit(0)).count() == 0


def test_hits_without_stored_rows(spark):
    hits = spark.createDataFrame([("a", None, None, None, 1)], "q_id string, chunk_id string, doc_id long, score double, rank int")
    chunks, docs = spark.createDataFrame([], "chunk_id string, text string"), spark.createDataFrame([], "doc_id long, title string")
    cited = answer.cited(hits, chunks, docs)
    assert (cited.first().score, cited.first().title, cited.first().snippet) == (0.0, None, None)
    assert cited.select(answer.context_line().alias("line")).first().line == "[unknown:] unknown: "
    assert answer.shown(cited).first().citation_id == "unknown:"


def test_a_failing_embedder_gives_way_to_the_built_in_one(spark, monkeypatch):
    def failing(dim):
        @F.pandas_udf("array<double>")
        def embed(texts: pd.Series) -> pd.Series:
            if (texts == "bad").any():
                raise OSError("no answer")
            return texts.map(lambda t: [1.0] * (dim if t != "short" else 1))

        return embed

    monkeypatch.setitem(V.EMBEDDERS, "failing", failing)
    for texts, by in ((["a", "b"], "failing"), (["a", "bad"], "stub"), (["short", "a"], "stub")):
        rows = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select("t", V.embedded(F.col("t"), "failing", 8).alias("e")).select("t", "e.*")
        got = {r.t: (r.provider, list(r.v)) for r in rows.collect()}
        assert {g[0] for g in got.values()} == {by}
        assert got["a"][1] == ([1.0] * 8 if by == "failing" else V.hash_vector("a", 8))
        assert {r.error for r in store.dimension_errors(rows, 8, provider="failing").collect()} == {None if by == "failing" else "provider"}
    bare = spark.createDataFrame([("a",), (None,)], "t string").coalesce(1).select("t", V.embedded(F.col("t"), "auto", 8).alias("e")).select("t", "e.*")
    assert {(r.t, r.provider, r.v and len(r.v)) for r in bare.collect()} == {("a", "stub", 8), (None, "stub", None)}


def test_hash_vectors(spark):
    assert V.safe_embedder("missing", 8)[1] == "stub" and V.safe_embedder("auto", 8)[1] == "auto"
    import random, hashlib

    assert math.isclose(random.Random(hashlib.sha256(b"alpha").digest()).uniform(-1.0, 1.0), -0.415986384672117)
    got = spark.createDataFrame([("alpha",), ("alpha",), (None,)], "t string").select(V.embedder("auto", 384)(F.col("t")).alias("v")).collect()
    assert len(got[0].v) == 384 and got[0].v == got[1].v and got[2].v is None
    assert math.isclose(sum(x * x for x in got[0].v), 1.0)
    with pytest.raises(ValueError):
        V.embedder("other")


def test_answers(spark):
    plans = spark.createDataFrame([("a", "GRAPH", "q?"), ("b", "VECTOR", " r ")], "q_id string, mode string, question string")
    hits = spark.createDataFrame([("a", "1-0", 1, 0.5, 1), ("a", "1-1", 1, 1.5, 2)], "q_id string, chunk_id string, doc_id long, score double, rank int")
    chunks = spark.createDataFrame([("1-0", "one\ntwo"), ("1-1", "x " * 600)], "chunk_id string, text string")
    docs = spark.createDataFrame([(1, "")], "doc_id long, title string")
    cited = answer.cited(hits, chunks, docs)
    got = {r.q_id: r for r in answer.answers(plans, cited).collect()}
    assert (got["a"].confidence, got["b"].confidence, got["b"].n_citations) == (0.5, 0.5, 0)
    lines = cited.select("q_id", "rank", answer.context_line().alias("line"))
    prompts = {r.q_id: r.prompt for r in answer.prompts(plans, lines).collect()}
    assert "[1:1-0] 1: one two\n[1:1-1] 1: x x" in prompts["a"] and prompts["a"].split("\n")[3].endswith("…") and answer.NOTHING in prompts["b"]
    replies = spark.createDataFrame([("a", " yes ")], "q_id string, reply string")
    assert {r.q_id: r.answer for r in answer.replied(plans, replies, "ollama").collect()} == {"a": "yes", "b": answer.FAILED + answer.STUB_ANSWER}
    assert {r.title for r in answer.shown(cited).collect()} == {"Untitled"}


def test_merges(spark):
    rows = spark.createDataFrame([("k", "a", 1), ("k", "b", 2), ("m", "c", 1)], "id string, v string, seq int")
    assert {(r.id, r.v) for r in store.merged(rows, ["id"], "seq").collect()} == {("k", "b"), ("m", "c")}
    assert {(r.id, r.v) for r in store.merged(rows, ["id"], "seq", "first").collect()} == {("k", "a"), ("m", "c")}
    tables = Snapshots(spark)
    opened = tables.upsert("t", rows.where("seq = 1"), ["id"])
    tables.upsert("t", rows.where("seq = 2"), ["id"])
    assert {(r.id, r.v) for r in tables.read("t").collect()} == {("k", "b"), ("m", "c")} and opened.count() == 2
    assert [tuple(r)[:5] for r in tables.health().collect()] == [("t", 2, 2, 3, 0)]
    ties = spark.createDataFrame([("k", "b", 1), ("k", "a", 1), ("k", None, None), (None, "n", 1)], "id string, v string, seq int")
    assert {(r.id, r.v) for r in store.merged(ties, ["id"], "seq").collect()} == {("k", "b"), (None, "n")}
    assert [r.n for r in store.broken_keys(rows, ["id"]).collect()] == [2]
    names = spark.createDataFrame([("Alpha", 1), ("ALPHA", 2)], "name string, seq int")
    assert [store.entity_nodes(names, k).first().name for k in ("first", "last")] == ["Alpha", "ALPHA"]


def test_validation(spark):
    rows = [("a", "q", None, None), ("b", "", None, None), ("c", "q", 0, None), ("d", "q", 1, "else"), ("e", "é" * 4, 1, "stub")]
    asked = spark.createDataFrame(rows, "q_id string, question string, top_k int, provider_override string")
    assert [r.error for r in planner.validated(asked, EngineConfig(ask_bytes=7)).orderBy("q_id").collect()] == [None, "blank_question", "top_k_below_1", "unknown_provider", "too_large"]


def test_providers_as_plug_ins(spark, monkeypatch):
    def slow(config):
        return lambda prompt: time.sleep(30) if "wait" in prompt else f"slow {prompt}"

    def failing(config):
        def model(prompt):
            if "bad" in prompt:
                raise ConnectionError("no answer")
            return 7 if "number" in prompt else " " if "blank" in prompt else f"{config.top_k} {prompt}"

        return model

    def closed(config):
        raise OSError("not there")

    for name, made in (("slow", slow), ("failing", failing), ("closed", closed)):
        monkeypatch.setitem(providers.MODELS, name, made)
    asked = spark.createDataFrame([("a", "good"), ("b", "wait"), ("c", "bad"), ("d", "number"), ("e", "blank"), ("f", None), *((f"w{k}", "wait") for k in range(10))], "q_id string, prompt string").coalesce(1)
    config, began = EngineConfig(model_timeout_sec=0.5, top_k=3), time.monotonic()
    got = {r.q_id: r for r in answer.answered(asked, "slow", config).collect()}
    assert time.monotonic() - began < 20 and (got["a"].answer, got["a"].error) == ("slow good", None)
    assert {got[q].error for q in got if q[0] in "bw"} == {"timeout"} and got["b"].answer == answer.FAILED + answer.STUB_ANSWER and got["b"].latency_ms == 500
    got = {r.q_id: r for r in answer.answered(asked, "failing", config).collect()}
    assert [got[q].error for q in "abcdef"] == [None, None, "ConnectionError", "TypeError", "empty", None] and (got["a"].answer, got["f"].answer) == ("3 good", "3")
    assert {r.error for r in answer.answered(asked, "closed", config).collect()} == {"OSError"} and answer.answered(asked.limit(0), "closed", config).count() == 0
    assert {(r.provider, r.answer, r.error) for r in answer.answered(asked, "stub", config).collect()} == {("stub", answer.STUB_ANSWER, None)}
    with pytest.raises(ValueError):
        answer.answered(asked, "unheard of")


def test_first_titles_and_requests(spark):
    cited = spark.createDataFrame([("a", 1, " "), ("a", 2, None), ("a", 3, " Third "), ("a", 4, "Fourth"), ("b", 1, "")], "q_id string, rank int, title string")
    asked = spark.createDataFrame([("a",), ("b",), ("c",)], "q_id string")
    assert {tuple(r) for r in answer.first_titles(asked, cited).collect()} == {("a", "Third"), ("b", "Untitled"), ("c", "Untitled")}
    rows = [(1, " https://a.b ", 0, 1), (2, "\u00a0", None, None), (3, None, 1, 1), (4, "HTTP://a", 1, 1), (5, "http://a", -1, 0), (6, "http://a", None, 0)]
    got = planner.validated_urls(spark.createDataFrame(rows, "i int, url string, max_depth int, max_pages int")).orderBy("i").collect()
    assert [(r.url, r.error) for r in got] == [("https://a.b", None), ("\u00a0", "empty_url"), (None, "blank_url"), ("HTTP://a", "not_http"), ("http://a", "max_depth_below_0"), ("http://a", "max_pages_below_1")]
    toggles = spark.createDataFrame([(1, " OLLAMA"), (2, "stub"), (3, None)], "i int, provider string")
    assert [(r.provider, r.error) for r in planner.validated_toggles(toggles).orderBy("i").collect()] == [("ollama", None), ("stub", "unknown_provider"), (None, "blank_provider")]


def linked_texts():
    rng = random.Random(3)
    words = ["North", "of", "Southern Sea", "eastward", "thé", "wörd", "one_two", "McDonald", "St9", "Ends\x1cHere", "a\xa0b", "KelvinK", "İstanbul Road", "\n", "end-less", "ABCDe"]
    texts = [" ".join(rng.choice(words) for _ in range(n)) for n in (0, 1, 3, 8, 20, 21, 90, 400, 2000)]
    return [(k, t) for k, t in enumerate([*texts, None, "", "In The North\nOf Southern Lands " * 9])]


@pytest.mark.parametrize("rows", [linked_texts(), [*linked_texts(), (3, "Other Words here"), (7, "North again"), (None, "Lost Text"), (None, "Lost Text again")]])
def test_links_hold_mentions_and_edges(spark, rows):
    """What the joins of mentions and chunks give, worked out document by document; rows of one id (or none) meet as before."""
    config = EngineConfig(chunk_tokens=8, chunk_overlap=2)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    linked = Scratch(spark).table(graph.links(docs, config), "links")
    found, made = graph.mentions(docs, config), chunking.chunks(docs, config)
    sort = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert sort(graph.linked_mentions(linked)) == sort(found)
    assert sort(graph.linked_edges(linked)) == sort(graph.about_edges(found, made).select("chunk_id", "doc_id", "ord", "entity"))


def test_links_of_distinct_documents_are_not_shuffled(spark):
    """Each document is read once where it lies, and batches of results are bounded by entities, not by documents."""
    docs = spark.createDataFrame(linked_texts(), "doc_id long, text string").coalesce(1)
    plan = graph.links(docs)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan and "Join" not in plan
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int32())])
    made = graph._in_batches(((k, graph.ENTITIES // 4) for k in range(41)), schema, lambda row: row[1])
    assert [batch.num_rows for batch in made] == [4] * 10 + [1]
    few = graph._few(iter([pa.record_batch([list(range(1000))], names=["x"])]))
    assert [x for x, in few] == list(range(1000))


def test_edges_are_linked_once_and_before_their_entities_are_met(spark):
    edges = spark.createDataFrame([("c1", "a", "R"), ("c1", "a", "R"), ("c1", "a", "S"), ("c2", "a", "R"), ("c9", "a", "R"), ("c1", "z", "R")], "chunk_id string, entity_id string, rel string")
    kept = store.linked(edges.unionByName(edges), spark.createDataFrame([("c1",), ("c2",)], "chunk_id string"), spark.createDataFrame([("a",)], "entity_id string"))
    assert sorted(map(tuple, kept.select("chunk_id", "entity_id", "rel").collect())) == [("c1", "a", "R"), ("c1", "a", "S"), ("c2", "a", "R")]
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("LeftSemi") < plan.index("Aggregate")


@pytest.mark.parametrize("name", ["graph_topk", "store_linked_edges", "key_constraints", "citations", "context_lines", "prompt_shortened", "stub_answers"])
def test_queries_of_the_graph_write_one_table_of_links(spark, sf001, name):
    """Mentions and edges are read from it; neither is written, and none is made by joining names with chunks."""
    df = catalogue.QUERIES[name](spark, sf001)
    held = Corpus.of(spark, sf001)
    path, fs = file_system(spark, held.scratch.root)
    names = {s.getPath().getName() for s in fs.listStatus(path)}
    assert "links" in names and not names & {"mentions", "about"}
    assert df.count() > 0 and held.about.inputFiles() == held.mentions.inputFiles() == held.links.inputFiles()
