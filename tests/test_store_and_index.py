import random
import tempfile
import threading
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ravelin.config import EngineConfig
from ravelin.functions import vectors as V
from ravelin.operators import nearest, retrieval, vector_index
from ravelin.operators.graph import degrees
from ravelin.operators.versions import Conflict, Snapshots
from ravelin.plans import catalogue
from ravelin.plans.ask import ask
from ravelin.scratch import file_system, together
from ravelin.streaming import ingest

DOCS = "doc_id long, title string, text string"
NAMES = ("documents", "chunks", "mentions", "about", "entities", "vectors")
SMALL = EngineConfig(embedding_dim=16, chunk_tokens=4, chunk_overlap=1)


def new():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def rows_of(tables, names=NAMES):
    return {n: sorted((tuple(map(str, r)) for r in tables.read(n).drop("seq").collect()), key=repr) for n in names}


def size_of(store, names):
    """Bytes of all files of some tables."""
    total = 0
    for name in names:
        path, fs = file_system(store.spark, f"{store.root}/data/{name}")
        total += fs.getContentSummary(path).getLength()
    return total


# --- commits ---


def test_of_two_writers_none_loses_rows(spark):
    store = Snapshots(spark, new())
    one = lambda k: spark.createDataFrame([(k, f"v{k}", 1)], "id long, v string, seq int")
    store.upsert("t", one(1), ["id"])
    a, b = store.begin(), store.begin()
    a.upsert("t", one(2), ["id"]), b.upsert("t", one(3), ["id"])
    a.commit()
    with pytest.raises(Conflict):
        b.commit()
    b.discard()
    assert {r.id for r in store.read("t").collect()} == {1, 2}
    failed = []

    def writer(k):
        try:
            Snapshots(spark, store.root).commit(lambda c: c.upsert("t", one(k), ["id"]), tries=12)
        except Exception as error:
            failed.append(error)

    threads = [threading.Thread(target=writer, args=(10 + k,)) for k in range(4)]
    [t.start() for t in threads], [t.join() for t in threads]
    assert not failed and {r.id for r in store.read("t").collect()} == {1, 2, 10, 11, 12, 13}
    with pytest.raises(Conflict):
        store.take(store.version(), store.begin().state)


def test_a_version_that_was_made_in_spite_of_an_error_keeps_its_files(spark, monkeypatch):
    store = Snapshots(spark, new())
    take = store.take

    def lost(version, state):
        take(version, state)
        raise OSError("the answer was lost")

    monkeypatch.setattr(store, "take", lost)
    rows = spark.createDataFrame([(1, "a")], "id long, v string")
    with pytest.raises(OSError):
        store.write("t", rows, ["id"])
    assert [tuple(r) for r in Snapshots(spark, store.root).read("t").collect()] == [(1, "a")]
    change = store.begin()
    change.put("t", rows, rows, ["id"])
    take(2, change.state)
    take(2, change.state)  # the same again is no conflict
    with pytest.raises(Conflict):
        take(2, store.begin().state)


def test_a_crash_between_tables_shows_nothing(spark, monkeypatch):
    store = Snapshots(spark, new())
    ingest.ingest(store, spark.createDataFrame([(1, "a", "Alpha beta text")], DOCS), 0, SMALL)
    before, version = rows_of(store), store.version()
    monkeypatch.setattr(ingest, "put_vectors", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        ingest.ingest(store, spark.createDataFrame([(1, "b", "Gamma rays"), (2, "c", "More")], DOCS), 1, SMALL)
    assert rows_of(store) == before and store.version() == version


def test_steps_at_the_same_time_all_end_and_one_error_leaves_nothing(spark):
    assert together(spark, lambda: spark.range(3).count(), lambda: spark.range(5).count()) == [3, 5]
    store, ended = Snapshots(spark, new()), []
    rows = spark.createDataFrame([(1, "a")], "id long, v string")

    def fails():
        raise RuntimeError("stop")

    def slow():
        time.sleep(0.5)
        ended.append(1)

    with pytest.raises(RuntimeError, match="stop"):
        store.commit(lambda c: together(spark, lambda: c.put("t", rows, rows, ["id"]), fails, slow))
    # the folder of the step that was done is gone, as no version names it
    assert ended == [1] and store.version() == 0 and not store._named(f"{store.root}/data/t")
    store.commit(lambda c: together(spark, *(lambda n=n: c.put(n, rows, rows, ["id"]) for n in ("t", "u", "w"))))
    assert store.version() == 1 and all(store.read(n).collect() == rows.collect() for n in ("t", "u", "w"))


def test_readers_keep_their_version_and_old_ones_expire(spark):
    store = Snapshots(spark, new())
    made = lambda rows: spark.createDataFrame(rows, "id long, v string")
    opened = store.write("t", made([(1, "a"), (2, "b")]), ["id"])
    store.replace("t", made([(1, "c"), (1, "d"), (None, "n")]), made([(1, ""), (3, ""), (None, "")]), ["id"])
    assert sorted(map(tuple, store.read("t").collect()), key=repr) == [(1, "c"), (1, "d"), (2, "b"), (None, "n")]
    assert {tuple(r) for r in opened.collect()} == {(1, "a"), (2, "b")} == {tuple(r) for r in store.read("t", 1).collect()}
    store.replace("t", made([]), made([(1, ""), (None, "")]), ["id"])
    assert [tuple(r) for r in store.read("t").collect()] == [(2, "b")]
    n = len(store._named(f"{store.root}/data/t"))
    store.expire(1)  # folders may still belong to a writer
    assert len(store._named(f"{store.root}/data/t")) == n and len(store.versions()) == 1
    store.fold("t"), store.expire(1, grace=0)
    assert [tuple(r) for r in store.read("t").collect()] == [(2, "b")] and len(store._named(f"{store.root}/data/t")) == 1
    with pytest.raises(ValueError):
        store.write("t", made([]), ["id"]) and store.replace("t", made([]), made([]), ["v"])


def test_changes_equal_a_model_of_them(spark, monkeypatch):
    """Random puts, sums and folds against a dictionary."""
    from ravelin.operators import versions

    monkeypatch.setattr(versions, "MOST_CHANGES", 3)
    monkeypatch.setattr(versions, "BUCKET_BYTES", 1500)
    rng, store, held, sums = random.Random(5), Snapshots(spark, new(), buckets=2), {}, {}
    for step in range(7):
        ids = rng.sample([None, *range(12)], 5)
        rows = [(i, f"{step}-{k}") for i in ids for k in range(rng.randrange(3))]
        amounts = [(i, rng.randrange(-2, 3)) for i in ids]
        store.commit(lambda c, rows=rows, ids=ids: c.put("t", spark.createDataFrame(rows, "id long, v string"), spark.createDataFrame([(i,) for i in ids], "id long"), ["id"]))
        store.commit(lambda c, amounts=amounts: c.add("s", spark.createDataFrame(amounts, "id long, n long"), ["id"]))
        for i in ids:
            held[i] = [v for j, v in rows if j == i]
        for i, n in amounts:
            sums[i] = sums.get(i, 0) + n
        assert sorted(map(tuple, store.read("t").collect()), key=repr) == sorted(((i, v) for i, vs in held.items() for v in vs), key=repr)
        assert {tuple(r) for r in store.read("s").collect()} == {(i, n) for i, n in sums.items() if n}
    found = store.begin().lookup("t", spark.createDataFrame([(3,), (None,), (99,)], "id long")).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(((i, v) for i in (3, None) for v in held.get(i, [])), key=repr)
    store.fold("t")
    assert store.state()["tables"]["t"]["buckets"] > 2 and sorted(r.v for r in store.read("t").collect()) == sorted(v for vs in held.values() for v in vs)


def test_what_a_batch_writes_does_not_grow_with_the_table(spark):
    wrote = []
    for n in (200, 5000):
        store = Snapshots(spark, new())
        store.write("t", spark.range(n).select(F.col("id"), F.sha2(F.col("id").cast("string"), 256).alias("v")), ["id"])
        before = size_of(store, ["t"])
        rows = spark.range(60).select((F.col("id") * 3).alias("id"), F.sha2(F.col("id").cast("string"), 512).alias("v"))
        change = store.begin()
        change.put("t", rows, rows, ["id"])
        change.commit()
        wrote.append(size_of(store, ["t"]) - before)
        assert store.read("t").count() == n
    assert wrote[1] < 1.2 * wrote[0]


def test_health_does_not_fail_with_a_table(spark):
    store = Snapshots(spark, new())
    ingest.ingest(store, spark.createDataFrame([(1, "a", "Alpha beta text"), (2, "b", None)], DOCS), 0, SMALL)
    path, fs = file_system(spark, f"{store.root}/data/about")
    fs.delete(path, True)
    got = {r.name: r for r in store.health().collect()}
    assert got["documents"].n_rows == 2 and got["documents"].n_broken_keys == 0 and got["documents"].error is None
    assert got["about"].error and got["about"].n_rows is None
    assert (got["vectors"].provider, got["vectors"].dimension, got["vectors"].path) == ("stub", 16, store.root)


# --- ingest ---

BATCHES = [
    [(i, f"t{i}", f"Alpha number{i} words and Beta Gamma rays in it") for i in range(30)],
    [(2, "late", "Gamma rays"), (2, "later", "Delta rays"), (41, None, None)],
    [(3, "c", "Omega rays"), (None, "n", "Nobody here"), (5, "gone", "")],
]


def test_stream_equals_batch_and_goes_on(spark):
    folder, checkpoint, path, other = (new() for _ in range(4))
    write = lambda n: spark.createDataFrame(BATCHES[n], DOCS).coalesce(1).write.mode("append").parquet(folder)
    write(0), write(1)
    ingest.start(spark, folder, DOCS, Snapshots(spark, path), checkpoint, config=SMALL).awaitTermination()
    assert {r.chunk_id: r.text for r in Snapshots(spark, path).read("chunks").where("doc_id = 2").collect()} == {"2-0": "Delta rays"}
    write(2)
    again = spark.newSession()
    ingest.start(again, folder, DOCS, Snapshots(again, path), checkpoint, config=SMALL).awaitTermination()
    reopened, once = Snapshots(again, path), Snapshots(spark, other)
    for n, rows in enumerate(BATCHES):
        ingest.ingest(once, spark.createDataFrame(rows, DOCS).coalesce(1), n, SMALL)
    counts = ingest.ingest(once, spark.createDataFrame(BATCHES[2], DOCS).coalesce(1), 2, SMALL)  # a batch replayed
    assert counts.pop("latency_ms") > 0 and counts == {"documents": 3, "chunks": 2, "mentions": 4, "vectors": 2}
    assert rows_of(once) == rows_of(reopened)
    # degrees that follow changes are those of all edges at once
    entities = {r.entity: (r.degree, r.n_docs) for r in reopened.read("entities").collect()}
    assert {e: d for e, (d, _) in entities.items() if d} == {r.entity: r.degree for r in degrees(reopened.read("about")).collect()}
    assert {e: n for e, (_, n) in entities.items() if n} == {r.entity: r.n for r in reopened.read("mentions").groupBy("entity").agg(F.count("*").alias("n")).collect()}
    assert entities["omega"] == (1, 1) and entities["delta"] == (1, 1) and entities["beta"][1] == 27 and "late" not in entities
    texts = {r.chunk_id: r.text for r in reopened.read("chunks").collect()}
    assert {r.chunk_id: list(r.v) for r in reopened.read("vectors").collect()} == {c: V.hash_vector(t, 16) for c, t in texts.items()}


def test_an_older_batch_changes_nothing_in_any_table(spark):
    store = Snapshots(spark, new())
    ingest.ingest(store, spark.createDataFrame([(1, "new", "Delta rays"), (2, "x", "Other words")], DOCS), 5, SMALL)
    before = rows_of(store)
    ingest.ingest(store, spark.createDataFrame([(1, "old", "Alpha beta gamma")], DOCS), 0, SMALL)
    assert rows_of(store) == before
    ingest.ingest(store, spark.createDataFrame([(1, "old", "Alpha beta gamma"), (3, "y", "Third text")], DOCS), 4, SMALL)
    after = rows_of(store)
    assert [r for r in after["documents"] if r[0] != "3"] == before["documents"] and len(after["documents"]) == 3
    assert {r.entity for r in store.read("entities").collect()} == {"delta", "rays", "other", "words", "third", "text"}


def constant(value):
    def made(dim):
        @F.pandas_udf("array<double>")
        def embed(texts: pd.Series) -> pd.Series:
            if (texts == "Bad words").any():
                raise OSError("no answer")
            return texts.map(lambda t: [value] * dim)

        return embed

    return made


def test_another_embedding_embeds_all_chunks_anew(spark, monkeypatch):
    monkeypatch.setitem(V.EMBEDDERS, "ones", constant(1.0))
    store = Snapshots(spark, new())
    ingest.ingest(store, spark.createDataFrame(BATCHES[0][:5], DOCS), 0, SMALL)
    ingest.build_index(store)
    assert store.property("embedding") == {"provider": "stub", "dimension": 16} and store.read("codes").count() == store.read("chunks").count()
    other = EngineConfig(embedding="ones", embedding_dim=8, chunk_tokens=4, chunk_overlap=1)
    ingest.ingest(store, spark.createDataFrame([(99, "z", "Last text")], DOCS), 1, other)
    assert store.property("embedding") == {"provider": "ones", "dimension": 8} and store.read("codes") is None
    assert store.read("vectors").count() == store.read("chunks").count() and {tuple(r.v) for r in store.read("vectors").collect()} == {(1.0,) * 8}
    # what the provider fails on waits
    ingest.ingest(store, spark.createDataFrame([(100, "z", "Bad words")], DOCS), 2, other)
    assert store.read("vectors").where("doc_id = 100").count() == 0 and store.read("chunks").where("doc_id = 100").count() == 1
    monkeypatch.setitem(V.EMBEDDERS, "ones", lambda dim: F.pandas_udf(lambda s: s.map(lambda t: [1.0] * dim), "array<double>"))
    assert ingest.embed_missing(store) == 1 and store.read("vectors").where("doc_id = 100").count() == 1


def test_stream_reopen_and_ask(spark):
    folder, checkpoint, path = (new() for _ in range(3))
    rng = random.Random(7)
    names = [f"{a}{b}" for a in ("Kor", "Mel", "Tan", "Vir") for b in ("ada", "ilo", "una", "ex")]
    docs = [(i, f"title {i}", f"{rng.choice(names)} met {rng.choice(names)} near place{i} on day{i}") for i in range(60)]
    for k in range(0, 60, 20):
        spark.createDataFrame(docs[k : k + 20], DOCS).coalesce(1).write.mode("append").parquet(folder)
    ingest.start(spark, folder, DOCS, Snapshots(spark, path), checkpoint, config=SMALL).awaitTermination()
    batch = Snapshots(spark, new())
    ingest.ingest(batch, spark.createDataFrame(docs, DOCS), 0, SMALL)
    questions = spark.createDataFrame([("a", "Where was Korada?", 3), ("b", "who was at place7", 2), ("c", "xx yy", 4), ("d", docs[11][2], 150), ("e", None, None)], "q_id string, question string, top_k int")
    reopened = Snapshots(spark.newSession(), path)
    ingest.build_index(reopened)
    got = {}
    for name, store, exact in (("batch", batch, True), ("exact", reopened, True), ("index", reopened, False)):
        found = ask(store, questions, SMALL, exact)
        got[name] = sorted(map(tuple, found.hits.collect()), key=repr)
        assert found.answers.count() == 5 and found.citations.where("snippet IS NULL OR title IS NULL").count() == 0
    assert got["batch"] == got["exact"]
    modes = {r.q_id: r.mode for r in found.plans.collect()}
    assert modes["a"] == "GRAPH" and modes["c"] == modes["e"] == "VECTOR"
    assert {h for h in got["index"] if h[1] == "GRAPH"} == {h for h in got["exact"] if h[1] == "GRAPH"}
    assert len(got["index"]) == len(got["exact"])


# --- vectors ---


def test_nearest_takes_each_dimension_and_leaves_out_what_has_no_numbers(spark):
    rows = [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [1.0]), (5, [None, 1.0]), (6, [float("nan"), 0.0]), (7, [0.0, 0.0]), (None, [0.0, 0.0]), (8, [])]
    vectors = spark.createDataFrame(rows, "id long, v array<double>")
    asked = spark.createDataFrame([("a", [0.0, 0.0], 3), ("b", [0.5], 9), ("c", None, 2), ("d", [1.0, 2.0, 3.0], 2)], "q_id string, qv array<double>, top_k int")
    got = sorted((r.q_id, r["rank"], r.id, r.score) for r in retrieval.nearest(asked, vectors).collect() if r.id)
    assert got == [("a", 2, 1, 0.0), ("a", 3, 7, 0.0), ("b", 1, 4, 0.25)]


def test_nearest_equals_all_distances(spark, monkeypatch):
    monkeypatch.setattr(nearest, "HELD", 50)
    monkeypatch.setattr(nearest, "CELLS", 300)
    rng = np.random.default_rng(3)
    held = rng.normal(size=(300, 5)).round(1)
    held[100:200] = held[0]  # many at one distance
    asked = rng.normal(size=(20, 5)).round(1)
    vectors = spark.createDataFrame([(f"v{i:03d}", row.tolist()) for i, row in enumerate(held)], "id string, v array<float>").repartition(3)
    queries = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(asked)], "q_id long, qv array<float>")
    held, asked = held.astype(np.float32).astype(float), asked.astype(np.float32).astype(float)
    want = set()
    for q, row in enumerate(asked):
        far = [(round(sum((x - y) ** 2 for x, y in zip(row, other, strict=True)), 9), f"v{i:03d}") for i, other in enumerate(held)]
        want |= {(q, name, far_, k + 1) for k, (far_, name) in enumerate(sorted(far)[:7])}
    assert {(r.q_id, r.id, round(r.score, 9), r["rank"]) for r in retrieval.nearest(queries, vectors, 7, block=6).collect()} == want


def clustered(rng, n, dim=32, groups=40):
    centres = rng.normal(size=(groups, dim)) * 2
    return centres[rng.integers(groups, size=n)] + rng.normal(size=(n, dim))


@pytest.mark.parametrize("hot", [False, True])
def test_the_index_finds_nine_of_ten(spark, monkeypatch, hot):
    monkeypatch.setattr(vector_index, "PART", 200)
    monkeypatch.setattr(vector_index, "QUERIES", 7)
    rng = np.random.default_rng(1)
    held = clustered(rng, 3000)
    if hot:
        held[:1000] = held[0] + rng.normal(size=(1000, 32)) * 1e-3  # a third of all rows in one cell
    rows = [(i, row.tolist()) for i, row in enumerate(held)] + [(3000, None), (3001, [1.0])]
    vectors = spark.createDataFrame(rows, "id long, v array<double>").repartition(4)
    queries = vectors.where("id % 50 = 0 AND id < 3000").select(F.col("id").alias("q_id"), F.col("v").alias("qv"))
    model = vector_index.Model.from_bytes(vector_index.fit(vectors, 32, sample=1500).to_bytes())
    coded = vector_index.codes(vectors, model)
    assert coded.count() == 3000
    got = {(r.q_id, r.id) for r in vector_index.search(queries, vectors, coded, model, 10).collect()}
    want = {(r.q_id, r.id) for r in retrieval.nearest(queries, vectors, 10).collect()}
    assert len(want) == 600 == len(got) and len(got & want) >= 0.9 * len(want)
    every = {(r.q_id, r.id) for r in vector_index.search(queries, vectors, coded, model, 10, probes=10**6, refine=400).collect()}
    assert every == want
    assert vector_index.search(queries.limit(0), vectors, coded, model, 10).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_the_index_on_given_vectors(spark, sf001, sf):
    vectors = spark.read.parquet(f"{sf001}/../{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    dim = vectors.agg(F.max(F.size("v"))).first()[0]
    queries = vectors.where("id % 50 = 0").select(F.col("id").alias("q_id"), F.col("v").alias("qv"))
    model = vector_index.fit(vectors, dim)
    got = {(r.q_id, r.id) for r in vector_index.search(queries, vectors, vector_index.codes(vectors, model), model, 10).collect()}
    want = {(r.q_id, r.id) for r in retrieval.nearest(queries, vectors, 10).collect()}
    print("recall", sf, len(got & want) / len(want), "cells", len(model.centres), "probes", model.probes, "refine", model.refine)
    assert len(got & want) >= 0.9 * len(want)


def test_settings():
    env = {"RAVELIN_CRAWL_DEPTH": "0", "RAVELIN_CRAWL_RATE_SEC": "0.25", "RAVELIN_ALLOW_URLS": "Yes", "RAVELIN_TOP_K": "0", "RAVELIN_EMBEDDING": " Stub ", "RAVELIN_MODEL_TIMEOUT_SEC": "x", "RAVELIN_CRAWL_PAGES": "-1"}
    got = EngineConfig.from_env(env)
    assert (got.crawl_depth, got.crawl_rate_sec, got.allow_urls, got.top_k, got.embedding, got.model_timeout_sec, got.crawl_pages) == (0, 0.25, True, 6, "stub", 20.0, 5)
    assert EngineConfig.from_env({}) == EngineConfig()


def test_time_of_search_over_all_cores(spark):
    """A million distances of 64 dimensions in seconds, not minutes."""
    rng = np.random.default_rng(2)
    vectors = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(rng.normal(size=(4000, 64)))], "id long, v array<double>")
    queries = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(rng.normal(size=(500, 64)))], "q_id long, qv array<double>")
    began = time.time()
    assert retrieval.nearest(queries, vectors, 10).count() == 5000 and time.time() - began < 30


def test_ingest_entities_keeps_no_folders_that_its_store_no_longer_names(spark, sf001, monkeypatch):
    made, key = [], "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    monkeypatch.setattr(catalogue, "Snapshots", lambda s: made.append(Snapshots(s)) or made[-1])
    seen, commit = [], Snapshots.commit
    monkeypatch.setattr(Snapshots, "commit", lambda self, change: seen.append(spark.conf.get(key)) or commit(self, change))
    was = spark.conf.get(key, None)
    assert catalogue.QUERIES["ingest_entities"](spark, sf001).count() > 0
    store = made[0]
    named = {(n, p) for n, t in store.state()["tables"].items() for p in [*t["base"], *(c["part"] for c in t["changes"])]}
    assert {(n, p.removeprefix("_part=")) for n in store._named(f"{store.root}/data") for p in store._named(f"{store.root}/data/{n}")} == named
    assert store.versions() == [store.version()] and seen == ["true"] * 4 and spark.conf.get(key, None) == was
