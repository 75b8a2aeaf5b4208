"""Hard cases: large groups, recall, exact thresholds, very long texts, deep pages, plain restatements of what is learned."""

import hashlib
import math
import os
import random
import time
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from ravelin.llm import chat, common, decontamination, html_text, language_model, line_dedup, minhash, packing, suffix_dedup, topk, toxicity
from ravelin.scratch import Scratch
from tests.llm.test_operators import likeness, order, restated_bytes, restated_hits, restated_lines, weighted


def table_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def share_met(got, sets):
    """Number of pairs of different texts that are alike, and the share of them that have one class."""
    label = {r.doc_id: r.class_id for r in got.select("doc_id", "class_id").collect()}
    by: dict = {}
    for doc, cells in sets.items():
        for cell in cells:
            by.setdefault(cell, []).append(doc)
    pairs = met = 0
    for doc, cells in sets.items():
        near = Counter(x for cell in cells for x in by[cell] if x < doc)
        for other, _ in near.items():
            if sets[other] != cells and likeness(sets[other], cells) >= 0.8:
                pairs, met = pairs + 1, met + (label[doc] == label[other])
    return pairs, met / max(pairs, 1)


def near_group(rng, size):
    base = [f"w{rng.randrange(5000)}" for _ in range(110)]
    rows = []
    for k in range(size):
        own = list(base)
        for _ in range(rng.choice([1, 2, 3, 4, 5, 6])):
            own[rng.randrange(110)] = f"v{rng.randrange(40)}"
        rows.append((k, " ".join(own)))
    return rows


def test_recall_in_a_large_group(spark, monkeypatch):
    rows = near_group(random.Random(11), 350)
    sets = {k: weighted(t) for k, t in rows}
    compared = []
    linked = minhash._linked
    monkeypatch.setattr(minhash, "_linked", lambda pairs, *a: compared.append(pairs.count()) or linked(pairs, *a))
    pairs, share = share_met(minhash.near_copies(table_of(spark, rows)), sets)
    assert pairs > 1000 and share >= 0.97
    assert sum(compared) <= len(rows) * minhash.BANDS * (1 + minhash.ROUNDS * minhash.ORDERS * minhash.REACH)
    assert share_met(minhash.near_copies(table_of(spark, rows), every_pair=True), sets) == (pairs, 1.0)


def test_recall_on_a_table(spark, sf001):
    docs = spark.read.parquet(sf001.replace("sf0.001", "sf0.01") + "/documents.parquet").select("doc_id", "text")
    sets = {r.doc_id: weighted(r.text) for r in docs.collect()}
    pairs, share = share_met(minhash.near_copies(docs), {k: v for k, v in sets.items() if v})
    assert pairs > 0 and share >= 0.9


def test_a_pair_exactly_at_the_threshold(spark):
    words = [f"t{k}" for k in range(14)]
    rows = [(1, " ".join(words[:12])), (2, " ".join(words)), (3, " ".join(words[:7])), (4, " ".join(words[:10]))]
    assert likeness(weighted(rows[0][1]), weighted(rows[1][1])) == 0.8
    got = {r.doc_id: r.class_id for r in minhash.near_copies(table_of(spark, rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}  # 6 of 8 and of 10 are less


def test_very_long_texts(spark):
    rng = random.Random(12)
    long = " ".join(f"x{rng.randrange(9999)}" for _ in range(120_000))
    lines = "\n".join(f"line {k}" for k in range(30_000))
    rows = [(1, long), (2, long + " end"), (3, "short text"), (4, lines), (5, lines + "\nmore")]
    docs = table_of(spark, rows)
    assert {r.doc_id: r.class_id for r in minhash.near_copies(docs.where("doc_id < 4")).collect()} == {1: 1, 2: 1, 3: 3}
    items = spark.createDataFrame([(1, " ".join(long.split()[60_000:60_030])), (2, "short")], "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit) for r in decontamination.decontaminate(docs.where("doc_id < 4"), items).collect()}
    assert got == {1: (120_000, 30), 2: (120_001, 30), 3: (2, 1)}
    assert {r.doc_id: r.n_removed for r in line_dedup.dedup_lines(docs.where("doc_id > 3")).select("doc_id", "n_removed").collect()} == {4: 0, 5: 30_000}
    scored = toxicity.score_documents(docs, (np.zeros(1 << toxicity.BITS), 0.0)).collect()
    assert {(r.score, r.predicted) for r in scored} == {(0.5, 1)}  # a tie counts as toxic
    turns = spark.createDataFrame([(1, 0, "ann", long), (1, 1, "bob", "yes")], "conv_id long, turn long, role string, text string")
    assert chat.rotate(turns).agg(F.max(F.char_length("segment"))).first()[0] > len(long)
    odd = spark.createDataFrame([(1, "y" * 500 + " a"), (3, "y" * 500), (4, "a a")], "doc_id long, text string")
    assert {r.doc_id: (r.n_tokens, r.n_known) for r in language_model.score_texts(odd).collect()} == {1: (3, 3), 3: (2, 2), 4: (3, 3)}


def test_repeats_across_stretches(spark, monkeypatch):
    rng = random.Random(13)
    long = bytes(rng.choice(b"abcd efgh") for _ in range(3 * suffix_dedup.STRETCH)).decode()
    at = suffix_dedup.STRETCH - 150
    rows = [(1, long), (2, "start " + long[at : at + 400] + " end"), (3, long[-260:] + "!"), (4, long[: suffix_dedup.STRETCH + 300])]
    got = suffix_dedup.kept_digests(suffix_dedup.removed_spans(table_of(spark, rows)))
    cut = suffix_dedup.STRETCH + 300
    want = {1: (len(long), cut + 260, 2, long[cut:-260]), 2: (410, 400, 1, "start  end"), 3: (261, 260, 1, "!"), 4: (cut, cut, 1, "")}
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()} == {k: (*v[:3], hashlib.sha256(v[3].encode()).hexdigest()) for k, v in want.items()}


def test_short_items_of_every_size(spark):
    rng = random.Random(14)
    words = "aa bb cc dd".split()
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(size * 10 + k, text(size)) for size in range(1, 12) for k in range(2) if size > 2 or k == 0]
    items[0] = (10, "once")
    docs = [(k, text(rng.randrange(25))) for k in range(40)] + [(100, "Once"), (101, "x once"), (102, items[-1][1])]
    for given in (items, items[1:], items[:1]):
        got = decontamination.decontaminate(table_of(spark, docs), spark.createDataFrame(given, "item_id long, text string"))
        assert order(got.collect()) == order(restated_hits(docs, given))


def test_null_ids_and_the_text_null(spark):
    rows = [("null", "a\nb\nc"), (None, "a\nb\nc"), ("b", "d")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    assert {r.doc_id: r.n_removed for r in line_dedup.dedup_lines(docs).collect()} == {"null": 0, None: 3, "b": 0}
    more = [(1, "a\nb\nc"), (None, "a\nb\nc")]
    assert order(line_dedup.dedup_lines(table_of(spark, more)).select("doc_id", "n_lines", "n_removed", "text").collect()) == order(restated_lines(more))


def test_risk_steps_equal_finite_differences():
    rng = np.random.default_rng(15)
    size, prior = 16, 0.3
    draw = lambda n: [np.sort(rng.choice(size, rng.integers(1, 8), replace=False)).astype(np.int32) for _ in range(n)]
    positive, unlabelled = draw(30), draw(50)
    dense = [np.array([np.bincount(d, minlength=size) for d in part], float) for part in (positive, unlabelled)]
    kept = np.flatnonzero(dense[0].sum(0) >= toxicity.LEAST_SEEN)
    xp, xu = (x[:, kept] for x in dense)
    loss = lambda g: np.logaddexp(0, -g)

    def parts(v):
        gp, gu = xp @ v[:-1] + v[-1], xu @ v[:-1] + v[-1]
        return prior * loss(gp).mean(), loss(-gu).mean() - prior * loss(-gp).mean()

    v, squares = np.r_[np.zeros(len(kept)), np.log(prior / (1 - prior))], np.full(len(kept) + 1, 1e-8)
    for _ in range(12):
        risk = (lambda v: sum(parts(v))) if parts(v)[1] >= 0 else (lambda v: -parts(v)[1])
        slope = np.array([(risk(v + e) - risk(v - e)) / 2e-5 for e in 1e-5 * np.eye(len(v))])
        squares += slope**2
        rate = toxicity.RATE / np.sqrt(squares)
        v = v - rate * slope
        v[:-1] = np.sign(v[:-1]) * np.maximum(np.abs(v[:-1]) - rate[:-1] * toxicity.SPARSE, 0)
    weight, bias = toxicity.fit(positive, unlabelled, prior, bits=4, steps=12)
    assert np.allclose(weight[kept], v[:-1], atol=1e-4) and abs(bias - v[-1]) < 1e-4


def test_scores_of_the_model_restated(spark):
    rng = random.Random(16)
    rows = [(i, " ".join(rng.choice(["a", "b", "b c", "A", "d e", f"rare{i % 50}"]) for _ in range(rng.randrange(30)))) for i in range(200)] + [(500, None)]
    got = {r.doc_id: r.score for r in language_model.score_texts(table_of(spark, rows), words=3, most=6, classes=3, head=9).collect()}
    tokens = {doc: [*(text or "").lower().encode().split(), b""] for doc, text in rows}
    learned = {doc: t for doc, t in tokens.items() if zlib.crc32(str(doc).encode()) % 10}
    counts = Counter(x for t in learned.values() for x in t)
    known = sorted((t for t in counts), key=lambda t: (-counts[t], t))[:5]
    number = {t: i + 1 for i, t in enumerate(known)}
    ids = {doc: [number.get(x, 0) for x in [b"", b"", *t]] for doc, t in tokens.items()}
    profiles = np.zeros((6, 2 * language_model.BINS))
    for doc in learned:
        for before, now in zip(ids[doc][1:], ids[doc][2:], strict=False):
            profiles[now, before] += 1
            profiles[before, language_model.BINS + now] += 1
    of = language_model.word_classes(profiles, 3)
    assert of[0] == 0 and set(of[1:]) == {1, 2}
    logs = []
    for k in (1, 2):
        first, second = np.zeros((6, 3)), np.zeros((3, 6))
        for doc in learned:
            for i in range(2, len(ids[doc])):
                first[ids[doc][i - k], of[ids[doc][i]]] += 1
                second[of[ids[doc][i - k]], ids[doc][i]] += 1
        logs.append((language_model.log_probabilities(*language_model.train(first)), language_model.log_probabilities(*language_model.train(second, of), of)))
    rest = sum(counts.values()) - sum(counts[t] for t in known)

    def score(doc, mix):
        total = 0.0
        for i, now in enumerate(ids[doc][2:], 2):
            parts = [10 ** (a[ids[doc][i - k], of[now]] + b[of[ids[doc][i - k]], now]) for k, (a, b) in enumerate(logs, 1)]
            total += math.log10(mix * parts[0] + (1 - mix) * parts[1])
            if not now:
                total += math.log10((counts[tokens[doc][i - 2]] + 0.1) / (rest + 0.1 * (len(counts) - 5 + 1)))
        return total

    best = max(language_model.MIXES, key=lambda m: sum(score(doc, m) for doc in learned))
    for doc in tokens:
        assert abs(got[doc] - score(doc, best)) < 1e-4 * max(1, abs(got[doc]))


def test_words_of_the_model_grow_with_the_corpus(spark, monkeypatch):
    seen = []
    whole = language_model.word_classes
    monkeypatch.setattr(language_model, "word_classes", lambda profiles, classes: seen.append(len(profiles)) or whole(profiles, classes))
    for many in (20, 200):
        rows = [(i, " ".join(f"w{(i * 7 + k) % 90}" for k in range(20))) for i in range(many)]
        language_model.score_texts(table_of(spark, rows), words=4)
    n = [sum(21 for i in range(many) if zlib.crc32(str(i).encode()) % 10) for many in (20, 200)]
    assert seen == [4 + math.isqrt(k) for k in n]


def test_ids_are_those_of_the_tokenizer_on_whole_tables(spark, sf001):
    docs = spark.read.parquet(sf001.replace("sf0.001", "sf0.1") + "/documents.parquet")
    path = packing.default_tokenizer()

    def run(batches):
        made = packing.WordTokenizer.load(path)
        for batch in batches:
            texts = [t or "" for t in batch["text"]]
            plain = made.whole.encode_batch(texts, add_special_tokens=False)
            yield batch[["doc_id"]].assign(same=[np.frombuffer(made.ids(t), "<u4").tolist() == p.ids for t, p in zip(texts, plain, strict=True)])

    got = docs.select("doc_id", "text").repartition(8).mapInPandas(run, "doc_id long, same boolean")
    assert got.where("NOT same").count() == 0


def test_deep_and_long_pages():
    long = "word " * 60
    began = time.process_time()
    for page in ("<div>" * 100_000 + long, "<div>x " * 50_000, "<div><span class=x>" * 50_000 + "</i></section>" * 50_000 + long, "<ul><li>" * 50_000 + long, "<p>a" * 50_000):
        assert html_text.main_text(page)
    assert time.process_time() - began < 60
    assert html_text.main_text("<article>" + f"<p>{long}</p>" * 5000).count("\n\n") == 4999


def test_reader_comments_go_beside_any_name():
    long = "word " * 60
    for name in ("text comment", "comment-body entry-content", "content comments", "comment-list"):
        assert html_text.main_text(f"<article><p>{long}</p><div class='{name}'><p>reader said</p></div></article>") == long.strip()
    assert html_text.main_text(f"<div class='post comments-open'><p>{long}</p></div>") == long.strip()


def test_the_last_plan_does_not_grow_with_the_blocks(spark):
    rows = [(i, [float(i % 13), float(i % 7)]) for i in range(1200)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    plans = [topk.top_k(vectors, every=100, block=block) for block in (100, 2)]
    nodes = [p._jdf.queryExecution().optimizedPlan().toString().count("\n") for p in plans]
    assert nodes[0] == nodes[1] and order(plans[0].collect()) == order(plans[1].collect())


def test_repeated_ids_stay_within_the_training_bounds(spark, monkeypatch):
    hot = next(k for k in range(1000) if zlib.crc32(str(k).encode()) % 5)
    rows = [(hot, f"text number {k}") for k in range(300)] + [(k, f"other text {k}") for k in range(2000, 2200)]
    labels = spark.createDataFrame([(hot, 1)] + [(k, 0) for k in range(2000, 2010)], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda positive, unlabelled, prior, bits: seen.append(([p.tobytes() for p in positive], [u.tobytes() for u in unlabelled])))
    for parts in (1, 5):
        toxicity.train(table_of(spark, rows).repartition(parts), labels, most_positive=20, most_unlabelled=30)
    assert [len(x) for x in seen[0]] == [20, 30] and seen[0] == seen[1]


def test_neighbours_do_not_depend_on_the_partitions(spark):
    rng = np.random.default_rng(6)
    rows = [(int(rng.integers(3)), k, 40, 38, k // 7, rng.bytes(2 * minhash.ORDERS * minhash.DEPTH)) for k in range(400)]
    banded = spark.createDataFrame(rows, "bucket long, id long, n long, s long, label long, far binary").repartition(5)
    was = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    found = {}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        for parts in (1, 4, 40, 200):
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            scratch = minhash.Scratch(spark)
            found[parts] = {tuple(r) for r in minhash._neighbours(scratch, "n", banded, 1, 0.8).collect()}
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    line = sorted((b, far[2 * minhash.DEPTH : 4 * minhash.DEPTH], i, label) for b, i, _, _, label, far in rows)
    want = {(min(x[2], y[2]), max(x[2], y[2])) for k, x in enumerate(line) for y in line[k + 1 : k + 1 + minhash.REACH] if x[0] == y[0] and x[3] != y[3]}
    assert all(pairs == want for pairs in found.values())


def test_words_of_the_model_are_exact_under_ties(spark):
    counts = [(f"t{k:03d}".encode(), 5 if k < 20 else 7 if k < 30 else 1) for k in range(60)]
    table = spark.createDataFrame(counts, "token binary, c long").repartition(3)
    ranked = sorted(counts, key=lambda t: (-t[1], t[0]))
    for most in (1, 10, 13, 29, 30, 31, 60, 99):
        assert language_model.frequent_tokens(table, most) == ranked[:most]
    assert language_model.frequent_tokens(table.limit(0), 5) == []
    docs = table_of(spark, [(k, " ".join(f"w{chr(97 + i)}" for i in range(20))) for k in range(12)])
    scores = [sorted(map(tuple, language_model.score_texts(docs, words=30, classes=3, head=head).collect())) for head in (10, 30, 1000)]
    assert scores[0] == scores[1] == scores[2]


def test_long_tokens_are_words_like_others(spark):
    ruler = "=" * 500
    assert language_model.tokens_of(f"a {ruler} B") == [b"a", b" " + hashlib.sha256(ruler.encode()).digest(), b"b"]
    docs = table_of(spark, [(k, f"head {ruler} text {'x' * 70 + str(k % 3)}") for k in range(40)])
    got = language_model.score_texts(docs, words=30, classes=3).collect()
    learned = [k for k in range(40) if zlib.crc32(str(k).encode()) % 10]
    tokens = [t for k in learned for t in ["head", ruler, "text", "x" * 70 + str(k % 3), ""]]
    c, n, v = Counter(tokens), len(tokens), len(set(tokens))
    for r in got:
        own = ["head", ruler, "text", "x" * 70 + str(r.doc_id % 3), ""]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (5, sum(t in c for t in own), n)
        assert math.isclose(r.base_score, sum(math.log10((c[t] + 0.1) / (n + 0.1 * (v + 1))) for t in own), rel_tol=1e-9)
        assert r.score > r.base_score


def test_large_blocks_of_queries_take_few_passes(spark, monkeypatch):
    rng = np.random.default_rng(4)
    held = rng.normal(size=(300, 4)).round(1)
    table = spark.createDataFrame([(k, row.tolist()) for k, row in enumerate(held)], "vec_id long, embedding array<float>")
    whole = np.floor(held.astype(np.float32).astype(float) * 1024).astype(np.int64)
    score = whole @ whole.T
    want = {(q, n + 1, c, int(score[q, c])) for q in range(300) for n, c in enumerate(sorted((c for c in range(300) if c != q), key=lambda c, q=q: (-score[q, c], c))[:10])}
    passes = []
    counted = topk._count
    monkeypatch.setattr(topk, "_count", lambda *a: passes.append(len(a[1]["ids"])) or counted(*a))
    monkeypatch.setattr(topk, "CELLS", 300 * 80)
    assert {tuple(r) for r in topk.top_k(table, every=1).collect()} == want
    assert len(passes) <= 8 and set(passes) == {300}


def test_every_link_of_a_large_group_counts(spark, monkeypatch):
    rows = near_group(random.Random(21), 60)
    sets = [weighted(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if label[i] != label[j] and likeness(sets[i], sets[j]) >= 0.8:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    # hub and neighbours find nothing, so that all links are left to the last step, which deals every bucket into several parts
    monkeypatch.setattr(minhash, "_linked", lambda pairs, *_: pairs.limit(0))
    for name, value in (("ROUNDS", 1), ("ORDERS", 1), ("REACH", 0), ("PART", 6000)):
        monkeypatch.setattr(minhash, name, value, raising=False)
    docs = table_of(spark, rows)
    assert [r.class_id for r in minhash.near_copies(docs).orderBy("doc_id").collect()] == label
    assert {r.doc_id for r in minhash.drop_near_copies(docs).collect()} == set(label)


def test_repeats_leave_neither_tables_nor_shuffles(spark):
    folder = suffix_dedup.Scratch(spark).root.rsplit("/", 1)[0].removeprefix("file://")
    was = set(os.listdir(folder))
    rng = random.Random(15)
    body = "".join(rng.choice("abcdefgh ") for _ in range(900))
    docs = table_of(spark, [(1, body), (2, body[:500] + "!" + body[500:]), (3, body[100:]), (4, body)])
    seen = []
    found = suffix_dedup.repeated_windows(docs)
    for name in set(os.listdir(folder)) - was:
        seen += os.listdir(f"{folder}/{name}")
    assert seen == ["windows"] and found.count() == 3
    assert spark.conf.get(suffix_dedup.CLEANUP, None) is None


def batch_settings(spark, monkeypatch):
    """The setting of a batch's bytes while each table is written."""
    seen, write = [], Scratch.table
    monkeypatch.setattr(Scratch, "table", lambda self, df, name: (seen.append(spark.conf.get(common.BATCH, None)), write(self, df, name))[1])
    return seen


def test_repeats_are_found_in_small_batches_and_one_python_step_is_left(spark, monkeypatch):
    seen = batch_settings(spark, monkeypatch)
    monkeypatch.setattr(common, "BATCH_BYTES", 3000)
    rng = random.Random(16)
    body = "".join(rng.choice("abcdefgh ") for _ in range(900))
    rows = [(i, body[20 * i : 20 * i + 400] + str(i) * 30) for i in range(20)] + [(30, body), (31, body), (32, None), (33, "x")]
    out = suffix_dedup.kept_digests(suffix_dedup.removed_spans(table_of(spark, rows).coalesce(1)))
    assert set(seen) == {"3000"} and spark.conf.get(common.BATCH, None) is None
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert order(out.collect()) == order(restated_bytes(rows))


def test_toxic_rows_go_without_a_way_through_python(spark, monkeypatch):
    seen = batch_settings(spark, monkeypatch)
    bad, good = "vile nasty words here", "calm plain words there"
    rows = [(i, f"{bad if i % 3 == 0 else good} {i % 5}") for i in range(60)] + [(None, f"{bad} 1"), (3, f"{bad} 3"), (70, None), (71, ""), (71, "")]
    docs = table_of(spark, rows).select("doc_id", "text", F.lit(7).alias("k1"))
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(0, 60)], "doc_id long, toxic int")
    weight, bias = toxicity.train(docs, labels)
    want = [(i, t, 7) for i, t in rows if bias + weight.astype(np.float32)[toxicity.features(t)].sum(dtype=np.float64) < 0]
    out = toxicity.drop_toxic(docs, labels)
    assert 0 < len(want) < len(rows) and out.columns == docs.columns
    assert order(out.collect()) == order(want)
    assert seen == [str(common.BATCH_BYTES)] and spark.conf.get(common.BATCH, None) is None
    assert "MapInArrow" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_classes_are_the_same_in_small_batches(spark, monkeypatch):
    seen = batch_settings(spark, monkeypatch)
    rng = random.Random(17)
    base = [[str(rng.randrange(500)) for _ in range(60)] for _ in range(4)]
    rows = [(i, " ".join([*base[i % 4][:-1], f"w{i}"])) for i in range(80)]
    found = []
    for size in (1 << 26, 2000):
        monkeypatch.setattr(common, "BATCH_BYTES", size)
        found.append(order(minhash.near_copies(table_of(spark, rows).coalesce(1)).collect()))
    assert found[0] == found[1] and {r[1] for r in found[0]} == {0, 1, 2, 3}
    assert {str(1 << 26), "2000"} <= set(seen)


def test_pieces_are_written_in_small_batches(spark, monkeypatch):
    seen = batch_settings(spark, monkeypatch)
    assert packing.pack_documents(table_of(spark, [(1, "a b c"), (2, None)])).count() == 2
    assert seen == [str(common.BATCH_BYTES)]
