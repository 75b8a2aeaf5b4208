"""Each operator against a plain restatement, over crafted rows with nulls, ties, repeats and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ravelin.llm import chat, decontamination, html_text, language_model, line_dedup, minhash, suffix_dedup, topk, toxicity

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TO_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def documents(spark, rows, kind="doc_id long, text string"):
    """Rows with further columns whose names clash with those that operators make."""
    made = spark.createDataFrame(rows, kind)
    for name in ("k1", "rid", "id", "label", "lines", "bucket", "score", "n_lines", "piece", "token", "h", "i", "_0"):
        made = made.withColumn(name, F.lit(None).cast("string"))
    return made


def order(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def words_of(text):
    return WORD.findall((text or "").translate(TO_LOWER))


# --- 1 ---


def test_every_perspective_renders_the_dialogue(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 2, "ann", "yo"), (None, None, None, "lost"), (2, 0, "system", "alone"), (1, 1, "ann", "hi")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("name", F.lit("x")).withColumn("part", F.lit(1)).withColumn("start", F.lit(0))
    got = chat.rotate(turns).collect()
    shown = {}
    for r in sorted(got, key=lambda r: r.position):
        shown.setdefault((r.conv_id, r.perspective), []).append(r)
    assert set(shown) == {(1, "ann"), (1, "bob"), (None, "unknown")}
    for (_, me), parts in shown.items():
        whole = "".join(p.segment for p in parts)
        assert [p.position for p in parts] == list(range(len(parts)))
        for p in parts:
            assert whole[p.start : p.start + p.length] == p.segment
            assert p.mask == (p.speaker == me) == (p.role == "assistant")
            if p.mask:
                assert whole[p.mask_start : p.mask_start + p.mask_length].endswith(chat.END) and p.segment.startswith("<|assistant|>\n")
            elif p.role == "user":
                assert p.segment.startswith(f"<|user name={p.speaker}|>\n")
    assert "".join(p.segment for p in shown[(1, "bob")]) == "<|system|>\nbe kind<|end|>\n<|user name=ann|>\nhi<|end|>\n<|user name=ann|>\nhi<|end|>\n<|user name=ann|>\nyo<|end|>\n<|assistant|>\n<|end|>\n"
    assert chat.rotate(turns.limit(0)).count() == 0


# --- 2 ---


def restated_hits(docs, items):
    out = []
    for doc, text in docs:
        words = words_of(text)
        hit, found = set(), set()
        for item, given in items:
            own = words_of(given)
            size = min(10, len(own))
            for k in range(len(own) - size + 1 if own else 0):
                for i in range(len(words) - size + 1):
                    if words[i : i + size] == own[k : k + size]:
                        hit.update(range(i, i + size))
                        found |= {str(item)} if item is not None else set()
        names = ",".join(sorted(found))
        out.append((doc, len(words), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return out


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(2)
    line = lambda n: " ".join(rng.choice("aa Bb cc É é dd9".split()) for _ in range(n))
    items = [(1, line(10)), (2, line(25)), (3, "Short one"), (4, None), (None, line(12)), (5, "...")]
    items += [(6, items[1][1]), (6, line(14)), (10, "x " * 30)]
    docs = [(None, None), (0, ""), (7, "SHORT, one"), (8, "x " * 11), (8, "x " * 11), (9, items[0][1])]
    docs += [(20 + i, " ".join([line(rng.randrange(9)), *rng.sample(items[1][1].split(), 3), items[i % 2][1][rng.randrange(9) :], line(3)])) for i in range(30)]
    got = decontamination.decontaminate(documents(spark, docs), spark.createDataFrame(items, "item_id long, text string").withColumn("size", F.lit(1)))
    assert order(got.collect()) == order(restated_hits(docs, items))
    big = decontamination.small
    decontamination.small = lambda df: df
    try:  # the way beyond a broadcast
        assert order(decontamination.decontaminate(documents(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()) == order(restated_hits(docs, items))
    finally:
        decontamination.small = big
    none = spark.createDataFrame([], "item_id long, text string")
    assert not any(r.contaminated for r in decontamination.decontaminate(documents(spark, docs), none).collect())
    assert decontamination.decontaminate(documents(spark, []), none).count() == 0


def test_decontamination_of_repetitive_text(spark):
    runs = [" ".join((phrase.split() * 60)[:n]) for phrase in ("no", "0", "a b", "a b c", "p q r s", "t u v w x", "1 2 3 4 5 6", "f g h i j k l") for n in (17, 40)]
    items = [*enumerate(runs[::3]), *((100 + k, f"0 0 0 0 0 {a} b c d e") for k, a in enumerate("abcdefgh"))]
    docs = [*enumerate(runs), *((100 + k, "0 " * 30 + f"{a} b c d e end") for k, a in enumerate("abcdefgh")), (200, "no " * 25 + "0 " * 25 + "a b " * 20)]
    got = decontamination.decontaminate(documents(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    assert order(got.collect()) == order(restated_hits(docs, items))
    whole = decontamination.decontaminate(documents(spark, [(1, "no " * 40)]), spark.createDataFrame([(1, "no " * 40)], "item_id long, text string"))
    assert whole.first().n_hit == 40


# --- 3 ---


def test_toxicity_learns_and_handles_empty_tables(spark):
    rng = random.Random(1)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}x" for i in range(200)]
    docs, labels = [], []
    for i in range(1500):
        bad = i % 4 == 0
        docs.append((i, " ".join(rng.sample(words, 30) + (rng.sample(["vile", "nasty", "awful"], 2) if bad else []))))
        labels.append((i, int(bad)))
    docs += [(None, None), (9999, ""), (9999, "")]
    made = spark.createDataFrame(labels + [(3, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.toxicity(documents(spark, docs), made).collect()
    held = [r for r in got if r.held_out and r.doc_id < 1500]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert len(got) == len(docs) and sum(r.predicted == (r.doc_id % 4 == 0) for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    kept = toxicity.drop_toxic(documents(spark, docs), made)
    assert kept.columns == documents(spark, docs).columns and 1000 < kept.count() < 1250
    assert {r.score for r in toxicity.toxicity(documents(spark, docs), made.limit(0)).collect()} == {0.0}
    assert toxicity.toxicity(documents(spark, []), made).count() == 0


# --- 4 ---


def restated_lines(rows):
    seen, gone = set(), {}
    ranked = sorted({r for r in rows if r[1] is not None}, key=lambda r: (r[0] is None, r[0] or 0))
    for doc, text in ranked:
        lines = text.split("\n")
        for i in range(len(lines) - 2):
            w = tuple(lines[i : i + 3])
            if w in seen:
                gone.setdefault((doc, text), set()).update(range(i, i + 3))
            seen.add(w)
    out = []
    for doc, text in rows:
        lines = text.split("\n") if text is not None else []
        cut = gone.get((doc, text), set())
        out.append((doc, len(lines), len(cut), None if text is None else "\n".join(x for i, x in enumerate(lines) if i not in cut)))
    return out


def test_line_windows_equal_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, "\n".join(rng.choice("ab") for _ in range(rng.randrange(12)))) for i in range(40)]
    rows += [(50, None), (51, ""), (52, "a\nb"), (53, "x\ny\nz\n"), (53, "x\ny\nz\n"), (None, "x\ny\nz\n"), (54, "\n" * 9)]
    got = line_dedup.dedup_lines(documents(spark, rows)).select("doc_id", "n_lines", "n_removed", "text")
    assert order(got.collect()) == order(restated_lines(rows))
    assert line_dedup.dedup_lines(documents(spark, [])).count() == 0


# --- 5 ---


def restated_bytes(rows):
    count = Counter((t or "").encode()[p : p + 200] for _, t in rows for p in range(len((t or "").encode()) - 199))
    out = []
    for doc, text in rows:
        data = (text or "").encode()
        mark = bytearray(len(data))
        for p in range(len(data) - 199):
            if count[data[p : p + 200]] > 1:
                mark[p : p + 200] = b"\1" * 200
        spans = sum(1 for i, m in enumerate(mark) if m and not (i and mark[i - 1]))
        out.append((doc, len(data), sum(mark), spans, hashlib.sha256(bytes(b for b, m in zip(data, mark, strict=True) if not m)).hexdigest()))
    return out


def test_repeated_strings_equal_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    some = lambda n: "".join(rng.choice("ab c") for _ in range(n))
    base = [some(900) for _ in range(3)]
    rows = []
    for i in range(40):
        whole, a = rng.choice(base), rng.randrange(600)
        rows.append((i if i % 7 else None, some(rng.randrange(150)) + whole[a : a + rng.randrange(150, 500)] + some(rng.randrange(150))))
    rows += [(100, "x" * 1000), (101, None), (102, ""), (103, "ab" * 300), (104, "ab" * 90), (105, "é" * 150), (106, rows[0][1]), (106, rows[0][1])]
    got = suffix_dedup.kept_digests(suffix_dedup.removed_spans(documents(spark, rows)))
    assert order(got.collect()) == order(restated_bytes(rows))
    assert suffix_dedup.kept_digests(suffix_dedup.removed_spans(documents(spark, []))).count() == 0


def test_runs_do_not_depend_on_stretches(monkeypatch):
    rng = random.Random(5)
    data = bytes(rng.choice(b"ab c") for _ in range(3000))
    whole = [(a, s, e) for start, x in suffix_dedup.stretches(data) for a, s, e in zip(*x.runs(), strict=True)]
    monkeypatch.setattr(suffix_dedup, "STRETCH", 700)
    sample = lambda runs: {w: a for a, s, e in runs for w in range(s, e + 1)}
    parts = [(a + start, s + start, e + start) for start, x in suffix_dedup.stretches(data) for a, s, e in zip(*x.runs(), strict=True)]
    assert sample(parts) == sample(whole) and len(sample(whole)) == 2801


# --- 7 ---


PAGE = """<html><head><title>t</title></head><body><header>Site</header><div id="left-sidebar"><p>{long}</p></div>
<div class="content"><h1>Title &amp; more</h1><p>Short.</p><p>A <b>lo</b>nger  paragraph,\n{long} end.<br>next</p><p class="notice">notice {long}</p><p>Bye</p></div>
<div class="comments"><p>{long}</p></div><form>f</form><script>var x = "<p>s</p>"</script><footer>f</footer></body></html>"""


def test_main_text(spark):
    long = " ".join(["word"] * 40)
    want = f"Title & more\n\nShort.\n\nA longer paragraph, {long} end. next\n\nBye"
    assert html_text.main_text(PAGE.format(long=long)) == want
    assert html_text.main_text(f"<nav>menu<article><h2>H</h2><p>{long}<p>b</article><aside>{long * 9}</aside>") == f"H\n\n{long}\n\nb"
    assert [html_text.main_text(x) for x in (None, "", "<p>a &lt; b</p>", "<!-- x", "<div class=ad>never")] == ["", "", "a < b", "", ""]
    div = f'<div class="content has-sidebar"><article><header class="entry-header"><h1>T</h1></header><p>{long}</p><p class="notice">no<p>yes <a class="share" href="x">s</a>more</p></article><section id="comments">{long}</section></div>'
    assert html_text.main_text(div) == f"T\n\n{long}\n\nyes more"
    plain = f'<div class="wrap"><ul class="menu"><li>m</li></ul><div class="post-body text"><p>{long}</p><table><tr><td>c</td></tr></table></div><div class="relatedPosts">{long * 3}</div><div role="navigation">n</div></div>'
    assert html_text.main_text(plain) == f"{long}\n\nc"
    pages = spark.createDataFrame([(1, "u", PAGE.format(long=long)), (None, None, None)], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    assert order(html_text.extract(pages).collect()) == order([(1, "u", want, len(want)), (None, None, "", 0)])
    assert html_text.extract(pages.limit(0)).count() == 0


def test_missing_end_tags_lose_no_text():
    long = " ".join(["word"] * 40)
    text = html_text.main_text
    for head in ("<html><head><title>t</title><body>", "<html><head><meta charset=x><title>t</title><link href=s>\n", "<head><style>s</style><header>Site</header>"):
        assert text(f"{head}<p>{long}<p>{long}b") == f"{long}\n\n{long}b"
    assert text(f"<head><title>t</title> {long}<p>b") == f"{long}\n\nb"
    for own, other in (("li", "li"), ("dt", "dd"), ("dd", "dt")):
        around = "ul" if own == "li" else "dl"
        assert text(f"<div><{around}><{other}>a<{own} class=share>s<b>x<ul><li>y</ul><{other}>{long}</{around}><p>{long}c</p></div>") == f"a\n\n{long}\n\n{long}c"
        assert text(f"<div><{around}><{other}>a<{own} class=share>s</{around}><p>{long}</p></div>") == f"a\n\n{long}"
    table = f"<div><table><tr><td>a<td class=ad>x<table><tr><td>y<td>z</table><td>b<tr class=ad><td>n<th>n<tr><th>c<th class=ad>x<tbody class=ad><tr><td>n<tbody><tr><td>d<td class=ad>x</table><p>{long}</p></div>"
    assert text(table) == f"a\n\nb\n\nc\n\nd\n\n{long}"
    assert text(f"<article><div>a <span class=share>s</div><p>{long}</p><div><aside>n</div><p>b</article>") == f"a\n\n{long}\n\nb"


def test_all_stretches_of_an_article_are_kept():
    a, b, c = (" ".join([x * 5] * n) for x, n in (("a", 150), ("b", 80), ("c", 30)))
    items = [f"item {k}" for k in range(5)]
    listed = "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
    want = "\n\n".join(["A", a, *items, "B", b])
    sections = f"<div class=section><h2>A</h2><p>{a}</p></div>{listed}<div class=section><h2>B</h2><p>{b}</p></div>"
    menu = "<div><ul>" + "".join(f"<li>entry {k}" for k in range(9)) + "</ul></div>"
    assert html_text.main_text(f"<div id=content>{sections}</div>") == want
    assert html_text.main_text(f"<body>{sections}</body>") == want
    assert html_text.main_text(f"<div><div id=content><div>{sections}</div></div>{menu}</div>") == want
    assert html_text.main_text(f"<article><h2>A</h2><p>{a}</p></article>{listed}<article><h2>B</h2><p>{b}</p></article>") == f"A\n\n{a}\n\nB\n\n{b}"
    assert html_text.main_text(f"<main><article><p>{a}</p></article>{listed}<article><p>{b}</p></article><p>{c}</p></main>") == "\n\n".join([a, *items, b, c])
    links = "".join(f"<p><a href=x>link {b}</a></p>" for _ in range(3))
    assert html_text.main_text(f"<div><div id=content><h2>A</h2><p>{a}</p></div><div>{links}</div></div>") == f"A\n\n{a}"


# --- 8 ---


def weighted(text):
    words = words_of(text)
    size = min(5, len(words))
    return Counter(tuple(words[i : i + size]) for i in range(len(words) - size + 1)) if words else Counter()


def likeness(a, b):
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both)


def test_signatures_estimate_weighted_likeness():
    rng = np.random.default_rng(1)
    for _ in range(5):
        names = rng.integers(0, 2**62, 60).astype(np.uint64)
        x, y = rng.uniform(0.1, 3, 60), rng.uniform(0.1, 3, 60)
        same = (minhash.signature(names, x, 2000) == minhash.signature(names, y, 2000)).mean()
        assert abs(same - np.minimum(x, y).sum() / np.maximum(x, y).sum()) < 0.06
    assert not minhash.signature(names[:0], x[:0]).any()


def test_near_copies_equal_brute_force(spark):
    rng = random.Random(6)
    line = lambda n: [f"w{rng.randrange(500)}" for _ in range(n)]
    rows, k = [], 0
    for _ in range(12):
        base = line(rng.randrange(40, 120))
        for _ in range(rng.randrange(1, 12)):
            own = list(base)
            for _ in range(rng.randrange(5)):
                own[rng.randrange(len(own))] = f"v{rng.randrange(9)}"
            rows.append((k, " ".join(own)))
            k += 1
    rows += [(900, "One two"), (901, "one, TWO"), (902, None), (903, ""), (904, "..."), (905, rows[0][1]), (905, rows[0][1]), (None, rows[0][1].upper())]
    sets = [weighted(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and likeness(sets[i], sets[j]) >= 0.8:
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    first = {}
    for n, (doc, _) in enumerate(rows):
        first.setdefault(label[n], []).append(doc)
    want = order((doc, min(x for x in first[label[n]] if x is not None), len(first[label[n]])) for n, (doc, _) in enumerate(rows))
    docs = documents(spark, rows)
    got = minhash.near_copies(docs)
    assert order(got.select("doc_id", "class_id", "class_size").collect()) == want
    assert got.where("kept").count() == len(first)
    kept = minhash.drop_near_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len(first)
    assert minhash.near_copies(documents(spark, [])).count() == 0


# --- 9 ---


def test_language_model_scores(spark):
    rng = random.Random(7)
    rows = []
    for i in range(300):
        words = ["a"]
        for _ in range(rng.randrange(60)):
            words.append({"a": "b", "b": "c", "c": "a"}[words[-1]] if rng.random() < 0.8 else rng.choice("abc"))
        rows.append((i, " ".join(words + ([f"Rare{i} x"] if i % 5 == 0 else []))))
    rows += [(1000, None), (1001, ""), (None, "a b"), (7, "a b c")]
    got = language_model.score_texts(documents(spark, rows), words=3, head=4).collect()
    assert len(got) == len(rows)
    counts = Counter()
    for doc, text in rows:
        if doc is not None and zlib.crc32(str(doc).encode()) % 10:
            counts.update([*(text or "").encode().lower().split(), b""])
    n, v = sum(counts.values()), len(counts)
    by = {(r.doc_id, r.n_tokens, round(r.base_score, 6), r.n_known) for r in got}
    for doc, text in rows:
        tokens = [*(text or "").encode().lower().split(), b""]
        base = sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens)
        assert (doc, len(tokens), round(base, 6), sum(t in counts for t in tokens)) in by
    assert {r.train_tokens for r in got} == {n}
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert language_model.score_texts(documents(spark, [])).count() == 0


def test_model_is_normalised():
    pairs = np.random.default_rng(1).integers(0, 50, (20, 20)).astype(float)
    table = language_model.log_probabilities(*language_model.train(pairs, dimensions=4, steps=30))
    assert np.allclose((10**table).sum(1), 1)


# --- 10 ---


def test_topk_equals_brute_force_with_ties(spark):
    rng = random.Random(8)
    rows = [(i, [rng.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(3)]) for i in range(400)]
    rows += [(500, [0.5, 0.5]), (600, None), (601, [0.1, None, 0.2]), (602, [float("nan"), 0.0, 0.0]), (603, [float("inf"), 0.0, 0.0]), (None, [1.0, 1.0, 1.0]), (700, []), (100, [0.25, 0.5, 0.75]), (7, [9.0, 9.0, 9.0]), (7, [9.0, 9.0, 9.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit(1)).withColumn("score", F.lit(1)).repartition(5)
    good = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q in {i for i, _ in good if i % 100 == 0}:
        own = min(v for i, v in good if i == q)
        near = sorted((-sum(a * b for a, b in zip(own, v, strict=True)), i) for i, v in good if i != q and len(v) == len(own))[:10]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(near)]
    assert order(topk.top_k(table).collect()) == order(want)
    assert order(topk.top_k(table, block=2).collect()) == order(want)
    assert topk.top_k(table.limit(0)).count() == 0


@pytest.mark.parametrize("bins", [2, 7])
def test_few_bins_give_the_same(spark, bins):
    rows = [(i, [float((i * 37) % 11), float(i % 5)]) for i in range(300)]
    whole = topk.whole_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    mine = whole.where("vec_id % 100 = 0").collect()
    got = topk.search_block(whole, mine, 10, 2e5, 0, 299, bins=bins).groupBy("query_id").count().collect()
    assert [r["count"] for r in got] == [10, 10, 10]
