"""Every stage of the pipeline against a plain restatement on its own input."""

import zlib

import numpy as np
import pytest

import corpus_pipeline
from ravelin.llm import packing
from ravelin.scratch import Scratch
from test_operators import documents, likeness, restated_lines, weighted, words_of


@pytest.fixture(scope="module")
def steps(spark, sf001):
    docs, scratch = spark.read.parquet(f"{sf001}/documents.parquet"), Scratch(spark)
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(scratch.table(stage(spark, out[-1], sf001), name))
    return out


def rows_of(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns_and_order(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]
    assert all(s.columns == steps[0].columns for s in steps[1:5])


def test_toxic_rows_go_and_others_stay_as_they_are(steps):
    before, after = rows_of(steps[0]), rows_of(steps[1])
    assert after.items() <= before.items() and 0.5 * len(before) < len(after) < len(before)


def test_later_lines_go(steps):
    before = list(rows_of(steps[1]).items())
    want = {d: t for d, n, cut, t in restated_lines(before) if cut < n or not cut}
    assert rows_of(steps[2]) == want


def test_one_of_each_class_stays(steps):
    before = sorted(rows_of(steps[2]).items())
    sets = [weighted(t) for _, t in before]
    label = list(range(len(before)))
    for i in range(len(before)):
        for j in range(i):
            small, large = sorted((sum(sets[i].values()), sum(sets[j].values())))
            if sets[i] and sets[j] and small >= 0.8 * large and likeness(sets[i], sets[j]) >= 0.8:
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    first = {}
    for (doc, _), x in zip(before, label, strict=True):
        first.setdefault(x, doc)
    assert sorted(rows_of(steps[3])) == sorted(first.values())


def test_contaminated_rows_go(spark, steps, sf001):
    windows = set()
    for r in spark.read.parquet(f"{sf001}/benchmark.parquet").collect():
        words = words_of(r.text)
        size = min(10, len(words))
        windows |= {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set()
    sizes = {len(w) for w in windows}

    def clean(text):
        words = words_of(text)
        return not any(tuple(words[i : i + s]) in windows for s in sizes for i in range(len(words) - s + 1))

    before = rows_of(steps[3])
    assert rows_of(steps[4]) == {d: t for d, t in before.items() if clean(t)}


def test_all_that_is_left_is_packed(steps):
    made = packing.WordTokenizer.load(packing.default_tokenizer()).whole
    got = steps[5].toPandas()
    for doc, text in rows_of(steps[4]).items():
        ids = [*made.encode(text or "", add_special_tokens=False).ids, packing.END_ID]
        own = got[got.doc_id == doc].sort_values("piece")
        assert own.length.sum() == len(ids) and own.start.tolist() == [0, *np.cumsum(own.length)[:-1].tolist()]
        for r in own.itertuples():
            assert zlib.crc32(np.asarray(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
    for _, part in got.sort_values("offset").groupby("sequence_id"):
        assert part.offset.tolist() == [0, *np.cumsum(part.length)[:-1].tolist()] and part.length.sum() <= 1024
    assert set(got.doc_id) == set(rows_of(steps[4]))


def test_run_gives_the_same(spark, steps, sf001):
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf001).select(*cols).collect())) == sorted(map(tuple, steps[5].select(*cols).collect()))


def test_stages_take_nulls_repeats_and_clashing_names(spark, sf001):
    rows = [(None, None), (None, ""), (1, "a b c d e f g"), (1, "a b c d e f g"), (2, "A b c d e f g"), (3, "x\ny\nz\nw"), (4, "x\ny\nz"), (5, "é" * 5000), (None, "x\ny\nz")]
    docs = documents(spark, rows)
    for name, stage in corpus_pipeline.STAGES:
        for some in (docs, docs.limit(0)):
            made = stage(spark, some, sf001)
            count = made.count()
            assert count == 0 if some is not docs else count > 0
            if name != "packing":
                assert made.columns == docs.columns and [f.dataType for f in made.schema] == [f.dataType for f in docs.schema]
    assert sorted(map(repr, (r.text for r in corpus_pipeline.line_dedup(spark, docs, sf001).collect()))) == sorted(map(repr, [None, "", "a b c d e f g", "a b c d e f g", "A b c d e f g", "x\ny\nz\nw", "é" * 5000]))
    assert sorted(repr(r.text) for r in corpus_pipeline.near_dedup(spark, docs, sf001).collect()) == sorted(map(repr, [None, "", "a b c d e f g", "x\ny\nz\nw", "x\ny\nz", "é" * 5000]))
