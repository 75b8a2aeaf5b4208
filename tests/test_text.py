import re

import pytest
from pyspark.sql import functions as F

from ravelin.config import EngineConfig, positive_int, split_list
from ravelin.functions import text as T
from ravelin.operators.chunking import accepted, chunks


def texts(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "doc_id long, text string")


def loop_chunks(words, size, overlap):
    out, start = [], 0
    while start < len(words):
        out.append(words[start : start + size])
        if start + size >= len(words):
            break
        start += size - overlap
    return out


@pytest.mark.parametrize(("size", "overlap", "n"), [(4, 1, 7), (4, 2, 9), (5, 0, 70), (3, 3, 10), (512, 64, 2)])
def test_chunks_follow_the_window_rule(spark, size, overlap, n):
    words = [f"w{i}" for i in range(n)]
    config = EngineConfig(chunk_tokens=size, chunk_overlap=overlap)
    got = chunks(texts(spark, [" \n".join(words), None, "  "]), config).orderBy("ord").collect()
    effective = overlap or 64
    effective = effective if effective < size else size // 2
    want = loop_chunks(words, size, effective)
    assert [r.text.split() for r in got] == want
    assert [r.window_tokens for r in got] == [len(w) for w in want]
    assert [r.chunk_id for r in got] == [f"0-{i}" for i in range(len(want))]


def test_seven_words_make_two_chunks(spark):
    got = chunks(texts(spark, ["one two three four five six seven"]), EngineConfig(chunk_tokens=4, chunk_overlap=1)).orderBy("ord").collect()
    assert len(got) == 2 and got[1].text.startswith("four") and max(r.window_tokens for r in got) <= 4


def test_candidates_equal_a_plain_restatement(spark):
    def restated(text):
        found = re.findall(r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*", text)
        every = list(found)
        for p in found:
            parts = p.split()
            every += [" ".join(parts[i:]) for i in range(1, len(parts))]
        every += re.findall(r"\b[A-Za-z]{4,}\b", text)
        return sorted({e.strip().lower() for e in every if e.strip()})

    values = ["Alpha Beta uses gamma", "McDonald Über xAlpha snake_case abcd1 abcd", "", "New\nYork City", "é Eté Tést  Aa   Bb"]
    got = texts(spark, values).select(T.candidates(F.col("text"))).collect()
    assert [r[0] for r in got] == [restated(v) for v in values]


def test_approx_tokens_pages_and_guard(spark):
    values = ["", "  \t", "two words", "a" * 41, "x\fy\f", None]
    got = texts(spark, values).select(T.approx_tokens(F.col("text")), T.page_count(F.col("text"))).collect()
    assert [r[0] for r in got] == [0, 0, 2, 10, 2, 0]
    assert [r[1] for r in got] == [0, 1, 1, 1, 3, 0]
    assert [r.status for r in accepted(texts(spark, ["é" * 3, " ", "ok", None]), EngineConfig(paste_bytes=5)).orderBy("doc_id").collect()] == ["too_large", "empty", "accepted", "empty"]


def test_edge_labels(spark):
    got = spark.createDataFrame([("uses",), (None,), ("",), ("a-b",), ("_X9",), ("9X",), ("X\n",)], "l string").select(T.edge_label(F.col("l"))).collect()
    assert [r[0] for r in got] == ["USES", "ABOUT", "ABOUT", "ABOUT", "_X9", "ABOUT", "X\n"]


def test_config_bounds():
    c = EngineConfig(top_k=0, chunk_tokens=-1, crawl_chars=5)
    assert (c.top_k, c.chunk_tokens, c.crawl_chars) == (1, 1, 1000)
    assert EngineConfig.from_env({"RAVELIN_TOP_K": " 9 ", "RAVELIN_CHUNK_TOKENS": "x"}).top_k == 9
    assert positive_int("0", 3) == positive_int(" ", 3) == positive_int(None, 3) == 3
    assert split_list(" a, ,b ") == ["a", "b"]
