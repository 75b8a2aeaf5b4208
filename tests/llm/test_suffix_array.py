import bisect
import random
from collections import Counter

from ravelin.llm import suffix_array, suffix_dedup
from ravelin.llm.common import digest


def test_ranks_equal_sorting(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 30))) for _ in range(8)] + ["a" * 28, "a" * 29, "abab" * 3, "b"]
    rows = [(d, i, ord(c)) for d, t in enumerate(texts) for i, c in enumerate(t)]
    got = {(r.d, r.i): r.r for r in suffix_array.suffix_ranks(spark.createDataFrame(rows, "d long, i int, s long")).collect()}
    ordered = sorted(texts[d][i:] for d, i, _ in rows)
    assert got == {(d, i): bisect.bisect_left(ordered, texts[d][i:]) for d, i, _ in rows}
    assert suffix_array.suffix_ranks(spark.createDataFrame([], "d long, i int, s long")).count() == 0


def test_both_ways_find_the_same_strings(spark):
    rng = random.Random(4)
    base = "".join(rng.choice("abc") for _ in range(600))
    rows = [(k, base[rng.randrange(200) :][: rng.randrange(180, 400)] + "é" * k) for k in range(5)] + [(9, None), (10, "")]
    count = Counter((t or "").encode()[p : p + 200] for _, t in rows for p in range(len((t or "").encode()) - 199))
    want = {(d, p) for d, t in rows for p in range(len((t or "").encode()) - 199) if count[t.encode()[p : p + 200]] > 1}
    assert {(r.d, r.i) for r in suffix_array.repeated_starts(spark.createDataFrame(rows, "d long, text string")).collect()} == want
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = suffix_dedup.repeated_windows(docs)
    named = docs.select("doc_id", *digest(docs["text"])).join(found, ["k1", "k2"]).collect()
    assert {(r.doc_id, p) for r in named for w in r.windows for p in range(w.s, w.e + 1)} == want
