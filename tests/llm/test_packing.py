import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from ravelin.llm import packing


def check_plan(histogram, capacity=1024):
    slots = packing.plan_slots(histogram, capacity, rounds=60)
    got, room = {}, {}
    for length, start, end, first, offset in slots:
        for k in range(end - start):
            got.setdefault(length, []).append(start + k)
            room.setdefault(first + k, []).append((offset, length))
    assert {k: sorted(v) for k, v in got.items()} == {k: list(range(v)) for k, v in histogram.items() if v}
    for parts in room.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(room)


def test_plan_places_every_piece_once_and_fills_well():
    rng = random.Random(3)
    histogram = {}
    for _ in range(4000):
        n = min(1024, int(rng.lognormvariate(5.5, 1)) + 1)
        histogram[n] = histogram.get(n, 0) + 1
    total = sum(k * v for k, v in histogram.items())
    assert check_plan(histogram) <= -(-total // 1024) * 1.01 + 1


def test_plan_small_cases():
    assert check_plan({}) == 0
    assert check_plan({1024: 3}) == 3
    assert check_plan({1: 5}) == 1
    assert check_plan({600: 2, 424: 2}) == 2
    assert check_plan({7: 1, 3: 1, 5: 2}, 10) == 2


def test_word_tokenizer_equals_the_tokenizer():
    made = packing.WordTokenizer.load(packing.default_tokenizer())
    rng = random.Random(5)
    letters = " \n\t aB9'sé,._-²\x1c\xa0 't’œ  ñ"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(3000)]
    texts += ["", " ", "a <|endoftext|> b", "x" * 3000, "日本 語", "a  b   c", " \n x"]
    for text in texts:
        assert made.ids(text) == np.asarray(made.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


def test_pack_documents_round_trip(spark):
    rows = [(1, "alpha beta gamma"), (2, None), (3, ""), (None, "one two"), (4, "lorem ipsum dolor " * 900), (1, "alpha beta gamma")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("length", F.lit(3)).withColumn("piece", F.lit(None).cast("int"))
    got = packing.pack_documents(docs).toPandas()
    made = packing.WordTokenizer.load(packing.default_tokenizer()).whole
    want = []
    for doc, text in rows:
        ids = [*made.encode(text or "", add_special_tokens=False).ids, 2]
        at, size, k = 0, (len(ids) - 1) % 1024 + 1, 0
        while at < len(ids):
            want.append((doc, k, at, size, zlib.crc32(np.asarray(ids[at : at + size], "<u4").tobytes())))
            at, size, k = at + size, 1024, k + 1
    key = lambda r: tuple(-1 if x is None or x != x else int(x) for x in r)
    assert sorted(map(key, got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False))) == sorted(map(key, want))
    for _, part in got.sort_values("offset").groupby("sequence_id"):
        assert part.offset.tolist() == [0, *np.cumsum(part.length)[:-1].tolist()]
        assert part.length.sum() <= 1024


def test_pack_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack_documents(docs).count() == 0
    assert packing.token_pieces(docs, with_ids=True).columns[-1] == "ids"
