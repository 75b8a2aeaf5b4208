"""Periodic runs of words, by Lyndon arrays on an ordered alphabet.

A run is a stretch of words that repeats its first ``q`` words (its smallest
period) and can't be made longer on either side.  Every run holds a copy of its
period that is, in one of the two orders of the alphabet, the longest Lyndon
word that begins there.  So for either order the next smaller suffix of every
place is found from right to left, and the stretch over which a place and its
next smaller suffix agree, extended to the left, is a run if it is long
enough.  Only comparisons of words are needed: no suffix array or tree, and no
hashes of stretches.

How far two suffixes agree is seldom looked at anew.  Along the chain of
smaller suffixes the two agreements that are known give the third unless they
are equal, and for each distance the last stretch over which words agreed is
remembered, so that a comparison that comes to its beginning jumps to its end.

Words that can't be in a run are set aside first, in one vectorised step: three
words in a row that are part of a run of ``times`` periods occur ``times`` - 1
times in it, so words whose threes are rarer in the text are between runs.

Edge cases: a null or blank text has no words; words are split at ASCII white
space only; repeated rows and null ids are rows of their own; very long texts
are read whole, in memory in proportion to their words; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.llm.common import CRC32_SQL
from ravelin.sources.tables import table

#: Least number of periods and of words of a run.
TIMES, LEAST = 4, 6


def next_smaller(a: list[int]) -> tuple[list[int], list[int]]:
    """For every place of ``a`` where its next smaller suffix begins (the length where none does), and over how many values the two agree.

    The difference of the two places is the length of the longest Lyndon word
    that begins there.  A suffix that another one begins with is the smaller.
    """
    n = len(a)
    after, agree = [n] * n, [0] * n
    begin, end = [0] * (n + 1), [0] * (n + 1)  # by distance: where values last agreed
    for i in range(n - 1, -1, -1):
        j, m = i + 1, 0
        while j < n:
            d = j - i
            x, low, high = i + m, begin[d], end[d]
            while x + d < n and not low <= x < high and a[x] == a[x + d]:
                x += 1
            if low <= x < high:
                x = high
            m = x - i
            if m and not (x == high and low <= i):
                begin[d], end[d] = i, x
            if x + d == n or a[x + d] < a[x]:
                break
            # the suffix at i is smaller than the one at j: go on to the next smaller one of that
            while (k := after[j]) < n and m < agree[j]:
                j = k
            if k < n and m > agree[j]:
                j, m = k, agree[j]
                break
            j = k
        after[i], agree[i] = j, m if j < n else 0
    return after, agree


def lyndon_runs(a: list[int], times: int = TIMES, least: int = LEAST) -> set[tuple[int, int, int]]:
    """(start, length, period) of all runs of ``a`` of at least ``times`` periods (two or more) and ``least`` values."""
    found, n = set(), len(a)
    for values in (a, [-x for x in a]):
        after, agree = next_smaller(values)
        judged: list[tuple[int, int]] = [(0, 0)] * (n + 1)  # by period: the last stretch that was extended
        for i in range(n - 1, -1, -1):
            j, m = after[i], agree[i]
            q = j - i
            # the leftmost copy of a run's period begins less than a period after the run
            if m <= (times - 2) * q or judged[q][0] <= i < judged[q][1]:
                continue
            s = i
            while s and values[s - 1] == values[s - 1 + q]:
                s -= 1
            judged[q] = (s, i + m)
            if i + m + q - s >= max(least, times * q):
                found.add((s, i + m + q - s, q))
    return found


def stretches(words: np.ndarray, times: int = TIMES, least: int = LEAST) -> list[tuple[int, int]]:
    """Where runs can be: maximal stretches of words of which every three in a row occur as often in the text as they do in a run at least."""
    n, often = len(words), min(times - 1, max(times, least) - 2)
    if often < 2 or n < 3:
        return [(0, n)]
    size = np.int64(words.max() + 1)
    pairs = np.unique(words[:-1] * size + words[1:], return_inverse=True)[1].astype(np.int64)
    _, name, count = np.unique(pairs[:-1] * size + words[2:], return_inverse=True, return_counts=True)
    held = np.concatenate([[False], count[name] >= often, [False]])
    edge = np.flatnonzero(held[1:] != held[:-1])
    return [(int(s), int(e) + 2) for s, e in zip(edge[::2], edge[1::2], strict=True)]


def runs_of(words: list[bytes], times: int = TIMES, least: int = LEAST) -> list[tuple[int, int, int]]:
    """Runs of a list of words, by start and then period."""
    if len(words) < max(least, times):
        return []
    names = {w: k for k, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(names.__getitem__, words), np.int64, len(words))
    found = []
    for s, e in stretches(ids, times, least):
        if e - s >= max(least, times):
            found += [(s + k, length, q) for k, length, q in lyndon_runs(ids[s:e].tolist(), times, least)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    kept = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
    return b" ".join([words[k] for k in kept.tolist()])


def periodic_runs(docs: DataFrame, times: int = TIMES, least: int = LEAST) -> DataFrame:
    """doc_id, runs (array of start, length, period in order), collapsed (text without what runs repeat) of every text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs, texts = [], []
            for text in batch.column(1):
                words = (text.as_py() or "").encode().split()
                own = runs_of(words, times, least)
                runs.append([{"start": s, "length": n, "period": q} for s, n, q in own])
                texts.append(collapsed(words, own).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(runs, run_type), pa.array(texts, pa.string())], names=["doc_id", "runs", "collapsed"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, where the rows of one remainder of ten of the id's checksum have words that repeat from some place on (null ids have none)."""
    words = F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[ \t-\r]+"), "")
    h = F.crc32(F.col("doc_id").cast("string"))
    g, n = F.floor(h / 10), F.size("words")
    a = F.when(n > 0, g % n)
    p = 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8))
    chosen = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("words"), g.alias("g")).withColumn("a", a).withColumn("p", p)
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    again = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get("words", place(i).cast("int")))
    return chosen.select("doc_id", F.when(F.col("words").isNotNull() & (n > 0), F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def reported(found: DataFrame) -> DataFrame:
    """doc_id, the number of runs, the longest of them (ties: the least start, then period), and digests of the runs and of the collapsed text."""

    def line(r: Column) -> Column:
        return F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))

    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).cast("bigint").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_lyndon_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reported(periodic_runs(planted(table(spark, sf_dir, "documents"))))


#: By brute force: every pair of equal words whose distance may be a period.
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws, {CRC32_SQL.format(s="CAST(doc_id AS VARCHAR)")} AS h FROM documents),
g AS (SELECT *, len(ws) AS n, h // 10 AS g FROM d),
a AS (SELECT *, g % n AS a FROM g),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
w AS (SELECT rid, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: ws[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE ws END AS ws FROM p),
o AS (SELECT rid, n, unnest(ws) AS word, unnest(range(n)) AS i FROM w),
m AS (SELECT x.rid, y.i - x.i AS q, x.i FROM o x JOIN o y ON x.rid = y.rid AND x.word = y.word AND y.i > x.i AND (y.i - x.i) * 4 <= x.n),
s AS (SELECT rid, q, i, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS s FROM m),
r AS (SELECT rid, q, min(i) AS start, count(*) + q AS length FROM s GROUP BY rid, q, s HAVING count(*) + q >= greatest(6, 4 * q)),
run AS (SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM r b WHERE b.rid = r.rid AND b.q < r.q AND b.start <= r.start AND b.start + b.length >= r.start + r.length)),
gone AS (SELECT DISTINCT o.rid, o.i FROM o JOIN run ON o.rid = run.rid AND o.i >= run.start + run.q AND o.i < run.start + run.length),
kept AS (SELECT rid, string_agg(word, ' ' ORDER BY i) AS t FROM o ANTI JOIN gone USING (rid, i) GROUP BY rid),
told AS (SELECT rid, count(*) AS n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS lines, max({{'length': length, 'start': -start, 'q': -q}}) AS b FROM run GROUP BY rid)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, CAST(-b.start AS BIGINT) AS start, CAST(b.length AS BIGINT) AS length, CAST(-b.q AS BIGINT) AS period, CAST(1000 * b.length // -b.q AS BIGINT) AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM w LEFT JOIN told USING (rid) LEFT JOIN kept USING (rid)
"""
