"""Benchmark decontamination by winnowing.

Every window of ``span`` words has a fingerprint: the least hash of its word
``gram``-grams.  Two equal windows have equal fingerprints, so a join of the
fingerprints of documents and benchmark finds every shared window.  A document
keeps a fingerprint once where it comes up, and again wherever the window
leaves a gram that has it (winnowing by position), so that it is never kept for
more windows than a gram lies in, however often the text repeats itself; a hit
is extended over these windows, and a window counts if the hashes of its first
and last gram (which cover all its words) are those of a benchmark window.

Everything is a DataFrame operation.  The benchmark's fingerprints are counted
and broadcast if they are few; otherwise the join shuffles the documents'
thinned fingerprints.  Windows are keyed by a digest of the text, so that
copies of a text are worked out once.

Edge cases: a null or empty text has no words; a benchmark item of fewer than
``span`` words, but not none, is one window, looked up where its first two
words stand;
repeated rows each get their result; item ids that are null are not listed,
their windows still hit; an item id on several rows is one item; an empty
benchmark hits nothing; empty documents give an empty result; other columns
are ignored; very long texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ravelin.llm.common import LOWER, UPPER, WORD, digest, small, words_of
from ravelin.scratch import Scratch
from ravelin.sources.tables import table

SPAN = 10
GRAM = 5


def _grams(df: DataFrame, names: list[str], span: int, gram: int, words: bool = False) -> DataFrame:
    """A row for each word position (one with a null position for no words): n words, i, fingerprint m of the window there and of the one before, whether that is the hash of the gram left behind (left), and g, the hashes of the grams; with ``words`` also h, those of the words."""
    hashed = df.select(*names, F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w)).alias("h"))
    names = [*names, *(["h"] if words else [])]
    grams = hashed.select(*names, F.transform("h", lambda x, i: F.xxhash64(x, *(F.get("h", i + k) for k in range(1, gram)))).alias("g"))
    least = grams.select(*names, "g", F.transform("g", lambda x, i: F.least(x, *(F.get("g", i + k) for k in range(1, span - gram + 1)))).alias("m"))
    return least.select(*names, "g", F.size("g").alias("n"), "m", F.posexplode_outer("m").alias("i", "at")).select(*names, "g", "n", "i", F.col("at").alias("m"), F.get("m", F.col("i") - 1).alias("before"), (F.get("m", F.col("i") - 1) == F.get("g", F.col("i") - 1)).alias("left"))


def _short(size: int, at) -> list[Column]:
    """Identity of a window of fewer words, the k-th of which is ``at(k)``: two hashes of all of them."""
    own = [at(k) for k in range(size)]
    return [F.xxhash64(*own).alias("w1"), F.xxhash64(F.lit(size), *own).alias("w2")]


def _start(size: int, at) -> Column:
    """Hash of the first two words of a short window, or of its one."""
    return F.xxhash64(F.lit(min(size, 2)), *(at(k) for k in range(min(size, 2))))


def benchmark_windows(benchmark: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """item_id, size, fingerprint m (of a short window the hash of its start), w1, w2 of every window of the benchmark."""
    texts = benchmark.select("item_id", "text")
    whole = _grams(texts, ["item_id"], span, gram).where(F.col("i") + span <= F.col("n"))
    parts = [whole.select("item_id", F.lit(span).alias("size"), "m", F.get("g", "i").alias("w1"), F.get("g", F.col("i") + (span - gram)).alias("w2"))]
    hashed = texts.select("item_id", F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w)).alias("h"))
    at = lambda k: F.get("h", F.lit(k))
    parts += [hashed.where(F.size("h") == s).select("item_id", F.lit(s).alias("size"), _start(s, at).alias("m"), *_short(s, at)) for s in range(1, span)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, gram: int = GRAM, keep: list[str] | None = None) -> DataFrame:
    """Per row of ``docs``: the columns ``keep`` (doc_id), n_words, n_hit, n_items, items_sha256, contaminated."""
    if span < 2 * gram - 1 or span > 2 * gram:
        raise ValueError("two grams must cover a window")
    keep = keep or ["doc_id"]
    scratch = Scratch(docs.sparkSession)
    bench = scratch.table(benchmark_windows(benchmark, span, gram), "benchmark")
    marks = small(scratch.table(bench.where(F.col("size") == span).select("m").distinct().withColumn("found", F.lit(True)), "marks"))
    sizes = sorted(r[0] for r in bench.where(F.col("size") < span).select("size").distinct().collect())  # fewer than span
    texts = docs.select(*(F.col(c).alias(f"_{x}") for x, c in enumerate(keep)), "text")
    kept = [f"_{x}" for x in range(len(keep))]
    at = _grams(texts.select(*kept, *digest(F.coalesce("text", F.lit(""))), "text"), [*kept, "k1", "k2"], span, gram, bool(sizes))
    windows = span - gram + 1
    first = F.coalesce(F.col("i") == 0, F.lit(True))
    thin = (F.col("i") + span <= F.col("n")) & (first | (F.col("m") != F.col("before")) | F.col("left"))
    # the grams of all windows that this fingerprint can be the least hash of
    cut = [F.when(thin, F.col("m")).alias("m"), F.when(thin, F.slice("g", F.col("i") + 1, windows + span - gram)).alias("g")]
    ids, hit = [*kept, "k1", "k2", "n", "i"], first | F.col("found")
    if sizes:  # in the same pass, places where a short item may start
        word = lambda k: F.get("h", F.col("i") + k)
        depths = sorted({min(s, 2) for s in sizes})
        at = at.select(*ids, *cut, F.slice("h", F.col("i") + 1, span - 1).alias("h"), *(_start(d, word).alias(f"start{d}") for d in depths))
        for d in depths:
            starts = bench.where((F.col("size") < span) & (F.least(F.col("size"), F.lit(2)) == d)).select(F.col("m").alias(f"start{d}")).distinct().withColumn(f"short{d}", F.lit(True))
            at = at.join(small(scratch.table(starts, f"starts{d}")), f"start{d}", "left")
        at = at.withColumn("short", F.coalesce(*(F.col(f"short{d}") for d in depths))).where(first | F.col("m").isNotNull() | F.col("short"))
        hit = hit | F.col("short")
        more = [F.when(F.col("short"), F.col("h")).alias("h")]
    else:
        at, more = at.select(*ids, *cut).where(first | F.col("m").isNotNull()), []
    hit = at.join(marks, "m", "left").where(hit)
    hit = scratch.table(hit.select(*ids, first.alias("first"), F.when(F.col("found"), F.col("g")).alias("g"), *more), "hits")

    known = bench.select("size", "w1", "w2").distinct()
    near = F.array(*(F.struct((F.col("i") + x).alias("i"), F.get("g", F.lit(x)).alias("w1"), F.get("g", F.lit(x + span - gram)).alias("w2")) for x in range(windows)))
    found = hit.where("g is not null").select("k1", "k2", "n", near.alias("near")).select("k1", "k2", "n", F.inline("near")).where(F.col("i") + span <= F.col("n"))
    found = found.select("k1", "k2", F.lit(span).alias("size"), "i", "w1", "w2")
    if sizes:
        each = F.array(*(F.struct(F.lit(s).alias("size"), *_short(s, lambda k: F.get("h", F.lit(k)))) for s in sizes))
        short = hit.where("h is not null").select("k1", "k2", "n", "i", F.inline(each)).where(F.col("i") + F.col("size") <= F.col("n"))
        found = found.unionByName(short.select("k1", "k2", "size", "i", "w1", "w2"))
    known = small(scratch.table(known, "known"))
    found = scratch.table(found.join(known, ["size", "w1", "w2"], "left_semi").distinct(), "found")

    order = Window.partitionBy("k1", "k2").orderBy("i", "size")
    reached = F.max(F.col("i") + F.col("size")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.lit(0), F.col("i") + F.col("size") - F.greatest("i", F.coalesce(reached, F.lit(0))))
    hits = found.select("k1", "k2", new.alias("new")).groupBy("k1", "k2").agg(F.sum("new").alias("n_hit"))
    items = found.select("k1", "k2", "size", "w1", "w2").distinct().join(bench.select("size", "w1", "w2", "item_id"), ["size", "w1", "w2"])
    items = items.where("item_id is not null").select("k1", "k2", F.col("item_id").cast("string").alias("item")).distinct()
    items = items.groupBy("k1", "k2").agg(F.array_sort(F.collect_list("item")).alias("items"))
    result = scratch.table(hits.join(items, ["k1", "k2"], "left"), "result")
    out = hit.where("first").join(result, ["k1", "k2"], "left")
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        *(F.col(f"_{x}").alias(c) for x, c in enumerate(keep)),
        F.col("n").cast("bigint").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.size(listed).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, most: float = 0.0) -> DataFrame:
    """The rows of ``docs`` of whose words at most the share ``most`` are hit, with all their columns."""
    judged = decontaminate(docs, benchmark, keep=docs.columns)
    return judged.where(F.col("n_hit") <= most * F.col("n_words")).select(*docs.columns)


def op2_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM benchmark),
bl AS (SELECT item_id, w, least({SPAN}, len(w)) AS size FROM b WHERE len(w) > 0),
bp AS (SELECT item_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM bl),
bw AS (SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS s FROM bp),
sizes AS (SELECT DISTINCT size FROM bw),
dp AS (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size),
dw AS (SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS s FROM dp),
hit AS (SELECT dw.doc_id, dw.i, bw.size, bw.item_id FROM dw JOIN bw ON dw.size = bw.size AND dw.s = bw.s),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN it USING (doc_id)
"""
