"""Removal of repeated 200-byte strings by sorting sampled suffixes into groups.

Asked for was a suffix array by the difference-cover algorithm over all bytes.
``suffix_array`` is that algorithm; on every byte position it shuffles hundreds
of bytes for each byte of text, far beyond the limits (figures in the README),
so the sample is thinner here and suffixes are compared only as deep as the
result needs.  What stays of the method: sampled suffixes are named and
grouped, the remaining suffixes are placed by the bytes to their sample, and
prefixes that meet are compared.

1. The sample of a window (a string of ``LENGTH`` bytes) is its least hash of
   ``GRAM`` bytes, so equal windows have their sample at the same offset.
   Neighbouring windows with one sample make up a run.
2. Runs are grouped by the sample's name.  A run whose bytes are all the same
   elsewhere is repeated as a whole; a run that is alone with its sample isn't
   repeated at all.
3. The rest are cut into blocks of ``GRID`` offsets.  The bytes that all
   windows of a block have in common are compared first.  Every window is
   hashed and compared only from the first to the last block of a run where
   those meet, in a second pass over the texts that hold such blocks.

Equality is that of 128 bits or more of hashes.  Groups are worked out by
grouped minima and maxima with partial aggregation and by joins, never by
gathering a group; long texts are read in stretches of bounded size.

Edge cases: a null text is no bytes; a text of fewer than ``LENGTH`` bytes is
kept; repeated rows (null ids too) are other places, so their whole windows
go; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.llm.common import digest, few_rows, settings, small_batches
from ravelin.llm.minhash import mixed
from ravelin.scratch import Scratch
from ravelin.sources.tables import table

LENGTH, GRAM, GRID = 200, 32, 8
#: Windows of a text that are worked on at once.
STRETCH = 1 << 18
#: Spark's setting by which a written table's shuffles are deleted with the end of its query, not when the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Texts of a batch that are worked on at once.
TEXTS = 256

_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2 ** 64
_LOW = np.uint64((1 << 20) - 1)
_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse."""
    size = STRETCH + LENGTH + 1
    made = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        made.append(np.multiply.accumulate(steps))
    return made[0], made[1]


class Stretch:
    """Hashes of all parts of a stretch of bytes."""

    def __init__(self, data: bytes):
        up, self.down = _powers()
        self.size = len(data)
        self.sums = np.zeros(self.size + 1, np.uint64)
        np.cumsum(_BYTES[np.frombuffer(data, np.uint8)] * up[: self.size], out=self.sums[1:])

    def part(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the bytes from ``start`` to before ``end``; they say nothing of the place."""
        return mixed((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sample, first and last window of each run."""
        many = self.size - GRAM + 1
        at = np.arange(many)
        width = LENGTH - GRAM + 1
        value = (self.part(at, at + GRAM) & ~_LOW) | at.astype(np.uint64)
        blocks = np.full(-(-many // width) * width, np.iinfo(np.uint64).max, np.uint64)
        blocks[:many] = value
        blocks = blocks.reshape(-1, width)
        ahead = np.minimum.accumulate(blocks, 1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
        least = (np.minimum(behind[: many - width + 1], ahead[width - 1 : many]) & _LOW).astype(np.int64)
        first = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
        return least[first], first, np.r_[first[1:], len(least)] - 1


def stretches(data: bytes) -> Iterator[tuple[int, Stretch]]:
    """Start and hashes of stretches that hold every window of the text once."""
    for start in range(0, len(data) - LENGTH + 1, STRETCH):
        yield start, Stretch(data[start : start + STRETCH + LENGTH - 1])


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(*digest(F.coalesce("text", F.lit(""))), "text")


def sampled_runs(docs: DataFrame) -> DataFrame:
    """k1, k2 (text) and for each run: name g of the sample, hash c of all its bytes, sample a, first window s, last window e."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches, TEXTS):
            made: list[list[np.ndarray]] = []
            for text in batch.column(2).to_pylist():
                parts = []
                for start, x in stretches((text or "").encode("utf-8", "surrogatepass")):
                    a, s, e = x.runs()
                    c = mixed(x.part(s, e + LENGTH) + mixed((a - s).astype(np.uint64)))
                    parts.append((x.part(a, a + GRAM).view(np.int64), c.view(np.int64), a + start, s + start, e + start))
                made.append([np.concatenate(p) for p in zip(*parts, strict=True)] or [np.empty(0, np.int64)] * 5)
            sizes = np.cumsum([0, *(len(m[0]) for m in made)])
            flat = [np.concatenate([m[k] for m in made]) if made else np.empty(0, np.int64) for k in range(5)]
            kinds = [pa.int64()] * 5
            lists = [pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(f, k)) for f, k in zip(flat, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *lists], names=["k1", "k2", "g", "c", "a", "s", "e"])

    kinds = ", ".join(f"{n} array<bigint>" for n in "gcase")
    return _texts(docs).mapInArrow(run, f"k1 bigint, k2 bigint, {kinds}")


def window_blocks(open_texts: DataFrame, windows: bool = False) -> DataFrame:
    """For each of the given blocks of offsets of each text's runs (copies that follow each other count once): hash of what its windows have in common, c, single, j and, if asked for, the windows' hashes (0: not of the run)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in few_rows(batches, TEXTS):
            ends = np.cumsum([0, *pc.list_value_length(batch.column(3)).to_pylist()])
            fields = [x.to_numpy(zero_copy_only=False) for x in pc.list_flatten(batch.column(3)).flatten()]
            for key, text, low, high in zip(zip(*(batch.column(k).to_pylist() for k in (0, 1)), strict=True), batch.column(2).to_pylist(), ends[:-1], ends[1:], strict=True):
                if key == last:
                    continue  # a copy of the text before has the same windows
                last = key
                data = (text or "").encode("utf-8", "surrogatepass")
                c, a, s, e, single, first, last_ = (x[low:high] for x in fields)
                for start, x in stretches(data):
                    mine = np.flatnonzero((s >= start) & (s < start + STRETCH))  # runs don't cross stretches
                    if not len(mine):
                        continue
                    low, high = first[mine], last_[mine]
                    of = np.repeat(mine, high - low + 1)
                    j = np.arange(len(of)) - np.repeat(np.cumsum(high - low + 1) - (high - low + 1), high - low + 1) + np.repeat(low, high - low + 1)
                    at = a[of] - start
                    core = mixed(x.part(at - GRID * j, at - GRID * j + LENGTH - GRID + 1) + mixed(j.astype(np.uint64)))
                    made = [pa.array(core.view(np.int64)), pa.array(c[of]), pa.array(single[of]), pa.array(j.astype(np.int32))]
                    if not windows:
                        yield pa.RecordBatch.from_arrays(made, names=["core", "c", "single", "j"])
                        continue
                    p = at[:, None] - (GRID * j[:, None] + np.arange(GRID)[None, :])
                    there = (p >= (s[of] - start)[:, None]) & (p <= (e[of] - start)[:, None])
                    p = np.where(there, p, 0)
                    hashes = np.where(there, x.part(p, p + LENGTH) | np.uint64(1), np.uint64(0)).view(np.int64)
                    wins = pa.ListArray.from_arrays(pa.array(np.arange(len(of) + 1) * GRID, pa.int32()), pa.array(hashes.ravel()))
                    yield pa.RecordBatch.from_arrays([*made, wins], names=["core", "c", "single", "j", "wins"])

    return open_texts.select("k1", "k2", "text", "runs").mapInArrow(run, "core bigint, c bigint, single boolean, j int" + ", wins array<bigint>" * windows)


def repeated_windows(docs: DataFrame) -> DataFrame:
    """k1, k2 (text) and windows: array of first and last start of stretches of windows that occur elsewhere too."""
    spark = docs.sparkSession
    with settings(spark, {CLEANUP: "true"}), small_batches(spark):
        return _repeated_windows(docs)


def _repeated_windows(docs: DataFrame) -> DataFrame:
    scratch = Scratch(docs.sparkSession)

    def done(*names: str) -> None:
        for name in names:
            scratch.drop(name)

    texts = scratch.table(sampled_runs(docs), "runs")
    runs = texts.select("k1", "k2", F.inline(F.arrays_zip("g", "c", "a", "s", "e")))
    twice = runs.groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g")
    met = scratch.table(runs.join(scratch.table(twice, "twice"), "g"), "met")  # others are alone with their sample
    done("runs", "twice")
    named = met.groupBy("g", "c").agg(F.count("*").alias("m"), *(F.first(x).alias(x) for x in ("k1", "k2", "a", "s", "e")))
    named = scratch.table(named, "named")
    whole = met.select("g", "c", "k1", "k2", "s", "e").join(named.where("m > 1").select("g", "c"), ["g", "c"], "left_semi").select("k1", "k2", "s", "e").distinct()
    whole = scratch.table(whole, "whole")
    done("met")
    mixed_up = named.groupBy("g").agg(F.count("*").alias("kinds"), F.min("m").alias("least")).where("kinds > 1 and least = 1").select("g")
    mixed_up = scratch.table(named.join(scratch.table(mixed_up, "mixed-names"), "g"), "open")
    done("named", "mixed-names")
    item = F.struct("c", "a", "s", "e", (F.col("m") == 1).alias("single"), "low", "high")

    def opened(runs: DataFrame, name: str) -> DataFrame:
        by_text = scratch.table(runs.groupBy("k1", "k2").agg(F.collect_list(item).alias("runs")), name)
        return _texts(docs).join(by_text, ["k1", "k2"])

    bounds = [F.floor((F.col("a") - F.col(x)) / GRID).alias(name) for x, name in (("e", "low"), ("s", "high"))]
    blocks = scratch.table(window_blocks(opened(mixed_up.select("*", *bounds), "open-texts")), "blocks")
    cores = blocks.groupBy("core").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.max("single").alias("any")).where("low != high and any").select("core")
    # blocks between the first and the last that meet are hashed too; those that meet nothing drop out below
    spots = blocks.join(scratch.table(cores, "cores"), "core").groupBy("c").agg(F.min("j").alias("low"), F.max("j").alias("high"))
    spots = scratch.table(spots, "spots")
    done("blocks", "open-texts", "cores")
    close = window_blocks(opened(mixed_up.join(spots, "c"), "close-texts"), windows=True).select("core", "c", "single", "j", F.posexplode("wins").alias("x", "h")).where("h != 0")
    close = scratch.table(close.select("core", "h", "c", "single", (F.col("j") * GRID + F.col("x")).alias("o")), "close")
    done("spots", "close-texts")
    equal = close.groupBy("core", "h").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.max("single").alias("any")).where("low != high and any").select("core", "h")
    # a run has fewer windows than LENGTH: its hits become ranges before they meet its text
    hit = close.where("single").join(scratch.table(equal, "equal"), ["core", "h"]).groupBy("c").agg(F.sort_array(F.collect_set("o")).alias("os"))
    low = F.filter("os", lambda o, i: (i == 0) | (F.get("os", i - 1) != o - 1))
    high = F.filter("os", lambda o, i: F.coalesce(F.get("os", i + 1) != o + 1, F.lit(True)))
    single = mixed_up.where("m = 1").select("c", "k1", "k2", "a")
    # an offset counts back from the sample
    spans = hit.select("c", F.explode(F.arrays_zip(low.alias("low"), high.alias("high"))).alias("x")).join(single, "c")
    part = spans.select("k1", "k2", (F.col("a") - F.col("x.high")).alias("s"), (F.col("a") - F.col("x.low")).alias("e"))
    every = whole.unionByName(part).groupBy("k1", "k2").agg(F.collect_list(F.struct("s", "e")).alias("windows"))
    made = scratch.table(every, "windows")
    done("whole", "open", "close", "equal")
    return made


def removed_spans(docs: DataFrame) -> DataFrame:
    """doc_id, text, and spans (array of start and end in bytes, in order) that go, for each row."""
    found = repeated_windows(docs)
    # ranges of windows don't overlap, so that their ends are in order too
    own = found.select("k1", "k2", F.sort_array("windows").alias("w"))
    first = F.filter("w", lambda x, i: (i == 0) | (x["s"] > F.get("w", i - 1)["e"] + LENGTH))
    last = F.filter("w", lambda x, i: F.coalesce(F.get("w", i + 1)["s"] > x["e"] + LENGTH, F.lit(True)))
    spans = F.zip_with(first, last, lambda a, b: F.struct(a["s"].alias("start"), (b["e"] + LENGTH).alias("end")))
    spanned = own.select("k1", "k2", spans.alias("spans"))
    rows = docs.select("doc_id", *digest(F.coalesce("text", F.lit(""))), "text").join(spanned, ["k1", "k2"], "left")
    none = F.array().cast("array<struct<start: bigint, end: bigint>>")
    return rows.select("doc_id", "text", F.coalesce("spans", none).alias("spans"))


def kept_digests(spanned: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of rows with spans."""
    kind = spanned.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches, TEXTS):
            out: list[tuple] = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data = (text or "").encode("utf-8", "surrogatepass")
                edges = [0, *(x for s in spans for x in (s["start"], s["end"])), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                out.append((len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
            cols = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return spanned.select("doc_id", "text", "spans").mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept_digests(removed_spans(table(spark, sf_dir, "documents").select("doc_id", "text")))
