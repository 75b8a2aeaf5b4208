"""MinHash near-deduplication with DartMinHash signatures.

A text is the weighted set of its five-word shingles (weights are numbers of
occurrences).  Darts are thrown at the area under the weights: every unit
region of an element gets a Poisson number of darts for each unit of time, all
from hashes, so that two sets see the same darts where their areas overlap.
Each dart has a coordinate; the earliest dart of a coordinate that lands under
the weights is its signature, and two signatures agree there with the weighted
Jaccard similarity as probability.  Enough time is drawn that every coordinate
has a dart, which takes about t ln t darts whatever the weights.

Bands of the signature are bucketed.  A bucket's members are compared first
with its hub, the one that has most in common with others.  Where that leaves
more than one class in a bucket, its members are sorted by further coordinates
of a fresh signature, in ``ORDERS`` orders, and each is compared with the next
``REACH`` that aren't of its class; this is done in ``ROUNDS`` rounds, which
leave few outside the main class of a bucket.  Those are then compared with all
members of other classes, so that every link of a bucket counts, however large
the bucket is; only this last step takes time with the product of the two
numbers.  ``every_pair=False`` leaves it out.  Comparisons are weighted Jaccard over the whole texts'
shingles, held as 32-bit hashes.  Classes are the connected components of the
links, found by passing on the least label.

Edge cases: equal words in a row (whatever their case A-Z and punctuation) are
exact copies and of one class; texts without a word, null texts too, stand
alone; a text of fewer than five words is one shingle; a null doc_id comes
last in the order that picks a class's first document; repeated rows are
copies of each other, and ``drop_near_copies`` takes rows with the same doc_id
and text once; an empty table gives an empty result; other columns are ignored
here and kept by ``drop_near_copies``; very long texts are read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.llm.common import digest, small_batches
from ravelin.scratch import Scratch
from ravelin.sources.tables import table

SHINGLE = 5
LIKE = 0.8
BANDS, WIDTH = 25, 5
#: Rounds of comparing with neighbours, orders of each, neighbours in an order, and 16-bit coordinates that an order sorts by.
ROUNDS, ORDERS, REACH, DEPTH = 2, 4, 8, 24
#: Cells of a part of a bucket that is compared with another part at once.
PART = 1 << 17
#: Entries that a worker keeps of its map from words to hashes.
CACHE = 200_000

#: Bytes to lower case, those outside words to spaces.
_TO_WORDS = bytes(x + 32 if 65 <= x <= 90 else x if 48 <= x <= 57 or 97 <= x <= 122 or x >= 128 else 32 for x in range(256))
#: Upper ends of the Poisson distribution with mean 1.
_POISSON = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 20)]))
_GOLD = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = made = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return made


_hashes = _Hashes()


def mixed(x: np.ndarray) -> np.ndarray:
    """Well mixed 64-bit numbers, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(words: list[bytes], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles as hashes, and how often each occurs."""
    if not words:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    w = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    size = min(size, len(w))
    made = np.zeros(len(w) - size + 1, np.uint64)
    for k in range(size):
        made = mixed(made + _GOLD + w[k : len(w) - size + 1 + k])
    return np.unique(made, return_counts=True)


def signature(elements: np.ndarray, weights: np.ndarray, size: int = BANDS * WIDTH) -> np.ndarray:
    """The earliest dart of each coordinate (0 for each if there is no weight)."""
    weights = np.asarray(weights, float)
    total = weights.sum()
    if not total > 0:
        return np.zeros(size, np.uint64)
    units = np.ceil(weights).astype(np.int64)
    of = np.repeat(np.arange(len(elements)), units)
    level = np.arange(len(of)) - np.repeat(np.cumsum(units) - units, units)
    region = mixed(elements[of] + mixed(level.astype(np.uint64) + _GOLD))
    best, when = np.zeros(size, np.uint64), np.full(size, np.inf)
    per = max(1, int(np.ceil(size * (np.log(size) + 2) / len(region))))  # so many units of time at once
    time = 0
    while not np.isfinite(when).all():
        units = np.arange(time, time + per)
        seed = mixed(region[None, :] + (units + 1).astype(np.uint64)[:, None] * _GOLD).ravel()
        number = np.searchsorted(_POISSON, (seed >> np.uint64(11)) / 2.0**53)
        at = np.repeat(np.arange(len(seed)), number)
        which = (np.arange(len(at)) - np.repeat(np.cumsum(number) - number, number)).astype(np.uint64)
        dart = mixed(seed[at] ^ mixed(which + np.uint64(7)))
        more = mixed(dart + _GOLD)
        moment = units[at // len(region)] + (dart >> np.uint64(11)) / 2.0**53
        cell = at % len(region)
        under = level[cell] + (more >> np.uint64(11)) / 2.0**53 < weights[of[cell]]
        place = (mixed(more + _GOLD) % np.uint64(size)).astype(np.int64)
        landed = np.flatnonzero(under & (moment < when[place]))
        landed = landed[np.argsort(-moment[landed], kind="stable")]  # the earliest is written last
        best[place[landed]], when[place[landed]] = dart[landed], moment[landed]
        time += per
    return best


def _text_key(text: str) -> list[Column]:
    """128 bits that tell a text, and null from an empty one."""
    return [c.alias(n) for c, n in zip(digest(F.col(text).isNull(), F.coalesce(text, F.lit(""))), ("t1", "t2"), strict=True)]


def sketched(docs: DataFrame) -> DataFrame:
    """rid, doc_id, t1, t2 (text), k1, k2 (words), bands and cells (one int for each occurrence of a shingle) of each row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", *_text_key("text"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, bands, cells = [], [], []
            for text in batch.column(4).to_pylist():
                words = (text or "").encode("utf-8", "surrogatepass").translate(_TO_WORDS).split()
                keys.append(np.frombuffer(hashlib.blake2b(b" ".join(words), digest_size=16).digest(), np.int64))
                found, often = shingles(words)
                if not len(found):
                    bands.append(None)
                    cells.append(None)
                    continue
                made = signature(found, often).reshape(BANDS, WIDTH)
                band = np.arange(BANDS, dtype=np.uint64)
                for k in range(WIDTH):
                    band = mixed(band * _GOLD + made[:, k])
                bands.append(band.view(np.int64))
                nth = np.arange(often.sum()) - np.repeat(np.cumsum(often) - often, often)
                cells.append((mixed(np.repeat(found, often) + nth.astype(np.uint64) * _GOLD) >> np.uint64(32)).astype(np.uint32).view(np.int32))
            both = np.array(keys, np.int64).reshape(-1, 2)
            out = [*batch.columns[:4], pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(bands, pa.list_(pa.int64())), pa.array(cells, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(out, names=["rid", "doc_id", "t1", "t2", "k1", "k2", "bands", "cells"])

    return rows.mapInArrow(run, f"rid bigint, doc_id {kind}, t1 bigint, t2 bigint, k1 bigint, k2 bigint, bands array<bigint>, cells array<int>")


def components(scratch: Scratch, name: str, labels: DataFrame, links: DataFrame) -> DataFrame:
    """id and label: the least label of the ids that links (a, b) connect; every id of ``links`` is in ``labels``."""
    both = scratch.table(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), f"{name}-links")
    at, step = labels, 0
    while True:
        reached = both.join(at.select(F.col("id").alias("b"), F.col("label").alias("found")), "b").groupBy("a").agg(F.min("found").alias("found"))
        near = at.join(reached, at["id"] == reached["a"], "left").select("id", F.col("label").alias("was"), F.least("label", F.coalesce("found", "label")).alias("label"))
        near = scratch.table(near, f"{name}-{step}-near")
        # a label is an id: take its own label, which halves the way
        jump = near.where("id != label").select("label").distinct().join(near.select(F.col("id").alias("label"), F.col("label").alias("least")), "label")
        out = near.join(scratch.table(jump, f"{name}-{step}-jump"), "label", "left").select("id", "was", F.coalesce("least", "label").alias("label"))
        out = scratch.table(out, f"{name}-{step}")
        for old in (f"{step}-near", f"{step}-jump", f"{step - 1}"):
            scratch.drop(f"{name}-{old}")
        if not out.where("label != was").limit(1).count():
            return out.select("id", "label")
        at, step = out.select("id", "label"), step + 1


def _of_two(scratch: Scratch, rows: DataFrame, name: str) -> DataFrame:
    """The written rows of buckets that hold two ids at least."""
    twice = rows.groupBy("bucket").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low != high").select("bucket")
    return scratch.table(rows.join(scratch.table(twice, f"{name}-buckets"), "bucket"), name)


def _further(sets: DataFrame, seed: int) -> DataFrame:
    """id and far: ``ORDERS * DEPTH`` fresh coordinates, two bytes each, from the cells of each id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for cells in batch.column(1):
                units = mixed(cells.values.to_numpy().view(np.uint32).astype(np.uint64) + np.array([seed], np.uint64) * _GOLD)
                made.append((signature(units, np.ones(len(units)), ORDERS * DEPTH) >> np.uint64(48)).astype(">u2").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["id", "far"])

    return sets.select("id", "cells").mapInArrow(run, "id bigint, far binary")


def _can_be_alike(n, s, hn, hs, like: float):
    """Whether the most that two sets can have in common is enough of the least that they can have together."""
    low, high = (F.least, F.greatest) if isinstance(n, Column) else (np.minimum, np.maximum)
    return low(s, hs) >= like * (n - s + hn - hs + high(s, hs))


def _next_ones(rows: list[np.ndarray], like: float, old: int = 0, apart: bool = False) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows (bucket, id, n, s, label, part) at most ``REACH`` from each other that can be alike, of two parts if ``apart``; the first ``old`` rows have met."""
    bucket, id_, n, s, label, part = rows[:6]
    found = []
    for k in range(1, min(REACH, len(id_) - 1) + 1):
        good = (bucket[:-k] == bucket[k:]) & (label[:-k] != label[k:]) & _can_be_alike(n[:-k], s[:-k], n[k:], s[k:], like)
        good[: max(0, old - k)] = False
        if apart:
            good &= part[:-k] != part[k:]
        found.append((np.minimum(id_[:-k], id_[k:])[good], np.maximum(id_[:-k], id_[k:])[good]))
    return found


def _neighbours(scratch: Scratch, name: str, banded: DataFrame, order: int, like: float) -> DataFrame:
    """Pairs a < b of neighbours in an order of every bucket that have other labels and can be alike.

    The order is that of all rows by bucket and coordinates, in parts of even
    size, so that a large bucket is no single task's.  Every part also hands on its
    first and last ``REACH`` rows; neighbours on two sides of an edge meet among
    these, so that the pairs don't depend on the number of parts.
    """
    rows = banded.select("bucket", "id", "n", "s", "label", F.substring("far", 2 * order * DEPTH + 1, 2 * DEPTH).alias("far"))
    rows = rows.repartitionByRange("bucket", "far", "id").sortWithinPartitions("bucket", "far", "id").drop("far").withColumn("part", F.spark_partition_id().cast("bigint"))
    sides = ["bucket", "id", "n", "s", "label", "part", "k"]

    def pairs(found: list[tuple[np.ndarray, np.ndarray]]) -> list[pa.Array]:
        return [pa.array(np.concatenate(x)) for x in zip(*found, strict=True)] if found else [pa.array([], pa.int64())] * 2

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, edges, seen = [np.empty(0, np.int64)] * 6, [], 0
        for batch in batches:
            new = [c.to_numpy() for c in batch.columns]
            now = [np.concatenate([h, c]) for h, c in zip(held, new, strict=True)]
            made = pairs(_next_ones(now, like, len(held[0])))
            yield pa.RecordBatch.from_arrays([*made, *[pa.nulls(len(made[0]), pa.int64())] * len(sides)], names=["a", "b", *sides])
            if seen < REACH:
                edges.append([*(c[: REACH - seen] for c in new), np.arange(seen, min(REACH, seen + len(new[0])))])
            seen += len(new[0])
            held = [c[-REACH:] for c in now]
        place = np.arange(seen - len(held[0]), seen)
        edges.append([*(c[place >= REACH] for c in held), place[place >= REACH]])
        whole = [pa.array(np.concatenate(c)) for c in zip(*edges, strict=True)]
        yield pa.RecordBatch.from_arrays([*[pa.nulls(len(whole[0]), pa.int64())] * 2, *whole], names=["a", "b", *sides])

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [pa.concat_arrays(c).to_numpy() for c in zip(*(b.columns for b in batches), strict=True)]
        if not rows:
            return
        yield pa.RecordBatch.from_arrays(pairs(_next_ones(rows, like, apart=True)), names=["a", "b"])

    made = scratch.table(rows.mapInArrow(inside, ", ".join(f"{c} bigint" for c in ("a", "b", *sides))), f"{name}-sides")
    # at most 2 * REACH rows of each part, in one task
    edges = made.where("part IS NOT NULL").select(*sides).repartition(1).sortWithinPartitions("part", "k").mapInArrow(across, "a bigint, b bigint")
    return made.where("part IS NULL").select("a", "b").unionByName(edges).distinct()


def _linked(pairs: DataFrame, sets: DataFrame, like: float) -> DataFrame:
    """Those of the pairs (a, b) whose sets are alike."""
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("cells").alias("x")), "a")
    both = both.join(sets.select(F.col("id").alias("b"), F.col("cells").alias("y")), "b")
    sized = both.select("a", "b", F.size("x").alias("nx"), F.size("y").alias("ny"), F.size(F.array_intersect("x", "y")).alias("inside"))
    return sized.where(F.col("inside") >= like * (F.col("nx") + F.col("ny") - F.col("inside"))).select("a", "b")


def _met_in_part(like: float):
    """Links (a, b) of two labels between the rows of side 0 and of side 1, counted by the cells that they have in common."""

    def run(part: pa.Table) -> pa.Table:
        side, id_, n, label = (part[c].to_numpy() for c in ("side", "id", "n", "label"))
        cells = part["cells"].combine_chunks()
        cells = pa.concat_arrays(cells.chunks) if isinstance(cells, pa.ChunkedArray) else cells
        owner = np.repeat(np.arange(len(id_)), np.diff(cells.offsets.to_numpy()))
        value = cells.flatten().to_numpy()
        order = np.lexsort((owner, value))
        value, owner = value[order], owner[order]
        once = np.r_[True, (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])] if len(value) else np.empty(0, bool)
        value, owner = value[once], owner[once]
        right = np.flatnonzero(side == 1)
        place = np.cumsum(side == 1) - 1
        held = side[owner] == 1
        there, whose = value[held], place[owner[held]]
        mine = np.flatnonzero(~held)
        mine = mine[np.argsort(owner[mine], kind="stable")]
        lefts, starts = np.unique(owner[mine], return_index=True)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for left, own in zip(lefts, np.split(value[mine], starts[1:]), strict=True):
            low, many = np.searchsorted(there, own), np.searchsorted(there, own, "right")
            many -= low
            at = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(many.sum())
            inside = np.bincount(whose[at], minlength=len(right))
            good = right[(inside >= like * (n[left] + n[right] - inside)) & (label[right] != label[left])]
            found.append((np.minimum(id_[left], id_[good]), np.maximum(id_[left], id_[good])))
        ends = [np.concatenate(x) for x in zip(*found, strict=True)] or [np.empty(0, np.int64)] * 2
        return pa.table({"a": pa.array(ends[0], pa.int64()), "b": pa.array(ends[1], pa.int64())})

    return run


def _every_link(scratch: Scratch, now: DataFrame, sets: DataFrame, like: float) -> DataFrame:
    """All links a < b of two labels between members of a bucket (rows bucket, id, n, s, label).

    Members outside the bucket's most common label are compared with all of it.
    Both are dealt into parts of about ``PART`` cells, so that a task's group is
    one part against another and a large bucket is many of them.  Buckets of at
    most ``REACH + 1`` members have met whole in every order.
    """
    labels = now.groupBy("bucket", "label").agg(F.count("*").alias("many"), F.sum("n").alias("cells"))
    sized = labels.groupBy("bucket").agg(F.max_by("label", F.struct("many", "label")).alias("main"), F.max(F.struct("many", "label", "cells"))["cells"].alias("own"), F.sum("many").alias("members"), F.sum("cells").alias("total"), F.count("*").alias("kinds"))
    parts = [F.ceil(c / PART).cast("int") for c in (F.col("total") - F.col("own"), F.col("total"))]
    large = scratch.table(sized.where((F.col("kinds") > 1) & (F.col("members") > REACH + 1)).select("bucket", "main", *(p.alias(c) for p, c in zip(parts, ("lefts", "rights"), strict=True))), "large")
    rows = now.join(large, "bucket").select("bucket", "id", F.col("n").cast("bigint").alias("n"), "label", "main", "lefts", "rights").join(sets.select("id", "cells"), "id")
    columns = ["bucket", "side", "left", "right", "id", "n", "label", "cells"]
    dealt = [F.pmod(F.xxhash64("id"), F.col(c)).cast("int") for c in ("lefts", "rights")]
    outside = rows.where("label != main").select("*", F.lit(0).alias("side"), dealt[0].alias("left"), F.explode(F.sequence(F.lit(0), F.col("rights") - 1)).alias("right"))
    every = rows.select("*", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), F.col("lefts") - 1)).alias("left"), dealt[1].alias("right"))
    both = outside.select(*columns).unionByName(every.select(*columns))
    return both.groupBy("bucket", "left", "right").applyInArrow(_met_in_part(like), "a bigint, b bigint").distinct()


def classes(docs: DataFrame, like: float = LIKE, every_pair: bool = True) -> DataFrame:
    """rid, doc_id, t1, t2, id (of the copies' first row), label (of the class) for each row of ``docs``."""
    with small_batches(docs.sparkSession):
        return _classes(docs, like, every_pair)


def _classes(docs: DataFrame, like: float, every_pair: bool) -> DataFrame:
    scratch = Scratch(docs.sparkSession)
    rows = scratch.table(sketched(docs), "rows")
    worded = rows.where("bands is not null")
    copies = scratch.table(worded.groupBy("k1", "k2").agg(F.min("rid").alias("id")), "copies")
    firsts = worded.join(copies.select(F.col("id").alias("rid")), "rid", "left_semi")
    spread = scratch.table(firsts.select(F.col("rid").alias("id"), F.explode("bands").alias("bucket"), F.size("cells").alias("n")), "spread")
    shared = _of_two(scratch, spread, "shared")
    sets = scratch.table(firsts.select(F.col("rid").alias("id"), "cells", "bands").join(shared.select("id").distinct(), "id", "left_semi"), "sets")
    scratch.drop("spread")
    # cells that no other text has can't be in common with any
    cells = sets.select("id", F.explode("cells").alias("cell")).groupBy("cell").agg(F.min("id").alias("id"), F.max("id").alias("last"))
    alone = scratch.table(cells.where("id = last").groupBy("id").agg(F.count("*").alias("own")), "alone")
    shared = shared.join(alone, "id", "left").select("bucket", "id", "n", (F.col("n") - F.coalesce("own", F.lit(0))).alias("s"))
    shared = _of_two(scratch, scratch.table(shared.where(F.col("s") >= like * F.col("n")), "able"), "hopeful")
    for name in ("shared", "alone", "able"):
        scratch.drop(name)
    labels = scratch.table(shared.select("id").distinct().withColumn("label", F.col("id")), "labels")
    tested = None
    for step in range(1 + ROUNDS):
        now = scratch.table(shared.join(labels, "id"), f"{step}-now")
        # the hub has most in common with others
        most = F.struct(F.col("s") / F.col("n"), "id")
        ends = now.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.max_by("id", most).alias("hub"), F.max_by("label", most).alias("main"))
        ends = scratch.table(ends.where("low != high").drop("low", "high"), f"{step}-ends")
        mingled = scratch.table(now.join(ends, "bucket"), f"{step}-mingled")
        if step == 0:
            picked = mingled.where("id = hub").select("bucket", F.col("id").alias("h"), F.col("n").alias("hn"), F.col("s").alias("hs"), F.col("label").alias("hl"))
            picked = scratch.table(picked, "hubs")
            near = (F.col("label") != F.col("hl")) & _can_be_alike(F.col("n"), F.col("s"), F.col("hn"), F.col("hs"), like)
            pairs = mingled.join(picked, (mingled["bucket"] == picked["bucket"]) & near).select(F.least("id", "h").alias("a"), F.greatest("id", "h").alias("b")).distinct()
        else:
            far = _further(sets.join(mingled.select("id").distinct(), "id", "left_semi"), step)
            banded = scratch.table(mingled.select("bucket", "id", F.col("n").cast("bigint").alias("n"), "s", "label").join(scratch.table(far, f"{step}-far"), "id"), f"{step}-banded")
            found = [scratch.table(_neighbours(scratch, f"{step}-order-{order}", banded, order, like), f"{step}-order-{order}") for order in range(ORDERS)]
            pairs = reduce(DataFrame.unionByName, found).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = scratch.table(pairs, f"{step}-pairs")
        tested = pairs if tested is None else tested.unionByName(pairs)
        links = scratch.table(_linked(pairs, sets, like), f"{step}-links")
        # labels stand for the links so far
        links = links.unionByName(labels.where("id != label").select(F.col("label").alias("a"), F.col("id").alias("b")))
        labels = components(scratch, f"{step}-components", labels, links)
        for name in ("now", "ends", "mingled", "far", "banded", *(f"order-{order}{end}" for order in range(ORDERS) for end in ("", "-sides"))):
            scratch.drop(f"{step}-{name}")
    if every_pair:
        links = scratch.table(_every_link(scratch, shared.join(labels, "id"), sets, like), "rest-links")
        links = links.unionByName(labels.where("id != label").select(F.col("label").alias("a"), F.col("id").alias("b")))
        labels = components(scratch, "rest-components", labels, links)
    known = scratch.table(copies.join(labels, "id", "left").select("k1", "k2", "id", F.coalesce("label", "id").alias("label")), "known")
    ids = ["rid", "doc_id", "t1", "t2"]
    named = worded.select(*ids, "k1", "k2").join(known, ["k1", "k2"]).select(*ids, "id", "label")
    # texts without a word share no key: they are left out of the join
    named = named.unionByName(rows.where("bands is null").select(*ids, F.col("rid").alias("id"), F.col("rid").alias("label")))
    made = scratch.table(named, "classes")
    for name in ("rows", "copies", "hopeful", "sets", "known"):
        scratch.drop(name)
    return made


def _firsts(made: DataFrame) -> DataFrame:
    """Of each label: its first row by (doc_id, rid) and its number of rows."""
    order = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id"), F.col("rid"), F.col("t1"), F.col("t2"))
    return made.groupBy("label").agg(F.min(order).alias("first"), F.count("*").alias("class_size"))


def near_copies(docs: DataFrame, like: float = LIKE, every_pair: bool = True) -> DataFrame:
    """doc_id, class_id (the first doc_id of the class), class_size and kept (whether the row is the first) for each row."""
    made = classes(docs, like, every_pair)
    first = Scratch(docs.sparkSession).table(_firsts(made), "firsts")
    out = made.join(first, "label")
    return out.select("doc_id", F.col("first.doc_id").alias("class_id"), F.col("class_size"), (F.col("rid") == F.col("first.rid")).alias("kept"))


def drop_near_copies(docs: DataFrame, like: float = LIKE) -> DataFrame:
    """One row of each class, its first by doc_id, with all columns of ``docs``."""
    first = _firsts(classes(docs, like)).select(F.col("first.doc_id").alias("_doc"), F.col("first.t1").alias("_t1"), F.col("first.t2").alias("_t2"))
    first = Scratch(docs.sparkSession).table(first.distinct(), "firsts")
    names = docs.columns
    rows = docs.select(*(F.col(c).alias(f"_{x}") for x, c in enumerate(names)), *_text_key("text"))
    ids = f"_{names.index('doc_id')}"
    same = F.col("t1").eqNullSafe(F.col("_t1")) & F.col("t2").eqNullSafe(F.col("_t2")) & F.col(ids).eqNullSafe(F.col("_doc"))
    kept = rows.join(first, same, "left_semi")
    once = kept.dropDuplicates(["t1", "t2", ids])
    return once.select(*(F.col(f"_{x}").alias(c) for x, c in enumerate(names)))


def op8_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "documents"))
