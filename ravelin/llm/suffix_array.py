"""Suffix ranks of many strings by the difference-cover algorithm, as Spark jobs.

Positions that are 1 or 2 modulo 3 are sampled.  Their triples of symbols are
sorted and named; the names of each residue make up a string of a third of the
length, on which the algorithm recurses.  The remaining suffixes are merged by
sorting them with each sampled residue: (symbol, rank of the next suffix) with
those that are 1, and (two symbols, rank of the one after) with those that are
2.  A rank is the number of smaller suffixes, so equal suffixes share a rank.

Every step is a grouping of distinct keys, a range partitioning with running
counts, and a join back; the driver sees a number for each partition.  All
positions of the text are shuffled several times on each level, so this is for
inputs of moderate size (figures in the README); ``suffix_dedup`` gives the
same repeated strings for large ones.

Edge cases: strings that are null or empty have no suffix; a suffix that is the
beginning of another is the smaller one; strings of any length; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ravelin.scratch import Scratch


def _smaller(scratch: Scratch, name: str, rows: DataFrame, keys: list[str], flags: list[str]) -> DataFrame:
    """``rows`` with, for each flag, the number of flagged rows (0 or 1 in the flag's column) whose keys are smaller (nulls least)."""
    kinds = rows.groupBy(*keys).agg(*(F.sum(f).alias(f) for f in flags))
    dealt = scratch.table(kinds.repartitionByRange(*keys).withColumn("part", F.spark_partition_id()), f"{name}-kinds")
    upto = lambda w, f: F.coalesce(F.sum(f).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = dealt.groupBy("part").agg(*(F.sum(f).alias(f) for f in flags))
    before = Window.orderBy("part")  # a row for each partition
    parts = parts.select("part", *(upto(before, f).alias(f"{f}_before") for f in flags))
    inside = Window.partitionBy("part").orderBy(*keys)
    counted = dealt.select("part", *keys, *(upto(inside, f).alias(f"{f}_in") for f in flags)).join(F.broadcast(parts), "part")
    counted = counted.select(*(F.col(k).alias(f"_{k}") for k in keys), *((F.col(f"{f}_in") + F.col(f"{f}_before")).alias(f"n_{f}") for f in flags))
    same = [rows[k].eqNullSafe(counted[f"_{k}"]) for k in keys]
    on = same[0]
    for one in same[1:]:
        on = on & one
    return rows.join(counted, on).drop(*(f"_{k}" for k in keys))


def suffix_ranks(symbols: DataFrame, level: int = 0, scratch: Scratch | None = None) -> DataFrame:
    """d, i and r of every suffix, for symbols (d string, i place from 0 without gaps, s symbol of any long)."""
    scratch = scratch or Scratch(symbols.sparkSession)
    own = Window.partitionBy("d").orderBy("i")
    ahead = symbols.select("d", "i", "s", F.lead("s", 1).over(own).alias("s1"), F.lead("s", 2).over(own).alias("s2"))
    ahead = scratch.table(ahead, f"{level}-symbols").withColumn("one", F.lit(1))
    if not ahead.where("i >= 3").limit(1).count():  # a triple is all of a suffix
        return scratch.table(_smaller(scratch, f"{level}-all", ahead, ["s", "s1", "s2"], ["one"]).select("d", "i", F.col("n_one").alias("r")), f"{level}-ranks")
    sampled = ahead.where("i % 3 != 0")
    named = _smaller(scratch, f"{level}-triples", sampled, ["s", "s1", "s2"], ["one"])
    thirds = named.select((F.col("d") * 2 + F.col("i") % 3 - 1).alias("d"), F.floor((F.col("i") - F.col("i") % 3) / 3).cast("int").alias("i"), F.col("n_one").alias("s"))
    ranks = suffix_ranks(scratch.table(thirds, f"{level}-thirds"), level + 1, scratch)
    ranks = ranks.select(F.floor(F.col("d") / 2).alias("d"), (F.col("i") * 3 + F.pmod("d", F.lit(2)) + 1).cast("int").alias("i"), "r")
    both = ahead.drop("one").join(ranks, ["d", "i"], "left")
    full = both.select("d", "i", "s", "s1", "r", F.lead("r", 1).over(own).alias("r1"), F.lead("r", 2).over(own).alias("r2"))
    for k in range(3):
        full = full.withColumn(f"is{k}", (F.col("i") % 3 == k).cast("int"))
    full = scratch.table(full, f"{level}-full")
    one = _smaller(scratch, f"{level}-with-1", full.where("i % 3 != 2"), ["s", "r1"], ["is0", "is1"])
    two = _smaller(scratch, f"{level}-with-2", full.where("i % 3 != 1"), ["s", "s1", "r2"], ["is0", "is2"])
    rest = one.where("is0 = 1").select("d", "i", (F.col("n_is0") + F.col("n_is1")).alias("a")).join(two.where("is0 = 1").select("d", "i", F.col("n_is2").alias("b")), ["d", "i"])
    out = rest.select("d", "i", (F.col("a") + F.col("b")).alias("r"))
    out = out.unionByName(one.where("is1 = 1").select("d", "i", (F.col("r") + F.col("n_is0")).alias("r")))
    out = out.unionByName(two.where("is2 = 1").select("d", "i", (F.col("r") + F.col("n_is0")).alias("r")))
    return scratch.table(out, f"{level}-ranks")


def repeated_starts(texts: DataFrame, length: int = 200) -> DataFrame:
    """d and i of every byte position whose next ``length`` bytes start elsewhere too, for texts (d, text): prefixes of neighbours in rank are compared."""
    scratch = Scratch(texts.sparkSession)
    hexed = texts.where(F.coalesce("text", F.lit("")) != "").select("d", F.hex(F.encode("text", "UTF-8")).alias("x"))
    places = hexed.select("d", "x", F.explode(F.sequence(F.lit(0), F.floor(F.length("x") / 2).cast("int") - 1)).alias("i"))
    symbols = places.select("d", "i", F.conv(F.substr("x", F.col("i") * 2 + 1, F.lit(2)), 16, 10).cast("bigint").alias("s"))
    ranks = suffix_ranks(scratch.table(symbols, "symbols"), 0, scratch)
    prefix = places.where(F.length("x") >= (F.col("i") + length) * 2).select("d", "i", F.md5(F.substr("x", F.col("i") * 2 + 1, F.lit(2 * length)).cast("binary")).alias("p"))
    # equal prefixes are neighbours, so it is enough to count them where they stand together
    sorted_ = scratch.table(prefix.join(ranks, ["d", "i"]).repartitionByRange("r"), "sorted").withColumn("part", F.spark_partition_id())
    at = scratch.table(sorted_, "dealt")
    near = Window.partitionBy("part").orderBy("r", "d", "i")
    at = at.withColumn("up", F.lag("p").over(near)).withColumn("down", F.lead("p").over(near))
    edge = at.where("up is null or down is null")
    ends = Window.orderBy("r", "d", "i")  # two rows for each partition
    edge = edge.withColumn("up", F.coalesce("up", F.lag("p").over(ends))).withColumn("down", F.coalesce("down", F.lead("p").over(ends)))
    inner = at.where("up is not null and down is not null")
    return inner.unionByName(edge).where("p = up or p = down").select("d", "i")
