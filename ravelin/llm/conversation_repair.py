"""Repair of the structure of conversations at the least cost.

A repaired conversation's roles begin with s (once, or not at all), u, a, u, a
and so on, and end with a; or there are none.  Rows may be kept, given another
role or deleted, and rows without text inserted.  A state of the grammar is what
the output so far allows next: 0 nothing written yet, 1 after s, 2 after u, 3
after a; 0 and 3 may end.

Which edits are open to a row depends on one letter alone: the initial of its
role, in upper case where its text is cut off, or x where it must go.  A
recursive query of DuckDB in hash-partitioned batches advances all groups of a
batch by one turn at a time and keeps, for each state, the least cost and the
audit of its edits (of equal costs the least in ASCII order).  One audit of the
same cost can't begin with another, so the best way to a state is part of
every best way through it, and tables from state to state can be chained.  Long
conversations are therefore cut into stretches of ``STRETCH`` turns: these are
walked from every state, then the stretches of each sorted part of the rows,
then the parts, by the same query.  No conversation is gathered in one task
but to write its repaired turns in order, which is a stream over sorted rows.

Edge cases: a null role or text is one space; a null turn comes first; rows of
one turn are ordered by role, then by the MD5 of the text; repeated rows are
rows of their own, of which the later are duplicates; rows with a null conv_id
are one conversation with a null id; an empty role or another initial than s, u
and a can't be kept; very long texts travel as they are, and only their last
character decides; a conversation without rows costs nothing and is empty; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ravelin.llm.common import CRC32_SQL, digest
from ravelin.scratch import Scratch
from ravelin.sources.tables import table

#: Turns that are walked in one group, and rows that a DuckDB query takes at once (whole groups).
STRETCH, BATCH = 256, 20_000
STATES = (0, 1, 2, 3)
RENAME, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5
BLANK = r"[^ \t-\r]"
ENDED = r"[.!?][ \t-\r]*\z"

#: What may be written next: from each state by initial.
WRITES = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def _inserted(state: int) -> list[tuple[int, int, str]]:
    """(state, cost, audit) of all that inserted rows lead to; a second time in a state is never cheaper."""
    out, seen = [(state, 0, "")], {state}
    for at, cost, audit in out:
        for initial, to in WRITES[at].items():
            if initial != "s" and to not in seen:
                seen.add(to)
                out.append((to, cost + INSERT, audit + "I"))
    return out


@lru_cache(maxsize=1)
def moves() -> pa.Table:
    """code, state, next, cost, audit: the best way over a row of a code from one state to another, insertions before it included."""
    best: dict[tuple[str, int, int], tuple[int, str]] = {}

    def offer(code: str, state: int, to: int, cost: int, audit: str) -> None:
        key = (code, state, to)
        best[key] = min(best.get(key, (cost, audit)), (cost, audit))

    for code in "suaoSUAOx":
        for state in STATES:
            for at, cost, audit in _inserted(state):
                offer(code, state, at, cost + DELETE, audit + "D")
                extra = CUT_OFF if code.isupper() else 0
                for initial, to in WRITES[at].items() if code != "x" else ():
                    if initial == code.lower():
                        offer(code, state, to, cost + extra, audit + "K")
                    elif initial != "s":
                        offer(code, state, to, cost + extra + RENAME, audit + "R")
    rows = [(*k, *v) for k, v in sorted(best.items())]
    return pa.table(dict(zip(("code", "state", "next", "cost", "audit"), map(list, zip(*rows, strict=True)), strict=True)))


#: ``item`` has grp, k (from 0), state, next, cost, audit and alone (whether only the first state is asked for).
WALK = """
WITH RECURSIVE walk(grp, start, k, state, cost, audit) USING KEY (grp, start, state) AS (
  SELECT DISTINCT grp, s.s, 0::BIGINT, s.s, 0::BIGINT, '' FROM item, (VALUES (0), (1), (2), (3)) s(s) WHERE s.s = 0 OR NOT alone
  UNION
  SELECT grp, start, k + 1, next, best.cost, best.audit FROM (
    SELECT w.grp, w.start, w.k, i.next, min({'cost': w.cost + i.cost, 'audit': w.audit || i.audit}) AS best
    FROM walk w JOIN item i ON i.grp = w.grp AND i.k = w.k AND i.state = w.state GROUP BY ALL)
)
SELECT w.grp, w.start::INTEGER AS state, w.state::INTEGER AS next, w.cost::BIGINT AS cost, w.audit
FROM walk w JOIN (SELECT grp, max(k) + 1 AS n FROM item GROUP BY grp) g ON g.grp = w.grp AND g.n = w.k
"""


def walked(items: DataFrame) -> DataFrame:
    """grp, state, next, cost, audit of the best way over the rows k = 0, 1, .. of every group; ``items`` has a code for each row, or its ways as state, next, cost and audit."""
    coded = "code" in items.columns
    names = ["grp", "state", "next", "cost", "audit"]

    def solved(con: duckdb.DuckDBPyConnection, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        con.register("given", rows)
        if coded:
            con.execute("CREATE OR REPLACE TEMP TABLE item AS SELECT grp, k, alone, m.state, m.next, m.cost, m.audit FROM given JOIN moves m USING (code)")
        else:
            con.execute("CREATE OR REPLACE TEMP TABLE item AS FROM given")
        found = con.sql(WALK).to_arrow_table()
        con.unregister("given")
        types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string()]
        yield from found.select(names).cast(pa.schema(list(zip(names, types, strict=True)))).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = duckdb.connect(config={"threads": 1, "memory_limit": "500MB", "temp_directory": ""})
        con.register("moves", moves())
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < BATCH:
                continue
            rows = pa.Table.from_batches(held)
            groups = rows.column("grp").to_numpy()
            whole = int((groups != groups[-1]).sum())  # rows are sorted, so the last group's stand at the end
            if whole:
                yield from solved(con, rows.slice(0, whole))
                held = rows.slice(whole).to_batches()
        if rest := [b for b in held if b.num_rows]:
            yield from solved(con, pa.Table.from_batches(rest))
        con.close()

    dealt = items.repartition("grp").sortWithinPartitions("grp", "k")
    return dealt.mapInArrow(run, "grp bigint, state int, next int, cost bigint, audit string")


def _placed(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id, turn, role, text and at, a number that grows in order and whose upper bits name the sorted part."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    order = ["conv_id", "turn", "role", F.md5("text")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return scratch.table(dealt.withColumn("at", F.monotonically_increasing_id()), "rows")


def _judged(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Without texts: conv_id, at, head (the conversation's first at), base (its first in the part), place of the part, and what is wrong with each row."""
    text = F.col("text")
    fault = F.when(~text.rlike(BLANK), "blank").when(~text.rlike(ENDED), "truncated")
    slim = rows.select("conv_id", "at", F.shiftright("at", 33).alias("part"), "turn", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"), *digest(F.col("role"), text))
    slim = scratch.table(slim, "slim")
    # a row is the first of its kind if it has the least number of them
    fresh = slim.groupBy("conv_id", "k1", "k2").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("fresh"))
    inside = Window.partitionBy("conv_id", "part")
    before = inside.orderBy("at")
    slim = slim.join(fresh, "at", "left").withColumns(
        {
            "fault": F.when(F.col("fault") == "blank", "blank").when(F.col("fresh").isNull(), "duplicate").otherwise(F.col("fault")),
            "base": F.min("at").over(inside),
            "size": F.count("*").over(inside),
            "turn_before": F.lag("turn").over(before),
            "initial_before": F.lag("initial").over(before),
        }
    )
    # conversations on both sides of a part's edge: two for each part at most, which bounds what is broadcast
    ends = scratch.table(rows.groupBy("conv_id", F.shiftright("at", 33).alias("part")).agg(F.min("at").alias("first"), F.max_by(F.struct("turn", F.substring("role", 1, 1).alias("initial")), "at").alias("last")), "ends")
    line = Window.partitionBy("conv_id").orderBy("part")
    over = ends.select(
        F.col("conv_id").alias("_conv"),
        F.col("part").alias("_part"),
        F.min("first").over(Window.partitionBy("conv_id")).alias("head"),
        F.count("*").over(Window.partitionBy("conv_id")).alias("parts"),
        (F.row_number().over(line) - 1).alias("place"),
        F.lag("last").over(line).alias("past"),
    ).where("parts > 1")
    over = F.broadcast(scratch.table(over, "over"))
    met = slim.join(over, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("part") == F.col("_part")), "left")
    first = F.col("at") == F.col("base")
    turn_before = F.when(first, F.col("past.turn")).otherwise(F.col("turn_before"))
    initial_before = F.when(first, F.col("past.initial")).otherwise(F.col("initial_before"))
    stretch = F.floor((F.col("at") - F.col("base")) / STRETCH)
    letter = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    made = met.select(
        "conv_id",
        "at",
        "turn",
        "fault",
        "base",
        F.coalesce("head", "base").alias("head"),
        F.coalesce("parts", F.lit(1)).alias("parts"),
        F.coalesce("place", F.lit(0)).cast("bigint").alias("place"),
        stretch.alias("stretch"),
        F.ceil(F.col("size") / STRETCH).alias("stretches"),
        F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper(letter)).otherwise(letter).alias("code"),
        (F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(turn_before)).alias("new_turn"),
        (initial_before.isNotNull() & ~F.concat(initial_before, "initial").isin("su", "ua", "au")).alias("illegal"),
    )
    return scratch.table(made, "judged")


def _best(judged: DataFrame, scratch: Scratch) -> DataFrame:
    """head, cost and audit of the best repair of every conversation."""
    seg = F.col("base") + F.col("stretch") * STRETCH
    alone = (F.col("parts") == 1) & (F.col("stretches") == 1)
    turns = judged.select(seg.alias("grp"), (F.col("at") - seg).alias("k"), "code", alone.alias("alone"))
    found = scratch.table(walked(turns), "stretches")
    # chained within each part, then over the parts; groups of one member pass as they are
    for level, (by, n, grp, k) in enumerate([(seg, "stretches", "base", "stretch"), (F.col("base"), "parts", "head", "place")]):
        keys = judged.groupBy(by.alias("grp")).agg(F.first(grp).alias("up"), F.first(k).alias("k"), F.first(n).alias("n"), F.first("parts").alias("parts"))
        up = scratch.table(found.join(keys, "grp").withColumn("grp", F.col("up")), f"level-{level}")
        one = up.where("n = 1").select("grp", "state", "next", "cost", "audit")
        many = up.where("n > 1").select("grp", "k", "state", "next", "cost", "audit", (F.lit(level == 1) | (F.col("parts") == 1)).alias("alone"))
        found = one.unionByName(walked(many))
    ends = F.broadcast(judged.sparkSession.createDataFrame([(s, c, a) for s in STATES for to, c, a in _inserted(s) if to in (0, 3) and (s == to or to == 3)], "next int, more bigint, rest string"))
    done = found.where("state = 0").join(ends, "next").groupBy("grp").agg(F.min(F.struct((F.col("cost") + F.col("more")).alias("cost"), F.concat("audit", "rest").alias("audit"))).alias("b"))
    return done.select(F.col("grp").alias("head"), "b.*")


def repaired_turns(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """conv_id, position, role, text and edit of the repaired turns, in order within partitions, each conversation in one of them.

    ``rows`` has conv_id, at, role, text; ``audits`` conv_id and audit.  A
    conversation's audit goes before its rows; nothing else is held.
    """
    plans = audits.select("conv_id", F.lit(-1).cast("bigint").alias("at"), F.lit(None).cast("string").alias("role"), F.col("audit").alias("text"))
    both = rows.select("conv_id", "at", "role", "text").unionByName(plans).repartition("conv_id").sortWithinPartitions("conv_id", "at")
    kind = rows.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "position", "role", "text", "edit"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, edits, at, position, wanted = None, "", 0, 0, "u"

        def inserts(out: list) -> str:
            """Write what is inserted here; the next other edit."""
            nonlocal at, position, wanted
            while at < len(edits):
                edit, at = edits[at], at + 1
                if edit != "I":
                    return edit
                out.append((conv, position, "user" if wanted == "u" else "assistant", "", "I"))
                position, wanted = position + 1, "a" if wanted == "u" else "u"
            return ""

        for batch in batches:
            out: list[tuple] = []
            for conv_id, place, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if place < 0:
                    inserts(out)  # the end of the conversation before
                    conv, edits, at, position, wanted = conv_id, text, 0, 0, "u"
                elif (edit := inserts(out)) in ("K", "R"):
                    if edit == "R":
                        role = "user" if wanted == "u" else "assistant"
                    out.append((conv, position, role, text, edit))
                    position, wanted = position + 1, "a" if role[0] == "u" else "u"
            kinds = [batch.schema.field(0).type, pa.int64(), *[pa.string()] * 3]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 5, kinds, strict=True)], names=names)
        last: list[tuple] = []
        inserts(last)
        if last:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*last, strict=True), kinds, strict=True)], names=names)

    return both.mapInArrow(run, f"conv_id {kind}, position bigint, role string, text string, edit string")


def digested(turns: DataFrame) -> DataFrame:
    """conv_id and repaired_sha256 of ``role:text`` of the turns of ``repaired_turns``, joined by line feeds."""
    kind = turns.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, made = None, None
        for batch in batches:
            out = []
            for conv_id, position, role, text in zip(*(c.to_pylist() for c in batch.columns[:4]), strict=True):
                if position == 0:
                    if made is not None:
                        out.append((conv, made.hexdigest()))
                    conv, made = conv_id, hashlib.sha256()
                else:
                    made.update(b"\n")
                made.update(f"{role}:{text}".encode())
            kinds = [batch.schema.field(0).type, pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 2, kinds, strict=True)], names=["conv_id", "repaired_sha256"])
        if made is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv], kinds[0]), pa.array([made.hexdigest()])], names=["conv_id", "repaired_sha256"])

    return turns.mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def repaired(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is wrong with each conversation of ``turns`` (conv_id, turn, role, text), its cost and audit; and its repaired turns."""
    scratch = Scratch(turns.sparkSession)
    rows = _placed(turns, scratch)
    judged = _judged(rows, scratch)
    best = _best(judged, scratch)
    count = lambda test: F.sum(F.when(test, 1).otherwise(0))
    counts = judged.groupBy("head").agg(
        F.first("conv_id").alias("conv_id"),
        F.coalesce(F.max("turn") - F.min("turn") + 1 - count(F.col("new_turn")), F.lit(0)).cast("bigint").alias("gaps"),
        *(count(F.col("fault") == name).alias(name) for name in ("blank", "duplicate", "truncated")),
        count(F.col("illegal")).alias("illegal"),
    )
    found = scratch.table(counts.join(best, "head").drop("head"), "found")
    return found, repaired_turns(rows, found)


def repair(turns: DataFrame, every: DataFrame) -> DataFrame:
    """A row for each conv_id of ``every``: gaps, blank, duplicate, truncated, illegal, cost, audit and the digest of the repaired turns."""
    found, kept = repaired(turns)
    ids = every.select("conv_id").distinct()
    met = found.join(digested(kept).withColumnRenamed("conv_id", "_id"), F.col("conv_id").eqNullSafe(F.col("_id")), "left").drop("_id").withColumnRenamed("conv_id", "_conv")
    out = ids.join(met, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    numbers = [F.coalesce(n, F.lit(0)).cast("bigint").alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(EMPTY_SHA256)).alias("repaired_sha256"))


def damaged(turns: DataFrame) -> DataFrame:
    """``turns`` with faults, chosen by a checksum of conv_id and turn: rows missing, emptied, without ends of sentences, repeated, or all of users."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    rows = turns.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), (F.crc32(key) % 20).alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))).drop("col")


def op12_recursive_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return repair(damaged(turns), turns)


ORACLE = rf"""
WITH RECURSIVE t AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {CRC32_SQL.format(s="coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS kind FROM conversations),
d AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS again FROM t WHERE kind <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), again) AS k FROM d),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^ \t-\r]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][ \t-\r]*\z') THEN 'truncated' ELSE '' END AS fault,
             lag(role[1]) OVER (PARTITION BY conv_id ORDER BY k) || role[1] AS pair FROM o),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
             count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM f GROUP BY conv_id),
writes(state, ini, next) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
ins(state, next, cost, audit) AS (VALUES (0, 0, 0, ''), (0, 2, 5, 'I'), (0, 3, 10, 'II'), (1, 1, 0, ''), (1, 2, 5, 'I'), (1, 3, 10, 'II'), (2, 2, 0, ''), (2, 3, 5, 'I'), (3, 3, 0, ''), (3, 2, 5, 'I')),
way AS (SELECT f.conv_id, k, w.state, w.next, CASE WHEN ini = role[1] THEN 0 ELSE 1 END + CASE fault WHEN 'truncated' THEN 5 ELSE 0 END AS cost, CASE WHEN ini = role[1] THEN 'K' ELSE 'R' END AS edit FROM f, writes w WHERE fault NOT IN ('blank', 'duplicate') AND (ini = role[1] OR ini <> 's')
  UNION ALL SELECT f.conv_id, k, s, s, 2, 'D' FROM f, range(4) r(s)),
walk AS (SELECT conv_id, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS state, {{'cost': CAST(0 AS BIGINT), 'audit': ''}} AS best FROM c
  UNION ALL SELECT w.conv_id, w.k + 1, CAST(y.next AS BIGINT), min({{'cost': CAST(w.best.cost + i.cost + y.cost AS BIGINT), 'audit': w.best.audit || i.audit || y.edit}}) FROM walk w JOIN ins i ON i.state = w.state JOIN way y ON y.conv_id IS NOT DISTINCT FROM w.conv_id AND y.k = w.k + 1 AND y.state = i.next GROUP BY w.conv_id, w.k, y.next),
best AS (SELECT c.conv_id, min({{'cost': w.best.cost + i.cost, 'audit': w.best.audit || i.audit}}) AS b FROM c JOIN walk w ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND w.k = c.n JOIN ins i ON i.state = w.state AND i.next IN (0, 3) GROUP BY c.conv_id),
e AS (SELECT conv_id, b.audit AS audit, unnest(range(1, length(b.audit) + 1)) AS p FROM best),
g AS (SELECT conv_id, p, audit[p] AS edit, length(replace(audit[:p], 'I', '')) AS k, length(replace(audit[:p], 'D', '')) AS n FROM e),
h AS (SELECT g.conv_id, p, edit, n, role, text, max(CASE WHEN n = 1 AND edit = 'K' AND role[1] = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY g.conv_id) AS led FROM g LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM g.conv_id AND f.k = g.k AND edit <> 'I' WHERE edit <> 'D'),
r AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (n - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY p) AS whole FROM h GROUP BY conv_id),
ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT ids.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
       CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(b.cost, 0) AS BIGINT) AS cost, coalesce(b.audit, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM ids LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM ids.conv_id
"""
