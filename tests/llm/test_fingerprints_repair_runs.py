"""Scaled sketches, conversation repair and periodic runs against plain restatements."""

import hashlib
import random
import re
import time
import zlib

import pytest
from pyspark.sql import functions as F

from ravelin.llm import conversation_repair, fingerprints, periodic_runs
from tests.llm.test_operators import documents, order

SPACE = " \t\n\x0b\x0c\r"


# --- 11 ---


def restated_sketch(text):
    """Kept hashes, one shingle at a time."""
    if not text:
        return set()
    parts = [text[k : k + fingerprints.SHINGLE] for k in range(max(1, len(text) - fingerprints.SHINGLE + 1))]
    hashes = set()
    for part in parts:
        codes = [ord(c) + 1 for c in part] + [0] * (fingerprints.SHINGLE - len(part))
        h = 0
        for c in codes:
            h = (h * 0x9E3779B97F4A7C15 + c) % 2**64
        h = ((h ^ h >> 30) * 0xBF58476D1CE4E5B9) % 2**64
        h = ((h ^ h >> 27) * 0x94D049BB133111EB) % 2**64
        hashes.add((h ^ h >> 31) >> 16)
    below = {h for h in hashes if h < 2**48 // fingerprints.SCALE}
    return below or {min(hashes)}


def restated_prints(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    alike = lambda a, b: 1.0 if a == b else len(a & b) / len(a | b)
    write = lambda s: "".join(f"{h:012x}" for h in sorted(s))
    out = []
    for k, (doc, text) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        a, b, c = map(restated_sketch, (text, edited, after))
        out.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), write(a), write(b), alike(a, b), alike(a, c)))
    return out


def texts(rng, n):
    words = [f"{chr(97 + i % 26)}{i}é𝄞"[: 2 + i % 5] for i in range(300)]
    return [(7 * k, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 2, 30, 200])))) for k in range(n)]


def test_fingerprints_equal_the_restatement(spark):
    rng = random.Random(11)
    rows = [(None, "first of all"), (-5, None), (3, ""), (1, "x"), (2, "ab"), (4, "word " * 5000), (10**12, "the last one, with some more"), *texts(rng, 150)[1:]]
    rows.append((rows[-1][0] + 1, rows[-1][1]))
    got = fingerprints.fingerprints(documents(spark, rows).repartition(7)).collect()
    assert order(got) == order(restated_prints(rows))
    by = {r.doc_id: r for r in got}
    assert by[4].n_chars == 25000 and by[1].edited_sha256 == hashlib.sha256(b"x").hexdigest() and by[1].near_edited == 1.0
    assert by[rows[-2][0]].near_next == 1.0 and by[-5].fingerprint == ""
    alone = fingerprints.fingerprints(documents(spark, [(1, "abcd")])).collect()
    assert [tuple(r) for r in alone] == restated_prints([(1, "abcd")]) and alone[0].near_next == 1.0
    assert fingerprints.fingerprints(documents(spark, [])).count() == 0
    assert {(r.doc_id, r.n_chars, r.fingerprint) for r in fingerprints.sketched(documents(spark, rows)).collect()} == {(r.doc_id, r.n_chars, r.fingerprint) for r in got}


def test_rows_of_one_id_follow_each_other(spark):
    rows = [(1, f"text number {k} of the same id") for k in range(40)] + [(1, "twice")] * 9 + [(2, "end")]
    got = fingerprints.fingerprints(documents(spark, rows).repartition(5)).collect()
    assert len(got) == 50 and sum(r.near_next == 1.0 for r in got if r.n_chars == 5) >= 8
    # every text but those before the copies' run has one successor of its own
    assert len({r.edited_sha256 for r in got}) >= 42


def test_likeness_and_containment_are_estimates_of_the_true_ones(spark):
    rng = random.Random(3)
    whole = " ".join(f"w{rng.randrange(9000)}" for _ in range(20000))
    part = whole[30000:36000]
    rows = documents(spark, [(1, whole), (2, part), (3, part[:3000] + "".join(chr(97 + rng.randrange(26)) for _ in range(3000)))])
    made = {r.doc_id: r.fingerprint for r in fingerprints.sketched(rows).collect()}
    table = spark.createDataFrame([(made[2], made[1], 1.0), (made[1], made[2], 6000 / len(whole)), (made[3], made[1], 0.5), ("", made[1], None)], "a string, b string, true double")
    for r in table.select(fingerprints.containment(F.col("a"), F.col("b")).alias("c"), "true").collect():
        assert (r.c is None and r.true is None) or abs(r.c - r.true) < 0.1


def test_sketches_of_unions(spark):
    rng = random.Random(4)
    rows = [(k, t) for k, t in texts(rng, 60) if t] + [(1001, "tiny"), (1003, "small")]
    made = fingerprints.sketched(documents(spark, rows)).withColumn("g", F.col("doc_id") % 2)
    got: dict = {}
    for r in fingerprints.union_hashes(made, "g").collect():
        got.setdefault(r.g, set()).add(int(r.hash, 16))
    for g in (0, 1):
        sketch = fingerprints.sketch("")
        for k, t in rows:
            if k % 2 == g:
                sketch = fingerprints.joined(sketch, fingerprints.sketch(t))
        assert got[g] == set(map(int, sketch))
    tiny = fingerprints.union_hashes(fingerprints.sketched(documents(spark, [(1, "a"), (2, "b"), (3, "a")])).withColumn("g", F.lit(None).cast("int")), "g").collect()
    kept = {h for t in "ab" for h in restated_sketch(t)}
    below = {h for h in kept if h < 2**48 // fingerprints.SCALE}
    assert {int(r.hash, 16) for r in tiny} == (below or {min(kept)})


# --- 12 ---


def restated_repair(rows):
    """One conversation of (turn, role, text): all ways over the rows, kept apart by what is written last."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
    faults, seen = [], set()
    for _, role, text in rows:
        bare = text.strip(SPACE)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    legal = {"": "su", "s": "u", "u": "a", "a": "u"}
    best = {"": (0, "", ())}

    def offer(to, state, way):
        to[state] = min(to.get(state, way), way)

    def with_inserts(ways):
        out = dict(ways)
        for _ in range(3):
            for state, (cost, audit, made) in list(out.items()):
                for ini in legal[state]:
                    if ini != "s":
                        offer(out, ini, (cost + 5, audit + "I", (*made, ({"u": "user", "a": "assistant"}[ini], ""))))
        return out

    for (_, role, text), fault in zip(rows, faults, strict=True):
        to = {}
        for state, (cost, audit, made) in with_inserts(best).items():
            offer(to, state, (cost + 2, audit + "D", made))
            if fault in ("", "truncated"):
                more = 5 * (fault == "truncated")
                for ini in legal[state]:
                    if role[:1] == ini:
                        offer(to, ini, (cost + more, audit + "K", (*made, (role, text))))
                    elif ini != "s":
                        offer(to, ini, (cost + more + 1, audit + "R", (*made, ({"u": "user", "a": "assistant"}[ini], text))))
        best = to
    cost, audit, made = min(way for state, way in with_inserts(best).items() if state in ("", "a"))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    text = "\n".join(f"{r}:{x}" for r, x in made)
    return (gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def talks(rng, n, longest=9):
    rows = []
    for conv in [None, *range(n)]:
        for turn in range(rng.randrange(longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "uno"])
            text = rng.choice(["Hi.", "What?", "Yes!", "cut off", "", " \t", None, f"t{rng.randrange(20)}.", "a é.", "line\nbreak. \n"])
            rows.append((conv, rng.choice([turn, turn, turn, None, turn + 3]), role, text))
    return rows


def grouped(rows):
    by: dict = {}
    for conv, *row in rows:
        by.setdefault(conv, []).append(tuple(row))
    return by


def turns_of(spark, rows):
    made = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for name in ("at", "head", "base", "code", "k1", "audit", "position", "fault"):
        made = made.withColumn(name, F.lit("x"))
    return made


@pytest.mark.parametrize("stretch", [256, 2])
def test_repair_equals_the_restatement(spark, monkeypatch, stretch):
    monkeypatch.setattr(conversation_repair, "STRETCH", stretch)
    monkeypatch.setattr(conversation_repair, "BATCH", 40)
    rows = talks(random.Random(12), 120)
    rows += [(500, k, "user" if k % 3 else "assistant", f"text {k % 11}" + ".?"[k % 2] * (k % 5 > 0)) for k in range(400)] + rows[:20]
    turns = turns_of(spark, rows)
    every = spark.createDataFrame([(c,) for c in [None, 999, 500, *range(120)]], "conv_id long")
    got = conversation_repair.repair(turns.repartition(6), every).collect()
    by = grouped(rows)
    assert order(got) == order((c, *restated_repair(by.get(c, []))) for c in [None, 999, 500, *range(120)])


def test_repaired_turns_fit_the_grammar(spark):
    rows = talks(random.Random(13), 40)
    found, kept = conversation_repair.repaired(turns_of(spark, rows))
    audits = {r.conv_id: r.audit for r in found.collect()}
    by: dict = {}
    for r in kept.collect():
        by.setdefault(r.conv_id, []).append(r)
    for conv, turns in by.items():
        turns.sort(key=lambda r: r.position)
        assert [r.position for r in turns] == list(range(len(turns)))
        assert re.fullmatch("s?(ua)+", "".join(r.role[0] for r in turns))
        assert audits[conv].replace("D", "") == "".join(r.edit for r in turns)


def test_no_cheaper_repair_by_trying_all(spark):
    rng = random.Random(14)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["a.", "b", "", "c!"])) for c in range(60) for t in range(rng.randrange(4))]

    def tried(given):
        """The least (cost, audit) over all strings of edits with at most two insertions in each gap."""
        best = None
        todo = [(0, 0, "", "", 0)]
        faults, seen = [], set()
        for _, role, text in given:
            faults.append("x" if not text or (role, text) in seen else "" if text[-1] in ".!?" else "cut")
            seen.add((role, text))
        while todo:
            k, cost, audit, roles, inserts = todo.pop()
            if k == len(given) and re.fullmatch("(s?(ua)+)?", roles):
                best = min(best or (cost, audit), (cost, audit))
            wanted = "a" if roles[-1:] == "u" else "u"
            if inserts < 2:
                todo.append((k, cost + 5, audit + "I", roles + wanted, inserts + 1))
            if k < len(given):
                todo.append((k + 1, cost + 2, audit + "D", roles, 0))
                if faults[k] != "x":
                    own, extra = given[k][1][0], 5 * (faults[k] == "cut")
                    if own == wanted or (own == "s" and not roles):
                        todo.append((k + 1, cost + extra, audit + "K", roles + own, 0))
                    if own != wanted:
                        todo.append((k + 1, cost + extra + 1, audit + "R", roles + wanted, 0))
        return best

    every = spark.createDataFrame([(c,) for c in grouped(rows)], "conv_id long")
    got = {r.conv_id: (r.cost, r.audit) for r in conversation_repair.repair(turns_of(spark, rows), every).collect()}
    assert got == {c: tried(given) for c, given in grouped(rows).items()}


def test_repair_of_nothing(spark):
    none = turns_of(spark, [])
    assert conversation_repair.repair(none, none).count() == 0
    one = spark.createDataFrame([(5,)], "conv_id long")
    assert [tuple(r) for r in conversation_repair.repair(none, one).collect()] == [(5, 0, 0, 0, 0, 0, 0, "", conversation_repair.EMPTY_SHA256)]


def test_damage_goes_by_the_checksum(spark):
    rows = [(c, t, "assistant", "One. Two? Three!") for c in range(20) for t in range(5)] + [(None, None, None, None)]
    wanted = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        made = (c, t, "user" if kind == 4 else role, "" if kind == 1 else "One Two Three" if kind == 2 else text)
        wanted += [made] * (0 if kind == 0 else 2 if kind == 3 else 1)
    assert order(conversation_repair.damaged(turns_of(spark, rows)).collect()) == order(wanted)


# --- 13 ---


def restated_runs(words, times=4, least=6):
    """Every period by itself; a stretch that has a smaller period as well isn't its run."""
    out = []
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            s = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            n = i + q - s
            if i > s and n >= max(least, times * q) and not any(all(words[x] == words[x + p] for x in range(s, s + n - p)) for p in range(1, q)):
                out.append((s, n, q))
            i = max(i, s + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def restated_report(doc, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc).encode()) if doc is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    runs = restated_runs(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    told = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc, len(runs), *told, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_runs_equal_brute_force():
    rng = random.Random(13)
    for _ in range(4000):
        size = rng.choice([1, 2, 2, 3, 5])
        a = [rng.randrange(size) for _ in range(rng.randrange(45))]
        if a and rng.random() < 0.6:
            s, p = rng.randrange(len(a)), rng.randrange(1, 7)
            for i in range(s + p, len(a)):
                a[i] = a[i - p]
            a += [rng.randrange(size) for _ in range(rng.randrange(4))]
        words = [str(x).encode() for x in a]
        for times, least in ((4, 6), (2, 1), (3, 3), (5, 20)):
            assert periodic_runs.runs_of(words, times, least) == restated_runs(words, times, least)


def test_next_smaller_suffixes():
    rng = random.Random(1)
    for _ in range(500):
        a = [rng.randrange(rng.choice([1, 2, 3])) for _ in range(rng.randrange(25))]
        after, agree = periodic_runs.next_smaller(a)
        assert after == [next((j for j in range(i + 1, len(a)) if a[j:] < a[i:]), len(a)) for i in range(len(a))]
        for i, j in enumerate(after):
            if j < len(a):
                m = agree[i]
                assert a[i : i + m] == a[j : j + m] and (j + m == len(a) or a[i + m] != a[j + m])


@pytest.mark.parametrize("name", ["one", "fibonacci", "ruler", "period", "blocks"])
def test_runs_take_linear_time(name):
    fibonacci = [[0], [0, 1]]
    while len(fibonacci[-1]) < 160_000:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    make = {
        "one": lambda n: [1] * n,
        "fibonacci": lambda n: fibonacci[-1][:n],
        "ruler": lambda n: [(i & -i).bit_length() for i in range(1, n)],
        "period": lambda n: list(range(n // 5)) * 5,
        "blocks": lambda n: ([0] * 300 + [1]) * (n // 301),
    }[name]
    took = []
    for n in (40_000, 160_000):
        began = time.process_time()
        periodic_runs.lyndon_runs(make(n))
        took.append(time.process_time() - began)
    assert took[1] < 8 * took[0] + 0.5


def test_reported_runs(spark):
    rng = random.Random(9)
    rows = [(None, "la " * 9), (1, None), (2, ""), (3, " \t\n"), (4, "a b " * 3 + "a b c"), (4, "a b " * 3 + "a b c"), (5, "x " * 6), (6, "x " * 5), (7, "no break " * 7), (8, "x y " * 700)]
    rows += [(k, " ".join(rng.choice("a b c ü".split()) for _ in range(rng.randrange(60)))) for k in range(20, 260)]
    got = periodic_runs.reported(periodic_runs.periodic_runs(periodic_runs.planted(documents(spark, rows)))).collect()
    assert order(got) == order(restated_report(*r) for r in rows)
    assert sum(r.n_runs > 0 for r in got) > 20
    assert periodic_runs.reported(periodic_runs.periodic_runs(periodic_runs.planted(documents(spark, [])))).count() == 0
    kept = {r.doc_id: (r.collapsed, [tuple(x) for x in r.runs]) for r in periodic_runs.periodic_runs(documents(spark, [(1, "go go go go go go now"), (2, "a  b\tc")])).collect()}
    assert kept == {1: ("go now", [(0, 6, 1)]), 2: ("a b c", [])}
