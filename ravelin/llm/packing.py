"""Best-fit packing by a configuration linear program.

Pieces of at most ``capacity`` tokens are packed into as few sequences as
possible.  Only the histogram of piece lengths (at most ``capacity`` numbers)
reaches the driver.  There the linear program over packing patterns is solved
approximately by multiplicative weights: each round prices a piece length by
its weight over its demand, finds the most valuable pattern with a knapsack
dynamic program, uses it for a number of sequences and lowers the weights of
what it covers.  The rounded patterns (those that leave little room) leave a
remainder, which is placed by best fit, group by group, into the free room of
the patterns and then into new sequences.  The result is a small table of slots
(length, rank range, sequence, offset) that Spark joins with the ranked pieces.

Edge cases: a null text counts as empty and gives one piece with the end id;
an empty table gives an empty result; repeated rows are packed one by one;
other columns of the input are ignored; a text may have any length.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ravelin.llm.common import small_batches
from ravelin.scratch import Scratch
from ravelin.sources.tables import table

CAPACITY = 1024
END_ID = 2
#: Rounds of multiplicative weights and the fraction of the scarcest demand that a round covers.
ROUNDS = 300
SHARE = 0.5
#: Bounds on the room that a used pattern leaves, tried besides none and any.
SLACKS = (1, 4, 16)
#: Entries that a worker keeps of its map from words to ids.
CACHE = 200_000
#: Ranks within a length are counted in so many parts at least.
PARTS = 64

# Fixed value: the one special string of the vocabulary.
SPECIAL = "<|endoftext|>"
#: Texts with other bytes in Latin-1, or with white space after a space, go to the tokenizer whole.
PLAIN = bytes(x for x in range(256) if 9 <= x <= 13 or 32 <= x <= 177 or x in (180, 181, 182, 183, 184, 186, 187) or x >= 191)
GAPS = tuple(" " + x for x in " \t\n\x0b\x0c\r\x85\xa0")


class _Words(dict):
    """Little-endian ids of a word after a space, made on first sight.

    A byte-level BPE splits before a space that white space neither precedes
    nor follows, so the ids of a text are those of its words in a row.
    """

    def __init__(self, encode, encode_piece):
        super().__init__()
        self.encode, self.encode_piece = encode, encode_piece
        self.marks = {x: np.asarray(encode(x), "<u4").tobytes() for x in ",."}

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        if word.isalpha():
            ids = array("I", self.encode_piece((" " + word).encode())).tobytes()
        elif word[-1:] in self.marks and word[:-1].isalpha():
            ids = self[word[:-1]] + self.marks[word[-1]]
        else:
            ids = array("I", self.encode(" " + word)).tobytes()
        self[word] = ids
        return ids


class WordTokenizer:
    """Ids of whole texts by one tokenizer file, with a bounded map from words to their ids."""

    loaded: dict[str, WordTokenizer] = {}

    def __init__(self, path: str):
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        ranks = {bytes(map(byte.__getitem__, w)): i for w, i in self.whole.get_vocab().items() if w != SPECIAL}
        made = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.encode = made.encode_ordinary
        self.words = _Words(self.encode, made._core_bpe.encode_single_piece)

    @classmethod
    def load(cls, path: str) -> WordTokenizer:
        """One per worker process and file."""
        if path not in cls.loaded:
            cls.loaded[path] = cls(path)
        return cls.loaded[path]

    @staticmethod
    def odd(text: str) -> bool:
        """Whether words after a space can't stand for the text."""
        try:
            other = text.encode("latin-1").translate(None, PLAIN)
        except UnicodeEncodeError:
            return True
        return bool(other) or SPECIAL in text or any(x in text for x in GAPS)

    def ids(self, text: str) -> bytes:
        if self.odd(text):
            return np.asarray(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        first, *rest = text.split(" ")
        return np.asarray(self.encode(first), "<u4").tobytes() + b"".join(map(self.words.__getitem__, rest))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def token_pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """The pieces of every document: doc_id, piece, start, length, ids_crc32 and, if asked, ids."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = WordTokenizer.load(tokenizer or default_tokenizer()).ids
        end = np.asarray([end_id], "<u4").tobytes()
        for batch in batches:
            rows, piece, start, length, crc, ids = [], [], [], [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                data = ids_of(text or "") + end
                n = len(data) // 4
                at, size = 0, (n - 1) % capacity + 1
                while at < n:
                    part = data[4 * at : 4 * (at + size)]
                    rows.append(row)
                    piece.append(0 if at == 0 else piece[-1] + 1)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(np.frombuffer(part, "<u4").astype(np.int64).tolist())
                    at, size = at + size, capacity
            out = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                out, names = [*out, pa.array(ids, pa.list_(pa.int64()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(out, names=names)

    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def _price(lengths: np.ndarray, value: np.ndarray, capacity: int) -> np.ndarray:
    """Uses of each length in the most valuable pattern (knapsack dynamic program over the room)."""
    best = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1)
    upto = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for room in range(int(lengths[0]), capacity + 1):
        k = upto[room]
        got = best[room - lengths[:k]] + value[:k]
        j = got.argmax()
        if got[j] > best[room - 1]:
            best[room], choice[room] = got[j], j
        else:
            best[room] = best[room - 1]
    uses, room = np.zeros(len(lengths), np.int64), capacity
    while room > 0:
        if choice[room] < 0:
            room -= 1
        else:
            uses[choice[room]] += 1
            room -= lengths[choice[room]]
    return uses


def solve_patterns(lengths: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = ROUNDS, share: float = SHARE) -> list[tuple[np.ndarray, float]]:
    """Patterns and how many sequences take them: a fractional cover of the demand by multiplicative weights."""
    weight, cover = np.ones(len(lengths)), np.zeros(len(lengths))
    used: dict[bytes, float] = {}
    for _ in range(rounds):
        live = cover < 1
        if not live.any():
            break
        uses = _price(lengths, np.where(live, weight * lengths / demand, 0), capacity) * live
        uses = np.minimum(uses, np.maximum(demand, 1)).astype(np.int64)
        if not uses.any():
            break
        inside = uses > 0
        step = max(1.0, share * (demand[inside] / uses[inside]).min())
        used[uses.tobytes()] = used.get(uses.tobytes(), 0.0) + step
        cover += step * uses / demand
        weight *= np.exp(-step * uses / demand)
        weight /= weight.max()
    return [(np.frombuffer(k, np.int64), v) for k, v in used.items()]


def _rounded(histogram: dict[int, int], patterns: list[tuple[np.ndarray, float]], lengths: np.ndarray, capacity: int, slack: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Slots and number of sequences: patterns that leave at most ``slack`` room are used as often as whole numbers allow, the rest is placed by best fit."""
    slots: list[tuple[int, int, int, int, int]] = []
    taken = dict.fromkeys(histogram, 0)
    sequences = 0
    left = {k: v for k, v in histogram.items() if v > 0}

    def put(length: int, number: int, first: int, offset: int) -> None:
        slots.append((length, taken[length], taken[length] + number, first, offset))
        taken[length] += number
        left[length] -= number

    if full := left.get(capacity, 0):
        put(capacity, full, 0, 0)
        sequences = full
    free: dict[int, list[tuple[int, int]]] = {}  # room -> groups (first sequence, how many)
    for uses, times in patterns:
        room = capacity - int((uses * lengths).sum())
        number = int(times) if room <= slack else 0
        for k in np.flatnonzero(uses):
            number = min(number, left[int(lengths[k])] // int(uses[k]))
        if number <= 0:
            continue
        offset = 0
        for k in np.flatnonzero(uses)[::-1]:
            for _ in range(uses[k]):
                put(int(lengths[k]), number, sequences, offset)
                offset += int(lengths[k])
        free.setdefault(room, []).append((sequences, number))
        sequences += number
    for length in sorted((k for k, v in left.items() if v > 0), reverse=True):
        while left[length] > 0:
            room = min((r for r, groups in free.items() if r >= length and groups), default=None)
            if room is None:
                number = -(-left[length] // (capacity // length))
                groups, room = [(sequences, number)], capacity
                sequences += number
            else:
                groups = free[room]
            first, number = groups.pop()
            used = min(number, left[length])
            if used < number:
                free.setdefault(room, []).append((first + used, number - used))
            put(length, used, first, capacity - room)
            free.setdefault(room - length, []).append((first, used))
    return slots, sequences


def plan_slots(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> list[tuple[int, int, int, int, int]]:
    """Slots (length, first rank, end rank, first sequence, offset) that hold every piece once.

    Ranks of one length are interchangeable; rank r of a slot lies in sequence
    ``first sequence + r - first rank`` at the offset.  The number of slots
    depends on the lengths and rounds, not on the number of pieces.  Rounding
    is tried with several bounds on the room that a pattern may leave; the
    fewest sequences win.
    """
    lengths = np.array(sorted(k for k, v in histogram.items() if v > 0 and k < capacity), np.int64)
    patterns: list[tuple[np.ndarray, float]] = []
    if len(lengths):
        demand = np.array([histogram[int(k)] for k in lengths], float)
        patterns = sorted(solve_patterns(lengths, demand, capacity, rounds), key=lambda p: -p[1])
    tried = (_rounded(histogram, patterns, lengths, capacity, slack) for slack in (0, *SLACKS, capacity))
    return min(tried, key=lambda t: t[1])[0]


def pack(pieces: DataFrame, capacity: int = CAPACITY, rounds: int = ROUNDS) -> DataFrame:
    """``pieces`` (any columns with ``length``) with ``sequence_id`` and ``offset``.

    Ranks are dealt by a hash of the row, so that a common length is spread
    over many tasks; only counts per length and part are summed across them.
    The driver gets the histogram of at most ``capacity`` lengths.
    """
    spark = pieces.sparkSession
    names = pieces.columns
    parts = max(PARTS, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = pieces.withColumn("_part", F.pmod(F.xxhash64(*names), F.lit(parts)).cast("int"))
    counts = dealt.groupBy("_part", "length").agg(F.count("*").alias("_n"))
    histogram = {int(r["length"]): int(r["n"]) for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    plan = plan_slots(histogram, capacity, rounds)
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_part", "length", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    order = Window.partitionBy("_part", "length").orderBy(*names)
    ranked = dealt.withColumn("_in", F.row_number().over(order) - 1).join(counts, ["_part", "length"]).withColumn("_rank", F.col("_in") + F.col("_before"))
    slots = spark.createDataFrame(plan, "length bigint, _from bigint, _to bigint, _seq bigint, offset bigint")
    hit = (ranked["length"] == slots["length"]) & (ranked["_rank"] >= slots["_from"]) & (ranked["_rank"] < slots["_to"])
    found = ranked.join(F.broadcast(slots), hit)
    return found.select(*(ranked[n] for n in names), (F.col("_seq") + F.col("_rank") - F.col("_from")).alias("sequence_id"), F.col("offset"))


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, rounds: int = ROUNDS) -> DataFrame:
    """Tokenize, cut and pack all documents; one row per piece."""
    with small_batches(docs.sparkSession):
        pieces = Scratch(docs.sparkSession).table(token_pieces(docs, tokenizer, capacity), "pieces")
    return pack(pieces, capacity, rounds)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
