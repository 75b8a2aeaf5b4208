"""Language-model scores by a log-bilinear neural model with noise-contrastive estimation.

Counts of all training tokens are gathered by Spark.  The model's words are the
most frequent ones, ``WORDS`` and as many more as the square root of the number
of training tokens, ``MOST`` at the most; all other tokens are one word.  Words
fall into classes by their neighbours (k-means on the shares of the most
frequent words before and after each).  For each of the two places before a
token, Spark gathers over the whole training part how often each class follows
each word, and how often each word follows each class.  On these counts the
driver trains log-bilinear models in numpy: the vector predicted from the
context meets that of what follows, and the parameters maximise the
noise-contrastive objective, its expectation over the noise taken exactly.
The probability of a token is that of its class after the word before, times
its own in the class after the word's class; the two places' probabilities are
mixed by the weight, of ``MIXES``, that suits the training part best.  Workers
turn the parameters into normalised log-probabilities by matrix products.  A
token outside the model's words gets their probability times its own smoothed
share among them, so that every position is normalised over all tokens, unseen
ones included.

Counts of the ``HEAD`` most frequent tokens reach the workers as a broadcast of
bounded size; for all others each text's tokens are joined with the counts.

Edge cases: a null text counts as empty and has the end token alone; a null
doc_id is not held out and not learned from; without training rows every count
is 0; repeated rows count and are scored one by one; very long texts and tokens
count whole (a long token by its hash); of tokens of one count the least become
words first; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.llm.toxicity import remainder
from ravelin.scratch import Scratch
from ravelin.sources.tables import table

FOLDS = 10
SMOOTH = 0.1
#: Words of the model for an empty corpus (others counted as one) and at the most, classes of words, and words that tell the classes.
WORDS, MOST, CLASSES, BINS = 1024, 32_768, 64, 64
#: Dimensions, noise samples for each token, steps of training, and weights of the nearer place to choose from.
DIMENSIONS, NOISE, STEPS, MIXES = 32, 20, 150, (0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)
#: Tokens before each one that the model looks at, and tokens that a worker handles at a time.
PLACES, AT_ONCE = 2, 200_000
#: Tokens whose counts are broadcast (the model's words at least), and bytes from which a token is held by its hash.
HEAD, LONGEST = 200_000, 64
#: Distinct tokens that a task counts before it passes the counts on.
HELD = 300_000
#: Never a token of a text: stands for its end.
END = b""


def tokens_of(text: str | None) -> list[bytes]:
    """Tokens of a text with A-Z in lower case, without the end; of a token of more than ``LONGEST`` bytes a space and its SHA-256, which no other token is."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if tokens and max(map(len, tokens)) > LONGEST:
        return [t if len(t) <= LONGEST else b" " + hashlib.sha256(t).digest() for t in tokens]
    return tokens


def token_counts(texts: DataFrame) -> DataFrame:
    """token (binary) and c over the column ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["token", "c"])
            held.clear()
            return made

        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.update(tokens_of(text))
                held[END] += 1
                if len(held) > HELD:
                    yield out()
        yield out()

    return texts.select("text").mapInArrow(run, "token binary, c bigint").groupBy("token").agg(F.sum("c").alias("c"))


def frequent_tokens(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """The ``most`` tokens with the largest counts, of equal counts the least tokens, with their counts.

    The last count comes from a histogram of the counts' logarithms and then of
    the counts on one of its levels, so that no task sorts more than its share.
    """
    ranked = counts.withColumn("level", F.floor(F.log2("c") * 8))

    def last(rows: DataFrame, by: str, left: int) -> tuple[int | None, int]:
        """The value of ``by`` at which ``left`` rows are reached from above, if they are, and how many are left then."""
        for r in sorted(rows.groupBy(by).agg(F.count("*").alias("n")).collect(), key=lambda r: -r[by]):
            if r["n"] >= left:
                return r[by], left
            left -= r["n"]
        return None, left

    level, left = last(ranked, "level", most)
    if level is None:
        found = ranked
    else:
        on = ranked.where(F.col("level") == level)
        c, left = last(on, "c", left)  # as many counts as an eighth of a power of two holds
        found = ranked.where(F.col("c") > c).unionByName(on.where(F.col("c") == c).orderBy("token").limit(left))
    held = found.select("token", "c").toArrow()  # at most ``most`` rows
    return sorted(zip(held.column("token").to_pylist(), held.column("c").to_pylist(), strict=True), key=lambda t: (-t[1], t[0]))


def numbered(texts: list[str | None], number: Callable[[bytes], int], end: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[list[bytes]]]]:
    """For groups of whole texts: numbers of the tokens with ``PLACES`` ends before each text, where the tokens are, how many each text has, and the tokens."""
    made, lists, size = [], [], 0
    for k, text in enumerate(texts):
        tokens = tokens_of(text)
        made.append(np.array([*[end] * PLACES, *map(number, tokens), end]))
        lists.append(tokens)
        size += len(tokens)
        if size >= AT_ONCE or k == len(texts) - 1:
            sizes = np.array([len(m) - PLACES for m in made])
            at = np.arange(sizes.sum()) + PLACES * np.repeat(np.arange(1, len(sizes) + 1), sizes)
            yield np.concatenate(made), at, sizes, lists
            made, lists, size = [], [], 0


def cell_counts(texts: DataFrame, words: list[bytes], cells: int, find: Callable[[np.ndarray, np.ndarray], Iterator[np.ndarray]]) -> np.ndarray:
    """How often ``find`` names each of so many cells for the numbers and places of all tokens; 0 numbers the tokens that aren't in ``words``."""
    shared = texts.sparkSession.sparkContext.broadcast({w: i + 1 for i, w in enumerate(words)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, total = shared.value, np.zeros(cells, np.int64)
        for batch in batches:
            for now, at, _, _ in numbered(batch.column(0).to_pylist(), lambda t: ids.get(t, 0), ids.get(END, 0)):
                for found in find(now, at):
                    total += np.bincount(found, minlength=cells)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found], pa.int64())], names=["cell", "n"])

    counted = texts.select("text").mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # at most ``cells`` rows
    out = np.zeros(cells, np.float32)
    out[counted.column("cell").to_numpy()] = counted.column("n").to_numpy()
    return out


def neighbour_profiles(texts: DataFrame, words: list[bytes], bins: int = BINS) -> np.ndarray:
    """For each word, how often each of the most frequent ones is before and after it (the last bin: any less frequent one)."""
    size = len(words) + 1

    def find(now: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
        yield now[at] * 2 * bins + np.minimum(now[at - 1], bins - 1)
        yield now[at - 1] * 2 * bins + bins + np.minimum(now[at], bins - 1)

    return cell_counts(texts, words, size * 2 * bins, find).reshape(size, 2 * bins)


def word_classes(profiles: np.ndarray, classes: int = CLASSES, steps: int = 15) -> np.ndarray:
    """Class of each word by k-means on the roots of its shares, from the most frequent words on; 0 is that of the others alone."""
    shares = np.sqrt(profiles[1:] / np.maximum(profiles[1:].sum(1, keepdims=True), 1))
    centres = shares[: classes - 1].copy()
    near = np.zeros(len(shares), np.int64)
    for _ in range(steps if len(centres) else 0):
        near = (shares @ centres.T - (centres**2).sum(1) / 2).argmax(1)
        filled = np.bincount(near, minlength=len(centres))
        for k in np.flatnonzero(filled):
            centres[k] = shares[near == k].mean(0)
    return np.r_[0, near + 1]


def context_counts(texts: DataFrame, words: list[bytes], of: np.ndarray, classes: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each place before a token: counts of word then class, and of class then word."""
    size = len(words) + 1
    cells = size * classes

    def find(now: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
        for k in range(PLACES):
            before, word = now[at - 1 - k], now[at]
            yield 2 * k * cells + before * classes + of[word]
            yield (2 * k + 1) * cells + of[before] * size + word

    made = cell_counts(texts, words, 2 * PLACES * cells, find).reshape(PLACES, 2, cells)
    return [(a.reshape(size, classes), b.reshape(classes, size)) for a, b in made]


def train(pairs: np.ndarray, group: np.ndarray | None = None, dimensions: int = DIMENSIONS, noise: int = NOISE, steps: int = STEPS, rate: float = 0.05, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context vectors, vectors and biases of what follows, of the log-bilinear model for a matrix of counts.

    Maximises, over contexts h and followers w, the sum of
    ``n(h, w) log s(f) + k n(h) q(w) log(1 - s(f))`` with
    ``f = score(h, w) - log(k q(w))``, k noise samples from the distribution q
    of followers, and s the logistic function (adaptive steps with momentum).
    With ``group`` (of each follower), n(h) and q are those in w's group.
    """
    group = np.zeros(pairs.shape[1], np.int64) if group is None else group
    pairs = pairs.astype(np.float32)
    total = float(pairs.sum(dtype=float))
    member = (group[:, None] == np.arange(group.max() + 1)).astype(np.float32)
    each = pairs.sum(0, dtype=float) + 0.5
    unigram = (each / (each @ member)[group]).astype(np.float32)
    rng = np.random.default_rng(seed)
    params = [rng.normal(0, 0.05, (n, dimensions)).astype(np.float32) for n in pairs.shape] + [np.log(unigram)]
    if not total:
        return tuple(params)
    data, chance = pairs / np.float32(total), noise * ((pairs @ member) / np.float32(total))[:, group] * unigram
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        context, token, bias = params
        f = context @ token.T + (bias - np.log(noise * unigram))
        s = 1 / (1 + np.exp(-np.clip(f, -30, 30)))
        slope = data * (1 - s) - chance * s
        slopes = [slope @ token, slope.T @ context, slope.sum(0)]
        for k, g in enumerate(slopes):
            g = g - np.float32(1e-7) * params[k] * (k < 2)
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            params[k] = params[k] + rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + np.float32(1e-10))
    return tuple(params)


def log_probabilities(context: np.ndarray, token: np.ndarray, bias: np.ndarray, group: np.ndarray | None = None) -> np.ndarray:
    """log10 of the normalised probability of each follower after each context, in its group where there are groups."""
    group = np.zeros(len(token), np.int64) if group is None else group
    score = context @ token.T + bias
    for k in np.unique(group):
        own = score[:, group == k]
        own -= own.max(1, keepdims=True)
        score[:, group == k] = own - np.log(np.exp(own).sum(1, keepdims=True))
    return score / np.float32(np.log(10))


def score_texts(docs: DataFrame, folds: int = FOLDS, words: int = WORDS, most: int = MOST, classes: int = CLASSES, head: int = HEAD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every whole text."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    learned = docs.where(remainder("doc_id", folds) != 0).select("text")
    counts = scratch.table(token_counts(learned), "counts")
    n, v = (int(x or 0) for x in counts.agg(F.sum("c"), F.count("*")).first())
    size = min(most, words + isqrt(n)) - 1
    frequent = frequent_tokens(counts, max(head, size))
    known = [t for t, _ in frequent[:size]]
    size = len(known) + 1
    of = word_classes(neighbour_profiles(learned, known), classes)
    model = [(train(a), train(b, of)) for a, b in context_counts(learned, known, of, int(of.max()) + 1)]
    rest, kinds = n - sum(c for _, c in frequent[: size - 1]), v - len(known)
    shared = spark.sparkContext.broadcast((frequent, of, model))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.coalesce(remainder("doc_id", folds) == 0, F.lit(False)).alias("held_out"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, of, model = shared.value
        place = {t: i for i, (t, _) in enumerate(frequent)}
        logs = np.array([*(np.log10(c + SMOOTH) for _, c in frequent), 0.0])  # the last: not here
        ids = np.zeros(len(logs), np.int64)
        ids[: size - 1] = np.arange(1, size)
        own = np.where(ids == 0, logs, 0.0)  # for those outside the model's words
        tables = [(log_probabilities(*a), log_probabilities(*b, of)) for a, b in model]
        out_of, end = len(frequent), place.get(END, len(frequent))
        for batch in batches:
            made = [[] for _ in range(6)]
            for found, at, sizes, lists in numbered(batch.column(3).to_pylist(), lambda t: place.get(t, out_of), end):
                now, found = ids[found], found[at]
                word = now[at]
                parts = []
                for k, (a, b) in enumerate(tables):
                    before = now[at - 1 - k]
                    parts.append(10 ** (a[before, of[word]].astype(float) + b[of[before], word]))
                starts = np.cumsum(sizes) - sizes
                odd = found == out_of
                mixed = np.stack([np.add.reduceat(np.log10(m * parts[0] + (1 - m) * parts[1]) + own[found], starts) for m in MIXES], 1)
                made[0].append(sizes)
                made[1].append(sizes - np.add.reduceat(odd.astype(np.int64), starts))
                made[2].append(np.add.reduceat(logs[found], starts))
                made[3].append(mixed.ravel())
                made[4].append(np.add.reduceat((word == 0).astype(np.int64), starts))
                for tokens, start in zip(lists, starts, strict=True):
                    made[5].append([tokens[i] if i < len(tokens) else END for i in np.flatnonzero(odd[start : start + len(tokens) + 1])])
            flat = [np.concatenate(m) if m else np.empty(0, t) for m, t in zip(made[:5], (np.int64, np.int64, float, float, np.int64), strict=True)]
            mixes = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1) * len(MIXES), pa.int32()), pa.array(flat[3]))
            out = [*batch.columns[:3], *(pa.array(f) for f in flat[:3]), mixes, pa.array(flat[4]), pa.array(made[5], pa.list_(pa.binary()))]
            yield pa.RecordBatch.from_arrays(out, names=["rid", "doc_id", "held_out", "n_tokens", "near", "base", "mixes", "others", "odd"])

    schema = f"rid bigint, doc_id {kind}, held_out boolean, n_tokens bigint, near bigint, base double, mixes array<double>, others bigint, odd array<binary>"
    scored = scratch.table(rows.mapInArrow(run, schema), "scored")
    # the mixing weight that suits the training part best
    sums = scored.where(~F.col("held_out") & F.col("doc_id").isNotNull()).agg(*(F.sum(F.col("mixes")[k]).alias(f"m{k}") for k in range(len(MIXES)))).first()
    best = max(range(len(MIXES)), key=lambda k: (sums[k] if sums[k] is not None else 0.0, -k))
    odd = scored.select("rid", F.explode("odd").alias("token")).join(counts, "token", "left")
    odd = odd.groupBy("rid").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + SMOOTH)).alias("odd_log"), F.count("c").alias("odd_known"))
    both = scored.select("rid", "doc_id", "held_out", "n_tokens", "near", "base", F.col("mixes")[best].alias("model"), "others").join(odd, "rid", "left")
    more = F.coalesce("odd_log", F.lit(0.0))
    whole, part = (float(np.log10(a + SMOOTH * (b + 1))) for a, b in ((n, v), (rest, kinds)))
    return both.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("near") + F.coalesce("odd_known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("bigint").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * whole).alias("base_score"),
        (F.col("model") + more - F.col("others") * part).alias("score"),
    )


def op9_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))
