"""Text expressions: tokens, sizes and candidates for entities."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_TEXTS = "array<string>"
# Patterns whose matches the results depend on.
PHRASE = r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*"
WORD_RUN = r"[\p{L}\p{N}_]+"
LONG_WORD = r"^[A-Za-z]{4,}$"


def stripped(text: Column) -> Column:
    """Without white space (Unicode) at both ends; null stays null."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def tokens(text: Column) -> Column:
    """Runs of characters other than white space; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), "")


def approx_tokens(text: Column) -> Column:
    """0 for blank text, else the largest of the token count, 1 and a quarter of the characters."""
    bare = stripped(F.coalesce(text, F.lit("")))
    quarter = F.floor(F.char_length(bare) / 4).cast("int")
    return F.when(bare == "", 0).otherwise(F.greatest(F.size(tokens(bare)), F.lit(1), quarter)).cast("int")


def window_count(n: Column, size: int, overlap: int) -> Column:
    """Number of windows of ``size`` tokens that overlap by ``overlap`` over n tokens."""
    return F.when(n <= 0, 0).when(n <= size, 1).otherwise(F.ceil((n - size) / F.lit(size - overlap)) + 1).cast("int")


def windows(words: Column, size: int, overlap: int) -> Column:
    """Texts of all windows of an array of tokens, in order."""
    n = window_count(F.size(words), size, overlap)
    step = size - overlap
    made = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.array_join(F.slice(words, k * step + 1, size), " "))
    return F.when(n > 0, made).otherwise(F.array().cast(NO_TEXTS))


def phrases(text: Column) -> Column:
    """Runs of capitalised words."""
    return F.regexp_extract_all(text, F.lit(f"({PHRASE})"), F.lit(1))


def suffixes(phrase: Column) -> Column:
    """The phrase without its first word, its first two, and so on, single-spaced."""
    parts = F.split(phrase, r"\s+")
    ends = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), " "))
    return F.when(F.size(parts) > 1, ends).otherwise(F.array().cast(NO_TEXTS))


def long_words(text: Column) -> Column:
    """Whole words of four ASCII letters at least."""
    return F.filter(F.regexp_extract_all(text, F.lit(f"({WORD_RUN})"), F.lit(1)), lambda w: w.rlike(LONG_WORD))


def candidates(text: Column) -> Column:
    """Distinct entity candidates of a text, lower-cased, in order."""
    found = phrases(text)
    every = F.concat(found, F.flatten(F.transform(found, suffixes)), long_words(text))
    bare = F.transform(every, lambda c: F.lower(stripped(c)))
    return F.array_sort(F.array_distinct(F.filter(bare, lambda c: c != "")))


# The same for one text in Python: what the expressions find, for steps that read whole texts row by row.
_PHRASE = re.compile(r"[A-Z][a-z]+(?:[ \t-\r]+[A-Z][a-z]+)*")
_LONG_WORD = re.compile(r"(?<!\w)[A-Za-z]{4,}+(?!\w)")
#: Characters that Python splits at and Unicode doesn't call white space, and what Unicode does.
_SEPARATORS = re.compile("[\x1c-\x1f]")
_WHITE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def token_list(text: str | None) -> list[str]:
    """``tokens`` of one text."""
    if _SEPARATORS.search(text := text or ""):
        return [word for word in _WHITE.split(text) if word]
    return text.split()


def window_texts(words: list[str], size: int, overlap: int) -> list[str]:
    """``windows`` of one list of tokens."""
    step = size - overlap
    return [" ".join(words[at : at + size]) for at in range(0, max(len(words) - overlap, min(len(words), 1)), step)]


def candidate_list(text: str) -> list[str]:
    """``candidates`` of one text, in the order in which they are found."""
    out: dict[str, None] = {}
    for phrase in _PHRASE.findall(text):
        lowered = phrase.lower()
        out[lowered] = None
        parts = lowered.split()
        for k in range(1, len(parts)):
            out[" ".join(parts[k:])] = None
    out.update(dict.fromkeys(map(str.lower, _LONG_WORD.findall(text))))
    return list(out)


def page_count(text: Column) -> Column:
    """Form feeds and one; 0 for null or empty text."""
    feeds = F.char_length(text) - F.char_length(F.replace(text, F.lit("\f"), F.lit("")))
    return F.when(F.coalesce(text, F.lit("")) == "", 0).otherwise(feeds + 1).cast("int")


def edge_label(label: Column, default: str = "ABOUT") -> Column:
    """An upper-case identifier, else the default."""
    upper = F.upper(F.coalesce(F.nullif(label, F.lit("")), F.lit(default)))
    return F.when(upper.rlike(r"\A[A-Z_][A-Z0-9_]*\n?\z"), upper).otherwise(F.lit(default))
