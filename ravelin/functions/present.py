"""Expressions that prepare answers, quotes and lists for display."""

from __future__ import annotations

import textwrap

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def excerpt(text: Column, most: int) -> Column:
    """One line of at most ``most`` characters, with an ellipsis if more was there."""
    line = one_line(text)
    return F.when(F.char_length(line) <= most, line).otherwise(F.concat(F.rtrim(F.substring(line, 1, most)), F.lit("…")))


def last_summary(text: Column, most: int = 110) -> Column:
    """The first sentence of a text, cut like an excerpt; null for blank text."""
    line = one_line(text)
    first = F.trim(F.regexp_extract(line, r"^(.*?[.!?](?:\s|$))", 1))
    picked = F.when(first == "", line).otherwise(first)
    return F.when(line != "", excerpt(picked, most))


# What counts as a hash, and where sentences part.
HEX_RUN = r"(?i)(?:\b[0-9a-f]{16,}\b:?)+"
SENTENCE_GAP = r"(?<=[.!?])\s+"


def without_hex(text: Column) -> Column:
    """Without runs of 16 hexadecimal digits or more."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, HEX_RUN, " "), r"\s{2,}", " "))


# Pairs of pattern and replacement, in the order in which they apply.
POLISH = (
    (r"\(\s*\)", ""),
    (r":\s*-\s+", ": "),
    (r"([.!?])\s*-\s+", "$1 "),
    (r"\s+-\s+", " "),
    (r"\s{2,}", " "),
    (r"\s+([,.;:])", "$1"),
    (r"([,.;:])(\S)", "$1 $2"),
)
# What marks a sentence that is dropped, and tags that are cut out.
DROPPED = ("this information can be found at", "doc_id", "chunk_id")
TAGS = (r"(?i)\[doc_id:[^\]]*\]", r"(?i)\[chunk_id:[^\]]*\]", r"\[[^:\]]+:[^\]]*\]")


def polished(text: Column) -> Column:
    for pattern, put in POLISH:
        text = F.regexp_replace(text, pattern, put)
    return F.trim(text)


def untagged(text: Column) -> Column:
    for pattern in TAGS:
        text = F.regexp_replace(text, pattern, "")
    return polished(without_hex(F.trim(text)))


def sanitised(text: Column) -> Column:
    """An answer without sentences about ids, tags and long hexadecimal runs; the text itself if nothing is left."""
    sentences = F.split(text, SENTENCE_GAP)
    kept = F.filter(sentences, lambda s: (F.trim(s) != "") & ~F.lower(s).rlike("|".join(DROPPED)))
    first, second = untagged(F.array_join(kept, " ")), untagged(text)
    return F.when(first != "", first).when(second != "", second).otherwise(text)


def shortened(texts: Column) -> Column:
    """At most 500 characters of whole words, with an ellipsis if words were left out."""

    @F.pandas_udf("string")
    def cut(values: pd.Series) -> pd.Series:
        return values.map(lambda t: None if t is None else textwrap.shorten(t, width=500, placeholder="…"))

    return cut(texts)
