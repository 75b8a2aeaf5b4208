"""Vector expressions and the deterministic hash embedder."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def squared_distance(a: Column, b: Column) -> Column:
    """Squared Euclidean distance of two arrays, summed in order as doubles."""
    parts = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    """Euclidean norm; 1 for the zero vector."""
    size = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(size == 0, 1.0).otherwise(size)


def unit(v: Column, length: Column) -> Column:
    """The vector over its norm, which is a column of its own so that it is worked out once."""
    return F.transform(v, lambda x: x / length)


def hash_vector(text: str, dim: int) -> list[float]:
    """Unit vector of uniform numbers from a generator that the text's SHA-256 seeds."""
    made = random.Random(hashlib.sha256(text.encode("utf-8")).digest())
    raw = np.array([made.uniform(-1.0, 1.0) for _ in range(dim)])
    return (raw / (np.sqrt((raw * raw).sum()) or 1.0)).tolist()


def hash_embedder(dim: int = 384):
    """A pandas UDF from texts to vectors; null has no vector."""

    @F.pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        made = {t: hash_vector(t, dim) for t in texts.dropna().unique()}
        return texts.map(made.get)

    return embed


#: Embedding providers by name: a function of the dimension that gives a column function.
EMBEDDERS = {"stub": hash_embedder}


def embedder(name: str, dim: int = 384):
    """The named provider; ``auto`` is the built-in one. Others are added to EMBEDDERS."""
    key = "stub" if name == "auto" else name
    if key not in EMBEDDERS:
        raise ValueError(f"no embedding provider named {name!r}")
    return EMBEDDERS[key](dim)


def safe_embedder(name: str, dim: int = 384):
    """The named provider, or the built-in one where it can't be made; and the name of the one taken."""
    try:
        return embedder(name, dim), name
    except Exception:  # a provider may fail in any way
        return embedder("stub", dim), "stub"


def embedded(text: Column, name: str, dim: int = 384) -> Column:
    """Struct of provider and v (null for null): batches on which the named provider fails, or gives other sizes, take the built-in one.

    A store of one provider and dimension keeps the rows that fit it
    (``store.dimension_errors``), so that vectors of two kinds never meet.
    """
    made, taken = safe_embedder(name, dim)
    named, plain, taken = made.func, hash_embedder(dim).func, "stub" if taken == "auto" else taken

    @F.pandas_udf("struct<provider: string, v: array<double>>")
    def embed(texts: pd.Series) -> pd.DataFrame:
        try:
            found, by = list(named(texts)), taken
            if len(found) != len(texts) or any(v is not None and len(v) != dim for v in found):
                raise ValueError("sizes differ")
        except Exception:  # a provider may fail in any way
            found, by = list(plain(texts)), "stub"
        return pd.DataFrame({"provider": [by] * len(texts), "v": found})

    return embed(text)
