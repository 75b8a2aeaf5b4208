"""URL and page expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def scheme(url: Column) -> Column:
    return F.lower(F.nullif(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1), F.lit("")))


def authority(url: Column) -> Column:
    """Host with user and port as written; null where there is none."""
    return F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1), F.lit(""))


def valid_url(url: Column) -> Column:
    """http or https with a host."""
    return F.coalesce(scheme(url).isin("http", "https") & authority(url).isNotNull(), F.lit(False))


def normalised(url: Column) -> Column:
    """Without query, fragment and slashes at the end."""
    bare = F.regexp_replace(url, r"[?#][\s\S]*$", "")
    short = F.regexp_replace(bare, r"/+$", "")
    return F.when(short == "", bare).otherwise(short)


def same_origin(a: Column, b: Column) -> Column:
    return F.coalesce((scheme(a) == scheme(b)) & (authority(a) == authority(b)), F.lit(False))


def models_url(api_url: Column) -> Column:
    """Where a hosted API lists its models, from the address of its base or of its chat endpoint; empty for none."""
    bare = F.regexp_replace(F.coalesce(api_url, F.lit("")), r"/+$", "")
    short = F.regexp_replace(bare, r"/chat/completions$", "")
    base = F.regexp_replace(F.regexp_replace(short, r"/openai/v1[\s\S]*$", ""), r"/+$", "")
    return F.when(F.coalesce(api_url, F.lit("")) == "", "").when(short.endswith("/openai/v1"), F.concat(short, F.lit("/models"))).otherwise(F.concat(base, F.lit("/openai/v1/models")))
