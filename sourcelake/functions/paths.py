"""Expressions over ``/``-separated relative paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]*$", 0)


def dirname(path: Column) -> Column:
    """Text before the last slash, '' at the root."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def extension(path: Column) -> Column:
    """Last suffix of the final segment with its dot; leading dots start no suffix."""
    return F.regexp_extract(path, r"(?:^|/)\.*[^./][^/]*?(\.[^./]*)$", 1)


def stem(path: Column) -> Column:
    """Final segment without its last suffix."""
    name = basename(path)
    return name.substr(F.lit(1), F.length(name) - F.length(extension(path)))


def ancestors(path: Column) -> Column:
    """``a/b/c.py`` -> ``[a, a/b]``: every directory above the file."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(
        F.sequence(F.lit(1), F.size(parts) - 1),
        lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"),
    )).otherwise(F.array().cast("array<string>"))


def normalize(path: Column) -> Column:
    """Fold ``.``, ``..`` and empty segments; an empty result is ``.``."""
    segments = F.filter(F.split(path, "/"), lambda s: ~s.isin("", "."))
    folded = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(
            (s == "..") & (F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("..")) != ".."),
            F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))),
        ).otherwise(F.concat(acc, F.array(s))),
    )
    # Segments are never empty, so only an empty fold joins to ''.
    return F.coalesce(F.nullif(F.array_join(folded, "/"), F.lit("")), F.lit("."))
