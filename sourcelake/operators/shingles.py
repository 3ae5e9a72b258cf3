"""Set-valued fingerprints of flat text, and Jaccard similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that shape code; other identifiers only count as "an identifier".
KEYWORDS = (
    "and as async await break case catch class const continue def default del do elif else enum except export extends "
    "finally for from function if implements import in interface is lambda let new not or pass raise return switch "
    "this throw try type var while with yield"
).split()

_TOKEN = (
    r'"""(?:[^"\\]++|\\[\s\S]|"(?!""))*+"""'
    r"|'''(?:[^'\\]++|\\[\s\S]|'(?!''))*+'''"
    r'|"(?:[^"\\\n]++|\\.)*+"'
    r"|'(?:[^'\\\n]++|\\.)*+'"
    r"|\d[\w.]*+|[\w$]++|[^\s\w$]"
)


def shape_tokens(text: Column) -> Column:
    """Token classes in order: keywords and punctuation as they are, names as
    ``I``, numbers and strings as ``L``."""
    return F.transform(
        F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0)),
        lambda t: F.when(t.isin(*KEYWORDS), t)
        .when(t.rlike(r"^[A-Za-z_$]"), F.lit("I"))
        .when(t.rlike(r"""^(?:\d|["'][\s\S])"""), F.lit("L"))
        .otherwise(t),
    )


def shingles(tokens: Column, k: int) -> Column:
    """Distinct runs of ``k`` tokens; a shorter text is one run."""
    n = F.size(tokens)
    runs = F.transform(
        F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))),
        lambda i: F.array_join(F.slice(tokens, i, F.lit(k)), " "),
    )
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(runs))


def line_set(text: Column) -> Column:
    """Distinct trimmed non-empty lines."""
    lines = F.transform(F.split(text, "\n"), lambda s: F.btrim(s, F.lit(" \t\r")))
    return F.array_distinct(F.filter(lines, lambda s: s != ""))


def hashes(items: Column) -> Column:
    return F.array_distinct(F.transform(items, lambda s: F.xxhash64(s)))


SHAPE_RUN = 5  # tokens in a run


def shape_shingles(files: DataFrame, k: int = SHAPE_RUN) -> DataFrame:
    """``(repo, path, hashes)``: the structural fingerprint of each file."""
    shaped = files.select("repo", "path", shape_tokens(F.col("content")).alias("_t"))
    return shaped.select("repo", "path", hashes(shingles(F.col("_t"), k)).alias("hashes"))


def line_fingerprints(files: DataFrame) -> DataFrame:
    """``(repo, path, hashes)`` over line sets."""
    return files.select("repo", "path", hashes(line_set(F.col("content"))).alias("hashes"))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over combined elements of two duplicate-free arrays.

    Two empty sets are identical, an empty and a filled one are disjoint."""
    shared = F.size(F.array_intersect(a, b))
    return (
        F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0))
        .when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0))
        .otherwise(shared / (F.size(a) + F.size(b) - shared))
    )
