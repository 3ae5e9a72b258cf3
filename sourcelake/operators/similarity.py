"""Exact Jaccard similarity join over fingerprint sets.

Input is ``(repo, path, hashes)`` with duplicate-free ``hashes``.  Three
reductions keep the work near the size of the answer and none loses a pair:

* files with equal sets collapse to one *class*, named by its smallest path;
* prefix filter: with hashes ordered from rare to frequent, sets at similarity
  t share one of their first ``n - ceil(t*n) + 1`` (Bayardo et al. 2007);
* length and position filters on each shared hash (Xiao et al. 2008).

A bucket (one repository's classes sharing a prefix hash) that is still large
is cut into blocks, and pairs of blocks become separate join keys, so no task
compares a whole hot bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sourcelake.operators.shingles import jaccard
from sourcelake.session import materialize

_SLACK = 1e-9  # float guard of the filters; the final test is exact
BLOCK = 512  # classes per block of a cut bucket


def set_classes(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(keyed, classes)``.

    The sets are written down first: computing them reads every text, and the
    steps below use them several times.

    ``keyed``: ``(repo, path, set_key)``.  ``classes``: ``(repo, v, set_key,
    n, copies, hashes)``, one row per distinct set with ``v`` its smallest
    path.  Copies combine map-side, however many there are."""
    ordered = sets.select("repo", "path", F.array_sort("hashes").alias("hashes"))
    as_text = F.array_join(F.transform("hashes", lambda h: h.cast("string")), ",")
    hashed = materialize(ordered.withColumn("set_key", F.sha2(as_text, 256)), "sets")
    classes = hashed.groupBy("repo", "set_key").agg(
        F.min("path").alias("v"), F.count("*").alias("copies"), F.first("hashes").alias("hashes")
    )
    classes = classes.select("repo", "v", "set_key", F.size("hashes").alias("n"), "copies", "hashes")
    return hashed.select("repo", "path", "set_key"), materialize(classes, "classes")


def prefix_rows(classes: DataFrame, threshold: float) -> DataFrame:
    """``(repo, h, v, n, i)``: each class under the hashes of its prefix, ``i``
    the hash's position from 1.  Hashes of a single class pair with nothing and
    are left out after positions are fixed."""
    tokens = classes.select("repo", "v", "n", F.explode("hashes").alias("h"))
    frequency = tokens.groupBy("repo", "h").agg(F.count("*").alias("df"))
    ranked = tokens.join(frequency, ["repo", "h"])
    length = F.col("n") - F.ceil(F.col("n") * F.lit(threshold) - F.lit(_SLACK)) + 1
    order = Window.partitionBy("repo", "v").orderBy("df", "h")  # one file's hashes
    return (
        ranked.withColumn("i", F.row_number().over(order))
        .where((F.col("i") <= length) & (F.col("df") > 1))
        .select("repo", "h", "v", "n", "i")
    )


def may_match(n1: Column, i1: Column, n2: Column, i2: Column, threshold: float) -> Column:
    """Length and position filters for two sets sharing the hash at ``i1``/``i2``,
    their first shared one; for later shared hashes it may reject, the first
    keeps the pair."""
    need = F.lit(threshold / (1.0 + threshold)) * (n1 + n2) - F.lit(_SLACK)
    return (F.least(n1, n2) >= F.lit(threshold) * F.greatest(n1, n2) - F.lit(_SLACK)) & (
        F.least(n1 - i1, n2 - i2) + 1 >= need
    )


def candidate_pairs(smaller: DataFrame, larger: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """Distinct ``(repo, u, v)``, ``u < v``, with ``u`` from ``smaller`` and ``v``
    from ``larger`` (both prefix rows), that share a prefix hash and pass the
    filters: a superset of all pairs at the threshold.

    A bucket whose two sides multiply to more than ``block**2`` is cut: each
    side falls into blocks by hash, rows are repeated for every block of the
    other side, and the pair of blocks becomes part of the join key."""
    count = lambda rows, name: rows.groupBy("repo", "h").agg(F.count("*").alias(name))
    large = lambda rows, name: count(rows, name).where(F.col(name) > block)
    cuts = (
        large(smaller, "m1").join(large(larger, "m2"), ["repo", "h"], "full_outer")
        .select(
            "repo", "h",
            F.ceil(F.coalesce("m1", F.lit(1)) / block).cast("int").alias("cuts1"),
            F.ceil(F.coalesce("m2", F.lit(1)) / block).cast("int").alias("cuts2"),
        )
    )

    def side(rows: DataFrame, own: str, other: str, tag: str) -> DataFrame:
        cut = rows.join(cuts, ["repo", "h"], "left")
        own_cuts, other_cuts = F.coalesce(own, F.lit(1)), F.coalesce(other, F.lit(1))
        mine = F.pmod(F.xxhash64("v"), own_cuts).cast("int")
        theirs = F.explode(F.sequence(F.lit(0), other_cuts - 1))
        first, second = (mine, theirs) if tag == "1" else (theirs, mine)
        return cut.select(
            "repo", "h", *[F.col(c).alias(c + tag) for c in ("v", "n", "i")],
            first.alias("b1"), second.alias("b2"),
        )

    met = side(smaller, "cuts1", "cuts2", "1").join(side(larger, "cuts2", "cuts1", "2"), ["repo", "h", "b1", "b2"])
    return (
        met.where(F.col("v1") < F.col("v2"))
        .where(may_match(F.col("n1"), F.col("i1"), F.col("n2"), F.col("i2"), threshold))
        .select("repo", F.col("v1").alias("u"), F.col("v2").alias("v"))
        .distinct()
    )


def verify_pairs(candidates: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """``(repo, u, v, similarity)`` of the candidates that reach the threshold."""
    side = lambda name, alias: classes.select("repo", F.col("v").alias(name), F.col("hashes").alias(alias))
    return (
        candidates.join(side("u", "hu"), ["repo", "u"])
        .join(side("v", "hv"), ["repo", "v"])
        .select("repo", "u", "v", jaccard(F.col("hu"), F.col("hv")).alias("similarity"))
        .where(F.col("similarity") >= threshold)
    )


def class_pairs(classes: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """All pairs of distinct sets at the threshold."""
    if threshold <= 0:
        raise ValueError("a similarity join needs a positive threshold")
    rows = materialize(prefix_rows(classes, threshold), "prefixes")
    return verify_pairs(candidate_pairs(rows, rows, threshold, block), classes, threshold)


def all_pairs(sets: DataFrame, threshold: float = 0.85, block: int = BLOCK) -> DataFrame:
    """All similar files of a repository, ``(repo, u, v, similarity)``, ``u < v``.

    Copies are given once, as ``(smallest path, copy, 1.0)``, and stand in for
    one another in all other pairs: the full pair list is the expansion of
    ``u`` and ``v`` by their copies.  The output stays linear in the copies."""
    keyed, classes = set_classes(sets)
    pairs = class_pairs(classes, threshold, block)
    if threshold > 1:
        return pairs
    copies = (
        keyed.join(classes.where("copies > 1").select("repo", "set_key", F.col("v").alias("u")), ["repo", "set_key"])
        .where(F.col("path") > F.col("u"))
        .select("repo", "u", F.col("path").alias("v"), F.lit(1.0).alias("similarity"))
    )
    return pairs.unionByName(copies)
