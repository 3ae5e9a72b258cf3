"""Greedy clustering of similar files, in parallel and exactly.

The sequential rule scans paths in ascending order; an unassigned path opens a
cluster and takes every unassigned path similar *to it*.  Equivalently:

* a path opens a cluster iff no earlier opener is similar to it, so openers are
  the lexicographically first maximal independent set of the similarity graph;
* every other path belongs to its smallest similar opener.

Openers are found in rounds of joins (Blelloch, Fineman and Shun 2012).
Families of near copies would fill that graph with all their pairs, so while
buckets are large, openers are first *peeled*: a class that is the smallest
open one in all its buckets is an opener, whatever its neighbours, and is
compared with its buckets only.  That is linear in the family.
"""

from __future__ import annotations

import itertools

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourcelake.operators.ordinals import ordinals
from sourcelake.operators.shingles import jaccard
from sourcelake.operators.similarity import (
    BLOCK,
    candidate_pairs,
    may_match,
    prefix_rows,
    set_classes,
    verify_pairs,
)
from sourcelake.session import materialize

HOT_BUCKET = 64  # open classes the average row shares a bucket with, above which peeling pays
ROUNDS = 4  # rounds before components are looked at
LOCAL_EDGES = 200_000  # edges of a component one task may settle


def _bucket_load(rows: DataFrame) -> tuple[float, float]:
    """Open rows, and the pairs their buckets imply."""
    sizes = rows.where(F.col("opener").isNull()).groupBy("repo", "h").agg(F.count("*").cast("double").alias("m"))
    total, pairs = sizes.agg(F.sum("m"), F.sum(F.col("m") * F.col("m"))).first()
    return total or 0.0, pairs or 0.0


def _peel(rows: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """One peeling pass over ``(repo, h, v, n, i, opener)``; NULL opener is open.

    Openers found leave the rows; classes they take carry the smallest opener
    seen so far and stay, since a later but smaller one may claim them."""
    open_rows = rows.where(F.col("opener").isNull())
    smallest = open_rows.groupBy("repo", "h").agg(F.min("v").alias("least"))
    openers = (
        open_rows.join(smallest, ["repo", "h"])
        .groupBy("repo", "v").agg(F.min(F.col("v") == F.col("least")).alias("first_everywhere"))
        .where("first_everywhere").select("repo", "v")
    )
    openers = materialize(openers, "openers")
    sources = open_rows.join(openers, ["repo", "v"], "left_semi").select(
        "repo", "h", F.col("v").alias("u"), F.col("n").alias("nu"), F.col("i").alias("iu")
    )
    met = (
        rows.join(sources, ["repo", "h"])
        .where((F.col("u") < F.col("v")) & (F.col("opener").isNull() | (F.col("u") < F.col("opener"))))
        .where(may_match(F.col("nu"), F.col("iu"), F.col("n"), F.col("i"), threshold))
        .select("repo", "u", "v").distinct()
    )
    taken = verify_pairs(met, classes, threshold).groupBy("repo", "v").agg(F.min("u").alias("taker"))
    return (
        rows.join(openers, ["repo", "v"], "left_anti")
        .join(taken, ["repo", "v"], "left")
        .select("repo", "h", "v", "n", "i", F.least("opener", "taker").alias("opener"))
    )


def _round(active: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One round over open edges: ``(nodes taken, edges still open)``.

    A node without a smaller open neighbour opens a cluster and takes its
    neighbours; edges of taken nodes close."""
    blocked = active.select("repo", F.col("v").alias("u")).distinct()
    out = materialize(
        active.join(blocked, ["repo", "u"], "left_anti").select("repo", "v").distinct(), "taken"
    )
    rest = active.join(out, ["repo", "v"], "left_anti").join(
        out.select("repo", F.col("v").alias("u")), ["repo", "u"], "left_anti"
    )
    return out, materialize(rest, "active")


def component_labels(edges: DataFrame) -> DataFrame:
    """``(repo, node, label)``: the smallest node each node is connected to.

    Labels spread to neighbours and then jump to their label's label, which
    halves a chain every round."""
    links = edges.select("repo", F.col("u").alias("node"), F.col("v").alias("other"))
    links = links.unionByName(links.select("repo", F.col("other").alias("node"), F.col("node").alias("other")))
    links = materialize(links.distinct(), "links")
    labels = materialize(
        links.groupBy("repo", "node").agg(F.least(F.first("node"), F.min("other")).alias("label")), "labels"
    )
    while True:
        of = lambda name, alias: labels.select("repo", F.col("node").alias(name), F.col("label").alias(alias))
        near = links.join(of("other", "l"), ["repo", "other"]).groupBy("repo", "node").agg(F.min("l").alias("near"))
        jumped = (
            labels.join(near, ["repo", "node"])
            .join(of("label", "far"), ["repo", "label"])
            .select("repo", "node", "label", F.least("label", "near", "far").alias("next"))
        )
        jumped = materialize(jumped, "labels")
        if jumped.where("next < label").isEmpty():
            return jumped.select("repo", "node", "label")
        labels = jumped.select("repo", "node", F.col("next").alias("label"))


def _solve_component(edges: pd.DataFrame) -> pd.DataFrame:
    """Nodes taken in one component, visited in ascending order."""
    taken: set[str] = set()
    for node, smaller in edges.sort_values("v").groupby("v", sort=False)["u"]:
        if any(u not in taken for u in smaller):
            taken.add(node)
    return pd.DataFrame({"repo": edges["repo"].iloc[0], "v": sorted(taken)}, columns=["repo", "v"])


def independent_rounds(edges: DataFrame, rounds: int = ROUNDS, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """Nodes of ``(repo, u, v)``, ``u < v``, outside the lexicographically first
    maximal independent set, as ``(repo, v)``.

    Few rounds settle most graphs.  What is then left are chains, say versions
    that each resemble the next: their components of at most ``local_edges``
    edges are settled one per task, larger ones by further rounds."""
    active = materialize(edges.select("repo", "u", "v"), "active")
    taken = active.select("repo", "v").where(F.lit(False))
    for done in itertools.count(1):
        if active.isEmpty():
            return taken
        out, active = _round(active)
        taken = taken.unionByName(out)
        if done == rounds and not active.isEmpty():
            labels = component_labels(active)
            labelled = active.join(labels.withColumnRenamed("node", "u"), ["repo", "u"])
            sizes = labelled.groupBy("repo", "label").agg(F.count("*").alias("edges"))
            small = sizes.where(F.col("edges") <= local_edges).select("repo", "label")
            local = labelled.join(small, ["repo", "label"], "left_semi").repartition("repo", "label")
            settled = local.groupBy("repo", "label").applyInPandas(_solve_component, "repo string, v string")
            taken = taken.unionByName(materialize(settled, "taken"))
            active = materialize(
                labelled.join(small, ["repo", "label"], "left_anti").select("repo", "u", "v"), "active"
            )


def assign_openers(
    classes: DataFrame, threshold: float, *, hot_bucket: int = HOT_BUCKET, block: int = BLOCK
) -> DataFrame:
    """``(repo, v, opener)`` for the classes another one's cluster takes."""
    rows = materialize(
        prefix_rows(classes, threshold).withColumn("opener", F.lit(None).cast("string")), "prefixes"
    )
    total, load = _bucket_load(rows)
    while load > hot_bucket * total:
        rows = materialize(_peel(rows, classes, threshold), "prefixes")
        total, remaining = _bucket_load(rows)
        if remaining > 0.7 * load:  # many dissimilar classes: pairs are cheaper than passes
            break
        load = remaining

    still_open = rows.where(F.col("opener").isNull())
    candidates = candidate_pairs(still_open, rows, threshold, block)
    known = rows.where(F.col("opener").isNotNull()).select("repo", "v", "opener").distinct()
    edges = materialize(
        verify_pairs(candidates, classes, threshold).join(known, ["repo", "v"], "left")
        .where(F.col("opener").isNull() | (F.col("u") < F.col("opener")))
        .select("repo", "u", "v", F.col("opener").isNull().alias("open")),
        "edges",
    )
    taken = independent_rounds(edges.where("open").select("repo", "u", "v"))
    from_openers = edges.join(taken.select("repo", F.col("v").alias("u")), ["repo", "u"], "left_anti")
    return (
        known.unionByName(from_openers.select("repo", "v", F.col("u").alias("opener")))
        .groupBy("repo", "v").agg(F.min("opener").alias("opener"))
    )


def greedy_cluster(
    sets: DataFrame, threshold: float = 0.85, *, hot_bucket: int = HOT_BUCKET, block: int = BLOCK
) -> DataFrame:
    """``(repo, representative, member)`` of all clusters with two or more files."""
    if threshold <= 0:  # everything is similar: one cluster per repository
        first = sets.groupBy("repo").agg(F.min("path").alias("representative"), F.count("*").alias("size"))
        return sets.join(first.where("size > 1"), "repo").select(
            "repo", "representative", F.col("path").alias("member")
        )
    keyed, classes = set_classes(sets)
    if threshold > 1:  # not even copies qualify
        return keyed.where(F.lit(False)).select(
            "repo", F.col("path").alias("representative"), F.col("path").alias("member")
        )
    openers = assign_openers(classes, threshold, hot_bucket=hot_bucket, block=block)
    placed = classes.join(openers, ["repo", "v"], "left").select(
        "repo", "set_key", "copies", F.coalesce("opener", "v").alias("representative")
    )
    shared = placed.groupBy("repo", "representative").agg(F.sum("copies").alias("size")).where("size > 1")
    placed = placed.join(shared, ["repo", "representative"], "left_semi").select("repo", "set_key", "representative")
    return keyed.join(placed, ["repo", "set_key"]).select("repo", "representative", F.col("path").alias("member"))


def similar_pairs(sets: DataFrame, threshold: float = 0.85) -> DataFrame:
    """``(repo, opener, member, similarity)``: what the rule compares and finds.

    One row for each member of a cluster but its opener, so a family of copies
    or near copies costs its size and not its pairs."""
    members = greedy_cluster(sets, threshold).where(F.col("representative") != F.col("member"))
    hashes = lambda path, name: sets.select("repo", F.col("path").alias(path), F.col("hashes").alias(name))
    both = members.join(hashes("member", "a"), ["repo", "member"]).join(hashes("representative", "b"), ["repo", "representative"])
    return both.select("repo", F.col("representative").alias("opener"), "member", jaccard(F.col("a"), F.col("b")).alias("similarity"))


def cluster_fingerprints(members: DataFrame) -> DataFrame:
    """``(repo, representative, size, fingerprint)``: SHA-1 of the representative,
    the size, and the sums of five 32-bit slices of the members' SHA-1.

    Sums combine before the shuffle, so the value is the same for every size
    and order and no task holds a cluster."""
    slices = [F.conv(F.substring(F.sha1("member"), 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(5)]
    sums = members.groupBy("repo", "representative").agg(
        F.count("*").alias("size"), *[F.sum(s).alias(f"_{i}") for i, s in enumerate(slices)]
    )
    parts = [F.col(c).cast("string") for c in ("size", "_0", "_1", "_2", "_3", "_4")]
    return sums.select("repo", "representative", "size", F.sha1(F.concat_ws("|", "representative", *parts)).alias("fingerprint"))


def cluster_ids(members: DataFrame, threshold: float = 0.85) -> DataFrame:
    """One row per cluster: ``cluster_<n>`` numbered by representative within the
    repository, its size, threshold and fingerprint."""
    numbered = ordinals(cluster_fingerprints(members), ["repo"], ["representative"], "no")
    return numbered.select(
        "repo",
        F.concat(F.lit("cluster_"), F.col("no").cast("string")).alias("cluster_id"),
        "representative",
        "size",
        F.lit(float(threshold)).alias("threshold"),
        "fingerprint",
    )
