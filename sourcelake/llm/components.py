"""Connected components by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourcelake.session import materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node of the undirected ``edges``;
    ``component`` is the smallest node that can be reached.

    Each round every node takes, of itself and its neighbours, the one whose
    hash for that round is smallest, and the edges are redrawn between what was
    taken.  A fresh hash each round makes the expected number of nodes fall by
    a constant factor whatever the shape, so chains and stars both end after a
    number of rounds that grows with the logarithm of the nodes.  What a round
    leaves is written down; a node's choices are composed in the end.  Minima
    combine before the shuffle, so a hub costs a row per task, and the joins
    rest on written tables, whose skewed keys adaptive execution splits.

    Loops and repeated edges are allowed; NULL ends are ignored.  No edges, no
    rows."""
    pairs = edges.select(F.col(a).cast("bigint").alias("a"), F.col(b).cast("bigint").alias("b"))
    pairs = pairs.where("a is not null and b is not null")
    loops = pairs.where("a = b").select(F.col("a").alias("node"))
    live = materialize(_normal(pairs), "edges")
    choices: list[DataFrame] = []
    while not live.isEmpty():
        rank = lambda c: F.xxhash64(F.col(c), F.lit(len(choices)))  # noqa: B023, E731
        both = live.union(live.select("b", "a"))
        nearest = both.groupBy("a").agg(F.min(F.struct(rank("b").alias("r"), F.col("b").alias("v"))).alias("n"))
        own = F.struct(rank("a").alias("r"), F.col("a").alias("v"))
        choice = nearest.select(F.col("a").alias("node"), F.least("n", own)["v"].alias("taken"))
        choice = materialize(choice, "choice")
        choices.append(choice)
        redrawn = (
            live.join(choice.toDF("a", "_a"), "a").join(choice.toDF("b", "_b"), "b")
            .select(F.col("_a").alias("a"), F.col("_b").alias("b"))
        )
        live = materialize(_normal(redrawn), "edges")
    if not choices:
        return loops.distinct().select("node", F.col("node").alias("component"))
    labels = choices[0].toDF("node", "root")
    for choice in choices[1:]:
        labels = labels.join(choice.toDF("root", "_next"), "root", "left").select(
            "node", F.coalesce("_next", "root").alias("root")
        )
    labels = materialize(labels, "labels")
    smallest = materialize(labels.groupBy("root").agg(F.min("node").alias("component")), "smallest")
    found = labels.join(smallest, "root").select("node", "component")
    alone = loops.distinct().join(labels.select("node"), "node", "left_anti")
    return found.union(alone.select("node", F.col("node").alias("component")))


def _normal(pairs: DataFrame) -> DataFrame:
    """Each edge once, its larger end first."""
    return pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
