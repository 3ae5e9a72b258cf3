"""Size metrics per repository: sums of lengths, never concatenated text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourcelake.functions.text import tokens_of_length


def raw_tokens(structures: DataFrame) -> DataFrame:
    """Tokens of all contents joined by newlines.  Reads ``n_chars``."""
    return structures.groupBy("repo").agg(
        tokens_of_length(F.sum("n_chars") + F.count("*") - 1).alias("raw_tokens")
    )


def compression_ratio(sizes: DataFrame) -> DataFrame:
    """Adds artifact over raw tokens, 0 for an empty repository."""
    return sizes.withColumn(
        "compression_ratio",
        F.when(F.col("raw_tokens") > 0, F.col("artifact_tokens") / F.col("raw_tokens")).otherwise(F.lit(0.0)),
    )


def _counts(structures: DataFrame, graph: DataFrame) -> DataFrame:
    files = structures.groupBy("repo").agg(
        F.count("*").alias("files"),
        tokens_of_length(F.sum("n_chars") + F.count("*") - 1).alias("raw_tokens"),
    )
    edges = graph.groupBy("repo").agg(F.sum(F.size("depends_on")).alias("edges"))
    return files.join(edges, "repo", "left").withColumn("edges", F.coalesce("edges", F.lit(0)))


def pipeline_metrics(structures: DataFrame, graph: DataFrame, clusters: DataFrame, artifact_sizes: DataFrame) -> DataFrame:
    """One row per repository; every input is reduced by ``repo`` with partial
    sums before it moves."""
    clustered = clusters.groupBy("repo").agg(F.count("*").alias("clusters"), F.max("size").alias("largest_cluster"))
    return (
        _counts(structures, graph)
        .join(clustered, "repo", "left")
        .join(artifact_sizes, "repo", "left")
        .select(
            "repo", "files", "edges",
            F.coalesce("clusters", F.lit(0)).alias("clusters"),
            F.coalesce("largest_cluster", F.lit(0)).alias("largest_cluster"),
            "raw_tokens", "artifact_tokens", "artifact_bytes",
        )
    )


def artifact_status(graph: DataFrame, generated_at) -> DataFrame:
    """What a status display shows about each repository's artifact."""
    return graph.groupBy("repo").agg(
        F.count("*").alias("modules"),
        F.count("*").alias("files"),
        F.sum(F.size("depends_on")).alias("edges"),
    ).withColumn("generated_at", generated_at)
