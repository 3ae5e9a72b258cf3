"""Artifact documents: XML in, ordered XML out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sourcelake import schemas
from sourcelake.functions.paths import basename
from sourcelake.operators.artifact import ORDER


@dataclass
class Artifact:
    """Tables of loaded documents, each with its ``repo``."""

    metadata: DataFrame
    nodes: DataFrame
    edges: DataFrame
    modules: DataFrame
    clusters: DataFrame


def _repo() -> Column:
    """The repository a file belongs to: its ``repo=`` folder, decoded, else the
    file's name.  A document written in parts is one repository."""
    path = F.col("_metadata.file_path")
    folder = F.regexp_extract(path, "/repo=([^/]*)/[^/]*$", 1)
    # The file system's form escapes what the folder's own escapes left.
    plus = lambda c: F.replace(c, F.lit("+"), F.lit("%2B"))
    decoded = F.url_decode(plus(F.url_decode(plus(folder))))
    return F.when(folder != "", decoded).otherwise(F.regexp_replace(basename(path), r"\.[^.]*$", ""))


def _elements(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    """One row per element, read as a stream of them: neither a document nor a part of
    one is ever a single string.  Parts need not be well formed by themselves, but
    hold whole elements: the parser that looks for tags reads them, where the other
    stops at the first end tag that has no start."""
    options = {"recursiveFileLookup": "true", "rowTag": tag, "useLegacyXMLParser": "true"}
    rows = spark.read.options(**options).schema(schema).xml(path)
    return rows.select(_repo().alias("repo"), *rows.columns)


def scan_artifact(spark: SparkSession, path: str) -> Artifact:
    """Read one document, a folder or a glob of them.

    Each table reads only its own element.  Empty text counts as absent; edges
    keep their order by ``(src, pos)``.  Of a single file the root's ``repo``
    attribute is the repository in ``metadata``."""
    filled = lambda items: F.filter(F.coalesce(items, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))
    lines = spark.read.option("recursiveFileLookup", "true").text(path).select("value", _repo().alias("folder"))
    attribute = F.regexp_extract("value", r"""^\s*<[\w.-]+\b[^>]*?\srepo=["']([^"']*)["']""", 1)
    plain = F.regexp_replace(F.replace(F.replace(attribute, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), "&amp;", "&")
    tag = lambda name: F.max(F.nullif(F.regexp_extract("value", rf"^\s*<{name}>([^<]+)</{name}>", 1), F.lit("")))
    metadata = lines.groupBy("folder").agg(
        F.max(F.nullif(plain, F.lit(""))).alias("repo"),
        tag("files_count").cast("bigint").alias("files_count"),
        tag("generated_at").alias("generated_at"),
    ).select(F.coalesce("repo", "folder").alias("repo"), "files_count", "generated_at")

    nodes = _elements(spark, path, "node", schemas.ARTIFACT_NODES).where("_name <> ''")
    deps = nodes.select("repo", F.col("_name").alias("src"), F.posexplode(filled(F.col("depends_on.dep"))).alias("pos", "dst"))
    modules = _elements(spark, path, "module", schemas.ARTIFACT_MODULES).select(
        "repo",
        F.coalesce("_path", F.lit("")).alias("path"),
        filled(F.col("classes.class")).alias("classes"),
        filled(F.col("functions.function")).alias("functions"),
        filled(F.col("imports.import")).alias("imports"),
        F.coalesce("summary", F.lit("")).alias("summary"),
    )
    clusters = _elements(spark, path, "cluster", schemas.ARTIFACT_CLUSTERS).select(
        "repo",
        F.col("_id").alias("cluster_id"),
        F.col("_representative").alias("representative"),
        F.col("_threshold").alias("threshold"),
        F.col("_fingerprint").alias("fingerprint"),
        F.explode(filled(F.col("members.member"))).alias("member"),
    )
    return Artifact(
        metadata=metadata,
        nodes=nodes.select("repo", F.col("_name").alias("path"), F.col("_type").alias("type")),
        edges=deps.select("repo", "src", "dst", "pos"),
        modules=modules,
        clusters=clusters,
    )


def write_artifact(fragments: DataFrame, path: str) -> None:
    """Write every repository's document under ``path/repo=<name>/``.

    Range partitioning by document order splits a large repository over many
    tasks; its document is the concatenation of its part files in name order.
    No part ends inside an element, so the parts can also be read one by one: a
    cluster's lines are written by one task, which sorts and streams them."""
    (
        fragments.repartitionByRange("repo", "section", "name")
        .sortWithinPartitions("repo", *ORDER)
        .select("repo", F.col("xml").alias("value"))
        .write.partitionBy("repo")
        .text(path)
    )
