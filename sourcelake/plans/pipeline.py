"""The whole pipeline, from files to metrics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from sourcelake.operators import artifact, clustering, code_trees, context, graph, metrics, shingles, structure, summaries
from sourcelake.operators.filters import select_files
from sourcelake.session import materialize


@dataclass
class CorpusAnalysis:
    """Tables of one run.  All are lazy except those written on the way."""

    structures: DataFrame
    rejected: DataFrame
    graph: DataFrame
    members: DataFrame
    clusters: DataFrame
    summaries: DataFrame
    fragments: DataFrame
    metrics: DataFrame

    def context_lines(self, title: str = context.TITLE) -> DataFrame:
        return context.context_lines(self.graph, self.summaries, title)


def analyze(
    files: DataFrame,
    *,
    rules: DataFrame | None = None,
    fingerprints: DataFrame | None = None,
    by: str = "trees",
    threshold: float = 0.85,
    cache: DataFrame | None = None,
    resolve_relative: bool = False,
    source_roots=(),
    select: bool = True,
    generated_at: Column | None = None,
    root_tag: str = artifact.ROOT_TAG,
) -> CorpusAnalysis:
    """Select files, extract structure, resolve imports, cluster, summarise,
    and lay out artifacts and metrics.

    Files are clustered ``by`` the subtree hashes of their block trees
    (``"trees"``), by shingles of token classes (``"shapes"``), or by the sets in
    ``fingerprints``.  ``files`` is scanned once for structure and shapes, and once
    more for trees; everything after works on the small derived tables, written once."""
    if by not in ("trees", "shapes"):
        raise ValueError(f"by {by!r}")
    if select:
        files = select_files(files, rules=rules)
    _, rejected = structure.split_languages(files)
    run = shingles.SHAPE_RUN if fingerprints is None and by == "shapes" else None
    scanned = materialize(structure.extract_structure(files, run), "structures")
    structures = scanned.drop("hashes")
    resolved = graph.resolve_imports(
        structures, resolve_relative=resolve_relative, source_roots=source_roots, keep_empty=True
    )
    nodes = materialize(graph.adjacency(resolved), "graph")
    if fingerprints is None:
        fingerprints = code_trees.tree_fingerprints(files) if by == "trees" else scanned.select("repo", "path", "hashes")
    members = materialize(clustering.greedy_cluster(fingerprints, threshold), "members")
    clusters = materialize(clustering.cluster_ids(members, threshold), "clusters")
    computed = summaries.summarize(structures) if cache is None else summaries.cached_summaries(structures, cache)
    modules = summaries.inject_summaries(artifact.placeholder_modules(structures), computed)
    fragments = artifact.build_artifact(
        nodes, modules, clusters, members, generated_at=generated_at, root_tag=root_tag
    )
    return CorpusAnalysis(
        structures=structures,
        rejected=rejected,
        graph=nodes,
        members=members,
        clusters=clusters,
        summaries=computed.select("repo", "path", "key", "summary"),
        fragments=fragments,
        metrics=metrics.compression_ratio(
            metrics.pipeline_metrics(structures, nodes, clusters, artifact.artifact_size(fragments))
        ),
    )
