"""Queries over the benchmark tables and the SQL that checks them."""

from __future__ import annotations

import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from sourcelake.functions.text import count_tokens  # noqa: E402
from sourcelake.operators import (
    artifact,
    clustering,
    code_trees,
    context,
    filters,
    graph,
    metrics,
    shingles,
    structure,
    summaries,
    trees,
)
from sourcelake.plans import corpus
from sourcelake.plans.oracles import ORACLES
from sourcelake.plans.pipeline import analyze
from sourcelake.session import fresh_path, materialize
from sourcelake.sources.artifacts import scan_artifact, write_artifact
from sourcelake.sources.cache import append_cache, read_cache, write_cache
from sourcelake.sources.files import scan_files, write_trees
from sourcelake.sources.prompts import write_prompts
from sourcelake.streaming.incremental import incremental_summaries, read_batches

try:
    import corpus_pipeline
    from sourcelake.llm import queries as llm
except ModuleNotFoundError as e:
    if e.name not in ("corpus_pipeline", "sourcelake.llm"):
        raise
    corpus_pipeline = llm = None

FLAGSHIP_DIR = "/root/testdata/sf0.001"
THRESHOLD = 0.85
STAMP = "2024-01-01T00:00:00Z"


# --- shared inputs ------------------------------------------------------------


def _code(spark: SparkSession, sf: str) -> DataFrame:
    return structure.extract_structure(corpus.code_files(spark, sf))


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return structure.extract_structure(corpus.doc_files(spark, sf))


def _doc_graph(spark: SparkSession, sf: str) -> DataFrame:
    return graph.adjacency(graph.resolve_imports(_docs(spark, sf), keep_empty=True))


def _doc_lines(spark: SparkSession, sf: str) -> DataFrame:
    return shingles.line_fingerprints(corpus.doc_texts(spark, sf))


def _symbols(spark: SparkSession, sf: str, kinds: list[str], languages: list[str]) -> DataFrame:
    rows = _code(spark, sf).where(F.col("language").isin(*languages))
    return structure.symbols(rows, kinds)


def _numbered(df: DataFrame) -> DataFrame:
    return df.withColumn("pos", F.col("pos").cast("bigint"))


PY, JS, TS = ["python"], ["javascript", "typescript", "tsx"], ["typescript", "tsx"]


# --- queries ------------------------------------------------------------------


def q_scan_files(spark, sf):
    """Documents written as trees of files, then listed, filtered by suffix and read back."""
    roots = write_trees(corpus.tree_files(spark, sf), fresh_path(spark, "trees"))
    files = scan_files(spark, roots)
    return files.select("repo", "path", F.length("content").cast("bigint").alias("chars"), F.md5("content").alias("content_md5"))


def q_filter_ignored(spark, sf):
    paths = corpus.scattered_paths(spark, sf)
    return filters.filter_ignored(paths, filters.parse_ignore_rules(corpus.ignore_files(paths)))


def q_select_files(spark, sf):
    """All selection rules together."""
    paths = corpus.scattered_paths(spark, sf)
    return filters.select_files(paths, rules=filters.parse_ignore_rules(corpus.ignore_files(paths)))


def q_extract_structure(spark, sf):
    long = structure.symbols(_code(spark, sf))
    return long.groupBy("repo", "path", "kind").agg(
        F.count("*").alias("n"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda s: s["name"]), "|").alias("names"),
    )


def q_module_name(spark, sf):
    rows = graph.import_rows(_code(spark, sf)).where("language = 'python'")
    return _numbered(rows.select("repo", "path", "pos", graph.module_name(F.col("import_text")).alias("module")))


def q_js_specifier(spark, sf):
    rows = graph.import_rows(_code(spark, sf)).where("language <> 'python'")
    return _numbered(rows.select("repo", "path", "pos", graph.script_specifier(F.col("import_text")).alias("specifier")))


def q_import_candidates(spark, sf):
    rows = graph.import_candidates(graph.import_rows(_code(spark, sf)))
    return _numbered(rows).select("repo", "path", "pos", F.col("ord").cast("bigint").alias("ord"), "candidate")


def q_adjacency(spark, sf):
    nodes = graph.adjacency(graph.resolve_imports(_code(spark, sf), keep_empty=True))
    return nodes.select(
        "repo", "path",
        F.array_join("depends_on", ",").alias("depends_on"),
        F.array_join("external_imports", "|").alias("external"),
    )


def _pages(spark, sf):
    return trees.html_tree_nodes(corpus.spread(corpus.table(spark, sf, "pages"), "page_id"), "page_id", "html")


def q_html_tree_nodes(spark, sf):
    return _pages(spark, sf).select(
        "tree_id", "node_id", "parent_id", F.col("child_ord").cast("bigint").alias("child_ord"), "visit_ord", "type"
    )


def q_subtree_hash(spark, sf):
    return trees.subtree_hash(_pages(spark, sf)).select("tree_id", "node_id", "h")


def q_fingerprint_set(spark, sf):
    return trees.fingerprint_set(trees.subtree_hash(_pages(spark, sf)))


def q_code_tree_nodes(spark, sf):
    nodes = code_trees.code_tree_nodes(corpus.code_files(spark, sf))
    return nodes.select(
        "tree_id.repo", "tree_id.path", "node_id", "parent_id", F.col("child_ord").cast("bigint").alias("child_ord"), "visit_ord", "type"
    )


def q_code_fingerprints(spark, sf):
    """Structural fingerprints of code: subtree hashes of its block trees."""
    sets = trees.fingerprint_set(trees.subtree_hash(code_trees.code_tree_nodes(corpus.code_files(spark, sf))))
    return sets.select("tree_id.repo", "tree_id.path", "h")


def q_code_clusters(spark, sf):
    """Files of code clustered by their structural trees."""
    return clustering.greedy_cluster(code_trees.tree_fingerprints(corpus.code_files(spark, sf)), THRESHOLD).select("repo", "representative", "member")


def q_shape_shingles(spark, sf):
    documents = corpus.spread(corpus.table(spark, sf, "documents"), "doc_id")
    tokens = documents.select("doc_id", shingles.shape_tokens(F.col("text")).alias("t"))
    runs = tokens.select("doc_id", F.size("t").cast("bigint").alias("n_tokens"), shingles.shingles(F.col("t"), 5).alias("s"))
    return runs.select(
        "doc_id", "n_tokens", F.size("s").cast("bigint").alias("n_shingles"),
        F.array_min("s").alias("first_shingle"), F.array_max("s").alias("last_shingle"),
    )


def q_jaccard(spark, sf):
    sets = _doc_lines(spark, sf)
    edges = graph.dependency_edges(graph.resolve_imports(_docs(spark, sf)))
    side = lambda path, alias: sets.select("repo", F.col("path").alias(path), F.col("hashes").alias(alias))
    return (
        edges.join(side("src", "a"), ["repo", "src"]).join(side("dst", "b"), ["repo", "dst"])
        .select("repo", "src", "dst", F.round(shingles.jaccard(F.col("a"), F.col("b")), 6).alias("similarity"))
    )


def q_similar_pairs(spark, sf):
    pairs = clustering.similar_pairs(_doc_lines(spark, sf), THRESHOLD)
    return pairs.select("repo", "opener", "member", F.round("similarity", 6).alias("similarity"))


def q_greedy_cluster(spark, sf):
    return clustering.greedy_cluster(_doc_lines(spark, sf), THRESHOLD)


def q_cluster_ids(spark, sf):
    members = clustering.greedy_cluster(_doc_lines(spark, sf), THRESHOLD)
    return clustering.cluster_ids(members, THRESHOLD)


def q_summary_prompt(spark, sf):
    prompts = summaries.summary_prompt(structure.extract_structure(corpus.doc_files(spark, sf), keep_content=True))
    return prompts.select("repo", "path", F.md5("prompt").alias("prompt_md5"), F.length("prompt").cast("bigint").alias("chars"))


def q_dependency_mentions(spark, sf):
    rows = _code(spark, sf).select("repo", "path", summaries.dependency_mentions(F.col("imports")).alias("m"))
    return rows.select("repo", "path", F.array_join("m", ", ").alias("mentions"))


def _seed_cache(spark, sf):
    """A cache that knows every third order, with every ninth entry empty."""
    computed = summaries.summarize(_code(spark, sf)).where("path like 'orders/%'")
    k = F.regexp_extract("path", r"order_(\d+)", 1).cast("bigint")
    known = computed.where(k % 3 == 0)
    return known.select("key", F.when(k % 9 == 0, F.lit("")).otherwise(F.concat(F.lit("cached "), k.cast("string"))).alias("summary"))


def q_cached_summaries(spark, sf):
    return summaries.cached_summaries(_code(spark, sf), _seed_cache(spark, sf)).select("repo", "path", "summary")


def q_cache_upsert(spark, sf):
    """A cache that a run appended its misses to, one entry per key."""
    path = write_cache(_seed_cache(spark, sf))
    append_cache(spark, path, _code(spark, sf))
    return summaries.cache_entries(read_cache(spark, path))


def q_read_cache(spark, sf):
    """Twice appended, which adds nothing the second time."""
    code = materialize(_code(spark, sf), "structures")
    path = write_cache(_seed_cache(spark, sf))
    append_cache(spark, path, code)
    append_cache(spark, path, code)
    return read_cache(spark, path).where("summary <> ''")


def q_inject_summaries(spark, sf):
    code = _code(spark, sf)
    new = summaries.summarize(code).where("path like 'orders/%'")
    return summaries.inject_summaries(artifact.placeholder_modules(code), new).select("repo", "path", "summary")


def q_incremental_summaries(spark, sf):
    """Events arrive in daily files, several to a batch, as versions of a user's
    file, one version per day: batches see keys again that earlier ones added."""
    events, daily = spark.read.parquet(f"{sf}/events.parquet"), fresh_path(spark, "daily-events")
    part = F.pmod(F.col("event_id"), F.lit(4))
    events.withColumn("part", part).repartition("part").write.partitionBy("part").parquet(daily)
    events = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).option("recursiveFileLookup", "true").parquet(daily)
    day = F.unix_date(F.col("ts").cast("date"))
    versions = events.select(
        F.col("event_type").alias("repo"),
        F.concat(F.lit("users/user_"), F.col("user_id").cast("string"), F.lit(".py")).alias("path"),
        F.timestamp_seconds(day.cast("bigint") * 86400).alias("mtime"),
        F.concat(
            F.lit("import "), F.col("event_type"), F.lit("\n\n\ndef handle_"), F.col("user_id").cast("string"),
            F.lit("(event):\n    return event\n"),
        ).alias("content"),
    )
    summarized = summaries.summarize(structure.extract_structure(versions)).select("key", "summary")
    cache, marks = fresh_path(spark, "stream-cache"), fresh_path(spark, "stream-marks")
    incremental_summaries(summarized, cache, marks).awaitTermination()
    return read_batches(spark, cache).select("key", "summary")


def q_build_artifact(spark, sf):
    return _artifact(spark, sf).fragments.withColumn("section", F.col("section").cast("bigint")).select("repo", "section", "name", "xml")


def _artifact(spark, sf):
    return analyze(
        corpus.doc_files(spark, sf), fingerprints=_doc_lines(spark, sf), threshold=THRESHOLD,
        select=False, generated_at=F.lit(STAMP),
    )


def q_scan_artifact(spark, sf):
    """Documents written in parts and read back: every table of them."""
    path = fresh_path(spark, "artifacts")
    write_artifact(_artifact(spark, sf).fragments, path)
    loaded = scan_artifact(spark, path)
    rows = lambda df, kind, a, b: df.select("repo", kind.alias("kind"), a.alias("a"), b.alias("b"))
    edges = rows(loaded.edges, F.lit("edge"), F.col("src"), F.col("dst"))
    modules = rows(loaded.modules, F.lit("module"), F.col("path"), F.col("summary"))
    members = rows(loaded.clusters, F.lit("member"), F.col("representative"), F.col("member"))
    nodes = rows(loaded.nodes, F.coalesce("type", F.lit("node")), F.col("path"), F.lit(None).cast("string"))
    files = rows(loaded.metadata, F.lit("files"), F.col("files_count").cast("string"), F.col("generated_at"))
    return edges.unionByName(modules).unionByName(members).unionByName(nodes).unionByName(files)


def q_artifact_size(spark, sf):
    return artifact.artifact_size(_artifact(spark, sf).fragments)


def q_pipeline_metrics(spark, sf):
    return _artifact(spark, sf).metrics.drop("compression_ratio")


def q_selected_pipeline(spark, sf):
    """The whole run from a tree of files: selection by suffix, ignore rules, test
    directories and lock files, then clusters by block trees."""
    files = corpus.scattered_files(spark, sf)
    rules = filters.parse_ignore_rules(corpus.ignore_files(corpus.scattered_paths(spark, sf)))
    run = analyze(files, rules=rules, threshold=THRESHOLD, generated_at=F.lit(STAMP))
    return run.metrics.select("repo", "files", "edges", "clusters", "largest_cluster", "raw_tokens")


def q_rejected_files(spark, sf):
    """Selected files of no known language, set aside instead of ending the run."""
    paths = corpus.scattered_paths(spark, sf).withColumn("content", F.lit(""))
    return structure.split_languages(paths)[1].select("repo", "path")


def q_compression_ratio(spark, sf):
    return _artifact(spark, sf).metrics.select("repo", "raw_tokens", "artifact_tokens", F.round("compression_ratio", 6).alias("compression_ratio"))


def q_artifact_status(spark, sf):
    nodes = graph.adjacency(graph.resolve_imports(_code(spark, sf), keep_empty=True))
    return metrics.artifact_status(nodes, F.lit(STAMP))


def _context_lines(spark, sf):
    docs = materialize(_docs(spark, sf), "structures")
    nodes = graph.adjacency(graph.resolve_imports(docs, keep_empty=True))
    return context.context_lines(nodes, summaries.summarize(docs))


def q_context_block(spark, sf):
    return context.context_block(_context_lines(spark, sf))


def q_prompt_pairs(spark, sf):
    pairs = context.prompt_pairs(_context_lines(spark, sf), corpus.questions(spark, sf))
    return pairs.select("id", "question", "baseline_prompt", "context_suffix", "context_tokens", "prompt_tokens")


def q_write_prompts(spark, sf):
    """Written and read back: the lines of every context, and every question's part of its prompt."""
    path, lines = fresh_path(spark, "prompts"), _context_lines(spark, sf)
    write_prompts(context.context_block(lines), context.prompt_pairs(lines, corpus.questions(spark, sf)), path)
    written = spark.read.schema("repo string, no bigint, line string").json(f"{path}/context")
    asked = spark.read.schema("repo string, id string, context_suffix string").json(f"{path}/questions")
    return written.select("repo", F.col("no").cast("string").alias("id"), F.md5("line").alias("text_md5")).unionByName(
        asked.select("repo", "id", F.md5("context_suffix").alias("text_md5"))
    )


def q_avg_context_tokens(spark, sf):
    out = context.avg_context_tokens(_context_lines(spark, sf), corpus.questions(spark, sf))
    return out.select("questions", F.round("avg_context_tokens", 6).alias("avg_context_tokens"))


def _resolved(spark, sf):
    return graph.resolve_imports(_code(spark, sf))


def _llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**llm.QUERIES, "pipeline": corpus_pipeline.run} if llm else {}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    paths = corpus.scattered_paths
    return _llm_queries() | {
        "scan_files": q_scan_files,
        "filter_extension": lambda s, d: filters.filter_extension(paths(s, d), filters.DEFAULT_EXTENSIONS),
        "filter_ignored": q_filter_ignored,
        "select_files": q_select_files,
        "filter_tests": lambda s, d: filters.filter_tests(paths(s, d)),
        "filter_filenames": lambda s, d: filters.filter_filenames(paths(s, d)),
        "count_source_files": lambda s, d: filters.count_source_files(paths(s, d)),
        "detect_language": lambda s, d: paths(s, d).select("repo", "path", structure.detect_language(F.col("path")).alias("language")),
        "extract_functions_py": lambda s, d: _numbered(_symbols(s, d, ["functions"], PY)),
        "extract_classes": lambda s, d: _numbered(_symbols(s, d, ["classes"], PY + JS)),
        "extract_imports_py": lambda s, d: _numbered(_symbols(s, d, ["imports"], PY)),
        "extract_imports_js": lambda s, d: _numbered(_symbols(s, d, ["imports"], JS)),
        "extract_functions_js": lambda s, d: _numbered(_symbols(s, d, ["functions"], JS)),
        "extract_ts_types": lambda s, d: _numbered(_symbols(s, d, ["interfaces", "types", "enums", "exports"], TS)),
        "extract_structure": q_extract_structure,
        "module_name": q_module_name,
        "js_specifier": q_js_specifier,
        "import_candidates": q_import_candidates,
        "resolve_imports": lambda s, d: _numbered(_resolved(s, d)).select("repo", "path", "pos", "dst"),
        "dependency_edges": lambda s, d: _numbered(graph.dependency_edges(_resolved(s, d))),
        "external_imports": lambda s, d: _numbered(graph.external_imports(_resolved(s, d))),
        "graph_nodes": lambda s, d: graph.graph_nodes(corpus.code_files(s, d)),
        "leaf_nodes": lambda s, d: graph.leaf_nodes(graph.adjacency(graph.resolve_imports(_code(s, d), keep_empty=True))),
        "adjacency": q_adjacency,
        "html_tree_nodes": q_html_tree_nodes,
        "subtree_hash": q_subtree_hash,
        "fingerprint_set": q_fingerprint_set,
        "code_tree_nodes": q_code_tree_nodes,
        "code_fingerprints": q_code_fingerprints,
        "code_clusters": q_code_clusters,
        "shape_shingles": q_shape_shingles,
        "jaccard": q_jaccard,
        "similar_pairs": q_similar_pairs,
        "greedy_cluster": q_greedy_cluster,
        "cluster_ids": q_cluster_ids,
        "summary_prompt": q_summary_prompt,
        "template_summary": lambda s, d: summaries.summarize(_code(s, d)).select("repo", "path", "summary"),
        "dependency_mentions": q_dependency_mentions,
        "cache_key": lambda s, d: summaries.summarize(_code(s, d)).select("repo", "path", "key"),
        "cached_summaries": q_cached_summaries,
        "cache_upsert": q_cache_upsert,
        "read_cache": q_read_cache,
        "inject_summaries": q_inject_summaries,
        "incremental_summaries": q_incremental_summaries,
        "count_tokens": lambda s, d: corpus.table(s, d, "documents").select("doc_id", count_tokens(F.col("text")).alias("tokens")),
        "raw_tokens": lambda s, d: metrics.raw_tokens(_docs(s, d)),
        "build_artifact": q_build_artifact,
        "scan_artifact": q_scan_artifact,
        "artifact_size": q_artifact_size,
        "compression_ratio": q_compression_ratio,
        "pipeline_metrics": q_pipeline_metrics,
        "selected_pipeline": q_selected_pipeline,
        "rejected_files": q_rejected_files,
        "artifact_status": q_artifact_status,
        "context_block": q_context_block,
        "prompt_pairs": q_prompt_pairs,
        "write_prompts": q_write_prompts,
        "avg_context_tokens": q_avg_context_tokens,
    }


def entry(spark: SparkSession) -> DataFrame:
    """Edges and external imports of every repository."""
    resolved = graph.resolve_imports(_code(spark, FLAGSHIP_DIR))
    return resolved.groupBy("repo").agg(
        F.count("dst").alias("edges"), (F.count("*") - F.count("dst")).alias("external_imports")
    )


def oracle_sql() -> dict[str, str]:
    found = dict(ORACLES)
    if llm:
        found |= llm.ORACLES
        if corpus_pipeline.ORACLE_SQL:
            found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found
