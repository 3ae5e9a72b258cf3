"""The per-repository XML document, as ordered fragments.

A repository may hold a large share of all files, so its document is never one
row: a fragment is one node, one module, one line of a cluster, or a line that
opens or closes a section.  Fragments ordered by :data:`ORDER` and joined by
newlines are the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourcelake.functions.text import tokens_of_length, xml_attr, xml_text

# The document format.
FORMAT_VERSION = "0.1"
TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss'Z'"
PLACEHOLDER_SUMMARY = "PLACEHOLDER - will be filled by LLM summarizer in Phase 2"
ROOT_TAG = "sourcelake"

ORDER = ("section", "name", "part", "item")
HEADER, GRAPH, NODE, GRAPH_END, PATTERNS, CLUSTER, PATTERNS_END, MODULES, MODULE, END = range(10)


def _list_element(tag: str, child: str, items: Column, indent: str) -> Column:
    """``<tag>`` around one ``<child>`` per item, or ``<tag />``."""
    lines = F.transform(items, lambda x: F.concat(F.lit(f"{indent}  <{child}>"), xml_text(x), F.lit(f"</{child}>")))
    return F.when(F.coalesce(F.size(items), F.lit(0)) == 0, F.lit(f"{indent}<{tag} />")).otherwise(
        F.concat(F.lit(f"{indent}<{tag}>\n"), F.array_join(lines, "\n"), F.lit(f"\n{indent}</{tag}>"))
    )


def node_fragments(graph: DataFrame) -> DataFrame:
    leaf = F.when(F.size("depends_on") == 0, F.lit(' type="leaf"')).otherwise(F.lit(""))
    xml = F.concat(
        F.lit('    <node name="'), xml_attr(F.col("path")), F.lit('"'), leaf, F.lit(">\n"),
        _list_element("depends_on", "dep", F.col("depends_on"), " " * 6), F.lit("\n    </node>"),
    )
    return graph.select("repo", F.lit(NODE).alias("section"), F.col("path").alias("name"), F.lit(0).alias("part"), F.lit("").alias("item"), xml.alias("xml"))


def module_fragments(modules: DataFrame) -> DataFrame:
    """``modules``: ``(repo, path, classes, functions, imports, summary)``."""
    pad = " " * 6
    summary = F.when(F.coalesce(F.col("summary"), F.lit("")) == "", F.lit(pad + "<summary />")).otherwise(
        F.concat(F.lit(pad + "<summary>"), xml_text(F.col("summary")), F.lit("</summary>"))
    )
    xml = F.concat(
        F.lit('    <module path="'), xml_attr(F.col("path")), F.lit('">\n'),
        _list_element("classes", "class", F.col("classes"), pad), F.lit("\n"),
        _list_element("functions", "function", F.col("functions"), pad), F.lit("\n"),
        _list_element("imports", "import", F.col("imports"), pad), F.lit("\n"),
        summary, F.lit("\n    </module>"),
    )
    return modules.select("repo", F.lit(MODULE).alias("section"), F.col("path").alias("name"), F.lit(0).alias("part"), F.lit("").alias("item"), xml.alias("xml"))


def cluster_fragments(clusters: DataFrame, members: DataFrame) -> DataFrame:
    """A ``<cluster>`` per cluster: its opening line (part 0), a line per member
    (part 1, in order of ``item``) and its closing line (part 2)."""
    attribute = lambda name, value: F.concat(F.lit(f' {name}="'), xml_attr(value), F.lit('"'))
    opening = F.concat(
        F.lit("    <cluster"),
        attribute("id", F.col("cluster_id")),
        attribute("representative", F.col("representative")),
        attribute("threshold", F.col("threshold").cast("string")),
        attribute("fingerprint", F.col("fingerprint")),
        F.lit(">\n      <members>"),
    )
    ends = F.array(
        F.struct(F.lit(0).alias("part"), opening.alias("xml")),
        F.struct(F.lit(2).alias("part"), F.lit("      </members>\n    </cluster>").alias("xml")),
    )
    frame = clusters.select("repo", F.col("representative").alias("name"), F.explode(ends).alias("e")).select(
        "repo", F.lit(CLUSTER).alias("section"), "name", "e.part", F.lit("").alias("item"), "e.xml"
    )
    line = F.concat(F.lit("        <member>"), xml_text(F.col("member")), F.lit("</member>"))
    return frame.unionByName(members.select(
        "repo", F.lit(CLUSTER).alias("section"), F.col("representative").alias("name"), F.lit(1).alias("part"),
        F.col("member").alias("item"), line.alias("xml"),
    ))


def frame_fragments(totals: DataFrame, generated_at: Column | None = None, root_tag: str = ROOT_TAG) -> DataFrame:
    """Opening and closing lines.  ``totals``: ``(repo, files, clusters)``."""
    stamp = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), TIME_FORMAT)
    header = F.concat(
        F.lit(f'<?xml version="1.0" encoding="UTF-8"?>\n<{root_tag} version="{FORMAT_VERSION}" repo="'),
        xml_attr(F.col("repo")), F.lit('">\n  <metadata>\n    <files_count>'), F.col("files").cast("string"),
        F.lit("</files_count>\n    <generated_at>"), stamp if generated_at is None else generated_at,
        F.lit("</generated_at>\n  </metadata>"),
    )
    line = lambda section, text, when=F.lit(True): F.when(
        when, F.struct(F.lit(section).alias("section"), text.alias("xml"))
    )
    clustered = F.col("clusters") > 0
    frame = F.array(
        line(HEADER, header),
        line(GRAPH, F.lit("  <dependency_graph>")),
        line(GRAPH_END, F.lit("  </dependency_graph>")),
        line(PATTERNS, F.lit("  <patterns>"), clustered),
        line(PATTERNS_END, F.lit("  </patterns>"), clustered),
        line(MODULES, F.lit("  <modules>")),
        line(END, F.lit(f"  </modules>\n</{root_tag}>")),
    )
    return totals.select("repo", F.explode(F.filter(frame, lambda f: f.isNotNull())).alias("f")).select(
        "repo", "f.section", F.lit("").alias("name"), F.lit(0).alias("part"), F.lit("").alias("item"), "f.xml"
    )


def placeholder_modules(structures: DataFrame) -> DataFrame:
    return structures.select(
        "repo", "path", "classes", "functions", "imports", F.lit(PLACEHOLDER_SUMMARY).alias("summary")
    )


def build_artifact(
    graph: DataFrame,
    modules: DataFrame,
    clusters: DataFrame | None = None,
    members: DataFrame | None = None,
    *,
    generated_at: Column | None = None,
    root_tag: str = ROOT_TAG,
) -> DataFrame:
    """``(repo, section, name, part, item, xml)`` of every repository's document.

    ``graph`` comes from ``adjacency``, ``modules`` from ``placeholder_modules``
    and ``inject_summaries``."""
    totals = graph.groupBy("repo").agg(F.count("*").alias("files"))
    if clusters is None:
        totals = totals.withColumn("clusters", F.lit(0))
    else:
        counted = clusters.groupBy("repo").agg(F.count("*").alias("clusters"))
        totals = totals.join(counted, "repo", "left").withColumn("clusters", F.coalesce("clusters", F.lit(0)))
    out = frame_fragments(totals, generated_at, root_tag)
    out = out.unionByName(node_fragments(graph)).unionByName(module_fragments(modules))
    return out if clusters is None else out.unionByName(cluster_fragments(clusters, members))


def artifact_size(fragments: DataFrame) -> DataFrame:
    """Tokens and UTF-8 bytes of each document, from its fragments' lengths."""
    breaks = F.count("*") - 1
    return fragments.groupBy("repo").agg(
        tokens_of_length(F.sum(F.length("xml")) + breaks).alias("artifact_tokens"),
        (F.sum(F.octet_length("xml")) + breaks).alias("artifact_bytes"),
    )
