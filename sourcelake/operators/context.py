"""Readable context of a repository, and question prompts built on it.

The context is a table of lines, at every size; prompts refer to it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourcelake.functions.text import tokens_of_length
from sourcelake.operators.ordinals import ordinals

# The context format.
TITLE = "## Codebase Context"
ARCHITECTURE = "### Architecture"
SUMMARIES = "### Module Summaries"
NO_SUMMARY = "(no summary)"
SEPARATOR = "\n\n---\n\n"


def context_lines(graph: DataFrame, summaries: DataFrame, title: str = TITLE) -> DataFrame:
    """``(repo, section, name, line)``; order by section and name.

    ``graph`` comes from ``adjacency``; a missing or empty summary reads
    ``(no summary)``."""
    totals = graph.groupBy("repo").agg(F.count("*").alias("files"), F.sum(F.size("depends_on")).alias("edges"))
    counts = F.concat(
        F.lit("Files: "), F.col("files").cast("string"), F.lit(" | Dependencies: "), F.col("edges").cast("string")
    )
    fixed = [
        F.lit(title), F.concat(F.lit("Repository: "), F.col("repo")), counts, F.lit(""), F.lit(ARCHITECTURE),
        None, F.lit(""), F.lit(SUMMARIES),
    ]
    frame = totals.select("repo", F.explode(F.array(*[
        F.struct(F.lit(i).alias("section"), text.alias("line")) for i, text in enumerate(fixed) if text is not None
    ])).alias("f")).select("repo", "f.section", F.lit("").alias("name"), "f.line")
    node = F.when(F.size("depends_on") == 0, F.concat(F.lit("  "), "path", F.lit(" (leaf)"))).otherwise(
        F.concat(F.lit("  "), "path", F.lit(" -> "), F.array_join("depends_on", ", "))
    )
    nodes = graph.select("repo", F.lit(5).alias("section"), F.col("path").alias("name"), node.alias("line"))
    text = F.coalesce(F.nullif("summary", F.lit("")), F.lit(NO_SUMMARY))
    modules = graph.select("repo", "path").join(summaries.select("repo", "path", "summary"), ["repo", "path"], "left")
    modules = modules.select(
        "repo", F.lit(len(fixed)).alias("section"), F.col("path").alias("name"),
        F.concat("path", F.lit(": "), text).alias("line"),
    )
    return frame.unionByName(nodes).unionByName(modules)


def context_block(lines: DataFrame) -> DataFrame:
    """``(repo, no, line)``: a repository's context is its lines in order of
    ``no``, from 1, joined by newlines.

    No repository's lines meet in one task, so the shape is the same for every
    size."""
    return ordinals(lines, ["repo"], ["section", "name"], "no").select("repo", "no", "line")


def context_lengths(lines: DataFrame) -> DataFrame:
    """``(repo, chars)``: the length of each context."""
    return lines.groupBy("repo").agg((F.sum(F.length("line")) + F.count("*") - 1).alias("chars"))


def context_tokens(lines: DataFrame) -> DataFrame:
    """Tokens of each context, from line lengths."""
    return context_lengths(lines).select("repo", tokens_of_length(F.col("chars")).alias("context_tokens"))


def prompt_pairs(lines: DataFrame, questions: DataFrame) -> DataFrame:
    """``(repo, id, q_no, question, baseline_prompt, context_suffix,
    context_tokens, prompt_tokens)`` for each question of a repository that has
    a context.

    The prompt with context is the repository's :func:`context_block` followed
    by ``context_suffix``: the context is referred to by ``repo`` and not
    repeated for every question.  ``prompt_tokens`` counts the whole."""
    totals = context_lengths(lines)
    suffix = F.concat(F.lit(SEPARATOR), "question")
    return questions.join(totals, "repo").select(
        "repo",
        F.concat("repo", F.lit("_q"), F.col("q_no").cast("string")).alias("id"),
        "q_no",
        "question",
        F.col("question").alias("baseline_prompt"),
        suffix.alias("context_suffix"),
        tokens_of_length(F.col("chars")).alias("context_tokens"),
        tokens_of_length(F.col("chars") + F.length(suffix)).alias("prompt_tokens"),
    )


def avg_context_tokens(lines: DataFrame, questions: DataFrame) -> DataFrame:
    """Context tokens added per question, 0 without questions."""
    asked = questions.select("repo").join(context_tokens(lines), "repo")
    return asked.agg(
        F.count("*").alias("questions"), F.coalesce(F.avg("context_tokens"), F.lit(0.0)).alias("avg_context_tokens")
    )
