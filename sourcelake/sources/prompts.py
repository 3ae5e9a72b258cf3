"""Prompts as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_prompts(context: DataFrame, prompts: DataFrame, path: str) -> None:
    """Write ``path/context``, a record per context line, and ``path/questions``,
    a record per question: the prompt with context is the repository's lines
    in order, joined by newlines, and the question's ``context_suffix``."""
    context.select("repo", "no", "line").write.json(f"{path}/context")
    prompts.write.json(f"{path}/questions")
