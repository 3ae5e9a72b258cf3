"""Template summaries of files and their cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourcelake.functions.paths import stem
from sourcelake.functions.rows import HASH, hashed
from sourcelake.functions.text import quoted_list, strip

# Summary sentences and prompt wording.
SPECIAL_SUMMARIES = {
    "config": "Configuration module that defines DATABASE_URL, DEBUG, SECRET_KEY, and LOG_LEVEL constants.",
    "database": "Database connection and session management. Provides get_connection and close_connection.",
    "utils": "Utility functions for logging and response formatting.",
    "main": "Application entry point. Orchestrates startup, loads User via models, formats output via utils.",
}
MODELS_SUMMARY = ("Data models. Defines ", " and fetch_user for DB access.")
LEAF_SENTENCE = "Leaf dependency with no internal imports."
PROMPT_HEAD = "Summarize this Python module for a codebase overview artifact.\n\nFile: "
PROMPT_STRUCTURE = ("\n\nStructure:\nClasses: ", "\nFunctions: ", "\nImports: ")
PROMPT_SOURCE = "\n\nSource code:\n```python\n"
PROMPT_TAIL = """
```

Instructions:
- Describe what this module does in 2-3 sentences max.
- List the key responsibilities.
- Note any important side effects, global state, or external dependencies.
- Keep the summary under 150 tokens.
- Focus on architectural role, not implementation details.

Summary:"""


def summary_prompt(structures: DataFrame) -> DataFrame:
    """``(repo, path, prompt)``: the request a summarising model would get.

    ``structures`` carries ``content``, so each text is read once and stays
    where it is."""
    head, (classes, functions, imports) = F.lit(PROMPT_HEAD), map(F.lit, PROMPT_STRUCTURE)
    return structures.select(
        "repo", "path",
        F.concat(
            head, "path",
            classes, quoted_list(F.col("classes")),
            functions, quoted_list(F.col("functions")),
            imports, quoted_list(F.col("imports")),
            F.lit(PROMPT_SOURCE), "content", F.lit(PROMPT_TAIL),
        ).alias("prompt"),
    )


def _short(name: Column) -> Column:
    last = F.substring_index(name, "/", -1)
    return F.replace(F.replace(last, F.lit(".js"), F.lit("")), F.lit(".ts"), F.lit(""))


def dependency_mentions(imports: Column, most: int | None = None) -> Column:
    """Short names of the imports that have one, or of the first ``most`` of them.

    A Python ``from x import y`` has none; quotes are trimmed from the ends
    only, so a JavaScript statement keeps its ``";``."""

    def mention(text: Column) -> Column:
        unquote = lambda s: F.btrim(s, F.lit("'\""))
        after_from = strip(F.regexp_extract(text, r"(?s)^.*? from (.*)$", 1))
        word = F.regexp_extract(text, r"^import\s+(\S+)", 1)
        return (
            F.when(F.startswith(text, F.lit("require:")), _short(F.substring(text, len("require:") + 1, 1 << 30)))
            .when(F.contains(text, F.lit(" from ")), _short(unquote(after_from)))
            .when(F.startswith(text, F.lit("import ")), _short(unquote(word)))
        )

    entries = F.transform(imports if most is None else F.slice(imports, 1, most), strip)  # by itself: once an entry
    return F.filter(F.transform(entries, mention), lambda m: m.isNotNull() & (m != ""))


def template_summary(path: Column, classes: Column, functions: Column, imports: Column) -> Column:
    """A sentence about the module, then what it depends on."""
    name = stem(path)
    opening = F.concat(
        F.lit("Module "), name, F.lit(" with "), F.size(functions).cast("string"), F.lit(" functions, "),
        F.size(classes).cast("string"), F.lit(" classes."),
    )
    before, after = MODELS_SUMMARY
    first_class = F.coalesce(F.try_element_at(classes, F.lit(1)), F.lit("entities"))
    opening = F.when(name == "models", F.concat(F.lit(before), first_class, F.lit(after))).otherwise(opening)
    for special, sentence in SPECIAL_SUMMARIES.items():
        opening = F.when(name == special, F.lit(sentence)).otherwise(opening)
    mentions = dependency_mentions(imports)
    closing = F.when(F.size(imports) == 0, F.lit(LEAF_SENTENCE)).when(
        F.size(mentions) > 0, F.concat(F.lit("Depends on: "), F.array_join(mentions, ", "), F.lit("."))
    )
    return F.concat_ws(" ", opening, closing)


def cache_key(repo: Column, path: Column, mtime: Column, version: Column) -> Column:
    """``repo|path|seconds|extractor version``; a missing time counts as 0.

    The time is a version mark: the content itself is not part of the key."""
    seconds = F.coalesce(F.unix_seconds(mtime), F.lit(0)).cast("string")
    return F.concat_ws("|", repo, path, seconds, F.coalesce(version, F.lit("unknown")))


def _key() -> Column:
    return cache_key(F.col("repo"), F.col("path"), F.col("mtime"), F.col("extractor_version"))


def _template() -> Column:
    return template_summary(F.col("path"), F.col("classes"), F.col("functions"), F.col("imports"))


def summarize(structures: DataFrame) -> DataFrame:
    """``(repo, path, key, summary)`` computed for every file."""
    return structures.select("repo", "path", _key().alias("key"), _template().alias("summary"))


def cached_summaries(structures: DataFrame, cache: DataFrame) -> DataFrame:
    """Cached text where it is a non-empty string, else the computed one.

    A summary is computed above the join, for the rows that found none."""
    known = cache.where("summary <> ''").select("key", F.col("summary").alias("cached"))
    keyed = structures.select("repo", "path", "classes", "functions", "imports", _key().alias("key"))
    return hashed(keyed, ["key"]).join(hashed(known, ["key"]), [HASH, "key"], "left").select(
        "repo", "path", "key",
        F.when(F.col("cached").isNotNull(), F.col("cached")).otherwise(_template()).alias("summary"),
    )


def cache_misses(cache: DataFrame, structures: DataFrame) -> DataFrame:
    """``(key, summary)`` of files whose key the cache lacks or holds empty:
    what a run appends.  Nothing else is computed."""
    known = cache.where("summary <> ''").select("key")
    keyed = structures.select("path", "classes", "functions", "imports", _key().alias("key"))
    return hashed(keyed, ["key"]).join(hashed(known, ["key"]), [HASH, "key"], "left_anti").select("key", _template().alias("summary"))


def cache_entries(cache: DataFrame) -> DataFrame:
    """One entry per key of a cache that grows by appending: a filled one if
    there is one.  Entries of one key never differ otherwise."""
    entry = F.coalesce(F.max(F.nullif("summary", F.lit(""))), F.max("summary")).alias("summary")
    return hashed(cache, ["key"]).groupBy(HASH, "key").agg(entry).drop(HASH)


def inject_summaries(modules: DataFrame, summaries: DataFrame) -> DataFrame:
    """Replace a module's summary where one exists for its path."""
    new = summaries.select("repo", "path", F.col("summary").alias("_new"))
    keys = ["repo", "path"]
    return hashed(modules, keys).join(hashed(new, keys), [HASH, *keys], "left").withColumn(
        "summary", F.coalesce("_new", "summary")
    ).select(*modules.columns)
