"""Which files belong to a corpus."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sourcelake.functions.paths import ancestors, basename, dirname
from sourcelake.session import materialize

# The selection conventions every corpus is read with.
DEFAULT_EXTENSIONS = (".py", ".js", ".jsx", ".ts", ".tsx")
COUNTED_EXTENSIONS = (".py", ".js", ".ts")
BUILTIN_IGNORES = ("__pycache__", ".git", "*.pyc", ".env", "node_modules", "venv", ".venv")
TEST_DIRECTORIES = ("/test/", "/tests/", "/__tests__/", "/spec/")
LOCK_FILES = (
    "package-lock.json",
    "pnpm-lock.yaml",
    "yarn.lock",
    "poetry.lock",
    "Pipfile.lock",
    "Gemfile.lock",
)
UNCOUNTED_DIRECTORIES = ("__pycache__", ".git", "node_modules", "venv", ".venv", "dist", "build")


def parse_extensions(text: str) -> list[str]:
    """``".py, .js,"`` -> ``[".py", ".js"]``."""
    return [item.strip() for item in text.split(",") if item.strip()]


def _any(conditions: list[Column]) -> Column:
    return reduce(or_, conditions, F.lit(False))


def has_extension(path: Column, extensions) -> Column:
    return _any([F.endswith(basename(path), F.lit(e)) for e in extensions])


def filter_extension(files: DataFrame, extensions=(".py",)) -> DataFrame:
    """Keep paths ending in one of ``extensions``, case-sensitively."""
    return files.where(has_extension(F.col("path"), extensions))


def filter_tests(files: DataFrame, substrings=TEST_DIRECTORIES) -> DataFrame:
    """Drop files below a test directory; test-like file *names* stay."""
    lowered = F.lower(F.concat(F.lit("/"), F.ltrim(F.col("path"), F.lit("/"))))
    return files.where(~_any([F.contains(lowered, F.lit(s)) for s in substrings]))


def filter_filenames(files: DataFrame, names=LOCK_FILES) -> DataFrame:
    """Drop files whose name is exactly one of ``names``."""
    return files.where(~basename(F.col("path")).isin(*names))


# --- ignore rules -----------------------------------------------------------


def rule_regex(body: Column) -> Column:
    """Regex for one ignore pattern (without its ``!``).

    A pattern with a slash before its end is anchored at the root, others
    match at any depth; ``**`` spans directories; whatever a pattern matches,
    everything below matches too; a trailing slash asks for something below."""
    # Stand-ins for the multi-segment wildcards while single stars are handled.
    deep_start, deep_mid, deep_end, lone, any_char, one = "\x01", "\x02", "\x03", "\x04", "\x05", "\x06"
    anchored = body.rlike(r"^/|/.")
    below_only = F.endswith(body, F.lit("/"))
    core = F.regexp_replace(body, r"^/+|/+$", "")
    core = F.when(anchored | (core == "**"), core).otherwise(F.concat(F.lit("**/"), core))
    core = F.regexp_replace(core, r"^(?:\*\*/)+", deep_start)
    core = F.regexp_replace(core, r"/(?:\*\*/)+", deep_mid)
    core = F.regexp_replace(core, r"/\*\*$", deep_end)
    core = F.regexp_replace(core, r"^\*\*$", lone)
    core = F.regexp_replace(core, f"(?<=^|[/{deep_start}{deep_mid}])\\*+(?=$|[/{deep_mid}{deep_end}])", lone)
    core = F.regexp_replace(core, r"(?<!\\)\*+", any_char)
    core = F.regexp_replace(core, r"(?<!\\)\?", one)
    core = F.regexp_replace(core, r"(?<!\\)\[(?!.[^/]*\])", r"\\[")
    core = F.regexp_replace(core, r"(?<!\\)\[!", "[^")
    core = F.regexp_replace(core, r"(?<!\\)\[(\^?)\]", r"[$1\\]")
    core = F.regexp_replace(core, r"([.+$(){}|])", r"\\$1")
    core = F.regexp_replace(core, r"(?<!\[)\^", r"\\^")
    for mark, meaning in (
        (deep_start, "(?:.+/)?"),
        (deep_mid, "/(?:.+/)?"),
        (deep_end, "/.*"),
        (lone, "[^/]+"),
        (any_char, "[^/]*"),
        (one, "[^/]"),
    ):
        core = F.replace(core, F.lit(mark), F.lit(meaning))
    tail = (
        F.when(below_only, F.lit("/.*"))
        .when(F.endswith(body, F.lit("/**")), F.lit(""))
        .otherwise(F.lit("(?:/.*)?"))
    )
    return F.concat(F.lit("^"), core, tail, F.lit("$"))


def parse_ignore_rules(ignore_files: DataFrame) -> DataFrame:
    """``(repo, content)`` of root ignore files -> ``(repo, ord, regex, ignore)``.

    Lines are trimmed; blanks and ``#`` comments are skipped."""
    lines = ignore_files.select(
        "repo", F.posexplode(F.split("content", "\r\n?|\n")).alias("ord", "line")
    ).select("repo", "ord", F.btrim("line", F.lit(" \t\f\x0b")).alias("line"))
    lines = lines.where(
        (F.col("line") != "")
        & ~F.startswith(F.col("line"), F.lit("#"))
        & ~F.col("line").rlike(r"^!?/*$")  # names nothing
        & ~F.col("line").rlike(r"(?<!\\)(?:\\\\)*\\$")  # dangling escape
    )
    negated = F.startswith(F.col("line"), F.lit("!"))
    body = F.when(negated, F.expr("substring(line, 2)")).otherwise(F.col("line"))
    body = F.regexp_replace(body, r"^\\(?=[#!])", "")
    return lines.select("repo", "ord", rule_regex(body).alias("regex"), (~negated).alias("ignore"))


def root_ignore_rules(files: DataFrame) -> DataFrame:
    """Rules of every repository's root ``.gitignore``."""
    return parse_ignore_rules(files.where(F.col("path") == ".gitignore"))


def _builtin_pattern() -> str:
    """The built-in rules as one regex: they all ignore, so order is moot."""
    names = [n.replace(".", r"\.").replace("*", "[^/]*") for n in BUILTIN_IGNORES]
    return "^(?:.+/)?(?:" + "|".join(names) + ")(?:/.*)?$"


def _merged(rules: DataFrame) -> DataFrame:
    """``(repo, _rules)``: each repository's rules in order, neighbours of one
    sign as one pattern."""
    order = Window.partitionBy("repo").orderBy("ord")
    turn = F.coalesce((F.col("ignore") != F.lag("ignore").over(order)).cast("int"), F.lit(0))
    runs = rules.withColumn("_turn", turn).withColumn("_run", F.sum("_turn").over(order))
    merged = runs.groupBy("repo", "_run", "ignore").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("ord", "regex"))), lambda r: F.concat(F.lit("(?:"), r["regex"], F.lit(")"))
    ), "|").alias("regex"))
    return merged.groupBy("repo").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("_run", "regex", "ignore"))),
        lambda r: F.struct(r["regex"].alias("regex"), r["ignore"].alias("ignore")),
    ).alias("_rules"))


def filter_ignored(files: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Drop files the ignore rules exclude.

    For a path the last matching rule wins, built-ins first.  A file goes when
    it or any directory above it is ignored, so nothing is re-included below an
    ignored directory.  Directories are judged once each; a file is then tested
    by its own path, and dropped by an anti-join on its directory.  Rules and
    ignored directories are written first, so that Spark broadcasts them by
    their real size and leaves ``content`` where it is."""
    builtin = _builtin_pattern()
    if rules is None:
        hit = lambda p: p.rlike(builtin)
        return files.where(~(hit(F.col("path")) | F.exists(ancestors(F.col("path")), hit)))
    per_repo = materialize(_merged(rules), "ignore-rules")
    none = F.array().cast("array<struct<regex:string,ignore:boolean>>")

    def ignored(p: Column) -> Column:
        return F.aggregate(
            F.coalesce("_rules", none),
            p.rlike(builtin),
            lambda acc, r: F.when(F.rlike(p, r["regex"]), r["ignore"]).otherwise(acc),
        )

    directories = files.select("repo", dirname(F.col("path")).alias("_dir")).where("_dir <> ''").distinct()
    above = ancestors(F.concat("_dir", F.lit("/")))
    gone = directories.join(per_repo, "repo", "left").where(F.exists(above, ignored)).select("repo", "_dir")
    gone = materialize(gone, "ignored-directories")
    kept = files.join(per_repo, "repo", "left").where(~ignored(F.col("path"))).withColumn("_dir", dirname(F.col("path")))
    return kept.join(gone, ["repo", "_dir"], "left_anti").select(*files.columns)


def select_files(
    files: DataFrame,
    *,
    extensions=DEFAULT_EXTENSIONS,
    exclude_tests: bool = True,
    exclude_filenames=LOCK_FILES,
    rules: DataFrame | None = None,
) -> DataFrame:
    """All selection rules, cheapest first."""
    kept = filter_filenames(filter_extension(files, extensions), exclude_filenames)
    if exclude_tests:
        kept = filter_tests(kept)
    return filter_ignored(kept, rules)


def count_source_files(files: DataFrame) -> DataFrame:
    """Per repository: files with a counted suffix outside the skipped directories."""
    return (
        filter_extension(files, COUNTED_EXTENSIONS)
        .where(~F.exists(F.split(F.col("path"), "/"), lambda s: s.isin(*UNCOUNTED_DIRECTORIES)))
        .groupBy("repo")
        .agg(F.count("*").alias("source_files"))
    )
