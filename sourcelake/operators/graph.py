"""Import resolution and the dependency graph.

A specifier names an ordered list of candidate paths.  Rather than explode
every import into its candidates and probe each one, the *files* side is keyed
by what could name it (``pkg/mod`` for ``pkg/mod.py`` and
``pkg/mod/__init__.py``), reduced to the best path per key, and imports join it
once.  The key side is unique, so a module that a third of all files import
skews only the import side, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourcelake.functions.paths import dirname, extension, normalize
from sourcelake.functions.rows import HASH, each, each_pos, hashed
from sourcelake.functions.text import strip
from sourcelake.operators.structure import JS_FAMILY

SCRIPT_SUFFIXES = (".ts", ".tsx", ".js", ".jsx")  # candidate order; fixed value
SCRIPT_TAILS = (*SCRIPT_SUFFIXES, *("/index" + s for s in SCRIPT_SUFFIXES))
MODULE_TAILS = (".py", "/__init__.py")


# How a statement names its target.
FROM_IMPORT = r"^from\s+(.+?)\s+import"
PLAIN_IMPORT = r"^import\s+(\S+)"
ESM_SPECIFIER = r"""^\s*(?:import|export)\s+(?:.+?\s+from\s+)?['"]([^'"]+)['"]\s*;?\s*$"""
REQUIRE_SPECIFIER = r"""\brequire\s*\(\s*['"]([^'"]+)['"]\s*\)"""


def _filled(text: Column) -> Column:
    """NULL for an empty text, which is computed twice: for columns and what is cheap."""
    return F.nullif(text, F.lit(""))


def _first(text: Column, pattern: str) -> Column:
    """What the pattern's group holds where it matches first, NULL without a match; searched once."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.lit(1))


def module_name(statement: Column) -> Column:
    """Module a Python import statement names, NULL if none.

    ``import a, b`` gives ``a,``, which names no file."""
    text = strip(statement)
    return F.when(F.startswith(text, F.lit("from")), _first(text, FROM_IMPORT)).otherwise(_first(text, PLAIN_IMPORT))


def _said_specifier(text: Column) -> Column:
    return F.btrim(
        F.when(F.startswith(text, F.lit("require:")), F.substring(text, len("require:") + 1, 1 << 30))
        .otherwise(F.coalesce(_first(text, ESM_SPECIFIER), _first(text, REQUIRE_SPECIFIER)))
    )


def script_specifier(statement: Column) -> Column:
    """Specifier of a JavaScript/TypeScript import entry, NULL if none.

    A brace list broken over lines yields none."""
    return _filled(_said_specifier(strip(statement)))


def _located(imports: DataFrame) -> DataFrame:
    """Adds ``_name`` (Python module), ``_target`` (folded path of a relative
    script specifier) and ``_exact`` (the target already has a suffix).

    One projection per step: each value is computed once per row."""
    python, script = F.col("language") == "python", F.col("language").isin(*JS_FAMILY)
    named = imports.withColumns({
        "_name": F.when(python, module_name(F.col("import_text"))),
        "_said": F.when(script, _said_specifier(strip(F.col("import_text")))),
    }).withColumn("_spec", _filled(F.col("_said")))
    spec = F.col("_spec")
    relative = F.startswith(spec, F.lit("./")) | F.startswith(spec, F.lit("../"))
    parted = named.withColumns({
        "_dir": F.when(relative, dirname(F.col("path"))),
        "_ups": (F.length(F.regexp_extract(spec, r"^(?:\./)?((?:\.\./)*)", 1)) / 3).cast("int"),
        "_rest": F.regexp_extract(spec, r"^(?:\./)?(?:\.\./)*(.*)$", 1),
    })
    # Usual case: ups first, then plain segments, staying inside the repository.
    folder = F.col("_dir")
    slashes = F.length(folder) - F.length(F.replace(folder, F.lit("/"), F.lit("")))
    placed = parted.withColumn("_above", F.when(folder == "", F.lit(0)).otherwise(slashes + 1) - F.col("_ups"))
    plain = (F.col("_above") >= 0) & ~F.col("_rest").rlike(r"(?:^|/)\.{0,2}(?:/|$)")
    above = F.call_function("substring_index", folder, F.lit("/"), F.col("_above"))
    folded = placed.withColumn(
        "_target",
        F.when(folder.isNotNull(), F.when(plain, F.concat_ws("/", _filled(above), F.col("_rest"))).otherwise(
            normalize(F.concat_ws("/", _filled(folder), spec))
        )),
    )
    return folded.withColumn("_exact", extension(F.col("_target")) != "").drop("_said", "_spec", "_dir", "_ups", "_rest", "_above")


def import_candidates(imports: DataFrame) -> DataFrame:
    """``(repo, path, pos, import_text, language)`` -> one row per candidate path,
    in the order they are tried (``ord``)."""
    dotted, target = F.replace("_name", F.lit("."), F.lit("/")), F.col("_target")
    endings = F.array(*map(F.lit, SCRIPT_TAILS))
    candidates = (
        F.when(F.col("_name").isNotNull(), F.array(F.concat(dotted, F.lit(".py")), F.concat(dotted, F.lit("/__init__.py"))))
        .when(F.col("_exact"), F.array(target))
        .when(target.isNotNull(), F.transform(endings, lambda e: F.concat(target, e)))
    )
    return each_pos(_located(imports), ["repo", "path", "pos", "import_text"], candidates, "ord", "candidate")


def import_rows(structures: DataFrame, keep_empty: bool = False) -> DataFrame:
    """``(repo, path, language, pos, import_text)``, one row per import."""
    rows = structures.select("repo", "path", "language", F.posexplode_outer("imports").alias("pos", "import_text"))
    return rows if keep_empty else rows.where(F.col("pos").isNotNull())


def module_keys(files: DataFrame, source_roots=()) -> DataFrame:
    """``(repo, kind, key, target)``: the best file for each name a file answers to.

    ``source_roots`` (``["src"]``) lets Python modules also be named from below
    those directories; names from the repository root win."""
    path = F.col("path")
    entry = lambda kind, key, rank: F.struct(
        F.lit(kind).alias("kind"), key.alias("key"), F.lit(rank).alias("ord")
    )
    no_entry = F.lit(None).cast("struct<kind:string,key:string,ord:int>")
    options = [entry("file", path, 0)]
    roots = ["", *(r.strip("/") + "/" for r in source_roots)]
    for i, root in enumerate(roots):
        inside = F.startswith(path, F.lit(root))
        rest = path.substr(F.lit(len(root) + 1), F.length(path))
        for rank, tail in enumerate(MODULE_TAILS):
            name = rest.substr(F.lit(1), F.length(rest) - len(tail))
            options.append(
                F.when(inside & F.endswith(rest, F.lit(tail)), entry("py", name, 2 * i + rank)).otherwise(no_entry)
            )
    stem_entry, index_entry = no_entry, no_entry
    for i, suffix in enumerate(SCRIPT_SUFFIXES):
        cut = lambda tail: path.substr(F.lit(1), F.length(path) - len(tail))
        stem_entry = F.when(F.endswith(path, F.lit(suffix)), entry("script", cut(suffix), i)).otherwise(stem_entry)
        tail = "/index" + suffix
        index_entry = F.when(
            F.endswith(path, F.lit(tail)), entry("script", cut(tail), i + len(SCRIPT_SUFFIXES))
        ).otherwise(index_entry)
    options += [stem_entry, index_entry]
    # The path follows from the name and its rank, so groups hold a number each and are hashed, not sorted.
    best = (
        each(files, ["repo", "path"], F.array(*options), "e")
        .groupBy("repo", F.col("e.kind").alias("kind"), F.col("e.key").alias("key"))
        .agg(F.min("e.ord").alias("ord"))
    )
    nth = lambda items: F.element_at(F.array(*map(F.lit, items)), F.col("ord") + 1)
    modules = [(r, tail) for r in roots for tail in MODULE_TAILS]
    target = (
        F.when(F.col("kind") == "file", F.col("key"))
        .when(F.col("kind") == "py", F.concat(nth([r for r, _ in modules]), "key", nth([tail for _, tail in modules])))
        .otherwise(F.concat("key", nth(SCRIPT_TAILS)))
    )
    return best.select("repo", "kind", "key", target.alias("target"))


def import_keys(imports: DataFrame, resolve_relative: bool = False) -> DataFrame:
    """Adds ``(kind, key)``: the name under which an import looks for its file.

    Imports that cannot name a file of the repository get a kind of their own
    and a key that spreads them, so they do not gather in one partition."""
    name = F.col("_name")
    key = F.replace(name, F.lit("."), F.lit("/"))
    if resolve_relative:
        dots = F.length(F.regexp_extract(name, r"^\.+", 0))
        rest = F.replace(F.ltrim(name, F.lit(".")), F.lit("."), F.lit("/"))
        parent = F.split(dirname(F.col("path")), "/")
        base = F.array_join(F.slice(parent, F.lit(1), F.greatest(F.size(parent) - dots + 1, F.lit(0))), "/")
        # more dots than directories lead out of the repository
        inside = (dots - 1 <= F.size(parent)) & ((dots == 1) | (dirname(F.col("path")) != ""))
        key = F.when(dots == 0, key).when(inside, F.concat_ws("/", _filled(base), _filled(rest))).otherwise(key)
    # Never NULL, and known to be: a join adds no test of it that would be pushed
    # below these projections and repeat them.
    return _located(imports).select(
        *imports.columns,
        F.when(name.isNotNull(), F.lit("py"))
        .when(F.col("_exact"), F.lit("file"))
        .when(F.col("_target").isNotNull(), F.lit("script"))
        .otherwise(F.lit("none")).alias("kind"),
        F.coalesce(F.when(name.isNotNull(), key), F.col("_target"), F.col("path"), F.lit("")).alias("key"),
    )


def resolve_imports(
    structures: DataFrame,
    files: DataFrame | None = None,
    *,
    resolve_relative: bool = False,
    source_roots=(),
    keep_empty: bool = False,
) -> DataFrame:
    """``(repo, path, pos, import_text, dst)``; ``dst`` is NULL for externals.

    By default names resolve from the repository root only, so relative Python
    imports and ``src/`` layouts stay external."""
    imports = import_keys(import_rows(structures, keep_empty), resolve_relative)
    targets = module_keys((structures if files is None else files).select("repo", "path"), source_roots)
    keys = ["repo", "kind", "key"]
    return hashed(imports, keys).join(hashed(targets, keys), [HASH, *keys], "left").select(
        "repo", "path", "pos", "import_text", F.col("target").alias("dst")
    )


def dependency_edges(resolved: DataFrame) -> DataFrame:
    """One edge per resolved import occurrence: a bag."""
    return resolved.where(F.col("dst").isNotNull()).select("repo", F.col("path").alias("src"), "dst", "pos")


def external_imports(resolved: DataFrame) -> DataFrame:
    """Imports that resolve to no file of the repository, one row each."""
    return resolved.where(F.col("dst").isNull() & F.col("import_text").isNotNull()).select(
        "repo", "path", "pos", "import_text"
    )


def graph_nodes(structures: DataFrame) -> DataFrame:
    return structures.select("repo", "path")


def adjacency(resolved: DataFrame) -> DataFrame:
    """One row per node: sorted ``depends_on`` with repeats, and the external
    imports in text order.  Needs ``resolve_imports(..., keep_empty=True)`` so
    that files without imports keep their row.  A group is one file's imports,
    never more than that file's own text."""
    external = F.when(F.col("dst").isNull() & F.col("import_text").isNotNull(), F.struct("pos", "import_text"))
    return hashed(resolved, ["repo", "path"]).groupBy(HASH, "repo", "path").agg(
        F.array_sort(F.collect_list("dst")).alias("depends_on"),
        F.transform(F.array_sort(F.collect_list(external)), lambda e: e["import_text"]).alias("external_imports"),
    ).drop(HASH)


def leaf_nodes(graph: DataFrame) -> DataFrame:
    """Nodes of :func:`adjacency` without an outgoing edge."""
    return graph.where(F.size("depends_on") == 0).select("repo", "path")
