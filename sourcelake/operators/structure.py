"""Functions, classes, imports and types of source files, as one projection.

Languages are read by regular expression inside the JVM.  Text that is not
code is blanked first in one left-to-right pass: the pass consumes strings and
comments as tokens, so a quote inside a comment opens nothing and a ``#``
inside a string comments nothing out.  Every repeated group is possessive and
therefore iterative: a file of any size needs no regex stack.

Known limits: JavaScript functions count only as statements that start a line
or follow ``;``, ``{`` or ``}``; text inside ``${}`` of a template string is
not code here; ``require`` counts once per textual occurrence; of an export
statement the head is given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourcelake.functions.rows import each
from sourcelake.functions.text import strip
from sourcelake.operators.shingles import hashes, shape_tokens, shingles

EXTRACTOR_VERSION = "sourcelake-1"

LANGUAGES = {  # suffix -> language; fixed values
    ".py": "python",
    ".js": "javascript",
    ".jsx": "javascript",
    ".ts": "typescript",
    ".tsx": "tsx",
}
JS_FAMILY = ("javascript", "typescript", "tsx")
TYPED = ("typescript", "tsx")

_WORD = r"[\w$\x{80}-\x{10FFFF}]"
_STRING = r'''"(?:[^"\\\n]++|\\[\s\S])*+"?|'(?:[^'\\\n]++|\\[\s\S])*+'?'''

# --- Python -------------------------------------------------------------------

_PY_TRIPLE = (
    r'"""(?:[^"\\]++|\\[\s\S]|"(?!""))*+(?:"""|\z)'
    r"|'''(?:[^'\\]++|\\[\s\S]|'(?!''))*+(?:'''|\z)"
)
_PY_GAP = r"(?:[ \t]|\\\n)"
_PY_FROM = rf"from{_PY_GAP}++(?!__future__\b)[.\w\x{{80}}-\x{{10FFFF}}]++{_PY_GAP}++import\b"
_PY_PARENS = r"\((?:[^()#]++|#[^\n]*+)*+\)"
# Parenthesised imports keep their comments, as the statement's own text.
# The leading lookahead passes over ordinary characters in one step each.
_PY_BLANK = rf"""(?=["'#f])(?:{_PY_TRIPLE}|{_STRING}|#[^\n]*+|((?<![\w.]){_PY_FROM}{_PY_GAP}*+{_PY_PARENS}))"""
_PY_IMPORT = (
    rf"(?m)(?=[ \t;:fi])(?:^|[;:])[ \t]*+((?:{_PY_FROM}(?:{_PY_GAP}*+{_PY_PARENS}|(?:[^\n;#(\\]++|\\\n)++))"
    rf"|(?:import{_PY_GAP}++(?:[^\n;#\\]++|\\\n)++))"
)
_PY_DECLARATION = rf"(?m)^[ \t]*+(?:(?:async{_PY_GAP}++)?def|class){_PY_GAP}++{_WORD}++"

# --- JavaScript and TypeScript --------------------------------------------------

_JS_COMMENT = r"/\*(?:[^*]++|\*(?!/))*+(?:\*/|\z)|//[^\n]*+"
_JS_TEMPLATE = r"`(?:[^`\\]++|\\[\s\S])*+`"
_JS_REGEX = r"(?<=[=(,:!&|?{};\[][ \t]{0,4})/(?![*/])(?:[^/\\\[\n]++|\\.|\[(?:[^\]\\\n]++|\\.)*+\])++/"
_JS_IMPORT = (
    rf"import\b(?!\s*+[(.])(?:[\w$\s{{}},*\x{{80}}-\x{{10FFFF}}]++|{_JS_COMMENT})*+"
    rf"(?:=\s*+require\s*+\(\s*+)?(?:\"[^\"\n]*+\"|'[^'\n]*+')(?:\s*+\))?"
    rf"(?:[ \t]*+(?:with|assert)[ \t]*+\{{[^{{}}]*+\}})?[ \t]*+;?"
)
_JS_REQUIRE = r"""\brequire\s*\(\s*['"][^'"]+['"]\s*\)"""
# Import statements keep their comments; other comments go, strings stay
# because they hold the specifiers.
_JS_BLANK = (
    rf"""(?=[/"'`i])(?:({_STRING})|{_JS_COMMENT}|{_JS_TEMPLATE}|{_JS_REGEX}|((?<![\w$.]){_JS_IMPORT}))"""
)
_JS_IMPORTS = rf"(?m)(?=[ \t;ir])(?:(?:^|;)[ \t]*+({_JS_IMPORT})|({_JS_REQUIRE}))"
_JS_START = r"(?m)(?:^|[;{}])[ \t]*+(?:@[\w.$]++(?:\([^()\n]*+\))?[ \t]++)*+(?:export[ \t]++)?(?:default[ \t]++)?"
_JS_PARENS = r"\((?:[^()]++|\((?:[^()]++|\((?:[^()]++|\([^()]*+\))*+\))*+\))*+\)"
# An overload signature, which ends at ";" behind its parameters, is no function; a type alias needs its "=".
_JS_DECLARATION = (
    rf"{_JS_START}(?:"
    rf"(?:async[ \t]++)?function\s*+\*?\s*+{_WORD}++(?!\s*+(?:<[^(]*>\s*+)?{_JS_PARENS}[^;{{]*+(?:;|\z))"
    rf"|(?:declare[ \t]++)?(?:class|interface|(?:const[ \t]++)?enum)[ \t]++{_WORD}++"
    rf"|(?:declare[ \t]++)?type[ \t]++{_WORD}++(?=\s*+(?:<[^=;]*+)?=))"
)


# The head of an export statement: a list or star with its ``from`` clause, or what is left of the line.
_JS_EXPORT = (
    rf"export\b(?:\s*+(?:type\b\s*+)?(?:\*(?:\s*+as\s++{_WORD}++)?+|\{{[^{{}}]*+\}})(?:\s*+from\s*+(?:\"[^\"\n]*+\"|'[^'\n]*+'))?+;?+|[^\n]*+)"
)
_JS_EXPORTS = rf"""(?m)(?=[/"'` \te])(?:{_JS_COMMENT}|{_STRING}|{_JS_TEMPLATE}|^[ \t]*+({_JS_EXPORT}))"""


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _none() -> Column:
    return F.array().cast("array<string>")


def detect_language(path: Column) -> Column:
    """Language by lower-cased suffix, ``unknown`` otherwise.

    Filters on it are judged again on every side of a join below, so it is
    made of plain string functions and one look-up."""
    suffix = F.substring_index(path, ".", -1)
    before = F.rtrim(path.substr(F.lit(1), F.length(path) - F.length(suffix) - 1), F.lit("."))
    named = (before != "") & ~F.endswith(before, F.lit("/"))  # a name of dots and suffix only has no suffix
    known = F.create_map(*[F.lit(x) for end, language in LANGUAGES.items() for x in (end[1:], language)])
    return F.coalesce(F.when(named, F.try_element_at(known, F.lower(suffix))), F.lit("unknown"))


def python_code(content: Column) -> Column:
    """Python text without strings and comments."""
    return F.regexp_replace(content, _PY_BLANK, "$1")


def script_code(content: Column) -> Column:
    """JavaScript/TypeScript text without comments, templates and regex literals."""
    return F.regexp_replace(content, _JS_BLANK, "$1$2")


def python_declarations(code: Column) -> Column:
    """Heads of all functions and classes, in text order."""
    return _all(code, _PY_DECLARATION, 0)


def script_declarations(code: Column) -> Column:
    """Heads of all functions, classes, interfaces, types and enums."""
    return _all(F.regexp_replace(code, _STRING, '""'), _JS_DECLARATION, 0)


def declared(heads: Column, keyword: str) -> Column:
    """Names among declaration heads that ``keyword`` introduces."""
    some = F.filter(heads, lambda h: F.contains(h, F.lit(keyword)))  # most heads are of other kinds: no pattern for them
    names = F.transform(some, lambda h: F.regexp_extract(h, rf"\b{keyword}\b[\s*\\]*+({_WORD}++)$", 1))
    return F.filter(names, lambda n: n != "")


def python_imports(code: Column) -> Column:
    return F.transform(_all(code, _PY_IMPORT), strip)


def script_imports(code: Column) -> Column:
    """Import statements and ``require:<specifier>`` entries in text order."""
    return F.transform(
        _all(code, _JS_IMPORTS, 0),
        lambda x: F.when(
            F.startswith(x, F.lit("require")),
            F.concat(F.lit("require:"), F.regexp_extract(x, r"""['"]([^'"]+)['"]""", 1)),
        ).otherwise(strip(F.ltrim(x, F.lit(";")))),
    )


def script_exports(content: Column) -> Column:
    """Heads of export statements, taken from the unblanked text."""
    return F.transform(F.filter(_all(content, _JS_EXPORTS), lambda x: x != ""), strip)


def split_languages(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(readable, rejected)``: files of an unknown language, or whose text
    could not be decoded, are set aside and do not fail the run."""
    tagged = files.withColumn("language", detect_language(F.col("path")))
    known = (F.col("language") != "unknown") & F.col("content").isNotNull()
    return tagged.where(known), tagged.where(~known)


def extract_structure(files: DataFrame, shingle: int | None = None, keep_content: bool = False) -> DataFrame:
    """One row per readable file with its structure; ``content`` is dropped
    unless it is to be kept.

    Arrays that only scripts have are NULL for Python.  With ``shingle`` the
    file's shape fingerprint comes along as ``hashes``, from the same scan."""
    readable, _ = split_languages(files)
    content, code, heads = F.col("content"), F.col("code"), F.col("heads")
    python, typed = F.col("language") == "python", F.col("language").isin(*TYPED)
    # One projection per stage: text is blanked once, declarations found once.
    coded = readable.withColumn("code", F.when(python, python_code(content)).otherwise(script_code(content)))
    coded = coded.withColumn(
        "heads", F.when(python, python_declarations(code)).otherwise(script_declarations(code))
    )

    extra = [content] if keep_content else []
    if shingle:
        coded = coded.withColumn("tokens", shape_tokens(content))
        extra.append(hashes(shingles(F.col("tokens"), shingle)).alias("hashes"))

    def script_only(value: Column, when: Column = ~python) -> Column:
        return F.when(when, value).when(~python, _none())

    return coded.select(
        "repo",
        "path",
        "mtime",
        F.length("content").cast("bigint").alias("n_chars"),
        "language",
        F.lit(EXTRACTOR_VERSION).alias("extractor_version"),
        F.when(python, declared(heads, "def")).otherwise(declared(heads, "function")).alias("functions"),
        declared(heads, "class").alias("classes"),
        F.when(python, python_imports(code)).otherwise(script_imports(code)).alias("imports"),
        script_only(script_exports(content)).alias("exports"),
        script_only(declared(heads, "interface"), typed).alias("interfaces"),
        script_only(declared(heads, "type"), typed).alias("types"),
        script_only(declared(heads, "enum"), typed).alias("enums"),
        *extra,
    )


SYMBOL_KINDS = ("functions", "classes", "imports", "exports", "interfaces", "types", "enums")


def symbols(structures: DataFrame, kinds=SYMBOL_KINDS) -> DataFrame:
    """Long form ``(repo, path, kind, pos, name)``; one pass, no shuffle."""
    none = F.array().cast("array<struct<kind:string,pos:int,name:string>>")

    def tagged(kind: str) -> Column:
        named = F.transform(
            F.col(kind),
            lambda name, pos: F.struct(F.lit(kind).alias("kind"), pos.alias("pos"), name.alias("name")),
        )
        return F.coalesce(named, none)

    every = F.concat(*[tagged(kind) for kind in kinds])
    return each(structures, ["repo", "path"], every, "s").select("repo", "path", "s.*")
