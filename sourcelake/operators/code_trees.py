"""Block trees of source files, from brackets and indentation.

A file's tokens are found by one regular expression, which reads over strings,
comments, names, numbers and operators.  Brackets, keywords, and in Python the first
token of each logical line become tree nodes or end them, so files of one shape
have one tree.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import zip_longest

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sourcelake.functions.rows import each
from sourcelake.functions.text import newlines
from sourcelake.operators.structure import (
    _JS_COMMENT,
    _JS_REGEX,
    _JS_TEMPLATE,
    _PY_TRIPLE,
    _STRING,
    _WORD,
    JS_FAMILY,
    detect_language,
)
from sourcelake.operators.trees import subtree_hash

# The keywords of the languages.
PY_KEYWORDS = (
    "and", "as", "assert", "async", "await", "break", "class", "continue", "def", "del", "elif", "else", "except",
    "finally", "for", "from", "global", "if", "import", "in", "is", "lambda", "nonlocal", "not", "or", "pass",
    "raise", "return", "try", "while", "with", "yield",
)
JS_KEYWORDS = (
    "async", "await", "break", "case", "catch", "class", "const", "continue", "debugger", "default", "delete", "do",
    "else", "enum", "export", "extends", "finally", "for", "function", "if", "implements", "import", "in",
    "instanceof", "interface", "let", "new", "of", "return", "static", "super", "switch", "this", "throw", "try",
    "type", "typeof", "var", "void", "while", "with", "yield",
)
OPENS, CLOSES = ("(", "[", "{"), (")", "]", "}")
ROOT, LINE = "module", "line"
_STEP = dict.fromkeys(OPENS, 1) | dict.fromkeys(CLOSES, -1)


def _other_word(keywords) -> str:
    """A word that is none of the keywords, which are told apart by their first letter."""
    letters = sorted({k[0] for k in keywords})
    tried = "|".join(f"{x}(?:{'|'.join(k[1:] for k in keywords if k[0] == x)})" for x in letters)
    return rf"(?!(?:{tried})(?!{_WORD})){_WORD}++"


#: What is read over: other signs and words, strings, comments.  A line's token is its break and indentation, with
#: its first word if it starts with one; blank lines, and lines of a comment only, have none, nor has a break behind a backslash.
_PLAIN = r"[ .,:;=]++|[^\n\"'#`/\\()\[\]{}\w$\x{80}-\x{10FFFF}]"
_PY_OVER = (
    rf"{_PLAIN}|{_other_word(PY_KEYWORDS)}|(?=[\"'#\\\n/`])(?:{_PY_TRIPLE}|{_STRING}|#[^\n]*+|\\\n|\n(?![ \t]*+[^\s#])|[\\/`])"
)
_JS_OVER = rf"{_PLAIN}|{_other_word(JS_KEYWORDS)}|(?=[\"'#\\\n/`])(?:{_JS_COMMENT}|{_STRING}|{_JS_TEMPLATE}|{_JS_REGEX}|[#\\\n/`])"
#: One match for each token that counts, with all before it; ``\G`` keeps a match from starting inside what was read over.
_PY_TOKEN = rf"\G(?:{_PY_OVER})*+(\n[ \t]*+(?:{_WORD}++|(?=[^\s#]))|{_WORD}++|[()\[\]{{}}])"
_JS_TOKEN = rf"\G(?:{_JS_OVER})*+({_WORD}++|[()\[\]{{}}])"
_FAR = 1 << 40
#: Stands between tokens; none of them has it.
_BETWEEN = "\x01"
_NODE = T.StructType(
    [T.StructField(name, kind) for name, kind in (
        ("node_id", T.LongType()), ("parent_id", T.LongType()), ("child_ord", T.IntegerType()), ("visit_ord", T.LongType()), ("type", T.StringType())
    )]
)


def block_tokens(files: DataFrame) -> DataFrame:
    """``(tree_id, tokens)``: brackets, keywords and starts of Python's lines of each
    file in text order, as one string; files of other languages are left out."""
    language = detect_language(F.col("path"))
    text = newlines(F.coalesce("content", F.lit("")))
    found = F.when(language == "python", F.regexp_extract_all(F.concat(F.lit("\n"), text), F.lit(_PY_TOKEN), F.lit(1))).otherwise(
        F.regexp_extract_all(text, F.lit(_JS_TOKEN), F.lit(1))
    )
    return files.where(language != "unknown").select(F.struct("repo", "path").alias("tree_id"), F.array_join(found, _BETWEEN).alias("tokens"))


@lru_cache(1 << 16)
def _line(token: str) -> tuple[str, int]:
    """Type and width of a line by its token; a tab is as wide as eight blanks."""
    word = token.lstrip("\n\t ")
    return word if word in PY_KEYWORDS else LINE, len(token) - len(word) - 1 + 7 * token.count("\t")


def _place(copies: list[list[str]]) -> tuple[list[int], list[int | None], list[str], list[int]]:
    """Numbers, parents, types and ends of the nodes of one file; rows that share its
    tree have their tokens beside each other.  Ends order the visits.

    A line that starts inside brackets goes on with the one before, and brackets that
    close nothing count for nothing: depth is above the least so far.  The last bracket
    that opened one level up is a node's parent, the next that closes at its own level
    ends it; a line stands under the nearest one before that is indented less."""
    k = len(copies)
    numbers, parents, types, ends = [0] * k, [None] * k, [ROOT] * k, [4 * _FAR] * k
    n, running, least, line = 0, 0, 0, 0
    opened: dict[int, int] = {}
    unclosed: dict[int, list[int]] = {}
    around: list[tuple[int, int, int]] = []  # width, number and row of the lines that a line may stand under
    for peers in zip(copies[0], strict=True) if k == 1 else zip_longest(*copies, fillvalue=""):
        for token in peers:
            running += _STEP.get(token, 0)
        least = min(least, running)
        depth = running - least
        for token in peers:
            step = _STEP.get(token, 0)
            if not token:
                continue
            if step < 0:
                n += 1
                for row in unclosed.pop(depth, ()):
                    ends[row] = 2 * n
                continue
            kind = token
            if step > 0:
                n += 1
                parent = opened.get(depth - 2, line) if depth > 1 else line
                opened[depth - 1] = n
                unclosed.setdefault(depth - 1, []).append(len(ends))
                end = 2 * _FAR
            elif token[0] != "\n":
                n += 1
                parent, end = opened.get(depth - 1, line) if depth else line, 2 * n
            else:
                kind, width = _line(token)
                if depth and kind == LINE:
                    continue
                n += 1
                if depth:
                    parent, end = opened.get(depth - 1, line), 2 * n
                else:
                    while around and around[-1][0] >= width:
                        ends[around.pop()[2]] = 2 * n - 1
                    parent, end, line = around[-1][1] if around else 0, 2 * _FAR - 1, n
                    around.append((width, n, len(ends)))
            numbers.append(n)
            parents.append(parent)
            types.append(kind)
            ends.append(end)
    return numbers, parents, types, ends


def _place_one(tokens: list[str]) -> tuple[list[int], list[int | None], list[str], list[int]]:
    """:func:`_place` of a file that has its tree alone, in one pass over its tokens."""
    numbers, parents, types, ends = [0], [None], [ROOT], [4 * _FAR]
    n, running, least, line = 0, 0, 0, 0
    opened: dict[int, int] = {}
    unclosed: dict[int, int] = {}
    around: list[tuple[int, int, int]] = []
    for token in tokens:
        step = _STEP.get(token)
        if step is None:
            depth = running - least
            if token[0] != "\n":
                n += 1
                parent, end = opened.get(depth - 1, line) if depth else line, 2 * n
            else:
                token, width = _line(token)
                if depth and token == LINE:
                    continue
                n += 1
                if depth:
                    parent, end = opened.get(depth - 1, line), 2 * n
                else:
                    while around and around[-1][0] >= width:
                        ends[around.pop()[2]] = 2 * n - 1
                    parent, end, line = around[-1][1] if around else 0, 2 * _FAR - 1, n
                    around.append((width, n, len(ends)))
        else:
            n += 1
            running += step
            if step < 0:
                least = min(least, running)
                if (row := unclosed.pop(running - least, None)) is not None:
                    ends[row] = 2 * n
                continue
            depth = running - least
            parent, end = opened.get(depth - 2, line) if depth > 1 else line, 2 * _FAR
            opened[depth - 1] = n
            unclosed[depth - 1] = len(ends)
        numbers.append(n)
        parents.append(parent)
        types.append(token)
        ends.append(end)
    return numbers, parents, types, ends


def _ranks(rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Rank from 1 of each row among those of its group: ``rows`` in order, ``starts`` marks the first of a group there."""
    places = np.arange(len(rows))
    ranks = np.empty(len(rows), np.int64)
    ranks[rows] = places - np.maximum.accumulate(np.where(starts, places, 0)) + 1
    return ranks


@F.arrow_udf(T.ArrayType(_NODE))
def _placed(trees: pa.Array) -> pa.Array:
    """Nodes of each file from the tokens of its rows."""
    numbers, parents, types, ends, sizes = [], [], [], [], [0]
    for rows in trees.to_pylist():
        copies = [row.split(_BETWEEN) if row else [] for row in rows]
        found = _place_one(copies[0]) if len(copies) == 1 else _place(copies)
        for column, values in zip((numbers, parents, types, ends), found, strict=True):
            column.extend(values)
        sizes.append(len(found[0]))
    offsets = np.cumsum(sizes)
    tree = np.repeat(np.arange(len(sizes) - 1), sizes[1:])
    n, end, parent = np.array(numbers, np.int64), np.array(ends, np.int64), np.array([-1 if x is None else x for x in parents], np.int64)
    # Numbers ascend within a tree, and both sorts are stable.
    siblings, visits = np.argsort(tree * (n.max(initial=0) + 2) + parent, kind="stable"), np.lexsort((-end, tree))
    new_tree = np.diff(tree[visits], prepend=-1) != 0
    new_parent = (np.diff(tree[siblings], prepend=-1) != 0) | (np.diff(parent[siblings], prepend=-2) != 0)
    columns = [pa.array(n), pa.array(parents, pa.int64()), pa.array(_ranks(siblings, new_parent).astype(np.int32)), pa.array(_ranks(visits, new_tree)), pa.array(types, pa.string())]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(columns, ["node_id", "parent_id", "child_ord", "visit_ord", "type"]))


def code_tree_nodes(files: DataFrame) -> DataFrame:
    """Files ``(repo, path, content)`` to ``(tree_id, node_id, parent_id, child_ord,
    visit_ord, type)``; ``tree_id`` is the struct of repository and path.

    Node 0 is the file.  Brackets hold what stands between them; a keyword is a
    leaf; a logical line of Python, typed by its first word if that is a keyword,
    holds its brackets and keywords and the lines indented more.  Brackets that are
    never closed hold all that follows.  Files of other languages are left out.
    All rows of a tree are bounded by its file: one exchange by ``tree_id`` brings
    the rows together that share one, and serves the hashes after.  ``visit_ord``
    numbers nodes in last-child-first pre-order."""
    grouped = block_tokens(files).groupBy("tree_id").agg(F.collect_list("tokens").alias("rows"))
    placed = grouped.select("tree_id", _placed("rows").alias("nodes"))
    return each(placed, ["tree_id"], F.col("nodes"), "node").select("tree_id", "node.*")


def tree_fingerprints(files: DataFrame, depth: int = 4, max_nodes: int | None = None) -> DataFrame:
    """``(repo, path, hashes)``: the distinct subtree hashes of each file's block
    tree, or of its first ``max_nodes`` visited nodes."""
    hashed = subtree_hash(code_tree_nodes(files), depth)
    seen = hashed if max_nodes is None else hashed.where(F.col("visit_ord") <= max_nodes)
    sets = seen.groupBy("tree_id").agg(F.collect_set(_hash_key(F.col("h"))).alias("hashes"))
    return sets.select("tree_id.repo", "tree_id.path", "hashes")


def _hash_key(h: Column) -> Column:
    return F.xxhash64(h)
