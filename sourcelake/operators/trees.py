"""Typed trees: nodes from markup, subtree hashes, fingerprint sets.

A tree belongs to one document, so all rows of a ``tree_id`` are bounded by
that document; partitioning by ``tree_id`` is what every step here needs, and
one exchange serves them all.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sourcelake.functions.rows import each, each_pos

# Elements without content, which are never closed.
VOID_ELEMENTS = (
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr",
)
_NOT_MARKUP = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->"


def html_tree_nodes(pages: DataFrame, tree_id: str, html: str) -> DataFrame:
    """Markup -> ``(tree_id, node_id, parent_id, child_ord, visit_ord, type)``,
    with a node for every opening tag.

    Tags of one name open and close in turn at each level of their own nesting:
    an opening tag whose next one there is a closing tag is closed by it.  These
    pairs form an event stream with a running depth.  At one depth events
    alternate open/close, so a window over ``(tree, depth)`` finds each node's
    end; the same window with the events of the level above finds its parent.
    Of the other opening tags void elements are leaves; the rest hold all that
    follows in what they stand in and end with it.  ``visit_ord`` numbers nodes
    in last-child-first pre-order: descending position of their end."""
    text = F.regexp_replace(F.col(html), _NOT_MARKUP, "")
    tags_found = F.regexp_extract_all(text, F.lit("</?[A-Za-z][A-Za-z0-9]*+"), F.lit(0))
    events = each_pos(pages, [F.col(tree_id).cast("string").alias("tree_id")], tags_found, "pos", "tag")
    events = events.select(
        "tree_id", "pos", (~F.startswith(F.col("tag"), F.lit("</"))).alias("opens"),
        F.lower(F.regexp_replace("tag", "^</?", "")).alias("type"),
    )
    opens = F.col("opens")
    own_level = F.sum(F.when(opens, 1).otherwise(-1)).over(Window.partitionBy("tree_id", "type").orderBy("pos"))
    events = events.withColumn("nesting", own_level + F.when(opens, 0).otherwise(1))
    alike = Window.partitionBy("tree_id", "type", "nesting").orderBy("pos")
    filled = F.when(opens, ~F.lead("opens").over(alike)).otherwise(F.lag("opens").over(alike))
    events = events.withColumn("filled", F.coalesce(filled, F.lit(False))).where("opens or filled")
    order = Window.partitionBy("tree_id").orderBy("pos")
    inside = F.col("opens") & F.col("filled")
    running = F.sum(F.when(inside, 1).when(F.col("filled"), -1).otherwise(0)).over(order)
    events = events.withColumn("depth", running + F.when(inside, 0).otherwise(1))

    # Each opening tag that is closed is seen at its own depth (as a possible
    # parent) and one level up (as a child); other opening tags only as children,
    # closing tags only at their own depth.
    roles = F.when(inside, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.col("opens")))
    seen = events.select("tree_id", "pos", "type", "opens", "filled", "depth", F.explode(roles).alias("child")).withColumn(
        "level", F.col("depth") - F.col("child").cast("int")
    )
    own = ~F.col("child")
    level = Window.partitionBy("tree_id", "level").orderBy("pos", "child")
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    after = level.rowsBetween(1, Window.unboundedFollowing)
    unclosed = F.col("child") & ~F.col("filled") & ~F.col("type").isin(*VOID_ELEMENTS)
    placed = seen.select(
        "*",
        F.last(F.when(unclosed, F.col("pos")), ignorenulls=True).over(before).alias("held_by"),
        F.last(F.when(own & F.col("opens"), F.col("pos")), ignorenulls=True).over(before).alias("parent"),
        F.first(F.when(own & ~F.col("opens"), F.col("pos")), ignorenulls=True).over(after).alias("close"),
    ).where("opens")
    nodes = placed.groupBy("tree_id", F.col("pos").alias("node_id")).agg(
        F.first("type").alias("type"),
        F.first("depth").alias("depth"),
        F.first("filled").alias("filled"),
        F.max(F.when(F.col("child"), F.greatest("parent", "held_by"))).alias("parent_id"),
        F.max(F.when(own | ~F.col("filled"), F.col("close"))).alias("close"),
    )
    void = ~F.col("filled") & F.col("type").isin(*VOID_ELEMENTS)
    end = F.when(void, F.col("node_id").cast("bigint")).otherwise(F.coalesce(F.col("close").cast("bigint"), F.lit(1 << 40)))
    siblings = Window.partitionBy("tree_id", "parent_id").orderBy("node_id")
    return nodes.select(
        "tree_id",
        F.col("node_id").cast("bigint").alias("node_id"),
        F.col("parent_id").cast("bigint").alias("parent_id"),
        F.row_number().over(siblings).alias("child_ord"),
        F.row_number().over(Window.partitionBy("tree_id").orderBy(end.desc(), "node_id")).cast("bigint").alias("visit_ord"),
        "type",
    )


def _leaf_hash(kind: Column) -> Column:
    return F.sha1(kind)


#: Subtree shapes a task remembers before it lets go of them, which bounds its memory.
REMEMBERED = 1 << 16


def subtree_hash(nodes: DataFrame, depth: int = 4, colocate: bool = True) -> DataFrame:
    """Adds ``h``: SHA-1 of the typed tree shape down to ``depth`` levels.

    Level 0 hashes the type; level d hashes the type around its children's
    level d-1 hashes in order.  With ``colocate`` the nodes of a tree are brought
    together by ``tree_id`` once and hashed there, all levels in turn; without it
    rounds shuffle by node, for trees too large for one task."""
    if depth <= 0 or not colocate:
        return _hash_rounds(nodes, depth)
    fields = [f for f in nodes.schema.fields if f.name != "tree_id"]
    trees = nodes.groupBy("tree_id").agg(F.collect_list(F.struct(*[f.name for f in fields])).alias("nodes"))
    rows = each(trees.select("tree_id", _tree_hashes(depth, fields)("nodes").alias("nodes")), ["tree_id"], F.col("nodes"), "r")
    return rows.select("tree_id", *[F.col(f"r.node.`{f.name}`") for f in fields], F.col("r.h").alias("h"))


def _sha1(text: str | None) -> str | None:
    return None if text is None else hashlib.sha1(text.encode()).hexdigest()


def _values(column: pa.Array) -> list:
    return column.to_pylist() if column.null_count else column.to_numpy(zero_copy_only=False).tolist()


def _plain_hashes(offsets: np.ndarray, ids: pa.Array, parents: pa.Array, ords: pa.Array, types: pa.Array, depth: int) -> pa.Array | None:
    """Hashes of all nodes of the trees that lie between ``offsets``, a level at a time over all of them; None unless ids
    are numbers from 0 that are unique in their tree, and nothing that orders or names a node is NULL or tied.

    Hashes are known by codes here; a parent's type and its children's codes, as bytes, are looked up."""
    if not len(ids) or ids.null_count or ords.null_count or types.null_count or not all(pa.types.is_integer(x.type) for x in (ids, parents, ords)):
        return None
    own, up, order = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in (ids, parents.fill_null(-1), ords))
    size = int(own.max()) + 1
    if own.min() < 0 or size * len(offsets) >= 1 << 62:
        return None
    start = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)) * size
    key = start + own
    rows = np.argsort(key, kind="stable")
    key = key[rows]
    if (key[1:] == key[:-1]).any():
        return None
    at = np.minimum(np.searchsorted(key, start + up), len(key) - 1)
    child = np.flatnonzero((up >= 0) & (up < size) & (key[at] == start + up))
    above = rows[at[child]]
    by = np.lexsort((order[child], above))
    child, above = child[by], above[by]
    new = np.diff(above, prepend=-1) != 0
    if (~new[1:] & (order[child][1:] == order[child][:-1])).any():
        return None
    said = types.dictionary_encode()
    kind, names = said.indices.to_numpy(zero_copy_only=False).astype(np.int32), said.dictionary.to_pylist()
    texts = [_sha1(x) for x in names] + [_sha1(f"{x}()") for x in names]
    codes, bare = kind, kind + np.int32(len(names))
    begins = np.flatnonzero(new)
    heads = above[begins]
    # Each parent's type stands before its children's codes.
    laid = np.insert(np.zeros(len(child), np.int32), begins, kind[heads])
    spot = np.arange(len(child)) + np.cumsum(new)
    cuts = np.append(begins + np.arange(len(begins)), len(laid)) * 4
    found: dict[bytes, int] = {}
    moving = np.arange(len(heads))
    for level in range(depth):
        if level > 1:  # a hash moves at this level only if one below moved at the last
            moving = np.flatnonzero(np.logical_or.reduceat(moved[child], begins)) if len(begins) else moving
        laid[spot] = codes[child]
        line, known = laid.tobytes(), []
        for a, b in zip(cuts[moving].tolist(), cuts[moving + 1].tolist(), strict=True):
            code = found.get(shape := line[a:b])
            if code is None:
                head, *kids = np.frombuffer(shape, np.int32).tolist()
                code = found[shape] = len(texts)
                texts.append(_sha1(f"{names[head]}({','.join([texts[k] for k in kids])})"))
            known.append(code)
        after = codes.copy() if level > 1 else bare.copy()
        after[heads[moving]] = known
        moved = after != codes
        codes = after
    return pa.array(texts, pa.string()).take(pa.array(codes))


def _tree_hashes(depth: int, fields: list[T.StructField]):
    """A function of a tree's nodes, structs of ``fields``, to ``(node, h)`` of each that stands for its id."""
    kind_of = T.StructType([T.StructField("node", T.StructType(fields)), T.StructField("h", T.StringType())])

    @F.arrow_udf(T.ArrayType(kind_of))
    def hashes(trees: pa.Array) -> pa.Array:
        leaf, inner = lru_cache(REMEMBERED)(_sha1), lru_cache(REMEMBERED)(
            lambda kind, kids: None if kind is None else _sha1(f"{kind}({','.join(kids)})")
        )
        nodes, first_row = trees.flatten(), trees.offsets[0].as_py()
        offsets = [x - first_row for x in trees.offsets.to_pylist()]
        columns = dict(zip((f.name for f in nodes.type), nodes.flatten(), strict=True))
        links = [columns[name] for name in ("node_id", "parent_id", "child_ord", "type")]
        if (plain := _plain_hashes(np.array(offsets), *links, depth)) is not None:
            pairs = pa.StructArray.from_arrays([pa.StructArray.from_arrays(list(columns.values()), list(columns)), plain], ["node", "h"])
            return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs)
        ids, parents, ords, types = map(_values, links)
        own, found, dropped = [True] * len(ids), [], [0]
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            first = dict(zip(reversed(ids[a:b]), range(b - 1, a - 1, -1), strict=True))
            first.pop(None, None)
            kids: dict[int, list[int]] = {}
            for i in range(a, b):
                if parents[i] in first:
                    kids.setdefault(first[parents[i]] - a, []).append(i - a)
            kind, order = types[a:b], ords[a:b]
            h, bare = [leaf(x) for x in kind], [inner(x, ()) for x in kind]
            unique = len(first) == b - a
            tied = [at for at, some in kids.items() if len({order[i] for i in some}) < len(some)]
            for some in kids.values():
                if len(some) > 1:
                    some.sort(key=lambda i: (order[i] is not None, order[i] or 0))
            moving = kids
            for level in range(depth):
                if level == 1 and not unique:  # rows that share an id are one node from the second level on
                    for i in set(range(a, b)).difference(first.values()):
                        own[i] = False
                    kids = {at: [i for i in some if own[a + i]] for at, some in kids.items()}
                    moving = kids
                for at in tied:
                    kids[at].sort(key=lambda i: (order[i] is not None, order[i] or 0, h[i] or ""))
                if level > 1 and unique:  # a hash moves at this level only if one below moved at the last
                    moving = {at: some for at, some in moving.items() if not moving.keys().isdisjoint(some)}
                    new = h.copy()
                else:
                    new = bare.copy()
                for at, some in moving.items():
                    new[at] = inner(kind[at], tuple([h[i] for i in some if h[i] is not None]))
                h = new
            if not unique:
                for i in set(range(a, b)).difference(first.values()):
                    own[i] = False
            found.extend(h)
            dropped.append(dropped[-1] + (b - a - len(first) if not unique else 0))
        pairs = pa.StructArray.from_arrays([pa.StructArray.from_arrays(list(columns.values()), list(columns)), pa.array(found, pa.string())], ["node", "h"])
        if dropped[-1]:
            pairs = pairs.filter(pa.array(own))
        return pa.ListArray.from_arrays(pa.array([x - y for x, y in zip(offsets, dropped, strict=True)], pa.int32()), pairs)

    return hashes


def _hash_rounds(nodes: DataFrame, depth: int) -> DataFrame:
    """:func:`subtree_hash` in rounds.  Each turns a node into two rows, itself under
    its own id and its hash under its parent's id, and groups by id: no join."""
    state = nodes.withColumn("h", _leaf_hash(F.col("type")))
    fields = [f for f in nodes.schema.fields if f.name != "tree_id"]
    payload = F.struct(*[F.col(f.name) for f in fields])
    no_payload = F.lit(None).cast(T.StructType(fields))
    for _ in range(depth):
        roles = F.array(
            F.struct(F.col("node_id").alias("id"), F.lit(None).cast("int").alias("ord"),
                     F.lit(None).cast("string").alias("child_h"), payload.alias("node")),
            F.struct(F.col("parent_id").alias("id"), F.col("child_ord").cast("int").alias("ord"),
                     F.col("h").alias("child_h"), no_payload.alias("node")),
        )
        state = (
            each(state, ["tree_id"], roles, "r").where(F.col("r.id").isNotNull())
            .groupBy("tree_id", F.col("r.id").alias("id"))
            .agg(
                F.first("r.node", ignorenulls=True).alias("node"),
                F.array_sort(F.collect_list(
                    F.when(F.col("r.child_h").isNotNull(), F.struct("r.ord", "r.child_h"))
                )).alias("kids"),
            )
            .where(F.col("node").isNotNull())
            .select(
                "tree_id",  # the grouping column itself: its partitioning carries over
                *[F.col(f"node.{f.name}") for f in fields],
                F.sha1(F.concat(
                    F.col("node.type"), F.lit("("),
                    F.array_join(F.transform("kids", lambda k: k["child_h"]), ","), F.lit(")"),
                )).alias("h"),
            )
        )
    return state


def fingerprint_set(hashed: DataFrame, max_nodes: int | None = None) -> DataFrame:
    """Distinct subtree hashes of a tree, or of its first ``max_nodes`` visited
    nodes.  ``hashed`` comes from :func:`subtree_hash`."""
    seen = hashed if max_nodes is None else hashed.where(F.col("visit_ord") <= max_nodes)
    return seen.select("tree_id", "h").distinct()
