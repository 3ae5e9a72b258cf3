"""How filters interact in every order, from decision diagrams of failure masks."""

from __future__ import annotations

from collections.abc import Iterator
from math import factorial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourcelake.llm.keys import SPACE_CLASS, content_keys, possible, whole_text
from sourcelake.session import materialize

FILTERS = "ABCDE"
#: What a diagram's leaves count: documents, and of these the good and the toxic ones.
WEIGHTS = 3


def own_failures(text: Column) -> Column:
    """Bits of the filters A to D that a text fails on its own."""
    words = F.regexp_extract_all(text, F.lit("[^" + SPACE_CLASS[1:-1] + "]++"), F.lit(0))
    # The words are an argument, so that a text is cut once.
    by_words = F.get(
        F.transform(F.array(words), lambda w: F.when(F.size(w) < 100, 1).otherwise(0) + F.when(100 * F.size(F.array_distinct(w)) < 80 * F.size(w), 2).otherwise(0)),
        F.lit(0),
    )
    capitals = F.when(100 * F.regexp_count(text, F.lit("[A-Z]")).cast("bigint") > 10 * F.char_length(text).cast("bigint"), 4).otherwise(0)
    return by_words + capitals + F.when(text.rlike("[#$%&*|]"), 8).otherwise(0)


def failure_masks(docs: DataFrame) -> DataFrame:
    """``doc_id, part, mask`` for every row: bit ``i`` is set if it fails filter ``i``.

    Only hashes of texts move: 128 bits stand for a text.  Texts that stand
    once are not joined; those that repeat are reduced to their least ``doc_id``
    before the shuffle."""
    text = whole_text()
    rows = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), *content_keys(text), own_failures(text).alias("mask"))
    rows = materialize(rows, "failures")
    repeated = rows.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1").select("k1", "k2", "first")
    repeated = materialize(repeated, "repeated-texts")
    single = possible(rows, F.col("k1"), repeated, F.col("k1"), "left_anti").select("doc_id", "part", "mask")
    again = possible(rows, F.col("k1"), repeated, F.col("k1")).join(repeated, ["k1", "k2"], "left")
    copy = F.when(F.col("doc_id") > F.col("first"), 1 << FILTERS.index("E")).otherwise(0)
    return single.unionByName(again.select("doc_id", "part", (F.col("mask") + copy).alias("mask")))


def mask_counts(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, n, good, toxic``: at most 32 rows for a part."""
    flag = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0))).alias(c)
    known = labels.where("quality = 1 or toxic = 1").groupBy(F.col("doc_id").alias("_id")).agg(flag("quality"), flag("toxic"))
    rows = masks.join(known, masks["doc_id"] == known["_id"], "left")
    total = lambda c, name: F.sum(F.coalesce(F.col(c), F.lit(0))).cast("bigint").alias(name)
    return rows.groupBy("part", "mask").agg(F.count("*").alias("n"), total("quality", "good"), total("toxic", "toxic"))


class Diagram:
    """A decision diagram over filters whose leaves are counts.

    A node is ``(pass, fail)``: what becomes of documents that pass and that fail the
    filter of its level; a leaf is a tuple of counts.  Equal nodes are one."""

    def __init__(self, order: list[int], counts: dict[int, tuple[int, ...]]):
        self.order = list(order)
        self._nodes: dict[tuple, tuple] = {}
        self._weights: dict[int, tuple[int, ...]] = {}
        self.root = self._build(counts, 0, 0)

    def _node(self, low: tuple, high: tuple) -> tuple:
        # Children are shared, so their identities say which node it is.
        return self._nodes.setdefault((id(low), id(high)), (low, high))

    def _leaf(self, counts: tuple[int, ...]) -> tuple:
        return self._nodes.setdefault(("leaf", *counts), counts)

    def _build(self, counts: dict[int, tuple[int, ...]], level: int, mask: int) -> tuple:
        if level == len(self.order):
            return self._leaf(counts.get(mask, (0,) * WEIGHTS))
        return self._node(self._build(counts, level + 1, mask), self._build(counts, level + 1, mask | 1 << self.order[level]))

    def weight(self, node: tuple) -> tuple[int, ...]:
        """Counts of all documents below a node."""
        if isinstance(node[0], int):
            return node
        found = self._weights.get(id(node))
        if found is None:
            found = self._weights[id(node)] = tuple(a + b for a, b in zip(self.weight(node[0]), self.weight(node[1]), strict=True))
        return found

    def swap(self, level: int) -> None:
        """Exchanges the filters of a level and the next.  Nodes above and below keep their shape."""
        done: dict[int, tuple] = {}

        def redraw(node: tuple, depth: int) -> tuple:
            if id(node) not in done:
                low, high = node
                if depth < level:
                    new = self._node(redraw(low, depth + 1), redraw(high, depth + 1))
                else:
                    new = self._node(self._node(low[0], high[0]), self._node(low[1], high[1]))
                done[id(node)] = new
            return done[id(node)]

        self.root = redraw(self.root, 0)
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]

    def steps(self) -> Iterator[tuple[int, tuple[int, ...], tuple[int, ...]]]:
        """``filter, kept, removed`` along the path of documents that pass all so far."""
        node = self.root
        for f in self.order:
            yield f, self.weight(node[0]), self.weight(node[1])
            node = node[0]


def adjacent_swaps(n: int) -> Iterator[int]:
    """Levels whose swaps lead through all orders of ``n`` filters, each once:
    the last goes down and up again between the swaps of the others."""
    if n < 2:
        return
    down = True
    inner = adjacent_swaps(n - 1)
    while True:
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        level = next(inner, None)
        if level is None:
            return
        yield level + 1 if down else level
        down = not down


def audit(part: str, counts: dict[int, tuple[int, ...]], filters: str = FILTERS) -> pd.DataFrame:
    """The steps of every order for one part."""
    n = len(filters)
    diagram = Diagram(list(range(n)), counts)
    seen = [(list(diagram.order), list(diagram.steps()))]
    for level in adjacent_swaps(n):
        diagram.swap(level)
        seen.append((list(diagram.order), list(diagram.steps())))
    assert len(seen) == factorial(n)
    # A filter removes all that fail it where it comes first, and what no other removes where it comes last.
    fails, alone, shapley = [0] * n, [0] * n, [0] * n
    for order, steps in seen:
        fails[order[0]], alone[order[-1]] = steps[0][2][0], steps[-1][2][0]
        for f, _, removed in steps:
            shapley[f] += removed[0]
    rows = []
    for order, steps in seen:
        name = "".join(filters[f] for f in order)
        for i, (f, kept, (gone, good, toxic)) in enumerate(steps, 1):
            rows.append((part, name, i, kept[0], gone, fails[f] - gone, alone[f], good, toxic, shapley[f]))
    return pd.DataFrame(rows, columns=["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"])


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley`` for every part of ``docs`` (its ``lang``,
    NULL as empty), each of the 120 orders of five filters and each step.

    A document fails A with under 100 words, B if under 80 % of its words
    differ, C if over 10 % of its code points are A to Z, D if it holds one of
    ``#$%&*|``, E if a row with a smaller ``doc_id`` has the same text.  Documents
    are counted by part and mask of failures; a task then has one part's counts,
    32 rows at most, as a decision diagram (:class:`Diagram`) that adjacent level
    swaps lead through all orders.

    NULL text counts as empty.  Rows without ``doc_id`` neither fail E nor make
    others fail it, and have no label; rows that repeat count each; of repeated
    labels a document has the greatest; an empty table gives no rows; other
    columns are ignored."""
    counts = mask_counts(failure_masks(docs), labels)

    def steps(rows: pd.DataFrame) -> pd.DataFrame:
        by_mask = {int(m): (int(n), int(g), int(t)) for m, n, g, t in zip(rows["mask"], rows["n"], rows["good"], rows["toxic"], strict=True)}
        return audit(rows["part"].iloc[0], by_mask)

    return counts.groupBy("part").applyInPandas(
        steps, "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, "
        "unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint"
    )
