"""Ranked lexical search by impact lists and the Best Position Algorithm."""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sourcelake.llm.keys import whole_text
from sourcelake.operators.ordinals import ordinals
from sourcelake.session import materialize

#: Terms of items that are searched at once: the bound of what a task holds of the queries.
BLOCK_TERMS = 1 << 16
#: Cells of a shard's impact lists (terms by documents): the bound of what a task holds of the documents.
SHARD_CELLS = 1 << 22
#: Positions read from every list at first; doubled while an item goes on.
FIRST_READ = 32

#: ASCII signs that end a term are blanked, A to Z lower-cased; all other bytes stand for themselves.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def terms_of(text: bytes) -> list[bytes]:
    """The maximal runs of ASCII letters and digits and of signs beyond ASCII, A to Z lower-cased."""
    return text.translate(_FOLD).split(b" ") if text else []


def item_terms(items: DataFrame) -> DataFrame:
    """``q, item_id, terms``: each row of ``items`` under a number from 1, with its different terms."""
    rows = items.select("item_id", whole_text().cast("string").alias("text"))
    folded = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = F.regexp_extract_all(folded, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]++"), F.lit(0))
    rows = materialize(rows.withColumn("terms", F.array_distinct(found)).withColumn("_row", F.monotonically_increasing_id()), "items")
    return ordinals(rows.select("item_id", "terms", "_row"), [], ["_row"], "q").select("q", "item_id", "terms")


def forward_index(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """``doc_id, n, terms, tfs`` for every document with a term: the number of
    its terms with repeats, and those of ``vocabulary`` with their frequency."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = known.value
        for batch in batches:
            keys, sizes, terms, tfs = [], [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                counts = Counter(terms_of(text))
                counts.pop(b"", None)
                if counts:
                    keys.append(doc_id)
                    sizes.append(counts.total())
                    held = [(number[t], n) for t, n in counts.items() if t in number]
                    terms.append([t for t, _ in held])
                    tfs.append([n for _, n in held])
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))],
                ["doc_id", "n", "terms", "tfs"],
            )

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().cast("binary").alias("text"))
    return texts.mapInArrow(count, "doc_id bigint, n bigint, terms array<int>, tfs array<bigint>")


class ImpactLists:
    """The lists of a shard of documents: for each term its documents by falling
    impact, and by document the impact and the position in the list."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, n_docs: int, n_terms: int):
        order = np.lexsort((doc, -impact, term))
        self.docs, self.impacts = doc[order], impact[order]
        self.starts = np.searchsorted(term[order], np.arange(n_terms + 1))
        position = np.arange(len(order)) - self.starts[term[order]]
        cell = term[order].astype(np.int64) * n_docs + self.docs
        #: Where a document stands in a term's list and with what impact; 0 and past the end if it is not there.
        self.impact = np.zeros(n_terms * n_docs, dtype=np.int64)
        self.position = np.full(n_terms * n_docs, -1, dtype=np.int32)
        self.impact[cell], self.position[cell] = self.impacts, position
        self.impact, self.position = self.impact.reshape(n_terms, n_docs), self.position.reshape(n_terms, n_docs)

    def best(self, terms: list[int], weights: np.ndarray, least: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores, among them the ``k`` with the highest scores and all that tie
        with the last of them; those that score under ``least`` may be missing.

        The lists are read side by side.  A document that is met is looked up in all
        other lists, which marks its positions there too.  A list's best position is the
        end of the run of marked positions from its start; no document that was not
        met can score more than the weighted impacts there.  Reading stops once that
        is below the ``k``-th score: at the same score documents may still tie."""
        lists = [(self.docs[a:b], self.impacts[a:b]) for a, b in ((self.starts[t], self.starts[t + 1]) for t in terms)]
        marked = [np.zeros(len(d) + 1, dtype=bool) for d, _ in lists]
        best = [0] * len(lists)
        met = np.zeros(self.impact.shape[1], dtype=bool)
        found, scores, size = [], [], FIRST_READ
        top: list[int] = []
        while True:
            read = [d[p:p + size] for (d, _), p in zip(lists, best, strict=True)]
            new = np.unique(np.concatenate(read))
            new = new[~met[new]]
            met[new] = True
            total = weights @ self.impact[np.ix_(terms, new)]
            found.append(new)
            scores.append(total)
            top = heapq.nlargest(k, top + total.tolist())
            bound = 0
            for i, (t, (d, impacts)) in enumerate(zip(terms, lists, strict=True)):
                at = self.position[t, new]
                marked[i][at[at >= 0]] = True
                best[i] += int(np.argmin(marked[i][best[i]:]))
                if best[i] < len(d):
                    # Lists only fall, so the first position that is not marked bounds the rest at least as well.
                    bound += int(weights[i]) * int(impacts[best[i]])
            kth = max(top[-1] if len(top) == k else 1, least, 1)
            if bound < kth:
                return np.concatenate(found), np.concatenate(scores)
            size *= 2


def _shard_lists(rows: list[tuple], n_all: int, l_all: int, n_terms: int) -> ImpactLists:
    sizes = np.array([len(r[2]) for r in rows])
    doc = np.repeat(np.arange(len(rows)), sizes)
    term = np.concatenate([r[2] for r in rows]).astype(np.int64)
    tf = np.concatenate([r[3] for r in rows])
    # Python integers: the products may pass 63 bits.
    m = np.array([10 + 90 * r[1] * n_all // l_all for r in rows], dtype=np.int64)
    impact = 1_000_000_000 * tf // (1000 * tf + 8 * m[doc])
    return ImpactLists(doc, term, impact, len(rows), n_terms)


def _top_k(index: DataFrame, queries: list[tuple[int, list[int], list[int]]], n_all: int, l_all: int, n_terms: int, k: int) -> DataFrame:
    """``q, doc_id, score``: of every partition of the index the ``k`` best of each query.

    A partition is searched in shards of :data:`SHARD_CELLS`.  What the earlier
    ones gave bounds the search of the next."""
    asked = index.sparkSession.sparkContext.broadcast(queries)
    per_shard = max(64, SHARD_CELLS // max(n_terms, 1))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, list[tuple]] = {}
        held: list[tuple] = []

        def shard() -> None:
            lists = _shard_lists(held, n_all, l_all, n_terms)
            for q, terms, weights in asked.value:
                here = [(t, w) for t, w in zip(terms, weights, strict=True) if w and lists.starts[t] < lists.starts[t + 1]]
                if not here:
                    continue
                before = kept.get(q, [])
                least = before[-1][0] if len(before) == k else 1
                docs, scores = lists.best([t for t, _ in here], np.array([w for _, w in here], dtype=np.int64), least, k)
                good = scores >= max(least, 1)
                if good.sum() > k:
                    good &= scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
                more = [(int(s), held[d][0]) for d, s in zip(docs[good], scores[good], strict=True)]
                kept[q] = sorted(before + more, key=lambda r: (-r[0], r[1] is None, r[1] or 0))[:k]
            held.clear()

        for batch in batches:
            columns = [batch.column(c) for c in ("doc_id", "n", "terms", "tfs")]
            for row in zip(columns[0].to_pylist(), columns[1].to_pylist(), *(_arrays(c) for c in columns[2:]), strict=True):
                if len(row[2]):
                    held.append(row)
                    if len(held) == per_shard:
                        shard()
        if held:
            shard()
        found = [(q, d, s) for q, rows in kept.items() for s, d in rows]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in found], pa.int64()) for i in range(3)], ["q", "doc_id", "score"]
        )

    return index.mapInArrow(search, "q bigint, doc_id bigint, score bigint")


def _arrays(lists: pa.ListArray) -> list[np.ndarray]:
    values, ends = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    ends = ends - ends[0]
    return [values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _blocks(items: DataFrame) -> Iterator[list]:
    """Rows of ``items`` in blocks of :data:`BLOCK_TERMS` terms, and one item more at most."""
    sized = items.select("q", F.size("terms").alias("n"))
    slices = materialize(ordinals(sized, [], ["q"], "_no").select("q", "n", F.floor((F.col("_no") - 1) / 1024).alias("slice")), "item-sizes")
    sums = slices.groupBy("slice").agg(F.sum("n").alias("n"), F.min("q").alias("a"), F.max("q").alias("b")).orderBy("slice")
    first, last, held = None, None, 0
    for row in sums.toLocalIterator():
        if first is not None and held + row["n"] > BLOCK_TERMS:
            yield items.where(F.col("q").between(first, last)).collect()
            first, held = None, 0
        first, last, held = row["a"] if first is None else first, row["b"], held + row["n"]
    if first is not None:
        yield items.where(F.col("q").between(first, last)).collect()


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """``item_id, rank, doc_id, score``: for each row of ``items`` its ``k`` best
    documents with a score above 0, equal scores by ascending ``doc_id``, NULL last.

    Terms, weights and impacts are whole numbers as README gives them.  Items
    are asked in blocks of bounded size, each against all documents.  For a
    block, every document becomes a row of a forward index that has the block's
    terms only; a task cuts its rows into shards of bounded size, draws up their
    impact lists, and finds each item's best by :meth:`ImpactLists.best`.  Only
    these move: ``k`` rows for an item and task, which are ranked together.

    NULL text has no terms; a document or item without terms is in no result;
    rows that repeat are documents, or items, of their own; an empty table
    gives no rows; other columns are ignored."""
    spark = docs.sparkSession
    numbered = materialize(item_terms(items), "item-terms")
    results = []
    for block in _blocks(numbered):
        results.append(_search_block(docs, block, k))
    if not results:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    best = results[0]
    for more in results[1:]:
        best = best.unionByName(more)
    order = Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(numbered.select("q", "item_id"), "q").select("item_id", "rank", "doc_id", "score")


def _search_block(docs: DataFrame, block: list, k: int) -> DataFrame:
    words = sorted({t for row in block for t in row["terms"]})
    number = {t.encode(): i for i, t in enumerate(words)}
    index = materialize(forward_index(docs, number), "forward-index")
    n_all, l_all = index.agg(F.count("*"), F.sum("n")).first()
    if not n_all:
        return docs.sparkSession.createDataFrame([], "q bigint, doc_id bigint, score bigint")
    df = dict(index.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*")).collect())
    weight = {t: math.floor(1000 * math.log((2 * n_all + 2) / (2 * n + 1))) for t, n in df.items()}
    queries = []
    for row in block:
        terms = [number[t.encode()] for t in row["terms"]]
        queries.append((row["q"], [t for t in terms if t in weight], [weight[t] for t in terms if t in weight]))
    return materialize(_top_k(index, queries, n_all, l_all, len(words), k), "best-documents")
