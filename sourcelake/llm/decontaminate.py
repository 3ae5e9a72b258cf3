"""Benchmark decontamination by spaced seeds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourcelake.llm.keys import possible, whole_text, without
from sourcelake.session import materialize

#: Of the words a mask spans, those marked 1 are hashed; the others may be anything.
#: Wherever the words are that may differ in :data:`MIN_WORDS`, one of these fits between them.
MASKS = ("11101111", "11010010111", "1101110011")
#: The same for whole items that are shorter; those of under five words may not differ.
SHORT_MASKS = {
    5: ("1101", "111"),
    6: ("1111", "110011"),
    7: ("11111", "111011", "1001111"),
    8: ("1110111", "11011011", "10111101"),
    9: ("1111011", "10101111"),
    10: ("110111", "11100011", "1100011001"),
    11: ("1110111", "110100111", "1111101", "1000110111"),
    12: ("11110111", "1110100111", "11011101001", "100111111"),
}
#: An overlap counts from so many words on (or a whole item that is shorter) ...
MIN_WORDS = 13
#: ... of which this share agrees.
AGREEMENT = 0.8
#: Items that are laid at a document side by side; a document that meets more takes several rows.
ITEMS_PER_ROW = 32
#: Slots of the filter that every task holds: its size whatever the benchmark.
SLOTS = 1 << 22
#: Words a task remembers the hashes of.
REMEMBERED = 1 << 18

_EDGES = b"""!"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"""
_SPAN = min(map(len, MASKS))
_FACTORS = np.array([xxhash.xxh64_intdigest(b"%d" % i, 7) | 1 for i in range(max(map(len, MASKS)))], np.uint64)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word.strip(_EDGES), 11)
        return value


def token_hashes(text: bytes, known: _WordHashes) -> np.ndarray:
    """A hash for each word: what ASCII white space separates, A-Z lower-cased,
    without ASCII punctuation at its ends."""
    words = text.lower().split()
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def seeds(tokens: np.ndarray, mask: str) -> np.ndarray:
    """The hash of the selected words at every place where ``mask`` fits."""
    n = len(tokens) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.full(n, xxhash.xxh64_intdigest(mask.encode(), 3), np.uint64)
    for i, sign in enumerate(mask):
        if sign == "1":
            total += tokens[i:i + n] * _FACTORS[i]
    total ^= total >> np.uint64(29)
    total *= np.uint64(0xBF58476D1CE4E5B9)
    return total ^ total >> np.uint64(32)


def _slots(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = np.uint64(SLOTS - 1)
    return (values & low).astype(np.int64), (values >> np.uint64(40) & low).astype(np.int64)


def _seed_rows(texts: DataFrame, id_columns: list[str], masks, keep) -> DataFrame:
    """``id_columns, pos, seed`` for the seeds of each text that ``keep`` lets pass."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHashes()
        for batch in batches:
            rows, places, found = [], [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                tokens = token_hashes(text, known)
                for mask in masks(len(tokens)):
                    values = seeds(tokens, mask)
                    at = np.flatnonzero(keep(values))
                    if len(at):
                        rows.append(np.full(len(at), row))
                        places.append(at)
                        found.append(values[at])
            if not rows:
                continue
            take = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).take(take) for c in id_columns]
                + [pa.array(np.concatenate(places), pa.int64()), pa.array(np.concatenate(found).view(np.int64))],
                [*id_columns, "pos", "seed"],
            )

    ids = ", ".join(f"{c} bigint" for c in id_columns)
    return texts.mapInArrow(scan, f"{ids}, pos bigint, seed bigint")


def item_masks(n: int, fuzzy: bool = False) -> tuple[str, ...]:
    """The masks for an item of ``n`` words; for one of under :data:`MIN_WORDS`
    with ``fuzzy`` those that find it wherever its words differ, without it
    those of :data:`MASKS` that fit and one over all its words."""
    if n >= MIN_WORDS or not n:
        return MASKS if n else ()
    if fuzzy:
        return SHORT_MASKS.get(n, ("1" * n,))
    return MASKS if n >= max(map(len, MASKS)) else (*(m for m in MASKS if len(m) <= n), "1" * n)


def benchmark_seeds(items: DataFrame, fuzzy: bool = False) -> DataFrame:
    """``item_id, pos, seed``: every seed of every item (:func:`item_masks`)."""
    return _seed_rows(items, ["item_id"], lambda n: item_masks(n, fuzzy), lambda v: np.ones(len(v), bool))


def _verify(tokens: np.ndarray, item: np.ndarray, shift: int) -> int:
    """Words of ``item`` that ``tokens`` overlap when it is laid at ``shift``:
    those in stretches of :data:`MIN_WORDS` (or the item's length, if less) of
    which :data:`AGREEMENT` agree."""
    a, b = max(0, -shift), min(len(item), len(tokens) - shift)
    width = min(MIN_WORDS, len(item))
    if b - a < width:
        return 0
    sums = np.concatenate(([0], np.cumsum(tokens[a + shift:b + shift] == item[a:b])))
    good = np.flatnonzero(sums[width:] - sums[:-width] >= AGREEMENT * width - 1e-9)
    if not len(good):
        return 0
    return int(width + np.minimum(np.diff(good), width).sum())


def contaminated(docs: DataFrame, benchmark: DataFrame, fuzzy: bool = False) -> DataFrame:
    """``doc_id, dk, item_id, words``: overlaps of documents with items of
    ``benchmark`` (``item_id, text``); ``dk`` is the text's hash, ``words`` the
    largest overlap.

    Seeds of both sides join on their hash.  Before that a filter of fixed size
    drops nearly all seeds of documents that no item has, so only rows near to
    a hit are shuffled.  Hits are reduced to one per document, item and shift,
    laid out in rows of some :data:`ITEMS_PER_ROW` items however many a document meets,
    and the words along each are compared, which finds all seeds' substitutions
    and any others."""
    items = materialize(benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), whole_text().cast("binary").alias("text")), "items")
    wanted = materialize(benchmark_seeds(items, fuzzy), "item-seeds")
    lengths = wanted.sparkSession.sparkContext.broadcast(_short_lengths(items))
    filled = np.zeros(SLOTS, bool)
    low, high = (F.col("seed").bitwiseAND(F.lit(SLOTS - 1)), F.shiftrightunsigned("seed", 40).bitwiseAND(F.lit(SLOTS - 1)))
    slots = wanted.select(F.explode(F.array(low.cast("int"), high.cast("int"))).alias("slot")).distinct().toPandas()["slot"].to_numpy()
    filled[slots] = True
    held = docs.sparkSession.sparkContext.broadcast(np.packbits(filled))

    def keep(values: np.ndarray) -> np.ndarray:
        table, (a, b) = held.value, _slots(values)
        hit = table[a >> 3] >> (7 - (a & 7)) & 1 == 1
        at = np.flatnonzero(hit)
        hit[at] = table[b[at] >> 3] >> (7 - (b[at] & 7)) & 1 == 1
        return hit

    def masks(n: int) -> list[str]:
        return [m for m in dict.fromkeys((*MASKS, *(m for k in lengths.value for m in item_masks(k, fuzzy)))) if len(m) <= n]

    dk = F.xxhash64(whole_text()).alias("dk")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), dk, whole_text().cast("binary").alias("text"))
    near = materialize(_seed_rows(texts, ["doc_id", "dk"], masks, keep), "near-seeds")
    shift = (F.col("d.pos") - F.col("i.pos")).alias("shift")
    hits = near.alias("d").join(wanted.alias("i"), F.col("d.seed") == F.col("i.seed")).select("doc_id", "dk", "item_id", shift).distinct()
    hits = hits.groupBy("doc_id", "dk", "item_id").agg(F.collect_list("shift").alias("shifts"))
    hits = materialize(hits, "hits")
    many = hits.groupBy("doc_id", "dk").agg(F.ceil(F.count("*") / ITEMS_PER_ROW).alias("_rows"))
    same = (F.col("h.dk") == F.col("m.dk")) & F.col("h.doc_id").eqNullSafe(F.col("m.doc_id"))
    part = F.pmod(F.xxhash64("item_id"), F.col("_rows")).alias("_part")
    hits = hits.alias("h").join(many.alias("m"), same).select("h.*", part)
    laid = hits.join(items.withColumnRenamed("text", "item"), "item_id").groupBy("doc_id", "dk", "_part").agg(
        F.collect_list(F.struct("item_id", "item", "shifts")).alias("laid")
    )
    laid = materialize(laid, "laid")
    same = (F.col("d.dk") == F.col("x.dk")) & F.col("d.doc_id").eqNullSafe(F.col("x.doc_id"))
    asked = possible(texts, F.col("dk"), laid, F.col("dk")).alias("d").join(laid.alias("x"), same).select("d.doc_id", "d.dk", "text", "laid")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHashes()
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                tokens = token_hashes(row["text"], known)
                for x in row["laid"]:
                    item = token_hashes(x["item"], known)
                    words = max(_verify(tokens, item, s) for s in x["shifts"])
                    if words:
                        out.append((row["doc_id"], row["dk"], x["item_id"], words))
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "dk", "item_id", "words"])

    return asked.mapInArrow(verify, "doc_id bigint, dk bigint, item_id bigint, words bigint").distinct()


def _short_lengths(items: DataFrame) -> list[int]:
    """Word counts below :data:`MIN_WORDS` that some item has."""
    n = F.regexp_count(F.col("text").cast("string"), F.lit(r"[^\x20\x09-\x0D]++"))
    rows = items.select(n.alias("n")).where(f"n between 1 and {MIN_WORDS - 1}").distinct().collect()
    return sorted(r.n for r in rows)


def contamination(docs: DataFrame, benchmark: DataFrame, fuzzy: bool = False) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, contaminated, items, words``:
    the items a document overlaps (:func:`contaminated`), in order, and the
    most words it shares with one.

    NULL and empty texts and items overlap nothing; rows that repeat are each
    reported; items that repeat under one id count once; an empty table gives
    no rows, an empty benchmark flags none; other columns are ignored."""
    found = contaminated(docs, benchmark, fuzzy).groupBy("doc_id", "dk").agg(
        F.array_sort(F.collect_set("item_id")).alias("items"), F.max("words").alias("words")
    )
    found = materialize(found, "contaminated")
    rows = docs.select("doc_id", F.xxhash64(whole_text()).alias("dk"))
    same = (F.col("d.dk") == F.col("x.dk")) & F.col("d.doc_id").eqNullSafe(F.col("x.doc_id"))
    return rows.alias("d").join(found.alias("x"), same, "left").select(
        "d.doc_id", F.col("words").isNotNull().alias("contaminated"),
        F.coalesce("items", F.array().cast("array<bigint>")).alias("items"), F.coalesce("words", F.lit(0).cast("bigint")).alias("words"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, fuzzy: bool = False) -> DataFrame:
    """``docs`` less every document that overlaps an item; all columns stay."""
    return without(docs, materialize(contaminated(docs, benchmark, fuzzy).select("doc_id", "dk").distinct(), "contaminated"))
