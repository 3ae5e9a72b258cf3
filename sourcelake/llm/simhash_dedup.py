"""SimHash near-duplicates by deletion-variant signatures."""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourcelake.llm.components import connected_components
from sourcelake.llm.keys import content_keys, one_of_each, whole_text
from sourcelake.session import materialize

BITS = 64
SEED = 42
#: Shingles whose bits are unpacked at a time, which bounds the memory of a long text.
BLOCK = 1 << 16

_hash = partial(xxhash.xxh64_intdigest, seed=SEED)


def fingerprint(text: bytes, words: int) -> int:
    """SimHash of a UTF-8 text over shingles of ``words`` words, repeats
    included, as a signed 64-bit integer.

    Words are what ASCII white space separates, A-Z lower-cased.  A text with
    fewer words is one shingle; one without words has fingerprint 0.  A bit is
    set if more than half of the shingles' hashes have it."""
    parts = text.lower().split()
    if not parts:
        return 0
    line = b" ".join(parts)
    n = max(1, len(parts) - words + 1)
    length = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(length + 1) - 1
    starts = (ends - length)[:n]
    ends = ends[len(parts) - n:]
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, BLOCK):
        cut = zip(starts[at:at + BLOCK].tolist(), ends[at:at + BLOCK].tolist(), strict=True)
        hashes = np.fromiter((_hash(line[a:b]) for a, b in cut), np.uint64)
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = 4, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``fp`` for every row; NULL text counts as empty."""

    @F.pandas_udf("bigint")
    def simhash(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, words) for t in texts], dtype="int64")

    return docs.select(*keep, simhash(whole_text().cast("binary")).alias("fp"))


def segments(max_distance: int) -> list[tuple[int, int]]:
    """``(lowest bit, width)`` of the segments: the fewest for which one of
    them differs by at most one bit when all differ by ``max_distance``."""
    count = max_distance // 2 + 1
    cuts = [round(BITS * i / count) for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def _variants(fp: Column, max_distance: int) -> Column:
    """A row for each bit: the segment it lies in with that bit wiped out."""
    rows = []
    for low, width in segments(max_distance):
        for bit in range(low, low + width):
            mask = ((1 << width) - 1 << low) & ~(1 << bit)
            rows.append(F.struct(F.lit(bit).alias("bit"), fp.bitwiseAND(F.lit(_signed(mask))).alias("value")))
    return F.array(*rows)


def _meets_here(difference: Column, bit: Column, max_distance: int) -> Column:
    """Whether ``bit`` is the one variant at which a pair is to be reported: in
    the first segment that differs by at most one bit, the bit that differs, or
    the lowest if none does."""
    power = F.expr("shiftleft(1L, l.bit)")
    here = F.lit(False)
    for low, width in reversed(segments(max_distance)):
        part = difference.bitwiseAND(F.lit(_signed((1 << width) - 1 << low)))
        here = F.when(F.bit_count(part) <= 1, (part == power) | ((part == 0) & (bit == low))).otherwise(here)
    return here


def near_links(distinct: DataFrame, max_distance: int = 4) -> DataFrame:
    """Every pair of different fingerprints within ``max_distance`` bits, once.

    ``distinct`` has one row per fingerprint ``fp``.  Each fingerprint is
    indexed under one variant per bit; equal variants join, and the pair is
    verified and kept at one of its variants only, inside the join.  Both sides
    are plain shuffles, so a crowded variant is split by adaptive execution; Spark
    takes the variants for as small as the fingerprints, and would broadcast them."""
    rows = distinct.select("fp", F.explode(_variants(F.col("fp"), max_distance)).alias("v"))
    rows = rows.select("fp", F.col("v.bit").alias("bit"), F.col("v.value").alias("value"))
    left, right = rows.toDF("a", "bit", "value").alias("l"), rows.toDF("b", "bit", "value").alias("r")
    difference = F.col("a").bitwiseXOR(F.col("b"))
    meet = (
        (F.col("l.bit") == F.col("r.bit")) & (F.col("l.value") == F.col("r.value")) & (F.col("a") > F.col("b"))
        & (F.bit_count(difference) <= max_distance) & _meets_here(difference, F.col("l.bit"), max_distance)
    )
    return left.hint("merge").join(right, meet).select("a", "b")


def simhash_groups(docs: DataFrame, words: int = 4, max_distance: int = 4, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per row of ``docs``: ``keep`` (which has ``doc_id``), ``fp``,
    ``fingerprint`` (16 hexadecimal digits), ``component_id`` and ``n_links``.

    Equal fingerprints are one node.  ``component_id`` is the smallest
    ``doc_id`` that links of at most ``max_distance`` bits reach (NULL if all of
    those are NULL), ``n_links`` the number of other fingerprints in reach of
    one link.  Empty and NULL texts share fingerprint 0; an empty table gives
    no rows; other columns are ignored."""
    prints = materialize(fingerprints(docs, words, keep), "fingerprints")
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    links = materialize(near_links(nodes, max_distance), "links")
    ends = links.select(F.explode(F.array("a", "b")).alias("fp"))
    degree = ends.groupBy("fp").agg(F.count("*").alias("n_links"))
    member = connected_components(links).toDF("fp", "root")
    grouped = materialize(nodes.join(member, "fp").join(degree, "fp"), "grouped")
    least = materialize(grouped.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    linked = grouped.join(least, "root").select("fp", "component_id", "n_links")
    named = materialize(
        nodes.join(linked, "fp", "left").select(
            "fp", F.coalesce("component_id", "least").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")
        ), "named",
    )
    return prints.join(named, "fp").select(
        *keep, "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links"
    )


def near_dedup(docs: DataFrame, words: int = 4, max_distance: int = 4) -> DataFrame:
    """``docs`` with one document of each group: the one whose ``doc_id`` is the
    group's ``component_id``.

    Of several rows with that id the one with the least text key stays, and one
    of rows that repeat it; rows without an id stay only where their whole group
    has none.  All columns are kept."""
    keyed = docs.select("doc_id", "text", *content_keys(whole_text()))
    groups = simhash_groups(keyed, words, max_distance, ("doc_id", "k1", "k2"))
    heads = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    group = F.coalesce(F.col("component_id"), F.col("fp"))
    first = F.min(F.struct("k1", "k2")).alias("first")
    stay = materialize(
        heads.groupBy("doc_id", group.alias("g")).agg(first).select("doc_id", "first.k1", "first.k2").distinct(), "stay"
    )
    k1, k2 = content_keys(whole_text())
    rows = docs.select(F.struct("*").alias("_row"), "doc_id", k1.alias("_k1"), k2.alias("_k2"))
    kept = rows.alias("d").join(
        stay.alias("s"),
        (F.col("d._k1") == F.col("s.k1")) & (F.col("d._k2") == F.col("s.k2")) & F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")),
        "left_semi",
    )
    return one_of_each(kept, ["doc_id", "_k1", "_k2"], materialize).select("_row.*")
