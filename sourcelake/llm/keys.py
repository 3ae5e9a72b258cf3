"""Helpers the operators of this package share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the white space that the operators delete or split on.
SPACE_CLASS = r"[\x20\x09-\x0D]"

#: The columns of ``documents``.
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def whole_text(name: str = "text") -> Column:
    """The text, NULL as the empty text."""
    return F.coalesce(F.col(name), F.lit(""))


def content_keys(text: Column) -> list[Column]:
    """Two independent 64-bit hashes that stand for a text: 128 bits together."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]


def hot_values(df: DataFrame, key: str, parts: int = 1000) -> list:
    """Values of ``key`` on more than one row in ``parts``: fewer than
    ``parts`` of them whatever the input, so a list of them is bounded."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    total = df.count()
    return [r[0] for r in counts.where(F.col("_n") * parts > total).select(key).collect()] if total > parts else []


def one_of_each(df: DataFrame, key: list[str], saved: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """``df`` with one row of every set of rows that share ``key``.

    Only rows whose key repeats are grouped; all others pass without moving
    when few keys repeat."""
    repeated = saved(df.groupBy(*key).agg(F.count("*").alias("_n")).where("_n > 1").select(*key), "repeated")
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in key]
    whole = df.alias("a")
    single = whole.join(repeated.alias("b"), same, "left_anti")
    first = whole.join(repeated.alias("b"), same, "left_semi").dropDuplicates(key)
    return single.unionByName(first)


#: Remainders that :func:`possible` tells keys apart by: the bound of what it broadcasts.
SLOTS = 1 << 20


def possible(df: DataFrame, key: Column, among: DataFrame, among_key: Column, how: str = "left_semi") -> DataFrame:
    """Rows of ``df`` whose 64-bit ``key`` may be among those of ``among``, with
    none that is left out; or with ``left_anti`` those whose key surely is not.

    Keys are told apart by their remainder, so the broadcast side has at most
    :data:`SLOTS` rows whatever the input, and rows that cannot match need not
    move to a join.  Far beyond that many keys more rows pass, which costs
    time only."""
    slots = among.select(F.pmod(among_key, F.lit(SLOTS)).alias("_slot")).distinct()
    return df.withColumn("_slot", F.pmod(key, F.lit(SLOTS))).join(F.broadcast(slots), "_slot", how).drop("_slot")


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``docs`` less the rows whose ``doc_id`` and text hash are those of a row
    of ``dropped`` (``doc_id, dk``).  Only rows that may be among them move."""
    rows = docs.select(F.struct("*").alias("_row"), "doc_id", F.xxhash64(whole_text()).alias("_dk"))
    clear = possible(rows, F.col("_dk"), dropped, F.col("dk"), "left_anti")
    same = (F.col("d._dk") == F.col("x.dk")) & F.col("d.doc_id").eqNullSafe(F.col("x.doc_id"))
    asked = possible(rows, F.col("_dk"), dropped, F.col("dk")).alias("d").join(dropped.alias("x"), same, "left_anti")
    return clear.unionByName(asked).select("_row.*")
