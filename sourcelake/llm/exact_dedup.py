"""Exact duplicates by deterministic block naming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sourcelake.llm.keys import SPACE_CLASS, hot_values, whole_text
from sourcelake.session import materialize

BLOCK_BYTES = 4096
#: Ranges of names: a key's hash says in which one it is ranked.
BUCKETS = 1 << 20


def sorted_names(items: DataFrame, key: list[str]) -> DataFrame:
    """``items`` with ``key`` replaced by ``name``, an integer that equal keys
    share and different keys never do.

    Keys are dealt to buckets by hash and sorted there; the name is made of the
    bucket and the key's rank in it, so each key moves once and nothing is
    joined back.  Keys on more than one item in 1000 would fill a bucket: they
    number under 1000, are reduced to one row each before any shuffle and
    named from a broadcast table of that bound, and their items are spread by
    ``row`` without the key."""
    rest = [c for c in items.columns if c not in key]
    hashed = items.withColumn("_h", F.xxhash64(*key))
    hot = hot_values(hashed.select("_h"), "_h")
    part = F.pmod("_h", F.lit(BUCKETS))
    if hot:
        few = materialize(hashed.where(F.col("_h").isin(hot)).select(*key).distinct(), "hot-keys")
        few = few.withColumn("_hot", -F.row_number().over(Window.orderBy(*key)).cast("bigint"))
        same = [F.col(f"i.{k}").eqNullSafe(F.col(f"f.{k}")) for k in key]
        hashed = hashed.alias("i").join(F.broadcast(few.alias("f")), same, "left").select(
            *rest, "_h", "_hot", *[F.when(F.col("_hot").isNull(), F.col(f"i.{k}")).alias(k) for k in key]
        )
        part = F.when(F.col("_hot").isNull(), part).otherwise(F.pmod(F.xxhash64("row", "pos"), F.lit(BUCKETS)))
    else:
        hashed = hashed.withColumn("_hot", F.lit(None).cast("bigint"))
    rank = F.dense_rank().over(Window.partitionBy("_part").orderBy(*key)).cast("bigint")
    ranked = hashed.select(*rest, "_hot", *key, part.alias("_part")).withColumn("_rank", rank)
    return ranked.select(*rest, F.coalesce("_hot", F.col("_rank") * BUCKETS + F.col("_part")).alias("name"))


def _blocks(raw: Column, n: Column) -> Column:
    at = lambda i: F.substring(raw, i * BLOCK_BYTES + 1, F.lit(BLOCK_BYTES))
    return F.transform(F.sequence(F.lit(0), n - 1), at)


def identities(docs: DataFrame) -> DataFrame:
    """``row, doc_id, points, sha, level, name`` for every row of ``docs``:
    ``(level, name)`` is equal exactly where the texts without white space are.

    The UTF-8 bytes are cut into blocks of :data:`BLOCK_BYTES`, which get
    sorted names; then adjacent pairs of names are named in turn, a last one
    without partner alone, until one is left.  A document of ``n`` blocks ends
    at level ``ceil(log2(n))``."""
    bare = F.regexp_replace(whole_text(), f"{SPACE_CLASS}++", "")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.char_length(whole_text()).alias("points"), bare.cast("binary").alias("raw"))
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("raw") / BLOCK_BYTES).cast("int"))
    rows = rows.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "points", F.sha2("raw", 256).alias("sha"), n.alias("n"), "raw"
    )
    cut = rows.select("row", "doc_id", "points", "sha", "n", F.posexplode(_blocks(F.col("raw"), F.col("n"))).alias("pos", "block"))
    head = lambda c: F.when(F.col("pos") == 0, F.col(c)).alias(c)
    items = cut.select("row", "n", "pos", head("doc_id"), head("points"), head("sha"), "block")
    level = materialize(sorted_names(items, ["block"]), "names")
    done, k = [], 0
    while True:
        done.append(level.where("n = 1").select("row", "doc_id", "points", "sha", F.lit(k).alias("level"), "name"))
        longer = level.where("n > 1")
        if longer.isEmpty():
            break
        half = F.col("pos").bitwiseAND(F.lit(1))
        pairs = longer.groupBy("row", F.expr("pos div 2").cast("int").alias("pos")).agg(
            F.max(F.expr("(n + 1) div 2")).cast("int").alias("n"),
            F.max("doc_id").alias("doc_id"), F.max("points").alias("points"), F.max("sha").alias("sha"),
            F.max(F.when(half == 0, F.col("name"))).alias("left"), F.max(F.when(half == 1, F.col("name"))).alias("right"),
        )
        level = materialize(sorted_names(materialize(pairs, "pairs"), ["left", "right"]), "names")
        k += 1
    found = done[0]
    for more in done[1:]:
        found = found.union(more)
    return found


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical without ASCII white space; NULL counts as
    empty.  Of equal ones the row with the most code points stays, then the
    smallest ``doc_id`` (NULL last), then any one of rows that agree in both.
    Empty table, no rows; other columns are ignored."""
    rows = materialize(identities(docs), "identities")
    order = F.struct((-F.col("points")).alias("p"), F.col("doc_id").isNull().alias("z"), "doc_id", "row")
    groups = rows.groupBy("level", "name").agg(F.count("*").alias("size"), F.min(order).alias("best")).where("size > 1")
    groups = materialize(groups.select("level", "name", "size", F.col("best.doc_id").alias("keep"), F.col("best.row").alias("keep_row")), "groups")
    joined = rows.join(groups, ["level", "name"], "left")
    single = F.col("size").isNull()
    return joined.select(
        "doc_id", F.when(single, F.col("doc_id")).otherwise(F.col("keep")).alias("keep_id"),
        F.coalesce("size", F.lit(1).cast("bigint")).alias("group_size"),
        (single | (F.col("row") == F.col("keep_row"))).alias("kept"), F.col("sha").alias("text_sha256"),
    )
