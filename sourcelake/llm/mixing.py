"""Mixing sources to target weights by subset sums over document lengths."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sourcelake.llm.keys import SPACE_CLASS, whole_text
from sourcelake.operators.ordinals import ordinals
from sourcelake.session import materialize

WEIGHTS = (5, 2, 1)
#: No document is taken more often than this.
REPEATS = 3
#: Words of a source's budget that are left to the exact fit.
SPAN = 1 << 16
#: Documents of one source and length that are ranked together.
SLICE = 10_000


def word_count(docs: DataFrame) -> DataFrame:
    """``row, doc_id, source, size``: the words of every text, NULL none."""
    size = F.regexp_count(whole_text(), F.lit("[^" + SPACE_CLASS[1:-1] + "]++")).cast("bigint")
    return docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "source", size.alias("size"))


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """``source, source_size, target`` of every source.

    Sources in the order of their code points, NULL last, weigh ``weights`` in
    turn and share the words of all.  No target exceeds ``repeats`` times its
    source: what is over is shared anew by weight until none does.  Only sums
    reach the driver."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("_last", F.col("source").isNull())
    numbered = ordinals(sources, [], ["_last", "source"], "_position")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("_position") - 1) % len(weights) + 1).cast("int"))
    rows = materialize(numbered.select("source", "source_size", weight.alias("_weight"), (F.col("source_size") * repeats).alias("_most")), "sources")
    total, share, before = rows.agg(F.sum("source_size")).first()[0] or 0, 0.0, -1
    while True:
        over = F.col("_weight") * share > F.col("_most")
        n, fixed, weighing = rows.agg(
            F.count_if(over), F.sum(F.when(over, F.col("_most")).otherwise(0)), F.sum(F.when(over, 0.0).otherwise(F.col("_weight")))
        ).first()
        if n == before or not weighing:
            break
        before, share = n, (total - fixed) / weighing
    return rows.select("source", "source_size", F.least(F.col("_weight") * share, F.col("_most").cast("double")).alias("target"))


def fit(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many documents of each length to take so that their words come as
    near ``budget`` as can be; lengths are positive and fall.

    All lengths first give the same share of their documents, rounded so that
    the rounding of one length is made good by the next, up to
    :data:`SPAN` words short of the budget.  The rest is a bounded knapsack:
    reachable sums are the bits of an integer, counts are split into powers of
    two, and the choice is traced back from the nearest sum."""
    words = sum(n * c for n, c in zip(lengths, counts, strict=True))
    if budget <= 0 or not words:
        return [0] * len(lengths)
    share, carry, left, taken = max(0, budget - SPAN) / words, 0.0, budget, []
    for n, c in zip(lengths, counts, strict=True):
        want = share * n * c + carry
        k = min(c, int(want // n), left // n)
        taken.append(k)
        carry, left = want - k * n, left - k * n
    for i, n in enumerate(lengths):
        k = min(counts[i] - taken[i], left // n, max(0, -((SPAN - left) // n)))
        taken[i] += k
        left -= k * n
    sums, limit, history = 1, 2 * left + 1, []
    for i, n in enumerate(lengths):
        free, power = min(counts[i] - taken[i], limit // n), 1
        while free > 0 and not sums >> left & 1:
            k = min(power, free)
            more = (sums | sums << n * k) & ((1 << limit) - 1)
            if more != sums:
                history.append((i, k, sums))
                sums = more
            free, power = free - k, power * 2
    near = min(_nearest(sums, left), key=lambda s: (abs(s - left), s))
    for i, k, earlier in reversed(history):
        if not earlier >> near & 1:
            taken[i] += k
            near -= lengths[i] * k
    return taken


def _nearest(sums: int, target: int) -> list[int]:
    """The largest bit of ``sums`` up to ``target`` and the smallest above it."""
    below = sums & ((1 << target + 1) - 1)
    above = sums >> target + 1
    return [below.bit_length() - 1] + ([target + (above & -above).bit_length()] if above else [])


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, seed: int = 1, repeats: int = REPEATS) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for every row of ``docs``.

    A source's target (:func:`source_targets`) is met by all its documents as
    often as they fit whole, and for the rest by documents chosen by length
    (:func:`fit`) and, within a length, by a hash of ``seed`` and ``doc_id``.
    Documents are counted by source and exact length first, so what one task
    fits is a row per length.  Many documents of one source and length are
    ranked in slices of their hash.

    NULL text has size 0 and is never taken; NULL is a source of its own; rows
    that repeat count each; of rows with one ``doc_id`` and size any may be
    taken first; an empty table gives no rows; other columns are ignored."""
    sized = materialize(word_count(docs), "sizes")
    targets = materialize(source_targets(sized, weights, repeats), "targets")
    lengths = sized.groupBy("source", "size").agg(F.count("*").alias("n"))
    same = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))
    whole = F.least(F.floor(F.col("target") / F.greatest("source_size", F.lit(1))), F.lit(repeats)).cast("bigint")
    plan = lengths.alias("l").join(targets.alias("t"), same("l", "t")).select("l.source", "size", "n", "source_size", "target", whole.alias("whole"))
    plan = plan.withColumn("rest", F.greatest(F.lit(0), F.round("target").cast("bigint") - F.col("whole") * F.col("source_size")))
    plan = materialize(plan, "lengths")

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("size", ascending=False)
        rows["extra"] = fit(rows["size"].tolist(), rows["n"].tolist(), int(rows["rest"].iloc[0]))
        return rows[["source", "size", "extra"]]

    fitted = plan.where("size > 0 and rest > 0").select("source", "size", "n", "rest").groupBy("source").applyInPandas(
        choose, "source string, size bigint, extra bigint"
    )
    plan = plan.alias("p").join(fitted.alias("f"), same("p", "f") & (F.col("p.size") == F.col("f.size")), "left").select(
        "p.*", F.coalesce("extra", F.lit(0).cast("bigint")).alias("extra")
    )
    plan = materialize(plan, "plan")

    h = F.xxhash64(F.lit(seed), F.col("doc_id"))
    slices = F.ceil(F.col("n") / SLICE)
    part = F.floor(F.pmod(F.shiftrightunsigned(h, 11), F.lit(1 << 32)) / float(1 << 32) * slices).cast("bigint")
    rows = sized.alias("s").join(plan.alias("p"), same("s", "p") & (F.col("s.size") == F.col("p.size"))).select(
        "row", "doc_id", "s.source", "s.size", "source_size", "target", "whole", "extra", h.alias("h"), part.alias("part"), slices.alias("slices")
    )
    group = ["source", "size"]
    earlier = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.where("slices > 1").groupBy(*group, "part").agg(F.count("*").alias("k")).select(
        *group, "part", F.coalesce(F.sum("k").over(earlier), F.lit(0)).alias("before")
    )
    before = materialize(before, "slices")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*group, "part").orderBy("h", "row")))
    ranked = ranked.alias("r").join(
        before.alias("b"), same("r", "b") & (F.col("r.size") == F.col("b.size")) & (F.col("r.part") == F.col("b.part")), "left"
    )
    chosen = F.coalesce("before", F.lit(0)) + F.col("rank") <= F.col("extra")
    return ranked.select(
        "doc_id", "r.size", "source_size", "target", (F.col("r.size") * (F.col("whole") + chosen.cast("bigint"))).alias("taken")
    )
