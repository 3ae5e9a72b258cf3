"""Row numbers within groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sourcelake.session import materialize


def ordinals(
    df: DataFrame, group: list[str], order: list[str], name: str, totals: dict[str, Column] | None = None
) -> DataFrame:
    """``row_number() OVER (PARTITION BY group ORDER BY order)``, exactly, but
    with no group in one task.

    Rows are range-partitioned by group and order, which cuts a large group
    into consecutive slices; slices are counted, earlier slices' counts added
    up (a row per group and slice), and rows numbered inside their slice.  The
    ranges are written down first, since sampling them twice could differ.
    ``(group, order)`` must be unique.  ``totals`` are sums over the whole
    group, found on the way."""
    totals = {f"_t{i}": (alias, value) for i, (alias, value) in enumerate((totals or {}).items())}
    ranged = materialize(
        df.repartitionByRange(*group, *order).withColumn("_slice", F.spark_partition_id()), "ranged"
    )
    whole = Window.partitionBy(*group)
    earlier = whole.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy(*group, "_slice")
        .agg(F.count("*").alias("_n"), *[F.sum(value).alias(t) for t, (_, value) in totals.items()])
        .select(
            *group, "_slice", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
            *[F.sum(t).over(whole).alias(alias) for t, (alias, _) in totals.items()],
        )
    )
    inside = Window.partitionBy(*group, "_slice").orderBy(*order)
    return (
        ranged.withColumn("_in", F.row_number().over(inside))
        .join(offsets, [*group, "_slice"])
        .withColumn(name, F.col("_before") + F.col("_in"))
        .select(*df.columns, name, *[alias for alias, _ in totals.values()])
    )
