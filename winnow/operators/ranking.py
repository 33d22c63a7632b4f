"""Positions in an order over a whole table, without one task that sorts it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import scratch


def ranked(df: DataFrame, order: Sequence[Column | str], name: str, part: Sequence[str] = ()) -> DataFrame:
    """df with name: each row's position from 0 in the order, within part if named.

    Rows are dealt by ranges of part and order; positions are those inside a range plus the rows in the ranges before, so
    neither a large table nor a large part is ever sorted in one task.  order must tell rows apart, or ties are
    broken as they come.
    """
    dealt = scratch(df.repartitionByRange(*part, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy(*part, "_range").agg(F.count("*").alias("_n"))
    # one row for each range and part in it
    before = Window.partitionBy(*part).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*[F.col(k).alias(f"_of{i}") for i, k in enumerate(part)], F.col("_range").alias("_at"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    same = F.col("_range") == F.col("_at")
    for i, k in enumerate(part):
        same = same & F.col(k).eqNullSafe(F.col(f"_of{i}"))
    inside = F.row_number().over(Window.partitionBy(*part, "_range").orderBy(*order)) - 1
    return dealt.withColumn("_inside", inside).join(offsets, same).select(*df.columns, (F.col("_before") + F.col("_inside")).cast("bigint").alias(name))
