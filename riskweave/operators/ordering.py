"""Row positions within a key that may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def positions(df: DataFrame, keys: list[str], order: list[Column | str], slice_by: Column,
              weight: str | None = None) -> DataFrame:
    """Add ``position`` (running count in the given order) and ``total`` per key.

    ``slice_by`` cuts a key into consecutive slices of the order, such as the
    day of an arrival time. Slices are counted first; each is then numbered on
    its own, from the count of those before it. With ``weight`` a row stands
    for that many rows and ``position`` is that of its last one.
    """
    amount = F.col(weight) if weight else F.lit(1)
    sliced = df.withColumn("_slice", slice_by)
    counts = sliced.groupBy(*keys, "_slice").agg(F.sum(amount).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = counts.select(
        *keys, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(Window.partitionBy(*keys)).alias("total"))
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return sliced.join(offsets, [*keys, "_slice"]).withColumn(
        "position", F.col("_before") + F.sum(amount).over(inside)).drop("_slice", "_before")
