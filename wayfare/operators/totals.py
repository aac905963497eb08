"""Running totals along a key's values, with hot keys cut into slices.

As in `sequence`, a key above a size limit is cut into ranges of its order column with about
equally many rows, each a window group of its own, and the totals of the ranges before come from a small table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfare.operators.skew import GROUP_ROWS, attach_small, slice_borders, slice_number


def running_total(df: DataFrame, keys, order: str, amount: str, below: str, total: str,
                  limit: int = GROUP_ROWS) -> DataFrame:
    """Add the sum of `amount` over lower values of `order` within `keys`, and over all.

    `order` is a number and unique within a key. Without keys all rows are one line.
    """
    keys = list(keys)
    borders = slice_borders(df, keys, [order], limit)
    sliced = attach_small(df, borders, keys).withColumns(
        {"__slice": slice_number([order]), "__hot": F.col("__borders").isNotNull()}
    ).drop("__borders")
    group = [*keys, "__slice"]
    before = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)

    # totals of the slices of hot keys: about rows / limit entries
    sums = (
        sliced.filter("__hot")
        .groupBy(*group)
        .agg(F.sum(amount).alias("__sum"))
    )
    every = Window.partitionBy(*keys)
    along = every.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(
        *group, F.sum("__sum").over(along).alias("__carry"), F.sum("__sum").over(every).alias("__all")
    )

    summed = sliced.withColumns(
        {"__before": F.sum(amount).over(before), "__whole": F.sum(amount).over(whole)}
    )
    nothing = F.lit(0)
    return (
        attach_small(summed, carried, group)
        .withColumn(below, F.coalesce("__before", nothing) + F.coalesce("__carry", nothing))
        .withColumn(total, F.coalesce("__all", "__whole"))
        .drop("__hot", "__all", "__slice", "__before", "__whole", "__carry")
    )
