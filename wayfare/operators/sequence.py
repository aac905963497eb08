"""Previous and next row of a key's time line, with hot keys cut into slices.

`lag` and `lead` put a whole key into one task. Here a key above a size limit is cut
into slices of its time line with about equally many rows; each slice is a window group of
its own, and the value at a slice border comes from a small table holding one row per slice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfare.operators.skew import GROUP_ROWS, attach_small, slice_borders, slice_number


def neighbour(
    df: DataFrame,
    keys,
    order,
    value: str,
    out: str,
    step: int,
    limit: int = GROUP_ROWS,
) -> DataFrame:
    """Add `out`: `value` of the row before (step=-1) or after (step=1) within `keys`.

    `order` lists columns that order the rows totally; rows of one second are told apart by
    the others, so a burst is cut like any other stretch. NULL keys form one group. Without
    keys all rows are one time line. `df` is read once more for a small sample, and again if
    a key is hot, so write a costly `df` first.
    """
    if step not in (-1, 1):
        raise ValueError("step must be -1 (previous) or 1 (next)")
    keys, order = list(keys), list(order)
    borders = slice_borders(df, keys, order, limit)
    sliced = attach_small(df, borders, keys).withColumns(
        {"__slice": slice_number(order), "__hot": F.col("__borders").isNotNull()}
    ).drop("__borders")

    group = [*keys, "__slice"]
    inside = Window.partitionBy(*group).orderBy(*order)
    shift = F.lag if step < 0 else F.lead
    # a struct tells "no row there" (NULL struct) from "a row holding NULL"
    shifted = sliced.withColumn("__near", shift(F.struct(F.col(value).alias("v"))).over(inside))

    # the last (or first) row of every slice of a hot key: at most ~2 rows / limit entries
    edge = F.max if step < 0 else F.min
    line = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)],
                    F.col(value).alias("v"))
    edges = (
        sliced.filter("__hot")
        .groupBy(*group)
        .agg(edge(line).alias("__edge"))
    )
    along = Window.partitionBy(*keys).orderBy("__slice")
    carried = edges.select(
        *group, F.struct(shift(F.col("__edge")["v"]).over(along).alias("v")).alias("__carry")
    )
    return (
        attach_small(shifted, carried, group)
        .withColumn(out, F.coalesce(F.col("__near"), F.col("__carry"))["v"])
        .drop("__hot", "__slice", "__near", "__carry")
    )


def previous_value(df, keys, order, value, out, limit=GROUP_ROWS) -> DataFrame:
    return neighbour(df, keys, order, value, out, -1, limit)


def next_value(df, keys, order, value, out, limit=GROUP_ROWS) -> DataFrame:
    return neighbour(df, keys, order, value, out, 1, limit)
