"""Medians per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.operators.skew import GROUP_ROWS
from wayfare.operators.totals import running_total


def median_element(value) -> Column:
    """The middle value that occurs in the group (lower one for even sizes).

    A mergeable sketch: tasks send summaries, whatever the group size.
    """
    return F.percentile_approx(value, 0.5)


def exact_median(df: DataFrame, group, value: str, out: str,
                 limit: int = GROUP_ROWS) -> DataFrame:
    """Exact median, averaging the two middle values of even groups; NULLs do not count.

    Equal values are counted before they meet in one group. The median is found by running
    counts, so a group with very many values is spread over several tasks.
    """
    known = F.when(F.col(value).isNotNull(), F.lit(1))
    counted = df.groupBy(*group, value).agg(F.count(known).alias("__n"))
    ranked = running_total(counted, group, value, "__n", "__below", "__total", limit)
    lower = F.floor((F.col("__total") + 1) / F.lit(2))
    upper = F.floor(F.col("__total") / F.lit(2)) + 1
    # the one or two values that hold the middle ranks
    middle = ranked.filter(
        (F.col("__below") < upper) & (F.col("__below") + F.col("__n") >= lower)
    )
    return middle.groupBy(*group).agg(((F.min(value) + F.max(value)) / F.lit(2)).alias(out))
