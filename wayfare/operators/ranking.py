"""Top-k, ranks within groups, padded rank templates and rank-to-column layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows of a total order (one heap per task, then one of k x tasks rows)."""
    return df.orderBy(*order).limit(k)


def slice_rows(df: DataFrame, offset: int, n: int, *order: Column) -> DataFrame:
    """`n` rows after skipping `offset` rows of a total order."""
    return df.orderBy(*order).offset(offset).limit(n)


def ranked(
    df: DataFrame, group, order, k: int, ties: bool = False, out: str = "rank"
) -> DataFrame:
    """Rows ranked 1..k within `group`; Spark trims groups to k rows before the shuffle.

    With ties=True equal rows share a rank and a group may keep more than k rows.
    """
    rank = F.rank() if ties else F.row_number()
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(out, rank.over(window)).filter(F.col(out) <= k)


def rank_template(groups: DataFrame, k: int, out: str = "rank") -> DataFrame:
    """Every group once per rank 1..k."""
    return groups.withColumn(out, F.explode(F.sequence(F.lit(1), F.lit(k))))


def pad_ranks(groups: DataFrame, rows: DataFrame, on, k: int, rank: str = "rank") -> DataFrame:
    """Every group with ranks 1..k, NULL where `rows` has none."""
    return rank_template(groups, k, rank).join(rows, [*on, rank], "left")


def rank_columns(values: dict[str, str], k: int, rank: str = "rank") -> list[Column]:
    """Aggregates `{prefix}_{i}`: each source column's value at rank i, NULL without one."""
    return [
        F.max(F.when(F.col(rank) == i, F.col(c))).alias(f"{prefix}_{i}")
        for i in range(1, k + 1)
        for c, prefix in values.items()
    ]


def widen_ranks(rows: DataFrame, group, values: dict[str, str], k: int,
                rank: str = "rank") -> DataFrame:
    """One row per group with the columns `{prefix}_{rank}` for ranks 1..k.

    `values` maps a source column to its prefix. Ranks must be unique within a group.
    """
    return rows.groupBy(*group).agg(*rank_columns(values, k, rank))
