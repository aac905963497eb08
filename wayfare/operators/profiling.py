"""Missing-value profiles: one pass over the table, whatever the number of columns."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfare.operators.quantiles import exact_quantiles


def is_missing(df: DataFrame, name: str) -> Column:
    """NULL, or NaN in a floating-point column."""
    column = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return column.isNull() | F.isnan(column)
    return column.isNull()


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def existing(df: DataFrame, names) -> list[str]:
    return [n for n in names if n in df.columns]


def _long(row: DataFrame, entries: list[Column]) -> DataFrame:
    """One output row per struct of `entries`, from a one-row table."""
    return row.select(F.inline(F.array(*entries)))


def missing_profile(df: DataFrame) -> DataFrame:
    """(column, missing_count, missing_percent, data_type), one row per column."""
    counts = df.agg(
        F.count(F.lit(1)).alias("__rows"),
        *[F.count_if(is_missing(df, c)).alias(c) for c in df.columns],
    )
    return _long(
        counts,
        [
            F.struct(
                F.lit(c).alias("column"),
                F.col(f"`{c}`").alias("missing_count"),
                F.try_divide(F.col(f"`{c}`") * F.lit(100.0), F.col("__rows")).alias(
                    "missing_percent"
                ),
                F.lit(df.schema[c].dataType.simpleString()).alias("data_type"),
            )
            for c in df.columns
        ],
    )


def missing_by_class(df: DataFrame, label: str) -> DataFrame:
    """(class, column, missing_count, total_count, missing_percent) per class and column."""
    columns = [c for c in df.columns if c != label]
    counts = df.groupBy(F.col(label).alias("class")).agg(
        F.count(F.lit(1)).alias("total_count"),
        *[F.count_if(is_missing(df, c)).alias(c) for c in columns],
    )
    entries = [
        F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("missing_count"))
        for c in columns
    ]
    return counts.select("class", "total_count", F.inline(F.array(*entries))).withColumn(
        "missing_percent", F.col("missing_count") * F.lit(100.0) / F.col("total_count")
    )


def missing_correlation(df: DataFrame, columns) -> DataFrame:
    """(column_a, column_b, correlation) of the missing flags, each pair of columns once.

    The correlation of two 0/1 flags follows from counts, so sums stay whole numbers.
    It is NULL when a flag never changes.
    """
    pairs = list(combinations(columns, 2))
    counts = df.agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        *[F.count_if(is_missing(df, c)).cast("double").alias(f"n_{c}") for c in columns],
        *[
            F.count_if(is_missing(df, a) & is_missing(df, b)).cast("double").alias(f"n_{a}_{b}")
            for a, b in pairs
        ],
    )
    n = F.col("n")

    def spread(c):
        return n * F.col(f"n_{c}") - F.col(f"n_{c}") * F.col(f"n_{c}")

    entries = [
        F.struct(
            F.lit(a).alias("column_a"),
            F.lit(b).alias("column_b"),
            F.try_divide(
                n * F.col(f"n_{a}_{b}") - F.col(f"n_{a}") * F.col(f"n_{b}"),
                F.sqrt(spread(a)) * F.sqrt(spread(b)),
            ).alias("correlation"),
        )
        for a, b in pairs
    ]
    return _long(counts, entries)


def modes(df: DataFrame, columns) -> DataFrame:
    """(column, value, n): the most frequent value of each string column, least on ties.

    Values are counted with map-side aggregation, never gathered per column.
    """
    entries = [
        F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value"))
        for c in columns
    ]
    counted = (
        df.select(F.inline(F.array(*entries)))
        .filter(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # least struct = greatest count first, then least value
    best = F.min(F.struct((-F.col("n")).alias("m"), "value", "n")).alias("best")
    return counted.groupBy("column").agg(best).select("column", "best.value", "best.n")


def _values(df: DataFrame, columns) -> DataFrame:
    """(column, value) per row and column."""
    entries = [F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("value")) for c in columns]
    return df.select(F.inline(F.array(*entries)))


def quantiles(df: DataFrame, columns, shares: list[float]) -> dict[str, list[float] | None]:
    """Exact values at `shares` of every column, which occur in it; None for a column without a value."""
    found = exact_quantiles(_values(df, columns), ["column"], "value", shares).collect()  # a row per column
    return {c: None for c in columns} | {r["column"]: r["quantiles"] for r in found}


def summary(df: DataFrame, columns) -> DataFrame:
    """(statistic, one column per input column): count, mean, stddev, min, quartiles, max.

    Quartiles are exact and values that occur.
    """
    names = ["count", "mean", "stddev", "min", "25%", "50%", "75%", "max"]
    quartiles = quantiles(df, columns, [0.25, 0.5, 0.75])

    def measures(c):
        col = F.col(c)
        places = [F.lit(q).cast("double") for q in quartiles[c] or [None] * 3]
        return [F.count(col).cast("double"), F.avg(col), F.stddev_samp(col), F.min(col).cast("double"),
                *places, F.max(col).cast("double")]

    flat = df.agg(
        *[m.alias(f"{c}__{i}") for c in columns for i, m in enumerate(measures(c))]
    )
    entries = [
        F.struct(
            F.lit(name).alias("statistic"), *[F.col(f"{c}__{i}").alias(c) for c in columns]
        )
        for i, name in enumerate(names)
    ]
    return _long(flat, entries)
