"""Samples, splits and class balancing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.functions.measures import id_fraction, row_fraction


def bernoulli(df: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    return df.sample(fraction=fraction, seed=seed)


def keyed_sample(df: DataFrame, key: str, fraction: float) -> DataFrame:
    """The same rows on every run and every layout, chosen by an integer key."""
    return df.filter(id_fraction(key) < fraction)


def shuffled(df: DataFrame, seed: int = 42) -> DataFrame:
    """Rows in a seeded random order (a global sort)."""
    return df.orderBy(F.rand(seed))


def split_rows(df: DataFrame, fraction: float = 0.7, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Two disjoint parts, chosen by row content.

    Every class is divided in the same proportion, equal rows stay on one side, and a
    re-run after a lost executor makes the same choice.
    """
    cut = row_fraction([F.col(c) for c in df.columns], seed)
    marked = df.withColumn("__cut", cut)
    train = marked.filter(F.col("__cut") < fraction).drop("__cut")
    test = marked.filter(F.col("__cut") >= fraction).drop("__cut")
    return train, test


def class_sizes(df: DataFrame, label: str = "label") -> tuple[int, int]:
    """Rows of class 0 and of class 1, in one pass."""
    row = df.agg(
        F.count_if(F.col(label) == 0).alias("n0"), F.count_if(F.col(label) == 1).alias("n1")
    ).first()
    return row["n0"], row["n1"]


def minority_factor(df: DataFrame, ratio: float, label: str = "label") -> float:
    """How often a row of class 1 must count to reach `ratio` times class 0; never below once."""
    n0, n1 = class_sizes(df, label)
    return max(1.0, int(n0 * ratio) / n1) if n1 else 1.0


def oversample(df: DataFrame, ratio: float = 0.5, label: str = "label", seed: int = 42) -> DataFrame:
    """Repeat rows of class 1 until they are about `ratio` times class 0.

    No row is removed: where class 1 is that large already, the rows stay as they are. Every row gets
    the whole part of the factor. The rest falls on rows by a fraction fixed by their content; of equal
    rows, which are counted first, the due share gets it. So a re-run, also on another layout, makes
    the same rows.
    """
    factor = minority_factor(df, ratio, label)
    if factor == 1.0:
        return df
    whole, rest = divmod(factor, 1)
    minority, columns = df.filter(F.col(label) == 1), [F.col(c) for c in df.columns]
    again = minority.groupBy(*columns).agg(F.count(F.lit(1)).alias("__rows")).withColumn(
        "__more", F.floor(F.col("__rows") * rest + row_fraction(columns, seed)).cast("int"))
    more = again.withColumn("__copy", F.explode(F.array_repeat(F.lit(0), F.col("__more"))))
    repeated = minority.withColumn("__copy", F.explode(F.array_repeat(F.lit(0), F.lit(int(whole)))))
    return (df.filter(F.col(label) == 0).unionByName(repeated.drop("__copy"))
            .unionByName(more.drop("__rows", "__more", "__copy")))


def class_weights(df: DataFrame, ratio: float = 0.5, label: str = "label",
                  out: str = "weight") -> DataFrame:
    """The balance of `oversample` as a weight column: no rows are copied or moved."""
    factor = minority_factor(df, ratio, label)
    return df.withColumn(out, F.when(F.col(label) == 1, F.lit(factor)).otherwise(F.lit(1.0)))


def with_folds(df: DataFrame, folds: int, seed: int = 42, out: str = "fold") -> DataFrame:
    """A fold number from 0, chosen by row content: equal rows are in one fold, on every run."""
    place = row_fraction([F.col(c) for c in df.columns], seed)
    return df.withColumn(out, F.floor(place * folds).cast("int"))
