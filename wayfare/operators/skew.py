"""Joins and groups that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A group above this many rows is split. A table of groups above the limit has at most
# rows / limit entries, which is what makes it safe to broadcast.
GROUP_ROWS = 4_000_000

# Rows sampled for every slice of a hot key. The size of a slice varies by about 1/8; one of twice
# the size asked for is a matter of 10^-9.
SAMPLES = 64


def same(left: DataFrame, right: DataFrame, names) -> Column:
    """NULL-safe equality over several columns."""
    return reduce(lambda a, b: a & b, [left[n].eqNullSafe(right[n]) for n in names])


def attach_small(df: DataFrame, small: DataFrame, on) -> DataFrame:
    """Left join, NULL keys included, with a table proven to be small.

    Without keys `small` has at most one row, and its columns are scalar subqueries.
    """
    if not on:
        return df.withColumns({c: small.select(c).scalar() for c in small.columns})
    aliased = small.select(*[F.col(n).alias(f"__k_{n}") for n in on],
                           *[c for c in small.columns if c not in on])
    condition = reduce(
        lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"__k_{n}")) for n in on]
    )
    return df.join(F.broadcast(aliased), condition, "left").drop(*[f"__k_{n}" for n in on])


def hot_groups(df: DataFrame, keys, limit: int = GROUP_ROWS, *extra: Column) -> DataFrame:
    """Groups above `limit` rows with their size `rows`; at most rows / limit of them."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), *extra)
    return counted.filter(F.col("rows") > limit)


def slice_borders(df: DataFrame, keys, order, limit: int = GROUP_ROWS) -> DataFrame:
    """Borders that cut every key above about `limit` rows into slices of about that many rows.

    `order` lists columns that order the rows of a key totally. One row per hot key: the keys and
    `__borders`, the sorted first positions of all slices but the first. The sample is chosen by
    content, so a repeated task draws the same; it has SAMPLES rows per `limit`, and the borders
    rows / limit entries in all.
    """
    every = max(1, limit // SAMPLES)  # of so many rows one is sampled
    apart = max(1, limit // every)  # and of so many samples one is a border
    position = F.struct(*order)
    chosen = df.filter(F.pmod(F.xxhash64(*keys, *order), F.lit(every)) == 0)
    gathered = chosen.groupBy(*keys).agg(F.sort_array(F.collect_list(position)).alias("all"))
    picked = F.transform(
        F.sequence(F.lit(1), F.floor((F.size("all") - 1) / F.lit(apart)).cast("int")),
        lambda i: F.get("all", i * apart),
    )
    return gathered.filter(F.size("all") > apart).select(*keys, picked.alias("__borders"))


def slice_number(order, borders: str = "__borders") -> Column:
    """How many borders lie at or before a row, found by bisection; 0 where there are none."""
    at = F.struct(*order)
    strides = F.array(*[F.lit(1 << i) for i in range(20, -1, -1)])
    found = F.aggregate(
        strides, F.lit(0),
        lambda low, stride: F.when(F.get(borders, low + stride - 1) <= at, low + stride)
        .otherwise(low),
    )
    return F.when(F.col(borders).isNotNull(), found).otherwise(F.lit(0))


def salts_of(hot: DataFrame, on, limit: int = GROUP_ROWS) -> DataFrame:
    """How many parts each hot key is divided into, from its `rows`."""
    return hot.select(*on, F.ceil(F.col("rows") / F.lit(limit)).cast("int").alias("__salts"))


def spread_rows(big: DataFrame, on, salts: DataFrame) -> DataFrame:
    """`big` with a `__salt` that divides the rows of its hot keys."""
    salt = F.pmod(F.xxhash64(*big.columns), F.coalesce(F.col("__salts"), F.lit(1))).cast("int")
    return attach_small(big, salts, on).withColumn("__salt", salt).drop("__salts")


def join_spread(spread: DataFrame, salts: DataFrame, small: DataFrame, on,
                how: str = "inner", keep_salt: bool = False, hint: str | None = None) -> DataFrame:
    """Join rows of `spread_rows` with `small`, whose hot keys are repeated once per salt.

    The `hint` "merge" keeps the planner from a broadcast, for rows that are far larger than their files.
    """
    copies = attach_small(small, salts, on).withColumn(
        "__salt",
        F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__salts"), F.lit(1)) - 1)),
    )
    copies = copies.drop("__salts")
    joined = spread.join(copies.hint(hint) if hint else copies, [*on, "__salt"], how)
    return joined if keep_salt else joined.drop("__salt")


def salted_join(
    big: DataFrame, small: DataFrame, on, how: str = "inner", limit: int = GROUP_ROWS,
    salts: DataFrame | None = None, hint: str | None = None,
) -> DataFrame:
    """Equi-join in which a key of `big` may hold a large share of all rows.

    Rows of a hot key are spread over several salts, and only the matching rows of
    `small` are repeated, once per salt. Other keys have one salt, hence no copies.
    `how` is "inner" or "left". Keys are counted first, unless their `salts` are known.
    """
    if salts is None:
        salts = salts_of(hot_groups(big, on, limit), on, limit)
    return join_spread(spread_rows(big, on, salts), salts, small, on, how, hint=hint)
