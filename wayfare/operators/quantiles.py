"""Exact quantiles of any number of groups, without sorting a group or holding its values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfare.session import cut_lineage

# A sketch of this accuracy is exact for groups of fewer values than half of it.
ACCURACY = 10_000
SMALL_GROUP = 4096
BINS = 1024


def known(value: str) -> Column:
    """The value, NULL where it is NULL or NaN."""
    return F.nanvl(F.col(value).cast("double"), F.lit(None))


def exact_quantiles(df: DataFrame, group, value: str, shares: list[float], *extra: Column,
                    out: str = "quantiles", limit: int = SMALL_GROUP, bins: int = BINS) -> DataFrame:
    """Per group the values at `shares`, as an array of doubles, and the `extra` aggregates.

    The value at share s of n values is the smallest one that at least s * n values do not exceed; it
    occurs. NULL and NaN do not count; a group without a value has a NULL array.

    One pass serves groups up to `limit` values. The larger ones, at most rows / limit, which is small
    enough to broadcast, are narrowed down: the values between the bounds of a wanted rank are counted
    in `bins` equal ranges, and the range that holds the rank gives the next bounds, until they are one
    value. What moves is a histogram per task, whatever the size of a group.
    """
    group = list(group)
    source = df.withColumn("__value", known(value))
    number = F.count("__value").alias("__n")
    sketched = F.percentile_approx("__value", shares, ACCURACY).alias(out)
    found = cut_lineage(source.groupBy(*group).agg(
        *extra, number, sketched, F.min("__value").alias("__low"), F.max("__value").alias("__high")))
    plain = [c for c in found.columns if not c.startswith("__")]
    large = found.filter(F.col("__n") > limit).select(*group, "__n", "__low", "__high")
    if large.isEmpty():
        return found.select(*plain)
    exact = _narrowed(source, group, large, shares, out, bins)
    keys = exact.select(*[F.col(c).alias(f"__g_{c}") for c in group], F.col(out).alias("__exact"))
    joined = found.join(F.broadcast(keys), same_as(found, group), "left") if group else found.crossJoin(keys)
    return joined.withColumn(out, F.coalesce("__exact", out)).select(*plain)


def same_as(df: DataFrame, group: list[str]) -> Column:
    """NULL-safe equality of the group columns with those of the prefix `__g_`."""
    condition = F.lit(True)
    for c in group:
        condition = condition & df[c].eqNullSafe(F.col(f"__g_{c}"))
    return condition


def _narrowed(source: DataFrame, group: list[str], large: DataFrame, shares: list[float], out: str,
              bins: int) -> DataFrame:
    """The values at `shares` of the groups in `large`, by ever narrower histograms."""
    named = [f"__g_{c}" for c in group]
    bounds = large.select(
        *[F.col(c).alias(g) for c, g in zip(group, named)], F.col("__low").alias("low"), F.col("__high").alias("high"),
        F.posexplode(F.array(*[F.greatest(F.ceil(F.col("__n") * F.lit(s)), F.lit(1)) for s in shares]))
        .alias("share", "rank"))
    bounds = cut_lineage(bounds.withColumn("below", F.lit(0).cast("long")))
    groups = bounds.select(*named).distinct()
    values = source.filter(F.col("__value").isNotNull())
    hot = values.join(F.broadcast(groups), same_as(values, group), "left_semi") if group else values
    # equal values are one row from here on
    counted = cut_lineage(hot.groupBy(*group, "__value").agg(F.count(F.lit(1)).alias("n")))
    target = [*named, "share"]
    while not bounds.filter("low < high").isEmpty():
        inside = counted.join(F.broadcast(bounds.filter("low < high")), same_as(counted, group) & F.col("__value").between(
            F.col("low"), F.col("high")))
        width = F.col("high") / 2 - F.col("low") / 2  # halves cannot overflow
        place = F.floor((F.col("__value") / 2 - F.col("low") / 2) / width * bins)
        # the bounds themselves never share a range, so every round gets ahead
        bin_ = F.when(F.col("__value") == F.col("high"), F.lit(bins)).otherwise(F.least(place, F.lit(bins - 1)))
        counts = inside.groupBy(*target, "rank", "below", bin_.alias("bin")).agg(
            F.sum("n").alias("n"), F.min("__value").alias("low"), F.max("__value").alias("high"))
        before = Window.partitionBy(*target).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        placed = counts.withColumn("below", F.col("below") + F.coalesce(F.sum("n").over(before), F.lit(0)))
        chosen = placed.filter((F.col("below") < F.col("rank")) & (F.col("rank") <= F.col("below") + F.col("n")))
        bounds = cut_lineage(chosen.select(*bounds.columns).unionByName(bounds.filter("low = high")))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("share", "low"))), lambda x: x["low"])
    return bounds.groupBy(*named).agg(listed.alias(out)).select(
        *[F.col(g).alias(c) for c, g in zip(group, named)], out)
