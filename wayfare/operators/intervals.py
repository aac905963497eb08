"""Rows against regular time ticks without a range join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


TICKS_PER_ROW = 1024


def _bounds(df: DataFrame, seconds: str, step: int) -> DataFrame:
    """One row with the first event and the number of the tick at or after the last; none without events."""
    bounds = df.agg(F.min(seconds).alias("lo"), F.max(seconds).alias("hi")).filter(F.col("lo").isNotNull())
    # from lo to below hi + step: the last tick is the first one at or after hi
    return bounds.select("lo", F.floor((F.col("hi") - F.col("lo") + F.lit(step - 1)) / F.lit(step)).alias("steps"))


def minute_ticks(df: DataFrame, seconds: str, step: int = 60) -> DataFrame:
    """Ticks `tick` from the first event on, every `step` seconds, to cover the last.

    A long time is cut into stretches of TICKS_PER_ROW ticks, which are dealt to the tasks before they
    are written out.
    """
    bounds = _bounds(df, seconds, step)
    stretches = bounds.select("lo", "steps", F.explode(
        F.sequence(F.lit(0).cast("bigint"), F.col("steps"), F.lit(TICKS_PER_ROW).cast("bigint"))).alias("from"))
    until = F.least(F.col("from") + F.lit(TICKS_PER_ROW - 1), F.col("steps"))
    return stretches.repartition("from").select("lo", F.explode(F.sequence("from", until)).alias("i")).select(
        (F.col("lo") + F.col("i") * F.lit(step)).alias("tick"))


def count_changes(df: DataFrame, seconds: str, group, span: int, step: int = 60,
                  out: str = "num_rides") -> DataFrame:
    """Stretches of ticks over which the count of a group stays the same and is not zero.

    (`group`, __first, __until, `out`, __lo): at the ticks numbered __first to __until - 1 the rows with
    t - span <= seconds <= t number `out`; tick i is at __lo + i * step. A row comes at one tick and
    goes at another, so what is shuffled is two changes per row at most, summed up before, whatever
    the span and the step. A group is one line in time with at most a row per tick.
    """
    bounds = _bounds(df, seconds, step)
    lo, steps = bounds.select("lo").scalar(), bounds.select("steps").scalar()
    from_start = F.col(seconds) - lo
    comes = F.ceil(from_start / F.lit(step))
    goes = F.floor((from_start + F.lit(span)) / F.lit(step)) + 1
    changes = df.filter(F.col(seconds).isNotNull()).select(*group, F.inline(F.array(
        F.struct(comes.alias("__first"), F.lit(1).alias("__change")),
        F.struct(F.least(goes, steps + 1).alias("__first"), F.lit(-1).alias("__change")))))
    summed = changes.groupBy(*group, "__first").agg(F.sum("__change").alias("__change")).filter("__change != 0")
    along = Window.partitionBy(*group).orderBy("__first")
    lines = summed.withColumns({
        out: F.sum("__change").over(along.rowsBetween(Window.unboundedPreceding, 0)),
        "__until": F.lead("__first").over(along)})
    return lines.filter(F.col(out) > 0).select(*group, "__first", "__until", out, lo.alias("__lo"))


def counts_at_ticks(
    df: DataFrame, seconds: str, group, span: int, step: int = 60, out: str = "num_rides"
) -> DataFrame:
    """For each tick t, the rows per `group` with t - span <= seconds <= t.

    The stretches of `count_changes` are written out tick by tick where they are; what follows may
    rank them per tick before anything moves.
    """
    lines = count_changes(df, seconds, group, span, step, out)
    ticks = lines.select(*group, out, "__lo", F.explode(F.sequence("__first", F.col("__until") - 1)).alias("__tick"))
    return ticks.select((F.col("__lo") + F.col("__tick") * F.lit(step)).alias("tick"), *group, out)


def ticks_between(first: Column, last: Column, step: int) -> Column:
    """Array of the multiples of `step` in [first, last]; empty when there is none."""
    low = F.ceil(first / F.lit(step)) * F.lit(step)
    high = F.floor(last / F.lit(step)) * F.lit(step)
    none = F.array().cast("array<bigint>")
    return F.when(low <= high, F.sequence(low, high, F.lit(step).cast("bigint"))).otherwise(none)
