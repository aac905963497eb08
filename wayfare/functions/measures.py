"""Small ratios and reproducible pseudo-random fractions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def speed_mph(distance="trip_distance", seconds="trip_time_in_secs") -> Column:
    """Miles per hour; NULL when the trip took no time."""
    return F.try_divide(F.col(distance), F.col(seconds) / F.lit(3600))


def share(part, other) -> Column:
    """part / (part + other), NULL when both are zero."""
    part, other = F.col(part), F.col(other)
    return F.try_divide(part, part + other)


def profitability(median, empties) -> Column:
    """Median profit per empty taxi, NULL where no taxi is empty."""
    return F.when(F.col(empties) > 0, F.try_divide(F.col(median), F.col(empties)))


def id_fraction(key: str, salt: int = 0) -> Column:
    """A fraction in [0, 1) fixed by an integer key (multiplicative hashing)."""
    spread = F.pmod(F.col(key).cast("bigint") + F.lit(salt), F.lit(2147483648))
    mixed = F.pmod(spread * F.lit(2654435761), F.lit(4294967296))
    return mixed / F.lit(4294967296.0)


def row_fraction(columns, seed: int) -> Column:
    """A fraction in [0, 1) fixed by the row's content and a seed."""
    bits = F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 40))
    return bits / F.lit(float(1 << 40))
