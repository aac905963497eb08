"""Times: parsing, epoch seconds and units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two timestamp layouts found in the trip files.
TRIP_TIME_FORMATS = ("yyyy-MM-dd HH:mm:ss", "dd-MM-yy HH:mm")


def parse_timestamp(text, formats=TRIP_TIME_FORMATS) -> Column:
    """Timestamp of the first layout that fits, NULL when none does."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def parse_unix(text, formats=TRIP_TIME_FORMATS) -> Column:
    """Epoch seconds of the first layout that fits, NULL when none does."""
    return F.unix_seconds(parse_timestamp(text, formats))


def hours(seconds: str) -> Column:
    return F.col(seconds) / F.lit(3600)


def minutes(seconds: str) -> Column:
    return F.col(seconds) / F.lit(60)


def window_start(seconds, size: int) -> Column:
    """Start of the tumbling window of `size` seconds that holds an epoch second."""
    seconds = F.col(seconds) if isinstance(seconds, str) else seconds
    return seconds - F.pmod(seconds, F.lit(size))
