"""Small inline tables."""

TRIP = (
    "trip_id bigint, medallion string, hack_license string, pickup_unix bigint, dropoff_unix bigint"
)


def trips(spark, rows):
    """(trip_id, medallion, pickup, dropoff) rows; the driver is the taxi."""
    return spark.createDataFrame([(i, m, m, p, d) for i, m, p, d in rows], TRIP)


def rows_of(df, *columns):
    return sorted(
        (tuple(r[c] for c in (columns or df.columns)) for r in df.collect()),
        key=lambda r: tuple((v is not None, v) for v in r),
    )
