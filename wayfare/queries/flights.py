"""Flight-quality queries."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from wayfare.operators.profiling import (
    missing_by_class,
    missing_correlation,
    missing_profile,
    modes,
)
from wayfare.plans import flights as plans
from wayfare.queries.base import FLIGHTS, ctes, query, stable, stable_sql
from wayfare.schemas import FLIGHT, column_names
from wayfare.sources import derived

KINDS = {part.split()[0]: part.split()[1] for part in FLIGHT.split(",")}
RENAMED_KINDS = {plans.RENAMES.get(c, c): kind for c, kind in KINDS.items()}
RENAMED = "renamed AS (SELECT " + ", ".join(
    f"{c} AS {plans.RENAMES.get(c, c)}" for c in KINDS) + " FROM flights)"
FILLED = "filled AS (SELECT " + ", ".join(
    f"coalesce({c}, 0e0) AS {c}" if c in plans.FILLED_COLUMNS else c for c in RENAMED_KINDS
) + ", dayofweek(FL_DATE) + 1 AS DayOfWeek, month(FL_DATE) AS Month FROM renamed)"
PREPARED = """prepared AS (
    SELECT *, CAST(CANCELLED AS INT) AS label FROM filled WHERE DIVERTED <> 1)"""


def _flights(spark, sf_dir):
    return derived.flights(spark, sf_dir)


def _renamed(spark, sf_dir):
    return plans.rename_columns(_flights(spark, sf_dir))


def _prepared(spark, sf_dir):
    return plans.preprocess(_flights(spark, sf_dir))


def _text_dates(df):
    return df.withColumn("FL_DATE", F.col("FL_DATE").cast("string"))


@query("renamed_flights", ctes(FLIGHTS, RENAMED) + """
    SELECT * REPLACE (CAST(FL_DATE AS VARCHAR) AS FL_DATE) FROM renamed""")
def renamed_flights(spark, sf_dir):
    return _text_dates(_renamed(spark, sf_dir))


@query("flights_without_leaks", ctes(FLIGHTS, RENAMED) + """
    SELECT * EXCLUDE (CancellationCode, DEP_TIME, ARR_TIME, WHEELS_OFF, WHEELS_ON, AIR_TIME,
        ActualElapsedTime) REPLACE (CAST(FL_DATE AS VARCHAR) AS FL_DATE) FROM renamed""")
def flights_without_leaks(spark, sf_dir):
    return _text_dates(plans.remove_leaks(_renamed(spark, sf_dir)))


@query("calendar_features", ctes(FLIGHTS) + """
    SELECT CAST(dayofweek(FL_DATE) + 1 AS INT) AS DayOfWeek, CAST(month(FL_DATE) AS INT) AS Month,
        count(*) AS flights FROM flights GROUP BY 1, 2""")
def calendar_features(spark, sf_dir):
    return plans.with_calendar(_flights(spark, sf_dir)).groupBy("DayOfWeek", "Month").agg(
        F.count(F.lit(1)).alias("flights")
    )


@query("undiverted_flights", ctes(FLIGHTS) + """
    SELECT DIVERTED AS diverted, count(*) AS flights FROM flights WHERE DIVERTED <> 1 GROUP BY 1""")
def undiverted_flights(spark, sf_dir):
    kept = plans.without_diverted(_flights(spark, sf_dir))
    return kept.groupBy(F.col("DIVERTED").alias("diverted")).agg(
        F.count(F.lit(1)).alias("flights")
    )


@query("cancelled_flights", ctes(FLIGHTS) + """
    SELECT OP_CARRIER, CAST(CANCELLED AS INT) AS label, count(*) AS flights FROM flights
    WHERE CANCELLED = 1 GROUP BY 1, 2""")
def cancelled_flights(spark, sf_dir):
    cancelled = plans.with_label(_flights(spark, sf_dir)).filter(F.col("CANCELLED") == 1)
    return cancelled.groupBy("OP_CARRIER", "label").agg(F.count(F.lit(1)).alias("flights"))


@query("preprocessed_flights", ctes(FLIGHTS, RENAMED, FILLED, PREPARED) + """
    SELECT * REPLACE (CAST(FL_DATE AS VARCHAR) AS FL_DATE, CAST(DayOfWeek AS INT) AS DayOfWeek,
        CAST(Month AS INT) AS Month) FROM prepared""")
def preprocessed_flights(spark, sf_dir):
    return _text_dates(_prepared(spark, sf_dir))


@query("top_carriers", ctes(FLIGHTS) + """
    SELECT OP_CARRIER AS UniqueCarrier, count(*) AS flight_count FROM flights
    GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def top_carriers(spark, sf_dir):
    return plans.top_carriers(_renamed(spark, sf_dir))


@query("cancel_reasons", ctes(FLIGHTS) + """
    SELECT CANCELLATION_CODE AS CancellationCode, count(*) AS count,
        CASE CANCELLATION_CODE WHEN 'A' THEN 'Carrier' WHEN 'B' THEN 'Weather'
            WHEN 'C' THEN 'National Air System' WHEN 'D' THEN 'Security' END AS reason
    FROM flights WHERE CANCELLED = 1 GROUP BY 1""")
def cancel_reasons(spark, sf_dir):
    return plans.cancellation_reasons(_renamed(spark, sf_dir))


@query("class_distribution", ctes(FLIGHTS, RENAMED, FILLED, PREPARED) + """
    SELECT n0, n1, n0 * 100e0 / (n0 + n1) AS percent0, n1 * 100e0 / (n0 + n1) AS percent1,
        CAST(n0 AS DOUBLE) / n1 AS imbalance_ratio
    FROM (SELECT count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1
        FROM prepared)""")
def class_distribution(spark, sf_dir):
    return plans.class_distribution(_prepared(spark, sf_dir))


def _profile_sql(table: str, kinds: dict[str, str], name: str) -> str:
    rows = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing_count,"
        f" (count(*) - count({c})) * 100e0 / count(*) AS missing_percent,"
        f" '{kind}' AS data_type FROM {table}"
        for c, kind in kinds.items()
    )
    return f"{name} AS ({rows})"


@query("missing_profile", ctes(FLIGHTS, _profile_sql("flights", KINDS, "profile"))
       + "SELECT * FROM profile")
def profile(spark, sf_dir):
    return missing_profile(_flights(spark, sf_dir)).orderBy(F.desc("missing_percent"), "column")


@query("missing_by_class", ctes(FLIGHTS) + " UNION ALL ".join(
    f"SELECT CANCELLED AS class, count(*) AS total_count, '{c}' AS \"column\","
    f" count(*) - count({c}) AS missing_count,"
    f" (count(*) - count({c})) * 100e0 / count(*) AS missing_percent FROM flights GROUP BY 1"
    for c in KINDS if c != "CANCELLED"))
def by_class(spark, sf_dir):
    return missing_by_class(_flights(spark, sf_dir), "CANCELLED")


def _corr_sql() -> str:
    """Correlations of the missing flags of all pairs of columns, where both flags change."""
    names = column_names(FLIGHT)
    flags = ", ".join(f"CAST({c} IS NULL AS DOUBLE) AS {c}" for c in names)
    pairs = ", ".join(f"{{'column_a': '{a}', 'column_b': '{b}', 'c': CASE WHEN var_pop({a}) > 0"
                      f" AND var_pop({b}) > 0 THEN corr({a}, {b}) END}}" for a, b in combinations(names, 2))
    return (f", flags AS (SELECT {flags} FROM flights), pairs AS (SELECT unnest([{pairs}]) AS x FROM flags)"
            f" SELECT x.column_a, x.column_b, {stable_sql('x.c')} AS correlation FROM pairs WHERE x.c IS NOT NULL")


@query("missing_corr", ctes(FLIGHTS) + _corr_sql())
def correlations(spark, sf_dir):
    """Every pair of columns that have gaps and are not empty throughout."""
    flights = _flights(spark, sf_dir).select(*column_names(FLIGHT))
    profile = missing_profile(flights).filter("missing_percent > 0 AND missing_percent < 100")
    gaps = {r["column"] for r in profile.collect()}  # one row per column
    table = missing_correlation(flights, [c for c in flights.columns if c in gaps])
    return table.select("column_a", "column_b", stable("correlation").alias("correlation"))


@query("column_means", ctes(FLIGHTS) + "SELECT " + ", ".join(
    f"{stable_sql(f'avg({c})')} AS {c}" for c in ("DEP_DELAY", "TAXI_OUT", "TAXI_IN", "DISTANCE")
) + " FROM flights")
def column_means(spark, sf_dir):
    names = ["DEP_DELAY", "TAXI_OUT", "TAXI_IN", "DISTANCE"]
    flights = _flights(spark, sf_dir)
    return flights.agg(*[F.avg(c).alias(c) for c in names]).select(
        *[stable(c).alias(c) for c in names]
    )


MODE_COLUMNS = ["OP_CARRIER", "ORIGIN", "DEST", "CANCELLATION_CODE"]


@query("column_modes", ctes(FLIGHTS) + " UNION ALL ".join(
    f"(SELECT '{c}' AS \"column\", {c} AS value, count(*) AS n FROM flights"
    f" WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY n DESC, value LIMIT 1)" for c in MODE_COLUMNS))
def column_modes(spark, sf_dir):
    return modes(_flights(spark, sf_dir), MODE_COLUMNS)


FILL_EXAMPLE = ["DEP_DELAY", "ARR_DELAY", "TAXI_OUT", "TAXI_IN"]


def _fill_sql(value: str) -> str:
    columns = ", ".join(
        f"{stable_sql(f'coalesce({c}, {value.format(c)})')} AS {c}" for c in FILL_EXAMPLE
    )
    return f"SELECT FL_DATE::VARCHAR AS FL_DATE, FlightNum, {columns} FROM renamed"


def _filled(df):
    return _text_dates(df).select(
        "FL_DATE", "FlightNum", *[stable(c).alias(c) for c in FILL_EXAMPLE]
    )


@query("filled_with_zero", ctes(FLIGHTS, RENAMED) + _fill_sql("0e0"))
def filled_with_zero(spark, sf_dir):
    return _filled(plans.fill_missing(_renamed(spark, sf_dir)))


@query("filled_with_mean", ctes(FLIGHTS, RENAMED) + _fill_sql("(SELECT avg({0}) FROM renamed)"))
def filled_with_mean(spark, sf_dir):
    return _filled(plans.fill_missing(_renamed(spark, sf_dir), FILL_EXAMPLE, "mean"))


def _strategy_sql() -> str:
    leaks = ", ".join(f"'{c}'" for c in plans.LEAKING_COLUMNS)
    return f"""strategy AS (
        SELECT "column", CASE
            WHEN missing_percent > 90 OR "column" IN ({leaks}) THEN 'drop'
            WHEN "column" = 'CANCELLATION_CODE' THEN 'keep_missing'
            WHEN "column" LIKE '%\\_DELAY' ESCAPE '\\' THEN 'fill_zero'
            WHEN data_type IN ('double', 'float', 'int', 'bigint') THEN CASE WHEN missing_percent < 5 THEN 'mean'
                WHEN missing_percent < 20 THEN 'median' ELSE 'zero' END
            WHEN data_type = 'string' THEN 'mode' ELSE 'keep' END AS strategy
        FROM profile WHERE missing_percent > 0)"""


@query("imputation_strategy", ctes(
    FLIGHTS, _profile_sql("flights", KINDS, "profile"), _strategy_sql()) + "SELECT * FROM strategy")
def imputation_strategy(spark, sf_dir):
    return plans.strategies(missing_profile(_flights(spark, sf_dir)))


@query("imputed", ctes(FLIGHTS) + f"""
    SELECT CAST(FL_DATE AS VARCHAR) AS FL_DATE, OP_CARRIER_FL_NUM,
        {stable_sql("coalesce(DIVERTED, (SELECT avg(DIVERTED) FROM flights))")} AS DIVERTED,
        {stable_sql("coalesce(CRS_ELAPSED_TIME, (SELECT avg(CRS_ELAPSED_TIME) FROM flights))")}
            AS CRS_ELAPSED_TIME,
        {stable_sql("coalesce(DISTANCE, (SELECT quantile_disc(DISTANCE, 0.5) FROM flights))")}
            AS DISTANCE,
        {stable_sql("coalesce(DEP_DELAY, 0)")} AS DEP_DELAY,
        {stable_sql("coalesce(TAXI_OUT, 0)")} AS TAXI_OUT,
        CANCELLATION_CODE FROM flights""")
def imputed(spark, sf_dir):
    filled = plans.impute(_flights(spark, sf_dir)).table
    numbers = ["DIVERTED", "CRS_ELAPSED_TIME", "DISTANCE", "DEP_DELAY", "TAXI_OUT"]
    return _text_dates(filled).select(
        "FL_DATE", "OP_CARRIER_FL_NUM", *[stable(c).alias(c) for c in numbers],
        "CANCELLATION_CODE",
    )


@query("imputation_report", ctes(
    FLIGHTS, _profile_sql("flights", KINDS, "profile"), _strategy_sql()) + """
    SELECT p."column", p.missing_percent AS missing_percent_before,
        CASE WHEN s.strategy = 'keep_missing' THEN p.missing_percent ELSE 0e0 END
            AS missing_percent_after,
        CASE WHEN s.strategy = 'keep_missing' THEN 0e0 ELSE p.missing_percent END AS reduction
    FROM profile p LEFT JOIN strategy s USING ("column")
    WHERE s.strategy IS DISTINCT FROM 'drop'""")
def imputation_report(spark, sf_dir):
    return plans.impute(_flights(spark, sf_dir)).comparison


@query("filled_with_mode", ctes(FLIGHTS) + """
    SELECT coalesce(CANCELLATION_CODE, (SELECT CANCELLATION_CODE FROM flights
        WHERE CANCELLATION_CODE IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS code,
        count(*) AS flights FROM flights GROUP BY 1""")
def filled_with_mode(spark, sf_dir):
    filled = plans.apply_strategy(_flights(spark, sf_dir), {"CANCELLATION_CODE": "mode"})
    return filled.groupBy(F.col("CANCELLATION_CODE").alias("code")).agg(
        F.count(F.lit(1)).alias("flights")
    )
