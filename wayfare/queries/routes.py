"""Frequent-route queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfare.functions.times import window_start
from wayfare.operators.cleaning import clean_trips, located_trips
from wayfare.operators.intervals import minute_ticks
from wayfare.operators.ranking import rank_template, slice_rows, top_k
from wayfare.plans import routes as plans
from wayfare.queries.base import (
    CLEAN,
    LOCATED,
    TRIPS,
    cell_500m_x_sql,
    cell_500m_y_sql,
    ctes,
    query,
    routes_of,
)
from wayfare.sources import derived

SIX_HOURS = 6 * 3600


def _located(spark, sf_dir):
    return located_trips(derived.trips(spark, sf_dir))


def _clean(spark, sf_dir):
    return clean_trips(derived.trips(spark, sf_dir))


def windows_sql(table: str, size: int = 1800) -> str:
    return f"""windows AS (
        SELECT dropoff_unix - dropoff_unix % {size} AS window_start,
            dropoff_unix - dropoff_unix % {size} + {size} AS window_end,
            start_cell, end_cell, count(*) AS number_of_rides
        FROM {table} GROUP BY ALL)"""


LOCATED_ROUTES = ctes(TRIPS, LOCATED, routes_of("located"))
CLEAN_WINDOWS = ctes(TRIPS, CLEAN, routes_of("clean"), windows_sql("routes"))


@query("route_counts", LOCATED_ROUTES + """
    SELECT start_cell, end_cell, count(*) AS num_rides FROM routes GROUP BY start_cell, end_cell""")
def route_counts(spark, sf_dir):
    return plans.route_counts(plans.with_degree_cells(_located(spark, sf_dir)))


@query("window_counts", ctes(TRIPS, LOCATED) + """
    SELECT dropoff_unix - dropoff_unix % 1800 AS window_start, count(*) AS num_rides
    FROM located GROUP BY 1""")
def window_counts(spark, sf_dir):
    return plans.window_counts(_located(spark, sf_dir))


@query("peak_window", ctes(TRIPS, LOCATED) + """
    SELECT dropoff_unix - dropoff_unix % 1800 AS window_start, count(*) AS num_rides
    FROM located GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1""")
def peak_window(spark, sf_dir):
    return plans.peak_window(_located(spark, sf_dir))


def _peak_sql(size: int) -> str:
    return LOCATED_ROUTES + f""",
    peak AS (SELECT dropoff_unix - dropoff_unix % {size} AS w FROM located
        GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
    SELECT start_cell, end_cell, count(*) AS num_rides FROM routes, peak
    WHERE dropoff_unix >= w AND dropoff_unix < w + {size} AND start_cell <> end_cell
    GROUP BY start_cell, end_cell ORDER BY num_rides DESC, start_cell, end_cell LIMIT 10"""


@query("peak_window_routes", _peak_sql(1800))
def peak_window_routes(spark, sf_dir):
    return plans.peak_window_routes(derived.trips(spark, sf_dir))


@query("peak_six_hours_routes", _peak_sql(SIX_HOURS))
def peak_six_hours_routes(spark, sf_dir):
    return plans.peak_window_routes(derived.trips(spark, sf_dir), size=SIX_HOURS)


@query("recent_routes", ctes(TRIPS, CLEAN, routes_of("clean")) + """
    SELECT start_cell, end_cell, count(*) AS num_rides FROM routes
    WHERE dropoff_unix > (SELECT max(dropoff_unix) FROM clean) - 1800
    GROUP BY start_cell, end_cell ORDER BY num_rides DESC, start_cell, end_cell LIMIT 10""")
def recent_routes(spark, sf_dir):
    return plans.recent_routes(_clean(spark, sf_dir))


@query("recent_day_routes", ctes(TRIPS, CLEAN, routes_of("clean")) + """
    SELECT start_cell, end_cell, count(*) AS num_rides FROM routes
    WHERE dropoff_unix > (SELECT max(dropoff_unix) FROM clean) - 86400
    GROUP BY start_cell, end_cell ORDER BY num_rides DESC, start_cell, end_cell LIMIT 10""")
def recent_day_routes(spark, sf_dir):
    return plans.recent_routes(_clean(spark, sf_dir), minutes=24 * 60)


@query("windowed_routes", CLEAN_WINDOWS + "SELECT * FROM windows")
def windowed_routes(spark, sf_dir):
    return plans.windowed_routes(_clean(spark, sf_dir))


@query("windowed_route_details", ctes(TRIPS, CLEAN) + f""", cells AS (
    SELECT *, {cell_500m_x_sql('pickup_latitude', 'pickup_longitude')} AS sx,
        {cell_500m_y_sql('pickup_latitude')} AS sy,
        {cell_500m_x_sql('dropoff_latitude', 'dropoff_longitude')} AS ex,
        {cell_500m_y_sql('dropoff_latitude')} AS ey FROM clean)
    SELECT dropoff_unix - dropoff_unix % 1800 AS window_start,
        sx || '.' || sy AS start_cell, ex || '.' || ey AS end_cell,
        count(*) AS number_of_rides, max(pickup_unix) AS latest_pickup,
        max(dropoff_unix) AS latest_dropoff
    FROM cells WHERE sx IS NOT NULL AND sy IS NOT NULL AND ex IS NOT NULL AND ey IS NOT NULL
    GROUP BY 1, 2, 3""")
def windowed_route_details(spark, sf_dir):
    placed = plans.with_500m_cells(_clean(spark, sf_dir))
    return placed.groupBy(
        window_start("dropoff_unix", 1800).alias("window_start"), "start_cell", "end_cell"
    ).agg(
        F.count(F.lit(1)).alias("number_of_rides"),
        F.max("pickup_unix").alias("latest_pickup"),
        F.max("dropoff_unix").alias("latest_dropoff"),
    )


@query("latest_window_routes", CLEAN_WINDOWS + """
    SELECT * FROM windows WHERE window_end >= (SELECT max(window_end) FROM windows) - 1800
    ORDER BY number_of_rides DESC, window_start, start_cell, end_cell LIMIT 10""")
def latest_window_routes(spark, sf_dir):
    return plans.latest_window_routes(plans.windowed_routes(_clean(spark, sf_dir)))


TOTALS = """totals AS (
    SELECT window_start, window_end, CAST(sum(number_of_rides) AS BIGINT) AS total_rides
    FROM windows GROUP BY window_start, window_end),
    top AS (SELECT * FROM totals WHERE total_rides = (SELECT max(total_rides) FROM totals))"""


@query("top_windows", CLEAN_WINDOWS + f", {TOTALS} SELECT * FROM top")
def top_windows(spark, sf_dir):
    return plans.top_windows(plans.windowed_routes(_clean(spark, sf_dir)))


def _ranked_sql(rank: str, order: str) -> str:
    return CLEAN_WINDOWS + f""", {TOTALS}, ranked AS (
        SELECT w.*, {rank} OVER (PARTITION BY w.window_start ORDER BY {order}) AS rank
        FROM windows w JOIN top USING (window_start, window_end))
    SELECT t.window_start, t.window_end, CAST(n.rank AS INT) AS rank, r.start_cell, r.end_cell,
        r.number_of_rides
    FROM top t CROSS JOIN (SELECT unnest(range(1, 11)) AS rank) n
    LEFT JOIN ranked r ON r.window_start = t.window_start AND r.rank = n.rank"""


@query("ranked_top_windows", _ranked_sql("rank()", "number_of_rides DESC"))
def ranked_top_windows(spark, sf_dir):
    return plans.ranked_top_windows(plans.windowed_routes(_clean(spark, sf_dir)))


@query("ranked_top_windows_unique", _ranked_sql("row_number()", "number_of_rides DESC, start_cell, end_cell"))
def ranked_top_windows_unique(spark, sf_dir):
    return plans.ranked_top_windows(plans.windowed_routes(_clean(spark, sf_dir)), ties=False)


@query("rank_template", CLEAN_WINDOWS + f""", {TOTALS}
    SELECT window_start, CAST(n.rank AS INT) AS rank
    FROM top CROSS JOIN (SELECT unnest(range(1, 11)) AS rank) n""")
def template(spark, sf_dir):
    top = plans.top_windows(plans.windowed_routes(_clean(spark, sf_dir)))
    return rank_template(top.select("window_start"), 10)


@query("minute_ticks", ctes(TRIPS, LOCATED) + """
    SELECT unnest(range((SELECT min(dropoff_unix) FROM located),
        (SELECT max(dropoff_unix) FROM located) + 60, 60)) AS tick""")
def ticks(spark, sf_dir):
    return minute_ticks(_located(spark, sf_dir), "dropoff_unix")


ROLLING = LOCATED_ROUTES + """, ticks AS (
    SELECT unnest(range((SELECT min(dropoff_unix) FROM located),
        (SELECT max(dropoff_unix) FROM located) + 60, 60)) AS tick),
    rolling AS (SELECT tick, start_cell, end_cell, count(*) AS num_rides
        FROM routes JOIN ticks ON dropoff_unix >= tick - 1800 AND dropoff_unix <= tick
        GROUP BY tick, start_cell, end_cell),
    ranks AS (SELECT *, row_number() OVER (
        PARTITION BY tick ORDER BY num_rides DESC, start_cell, end_cell) AS r FROM rolling)"""


@query("rolling_counts", ROLLING + "SELECT * FROM rolling")
def rolling_counts(spark, sf_dir):
    return plans.rolling_counts(_located(spark, sf_dir))


@query("rolling_ranks_with_ties", ROLLING + """
    SELECT * FROM (SELECT *, CAST(rank() OVER (PARTITION BY tick ORDER BY num_rides DESC) AS INT)
        AS rank FROM rolling) WHERE rank <= 10""")
def rolling_ranks_with_ties(spark, sf_dir):
    return plans.rolling_ranks(_located(spark, sf_dir), ties=True)


@query("rolling_routes", ROLLING + "SELECT tick, " + ", ".join(
    f"max(CASE WHEN r = {i} THEN start_cell END) AS start_cell_id_{i},"
    f" max(CASE WHEN r = {i} THEN end_cell END) AS end_cell_id_{i}" for i in range(1, 11)
) + ", 0 AS delay FROM ranks WHERE r <= 10 GROUP BY tick")
def rolling_routes(spark, sf_dir):
    return plans.rolling_routes(_located(spark, sf_dir))


@query("rolling_changes", ROLLING + """, sets AS (
    SELECT tick, string_agg(start_cell || '>' || end_cell, ',' ORDER BY start_cell || '>' || end_cell)
        AS routes FROM ranks WHERE r <= 10 GROUP BY tick)
    SELECT tick, routes FROM (SELECT *, lag(routes) OVER (ORDER BY tick) AS b FROM sets)
    WHERE routes IS DISTINCT FROM b""")
def rolling_changes(spark, sf_dir):
    return plans.rolling_changes(_located(spark, sf_dir))


@query("route_slice", LOCATED_ROUTES + """
    SELECT start_cell, end_cell, count(*) AS num_rides FROM routes GROUP BY start_cell, end_cell
    ORDER BY num_rides DESC, start_cell, end_cell LIMIT 25 OFFSET 10""")
def route_slice(spark, sf_dir):
    counts = plans.route_counts(plans.with_degree_cells(_located(spark, sf_dir)))
    return slice_rows(counts, 10, 25, *plans.route_order())


@query("busiest_windows", CLEAN_WINDOWS + """
    SELECT * FROM windows
    ORDER BY window_end DESC, number_of_rides DESC, start_cell, end_cell LIMIT 20""")
def busiest_windows(spark, sf_dir):
    windows = plans.windowed_routes(_clean(spark, sf_dir))
    return top_k(windows, 20, F.desc("window_end"), *plans.route_order("number_of_rides"))
