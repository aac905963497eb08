"""Streaming queries, run until their input is used up and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfare import schemas
from wayfare.operators.cleaning import clean_trips
from wayfare.plans import routes as route_plans
from wayfare.queries.base import (
    CLEAN,
    TRIPS,
    cell_500m_x_sql,
    cell_500m_y_sql,
    ctes,
    placed_of,
    query,
)
from wayfare.queries.files import DEBS_COLUMNS, debs_rows
from wayfare.queries.profit import ELEMENT, EMPTY, TAXIS, profit_sql
from wayfare.queries.routes import CLEAN_WINDOWS, TOTALS
from wayfare.session import scratch_path
from wayfare.sources import derived, files, messages
from wayfare.streaming import empty, ingest, late, profit, routes
from wayfare.streaming.run import (
    append_table,
    drain,
    progress,
    read_complete,
    read_updates,
    update_table,
)

PARTS = 3  # the trips arrive in so many parts, in the order of their dropoffs


def _places(spark, name: str) -> tuple[str, str]:
    base = scratch_path(spark, name)
    return f"{base}/table", f"{base}/checkpoint"


def _parts(rows):
    """The rows in PARTS parts of about equal size, by dropoff."""
    shares = [i / PARTS for i in range(1, PARTS)]
    cuts = rows.agg(F.percentile_approx("dropoff_unix", shares)).first()[0] or []
    number = sum([(F.col("dropoff_unix") >= c).cast("int") for c in cuts], F.lit(0))
    marked = rows.withColumn("part", F.coalesce(number, F.lit(0)))
    return [marked.filter(F.col("part") == i).drop("part") for i in range(len(cuts) + 1)]


def _arrived(spark, sf_dir, name: str, run) -> str:
    """The table that a stream of clean trips has written when all parts have arrived.

    `run(stream, table, checkpoint)` is started anew for every part, so every query here goes
    through several micro-batches, restarts and what it remembers of the part before.
    """
    table, checkpoint = _places(spark, name)
    source = scratch_path(spark, "arriving")
    rows = clean_trips(derived.trips(spark, sf_dir))
    for part in _parts(rows):
        part.write.mode("append").parquet(source)
        drain(run(ingest.file_stream(spark, source, rows.schema), table, checkpoint))
    return table


# -- messages to raw and clean tables -----------------------------------------------------

SHOWN_SQL = """hack_license, medallion, pickup_unix, dropoff_unix, trip_time_in_secs,
    trip_distance, pickup_longitude, dropoff_longitude, fare_amount, total_amount"""


def _shown(df):
    return df.select(
        "hack_license", "medallion",
        F.unix_seconds("pickup_datetime").alias("pickup_unix"),
        F.unix_seconds("dropoff_datetime").alias("dropoff_unix"),
        "trip_time_in_secs", "trip_distance", "pickup_longitude", "dropoff_longitude",
        "fare_amount", "total_amount",
    )


def _raw_table(spark, sf_dir) -> str:
    topic = scratch_path(spark, "topic")
    messages.publish_files(debs_rows(spark, sf_dir), topic, F.col("dropoff_datetime"))
    raw, checkpoint = _places(spark, "raw")
    drain(ingest.run_raw(ingest.message_files(spark, topic), schemas.TRIP_DEBS, raw, checkpoint))
    return raw


@query("stream_raw", ctes(TRIPS) + f"SELECT {SHOWN_SQL} FROM trips")
def stream_raw(spark, sf_dir):
    """Messages decoded into the raw table."""
    return _shown(files.read_table(spark, _raw_table(spark, sf_dir)))


@query("stream_clean", ctes(TRIPS, CLEAN) + f"SELECT {SHOWN_SQL} FROM clean")
def stream_clean(spark, sf_dir):
    """Messages to the raw table, and a second stream from there to the clean table."""
    raw = _raw_table(spark, sf_dir)
    schema = f"kafka_key string, kafka_timestamp timestamp, {schemas.TRIP_DEBS}"
    clean, checkpoint = _places(spark, "clean")
    drain(ingest.run_clean(ingest.file_stream(spark, raw, schema), clean, checkpoint))
    return _shown(files.read_table(spark, clean))


@query("stream_from_files", ctes(TRIPS) + """
    SELECT payment_type, count(*) AS trips FROM trips GROUP BY payment_type""")
def stream_from_files(spark, sf_dir):
    """One file at a time, to stand for data that arrives bit by bit."""
    source, (copy, checkpoint) = scratch_path(spark, "arriving"), _places(spark, "copy")
    rows = derived.trips(spark, sf_dir)
    for part in _parts(rows):
        part.write.mode("append").parquet(source)
    drain(append_table(ingest.file_stream(spark, source, rows.schema, max_files=1), copy, checkpoint))
    return files.read_table(spark, copy).groupBy("payment_type").agg(
        F.count(F.lit(1)).alias("trips")
    )


@query("stream_from_table", ctes(TRIPS, CLEAN) + f"SELECT {SHOWN_SQL} FROM clean")
def stream_from_table(spark, sf_dir):
    """A batch table copied to a table and streamed from there."""
    source = scratch_path(spark, "clean")
    rows = debs_rows(spark, sf_dir)
    files.write_table(clean_trips(rows), source)
    copy, checkpoint = _places(spark, "copy")
    stream = ingest.file_stream(spark, source, schemas.TRIP_DEBS)
    drain(append_table(stream.select(DEBS_COLUMNS), copy, checkpoint))
    return _shown(files.read_table(spark, copy))


@query("stream_progress", ctes(TRIPS) + "SELECT count(*) AS rows FROM trips")
def stream_progress(spark, sf_dir):
    """The rows that the progress reports of all micro-batches add up to."""
    copy, checkpoint = _places(spark, "copy")
    done = drain(append_table(derived.trip_stream(spark, sf_dir), copy, checkpoint, name=None))
    return spark.createDataFrame([(sum(p["rows"] for p in progress(done)),)], "rows bigint")


# -- routes -------------------------------------------------------------------------------


def _complete_windows(spark, sf_dir, slide=None):
    return read_complete(spark, _arrived(
        spark, sf_dir, "routes",
        lambda stream, table, checkpoint: routes.run_route_windows(
            stream, table, checkpoint, slide=slide)))


@query("stream_route_windows", CLEAN_WINDOWS + "SELECT * FROM windows")
def stream_route_windows(spark, sf_dir):
    """All windows with their routes, kept up to date in complete mode."""
    return _complete_windows(spark, sf_dir)


@query("stream_route_updates", CLEAN_WINDOWS + "SELECT * FROM windows")
def stream_route_updates(spark, sf_dir):
    """The same in update mode: each trigger writes only what changed."""
    keys = ["window_start", "window_end", "start_cell", "end_cell"]
    return read_updates(spark, _arrived(
        spark, sf_dir, "updates",
        lambda stream, *places: update_table(routes.route_windows(stream), *places)), keys)


@query("stream_routes_top10", CLEAN_WINDOWS + """
    SELECT * FROM windows WHERE window_end >= (SELECT max(window_end) FROM windows) - 1800
    ORDER BY number_of_rides DESC, window_start, start_cell, end_cell LIMIT 10""")
def stream_routes_top10(spark, sf_dir):
    return route_plans.latest_window_routes(_complete_windows(spark, sf_dir))


@query("stream_top_windows", CLEAN_WINDOWS + f""", {TOTALS}, ranked AS (
    SELECT w.*, row_number() OVER (PARTITION BY w.window_start
        ORDER BY number_of_rides DESC, start_cell, end_cell) AS rank
    FROM windows w JOIN top USING (window_start, window_end))
    SELECT t.window_start, t.window_end, CAST(n.rank AS INT) AS rank, r.start_cell, r.end_cell,
        r.number_of_rides
    FROM top t CROSS JOIN (SELECT unnest(range(1, 11)) AS rank) n
    LEFT JOIN ranked r ON r.window_start = t.window_start AND r.rank = n.rank""")
def stream_top_windows(spark, sf_dir):
    return route_plans.ranked_top_windows(_complete_windows(spark, sf_dir), ties=False)


CLOSED = "window_end <= (SELECT max(dropoff_unix) FROM clean) - {0}"


@query("stream_closed_windows", CLEAN_WINDOWS + f"SELECT * FROM windows WHERE {CLOSED.format(1800)}")
def stream_closed_windows(spark, sf_dir):
    """Append mode: a window is written once, when the watermark has passed its end."""
    return files.read_table(spark, _arrived(
        spark, sf_dir, "closed",
        lambda stream, *places: append_table(routes.route_windows(stream), *places)))


@query("stream_sliding_windows", CLEAN_WINDOWS + """
    SELECT w AS window_start, w + 1800 AS window_end, start_cell, end_cell,
        count(*) AS number_of_rides
    FROM (SELECT start_cell, end_cell, unnest(range(dropoff_unix - dropoff_unix % 300 - 1500,
        dropoff_unix - dropoff_unix % 300 + 1, 300)) AS w FROM routes)
    GROUP BY w, start_cell, end_cell""")
def stream_sliding_windows(spark, sf_dir):
    return _complete_windows(spark, sf_dir, slide="5 minutes")


CHANGE_PAIRS = [(f"start_cell_id_{i}", f"end_cell_id_{i}") for i in range(1, 11)]


@query("route_changes", ctes(TRIPS, CLEAN) + f""", cells AS (
    SELECT *, {cell_500m_x_sql('pickup_latitude', 'pickup_longitude')} AS sx,
        {cell_500m_y_sql('pickup_latitude')} AS sy,
        {cell_500m_x_sql('dropoff_latitude', 'dropoff_longitude')} AS ex,
        {cell_500m_y_sql('dropoff_latitude')} AS ey FROM clean),
    inside AS (SELECT *, sx || '.' || sy AS s, ex || '.' || ey AS e FROM cells
        WHERE sx IS NOT NULL AND sy IS NOT NULL AND ex IS NOT NULL AND ey IS NOT NULL),
    counted AS (SELECT dropoff_unix - dropoff_unix % 1800 AS w, s, e, count(*) AS n,
        max(pickup_unix) AS p, max(dropoff_unix) AS d FROM inside GROUP BY 1, 2, 3),
    closed AS (SELECT * FROM counted
        WHERE w + 1800 <= (SELECT max(dropoff_unix) FROM inside) - 1800),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY n DESC, s, e) AS r FROM closed),
    windows AS (SELECT w, string_agg(s || '>' || e, ',' ORDER BY s || '>' || e) AS entries,
        max(d) AS dropoff_unix, {', '.join(
            f"max(CASE WHEN r = {i + 1} THEN s END) AS {a}, max(CASE WHEN r = {i + 1} THEN e END) AS {b}"
            for i, (a, b) in enumerate(CHANGE_PAIRS))}
        FROM ranked WHERE r <= 10 GROUP BY w)
    SELECT w AS window_start, dropoff_unix, {', '.join(f'{a}, {b}' for a, b in CHANGE_PAIRS)}
    FROM (SELECT *, lag(entries) OVER (ORDER BY w) AS b FROM windows)
    WHERE entries IS DISTINCT FROM b""")
def route_changes(spark, sf_dir):
    """The change feed of the ten most frequent routes."""
    table = _arrived(spark, sf_dir, "changes", routes.run_route_changes)
    return files.read_table(spark, table).select(
        "window_start", F.unix_seconds("dropoff_datetime").alias("dropoff_unix"),
        *[c for pair in CHANGE_PAIRS for c in pair],
    )


# -- profit -------------------------------------------------------------------------------

PLACED = ctes(TRIPS, CLEAN, placed_of("clean"))


@query("stream_profit_by_cell", PLACED + """
    SELECT dropoff_unix - dropoff_unix % 900 AS window_start, CAST(sx AS INT) AS cell_x,
        CAST(sy AS INT) AS cell_y, quantile_disc(fare_plus_tip, 0.5) AS median_fare_tip
    FROM placed GROUP BY 1, 2, 3
    HAVING window_start + 900 <= (SELECT max(dropoff_unix) FROM placed) - 1200""")
def stream_profit_by_cell(spark, sf_dir):
    table = _arrived(spark, sf_dir, "profit",
                     lambda stream, *places: append_table(profit.profit_windows(stream), *places))
    return files.read_table(spark, table).select(
        "window_start", "cell_x", "cell_y", "median_fare_tip"
    )


CLOSED_TAXIS = "t.window_start + 1800 <= (SELECT max(dropoff_unix) FROM placed) - 2100"


@query("stream_taxis_by_cell", PLACED + f""", {TAXIS}
    SELECT window_start, window_start + 1800 AS window_end, cell_x, cell_y, empty_taxis
    FROM taxis t WHERE {CLOSED_TAXIS}""")
def stream_taxis_by_cell(spark, sf_dir):
    """Distinct taxis, counted by two aggregates in a row."""
    return files.read_table(spark, _arrived(
        spark, sf_dir, "taxis",
        lambda stream, *places: append_table(profit.taxi_windows(stream), *places)))


JOINED = PLACED + ", " + profit_sql(900, ELEMENT) + f""", {TAXIS}, joined AS (
    SELECT p.*, t.empty_taxis, p.median_fare_tip / t.empty_taxis AS profitability,
        p.cell_x || '.' || p.cell_y AS cell
    FROM profit p JOIN taxis t ON p.cell_x = t.cell_x AND p.cell_y = t.cell_y
        AND p.window_start - p.window_start % 1800 = t.window_start
    WHERE {CLOSED_TAXIS})"""


@query("stream_profitability", JOINED + """
    SELECT window_start, cell_x, cell_y, median_fare_tip, empty_taxis, profitability FROM joined""")
def stream_profitability(spark, sf_dir):
    """Windowed aggregates of one stream, joined within their time."""
    table = _arrived(spark, sf_dir, "profitability", lambda stream, *places: append_table(
        profit.profitability_windows(stream), *places))
    return files.read_table(spark, table).select(
        "window_start", "cell_x", "cell_y", "median_fare_tip", "empty_taxis", "profitability"
    )


PROFIT_SHOWN = {
    "profitable_cell_id": "cell",
    "empty_taxies_in_cell_id": "empty_taxis",
    "median_profit_in_cell_id": "median_fare_tip",
    "profitability_of_cell": "profitability",
}


@query("profit_changes", JOINED + f""", ranked AS (
    SELECT *, row_number() OVER (PARTITION BY window_start ORDER BY profitability DESC NULLS LAST,
        median_fare_tip DESC, cell) AS r FROM joined),
    windows AS (SELECT window_start, string_agg(cell, ',' ORDER BY r) AS entries,
        max(trigger_dropoff) AS dropoff_unix, {', '.join(
            f"max(CASE WHEN r = {i} THEN {c} END) AS {name}_{i}"
            for i in range(1, 11) for name, c in PROFIT_SHOWN.items())}
        FROM ranked WHERE r <= 10 GROUP BY window_start)
    SELECT * EXCLUDE (entries, b)
    FROM (SELECT *, lag(entries) OVER (ORDER BY window_start) AS b FROM windows)
    WHERE entries IS DISTINCT FROM b""")
def profit_changes(spark, sf_dir):
    """The change feed of the ten most profitable cells."""
    table = _arrived(spark, sf_dir, "changes", profit.run_profit_changes)
    return files.read_table(spark, table).select(
        "window_start", F.unix_seconds("dropoff_datetime").alias("dropoff_unix"),
        *[f"{name}_{i}" for i in range(1, 11) for name in PROFIT_SHOWN],
    )


# only closed ticks: the watermark is 35 minutes behind the latest dropoff
@query("stream_empty_taxis", PLACED + f", {EMPTY}" + """
    SELECT * FROM empties WHERE tick < (SELECT max(dropoff_unix) - 2100 FROM clean)""")
def stream_empty_taxis(spark, sf_dir):
    """Empty taxis per cell every quarter of an hour, from state kept per taxi; trips of any length."""
    return empty.empty_taxis_told(files.read_table(spark, _arrived(
        spark, sf_dir, "empty",
        lambda stream, *places: append_table(empty.taxi_claims(stream), *places))))


@query("stream_late_corrections", CLEAN_WINDOWS + f"SELECT * FROM windows WHERE {CLOSED.format(1800)}")
def stream_late_corrections(spark, sf_dir):
    """Trips in no order: windows closed by a stream, and the rows it was too late for, merged."""
    base, source = scratch_path(spark, "routed"), scratch_path(spark, "arriving")
    timely, gone, table = f"{base}/timely", f"{base}/late", f"{base}/closed"
    rows = clean_trips(derived.trips(spark, sf_dir))
    shuffled = rows.withColumn("part", F.pmod(F.xxhash64("trip_id"), F.lit(PARTS)))
    for i in range(PARTS):
        shuffled.filter(F.col("part") == i).drop("part").write.mode("append").parquet(source)
        arriving = ingest.file_stream(spark, source, rows.schema)
        drain(late.run_routed(arriving, timely, gone, f"{base}/checkpoint"))
        routed = ingest.file_stream(spark, timely, rows.schema).select(*rows.columns)
        drain(append_table(routes.route_windows(routed), table, f"{base}/windows"))
    keys = ["window_start", "window_end", "start_cell", "end_cell"]
    counted = route_plans.windowed_routes(spark.read.schema(rows.schema).parquet(gone))
    return late.corrected(files.read_table(spark, table), counted, keys, ["number_of_rides"])
