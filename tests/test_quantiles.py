import math
import random

import pytest
from pyspark.sql import functions as F

from helpers import rows_of
from wayfare.operators.intervals import TICKS_PER_ROW, count_changes, counts_at_ticks, minute_ticks
from wayfare.operators.profiling import quantiles, summary
from wayfare.operators.quantiles import exact_quantiles
from wayfare.plans import profit

SHARES = [0.0, 0.25, 0.5, 0.9, 1.0]


def plain(values, shares=SHARES):
    known = sorted(v for v in values if v is not None and not math.isnan(v))
    return [known[max(1, math.ceil(s * len(known))) - 1] for s in shares] if known else None


@pytest.mark.parametrize("limit, bins", [(0, 256), (4096, 1024)])
def test_quantiles_of_groups(spark, limit, bins):
    rng = random.Random(7)
    groups = {
        "one": [4.5], "none": [None, None], "same": [7.0] * 50, "ties": [float(rng.randrange(4)) for _ in range(200)],
        "gap": [1.0, None, 5.0, math.nan], "signs": [rng.gauss(0, 1) for _ in range(300)],
        "far": [10.0 ** rng.randrange(-300, 300) for _ in range(120)] + [-1.7e308, 1.7e308], None: [2.0, 1.0, 3.0],
    }
    rows = [(g, v) for g, values in groups.items() for v in values]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double")
    found = exact_quantiles(df, ["g"], "v", SHARES, F.count(F.lit(1)).alias("rows"), limit=limit, bins=bins)
    assert found.columns == ["g", "rows", "quantiles"]
    got = {r["g"]: (r["rows"], r["quantiles"]) for r in found.collect()}
    assert got == {g: (len(values), plain(values)) for g, values in groups.items()}


def test_quantiles_above_the_sketch(spark):
    """40,000 different values, most of them in one narrow stretch: exact, with and without groups."""
    df = spark.range(40_000).select((F.col("id") * 7919 % 40_000).alias("id")).select(
        F.when(F.col("id") < 39_000, F.col("id") / 1e6).otherwise(F.col("id").cast("double")).alias("v"))
    values = [i / 1e6 if i < 39_000 else float(i) for i in range(40_000)]
    assert exact_quantiles(df, [], "v", SHARES).first()["quantiles"] == plain(values)
    assert quantiles(df, ["v"], [0.5])["v"] == [values[19_999]]
    table = {r["statistic"]: r["v"] for r in summary(df, ["v"]).collect()}
    assert [table[x] for x in ("25%", "50%", "75%")] == plain(values, [0.25, 0.5, 0.75])
    assert exact_quantiles(df.filter("false"), [], "v", SHARES).first()["quantiles"] is None


def test_median_of_a_large_cell_is_exact(spark):
    placed = spark.range(12_001).select(
        F.lit("t").alias("medallion"), F.lit(100).cast("long").alias("pickup_unix"), F.lit(200).cast("long").alias("dropoff_unix"),
        F.lit(1).alias("start_cell_x"), F.lit(2).alias("start_cell_y"), F.col("id").cast("double").alias("fare_plus_tip"))
    assert rows_of(profit.profit_by_cell(placed), "window_start", "median_fare_tip", "trigger_dropoff") == [(0, 6000.0, 200)]


def test_sketches_of_quarters_give_half_hours(spark):
    placed = spark.range(30_000).select(
        (F.col("id") % 9000).cast("string").alias("medallion"), (F.col("id") % 3600).alias("dropoff_unix"),
        (F.col("id") % 3).cast("int").alias("end_cell_x"), F.lit(1).alias("end_cell_y"))
    exact = {r[:3]: r[3] for r in map(tuple, profit.taxis_by_cell(placed).collect())}
    found = {r[:3]: r[3] for r in map(tuple, profit.taxis_from_sketches(profit.taxi_sketches(placed)).collect())}
    assert found.keys() == exact.keys() and {k[0] for k in exact} == {0, 1800}
    for key, n in exact.items():
        assert abs(found[key] - n) <= max(0.5, 4 * profit.SKETCH_ERROR * n)


def test_ticks_in_stretches(spark):
    df = spark.createDataFrame([(100,), (100 + 60 * (TICKS_PER_ROW + 5) + 1,)], "at long")
    assert [r[0] for r in rows_of(minute_ticks(df, "at"))] == [100 + 60 * i for i in range(TICKS_PER_ROW + 7)]
    assert minute_ticks(df.filter("false"), "at").count() == 0


@pytest.mark.parametrize("span, step", [(1800, 60), (100, 7), (5, 60)])
def test_counts_from_change_points(spark, span, step):
    rng = random.Random(span)
    rows = [(rng.choice("ab"), rng.randrange(0, 4000)) for _ in range(60)] + [("c", None), ("c", 17)] + [("d", 20)] * 5
    df = spark.createDataFrame(rows, "g string, at long")
    times = [t for _, t in rows if t is not None]
    ticks = range(min(times), max(times) + step, step)
    want = sorted((t, g, n) for t in ticks for g in "abcd"
                  if (n := sum(x == g and a is not None and t - span <= a <= t for x, a in rows)))
    assert rows_of(counts_at_ticks(df, "at", ["g"], span, step)) == want
    changes = count_changes(df, "at", ["g"], span, step)
    assert changes.count() <= 2 * len(times)
