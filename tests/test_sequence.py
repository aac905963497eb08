import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from helpers import rows_of
from wayfare.operators.skew import attach_small, slice_borders, slice_number
from wayfare.operators.sequence import neighbour, next_value, previous_value
from wayfare.operators.totals import running_total


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(7)
    rows = []
    for i in range(600):
        key = rng.choice(["hot", "hot", "hot", None, "a", "b"])
        rows.append((key, rng.randrange(0, 5000), i, rng.choice([None, i])))
    rows.append(("single", 10, 1000, 1))
    return spark.createDataFrame(rows, "key string, at bigint, id bigint, v bigint").persist()


@pytest.mark.parametrize("limit", [1, 7, 100, 10_000])
@pytest.mark.parametrize("step", [-1, 1])
def test_slices_change_nothing(events, limit, step):
    window = Window.partitionBy("key").orderBy("at", "id")
    shift = F.lag if step < 0 else F.lead
    plain = events.withColumn("near", shift("v").over(window))
    sliced = neighbour(events, ["key"], ["at", "id"], "v", "near", step, limit)
    assert sliced.columns == plain.columns
    assert rows_of(sliced, "id", "near") == rows_of(plain, "id", "near")


def test_all_at_one_second(spark):
    rows = [("k", 5, i) for i in range(40)]
    df = spark.createDataFrame(rows, "key string, at bigint, id bigint")
    found = next_value(df, ["key"], ["at", "id"], "id", "after", limit=3)
    assert rows_of(found, "id", "after") == sorted([(i, i + 1) for i in range(39)] + [(39, None)])


@pytest.mark.parametrize("limit", [4, 10_000])
def test_one_line_without_keys(spark, limit):
    df = spark.range(0, 90, 3).select((F.col("id") * 7 % 90).alias("at"), "id")
    found = previous_value(df, [], ["at"], "at", "before", limit)
    order = sorted(r["at"] for r in df.collect())
    expected = dict(zip(order, [None, *order]))
    assert dict(rows_of(found, "at", "before")) == expected


def test_empty(spark):
    df = spark.createDataFrame([], "key string, at bigint, id bigint")
    assert previous_value(df, ["key"], ["at", "id"], "id", "before").count() == 0


def test_step_is_checked(events):
    with pytest.raises(ValueError):
        neighbour(events, ["key"], ["at"], "v", "near", 2)


@pytest.mark.parametrize("limit", [1, 5, 10_000])
def test_running_totals(spark, limit):
    rng = random.Random(9)
    values = {k: rng.sample(range(-500, 500), 60) for k in ("a", "b")}
    rows = [(k, v / 4, abs(v) % 7) for k, vs in values.items() for v in vs]
    df = spark.createDataFrame(rows, "key string, v double, n bigint")
    found = running_total(df, ["key"], "v", "n", "below", "total", limit)
    expected = [
        (k, v, sum(n2 for k2, v2, n2 in rows if k2 == k and v2 < v),
         sum(n2 for k2, _, n2 in rows if k2 == k))
        for k, v, _ in rows
    ]
    assert rows_of(found, "key", "v", "below", "total") == sorted(expected)


@pytest.mark.parametrize("order", [["at", "id"], ["value"]])
def test_slices_hold_equally_many_rows(spark, order):
    """A burst, a tie of thousands and one outlier, as a time line and as values."""
    limit, n = 1000, 40_000
    burst = F.when(F.col("id") < n // 2, F.lit(5)).otherwise(F.col("id") % 700)
    rows = spark.range(n).select(F.lit("hot").alias("key"), burst.alias("at"), "id",
                                 F.exp(-F.col("id") / 1000.0).alias("value"))
    far = spark.createDataFrame([("hot", 10**12, n, 1e9), ("cold", 1, n + 1, 0.5)], rows.schema)
    df = rows.unionByName(far)
    borders = slice_borders(df, ["key"], order, limit)
    assert [r["key"] for r in borders.collect()] == ["hot"]
    sizes = attach_small(df, borders, ["key"]).groupBy("key", slice_number(order)).count()
    counts = [r["count"] for r in sizes.collect()]
    assert max(counts) <= 2 * limit and len(counts) >= n // (2 * limit)
