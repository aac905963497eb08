import pytest
from pyspark.sql import functions as F

from helpers import rows_of
from wayfare.operators.skew import attach_small, hot_groups, salted_join


@pytest.fixture(scope="module")
def sides(spark):
    big = spark.range(1000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot"))
        .when(F.col("id") % 7 == 0, F.lit(None))
        .otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string")))
        .alias("key"),
        "id",
    )
    small = spark.createDataFrame(
        [("hot", 1), ("hot", 2), *[(f"k{i}", i) for i in range(40)], ("unused", 9)],
        "key string, v int",
    )
    return big, small


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("limit", [5, 100, 10_000])
def test_same_as_plain_join(sides, how, limit):
    big, small = sides
    plain = big.join(small, "key", how)
    assert rows_of(salted_join(big, small, ["key"], how, limit)) == rows_of(plain)


def test_hot_key_is_spread(sides):
    big, small = sides
    hot = hot_groups(big, ["key"], 100)
    assert [r["key"] for r in hot.collect() if r["key"]] == ["hot"]


def test_null_keys_are_attached(spark):
    df = spark.createDataFrame([("a", 1), (None, 2), ("c", 3)], "key string, v int")
    names = spark.createDataFrame([("a", "A"), (None, "none")], "key string, name string")
    assert rows_of(attach_small(df, names, ["key"]), "v", "name") == [
        (1, "A"), (2, "none"), (3, None)
    ]
