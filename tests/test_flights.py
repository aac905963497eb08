import pytest

from helpers import rows_of
from wayfare.operators.profiling import missing_correlation, missing_profile, modes
from wayfare.plans import flights as plans

NAN = float("nan")


@pytest.fixture(scope="module")
def gaps(spark):
    rows = [(None, 1.0, "x", 1, 0.0), (None, NAN, "y", 2, 0.0), (None, 3.0, "y", None, 1.0),
            (None, None, None, 4, 1.0)]
    return spark.createDataFrame(
        rows, "none string, half double, word string, whole int, full double"
    )


def test_profile(gaps):
    assert rows_of(missing_profile(gaps), "column", "missing_count", "missing_percent", "data_type") == [
        ("full", 0, 0.0, "double"), ("half", 2, 50.0, "double"), ("none", 4, 100.0, "string"),
        ("whole", 1, 25.0, "int"), ("word", 1, 25.0, "string"),
    ]


def test_constant_flags_have_no_correlation(gaps):
    found = {(a, b): c for a, b, c in rows_of(missing_correlation(gaps, ["none", "half", "word"]))}
    assert found["none", "half"] is None
    assert found["half", "word"] == pytest.approx(0.57735, abs=1e-5)


def test_strategy(spark):
    def row(name, percent, kind="double"):
        return name, float(percent), kind

    profile = spark.createDataFrame([
        row("a", 0.0), row("b", 90.1), row("AIR_TIME", 1.0), row("CANCELLATION_CODE", 50, "string"),
        row("X_DELAY", 50), row("c", 4.9), row("d", 5.0), row("e", 19.9, "int"), row("f", 20.0),
        row("g", 90.0), row("h", 3, "string"), row("i", 3, "date"),
        row("j", 3, "bigint"), row("k", 10, "float"), row("l", 30, "decimal(10,2)"),
    ], "column string, missing_percent double, data_type string")
    chosen = dict(plans.strategies(profile).collect())
    assert chosen == {
        "b": "drop", "AIR_TIME": "drop", "CANCELLATION_CODE": "keep_missing",
        "X_DELAY": "fill_zero", "c": "mean", "d": "median", "e": "median", "f": "zero",
        "g": "zero", "h": "mode", "i": "keep", "j": "mean", "k": "median", "l": "zero",
    }


def test_filling(gaps):
    filled = plans.apply_strategy(
        gaps, {"none": "drop", "half": "mean", "word": "mode", "whole": "median"}
    )
    assert "none" not in filled.columns
    assert rows_of(filled, "half", "word", "whole") == [
        (1.0, "x", 1), (2.0, "y", 2), (2.0, "y", 4), (3.0, "y", 2)
    ]
    zero = plans.apply_strategy(gaps, {"half": "zero"})
    assert rows_of(zero, "half") == [(0.0,), (0.0,), (1.0,), (3.0,)]


def test_mode_takes_the_least_of_equals(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,), (None,), (None,)], "c string")
    assert rows_of(modes(df, ["c"])) == [("c", "a", 2)]


def test_one_class_only(spark):
    df = spark.createDataFrame([(0,), (0,)], "label int")
    assert rows_of(plans.class_distribution(df)) == [(2, 0, 100.0, 0.0, None)]


def test_unknown_fill(gaps):
    with pytest.raises(ValueError):
        plans.fill_missing(gaps, ["half"], "median")


def test_absent_columns_are_skipped(spark):
    df = spark.createDataFrame([("AA", 1.5)], "OP_CARRIER string, DEP_DELAY double")
    renamed = plans.rename_columns(df)
    assert renamed.columns == ["UniqueCarrier", "DEP_DELAY"]
    assert plans.fill_missing(renamed).count() == 1
    assert plans.remove_leaks(renamed).columns == renamed.columns
