"""Every registered query: against its SQL check, or run to the end where SQL has none."""

import oracle
import pytest

import __spark_entry__ as contract
from wayfare.queries import ORACLES, QUERIES

# long trainings are covered by test_models with the quicker models
SLOW = {"cancel_model_forest", "cancel_model_boosted", "cancel_cv_forest", "cancel_cv_boosted"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, tiny, duck, name):
    assert oracle.difference(QUERIES[name](spark, tiny), duck, ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - SLOW))
def test_runs(spark, tiny, name):
    assert QUERIES[name](spark, tiny).count() > 0


def test_contract(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).count() > 0


def test_a_missing_library_costs_the_optional_queries_only(monkeypatch):
    def absent(name):
        raise ModuleNotFoundError(name)

    monkeypatch.setattr(contract, "import_module", absent)
    assert set(contract.queries()) == set(QUERIES)
    assert set(contract.oracle_sql()) == set(ORACLES)
