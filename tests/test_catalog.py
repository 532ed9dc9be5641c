"""Every catalogued query against its DuckDB statement."""

import compare
import pytest

import __spark_entry__ as entry_points
from oracle import STATEMENTS as ORACLE
from tillview.plans.catalog import all_queries

FOLDER = "/root/testdata/sf0.001"
QUERIES, STATEMENTS = all_queries(), ORACLE
# model quality and samples have no SQL counterpart; tests/test_ml.py covers them
WITHOUT_SQL = {
    "churn_train",
    "churn_score_batch",
    "churn_model_factors",
    "churn_model_report",
    "churn_holdout_eval",
}


@pytest.fixture(scope="module")
def con():
    return compare.connect(FOLDER)


def test_every_query_has_a_statement():
    assert set(QUERIES) - set(STATEMENTS) == WITHOUT_SQL
    assert set(STATEMENTS) <= set(QUERIES)
    assert set(QUERIES) <= set(entry_points.queries())
    assert set(STATEMENTS) <= set(entry_points.oracle_sql())


@pytest.mark.parametrize("name", sorted(STATEMENTS))
def test_matches_sql(spark, con, name):
    assert compare.difference(QUERIES[name](spark, FOLDER), STATEMENTS[name], con) is None


def test_entry_has_segments(spark):
    assert entry_points.entry(spark).count() > 3
