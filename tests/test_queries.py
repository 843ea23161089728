"""Every registered query with SQL agrees with DuckDB at sf0.001; the others give rows."""

import pytest

from conftest import SF
from oracle import compare, connect
from riskbench import catalog

SLOW = {"model_logreg", "model_trees", "model_boosted_trees", "model_svm_rbf", "model_mlp", "model_importance_top",
        "score_batch", "select_greedy", "select_support_mask"}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n in catalog.SQL])
def test_sql(spark, con, name):
    assert compare(spark, con, catalog.QUERIES[name], catalog.SQL[name], SF) is None


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n not in catalog.SQL and n not in SLOW])
def test_rows(spark, name):
    assert not catalog.QUERIES[name](spark, SF).isEmpty()
