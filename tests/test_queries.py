"""Registered queries against their SQL on the smallest tables, and the shape of their plans."""

import pytest

import __spark_entry__ as entry_points
from tableloom import plans
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
#: Long iterative queries, and those that need more rows; check.py runs them at the larger scale.
LONG = {
    "e02_dbscan_cores", "e02_dbscan_clusters", "f09_knn_classifier", "d04_local_outlier_factor", "d06_one_class_svm", "e03_hierarchical", "f02_random_forest",
    "f03_gradient_boosting", "f04_neural_network", "f05_kernel_regression", "f11_random_forest_classifier", "f12_gradient_boosting_classifier", "f13_kernel_classifier",
    "f16_perceptron_classifier", "f23_grid_search", "g09_class_learning_curve", "h02_bagging", "h07_boosting", "h09_ensemble_report", "h09_class_report", "i02_bootstrap_tree",
    "j01_tree_shapley", "j05_local_surrogate",
    # on a hundred customers or six thousand lines chance decides about these
    "e04_gaussian_mixture", "j06_permutation_importance",
}
CHECKED = sorted(set(plans.ORACLES) - LONG)


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
    assert len(plans.QUERIES) >= 264


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, con, name):
    problems = [p for p in compare(spark, con, plans.QUERIES[name], plans.ORACLES[name], SF) if p != "no rows"]
    assert not problems


@pytest.mark.parametrize("name", [
    "b08_conjunction_top", "c12_standard", "d01_zscore", "k04_t_test", "l03_retrain_advice", "p01_price_histogram", "q01_reference_lookup", "q04_scalar_broadcast",
    "q05_range_join", "q06_nearest_neighbours", "v06_request_pairs",
])
def test_no_pair_product(spark, name):
    plan = plans.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_filters_and_columns_reach_the_scan(spark):
    plan = plans.QUERIES["b07_closed_range"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(p_retailprice" in plan and "p_brand" not in plan.split("ReadSchema")[1]


def test_newest_is_a_top_k(spark):
    plan = plans.QUERIES["a04_newest_capped"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
