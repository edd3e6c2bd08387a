"""Shapes that must hold at any size: shuffles, joins, pushdown, no Python on base rows."""

import re

import pytest

from panelwise.catalog import QUERIES

FOLDER = "/root/testdata/sf0.001"
PYTHON_NODES = ("ArrowEvalPython", "BatchEvalPython", "MapInPandas", "FlatMapGroupsInPandas", "MapInArrow")
ON_RESULTS_ONLY = {"chisq_test", "fisher_2x2", "fisher_2x2_odds_ratio", "fisher_rx2", "fisher_rx2_five_levels", "study_one_row_chisq", "study_one_row_fisher"}


def plan(spark, key):
    df = QUERIES[key](spark, FOLDER)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", list(QUERIES))
def test_no_cross_product_and_no_python_on_rows(spark, key):
    fits = ("study_trends", "study_log", "study_behaviour", "study_masked", "study_baseline_predictors", "study_one_row_glm")
    if key.startswith(("gee", "glm", "trend", "predictor", "profile", "model_", "coef_ci", *fits)):
        pytest.skip("fits are actions; their passes are covered below")
    text = plan(spark, key)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    for node in PYTHON_NODES:
        if node in text:
            assert key in ON_RESULTS_ONLY
            # Python runs after the counts were aggregated.
            # The lowest Python node reads grouped rows, never those of the scan; aggregates may also stand above it.
            assert text.rindex(node) < text.rindex("HashAggregate") < text.rindex("FileScan")


def exchanges(text):
    return len(re.findall(r"Exchange (?:hash|range|round|Single)", text))


@pytest.mark.parametrize("key,most", [
    ("wilson_ci", 2), ("multi_table_two", 2), ("univariate_table_one", 3), ("group_pos_rate", 1), ("collapse_any", 1),
    ("first_nonnull", 1), ("first_per_id_random", 1), ("visits_from_wide", 1), ("unpivot_measures", 0), ("bin_cut", 0),
    ("safe_cast", 0), ("contingency_counts", 1), ("baseline_vs_post", 1), ("baseline_negative_followup", 2),
    ("lag_value", 1), ("incident_tests", 2), ("always_never", 2),
    # One shuffle of rows; the others join sums of cells, so that no test meets in one task.
    ("chisq_test", 11),
])
def test_number_of_shuffles(spark, key, most):
    assert exchanges(plan(spark, key)) <= most


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(spark, "filter_rows")
    assert "PushedFilters: [IsNotNull(o_orderpriority), IsNotNull(o_orderstatus)" in text or "EqualTo(o_orderstatus,P)" in text
    assert re.search(r"ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string,o_orderpriority:string>", text)
    assert "l_extendedprice" not in plan(spark, "fisher_2x2")


def test_window_is_never_without_partitions_on_rows(spark):
    for key in ("group_count_pct", "freq_1way_pct", "repeat_distribution"):
        assert "Window" not in plan(spark, key)


def test_one_pass_of_a_fit(spark):
    from panelwise.catalog.base import lines
    from panelwise.operators import design, gee
    from panelwise.operators.design import Model

    models = [Model("a", "y", ("qty",)), Model("b", "y", ("disc",), "binomial", "log")]
    frame = design.cells(lines(spark, FOLDER), models, "cl").persist()
    per = gee.cluster_sums(frame, models, {0: [-0.5, 0.0], 1: [-0.5, 0.0]}, 2)
    text = per._jdf.queryExecution().executedPlan().toString().split("InMemoryTableScan")[0]
    assert exchanges(text) == 1 and "partial_sum" in text and "InMemoryTableScan" in per._jdf.queryExecution().executedPlan().toString()
    frame.unpersist()
