"""Physical plans: exchanges, joins and pruning of the main queries."""

import pytest

from pluvia.operators import features as ft
from pluvia.operators import forecast as fc
from pluvia.plans.catalogue import registered
from pluvia.plans.queries_panel import dense_split
from pluvia.sources import panel as pn

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_feature_table_has_one_exchange_by_series(spark):
    text = plan(ft.drop_warmup(ft.feature_table(pn.split_panel(spark, FOLDER))))
    assert text.count("Exchange hashpartitioning(series_id") == 1
    assert "SortMergeJoin" not in text


def test_baselines_do_not_shuffle_the_panel_again(spark):
    text = plan(fc.with_baselines(dense_split(spark, FOLDER)))
    # One for the panel, one for the train copy the climatology reads, one for its daily means.
    assert text.count("Exchange hashpartitioning(series_id") <= 4
    assert "Exchange SinglePartition" not in text.split("Subquery")[0]


@pytest.mark.parametrize("name", [
    "c3_densify", "d13_feature_table", "e5_wet_density", "f6_dry_spells", "f7_spell_start_months",
    "g1_correlation_matrix", "h2_autocorrelation", "h5_decomposition", "l1_metrics", "l9_regime_metrics",
    "o5_calibration_curve", "o6_crps"])
def test_no_cross_products(spark, name):
    text = plan(registered()[name](spark, FOLDER))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_scans_are_pruned(spark):
    text = plan(pn.dense_panel(spark, FOLDER))
    assert "ReadSchema: struct<l_suppkey:bigint,l_quantity:double,l_shipdate:timestamp_ntz>" in text
