"""Registered queries: correlation, collinearity and time-series structure."""

from __future__ import annotations

from pyspark.sql import functions as F

from pluvia.operators import correlation as co
from pluvia.operators import structure as st
from pluvia.operators.calendar import densify
from pluvia.plans.settle import settle
from pluvia.sources import panel as pn
from pluvia.spec import COVARIATES, DEFAULT

VIF_SAMPLE = ["soil_wet_surf", "soil_wet_root", "tavg"]
WATCHED = {("soil_wet_surf", "soil_wet_root"): 0.8, ("rh", "soil_wet_surf"): 0.85, ("tmin", "tavg"): 0.85}


def _full(op, digits=6):
    return lambda spark, folder: settle(op(pn.full_panel(spark, folder)), digits)


def _dense(op, digits=6):
    return lambda spark, folder: settle(op(pn.dense_panel(spark, folder)), digits)


def _pairs(df):
    return co.correlation_pairs(df, ["rainfall", *COVARIATES])


def _logged(op):
    return lambda df: op(st.log_target(df))


def _both_lags(df):
    logged = st.log_target(df)
    return st.lag_correlation(logged, "rainfall").withColumn("scale", F.lit("raw")).unionByName(
        st.lag_correlation(logged, "log_target").withColumn("scale", F.lit("log")))


def _one_lag(df):
    logged = st.log_target(df)
    return st.adf_test(logged, "rainfall", "raw_daily", n_lags=1).unionByName(
        st.adf_test(logged, "log_target", "log_daily", n_lags=1)).drop("p_value", "crit_1", "crit_10")


def _events(spark, folder):
    """The same test on series with text keys."""
    events = densify(pn.event_panel(spark, folder))
    return settle(st.adf_test(events, "rainfall", "raw_daily", n_lags=1).drop("p_value", "crit_1", "crit_10"))


def _trend(df):
    return st.kpss_test(st.log_target(df), "log_target", "log_daily_trend", "ct", n_lags=7)


def _interpret(df):
    logged = st.log_target(df)
    return st.interpretation(
        st.significant_lags(st.lag_correlation(df, "rainfall", [1, 2, 7])), st.component_strength(st.decompose(df)),
        st.adf_test(logged, "log_target", "log_daily", n_lags=1), st.kpss_test(logged, "log_target", "log_daily_level"))


Q = {
    "g1_correlation_matrix": _full(_pairs),
    "g2_target_correlation": _full(lambda df: co.target_correlation(df, COVARIATES, top=6)),
    "g2_target_significance": _full(
        lambda df: co.correlation_significance(co.target_correlation(df, COVARIATES))),
    "g3_vif_three": _full(lambda df: co.variance_inflation(df, VIF_SAMPLE)),
    "g3_vif": _full(lambda df: co.variance_inflation(df, COVARIATES)),
    "g4_pair_regressions": _full(co.collinear_groups, 5),
    "g5_binned_trend": _full(lambda df: co.seasonal_trend(df, "rh"), 5),
    "g6_recommendations": _full(lambda df: co.recommendations(
        _pairs(df), co.variance_inflation(df, COVARIATES), "rainfall", WATCHED)),
    "h1_lag_correlation": _dense(_both_lags),
    "h1_significant_lags": _dense(lambda df: st.significant_lags(st.lag_correlation(df, "rainfall"))),
    "h2_autocorrelation": _dense(lambda df: st.autocorrelation(df, "rainfall")),
    "h2_autocorrelation_log": _dense(_logged(lambda df: st.autocorrelation(df, "log_target"))),
    "h2_autocorrelation_monthly": _dense(st.monthly_autocorrelation),
    "h3_partial_autocorrelation": _dense(lambda df: st.partial_autocorrelation(df, "rainfall")),
    "h4_lag_scatter": _dense(_logged(
        lambda df: st.lag_correlation(df, "log_target", st.SCATTER_LAGS).drop("n"))),
    "h5_decomposition": _dense(st.decompose, 5),
    "h6_component_strength": _dense(lambda df: st.component_strength(st.decompose(df))),
    "h7_adf_without_lags": _dense(lambda df: st.adf_without_lags(df, "rainfall")),
    "h7_adf_one_lag": _dense(_one_lag),
    "h7_adf_events": _events,
    "h7_adf_tests": _dense(st.adf_tests),
    "h8_kpss_level": _dense(lambda df: st.kpss_level(df, "rainfall")),
    "h8_kpss_trend": _dense(_trend),
    "h8_kpss_tests": _dense(st.kpss_tests),
    "h9_interpretation": _dense(_interpret),
}
