"""Registered queries: analog ensemble, intervals, calibration, CRPS, conformal bounds."""

from __future__ import annotations

from pyspark.sql import functions as F

from pluvia.operators import uncertainty as un
from pluvia.plans.queries_forecast import predictions
from pluvia.plans.queries_panel import dense_split
from pluvia.plans.settle import settle


def ensemble(spark, folder):
    return un.analog_ensemble(dense_split(spark, folder))


def table(spark, folder):
    return un.interval_table(ensemble(spark, folder))


def _ens(op, digits=6):
    return lambda spark, folder: settle(op(ensemble(spark, folder)), digits)


def _tab(op, digits=6):
    return lambda spark, folder: settle(op(table(spark, folder)), digits)


SUMMARY = ["mean_log", "std_log", "mean_mm", "std_mm"]

Q = {
    "o1_analog_ensemble": _ens(un.explode_members),
    "o2_ensemble_summary": _ens(
        lambda df: un.summary(df).select("series_id", "date", "actual", *SUMMARY), 5),
    "o3_central_intervals": _ens(lambda df: un.intervals(df).drop("members"), 5),
    "o4_interval_stats": _tab(un.interval_stats),
    "o5_calibration_curve": _ens(un.calibration_curve),
    "o5_calibration_summary": _ens(un.calibration_summary),
    "o6_crps": _ens(lambda df: un.crps(df).drop("members")),
    "o7_crps_by_month": _ens(un.crps_by_month),
    "o7_crps_by_intensity": _ens(un.crps_by_intensity),
    "o8_width_histogram": _tab(un.width_histogram),
    "o8_monthly_spread": _tab(un.monthly_spread),
    "o9_exceedances": _tab(un.exceedances, 5),
    "o9_exceedance_counts": _tab(un.exceedance_counts),
    "o10_calibration_labels": _ens(lambda df: un.calibration_labels(un.calibration_curve(df))),
    "o10_season_ratio": _tab(un.season_uncertainty_ratio),
    "o11_conformal_intervals": lambda spark, folder: settle(
        un.conformal_intervals(predictions(spark, folder)).groupBy("model").agg(
            F.max("q").alias("q"), F.count("*").alias("n"),
            F.avg(F.col("actual").between(F.col("lower"), F.col("upper")).cast("double")).alias("coverage"),
            F.avg(F.col("upper") - F.col("lower")).alias("mean_width")), 5),
}
