"""Registered queries: selection, MLlib models, attributions and dependence.

The linear set and the grid search have the whole sizes, the other models small defaults
for a quick run; every fit and every prediction covers all rows of its split.
"""

from __future__ import annotations

from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvia.functions.exprs import melt
from pluvia.operators import correlation as co
from pluvia.operators import explain as ex
from pluvia.operators import features as ft
from pluvia.operators import models as mo
from pluvia.operators import selection as se
from pluvia.operators import uncertainty as un
from pluvia.plans.queries_panel import features
from pluvia.plans.settle import settle
from pluvia.session import scratch_path
from pluvia.spec import DEFAULT

ML_FEATURES = [
    "rh", "cloud", "soil_moisture_gradient", "temp_range", "rainfall_lag1", "rainfall_lag7",
    "rainfall_roll_mean_7", "pressure_rh_interaction", "month_sin", "month_cos",
]
SCORED = [
    "tmax", "tavg", "rh", "cloud", "soil_wet_surf", "soil_wet_root", "rainfall_lag1", "rainfall_lag7",
    "rainfall_roll_mean_7", "rainfall_roll_mean_14", "month_sin", "temp_range",
]
EXPLAINED = [
    "rh", "cloud", "soil_moisture_gradient", "rainfall_lag1", "rainfall_roll_mean_7", "pressure_rh_interaction",
]
CORR_LIMIT, MIN_GAIN = 0.65, 0.004
QUICK = {"trees": 8, "depth": 3, "rate": 0.2}
# Of the linear set's gain model: the whole size, as of ``gain_importance`` itself. The name is older than the size.
SMALL = {"trees": 300, "depth": 4, "rate": 0.05}


def inputs(spark: SparkSession, folder: str) -> DataFrame:
    """Scaled model input of all splits, written once for the fits.

    The features are written before, as the scaler and the scaled rows both read them.
    """
    return mo.fitted_rows(ft.model_inputs(narrow(spark, folder, ML_FEATURES), ML_FEATURES).dropna(), "inputs")


def narrow(spark: SparkSession, folder: str, columns: list[str]) -> DataFrame:
    """Some columns of the feature table, written once: several aggregates read them."""
    df = features(spark, folder)
    keep = list(dict.fromkeys([*DEFAULT.key, "split", *ft.TARGETS, *columns]))
    return mo.fitted_rows(df.select(*keep), "narrow-features")


# --- selection

def score_tables(df):
    """Names, gain and attribution tables from plain correlations: inputs for the set rules."""
    rows = se.analysis_rows(df, SCORED)
    scored = co.target_correlation(rows.withColumn("rainfall", F.expm1("log_rainfall")), SCORED)
    names = scored.select("feature")
    gain = se.rank_gain(scored.where(F.col("r_log") > 0).select("feature", F.abs("r").alias("gain")))
    attribution = scored.where(F.col("rank") <= 8).select(
        "feature", F.abs("r_log").alias("mean_abs"), F.col("rank").alias("attribution_rank"))
    return rows, names, gain, attribution


def j1(spark, folder):
    df = features(spark, folder)
    rows = se.analysis_rows(df, ft.feature_names(df))
    return rows.agg(
        F.lit(len(se.candidates(ft.feature_names(df)))).alias("n_candidates"),
        F.count("*").alias("n_rows"), F.sum("log_rainfall").alias("sum_target"))


def candidate_rows(spark, folder):
    """Complete train rows of all candidates, written once, and the candidates."""
    df = features(spark, folder)
    names = se.candidates(ft.feature_names(df))
    return mo.fitted_rows(se.analysis_rows(df, names), "candidate-rows"), names


def as_table(spark, names):
    return spark.createDataFrame([(n,) for n in names], "feature string")


def j2(spark, folder):
    rows, names = candidate_rows(spark, folder)
    return as_table(spark, se.correlation_filter(rows, names))


def selected_linear(spark, folder):
    """The linear set of all candidates by their own VIF, greedy filter and gain."""
    rows, names = candidate_rows(spark, folder)
    dropped = as_table(spark, se.correlation_filter(rows, names))
    return se.linear_set(as_table(spark, names), co.variance_inflation(rows, names), dropped,
                         se.gain_importance(rows, names, **SMALL))


def d15_linear(spark, folder):
    """The scaled linear set by split: rows, mean and deviation of every column."""
    chosen = {r["feature"] for r in selected_linear(spark, folder).collect()}  # names of columns
    df = mo.fitted_rows(features(spark, folder), "features")
    names = [c for c in ft.feature_names(df) if c in chosen]
    return melt(ft.model_inputs(df, names), ["split"], names, "feature", "x").groupBy("split", "feature").agg(
        F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))


def j5(spark, folder):
    rows, names, gain, _ = score_tables(narrow(spark, folder, SCORED))
    vif = co.variance_inflation(rows, ["soil_wet_surf", "soil_wet_root", "tavg"]).withColumn(
        "severity", F.when(F.col("vif") > 3, "Severe").otherwise("Low"))
    close = co.correlation_pairs(rows, SCORED).where(F.abs("r") > CORR_LIMIT)
    return se.linear_set(names, vif, close.select(F.col("feature_b").alias("feature")).distinct(), gain, MIN_GAIN)


def j6(spark, folder):
    _, names, gain, attribution = score_tables(narrow(spark, folder, SCORED))
    return se.ml_set(names, attribution, gain, top=6, min_gain=MIN_GAIN)


def d17_summary(spark, folder):
    df = narrow(spark, folder, SCORED)
    rows, names, gain, attribution = score_tables(df)
    vif = co.variance_inflation(rows, SCORED)
    linear = [r.feature for r in se.linear_set(names, vif, names.limit(0), gain, MIN_GAIN).collect()]
    ml = [r.feature for r in se.ml_set(names, attribution, gain, 6, MIN_GAIN).collect()]
    return ft.feature_summary(ft.feature_statistics(df, SCORED), vif, attribution, gain, linear, ml, [])


def d18(spark, folder):
    _, _, gain, attribution = score_tables(narrow(spark, folder, SCORED))
    return ft.merge_importance(attribution, gain)


def j3(spark, folder):
    train = mo.fitted_rows(se.analysis_rows(features(spark, folder), ML_FEATURES), "gain-rows")
    return se.gain_importance(train, ML_FEATURES, **QUICK)


def j4(spark, folder):
    return se.attribution_ranking(
        se.analysis_rows(features(spark, folder), ML_FEATURES), ML_FEATURES, **QUICK)


# --- models

def two_stage(rows):
    return mo.fit_two_stage(rows, ML_FEATURES, **QUICK)


def k3(spark, folder):
    rows = inputs(spark, folder)
    return two_stage(rows).predict(rows.where(F.col("split") != "train"))


def k4(spark, folder):
    _, scores = mo.tune_two_stage(inputs(spark, folder), ML_FEATURES)
    return spark.createDataFrame(scores, mo.SCORE_SCHEMA)


def k5(spark, folder):
    return mo.fit_seasonal_linear(features(spark, folder))[0].where(F.col("split") != "train")


def k5_orders(spark, folder):
    table = mo.fit_seasonal_linear(features(spark, folder))[1]
    return spark.createDataFrame(table, "ar_order int, aic double")


def k6(spark, folder):
    df = narrow(spark, folder, [*mo.EXOGENOUS, *ML_FEATURES])
    base, _ = mo.fit_seasonal_linear(df)
    return mo.hybrid_forecast(base, ft.model_inputs(df, ML_FEATURES), ML_FEATURES, **QUICK)


def k7(spark, folder):
    rows = inputs(spark, folder)
    return mo.store_predictions(
        spark, two_stage(rows), rows, scratch_path(spark, "two-stage-model"), scratch_path(spark, "store"))


def o1_bootstrap(spark, folder):
    rows = inputs(spark, folder)
    ensemble = mo.bootstrap_ensemble(rows, ML_FEATURES, members=4, trees=4, depth=3)
    return un.interval_table(ensemble)


# --- explanations

def wet_rows(df: DataFrame, split: str) -> DataFrame:
    wet = df.where((F.col("split") == split) & (F.col("rain_occurrence") == 1))
    return wet.select(*DEFAULT.key, "rainfall", "log_rainfall", *EXPLAINED).dropna()


def wet_model(spark, folder):
    df = narrow(spark, folder, EXPLAINED)
    train = wet_rows(df, "train")
    model = GBTRegressor(
        labelCol="log_rainfall", featuresCol="x", maxIter=QUICK["trees"], maxDepth=QUICK["depth"],
        stepSize=QUICK["rate"], seed=mo.SEED,
    ).fit(mo.assemble(train, EXPLAINED).select("x", "log_rainfall"))
    return model, train, wet_rows(df, "test")


def linear_case(spark: SparkSession, folder: str) -> tuple[ex.LinearFit, DataFrame]:
    """The linear model of all candidates on the wet train days, and the wet test days."""
    df = features(spark, folder)
    names = se.candidates(ft.feature_names(df))
    wet = df.where((F.col("rain_occurrence") == 1) & F.col("split").isin("train", "test"))
    rows = mo.fitted_rows(wet.select(*DEFAULT.key, "split", "rainfall", "log_rainfall", *names).dropna(), "wet-rows")
    return ex.fit_linear(rows.where("split = 'train'"), names, "log_rainfall"), rows.where("split = 'test'").drop("split")


def linear_phi(spark, folder):
    fit, rows = linear_case(spark, folder)
    return ex.linear_attributions(rows, fit.features, fit.parameters())


def n2_predictions(spark, folder):
    """The model's own predictions beside the base value plus the attributions."""
    fit, rows = linear_case(spark, folder)
    phi = ex.linear_attributions(rows, fit.features, fit.parameters())
    sums = phi.groupBy(*DEFAULT.key).agg((F.lit(fit.base) + F.sum("phi")).alias("base_and_phi"))
    scored = fit.predictor()(rows.withColumn("x", ex.feature_array(fit.features)))
    return scored.select(*DEFAULT.key, "prediction").join(sums, DEFAULT.key)


def n1(spark, folder):
    model, train, test = wet_model(spark, folder)
    return ex.shapley_values(test, train, model, EXPLAINED)


def n5(spark, folder):
    return ex.dependence(linear_phi(spark, folder), EXPLAINED, "rainfall_lag1")


def n5_trend(spark, folder):
    phi = linear_phi(spark, folder).where(F.col("feature") == "rainfall_roll_mean_7")
    return co.binned_trend(phi, "value", "phi", 10)


def n6(spark, folder):
    fit, rows = linear_case(spark, folder)
    return ex.local_cases(ex.linear_attributions(rows, fit.features, fit.parameters()), fit.base)


def n7_linear(spark, folder):
    fit, rows = linear_case(spark, folder)
    return ex.linear_dependence(rows, fit, EXPLAINED)


def n7(spark, folder):
    model, _, test = wet_model(spark, folder)
    return ex.cell_dependence(test, EXPLAINED, EXPLAINED, ex.model_predictor(model), ex.split_cuts(model, EXPLAINED))


def curves(spark, folder, n_rows=ex.ICE_ROWS):
    model, _, test = wet_model(spark, folder)
    return ex.individual_curves(
        test, EXPLAINED, EXPLAINED, ex.model_predictor(model), n_rows, cuts=ex.split_cuts(model, EXPLAINED))


def band(spark, folder):
    model, _, test = wet_model(spark, folder)
    return ex.cell_band(test, EXPLAINED, EXPLAINED, ex.model_predictor(model), ex.split_cuts(model, EXPLAINED))


def n9(spark, folder):
    model, _, test = wet_model(spark, folder)
    return ex.cell_dependence_2d(
        test, EXPLAINED, "cloud", "rh", ex.model_predictor(model), ex.split_cuts(model, EXPLAINED))


def _plain(fn, digits=6):
    return lambda spark, folder: settle(fn(spark, folder), digits)


Q = {
    "d17_feature_summary": _plain(d17_summary),
    "d18_merge_importance": _plain(d18),
    "j1_candidate_set": _plain(j1, 4),
    "j2_correlation_filter": _plain(j2),
    "j3_gain_importance": _plain(j3),
    "j4_attribution_ranking": _plain(j4),
    "j5_linear_set": _plain(j5),
    "j5_selected_linear": _plain(selected_linear),
    "d15_linear_inputs": _plain(d15_linear, 5),
    "j6_ml_set": _plain(j6),
    "k3_two_stage": _plain(k3),
    "k4_grid_search": _plain(k4),
    "k5_seasonal_linear": _plain(k5),
    "k5_order_selection": _plain(k5_orders),
    "k6_hybrid_forecast": _plain(k6),
    "k7_predict_and_store": _plain(k7),
    "n1_shapley_values": _plain(n1),
    "n2_linear_attributions": _plain(linear_phi, 5),
    "n2_linear_predictions": _plain(n2_predictions, 5),
    "n3_global_summary": _plain(lambda s, f: ex.global_summary(linear_phi(s, f))),
    "n4_normalised_values": _plain(lambda s, f: ex.normalised_values(linear_phi(s, f)), 5),
    "n5_dependence": _plain(n5, 5),
    "n5_dependence_trend": _plain(n5_trend, 5),
    "n6_local_cases": _plain(n6, 5),
    "n7_linear_dependence": _plain(n7_linear, 5),
    "n7_partial_dependence": _plain(n7),
    "n8_individual_curves": _plain(curves),
    "n8_curve_band": _plain(band),
    "n9_dependence_2d": _plain(n9),
    "o1_bootstrap_ensemble": _plain(o1_bootstrap),
}
