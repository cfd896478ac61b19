"""Registered queries: baseline forecasts, scores and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvia.operators import evaluate as ev
from pluvia.operators import forecast as fc
from pluvia.plans.queries_panel import dense_split
from pluvia.plans.settle import settle
from pluvia.session import scratch_path
from pluvia.sources import tables as tb
from pluvia.spec import DEFAULT

MODELS = ["persistence", "climatology", "hybrid"]


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Long table of the three SQL-expressible models, all over the same days."""
    wide = fc.carried_residual(fc.with_baselines(dense_split(spark, folder)))
    return fc.long_predictions(wide, MODELS)


def comparison(spark, folder):
    return ev.comparison_table(predictions(spark, folder))


def stored_predictions(spark, folder):
    path = scratch_path(spark, "predictions")
    tb.write_predictions(predictions(spark, folder), path)
    return path


def a4_comparison_csv(spark, folder):
    path = scratch_path(spark, "comparison-csv")
    tb.write_csv(comparison(spark, folder).select("model", "rmse", "mae", "nse", "rank"), path)
    text = tb.read_csv(spark, path, ["model", "rmse", "mae", "nse", "rank"])
    return text.select("model", *[F.col(c).try_cast("double").alias(c) for c in ("rmse", "mae", "nse")],
                       F.col("rank").try_cast("bigint").alias("rank"))


def a6_prediction_store(spark, folder):
    store = stored_predictions(spark, folder)
    return tb.load_predictions(spark, store, ["persistence", "hybrid", "lstm"], split="test").select(
        "model", "split", "series_id", "date", "actual", "predicted")


def k6_hybrid_combine(spark, folder):
    wide = fc.with_baselines(dense_split(spark, folder))
    base = fc.long_predictions(wide, ["climatology"])
    known = wide.withColumn("_r", fc.log_residual(F.col("rainfall"), F.col("climatology")))

    seen = F.row_number().over(DEFAULT.ordered("split"))
    hats = known.withColumns({
        "residual": F.lag("_r").over(DEFAULT.ordered()) * 0.5, "_seen": seen,
    }).where(F.col("_seen") > 60)
    return fc.hybrid_combine(base, hats)


def l6_merge_comparisons(spark, folder):
    preds = predictions(spark, folder)
    first = ev.comparison_table(preds.where(F.col("model") != "hybrid"))
    second = ev.comparison_table(preds.where(F.col("model") != "persistence"))
    return ev.merge_comparisons(first, second).select("model", "rank", "rmse", "mae", "nse")


def on(op, digits=6):
    return lambda spark, folder: settle(op(predictions(spark, folder)), digits)


def on_table(op, digits=6):
    return lambda spark, folder: settle(op(comparison(spark, folder)), digits)


def plain(fn, digits=6):
    return lambda spark, folder: settle(fn(spark, folder), digits)


Q = {
    "a4_comparison_csv": plain(a4_comparison_csv),
    "a6_prediction_store": plain(a6_prediction_store, 5),
    "k1_persistence": plain(lambda s, f: fc.persistence(dense_split(s, f))),
    "k2_climatology": plain(lambda s, f: fc.climatology_forecast(dense_split(s, f))),
    "k6_hybrid_combine": plain(k6_hybrid_combine, 5),
    "l1_metrics": on(ev.metrics),
    "l2_season_metrics": on(ev.season_metrics),
    "l3_extreme_metrics": on(ev.extreme_metrics),
    "l4_comparison_table": plain(comparison),
    "l5_align_models": on(lambda df: ev.align_models(df, MODELS).groupBy("model", "split").agg(
        F.count("*").alias("n_rows"), F.min("date").alias("first_date"),
        F.sqrt(F.avg(F.pow(F.col("predicted") - F.col("actual"), 2))).alias("rmse"))),
    "l6_merge_comparisons": plain(l6_merge_comparisons),
    "l7_leaderboard": on_table(ev.leaderboard),
    "l8_verdicts": on_table(ev.verdicts),
    "l9_regime_metrics": on(ev.regime_metrics),
    "l10_residual_stats": on(ev.residual_stats),
    "l10_residual_histogram": on(ev.residual_histogram),
    "l11_taylor_statistics": on(ev.taylor_statistics),
    "l12_largest_miss": on(ev.largest_miss),
    "l12_rain_hit_rate": on(ev.rain_hit_rate),
    "l13_best_per_metric": on_table(ev.best_per_metric),
    "l14_season_zoom": on(lambda df: ev.season_zoom(df.where(F.col("split") == "test")), 5),
    "l15_extreme_errors": on(ev.extreme_errors),
    "l15_extreme_days": on(ev.extreme_days, 5),
}
