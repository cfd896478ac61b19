"""Baseline forecasts and the hybrid combination; all keep the partitioning by series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pluvia.functions.exprs import array_mean, at_least_zero
from pluvia.spec import DEFAULT, SeriesSpec

# Climatology smoothing width and circular padding.
SMOOTH_WIDTH = 15
PREDICTION_COLUMNS = ["model", "split", "series_id", "date", "actual", "predicted"]


def persistence_column(spec: SeriesSpec = DEFAULT) -> Column:
    """Yesterday's value; without one, the last train value of the series."""
    last_train = F.max_by(
        F.col(spec.target), F.when(F.col("split") == "train", F.col(spec.date))
    ).over(spec.whole())
    return at_least_zero(F.coalesce(F.lag(spec.target).over(spec.ordered()), last_train))


def climatology(df: DataFrame, spec: SeriesSpec = DEFAULT) -> DataFrame:
    """Smoothed day-of-year means of the train rows: one row per series.

    At most 366 means per series are folded into an array and smoothed there
    with a circular 15-wide frame, so the result joins on the series alone.
    """
    daily = df.where(F.col("split") == "train").groupBy(
        spec.series, F.dayofyear(spec.date).alias("doy")
    ).agg(F.avg(spec.target).alias("m"))
    pad, half = SMOOTH_WIDTH, SMOOTH_WIDTH // 2
    folded = daily.groupBy(spec.series).agg(
        F.sort_array(F.collect_list(F.struct("doy", "m"))).alias("days"))
    folded = folded.withColumn("means", F.transform("days", lambda e: e["m"]))
    n = F.size("means")
    padded = F.concat(
        F.slice("means", F.greatest(n - pad + 1, F.lit(1)), F.lit(pad)), F.col("means"),
        F.slice("means", F.lit(1), F.lit(pad)))
    folded = folded.withColumns({"padded": padded, "lead": F.least(n, F.lit(pad))})
    smooth = F.transform("means", lambda _, i: at_least_zero(array_mean(
        F.slice("padded", F.greatest(i + F.col("lead") - half + 1, F.lit(1)), F.lit(SMOOTH_WIDTH)))))
    curve = F.map_from_arrays(F.transform("days", lambda e: e["doy"]), smooth)
    folded = folded.select(spec.series, curve.alias("curve"))
    filled = F.when(
        F.map_contains_key("curve", 366) | ~F.map_contains_key("curve", 365), F.map_values("curve")
    ).otherwise(F.concat(F.map_values("curve"), F.array(F.try_element_at("curve", F.lit(365)))))
    return folded.select(spec.series, "curve", array_mean(filled).alias("overall"))


def climatology_column(spec: SeriesSpec = DEFAULT) -> Column:
    """Day 366 falls back to 365, a day never seen to the overall mean."""
    doy = F.dayofyear(spec.date)
    known = F.try_element_at("curve", doy)
    leap = F.when(doy == 366, F.try_element_at("curve", F.lit(365)))
    return at_least_zero(F.coalesce(known, leap, F.col("overall")))


def with_baselines(df: DataFrame, spec: SeriesSpec = DEFAULT) -> DataFrame:
    """Both baselines next to the target, for every row of the panel."""
    return (
        df.withColumn("persistence", persistence_column(spec))
        .join(climatology(df, spec), spec.series)
        .withColumn("climatology", climatology_column(spec))
        .drop("curve", "overall")
    )


def long_predictions(df: DataFrame, models: list[str], spec: SeriesSpec = DEFAULT) -> DataFrame:
    """(model, split, series, date, actual, predicted) for the val and test rows."""
    rows = F.array(*[
        F.struct(F.lit(m).alias("model"), F.col(m).alias("predicted")) for m in models
    ])
    return (
        df.where(F.col("split") != "train")
        .select("split", *spec.key, F.col(spec.target).alias("actual"), F.inline(rows))
        .where(F.col("predicted").isNotNull())
        .select("model", "split", *spec.key, "actual", "predicted")
    )


def persistence(df: DataFrame, spec: SeriesSpec = DEFAULT) -> DataFrame:
    return long_predictions(df.withColumn("persistence", persistence_column(spec)), ["persistence"], spec)


def climatology_forecast(df: DataFrame, spec: SeriesSpec = DEFAULT) -> DataFrame:
    joined = df.join(climatology(df, spec), spec.series)
    return long_predictions(joined.withColumn("climatology", climatology_column(spec)), ["climatology"], spec)


def log_residual(actual: Column, predicted: Column) -> Column:
    return F.log1p(actual) - F.log1p(at_least_zero(predicted))


def hybrid_column(base: Column, residual: Column) -> Column:
    """expm1(log1p(base) + residual), clipped; a missing residual counts 0."""
    log_base = F.log1p(at_least_zero(base))
    return at_least_zero(F.expm1(log_base + F.coalesce(residual, F.lit(0.0))))


def hybrid_combine(base: DataFrame, residuals: DataFrame, spec: SeriesSpec = DEFAULT) -> DataFrame:
    """Left-join predicted log residuals to base predictions; keeps both parts."""
    joined = base.join(residuals.select(*spec.key, "residual"), spec.key, "left")
    return joined.select(
        F.lit("hybrid").alias("model"), "split", *spec.key, "actual",
        hybrid_column(F.col("predicted"), F.col("residual")).alias("predicted"),
        at_least_zero(F.col("predicted")).alias("base_predicted"),
        F.coalesce("residual", F.lit(0.0)).alias("residual"),
    )


def carried_residual(
    df: DataFrame, lookback: int = 60, decay: float = 0.5, spec: SeriesSpec = DEFAULT
) -> DataFrame:
    """Adds the hybrid of climatology and yesterday's log residual, damped by the
    usual day-to-day persistence. The residual counts once ``lookback`` rows of the
    split lie behind; before that it is 0 and the base forecast stands."""
    df = df.withColumns({
        "_res": log_residual(F.col(spec.target), F.col("climatology")),
        "_seen": F.row_number().over(spec.ordered("split")),
    })
    df = df.withColumn("_hat", F.lag("_res").over(spec.ordered()) * decay)
    known = F.when(F.col("_seen") > lookback, F.col("_hat"))
    return df.withColumn("hybrid", hybrid_column(F.col("climatology"), known)).drop("_res", "_seen", "_hat")
