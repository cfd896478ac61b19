"""Forecast ensembles, intervals, calibration and CRPS.

The members of one forecast live in an array column (log scale), so summaries,
quantiles and scores are row-local: nothing is exploded or shuffled until the
final, small aggregates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pluvia.functions.exprs import (
    array_mean, array_sum, at_least_zero, bin_index, is_monsoon, sorted_quantile,
)
from pluvia.functions.quantiles import exact_quantiles
from pluvia.spec import DEFAULT, SeriesSpec

# Interval levels (%), calibration levels (%), intensity bins.
INTERVAL_LEVELS = (60, 70, 80, 90)
CALIBRATION_LEVELS = (10, 20, 30, 40, 50, 60, 70, 80, 90)
INTENSITY_BINS = {"Dry": (0.0, 0.1), "Light": (0.1, 5.0), "Moderate": (5.0, 20.0), "Heavy+": (20.0, float("inf"))}
ANALOG_STEP, ANALOG_MEMBERS = 7, 20


def analog_ensemble(
    df: DataFrame, members: int = ANALOG_MEMBERS, step: int = ANALOG_STEP,
    split: str = "test", spec: SeriesSpec = DEFAULT,
) -> DataFrame:
    """Members are the values ``step``, 2*``step``, ... days back, on the log scale.

    The lags reach back over the whole series, so every day of the split has a forecast
    if the series holds ``members`` * ``step`` days before it; without a full set a day has none.
    """
    w = spec.ordered()
    lags = [F.log1p(F.lag(spec.target, step * k).over(w)) for k in range(1, members + 1)]
    out = df.withColumns({f"_m{k}": c for k, c in enumerate(lags)})
    return (
        out.where((F.col("split") == split) & F.col(f"_m{members - 1}").isNotNull())
        .select(*spec.key, F.col(spec.target).alias("actual"),
                F.array(*[f"_m{k}" for k in range(members)]).alias("members")))


def explode_members(df: DataFrame, spec: SeriesSpec = DEFAULT) -> DataFrame:
    """Long form: one row per forecast and member."""
    return df.select(*spec.key, "actual", F.posexplode("members").alias("member", "value"))


def summary(df: DataFrame) -> DataFrame:
    """Mean and population std on the log scale and back on the measured scale."""
    mean = array_mean(F.col("members"))
    df = df.withColumn("mean_log", mean)
    spread = array_sum(F.transform("members", lambda x: F.pow(x - F.col("mean_log"), 2)))
    df = df.withColumn("std_log", F.sqrt(spread / F.size("members")))
    return df.withColumns({
        "mean_mm": at_least_zero(F.expm1("mean_log")),
        "std_mm": at_least_zero(F.expm1(F.col("mean_log") + F.col("std_log")) - F.expm1("mean_log")),
    })


def _sorted(df: DataFrame) -> DataFrame:
    return df.withColumn("_sorted", F.array_sort("members"))


def _bounds(level: int) -> tuple[Column, Column]:
    tail = (100 - level) / 200
    values = F.col("_sorted")
    return sorted_quantile(values, tail), sorted_quantile(values, 1 - tail)


def intervals(df: DataFrame, levels: Sequence[int] = INTERVAL_LEVELS) -> DataFrame:
    """Central intervals per level from linear quantiles on the log scale."""
    cols = {}
    for level in levels:
        lo, hi = _bounds(level)
        cols[f"lower_{level}"] = at_least_zero(F.expm1(lo))
        cols[f"upper_{level}"] = at_least_zero(F.expm1(hi))
    return _sorted(df).withColumns(cols).drop("_sorted")


def interval_table(df: DataFrame, spec: SeriesSpec = DEFAULT) -> DataFrame:
    return intervals(summary(df)).drop("members")


def interval_stats(
    table: DataFrame, levels: Sequence[int] = INTERVAL_LEVELS, spec: SeriesSpec = DEFAULT
) -> DataFrame:
    """Coverage, mean width and normalised width per level, with the spread figures."""
    monsoon = is_monsoon(spec.date, spec.monsoon)
    aggs = [
        F.avg("std_mm").alias("mean_std_mm"), F.max("std_mm").alias("max_std_mm"),
        F.avg(F.when(monsoon, F.col("std_mm"))).alias("std_monsoon"),
        F.avg(F.when(~monsoon, F.col("std_mm"))).alias("std_nonmonsoon"),
        F.stddev_pop("actual").alias("spread"),
    ]
    for level in levels:
        lo, hi = F.col(f"lower_{level}"), F.col(f"upper_{level}")
        aggs.append(F.avg(F.col("actual").between(lo, hi).cast("double")).alias(f"c{level}"))
        aggs.append(F.avg(hi - lo).alias(f"w{level}"))
    wide = table.agg(*aggs)
    rows = F.array(*[
        F.struct(F.lit(v).alias("level"), F.col(f"c{v}").alias("coverage"),
                 F.col(f"w{v}").alias("mean_width"),
                 (F.col(f"w{v}") / (F.col("spread") + 1e-8)).alias("normalised_width"))
        for v in levels])
    return wide.select(
        F.inline(rows), "mean_std_mm", "max_std_mm", "std_monsoon", "std_nonmonsoon")


def calibration_curve(df: DataFrame, levels: Sequence[int] = CALIBRATION_LEVELS) -> DataFrame:
    """Empirical coverage against nominal, on the log scale, with mean widths.

    All levels are conditional sums of one aggregate; no row is repeated.
    """
    y = F.log1p("actual")
    sums = []
    for level in levels:
        lo, hi = _bounds(level)
        width = at_least_zero(F.expm1(hi)) - at_least_zero(F.expm1(lo))
        sums.append(F.avg(((y >= lo) & (y <= hi)).cast("double")).alias(f"c{level}"))
        sums.append(F.avg(width).alias(f"w{level}"))
    wide = _sorted(df).agg(*sums)
    rows = F.array(*[
        F.struct(
            F.lit(v / 100).alias("nominal_coverage"), F.col(f"c{v}").alias("empirical_coverage"),
            F.abs(F.col(f"c{v}") - F.lit(v / 100)).alias("calibration_error"),
            F.col(f"w{v}").alias("mean_interval_width"))
        for v in levels])
    return wide.select(F.inline(rows))


def calibration_summary(df: DataFrame) -> DataFrame:
    """Expected calibration error, mean CRPS and the mean width of the 90 % interval."""
    curve = calibration_curve(df)
    score = crps(df).agg(F.avg("crps").alias("c")).scalar()
    wide = F.max(F.when(F.col("nominal_coverage") == 0.9, F.col("mean_interval_width")))
    return curve.agg(F.avg("calibration_error").alias("ece"), wide.alias("mean_width_90")).withColumn(
        "crps_mm", score)


def crps(df: DataFrame) -> DataFrame:
    """E|X - y| - E|X - X'| / 2 over all member pairs, from the sorted members.

    The pair term needs no pairs: with members sorted, half the mean absolute
    difference is sum((2i - T - 1) x_i) / T^2.
    """
    mm = F.array_sort(F.transform("members", lambda x: at_least_zero(F.expm1(x))))
    df = df.withColumn("_mm", mm)
    t = F.size("_mm")
    distance = array_sum(F.transform("_mm", lambda x: F.abs(x - F.col("actual")))) / t
    spread = array_sum(F.transform("_mm", lambda x, i: x * (2 * (i + 1) - t - 1))) / (t * t)
    return df.withColumn("crps", distance - spread).drop("_mm")


def crps_by_month(df: DataFrame, spec: SeriesSpec = DEFAULT) -> DataFrame:
    return crps(df).groupBy(F.month(spec.date).alias("month")).agg(
        F.avg("crps").alias("crps"), F.count("*").alias("n"))


def intensity(value: Column) -> Column:
    """Label of the intensity bin [lo, hi) a value falls into."""
    label = F.lit(None).cast("string")
    for name, (lo, hi) in INTENSITY_BINS.items():
        label = F.when((value >= lo) & (value < hi), name).otherwise(label)
    return label


def crps_by_intensity(df: DataFrame) -> DataFrame:
    scored = crps(df).withColumn("intensity", intensity(F.col("actual")))
    return scored.where(F.col("intensity").isNotNull()).groupBy("intensity").agg(
        F.avg("crps").alias("crps"), F.count("*").alias("n"))


def width_histogram(table: DataFrame, level: int = 90, n_bins: int = 30) -> DataFrame:
    """Histogram of the interval width within each intensity bin."""
    width = F.col(f"upper_{level}") - F.col(f"lower_{level}")
    data = table.select(width.alias("w"), intensity(F.col("actual")).alias("intensity")).where(
        F.col("intensity").isNotNull())
    limits = data.groupBy("intensity").agg(
        F.struct(F.min("w").alias("lo"), F.max("w").alias("hi")).alias("s"))
    lookup = limits.agg(F.map_from_entries(F.collect_list(F.struct("intensity", "s")))).scalar()
    marked = data.withColumn("s", lookup).withColumn("s", F.col("s")[F.col("intensity")])
    lo, hi = F.col("s.lo"), F.col("s.hi")
    index = bin_index(F.col("w"), lo, hi, n_bins)
    return marked.groupBy("intensity", index.alias("bin")).agg(
        F.count("*").alias("n"), F.max(lo + (hi - lo) / n_bins * index).alias("left_edge"),
        F.avg("w").alias("mean_width"))


def monthly_spread(table: DataFrame, level: int = 90, spec: SeriesSpec = DEFAULT) -> DataFrame:
    """Mean predictive std and interval width per calendar month."""
    return table.groupBy(F.month(spec.date).alias("month")).agg(
        F.avg("std_mm").alias("mean_std_mm"),
        F.avg(F.col(f"upper_{level}") - F.col(f"lower_{level}")).alias("mean_width"))


def exceedances(table: DataFrame, level: int = 90, spec: SeriesSpec = DEFAULT) -> DataFrame:
    """Days whose actual value lies above the upper bound."""
    upper = F.col(f"upper_{level}")
    return table.where(F.col("actual") > upper).select(*spec.key, "actual", "mean_mm", upper)


def exceedance_counts(table: DataFrame, level: int = 90, spec: SeriesSpec = DEFAULT) -> DataFrame:
    return table.groupBy(spec.series).agg(
        F.count("*").alias("n_days"),
        F.count_if(F.col("actual") > F.col(f"upper_{level}")).alias("n_exceed"))


def calibration_labels(curve: DataFrame) -> DataFrame:
    """Assessment per level and of the whole curve."""
    e = F.col("calibration_error")
    level = F.when(e < 0.03, "well-calibrated").when(e < 0.07, "slight bias").otherwise("miscalibrated")
    ece = curve.agg(F.avg("calibration_error")).scalar()
    out = curve.withColumn("ece", ece)
    overall = F.when(F.col("ece") < 0.05, "well-calibrated").when(
        F.col("ece") < 0.10, "moderately calibrated").otherwise("poorly calibrated")
    return out.select("nominal_coverage", "calibration_error", level.alias("assessment"), "ece",
                      overall.alias("overall"))


def season_uncertainty_ratio(table: DataFrame, spec: SeriesSpec = DEFAULT) -> DataFrame:
    monsoon = is_monsoon(spec.date, spec.monsoon)
    return table.agg(
        F.avg(F.when(monsoon, F.col("std_mm"))).alias("std_monsoon"),
        F.avg(F.when(~monsoon, F.col("std_mm"))).alias("std_nonmonsoon"),
    ).withColumn("ratio", F.when(F.col("std_nonmonsoon") > 0,
                                 F.col("std_monsoon") / F.col("std_nonmonsoon")))


def conformal_intervals(
    predictions: DataFrame, alpha: float = 0.10, max_models: int = 1000
) -> DataFrame:
    """Split-conformal bounds: the (1 - alpha)(1 + 1/n) quantile of the absolute
    validation residuals of each model, applied to its test predictions.

    All rows of a model form one group, so the quantile comes from the exact
    bracketed selection instead of one aggregation buffer.
    """
    scores = predictions.where(F.col("split") == "val").select(
        "model", F.abs(F.col("actual") - F.col("predicted")).alias("score"))
    quantile = exact_quantiles(
        scores, "score", [1 - alpha], ["model"], max_models, raised=lambda n, p: p * (1 + 1 / n))
    lookup = quantile.agg(F.map_from_entries(F.collect_list(F.struct("model", "q")))).scalar()
    return (
        predictions.where(F.col("split") == "test")
        .withColumn("_q", lookup)
        .withColumn("q", F.col("_q")[F.col("model")])
        .drop("_q")
        .withColumns({"lower": F.col("predicted") - F.col("q"), "upper": F.col("predicted") + F.col("q")}))
