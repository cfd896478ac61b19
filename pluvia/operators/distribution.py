"""Distribution profile of each series: categories, moments, histograms, tails, Q-Q fits.

Everything is per series. A series holds at most one row per calendar day, so
its distinct values and their counts fit one aggregation buffer.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pluvia.functions.exprs import category, is_monsoon, season
from pluvia.functions.special import gamma_quantile, gamma_shape, normal_quantile
from pluvia.spec import CATEGORIES, DEFAULT, DRY_LIMIT, EXTREME_LIMIT, HEAVY_LIMIT, SeriesSpec

# Histogram edges, fine for light and coarse for heavy days.
HISTOGRAM_EDGES = [
    0.0,
    *[round(0.1 + 0.5 * i, 1) for i in range(20)],
    *[10.0 + 2 * i for i in range(20)],
    *[50.0 + 10 * i for i in range(15)],
    float("inf"),  # days beyond the last edge have a bin of their own
]


def category_counts(df: DataFrame, spec: SeriesSpec = DEFAULT) -> DataFrame:
    """Days and share per intensity category; categories without days count 0."""
    label = category(spec.target)
    names = list(CATEGORIES)
    wide = df.groupBy(spec.series).agg(
        F.count("*").alias("n_total"),
        *[F.count_if(label == name).alias(f"c{i}") for i, name in enumerate(names)],
    )
    rows = F.array(*[
        F.struct(F.lit(n).alias("category"), F.col(f"c{i}").alias("n")) for i, n in enumerate(names)
    ])
    return wide.select(spec.series, "n_total", F.inline(rows)).select(
        spec.series, "category", "n", (F.col("n") / F.col("n_total") * 100).alias("pct"))


def distribution_stats(df: DataFrame, spec: SeriesSpec = DEFAULT) -> DataFrame:
    """Counts, location, spread, quantiles and shape (population skew, excess kurtosis)."""
    y = F.col(spec.target)
    wet = F.when(y > DRY_LIMIT, y)
    n, dry = F.count("*"), F.count_if(y < DRY_LIMIT)
    return df.groupBy(spec.series).agg(
        n.alias("n_total"),
        dry.alias("n_dry"),
        (n - dry).alias("n_rainy"),
        (dry / n * 100).alias("pct_dry"),
        ((n - dry) / n * 100).alias("pct_rainy"),
        F.count_if(y >= HEAVY_LIMIT).alias("n_heavy"),
        F.count_if(y >= EXTREME_LIMIT).alias("n_extreme"),
        F.avg(y).alias("mean"),
        F.percentile(y, 0.5).alias("median"),
        F.stddev_samp(y).alias("std"),
        F.max(y).alias("max"),
        F.percentile(y, 0.95).alias("p95"),
        F.percentile(y, 0.99).alias("p99"),
        F.skewness(y).alias("skewness"),
        F.kurtosis(y).alias("kurtosis_excess"),
        F.skewness(wet).alias("skewness_wet"),
        F.skewness(F.log1p(y)).alias("log_skewness"),
    )


def yearly(df: DataFrame, spec: SeriesSpec = DEFAULT) -> DataFrame:
    return df.groupBy(spec.series, F.year(spec.date).alias("year")).agg(
        F.sum(spec.target).alias("total"), F.max(spec.target).alias("annual_max"))


def annual_stats(df: DataFrame, spec: SeriesSpec = DEFAULT) -> DataFrame:
    """Mean, sample std, CV %, minimum and maximum of the yearly totals."""
    return yearly(df, spec).groupBy(spec.series).agg(
        F.avg("total").alias("annual_mean"),
        F.stddev_samp("total").alias("annual_std"),
        (F.stddev_samp("total") / F.avg("total") * 100).alias("annual_cv_pct"),
        F.min("total").alias("annual_min"),
        F.max("total").alias("annual_max"),
    )


def histogram(
    df: DataFrame, edges: Sequence[float] = HISTOGRAM_EDGES, spec: SeriesSpec = DEFAULT
) -> DataFrame:
    """Counts between explicit edges, zero-filled; a finite last edge belongs to its bin."""
    bucket = Bucketizer(
        splits=list(edges), inputCol="_x", outputCol="_bin", handleInvalid="keep")
    inside = df.select(spec.series, F.col(spec.target).alias("_x")).withColumn(
        "_x", F.when(F.col("_x").between(edges[0], edges[-1]), F.col("_x")).otherwise(float("nan")))
    counts = bucket.transform(inside).groupBy(spec.series, "_bin").agg(F.count("*").alias("n"))
    n_bins = len(edges) - 1
    bounds = F.array(*[F.lit(float(e)) for e in edges])
    filled = counts.groupBy(spec.series).agg(_by_bin("_bin", "n").alias("_n"))
    return (
        filled.select(spec.series, "_n", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))).alias("bin"))
        .select(spec.series, "bin", F.get(bounds, F.col("bin")).alias("left_edge"),
                F.get(bounds, F.col("bin") + 1).alias("right_edge"), _count_of("_n"))
    )


def _by_bin(bin_col: str, n_col: str) -> Column:
    """Bin -> count map of one series; bounded by the number of bins."""
    return F.map_from_entries(F.collect_list(F.struct(F.col(bin_col).cast("int"), n_col)))


def _count_of(map_col: str) -> Column:
    return F.coalesce(F.try_element_at(map_col, F.col("bin")), F.lit(0)).alias("n")


def log_histogram(df: DataFrame, n_bins: int = 60, spec: SeriesSpec = DEFAULT) -> DataFrame:
    """Equal bins of log1p per series with the counts a fitted normal would give."""
    x = F.log1p(F.col(spec.target).cast("double"))
    counted = df.groupBy(spec.series, x.alias("x")).agg(F.count("*").alias("c"))
    c = F.col("c")
    per_series = counted.groupBy(spec.series).agg(
        F.sum("c").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"),
        (F.sum(F.col("x") * c) / F.sum(c)).alias("mu"),
        F.collect_list(F.struct("x", "c")).alias("values"),
    )
    spread = F.aggregate(
        "values", F.lit(0.0), lambda acc, e: acc + e["c"] * F.pow(e["x"] - F.col("mu"), 2))
    width = (F.col("hi") - F.col("lo")) / n_bins
    shaped = per_series.withColumns({"sigma": F.sqrt(spread / (F.col("n") - 1)), "width": width})
    place = lambda e: F.least(
        F.floor((e["x"] - F.col("lo")) / (F.col("hi") - F.col("lo")) * n_bins), F.lit(n_bins - 1))
    binned = shaped.select(
        spec.series, "n", "lo", "mu", "sigma", "width",
        F.transform("values", lambda e: F.named_struct(F.lit("b"), place(e), F.lit("c"), e["c"])).alias("v"),
        F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))).alias("bin"),
    )
    n_in = F.aggregate(
        F.filter("v", lambda e: e["b"] == F.col("bin")), F.lit(0).cast("bigint"),
        lambda acc, e: acc + e["c"])
    mid = F.col("lo") + (F.col("bin") + 0.5) * F.col("width")
    pdf = F.exp(-0.5 * F.pow((mid - F.col("mu")) / F.col("sigma"), 2)) / (
        F.col("sigma") * math.sqrt(2 * math.pi))
    return binned.select(
        spec.series, "bin", (F.col("lo") + F.col("bin") * F.col("width")).alias("left_edge"),
        n_in.alias("count"), (pdf * F.col("n") * F.col("width")).alias("expected"))


def wet_density(df: DataFrame, n_grid: int = 400, spec: SeriesSpec = DEFAULT) -> DataFrame:
    """Gaussian kernel density of the wet days (Scott bandwidth) on a grid from
    0 to the 99.5 % quantile, next to the exponential density of equal mean.

    The kernel is summed over distinct values and their counts, inside the row
    of the series, so no grid x data pairs are ever produced as rows.
    """
    y = F.col(spec.target).cast("double")
    counted = df.where(y > DRY_LIMIT).groupBy(spec.series, y.alias("v")).agg(F.count("*").alias("c"))
    per_series = counted.groupBy(spec.series).agg(
        F.sum("c").alias("n"),
        (F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("mean"),
        F.percentile("v", 0.995, F.col("c")).alias("top"),
        F.collect_list(F.struct("v", "c")).alias("values"),
    )
    var = F.aggregate(
        "values", F.lit(0.0), lambda acc, e: acc + e["c"] * F.pow(e["v"] - F.col("mean"), 2)
    ) / (F.col("n") - 1)
    shaped = per_series.withColumn("h", F.sqrt(var) * F.pow("n", F.lit(-0.2)))
    grid = shaped.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_grid - 1))).alias("grid_idx"))
    grid = grid.withColumn("x", F.col("top") * F.col("grid_idx") / (n_grid - 1))
    kernel = F.aggregate(
        "values", F.lit(0.0),
        lambda acc, e: acc + e["c"] * F.exp(-0.5 * F.pow((F.col("x") - e["v"]) / F.col("h"), 2)))
    return grid.select(
        spec.series, "grid_idx", "x",
        (kernel / (F.col("n") * F.col("h") * math.sqrt(2 * math.pi))).alias("density"),
        (F.exp(-F.col("x") / F.col("mean")) / F.col("mean")).alias("exponential"))


def box_stats(df: DataFrame, group: Column, name: str, spec: SeriesSpec = DEFAULT) -> DataFrame:
    """Quartiles, 1.5 IQR whiskers and outlier count per series and group."""
    y = F.col(spec.target).cast("double")
    counted = df.where(y.isNotNull()).groupBy(spec.series, group.alias(name), y.alias("v")).agg(
        F.count("*").alias("c"))
    boxes = counted.groupBy(spec.series, name).agg(
        F.percentile("v", [0.25, 0.5, 0.75], F.col("c")).alias("q"),
        F.collect_list(F.struct("v", "c")).alias("values"),
    ).select(spec.series, name, "values", F.get("q", F.lit(0)).alias("q1"),
             F.get("q", F.lit(1)).alias("median"), F.get("q", F.lit(2)).alias("q3"))
    iqr = F.col("q3") - F.col("q1")
    lo, hi = F.col("q1") - 1.5 * iqr, F.col("q3") + 1.5 * iqr
    inside = F.transform(
        F.filter("values", lambda e: (e["v"] >= lo) & (e["v"] <= hi)), lambda e: e["v"])
    outside = F.filter("values", lambda e: (e["v"] < lo) | (e["v"] > hi))
    return boxes.select(
        spec.series, name, "q1", "median", "q3",
        F.array_min(inside).alias("whisker_low"), F.array_max(inside).alias("whisker_high"),
        F.aggregate(outside, F.lit(0).cast("bigint"), lambda a, e: a + e["c"]).alias("n_outliers"))


def monthly_boxes(df: DataFrame, spec: SeriesSpec = DEFAULT) -> DataFrame:
    return box_stats(df, F.month(spec.date), "month", spec)


def seasonal_boxes(df: DataFrame, spec: SeriesSpec = DEFAULT) -> DataFrame:
    return box_stats(df, season(F.month(spec.date)), "season", spec)


def annual_maxima(df: DataFrame, spec: SeriesSpec = DEFAULT) -> DataFrame:
    """Yearly maximum with its linear trend."""
    w = spec.whole()
    slope = F.regr_slope("annual_max", "year").over(w)
    intercept = F.regr_intercept("annual_max", "year").over(w)
    return yearly(df, spec).select(
        spec.series, "year", "annual_max", slope.alias("slope"),
        (intercept + slope * F.col("year")).alias("trend"))


def exceedance_curve(df: DataFrame, spec: SeriesSpec = DEFAULT) -> DataFrame:
    """Weibull plotting positions rank/(n+1) of the positive values, largest first."""
    wet = df.where(F.col(spec.target) > 0)
    order = spec.whole().orderBy(F.col(spec.target).desc(), spec.date)
    n = F.count(F.lit(1)).over(spec.whole())
    rank = F.row_number().over(order)
    return wet.select(*spec.key, spec.target, rank.alias("rank"), (rank / (n + 1)).alias("probability"))


def threshold_shares(
    df: DataFrame, limits: Mapping[str, float], spec: SeriesSpec = DEFAULT
) -> DataFrame:
    y = F.col(spec.target)
    return df.groupBy(spec.series).agg(
        *[F.avg((y >= v).cast("double")).alias(name) for name, v in limits.items()])


def top_events(df: DataFrame, n: int = 20, spec: SeriesSpec = DEFAULT) -> DataFrame:
    """The ``n`` largest days of each series with their season flag."""
    order = spec.whole().orderBy(F.col(spec.target).desc(), spec.date)
    ranked = df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    return ranked.select(
        *spec.key, spec.target, "rank", is_monsoon(spec.date, spec.monsoon).cast("int").alias("is_monsoon"))


def top_events_overall(df: DataFrame, n: int = 20, spec: SeriesSpec = DEFAULT) -> DataFrame:
    """The ``n`` largest days of the whole panel, in date order."""
    top = df.orderBy(F.col(spec.target).desc(), spec.date, spec.series).limit(n)
    return top.select(
        *spec.key, spec.target, is_monsoon(spec.date, spec.monsoon).cast("int").alias("is_monsoon")
    ).orderBy(spec.date, spec.series)


def plotting_positions(df: DataFrame, spec: SeriesSpec = DEFAULT) -> DataFrame:
    """Wet days in ascending order with Filliben's order-statistic medians."""
    wet = df.where(F.col(spec.target) > DRY_LIMIT)
    i = F.row_number().over(spec.whole().orderBy(spec.target, spec.date))
    n = F.count(F.lit(1)).over(spec.whole())
    ranked = wet.select(*spec.key, F.col(spec.target).cast("double").alias("value"),
                        i.alias("i"), n.alias("n"))
    i, n = F.col("i"), F.col("n")
    last = F.pow(F.lit(0.5), 1 / n)
    m = F.when(i == n, last).when(i == 1, 1 - last).otherwise((i - 0.3175) / (n + 0.365))
    return ranked.withColumn("m", m)


def _qq_fit(df: DataFrame, label: str, value: Column, theory: Column, spec: SeriesSpec) -> DataFrame:
    return df.select(spec.series, value.alias("_v"), theory.alias("_t")).groupBy(spec.series).agg(
        F.lit(label).alias("distribution"),
        F.regr_slope("_v", "_t").alias("slope"),
        F.regr_intercept("_v", "_t").alias("intercept"),
        F.regr_r2("_v", "_t").alias("r2"),
    )


def qq_exponential(df: DataFrame, spec: SeriesSpec = DEFAULT) -> DataFrame:
    ranked = plotting_positions(df, spec)
    return _qq_fit(ranked, "exponential", F.col("value"), -F.log(1 - F.col("m")), spec)


def qq_fits(df: DataFrame, spec: SeriesSpec = DEFAULT) -> DataFrame:
    """Straight-line fit of the ordered wet days against four candidate distributions."""
    ranked = plotting_positions(df, spec)
    v, m = F.col("value"), F.col("m")
    w = spec.whole()
    gap = F.log(F.avg("value").over(w)) - F.avg(F.log("value")).over(w)
    ranked = ranked.withColumn("gap", gap).withColumn("shape", gamma_shape("gap"))
    theory = ranked.withColumns({
        "z": normal_quantile("m"), "e": -F.log(1 - m), "g": gamma_quantile("m", "shape")})
    pairs = {
        "normal": (v, "z"), "log-normal": (F.log(v), "z"),
        "gamma": (v, "g"), "exponential": (v, "e"),
    }
    stats = [
        f(a, F.col(t)).alias(f"{s}{i}")
        for i, (a, t) in enumerate(pairs.values())
        for s, f in (("slope", F.regr_slope), ("intercept", F.regr_intercept), ("r2", F.regr_r2))
    ]
    wide = theory.groupBy(spec.series).agg(*stats)
    return wide.select(spec.series, F.inline(F.array(*[
        F.struct(F.lit(name).alias("distribution"),
                 *[F.col(f"{s}{i}").alias(s) for s in ("slope", "intercept", "r2")])
        for i, name in enumerate(pairs)
    ])))
