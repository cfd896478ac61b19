"""Feature engineering: 10 raw + 18 lag + 10 rolling + 11 calendar + 9 domain columns.

All lags, rolling frames and the dry-spell counter share one ordering of the
panel by (series, date), so the whole feature table costs a single exchange.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pluvia.functions.exprs import col, melt
from pluvia.functions.frames import add_centred_means, add_trailing, centred
from pluvia.functions.quantiles import exact_quantiles, quantile_columns
from pluvia.session import materialise
from pluvia.spec import (
    COVARIATE_LAGS, COVARIATE_ROLLS, DEFAULT, DRY_LIMIT, TARGET_LAGS, TARGET_ROLLS, SeriesSpec,
)

# Onset and withdrawal of the monsoon as day of year.
ONSET_DAY, WITHDRAWAL_DAY = 152, 273
# Ordinal season codes.
SEASON_CODES = {"Winter": 0, "Pre-Monsoon": 1, "Post-Monsoon": 2, "Monsoon": 3}
# Sample weight of heavy days.
HEAVY_DAY, HEAVY_WEIGHT = 20.0, 5.0

CYCLICAL = ["month_sin", "month_cos", "doy_sin", "doy_cos"]
CALENDAR_FEATURES = [
    "quarter", "week_of_year", "is_weekend", "year_frac", *CYCLICAL,
    "season_code", "days_from_monsoon_onset", "days_from_monsoon_withdrawal",
]
DOMAIN_FEATURES = [
    "soil_moisture_gradient", "dewpoint_approx", "temp_range", "pressure_rh_interaction",
    "rain_occurrence", "dry_spell_length", "monsoon_flag", "log_rainfall", "rainfall_wet_only",
]
TARGETS = ["rainfall", "log_rainfall", "rain_occurrence"]
LEAKAGE = ["rainfall", "log_rainfall", "rain_occurrence", "rainfall_wet_only"]
# Flags, calendar integers, targets and counters are never scaled.
NEVER_SCALED = {
    "rainfall", "log_rainfall", "rain_occurrence", "rainfall_wet_only", "is_monsoon",
    "monsoon_flag", "season", "year", "month", "quarter", "day_of_year", "week_of_year",
    "day_of_week", "is_weekend", "season_code", "dry_spell_length",
}


def lag_columns(
    df: DataFrame,
    spec: SeriesSpec = DEFAULT,
    target_lags: Sequence[int] = TARGET_LAGS,
    covariate_lags: Mapping[str, Sequence[int]] = COVARIATE_LAGS,
) -> dict[str, Column]:
    w = spec.ordered()
    plan = {spec.target: target_lags, **covariate_lags}
    return {
        f"{c}_lag{n}": F.lag(c, n).over(w)
        for c, lags in plan.items() if c in df.columns for n in lags
    }


def add_lags(df: DataFrame, spec: SeriesSpec = DEFAULT, **lags) -> DataFrame:
    """Values n rows back; columns that are absent are skipped."""
    return df.withColumns(lag_columns(df, spec, **lags))


def rolling_plan(
    columns: Sequence[str],
    spec: SeriesSpec = DEFAULT,
    target_windows: Sequence[int] = TARGET_ROLLS,
    covariate_windows: Mapping[str, Sequence[int]] = COVARIATE_ROLLS,
) -> tuple[dict[str, tuple[str, int]], dict[str, tuple[str, int]]]:
    """Rolling means and sample stds: output -> (source, width)."""
    y = spec.target
    means = {f"{y}_roll_mean_{n}": (y, n) for n in target_windows}
    stds = {f"{y}_roll_std_{n}": (y, n) for n in target_windows}
    for c, windows in covariate_windows.items():
        if c in columns:
            means |= {f"{c}_roll_mean_{n}": (c, n) for n in windows}
    return means, stds


def add_rolling(df: DataFrame, spec: SeriesSpec = DEFAULT, **windows) -> DataFrame:
    """Backward rolling mean and sample std over full frames, day t included."""
    return add_trailing(df, *rolling_plan(df.columns, spec, **windows), spec.ordered())


def add_centred(
    df: DataFrame, spec: SeriesSpec = DEFAULT, windows: Sequence[int] = (7, 30, 90),
    std_window: int = 30,
) -> DataFrame:
    """Centred smoothing for exploration; not a feature, it looks ahead."""
    w = spec.ordered()
    plan = {f"{spec.target}_centred_mean_{n}": (spec.target, n, n // 2) for n in windows}
    std = centred(spec.target, std_window, "std", w, std_window // 2)
    return add_centred_means(df, plan, w).withColumn(f"{spec.target}_centred_std_{std_window}", std)


def add_calendar_features(df: DataFrame, spec: SeriesSpec = DEFAULT) -> DataFrame:
    """Quarter, ISO week, weekend flag and fraction of the year."""
    d = F.col(spec.date)
    return df.withColumns({
        "quarter": F.quarter(d),
        "week_of_year": F.weekofyear(d),
        "is_weekend": (F.weekday(d) >= 5).cast("int"),
        "year_frac": F.dayofyear(d) / F.lit(365.25),
    })


def cyclical(value: Column, period: float) -> tuple[Column, Column]:
    angle = F.lit(2.0 * math.pi) * value / F.lit(period)
    return F.sin(angle), F.cos(angle)


def add_cyclical(df: DataFrame, spec: SeriesSpec = DEFAULT) -> DataFrame:
    d = F.col(spec.date)
    month_sin, month_cos = cyclical(F.month(d), 12.0)
    doy_sin, doy_cos = cyclical(F.dayofyear(d), 365.25)
    return df.withColumns(dict(zip(CYCLICAL, [month_sin, month_cos, doy_sin, doy_cos])))


def add_season_code(df: DataFrame) -> DataFrame:
    code = F.lit(0)
    for name, value in SEASON_CODES.items():
        code = F.when(F.col("season") == name, value).otherwise(code)
    return df.withColumn("season_code", code)


def add_monsoon_distance(df: DataFrame, spec: SeriesSpec = DEFAULT) -> DataFrame:
    doy = F.dayofyear(spec.date)
    return df.withColumns({
        "days_from_monsoon_onset": doy - ONSET_DAY,
        "days_from_monsoon_withdrawal": doy - WITHDRAWAL_DAY,
    })


def difference(a: str, b: str) -> Column:
    return F.col(a) - F.col(b)


def interaction(a: str, b: str, scale: float = 1.0) -> Column:
    return F.col(a) * (F.col(b) / F.lit(scale))


def dewpoint(tmin: str = "tmin", rh: str = "rh") -> Column:
    return F.col(tmin) - (F.lit(100.0) - F.col(rh)) / F.lit(5.0)


def add_physical(df: DataFrame) -> DataFrame:
    """Moisture gradient, dew point, diurnal range and pressure x humidity."""
    return df.withColumns({
        "soil_moisture_gradient": difference("soil_wet_surf", "soil_wet_root"),
        "dewpoint_approx": dewpoint(),
        "temp_range": difference("tmax", "tmin"),
        "pressure_rh_interaction": interaction("pressure", "rh", 100.0),
    })


def add_occurrence(df: DataFrame, spec: SeriesSpec = DEFAULT) -> DataFrame:
    return df.withColumn("rain_occurrence", (F.col(spec.target) > DRY_LIMIT).cast("int"))


def add_dry_spell_length(
    df: DataFrame, spec: SeriesSpec = DEFAULT, causal: bool = False
) -> DataFrame:
    """Dry days since the last wet one. Day t counts unless ``causal``.

    A running maximum of the last wet position replaces an island id and a
    second partitioning by it: position - last wet position is the run length.
    """
    w = spec.ordered()
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    pos = F.row_number().over(w)
    dry = F.col(spec.target) < DRY_LIMIT
    df = df.withColumns({"_pos": pos, "_dry": F.coalesce(dry, F.lit(False))})
    last_wet = F.coalesce(F.max(F.when(~F.col("_dry"), F.col("_pos"))).over(upto), F.lit(0))
    length = F.col("_pos") - last_wet
    if causal:
        df = df.withColumn("_len", length)
        length = F.coalesce(F.lag("_len").over(w), F.lit(0))
    return df.withColumn("dry_spell_length", length.cast("int")).drop("_pos", "_dry", "_len")


def add_target_transforms(df: DataFrame, spec: SeriesSpec = DEFAULT) -> DataFrame:
    y = F.col(spec.target)
    return df.withColumns({
        "monsoon_flag": F.month(spec.date).isin(*spec.monsoon).cast("int"),
        "log_rainfall": F.log1p(y),
        "rainfall_wet_only": F.when(y > DRY_LIMIT, y),
    })


def drop_warmup(df: DataFrame) -> DataFrame:
    """Remove rows whose lags or rolling frames reach before the series."""
    return df.dropna(subset=[c for c in df.columns if "_lag" in c or "_roll_" in c])


def warmup_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if "_lag" in c or "_roll_" in c]


def feature_names(df: DataFrame, spec: SeriesSpec = DEFAULT) -> list[str]:
    """The ordered feature list of a feature table."""
    raw = [c for c in spec.features if c in df.columns]
    lags = [c for c in df.columns if "_lag" in c]
    rolls = [c for c in df.columns if "_roll_" in c]
    return list(dict.fromkeys([*raw, *lags, *rolls, *CALENDAR_FEATURES, *DOMAIN_FEATURES]))


def feature_table(
    df: DataFrame, spec: SeriesSpec = DEFAULT, causal_dry_spell: bool = False
) -> DataFrame:
    """All features, the target and the split of a panel with calendar columns.

    Input: ``add_calendar`` + ``split_by_position`` output. Warm-up rows stay.
    """
    # Rolling steps first: they pass over the rows several times, so the rows
    # should still be narrow; the wide lag columns come last.
    out = (
        df.transform(add_rolling, spec)
        .transform(add_dry_spell_length, spec, causal_dry_spell)
        .transform(add_lags, spec)
        .transform(add_calendar_features, spec)
        .transform(add_cyclical, spec)
        .transform(add_season_code)
        .transform(add_monsoon_distance, spec)
        .transform(add_physical)
        .transform(add_occurrence, spec)
        .transform(add_target_transforms, spec)
    )
    return out.select(*spec.key, *feature_names(out, spec), spec.target, "split")


def day_features(daily: DataFrame, spec: SeriesSpec = DEFAULT) -> DataFrame:
    """The features that follow from the day alone, one row per day.

    Input: ``add_calendar`` output of one row per calendar day, with the covariates that all
    series share. Days whose lags or rolling frames reach before the first are left out.
    """
    one = daily.withColumn(spec.series, F.lit(0))
    out = (
        one.transform(add_rolling, spec, target_windows=())
        .transform(add_lags, spec, target_lags=())
        .transform(add_calendar_features, spec)
        .transform(add_cyclical, spec)
        .transform(add_season_code)
        .transform(add_monsoon_distance, spec)
        .transform(add_physical)
    )
    made = [c for c in out.columns if c not in one.columns]
    return drop_warmup(out.select(spec.date, *[c for c in spec.features if c in out.columns], *made))


def feature_table_of_days(
    df: DataFrame, daily: DataFrame, spec: SeriesSpec = DEFAULT, causal_dry_spell: bool = False
) -> DataFrame:
    """``drop_warmup(feature_table(...))`` of series that have every day of one calendar once.

    Rows n back are then days n back, so lags and rolling frames of covariates that all
    series share are built once per day (``day_features``) instead of once per series and
    day, and the windows pass over the target only. Input: ``split_by_position`` output
    with the target, and ``add_calendar`` output of the days with the covariates.
    """
    own = (
        df.transform(add_rolling, spec, covariate_windows={})
        .transform(add_dry_spell_length, spec, causal_dry_spell)
        .transform(add_lags, spec, covariate_lags={})
    )
    out = drop_warmup(own).join(F.broadcast(day_features(daily, spec)), spec.date).transform(
        add_occurrence, spec).transform(add_target_transforms, spec)
    means, stds = rolling_plan(out.columns, spec)
    ordered = [*lag_columns(out, spec), *means, *stds]
    out = out.select(*[c for c in out.columns if c not in ordered], *ordered)
    return out.select(*spec.key, *feature_names(out, spec), spec.target, "split")


def scaler_parameters(
    df: DataFrame, features: Sequence[str], spec: SeriesSpec = DEFAULT
) -> DataFrame:
    """Mean and population std of the train rows, one row per scaled feature."""
    long = melt(df.where(F.col("split") == "train"), [], scalable(features), "feature", "x")
    std = F.stddev_pop("x")
    return long.groupBy("feature").agg(
        F.avg("x").alias("mean"), F.when(std == 0, 1.0).otherwise(std).alias("std"))


def scalable(features: Sequence[str]) -> list[str]:
    return [c for c in features if c not in NEVER_SCALED]


def standardise(df: DataFrame, parameters: DataFrame, features: Sequence[str]) -> DataFrame:
    """(x - mean) / std with stored parameters; other columns stay as they are.

    The parameter table has one row per feature, so it is folded to a single
    row and used as a scalar. Features are looked up in it once, not once a row.
    """
    scaled = scalable(features)
    if not scaled:
        return df
    found = parameters.agg(
        F.map_from_entries(F.collect_list(F.struct("feature", F.struct("mean", "std")))).alias("params"))
    folded = found.select(F.struct(*[F.col("params")[c].alias(f"p{i}") for i, c in enumerate(scaled)])).scalar()
    df = df.withColumn("_params", folded)
    out = df.withColumns({
        c: (F.col(c) - F.col(f"_params.p{i}.mean")) / F.col(f"_params.p{i}.std") for i, c in enumerate(scaled)
    })
    return out.drop("_params")


def model_inputs(
    df: DataFrame, features: Sequence[str], spec: SeriesSpec = DEFAULT
) -> DataFrame:
    """Scaled model input: features + the three targets + split."""
    keep = [c for c in features if c not in LEAKAGE]
    scaled = standardise(df, scaler_parameters(df, keep, spec), keep)
    return scaled.select(*spec.key, *keep, *TARGETS, "split")


def feature_category(name: Column) -> Column:
    """Category of a feature from its name."""
    return (
        F.when(name.contains("_lag"), "Lag")
        .when(name.contains("_roll_"), "Rolling")
        .when(name.isin(*CYCLICAL), "Cyclical")
        .when(name.isin(
            "month", "quarter", "day_of_year", "week_of_year", "day_of_week", "is_weekend",
            "year_frac", "season", "season_code", "days_from_monsoon_onset",
            "days_from_monsoon_withdrawal"), "Temporal")
        .when(name.isin(*DOMAIN_FEATURES), "Domain")
        .when(name.isin("rainfall", "is_monsoon", "year"), "Target / Structural")
        .otherwise("Original Meteorological")
    )


def feature_statistics(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Category, non-null count, mean, std, min and max per feature, one pass.

    The columns become (feature, value) rows inside each task: five buffers per
    feature stay in generated code, hundreds of wide aggregates would not.
    """
    stats = melt(df, [], features, "feature", "x").groupBy("feature").agg(
        F.count("x").alias("non_null"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"),
        F.min("x").alias("min"), F.max("x").alias("max"))
    return stats.withColumn("category", feature_category(F.col("feature")))


def feature_summary(
    statistics: DataFrame,
    vif: DataFrame,
    attribution: DataFrame,
    gain: DataFrame,
    linear_set: Sequence[str],
    ml_set: Sequence[str],
    corr_dropped: Sequence[str],
) -> DataFrame:
    """Statistics left-joined with VIF, attribution and gain ranks, plus membership flags."""
    f = F.col("feature")
    return (
        statistics.join(vif.select("feature", "vif", "severity"), "feature", "left")
        .join(attribution.select("feature", "mean_abs", "attribution_rank"), "feature", "left")
        .join(gain.select("feature", "gain_frac", "gain_rank"), "feature", "left")
        .withColumns({
            "in_linear_set": f.isin(*linear_set) if linear_set else F.lit(False),
            "in_ml_set": f.isin(*ml_set) if ml_set else F.lit(False),
            "corr_dropped": f.isin(*corr_dropped) if corr_dropped else F.lit(False),
        })
        .fillna("N/A", subset=["severity"])
    )


def merge_importance(attribution: DataFrame, gain: DataFrame) -> DataFrame:
    """Full outer join of two importance tables, attribution rank first, NULLs last."""
    return attribution.join(gain, "feature", "full").orderBy(
        F.col("attribution_rank").asc_nulls_last(), "feature"
    )


def sliding_windows(
    df: DataFrame, features: Sequence[str], lookback: int = 30, spec: SeriesSpec = DEFAULT
) -> DataFrame:
    """For each row t with ``lookback`` predecessors in its split: the feature
    rows [t - lookback, t) as an array, the target and the sample weight."""
    frame = spec.ordered("split").rowsBetween(-lookback, -1)
    rows = F.collect_list(F.array(*[F.col(c).cast("double") for c in features])).over(frame)
    return (
        df.withColumn("window", rows)
        .where(F.size("window") == lookback)
        .select(*spec.key, "split", "window", F.col(spec.target).alias("y"),
                sample_weight(spec.target).alias("weight"))
    )


def sample_weight(
    target: Column | str, threshold: float = HEAVY_DAY, weight: float = HEAVY_WEIGHT
) -> Column:
    return F.when(col(target) > threshold, F.lit(weight)).otherwise(F.lit(1.0))


# Features shown by season, and the fewest and most bins of a histogram.
SHOWN = (
    "rainfall_lag1", "rainfall_roll_mean_7", "rainfall_roll_std_30", "soil_moisture_gradient", "dewpoint_approx", "temp_range",
    "pressure_rh_interaction", "dry_spell_length", "month_sin", "rh_lag1", "cloud_lag1", "pressure_lag1")
MIN_BINS, MAX_BINS = 20, 50


def histograms_by_season(df: DataFrame, features: Sequence[str] = SHOWN) -> DataFrame:
    """Density histogram of each feature, monsoon against the rest, on shared bins between
    the exact 1 % and 99 % quantiles; outliers are clipped in.

    There is a bin for every hundred values, 20 at least and 50 at most. All features share
    the passes; ``df`` is read twice. A feature whose two quantiles agree has no density.
    """
    data = melt(df, [(F.col("is_monsoon") == 1).alias("monsoon")], features, "feature", "x").where(F.col("x").isNotNull())
    edges = quantile_columns(
        exact_quantiles(data, "x", [0.01, 0.99], ["feature"], len(features)), ["feature"], {0.01: "lo", 0.99: "hi"})
    sizes = data.groupBy("feature").agg(F.least(F.lit(MAX_BINS), F.greatest(
        F.lit(MIN_BINS), F.floor(F.count("x") / 100))).cast("int").alias("bins"))
    data = data.join(materialise(edges.join(sizes, "feature"), "bin-edges"), "feature")
    lo, hi, bins = F.col("lo"), F.col("hi"), F.col("bins")
    clipped = F.greatest(lo, F.least(hi, F.col("x")))
    place = F.coalesce(F.least(F.floor(F.try_divide(clipped - lo, hi - lo) * bins), bins - 1), F.lit(0)).cast("int")
    counts = data.groupBy("feature", "monsoon", place.alias("bin"), "lo", "hi", "bins").agg(F.count("*").alias("n"))
    group = Window.partitionBy("feature", "monsoon")  # a row a bin
    return counts.select(
        "feature", "monsoon", "bin", (lo + (hi - lo) / bins * F.col("bin")).alias("left_edge"), "n",
        F.try_divide(F.col("n") / F.sum("n").over(group), (hi - lo) / bins).alias("density"))


def counter_calibration(df: DataFrame) -> DataFrame:
    """P(wet) with a 95 % band per two-day bin of the dry-spell counter."""
    x = F.col("dry_spell_length")
    left = F.least(F.floor(x / 2) * 2, F.lit(30)).cast("int")
    p, n = F.col("p_rain"), F.col("n")
    half = 1.96 * F.sqrt(p * (1 - p) / F.greatest(n, F.lit(1)))
    return (
        df.groupBy(left.alias("bin_left"))
        .agg(F.avg("rain_occurrence").alias("p_rain"), F.count("rain_occurrence").alias("n"))
        .withColumns({"p_low": p - half, "p_high": p + half})
    )
