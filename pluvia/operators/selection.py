"""Feature selection: candidates, correlation filter, importances, final sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pluvia.operators.correlation import correlation_pairs
from pluvia.operators.explain import global_summary, shapley_values
from pluvia.operators.features import LEAKAGE
from pluvia.operators.models import assemble, fitted_rows
from pluvia.spec import DEFAULT, SeriesSpec

# Limits of the selection rules and columns that are never removed.
CORR_LIMIT, MIN_GAIN_FRAC, TOP_ATTRIBUTION = 0.92, 0.001, 30
PROTECTED = {"rainfall", "log_rainfall", "rain_occurrence", "rainfall_wet_only", "is_monsoon", "monsoon_flag"}
SEED = 42
# Correlations that agree to so many digits are equal: names decide, not rounding errors.
DIGITS = 9


def candidates(columns: Sequence[str]) -> list[str]:
    """Features that do not derive from the target day itself."""
    return [c for c in columns if c not in LEAKAGE]


def analysis_rows(df: DataFrame, features: Sequence[str], target: str = "log_rainfall") -> DataFrame:
    """Complete train rows of the candidates and the target."""
    keep = candidates(features)
    return df.where(F.col("split") == "train").select(*DEFAULT.key, *keep, target).dropna()


def correlation_filter(
    df: DataFrame, features: Sequence[str], target: str = "log_rainfall",
    limit: float = CORR_LIMIT, protected: Sequence[str] = tuple(PROTECTED),
) -> list[str]:
    """Features to drop: of each pair with |r| above the limit, strongest first, the
    one less correlated with the target, unless one is dropped or protected.

    The correlations are one distributed aggregate; the greedy walk sees at most
    p^2 / 2 rows, a number fixed by the columns.
    """
    pairs = correlation_pairs(df, [*features, target])
    r = {(p.feature_a, p.feature_b): abs(p.r) for p in pairs.where(F.col("r").isNotNull()).collect()}
    with_target = {a: v for (a, b), v in r.items() if b == target}
    close = sorted(
        ((v, a, b) for (a, b), v in r.items() if b != target and v > limit),
        key=lambda e: (-round(e[0], DIGITS), e[1], e[2]))
    dropped: set[str] = set()
    for _, a, b in close:
        if dropped & {a, b} or {a, b} & set(protected):
            continue
        dropped.add(b if round(with_target.get(a, 0.0), DIGITS) >= round(with_target.get(b, 0.0), DIGITS) else a)
    return sorted(dropped)


def gain_importance(
    df: DataFrame, features: Sequence[str], target: str = "log_rainfall",
    trees: int = 300, depth: int = 4, rate: float = 0.05,
) -> DataFrame:
    """Importance of each feature in a boosted regressor, with fraction and rank."""
    model = GBTRegressor(
        labelCol=target, featuresCol="x", maxIter=trees, maxDepth=depth, stepSize=rate,
        subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=SEED,
    ).fit(assemble(df, features).select("x", target))
    rows = [(f, float(g)) for f, g in zip(features, model.featureImportances.toArray())]
    table = df.sparkSession.createDataFrame(rows, "feature string, gain double")
    return rank_gain(table)


def rank_gain(table: DataFrame) -> DataFrame:
    """Adds gain_frac and gain_rank to (feature, gain)."""
    every = Window.partitionBy(F.lit(1))  # one row per feature
    total = F.sum("gain").over(every)
    return table.select(
        "feature", "gain",
        F.when(total > 0, F.col("gain") / total).otherwise(0.0).alias("gain_frac"),
        F.row_number().over(every.orderBy(F.col("gain").desc(), "feature")).alias("gain_rank"))


def attribution_ranking(
    df: DataFrame, features: Sequence[str], target: str = "log_rainfall",
    trees: int = 200, depth: int = 4, rate: float = 0.05, permutations: int = 4,
) -> DataFrame:
    """Mean absolute attribution of a boosted regressor over all rows, with rank."""
    rows = fitted_rows(df, "attribution-rows")
    model = GBTRegressor(
        labelCol=target, featuresCol="x", maxIter=trees, maxDepth=depth, stepSize=rate,
        subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=SEED,
    ).fit(assemble(rows, features).select("x", target))
    phi = shapley_values(rows, rows, model, features, permutations=permutations)
    return global_summary(phi).select(
        "feature", "mean_abs", F.col("fraction").alias("mean_abs_frac"),
        F.col("rank").alias("attribution_rank"))


def linear_set(
    names: DataFrame, vif: DataFrame, corr_dropped: DataFrame, gain: DataFrame,
    min_gain: float = MIN_GAIN_FRAC, protected: Sequence[str] = tuple(PROTECTED),
) -> DataFrame:
    """Candidates without severe VIF, correlation drops and negligible gain;
    protected columns stay. All inputs are keyed by ``feature``."""
    excluded = (
        vif.where(F.col("severity") == "Severe").select("feature")
        .union(corr_dropped.select("feature"))
        .union(gain.where(F.col("gain_frac") < min_gain).select("feature"))
        .where(~F.col("feature").isin(*protected)))
    kept = names.where(~F.col("feature").isin(*LEAKAGE))
    return kept.join(excluded, "feature", "left_anti")


def ml_set(
    names: DataFrame, attribution: DataFrame, gain: DataFrame, top: int = TOP_ATTRIBUTION,
    min_gain: float = MIN_GAIN_FRAC, protected: Sequence[str] = tuple(PROTECTED),
) -> DataFrame:
    """The top features by attribution and the protected ones, without negligible gain."""
    best = attribution.where(F.col("attribution_rank") <= top).select("feature")
    low = gain.where((F.col("gain_frac") < min_gain) & ~F.col("feature").isin(*protected))
    kept = names.where(~F.col("feature").isin(*LEAKAGE))
    chosen = kept.join(best, "feature", "left_semi").union(
        kept.where(F.col("feature").isin(*protected)))
    return chosen.distinct().join(low.select("feature"), "feature", "left_anti")
