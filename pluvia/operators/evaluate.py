"""Scores of long prediction tables: (model, split, series, date, actual, predicted)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pluvia.functions.exprs import at_least_zero, bin_index, is_monsoon, safe_divide
from pluvia.spec import DEFAULT, DRY_LIMIT, EXTREME_EVENT, SeriesSpec

GROUP = ("model", "split")
LOWER_IS_BETTER = ("rmse", "mae", "mape_wet")
HIGHER_IS_BETTER = ("nse", "r2", "hit_rate")


def _parts(where: Column | None = None) -> dict[str, Column]:
    """The metric expressions over the rows of one regime (all rows by default)."""
    keep = (lambda c: c) if where is None else (lambda c: F.when(where, c))
    a = F.col("actual")
    p = at_least_zero(F.col("predicted"))
    e = p - a
    n = F.count(keep(a))
    ss_res, ss_tot = F.sum(keep(e * e)), F.var_pop(keep(a)) * n
    wet = a > DRY_LIMIT
    skill = 1 - safe_divide(ss_res, ss_tot)
    return {
        "n": n,
        "rmse": F.sqrt(F.avg(keep(e * e))),
        "mae": F.avg(keep(F.abs(e))),
        "r2": skill,
        "nse": skill,
        "mape_wet": F.avg(keep(F.when(wet, F.abs(e / a)))) * 100,
        "bias": F.avg(keep(e)),
        "hit_rate": safe_divide(
            F.sum(keep((wet & (p > DRY_LIMIT)).cast("int"))), F.sum(keep(wet.cast("int")))),
    }


def metrics(df: DataFrame, by: Sequence[str] = GROUP) -> DataFrame:
    """RMSE, MAE, R2, NSE, wet-day MAPE, bias and hit rate in one aggregate."""
    return df.groupBy(*by).agg(*[c.alias(n) for n, c in _parts().items()])


def season_metrics(
    df: DataFrame, by: Sequence[str] = GROUP, spec: SeriesSpec = DEFAULT
) -> DataFrame:
    return df.groupBy(*by).agg(*_season_parts(spec))


def _season_parts(spec: SeriesSpec) -> list[Column]:
    monsoon = is_monsoon(spec.date, spec.monsoon)
    out = []
    for label, where in (("monsoon", monsoon), ("nonmonsoon", ~monsoon)):
        parts = _parts(where)
        out += [parts[m].alias(f"{m}_{label}") for m in ("rmse", "mae", "nse", "hit_rate")]
    return out


def _extreme_parts(threshold: float) -> list[Column]:
    parts = _parts(F.col("actual") >= threshold)
    return [parts["n"].alias("n_extreme")] + [
        parts[m].alias(f"{m}_extreme") for m in ("rmse", "mae", "bias")]


def extreme_metrics(
    df: DataFrame, by: Sequence[str] = GROUP, threshold: float = EXTREME_EVENT
) -> DataFrame:
    return df.groupBy(*by).agg(*_extreme_parts(threshold))


def comparison_table(
    df: DataFrame, split: str = "test", spec: SeriesSpec = DEFAULT, threshold: float = EXTREME_EVENT
) -> DataFrame:
    """One row per model, overall + seasons + extremes, ranked by RMSE: one pass."""
    scored = df.where(F.col("split") == split).groupBy("model").agg(
        *[c.alias(n) for n, c in _parts().items()], *_season_parts(spec), *_extreme_parts(threshold))
    return rank_models(scored)


def rank_models(table: DataFrame) -> DataFrame:
    """Rank a table of one row per model by RMSE."""
    order = Window.partitionBy(F.lit(1)).orderBy("rmse", "model")  # one row per model
    return table.drop("rank").withColumn("rank", F.row_number().over(order))


def align_models(df: DataFrame, models: Sequence[str], spec: SeriesSpec = DEFAULT) -> DataFrame:
    """Rows of the days every listed model has a prediction for."""
    listed = df.where(F.col("model").isin(*models))
    day = Window.partitionBy(*spec.key)  # one row per model
    covered = F.size(F.collect_set("model").over(day))
    return listed.withColumn("_n", covered).where(F.col("_n") == len(models)).drop("_n")


def merge_comparisons(first: DataFrame, second: DataFrame) -> DataFrame:
    """All of ``first`` plus the models only ``second`` has, ranked again."""
    extra = second.join(first.select("model"), "model", "left_anti")
    return rank_models(first.unionByName(extra, allowMissingColumns=True))


def leaderboard(table: DataFrame, baseline: str = "climatology") -> DataFrame:
    """Improvement over the baseline's RMSE (the worst RMSE if it is absent), and
    of the best model over the worst."""
    every = Window.partitionBy(F.lit(1))  # one row per model
    base = F.coalesce(
        F.max(F.when(F.col("model") == baseline, F.col("rmse"))).over(every),
        F.max("rmse").over(every))
    best, worst = F.min("rmse").over(every), F.max("rmse").over(every)
    return table.select(
        "model", "rank", "rmse", "nse",
        F.greatest(F.lit(0.0), (base - F.col("rmse")) / base * 100).alias("improvement_pct"),
        F.when(worst > 0, (worst - best) / worst * 100).otherwise(0.0).alias("best_vs_worst_pct"))


def verdicts(table: DataFrame) -> DataFrame:
    """Harder season, skill verdict and bias direction per model."""
    return table.select(
        "model",
        F.when(F.col("rmse_monsoon") > F.col("rmse_nonmonsoon"), "monsoon").otherwise("non-monsoon")
        .alias("harder_season"),
        F.when(F.col("nse") > 0.5, "good").when(F.col("nse") > 0, "some").otherwise("none").alias("skill"),
        F.when(F.col("bias") > 0, "over").when(F.col("bias") < 0, "under").otherwise("none")
        .alias("bias_direction"))


def regime_metrics(
    df: DataFrame, split: str = "test", spec: SeriesSpec = DEFAULT, threshold: float = EXTREME_EVENT
) -> DataFrame:
    """RMSE, MAE, NSE, bias and N for all days, monsoon, the rest and extremes: one
    aggregate with a filter per regime instead of four scans."""
    monsoon = is_monsoon(spec.date, spec.monsoon)
    regimes = {
        "all": None, "monsoon": monsoon, "non_monsoon": ~monsoon,
        "extremes": F.col("actual") >= threshold,
    }
    names = ("rmse", "mae", "nse", "bias", "n")
    wide = df.where(F.col("split") == split).groupBy("model").agg(*[
        _parts(w)[m].alias(f"{r}__{m}") for r, w in regimes.items() for m in names])
    return wide.select("model", F.inline(F.array(*[
        F.struct(F.lit(r).alias("regime"), *[F.col(f"{r}__{m}").alias(m) for m in names])
        for r in regimes])))


def residuals(df: DataFrame) -> DataFrame:
    return df.withColumn("residual", F.col("predicted") - F.col("actual"))


def residual_stats(df: DataFrame, by: Sequence[str] = GROUP) -> DataFrame:
    r = F.col("residual")
    return residuals(df).groupBy(*by).agg(
        F.avg(r).alias("bias"), F.stddev_pop(r).alias("std"), F.min(r).alias("min"),
        F.max(r).alias("max"))


def residual_histogram(df: DataFrame, split: str = "test", n_bins: int = 50) -> DataFrame:
    """Equal bins between the extreme residuals of each model."""
    data = residuals(df.where(F.col("split") == split))
    limits = data.groupBy("model").agg(
        F.struct(F.min("residual").alias("lo"), F.max("residual").alias("hi")).alias("s"))
    # One entry per model, folded into a scalar map: no shuffle of the residuals.
    lookup = limits.agg(F.map_from_entries(F.collect_list(F.struct("model", "s")))).scalar()
    marked = data.withColumn("s", lookup).withColumn("s", F.col("s")[F.col("model")])
    lo, hi = F.col("s.lo"), F.col("s.hi")
    index = bin_index(F.col("residual"), lo, hi, n_bins)
    return marked.groupBy("model", index.alias("bin")).agg(
        F.count("*").alias("n"), F.max(lo + (hi - lo) / n_bins * index).alias("left_edge"))


def taylor_statistics(df: DataFrame, split: str = "test") -> DataFrame:
    """Correlation, normalised spread and angle per model."""
    r = F.corr("actual", "predicted")
    return df.where(F.col("split") == split).groupBy("model").agg(
        r.alias("r"),
        safe_divide(F.stddev_pop("predicted"), F.stddev_pop("actual")).alias("sigma_ratio"),
        F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), r))).alias("theta"))


def largest_miss(df: DataFrame, split: str = "test", spec: SeriesSpec = DEFAULT) -> DataFrame:
    """The day with the largest absolute error per model (first on ties)."""
    miss = F.struct(
        (-F.abs(F.col("predicted") - F.col("actual"))).alias("neg"), spec.series, spec.date,
        "actual", "predicted")
    worst = df.where(F.col("split") == split).groupBy("model").agg(F.min(miss).alias("m"))
    return worst.select(
        "model", F.col(f"m.{spec.series}"), F.col(f"m.{spec.date}"), "m.actual", "m.predicted",
        (-F.col("m.neg")).alias("abs_error"))


def rain_hit_rate(df: DataFrame, by: Sequence[str] = GROUP) -> DataFrame:
    """Hit rate with the inclusive threshold (>= 0.1)."""
    wet = F.col("actual") >= DRY_LIMIT
    hit = wet & (F.col("predicted") >= DRY_LIMIT)
    return df.groupBy(*by).agg(
        (F.count_if(hit) / F.greatest(F.count_if(wet), F.lit(1))).alias("hit_rate"))


def best_per_metric(table: DataFrame) -> DataFrame:
    """The best model for each metric of a comparison table."""
    rows = F.array(*[
        F.struct(F.lit(m).alias("metric"), (F.col(m) * sign).alias("cost"), F.col(m).alias("value"))
        for ms, sign in ((LOWER_IS_BETTER, 1), (HIGHER_IS_BETTER, -1)) for m in ms])
    best = table.select("model", F.inline(rows)).where(F.col("cost").isNotNull()).groupBy(
        "metric").agg(F.min(F.struct("cost", "model", "value")).alias("b"))
    return best.select("metric", F.col("b.model").alias("model"), F.col("b.value").alias("value"))


def season_zoom(
    df: DataFrame, months: int = 5, first_month: int = 6, spec: SeriesSpec = DEFAULT
) -> DataFrame:
    """Rows from the first day of ``first_month`` over the following months."""
    start = F.min(F.when(F.month(spec.date) == first_month, F.col(spec.date))).over(spec.whole("model"))
    return (
        df.withColumn("_start", start)
        .where(F.col(spec.date).between(F.col("_start"), F.add_months("_start", months)))
        .drop("_start"))


def extreme_errors(
    df: DataFrame, split: str = "test", threshold: float = EXTREME_EVENT
) -> DataFrame:
    """MAE on extreme days per model, best first."""
    return (
        df.where((F.col("split") == split) & (F.col("actual") >= threshold))
        .groupBy("model")
        .agg(F.avg(F.abs(F.col("actual") - F.col("predicted"))).alias("mae_extreme"),
             F.count("*").alias("n"))
        .orderBy("mae_extreme", "model"))


def extreme_days(
    df: DataFrame, split: str = "test", threshold: float = EXTREME_EVENT
) -> DataFrame:
    """Every extreme day with its error per model."""
    return residuals(df.where((F.col("split") == split) & (F.col("actual") >= threshold)))
