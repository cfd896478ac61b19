"""Correlation, collinearity and trend lines over the pooled panel."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pluvia.functions.exprs import is_monsoon
from pluvia.functions.quantiles import exact_quantiles
from pluvia.functions.special import student_two_sided
from pluvia.session import materialise
from pluvia.spec import DEFAULT, SeriesSpec

# Severity limits of the variance inflation factor.
SEVERE_VIF, MODERATE_VIF, CONSTANT_STD = 10.0, 5.0, 1e-8
# Eigenvalues of a correlation matrix under this are rounding errors of zero.
DEPENDENT = 1e-11


def comoments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Counts, means and centred second moments of every column pair a <= b.

    Columns: a, b, n, mean_a, mean_b, caa, cbb, cab; pairwise complete. Dozens
    of declarative ``corr`` aggregates over one row outgrow generated code, so
    each task folds its Arrow batches into p x p matrices instead, and only
    those partial moments are shuffled and merged.
    """
    names = list(columns)
    at, bt = np.triu_indices(len(names))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shift, sums = None, None
        for batch in batches:
            x = batch.to_numpy(float)
            if not len(x):
                continue
            seen = ~np.isnan(x)
            if shift is None:
                # Any common centre works; the first batch's mean keeps sums small.
                shift = np.where(seen, x, 0).sum(0) / np.maximum(seen.sum(0), 1)
            m = seen.astype(float)
            x = np.where(seen, x - shift, 0.0)
            part = np.stack([m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x])
            sums = part if sums is None else sums + part
        if sums is None:
            return
        n, first, square, cross = sums
        with np.errstate(invalid="ignore", divide="ignore"):
            mean = np.where(n > 0, first / n, 0.0)
        out = {
            "i": at, "j": bt, "n": n[at, bt].astype("int64"),
            "ma": mean[at, bt] + shift[at], "mb": mean[bt, at] + shift[bt],
            "caa": square[at, bt] - n[at, bt] * mean[at, bt] ** 2,
            "cbb": square[bt, at] - n[at, bt] * mean[bt, at] ** 2,
            "cab": cross[at, bt] - n[at, bt] * mean[at, bt] * mean[bt, at],
        }
        yield pd.DataFrame(out)

    schema = "i int, j int, n bigint, ma double, mb double, caa double, cbb double, cab double"
    parts = df.select(*[F.col(c).cast("double").alias(c) for c in names]).mapInPandas(fold, schema)
    n, ma, mb = F.col("n"), F.col("ma"), F.col("mb")
    pair = Window.partitionBy("i", "j")  # one row per task
    total = F.sum(n).over(pair)
    placed = parts.where(n > 0).withColumns({
        "mean_a": F.sum(n * ma).over(pair) / total, "mean_b": F.sum(n * mb).over(pair) / total})
    da, db = ma - F.col("mean_a"), mb - F.col("mean_b")
    # Moments within the tasks plus the spread of the task means around the common one.
    merged = placed.groupBy("i", "j").agg(
        F.sum("n").alias("n"), F.first("mean_a").alias("mean_a"), F.first("mean_b").alias("mean_b"),
        F.sum(F.col("caa") + n * da * da).alias("caa"),
        F.sum(F.col("cbb") + n * db * db).alias("cbb"),
        F.sum(F.col("cab") + n * da * db).alias("cab"))
    label = F.array(*[F.lit(c) for c in names])
    return merged.select(
        F.get(label, F.col("i")).alias("a"), F.get(label, F.col("j")).alias("b"),
        "n", "mean_a", "mean_b", "caa", "cbb", "cab")


def pearson():
    """r from a comoment row; NULL for a constant column."""
    spread = F.sqrt(F.col("caa")) * F.sqrt(F.col("cbb"))
    return F.when((F.col("caa") > 0) & (F.col("cbb") > 0), F.col("cab") / spread)


def correlation_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson r and number of complete rows for every pair of columns, in one pass.

    Pairwise complete: a row counts for a pair if both values are present.
    """
    moments = comoments(df, columns).where(F.col("a") != F.col("b"))
    return moments.select(
        F.col("a").alias("feature_a"), F.col("b").alias("feature_b"), pearson().alias("r"), "n")


def target_correlation(
    df: DataFrame, features: Sequence[str], spec: SeriesSpec = DEFAULT, top: int | None = None
) -> DataFrame:
    """r with the target and with log1p of it, ranked by |r|; ``top`` keeps the k best."""
    logged = df.withColumn("_log", F.log1p(F.col(spec.target)))
    pairs = correlation_pairs(logged, [*features, spec.target, "_log"])
    with_ = lambda t: F.max(F.when(F.col("feature_b") == t, F.col("r")))
    rows = pairs.where(F.col("feature_a").isin(*features)).groupBy(
        F.col("feature_a").alias("feature")
    ).agg(with_(spec.target).alias("r"), with_("_log").alias("r_log"),
          F.max(F.when(F.col("feature_b") == spec.target, F.col("n"))).alias("n"))
    order = Window.partitionBy(F.lit(1)).orderBy(F.abs("r").desc_nulls_last(), "feature")  # p rows
    ranked = rows.withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= top) if top else ranked


def correlation_significance(ranked: DataFrame) -> DataFrame:
    """Two-sided p-value of r_log from its t statistic."""
    r2 = F.least(F.col("r_log") * F.col("r_log"), F.lit(1 - 1e-15))
    t = F.col("r_log") * F.sqrt((F.col("n") - 2) / (1 - r2))
    return ranked.withColumn("t_stat", t).withColumn(
        "p_value", student_two_sided("t_stat", (F.col("n") - 2).cast("double")))


def variance_inflation(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """VIF with intercept over complete cases; constant columns are left out.

    VIF_i is the i-th diagonal element of the inverse correlation matrix. The
    correlations come from one distributed aggregate; the p x p inverse is one
    small row of numbers.
    """
    clean = df.select(*[F.col(c).cast("double").alias(c) for c in features]).dropna()
    moments = comoments(clean, features).agg(
        F.collect_list(F.struct("a", "b", "n", "caa", pearson().alias("r"))).alias("pairs"))
    names = list(features)

    def invert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for pairs in batch["pairs"]:
                std = {p["a"]: math.sqrt(max(p["caa"], 0.0) / max(p["n"] - 1, 1)) for p in pairs}
                kept = [n for n in names if std.get(n, 0.0) > CONSTANT_STD]
                at = {n: i for i, n in enumerate(kept)}
                m = np.eye(len(kept))
                for p in pairs:
                    a, b = p["a"], p["b"]
                    if a != b and a in at and b in at:
                        m[at[a], at[b]] = m[at[b], at[a]] = p["r"]
                # Columns of a linear dependence are those of the null space; the others keep
                # their finite value whatever the dependent ones do.
                roots, axes = np.linalg.eigh(m) if kept else (np.zeros(0), np.zeros((0, 0)))
                null = roots < DEPENDENT * max(1, len(kept))
                vif = (axes[:, ~null] ** 2 / roots[~null]).sum(1)
                vif[(axes[:, null] ** 2).sum(1) > 1e-6] = np.inf
                yield pd.DataFrame({"feature": kept, "vif": vif})

    out = moments.mapInPandas(invert, "feature string, vif double")
    return out.select(
        "feature", F.when(F.col("vif") == float("inf"), F.col("vif")).otherwise(F.bround("vif", 2)).alias("vif"),
        severity(F.col("vif")).alias("severity"))


def severity(vif):
    return F.when(vif > SEVERE_VIF, "Severe").when(vif > MODERATE_VIF, "Moderate").otherwise("Low")


def pair_regressions(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Slope, intercept and r of y over x for each pair, from one set of moments; a constant
    x has no line."""
    moments = comoments(df, list(dict.fromkeys(c for pair in pairs for c in pair)))
    wanted = F.lit(False)
    for x, y in pairs:
        wanted = wanted | ((F.col("a") == x) & (F.col("b") == y))
    slope = F.when(F.col("caa") > 0, F.col("cab") / F.col("caa"))
    return moments.where(wanted).select(
        F.col("a").alias("x"), F.col("b").alias("y"), slope.alias("slope"),
        (F.col("mean_b") - slope * F.col("mean_a")).alias("intercept"), pearson().alias("r"))


def collinear_groups(df: DataFrame, spec: SeriesSpec = DEFAULT) -> DataFrame:
    """The temperature triad, the soil pair and its replacement, the gradient."""
    derived = df.withColumns({
        "moisture_gradient": F.col("soil_wet_surf") - F.col("soil_wet_root"),
        "log_target": F.log1p(F.col(spec.target)),
    })
    return pair_regressions(derived, [
        ("tmax", "tmin"), ("tmax", "tavg"), ("tmin", "tavg"), ("soil_wet_surf", "soil_wet_root"),
        ("soil_wet_surf", "moisture_gradient"), ("moisture_gradient", spec.target),
        ("moisture_gradient", "log_target")])


def binned_trend(
    df: DataFrame, x: str, y: str, n_bins: int = 20, by: Sequence[str] = (), max_groups: int = 1
) -> DataFrame:
    """Mean of y within quantile bins of x: a trend line that needs no smoother.

    Bin edges are exact quantiles of each group from the bracketed selection.
    """
    by = list(by)
    data = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        *by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    inner = [i / n_bins for i in range(1, n_bins)]
    edges = exact_quantiles(data, "x", inner, by, max_groups).groupBy(*by).agg(
        F.sort_array(F.collect_list("q")).alias("edges"))
    if by:
        data = data.join(materialise(edges, "bin-edges"), by)  # read back, its size is known
    else:
        data = data.withColumn("edges", edges.scalar())
    # Edges at or below x, counted over a short array.
    bin_no = F.size(F.filter("edges", lambda e: F.col("x") > e))
    return data.groupBy(*by, bin_no.alias("bin")).agg(
        F.count("*").alias("n"), F.avg("x").alias("x_mean"), F.avg("y").alias("y_mean"))


def seasonal_trend(
    df: DataFrame, x: str, n_bins: int = 20, spec: SeriesSpec = DEFAULT
) -> DataFrame:
    """Trend of log1p(target) over one feature, monsoon against the rest."""
    label = F.when(is_monsoon(spec.date, spec.monsoon), "Monsoon").otherwise("Non-Monsoon")
    data = df.withColumns({"season_group": label, "log_target": F.log1p(F.col(spec.target))})
    return binned_trend(data, x, "log_target", n_bins, ["season_group"], max_groups=2)


def recommendations(
    pairs: DataFrame, vif: DataFrame | None, target: str,
    watched: Mapping[tuple[str, str], float],
) -> DataFrame:
    """Rules over the correlation table: watched pairs beyond their limit, the three
    strongest positive and two strongest negative correlates, severe VIFs."""
    on_target = pairs.where((F.col("feature_a") == target) | (F.col("feature_b") == target)).select(
        F.when(F.col("feature_a") == target, F.col("feature_b")).otherwise(F.col("feature_a")).alias("feature"),
        "r")
    pos = on_target.where(F.col("r") > 0).orderBy(F.col("r").desc(), "feature").limit(3)
    neg = on_target.where(F.col("r") < 0).orderBy("r", "feature").limit(2)
    cond = F.lit(False)
    for (a, b), limit in watched.items():
        hit = (F.col("feature_a") == a) & (F.col("feature_b") == b)
        cond = cond | (hit & (F.abs("r") > limit))
    none = F.lit(None).cast("string")
    out = (
        pairs.where(cond).select(F.lit("collinear_pair").alias("rule"), F.col("feature_a").alias("feature"),
                                 F.col("feature_b").alias("other"), F.col("r").alias("value"))
        .unionByName(pos.select(F.lit("top_positive").alias("rule"), "feature", none.alias("other"), F.col("r").alias("value")))
        .unionByName(neg.select(F.lit("top_negative").alias("rule"), "feature", none.alias("other"), F.col("r").alias("value"))))
    if vif is not None:
        severe = vif.where(F.col("severity") == "Severe")
        out = out.unionByName(severe.select(
            F.lit("severe_vif").alias("rule"), "feature", none.alias("other"), F.col("vif").alias("value")))
    return out
