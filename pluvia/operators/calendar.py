"""Calendar columns, densification and chronological splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pluvia.functions.exprs import melt, season
from pluvia.spec import DEFAULT, SeriesSpec

SPLITS = ("train", "val", "test")


def add_calendar(df: DataFrame, spec: SeriesSpec = DEFAULT) -> DataFrame:
    """Year, month, day of year, weekday (Monday = 0), season label and monsoon flag."""
    d = F.col(spec.date)
    return df.withColumns({
        "year": F.year(d),
        "month": F.month(d),
        "day_of_year": F.dayofyear(d),
        "day_of_week": F.weekday(d),
        "season": season(F.month(d)),
        "is_monsoon": F.month(d).isin(*spec.monsoon).cast("int"),
    })


def densify(
    df: DataFrame,
    spec: SeriesSpec = DEFAULT,
    first: Column | None = None,
    last: Column | None = None,
    fill: float | None = 0.0,
) -> DataFrame:
    """One row per series and calendar day.

    Each present row is stretched up to the day before the next one, so the
    calendar needs neither a second scan nor a join, and the result keeps the
    partitioning by series for the windows that follow. ``first`` / ``last``
    extend every series to a common calendar; by default each keeps its own.
    Dates must be unique per series.
    """
    w = spec.ordered()
    measures = [c for c in df.columns if c not in spec.key]
    d = F.col(spec.date)
    start = F.when(F.lag(d).over(w).isNull(), first if first is not None else d).otherwise(d)
    end = F.coalesce(F.date_sub(F.lead(d).over(w), 1), last if last is not None else d)
    stretched = df.withColumns({"_from": start, "_to": end}).withColumn(
        "_day", F.explode(F.sequence("_from", "_to"))
    )
    present = F.col("_day") == d
    return stretched.select(
        spec.series,
        F.col("_day").alias(spec.date),
        *[F.when(present, F.col(c)).otherwise(F.lit(fill)).alias(c) for c in measures],
    )


def attach_covariates(
    panel: DataFrame, covariates: DataFrame, spec: SeriesSpec = DEFAULT
) -> DataFrame:
    """Join covariates by day, or by series and day if they carry the series."""
    keys = [k for k in spec.key if k in covariates.columns]
    return panel.join(covariates, keys, "left")


def split_by_position(df: DataFrame, spec: SeriesSpec = DEFAULT) -> DataFrame:
    """Chronological train / val / test by row position, whole days never shared."""
    rank = F.row_number().over(spec.ordered())
    n = F.count(F.lit(1)).over(spec.whole())
    n_train = F.floor(n * F.lit(spec.train_frac))
    n_val = F.floor(n * F.lit(spec.val_frac))
    return df.withColumn(
        "split",
        F.when(rank <= n_train, "train").when(rank <= n_train + n_val, "val").otherwise("test"),
    )


def split_boundaries(df: DataFrame, spec: SeriesSpec = DEFAULT) -> DataFrame:
    """First and last day of each split, one row per series."""
    parts = []
    for s in SPLITS:
        day = F.when(F.col("split") == s, F.col(spec.date))
        parts += [F.min(day).alias(f"{s}_from"), F.max(day).alias(f"{s}_to")]
    return df.groupBy(spec.series).agg(*parts)


def apply_boundaries(
    df: DataFrame, boundaries: DataFrame, spec: SeriesSpec = DEFAULT
) -> DataFrame:
    """Label rows by stored boundary days (inclusive); rows outside are dropped."""
    d = F.col(spec.date)
    label = F.lit(None).cast("string")
    for s in reversed(SPLITS):
        label = F.when(d.between(F.col(f"{s}_from"), F.col(f"{s}_to")), s).otherwise(label)
    bounds = [f"{s}_{e}" for s in SPLITS for e in ("from", "to")]
    return (
        df.drop("split").join(boundaries, spec.series)
        .withColumn("split", label)
        .where(F.col("split").isNotNull())
        .drop(*bounds)
    )


def split_summary(df: DataFrame, spec: SeriesSpec = DEFAULT) -> DataFrame:
    """Rows, date range and share of each split over the whole panel."""
    counts = df.groupBy("split").agg(
        F.count("*").alias("n_rows"),
        F.min(spec.date).alias("date_from"),
        F.max(spec.date).alias("date_to"),
    )
    all_splits = Window.partitionBy(F.lit(1))  # three rows
    total = F.sum("n_rows").over(all_splits)
    return counts.withColumn("fraction_pct", F.col("n_rows") / total * 100)


def column_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """min / max / mean / sample std / missing, one row per column, in one pass."""
    return melt(df, [], columns, "column_name", "x").groupBy("column_name").agg(
        F.min("x").alias("min"), F.max("x").alias("max"), F.avg("x").alias("mean"),
        F.stddev_samp("x").alias("std"),
        F.count_if(F.col("x").isNull()).cast("double").alias("missing"))
