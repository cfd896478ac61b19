"""Seasonal and temporal profile of each series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pluvia.functions.exprs import bin_index, is_monsoon, season
from pluvia.functions.frames import centred, trailing
from pluvia.functions.special import normal_two_sided, student_two_sided
from pluvia.operators.distribution import yearly
from pluvia.operators.features import add_dry_spell_length
from pluvia.spec import DEFAULT, DRY_LIMIT, SEASONS, SeriesSpec

LONG_SPELL = 30


def monthly_climatology(df: DataFrame, spec: SeriesSpec = DEFAULT) -> DataFrame:
    y = F.col(spec.target)
    q = F.percentile(y, [0.25, 0.5, 0.75, 0.95])
    out = df.groupBy(spec.series, F.month(spec.date).alias("month")).agg(
        F.avg(y).alias("mean"), F.stddev_samp(y).alias("std"), F.sum(y).alias("total"), q.alias("q"))
    names = ["p25", "median", "p75", "p95"]
    return out.select(
        spec.series, "month", "mean", "std", "total",
        *[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(names)])


def monthly_share(df: DataFrame, spec: SeriesSpec = DEFAULT) -> DataFrame:
    """Share of the grand total and share of days with rain (>= 0.1) per month."""
    y = F.col(spec.target)
    monthly = df.groupBy(spec.series, F.month(spec.date).alias("month")).agg(
        F.sum(y).alias("total"), (F.avg((y >= DRY_LIMIT).cast("double")) * 100).alias("p_wet_pct"))
    return monthly.withColumn("share_pct", F.col("total") / F.sum("total").over(spec.whole()) * 100)


def season_share(df: DataFrame, spec: SeriesSpec = DEFAULT) -> DataFrame:
    """Fraction of the grand total per season."""
    label, y = season(F.month(spec.date)), F.col(spec.target)
    wide = df.groupBy(spec.series).agg(
        F.sum(y).alias("all"),
        *[F.sum(F.when(label == s, y).otherwise(0.0)).alias(s) for s in SEASONS])
    rows = F.array(*[F.struct(F.lit(s).alias("season"), F.col(f"`{s}`").alias("total")) for s in SEASONS])
    return wide.select(spec.series, "all", F.inline(rows)).select(
        spec.series, "season", "total", (F.col("total") / F.col("all") * 100).alias("share_pct"))


def yearly_season_share(df: DataFrame, spec: SeriesSpec = DEFAULT) -> DataFrame:
    """Monsoon total and its fraction of the year, per year."""
    y = F.col(spec.target)
    mon = F.sum(F.when(is_monsoon(spec.date, spec.monsoon), y).otherwise(0.0))
    return df.groupBy(spec.series, F.year(spec.date).alias("year")).agg(
        mon.alias("monsoon_total"), F.sum(y).alias("annual_total"),
        F.when(F.sum(y) != 0, mon / F.sum(y) * 100).alias("monsoon_pct"))


def annual_anomalies(df: DataFrame, spec: SeriesSpec = DEFAULT) -> DataFrame:
    """Yearly totals, departure from the long-term mean and +-1 std flag."""
    w = spec.whole()
    anomaly = F.col("total") - F.avg("total").over(w)
    return yearly(df, spec).select(
        spec.series, "year", "total", anomaly.alias("anomaly"),
        (F.abs(anomaly) > F.stddev_samp("total").over(w)).alias("unusual"))


def annual_trend(df: DataFrame, spec: SeriesSpec = DEFAULT) -> DataFrame:
    """Least-squares trend of the yearly totals with extreme years (first on ties)."""
    by_low = F.min(F.struct("total", "year"))
    by_high = F.max(F.struct(F.col("total"), (-F.col("year")).alias("minus_year")))
    return yearly(df, spec).groupBy(spec.series).agg(
        F.count("*").alias("n_years"),
        F.regr_slope("total", "year").alias("slope"),
        F.regr_intercept("total", "year").alias("intercept"),
        F.regr_r2("total", "year").alias("r2"),
        by_low["year"].alias("driest_year"),
        (-by_high["minus_year"]).alias("wettest_year"),
    )


def trend_significance(df: DataFrame, spec: SeriesSpec = DEFAULT) -> DataFrame:
    """t statistic and two-sided p-value of the annual trend."""
    trend = annual_trend(df, spec)
    dof = F.col("n_years") - 2
    r2 = F.least(F.col("r2"), F.lit(1.0 - 1e-15))
    t = F.signum("slope") * F.sqrt(r2 * dof / (1 - r2))
    return trend.withColumn("t_stat", t).withColumn(
        "p_value", student_two_sided("t_stat", dof.cast("double"))
    ).withColumn("significant", F.col("p_value") < 0.05)


def mann_kendall(df: DataFrame, spec: SeriesSpec = DEFAULT) -> DataFrame:
    """Mann-Kendall S, tie-corrected variance and Z on the yearly totals.

    The years of one series are a short ordered array, compared in place.
    """
    totals = F.transform(
        F.sort_array(F.collect_list(F.struct("year", "total"))), lambda e: e["total"])
    arr = yearly(df, spec).groupBy(spec.series).agg(totals.alias("y"))
    n = F.size("y")
    s = F.aggregate(
        F.transform("y", lambda v, i: F.aggregate(
            F.slice("y", i + 2, F.greatest(n - i - 1, F.lit(0))), F.lit(0),
            lambda acc, later: acc + F.signum(later - v).cast("int"))),
        F.lit(0), lambda acc, x: acc + x)
    ties = F.aggregate(
        F.transform("y", lambda v: F.size(F.filter("y", lambda o: o == v))),
        F.lit(0), lambda acc, t: acc + (t - 1) * (2 * t + 5))
    out = arr.select(spec.series, n.alias("n"), s.alias("s"),
                     ((n * (n - 1) * (2 * n + 5) - ties) / 18.0).alias("var_s"))
    z = F.when(F.col("var_s") <= 0, 0.0).otherwise(
        (F.col("s") - F.signum("s")) / F.sqrt("var_s"))
    verdict = F.when(F.abs("z") <= 1.959963984540054, "no trend").when(
        F.col("z") > 0, "increasing").otherwise("decreasing")
    return out.withColumn("z", z).withColumn("verdict", verdict)


def mann_kendall_significance(df: DataFrame, spec: SeriesSpec = DEFAULT) -> DataFrame:
    return mann_kendall(df, spec).withColumn("p_value", normal_two_sided("z"))


def dry_spells(df: DataFrame, min_length: int = 3, spec: SeriesSpec = DEFAULT) -> DataFrame:
    """Maximal runs of dry days with at least ``min_length`` days.

    A run ends where the counter is positive and the next day is wet or absent,
    and its start follows from the counter, so the runs need no second grouping.
    """
    counted = add_dry_spell_length(df, spec)
    nxt = F.coalesce(F.lead("dry_spell_length").over(spec.ordered()), F.lit(0))
    length = F.col("dry_spell_length")
    return (
        counted.withColumn("_next", nxt)
        .where((length >= min_length) & (F.col("_next") == 0))
        .select(spec.series, F.date_sub(spec.date, length - 1).alias("start_date"),
                F.col(spec.date).alias("end_date"), length.alias("n_days"))
    )


def dry_spell_stats(df: DataFrame, min_length: int = 3, spec: SeriesSpec = DEFAULT) -> DataFrame:
    n = F.col("n_days")
    return dry_spells(df, min_length, spec).groupBy(spec.series).agg(
        F.count("*").alias("n_spells"), F.max(n).alias("max_days"), F.avg(n).alias("mean_days"),
        F.count_if(n > LONG_SPELL).alias("n_long"))


def spell_start_months(df: DataFrame, spec: SeriesSpec = DEFAULT) -> DataFrame:
    """Starts of all dry runs per calendar month, months without a start count 0."""
    dry = F.coalesce(F.col(spec.target) < DRY_LIMIT, F.lit(False))
    flagged = df.withColumn("_dry", dry)
    before = F.coalesce(F.lag("_dry").over(spec.ordered()), F.lit(False))
    starts = flagged.withColumn("_start", F.col("_dry") & ~before)
    wide = starts.groupBy(spec.series).agg(*[
        F.count_if(F.col("_start") & (F.month(spec.date) == m)).alias(f"m{m}") for m in range(1, 13)])
    return wide.select(spec.series, F.inline(F.array(*[
        F.struct(F.lit(m).alias("month"), F.col(f"m{m}").alias("n_starts")) for m in range(1, 13)])))


def spell_length_ecdf(df: DataFrame, min_length: int = 3, spec: SeriesSpec = DEFAULT) -> DataFrame:
    """Cumulative share of spells up to each length."""
    lengths = dry_spells(df, min_length, spec).groupBy(spec.series, "n_days").agg(
        F.count("*").alias("n"))
    w = spec.whole()
    upto = F.sum("n").over(w.orderBy("n_days").rowsBetween(Window.unboundedPreceding, 0))
    return lengths.select(spec.series, "n_days", "n", (upto / F.sum("n").over(w)).alias("ecdf"))


def spell_length_quantiles(
    df: DataFrame, min_length: int = 3, spec: SeriesSpec = DEFAULT
) -> DataFrame:
    q = F.percentile("n_days", [0.5, 0.9])
    return dry_spells(df, min_length, spec).groupBy(spec.series).agg(q.alias("q")).select(
        spec.series, F.get("q", F.lit(0)).alias("median"), F.get("q", F.lit(1)).alias("p90"))


def day_of_year_climatology(
    df: DataFrame, width: int = 14, min_rows: int = 5, spec: SeriesSpec = DEFAULT
) -> DataFrame:
    means = df.groupBy(spec.series, F.dayofyear(spec.date).alias("doy")).agg(
        F.avg(spec.target).alias("mean"))
    w = spec.whole().orderBy("doy")
    return means.withColumn("smooth", centred("mean", width, "avg", w, min_rows))


def year_day_matrix(df: DataFrame, spec: SeriesSpec = DEFAULT) -> DataFrame:
    """log1p of the target as a year x day-of-year matrix, day 366 dropped."""
    d = F.col(spec.date)
    cells = df.where(F.dayofyear(d) <= 365).select(
        spec.series, F.year(d).alias("year"), F.dayofyear(d).alias("doy"),
        F.log1p(F.col(spec.target)).alias("v"))
    # one map of at most 365 days a row, then one projection
    days = cells.groupBy(spec.series, "year", "doy").agg(F.max("v").alias("v"))
    rows = days.groupBy(spec.series, "year").agg(F.map_from_entries(F.collect_list(F.struct("doy", "v"))).alias("m"))
    return rows.select(spec.series, "year", *[F.try_element_at("m", F.lit(i)).alias(f"d{i}") for i in range(1, 366)])


def colour_cap(df: DataFrame, spec: SeriesSpec = DEFAULT) -> DataFrame:
    """99 % quantile of the matrix cells."""
    cells = df.where(F.dayofyear(spec.date) <= 365)
    return cells.groupBy(spec.series).agg(
        F.percentile(F.log1p(F.col(spec.target)), 0.99).alias("cap"))


def filtered_profile(
    df: DataFrame, first: str, last: str, spec: SeriesSpec = DEFAULT
) -> DataFrame:
    """Key figures of a date range."""
    y = F.col(spec.target)
    window = df.where(F.col(spec.date).between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    per_year = window.groupBy(spec.series, F.year(spec.date).alias("year")).agg(
        F.count("*").alias("n"), F.sum(y).alias("total"), F.max(y).alias("mx"),
        F.count_if(y < DRY_LIMIT).alias("dry"))
    return per_year.groupBy(spec.series).agg(
        F.sum("n").alias("n_days"), (F.sum("total") / F.sum("n")).alias("mean"),
        F.max("mx").alias("max"), (F.sum("dry") / F.sum("n") * 100).alias("pct_dry"),
        F.avg("total").alias("annual_mean"))


def column_histogram(
    df: DataFrame, column: str, n_bins: int = 50, spec: SeriesSpec = DEFAULT
) -> DataFrame:
    """Equal-width histogram of any column over the whole panel, by monsoon label."""
    x = F.col(column).cast("double")
    limits = df.agg(F.struct(F.min(x).alias("lo"), F.max(x).alias("hi")).alias("s")).scalar()
    label = F.when(is_monsoon(spec.date, spec.monsoon), "Monsoon").otherwise("Non-Monsoon")
    data = df.where(x.isNotNull()).select(x.alias("x"), label.alias("season"), limits.alias("s"))
    lo, hi = F.col("s.lo"), F.col("s.hi")
    index = bin_index(F.col("x"), lo, hi, n_bins)
    return data.groupBy("season", index.alias("bin")).agg(
        F.count("*").alias("n"), F.max(lo + (hi - lo) / n_bins * index).alias("left_edge"))


def monthly_totals(df: DataFrame, spec: SeriesSpec = DEFAULT) -> DataFrame:
    """Sum per calendar month, labelled with its last day."""
    return df.groupBy(spec.series, F.last_day(spec.date).alias("month_end")).agg(
        F.sum(spec.target).alias("total"))


def monthly_rolling(df: DataFrame, width: int = 12, spec: SeriesSpec = DEFAULT) -> DataFrame:
    """Rolling mean / std and first difference of the monthly totals."""
    w = spec.whole().orderBy("month_end")
    return monthly_totals(df, spec).withColumns({
        "roll_mean": trailing("total", width, "avg", w),
        "roll_std": trailing("total", width, "std", w),
        "diff": F.col("total") - F.lag("total").over(w),
    })


def deseasonalised(
    df: DataFrame, width: int = 30, min_rows: int = 15, spec: SeriesSpec = DEFAULT
) -> DataFrame:
    """Target minus its calendar-month mean, and a centred mean of that."""
    monthly_mean = F.avg(spec.target).over(spec.whole("_month"))
    out = df.withColumn("_month", F.month(spec.date)).withColumn(
        "anomaly", F.col(spec.target) - monthly_mean)
    return out.select(
        *spec.key, "anomaly",
        centred("anomaly", width, "avg", spec.ordered(), min_rows).alias("smooth"))
