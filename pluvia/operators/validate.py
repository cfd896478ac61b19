"""Validation and cleaning of raw records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pluvia.functions.exprs import col, not_nan
from pluvia.operators.calendar import SPLITS
from pluvia.spec import DEFAULT, SeriesSpec


class ValidationError(ValueError):
    """Raised when a check that must hold does not."""


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValidationError(f"Missing required columns: {missing}")
    return df


def parse_dates(df: DataFrame, spec: SeriesSpec = DEFAULT) -> DataFrame:
    """Lenient parse: what is not a date becomes NULL."""
    return df.withColumn(spec.date, col(spec.date).try_cast("date"))


def unparseable_dates(df: DataFrame, spec: SeriesSpec = DEFAULT) -> DataFrame:
    """Per series: records, records without a usable date, verdict."""
    bad = F.count_if(F.col(spec.date).isNull())
    return parse_dates(df, spec).groupBy(spec.series).agg(
        F.count("*").alias("n_records"),
        bad.alias("n_unparseable"),
        (bad == 0).alias("passed"),
    )


def drop_undated(df: DataFrame, spec: SeriesSpec = DEFAULT) -> DataFrame:
    return parse_dates(df, spec).where(F.col(spec.date).isNotNull())


def keep_first(
    df: DataFrame, order: Sequence[str], spec: SeriesSpec = DEFAULT
) -> DataFrame:
    """The first record of each series and day in ``order``.

    The minimum of a struct instead of a row number: it combines on the map
    side, so a day repeated any number of times still moves one row per task.
    """
    keys = spec.key
    rest = [c for c in df.columns if c not in keys and c not in order]
    first = F.min(F.struct(*order, *rest)).alias("_first")
    return (
        df.groupBy(*keys).agg(first, F.count("*").alias("n_records"))
        .select(*keys, *[F.col(f"_first.{c}").alias(c) for c in [*order, *rest]], "n_records")
    )


def duplicate_dates(df: DataFrame, spec: SeriesSpec = DEFAULT) -> DataFrame:
    """Per series: records beyond the first of their day, verdict."""
    per_day = df.groupBy(*spec.key).agg(F.count("*").alias("n"))
    extra = F.sum(F.col("n") - 1)
    return per_day.groupBy(spec.series).agg(
        extra.alias("n_duplicates"), (extra == 0).alias("passed")
    )


def temporal_gaps(df: DataFrame, spec: SeriesSpec = DEFAULT) -> DataFrame:
    """Runs of missing days between present days; needs one row per day."""
    nxt = F.lead(spec.date).over(spec.ordered())
    return (
        df.select(*spec.key, nxt.alias("_next"))
        .where(F.datediff("_next", spec.date) > 1)
        .select(
            spec.series,
            F.date_add(spec.date, 1).alias("gap_start"),
            F.date_sub("_next", 1).alias("gap_end"),
            (F.datediff("_next", spec.date) - 1).alias("n_days"),
        )
    )


def missing_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NULL or NaN count per column, before any coercion."""
    types = dict(df.dtypes)

    def missing(c: str) -> Column:
        value = not_nan(c) if types[c] in ("double", "float") else F.col(c)
        return F.count_if(value.isNull()).alias(c)

    return _unpivot(df.agg(*[missing(c) for c in columns]), columns, "n_missing")


def coerce_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Every measure to double; text that is no number and NaN become NULL."""
    types = dict(df.dtypes)
    casts = {
        c: F.col(c).try_cast("double") if types[c] not in ("double", "float") else not_nan(c)
        for c in columns
    }
    return df.withColumns(casts)


def dtype_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Non-numeric columns: source type, values lost by coercion."""
    text = [c for c, t in df.dtypes if c in columns and t == "string"]
    lost = df.agg(*[
        F.count_if(F.col(c).isNotNull() & F.col(c).try_cast("double").isNull()).alias(c)
        for c in text
    ])
    return _unpivot(lost, text, "n_lost").withColumn("source_type", F.lit("string"))


def bound_violations(
    df: DataFrame, bounds: Mapping[str, tuple[float, float]]
) -> DataFrame:
    """Values outside the physical bounds per column, in one pass; NULL never violates."""
    names = [c for c in bounds if c in df.columns]
    counted = df.agg(*[
        F.count_if((F.col(c) < bounds[c][0]) | (F.col(c) > bounds[c][1])).alias(c) for c in names
    ])
    lo = F.create_map(*[F.lit(x) for c in names for x in (c, float(bounds[c][0]))])
    hi = F.create_map(*[F.lit(x) for c in names for x in (c, float(bounds[c][1]))])
    return _unpivot(counted, names, "n_violations").withColumns({
        "lower_bound": lo[F.col("column_name")],
        "upper_bound": hi[F.col("column_name")],
    })


def validation_report(
    raw: DataFrame,
    order: Sequence[str],
    measures: Sequence[str],
    bounds: Mapping[str, tuple[float, float]],
    spec: SeriesSpec = DEFAULT,
) -> DataFrame:
    """One row per check: (check_name, item, n_found, passed). Only undated and
    duplicate records fail the run; gaps, missing values and bounds warn.

    One scan: undated records stay in as the NULL day of their series, and all
    counts come from a single aggregate over the first record of each day.
    """
    require_columns(raw, [*spec.key, *measures])
    first = keep_first(parse_dates(raw, spec), order, spec)
    day = F.col(spec.date)
    types = dict(first.dtypes)
    first = first.withColumn(
        "_gap", F.datediff(F.lead(day).over(spec.ordered()), day) - 1
    )
    dated = day.isNotNull()

    def number(c: str) -> Column:
        return F.col(c).try_cast("double") if types[c] == "string" else not_nan(c)

    def missing(c: str) -> Column:
        return (F.col(c) if types[c] == "string" else not_nan(c)).isNull()

    counts = {
        ("unparseable_dates", spec.date): F.sum(F.when(~dated, F.col("n_records")).otherwise(0)),
        ("duplicate_dates", spec.date): F.sum(F.when(dated, F.col("n_records") - 1).otherwise(0)),
        ("missing_days", spec.date): F.sum(F.coalesce("_gap", F.lit(0))),
        ("rows_kept", "*"): F.count_if(dated),
    }
    for c in measures:
        counts["missing_values", c] = F.count_if(dated & missing(c))
    for c in measures:
        if types[c] == "string":
            counts["not_numeric", c] = F.count_if(
                dated & F.col(c).isNotNull() & number(c).isNull()
            )
    for c, (lo, hi) in bounds.items():
        if c in types:
            counts["bound_violations", c] = F.count_if(dated & ((number(c) < lo) | (number(c) > hi)))
    wide = first.agg(*[e.alias(f"n{i}") for i, e in enumerate(counts.values())])
    fails = {"unparseable_dates", "duplicate_dates"}
    return wide.select(F.inline(F.array(*[
        F.struct(
            F.lit(check).alias("check_name"),
            F.lit(item).alias("item"),
            F.col(f"n{i}").cast("bigint").alias("n_found"),
            ((F.col(f"n{i}") == 0) if check in fails else F.lit(True)).alias("passed"),
        )
        for i, (check, item) in enumerate(counts)
    ])))


def raise_on_failure(report: DataFrame) -> DataFrame:
    """Stop a run whose report has a failed check (the report is a few rows)."""
    failed = [r.check_name for r in report.where(~F.col("passed")).collect()]
    if failed:
        raise ValidationError(f"Validation failed: {sorted(set(failed))}")
    return report


def invariants(
    df: DataFrame, warmup_columns: Sequence[str] = (), spec: SeriesSpec = DEFAULT
) -> DataFrame:
    """Violations of what every processed table must satisfy, one row per check."""
    prev = F.lag(spec.date).over(spec.ordered())
    stepped = df.withColumn("_step", F.datediff(spec.date, prev))
    warm = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in warmup_columns], F.lit(False))
    per_series = stepped.groupBy(spec.series).agg(
        F.count_if(F.col("_step") <= 0).alias("dates_not_increasing"),
        F.count_if(F.col("_step") > 1).alias("calendar_gaps"),
        F.count_if(warm).alias("warmup_rows_left"),
        *[f(F.when(F.col("split") == s, F.col(spec.date))).alias(f"{s}_{f.__name__}")
          for s in SPLITS for f in (F.min, F.max)],
    )
    overlap = ((F.col("train_max") >= F.col("val_min")) | (F.col("val_max") >= F.col("test_min")))
    checks = per_series.agg(
        F.sum("dates_not_increasing").alias("dates_not_increasing"),
        F.sum("calendar_gaps").alias("calendar_gaps"),
        F.sum("warmup_rows_left").alias("warmup_rows_left"),
        F.count_if(overlap).alias("splits_overlapping"),
    )
    names = ["dates_not_increasing", "calendar_gaps", "warmup_rows_left", "splits_overlapping"]
    return _unpivot(checks, names, "n_violations").withColumnRenamed("column_name", "check_name")


def _unpivot(one_row: DataFrame, columns: Sequence[str], value: str) -> DataFrame:
    return one_row.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("bigint").alias(value))
        for c in columns
    ])))
