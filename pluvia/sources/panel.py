"""Panels derived from the transactional tables.

A series is a supplier, its daily target the shipped quantity; the covariates
are daily aggregates over all line items.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from pluvia.operators.calendar import add_calendar, attach_covariates, densify, split_by_position
from pluvia.spec import DEFAULT, SeriesSpec

# Rows of the dense panel that one task sorts for its windows. The shuffled rows are far
# fewer than those they are stretched to, so their bytes are no measure for a task.
PANEL_ROWS = 300_000
# A table of this many days is sent to every executor instead of shuffling the panel by day.
SENT_DAYS = 100_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def sparse_panel(spark: SparkSession, folder: str) -> DataFrame:
    """One row per series and day with shipments; gaps stay gaps."""
    return (
        table(spark, folder, "lineitem")
        .groupBy(F.col("l_suppkey").alias("series_id"), F.to_date("l_shipdate").alias("date"))
        .agg(F.sum("l_quantity").alias("rainfall"))
    )


def calendar_bounds(spark: SparkSession, folder: str) -> DataFrame:
    """One row with the first and last day of the whole panel."""
    return table(spark, folder, "lineitem").agg(
        F.to_date(F.min("l_shipdate")).alias("first_day"),
        F.to_date(F.max("l_shipdate")).alias("last_day"),
    )


def panel_extent(spark: SparkSession, folder: str) -> Row:
    """Number of calendar days, of undated line items and, to a few per cent, of series."""
    return table(spark, folder, "lineitem").agg(
        (F.datediff(F.max("l_shipdate"), F.min("l_shipdate")) + 1).alias("days"),
        F.count_if(F.col("l_shipdate").isNull()).alias("undated"),
        F.approx_count_distinct("l_suppkey").alias("series")).head()


def panel_tasks(spark: SparkSession, extent: Row) -> int:
    """Tasks of the dense panel: by its rows after stretching, so that they stay of one size."""
    few = min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return max(1, few, math.ceil((extent.days or 0) * extent.series / PANEL_ROWS))


def dense_panel(
    spark: SparkSession, folder: str, spec: SeriesSpec = DEFAULT, extent: Row | None = None
) -> DataFrame:
    """Every series on every calendar day, 0 where nothing was measured."""
    bounds = calendar_bounds(spark, folder)
    tasks = panel_tasks(spark, extent or panel_extent(spark, folder))
    return densify(
        sparse_panel(spark, folder).repartition(tasks, spec.series), spec,
        first=bounds.select("first_day").scalar(), last=bounds.select("last_day").scalar(),
    )


def covariates(spark: SparkSession, folder: str) -> DataFrame:
    """Daily covariates, one row per day with line items."""
    share = lambda cond: F.avg(F.when(cond, 1.0).otherwise(0.0))
    return (
        table(spark, folder, "lineitem")
        .groupBy(F.to_date("l_shipdate").alias("date"))
        .agg(
            F.max("l_quantity").alias("tmax"),
            F.min("l_quantity").alias("tmin"),
            F.avg("l_quantity").alias("tavg"),
            (1000 * F.avg("l_discount")).alias("rh"),
            (500 * F.avg("l_tax")).alias("wind"),
            (95 + F.avg("l_extendedprice") / 11000).alias("pressure"),
            (100 * share(F.col("l_returnflag") == "R")).alias("cloud"),
            (40 * share(F.col("l_linestatus") == "F")).alias("solar_rad"),
            share(F.col("l_quantity") > 25).alias("soil_wet_surf"),
            share(F.col("l_quantity") > 20).alias("soil_wet_root"),
        )
    )


def full_panel(spark: SparkSession, folder: str, spec: SeriesSpec = DEFAULT) -> DataFrame:
    """Dense panel with covariates."""
    extent, daily = panel_extent(spark, folder), covariates(spark, folder)
    if (extent.days or 0) <= SENT_DAYS:
        daily = F.broadcast(daily)
    return attach_covariates(dense_panel(spark, folder, spec, extent), daily, spec)


def split_panel(spark: SparkSession, folder: str, spec: SeriesSpec = DEFAULT) -> DataFrame:
    """Dense panel with covariates, calendar columns and the chronological split."""
    return split_by_position(add_calendar(full_panel(spark, folder, spec), spec), spec)


def daily_covariates(spark: SparkSession, folder: str, spec: SeriesSpec = DEFAULT) -> DataFrame:
    """The covariates of every calendar day of the panel, one row per day."""
    days = calendar_bounds(spark, folder).select(F.explode(F.sequence("first_day", "last_day")).alias(spec.date))
    return attach_covariates(days, covariates(spark, folder), spec)


def event_panel(spark: SparkSession, folder: str) -> DataFrame:
    """A second, short panel: daily event values by event type."""
    return (
        table(spark, folder, "events")
        .groupBy(F.col("event_type").alias("series_id"), F.to_date("ts").alias("date"))
        .agg(F.sum("value").alias("rainfall"))
    )


def raw_records(spark: SparkSession, folder: str) -> DataFrame:
    """Unvalidated records as a file would hold them: text dates and text measures.

    Some dates cannot be parsed, some measures are not numbers, some are
    missing, and several records share a series and day.
    """
    line = F.col("l_linenumber")
    return table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("series_id"),
        F.when(line == 7, "unknown")
        .when(line == 6, "1999-02-30")
        .otherwise(F.to_date("l_shipdate").cast("string")).alias("date"),
        F.when(line == 5, "n/a")
        .otherwise(F.col("l_quantity").cast("bigint").cast("string")).alias("rainfall"),
        F.when(line != 3, F.col("l_tax") * 1000).alias("rh"),
        F.when(line == 2, F.lit(float("nan"))).otherwise(F.col("l_discount") * 1000).alias("cloud"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice",
    )


RAW_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
