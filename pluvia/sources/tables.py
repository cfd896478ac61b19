"""Readers and writers: CSV, Parquet, scaler parameters, prediction store."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pluvia.operators.validate import coerce_numeric, drop_undated, require_columns
from pluvia.spec import DEFAULT, SeriesSpec

PREDICTION_SCHEMA = T.StructType([
    T.StructField("series_id", T.LongType()),
    T.StructField("date", T.DateType()),
    T.StructField("actual", T.DoubleType()),
    T.StructField("predicted", T.DoubleType()),
    T.StructField("model", T.StringType()),
    T.StructField("split", T.StringType()),
])


def read_csv(
    spark: SparkSession, path: str, columns: Sequence[str], spec: SeriesSpec = DEFAULT
) -> DataFrame:
    """Text columns by header name; a required column that is absent raises.

    Nothing is inferred: the header row alone is sampled for the names, and the
    values stay text until the lenient casts of the validation step.
    """
    header = spark.read.csv(path, header=True, inferSchema=False, enforceSchema=False)
    require_columns(header, columns)
    return header.select(*columns)


def read_typed_csv(
    spark: SparkSession, path: str, spec: SeriesSpec = DEFAULT, measures: Sequence[str] = ()
) -> DataFrame:
    """CSV to a typed panel: dates parsed, undated rows dropped, measures to double."""
    raw = read_csv(spark, path, [*spec.key, *measures], spec)
    typed = raw.withColumn(spec.series, F.col(spec.series).try_cast("bigint"))
    return coerce_numeric(drop_undated(typed, spec), measures)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*require_columns(df, columns).select(*columns).columns) if columns else df


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ("split",)) -> None:
    """Snappy Parquet, one directory per split (and model)."""
    df.write.mode("overwrite").option("compression", "snappy").partitionBy(*partition_by).parquet(path)


def write_scaler(parameters: DataFrame, path: str, suffix: str) -> None:
    """Scaler parameters as JSON: {suffix, features[], mean[], std[]} in one line."""
    row = F.sort_array(F.collect_list(F.struct("feature", "mean", "std")))
    folded = parameters.agg(row.alias("r")).select(
        F.lit(suffix).alias("suffix"),
        F.col("r.feature").alias("features"),
        F.col("r.mean").alias("mean"),
        F.col("r.std").alias("std"),
    )
    folded.write.mode("overwrite").json(path)


def read_scaler(spark: SparkSession, path: str) -> DataFrame:
    """The JSON parameters back as one row per feature."""
    schema = "suffix string, features array<string>, mean array<double>, std array<double>"
    return spark.read.schema(schema).json(path).select(
        F.inline(F.arrays_zip("features", "mean", "std"))
    ).withColumnRenamed("features", "feature")


def write_predictions(df: DataFrame, path: str) -> None:
    """Prediction store: one directory per model and split."""
    write_parquet(df, path, ("model", "split"))


def load_predictions(
    spark: SparkSession, path: str, models: Sequence[str], split: str | None = None
) -> DataFrame:
    """Predictions of the listed models that exist; other partitions are never read."""
    df = spark.read.schema(PREDICTION_SCHEMA).parquet(path).where(F.col("model").isin(*models))
    if split is not None:
        df = df.where(F.col("split") == split)
    return df.select("model", "split", *DEFAULT.key, "actual", "predicted")


def dataset_kpis(
    df: DataFrame, spec: SeriesSpec = DEFAULT, n_features: int | None = None
) -> DataFrame:
    """Records, span, years, dry share, maximum, annual mean and monsoon share per series.

    Two levels: the yearly totals carry everything the series level needs.
    """
    y, d = F.col(spec.target), F.col(spec.date)
    monsoon = F.month(d).isin(*spec.monsoon)
    yearly = df.groupBy(spec.series, F.year(d).alias("year")).agg(
        F.count("*").alias("n"), F.min(d).alias("a"), F.max(d).alias("b"),
        F.count_if(y < 0.1).alias("dry"), F.max(y).alias("mx"), F.sum(y).alias("total"),
        F.sum(F.when(monsoon, y).otherwise(0.0)).alias("mon"),
    )
    n = n_features if n_features is not None else len(spec.features)
    return yearly.groupBy(spec.series).agg(
        F.sum("n").alias("n_records"),
        F.min("a").alias("date_start"),
        F.max("b").alias("date_end"),
        F.count("*").alias("n_years"),
        F.lit(n).alias("n_features"),
        (F.sum("dry") / F.sum("n") * 100).alias("pct_dry"),
        F.max("mx").alias("max_rainfall"),
        F.avg("total").alias("annual_mean"),
        (F.sum("mon") / F.sum("total") * 100).alias("monsoon_pct"),
    )
