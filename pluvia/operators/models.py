"""Forecast models on MLlib, fitted on the pooled panel.

Iterative fits read a table written once to the shared folder, so the windows
behind the features are not recomputed per pass and a lost executor costs only
its own tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import product

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, LinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvia.functions.exprs import at_least_zero
from pluvia.operators.forecast import hybrid_column, log_residual
from pluvia.session import materialise
from pluvia.spec import DEFAULT, SeriesSpec

SEED = 42
# The tuning grid and the early-stopping tolerance.
GRID = {"trees": (400, 600), "depth": (4, 6), "rate": (0.05, 0.01), "min_rows": (3, 5)}
STOP_TOLERANCE = 0.001
# Exogenous columns of the linear seasonal model and its seasonal lag.
EXOGENOUS = (
    "cloud", "wind", "solar_rad", "cloud_lag1", "cloud_lag3", "cloud_lag7",
    "month_sin", "month_cos", "monsoon_flag")
SEASONAL_LAG = 12
PARALLEL_FITS = 4


def assemble(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Feature vector ``x``; rows with a missing feature are skipped."""
    return VectorAssembler(inputCols=list(features), outputCol="x", handleInvalid="skip").transform(df)


def fitted_rows(df: DataFrame, name: str) -> DataFrame:
    return materialise(df, name)


def class_weight(df: DataFrame) -> DataFrame:
    """Weight of wet rows = train dry rows / train wet rows, dry rows weigh 1."""
    train = df.where(F.col("split") == "train")
    ratio = train.agg(
        (F.count_if(F.col("rain_occurrence") == 0)
         / F.greatest(F.count_if(F.col("rain_occurrence") == 1), F.lit(1))).alias("w")).scalar()
    return df.withColumn("weight", F.when(F.col("rain_occurrence") == 1, ratio).otherwise(1.0))


@dataclass(frozen=True)
class TwoStage:
    """Occurrence classifier and log-amount regressor over one feature list."""

    classifier: GBTClassificationModel
    regressor: GBTRegressionModel
    features: tuple[str, ...]

    def predict(self, df: DataFrame, spec: SeriesSpec = DEFAULT) -> DataFrame:
        """expm1(log amount) on days called wet, else 0; and P(rain)."""
        scored = self.regressor.transform(
            self.classifier.transform(assemble(df, self.features).drop("weight")).select(
                *spec.key, "split", spec.target, "x", F.col("rain_flag"), F.col("rain_prob")))
        amount = at_least_zero(F.expm1("log_amount") * F.col("rain_flag"))
        return scored.select(
            *spec.key, "split", F.col(spec.target).alias("actual"), amount.alias("predicted"),
            vector_to_array("rain_prob")[1].alias("p_rain"))

    def save(self, path: str) -> None:
        PipelineModel([self.classifier, self.regressor]).write().overwrite().save(path)

    @staticmethod
    def load(path: str, features: Sequence[str]) -> TwoStage:
        classifier, regressor = PipelineModel.load(path).stages
        return TwoStage(classifier, regressor, tuple(features))


def _classifier(trees: int, depth: int, rate: float, min_rows: int) -> GBTClassifier:
    return GBTClassifier(
        labelCol="rain_occurrence", featuresCol="x", weightCol="weight", predictionCol="rain_flag",
        maxIter=trees, maxDepth=depth, stepSize=rate, minInstancesPerNode=min_rows, subsamplingRate=0.8, featureSubsetStrategy="0.8",
        validationIndicatorCol="is_val", validationTol=STOP_TOLERANCE, seed=SEED,
    ).setProbabilityCol("rain_prob").setRawPredictionCol("rain_raw")


def _regressor(trees: int, depth: int, rate: float, min_rows: int) -> GBTRegressor:
    return GBTRegressor(
        labelCol="log_rainfall", featuresCol="x", predictionCol="log_amount", maxIter=trees,
        maxDepth=depth, stepSize=rate, minInstancesPerNode=min_rows, subsamplingRate=0.8,
        featureSubsetStrategy="0.8", validationIndicatorCol="is_val", validationTol=STOP_TOLERANCE,
        seed=SEED)


def _combinations(grid: Mapping[str, Iterable]) -> list[dict]:
    keys = ("trees", "depth", "rate", "min_rows")
    return [dict(zip(keys, values)) for values in product(*(grid[k] for k in keys))]


def tune_two_stage(
    df: DataFrame, features: Sequence[str], grid: Mapping[str, Iterable] = GRID
) -> tuple[TwoStage, list[tuple]]:
    """Fit every grid point with early stopping on val; keep the best F1 / log RMSE.

    ``df`` holds the train and val rows of a model-input table. Returns the
    model and one score row per stage and grid point.
    """
    fit_rows = class_weight(df.where(F.col("split") != "test")).withColumn(
        "is_val", F.col("split") == "val")
    rows = fitted_rows(
        assemble(fit_rows, features).select("x", "weight", "is_val", "rain_occurrence", "log_rainfall"),
        "model-input")
    wet = rows.where(F.col("rain_occurrence") == 1)
    scores, best = [], {}
    points = _combinations(grid)
    for stage, build, data, score, sign in (
        ("classifier", _classifier, rows, f1_score, 1), ("regressor", _regressor, wet, log_rmse, -1)):
        def fit(point: dict, build=build, data=data, score=score):
            model = build(**point).fit(data)
            return model, score(model.transform(data.where("is_val")))

        fits = _staged_fits(points, fit)
        for point, (model, value) in zip(points, fits, strict=True):
            scores.append((stage, *point.values(), model.getNumTrees, value))
            if stage not in best or sign * value > sign * best[stage][0]:
                best[stage] = (value, model)
    return TwoStage(best["classifier"][1], best["regressor"][1], tuple(features)), scores


def _staged_fits(points: list[dict], fit) -> list[tuple]:
    """``fit`` of every point, where the largest number of trees stands for the smaller ones.

    Boosting adds trees one by one from one seed, so a fit that stops early on val by
    itself, at no more trees than a smaller number allows, is that smaller fit as well. Only
    where it went on beyond is the smaller number fitted. Independent fits run side by side,
    as one tree's jobs are too small to fill a cluster.
    """
    families: dict[tuple, list[int]] = {}
    for i, p in enumerate(points):
        families.setdefault((p["depth"], p["rate"], p["min_rows"]), []).append(i)
    found: dict[int, tuple] = {}
    with ThreadPoolExecutor(PARALLEL_FITS) as pool:
        largest = [max(own, key=lambda i: points[i]["trees"]) for own in families.values()]
        found.update(zip(largest, pool.map(lambda i: fit(points[i]), largest)))
        rest = []
        for own, top in zip(families.values(), largest, strict=True):
            used = found[top][0].getNumTrees
            for i in own:
                if i != top and used < points[i]["trees"]:
                    found[i] = found[top]
                elif i != top:
                    rest.append(i)
        found.update(zip(rest, pool.map(lambda i: fit(points[i]), rest)))
    return [found[i] for i in range(len(points))]


SCORE_SCHEMA = ("stage string, trees int, depth int, rate double, min_rows int, "
                "trees_used int, score double")


def fit_two_stage(
    df: DataFrame, features: Sequence[str], trees: int = 400, depth: int = 4, rate: float = 0.05,
    min_rows: int = 3,
) -> TwoStage:
    grid = {"trees": (trees,), "depth": (depth,), "rate": (rate,), "min_rows": (min_rows,)}
    return tune_two_stage(df, features, grid)[0]


def f1_score(scored: DataFrame) -> float:
    t, p = F.col("rain_occurrence") == 1, F.col("rain_flag") == 1
    c = scored.agg(F.count_if(t & p).alias("tp"), F.count_if(t | p).alias("any"),
                   F.count_if(t & p).alias("both")).head()
    return 2 * c.tp / (c["any"] + c.both) if c["any"] else 0.0


def log_rmse(scored: DataFrame) -> float:
    return math.sqrt(scored.agg(F.avg(F.pow(F.col("log_amount") - F.col("log_rainfall"), 2))).head()[0])


# --- linear seasonal model

def seasonal_inputs(
    df: DataFrame, exogenous: Sequence[str] = EXOGENOUS, max_lag: int = 2,
    seasonal_lag: int = SEASONAL_LAG, spec: SeriesSpec = DEFAULT,
) -> tuple[DataFrame, list[str]]:
    """log1p target, its lags and the exogenous columns, all of which must exist; the lags
    come from the whole series, so a split starts with its true history."""
    w = spec.ordered()
    present = list(exogenous)
    if absent := [c for c in present if c not in df.columns]:
        raise ValueError(f"exogenous columns are absent: {absent}")
    y = F.log1p(F.col(spec.target).cast("double"))
    lags = {f"ar{k}": F.lag(y, k).over(w) for k in range(1, max_lag + 1)}
    lags["seasonal"] = F.lag(y, seasonal_lag).over(w)
    out = df.withColumns({"log_y": y, **lags}).select(
        *spec.key, "split", spec.target, "log_y", *lags, *present)
    return out.dropna(), present


def fit_seasonal_linear(
    df: DataFrame, exogenous: Sequence[str] = EXOGENOUS, orders: Sequence[int] = (0, 1, 2),
    spec: SeriesSpec = DEFAULT,
) -> tuple[DataFrame, list[tuple[int, float]]]:
    """AR order by AIC on the train rows, one normal-equation fit per order.

    Returns one-step-ahead predictions for all rows (actual, predicted,
    log_residual) and the AIC of each order.
    """
    inputs, present = seasonal_inputs(df, exogenous, max(orders), spec=spec)
    rows = fitted_rows(inputs, "seasonal-input")
    best, table = None, []
    for p in orders:
        names = [*(f"ar{k}" for k in range(1, p + 1)), "seasonal", *present]
        train = assemble(rows.where(F.col("split") == "train"), names).select("x", "log_y")
        model = LinearRegression(labelCol="log_y", featuresCol="x", solver="normal").fit(train)
        summary = model.summary
        n = summary.numInstances
        aic = n * math.log(max(summary.meanSquaredError, 1e-300)) + 2 * (len(names) + 1)
        table.append((p, aic))
        if best is None or aic < best[0]:
            best = (aic, model, names)
    _, model, names = best
    scored = model.transform(assemble(rows, names))
    mm = at_least_zero(F.expm1("prediction"))
    return scored.select(
        *spec.key, "split", F.col(spec.target).alias("actual"), mm.alias("predicted"),
        (F.col("log_y") - F.col("prediction")).alias("log_residual")), table


def hybrid_forecast(
    base: DataFrame, inputs: DataFrame, features: Sequence[str], trees: int = 100, depth: int = 4,
    rate: float = 0.05, spec: SeriesSpec = DEFAULT,
) -> DataFrame:
    """A second model learns the log residual of a base forecast and corrects it.

    Rows without features keep the base forecast; both parts stay in the output.
    """
    residual = base.withColumn("residual", log_residual(F.col("actual"), F.col("predicted")))
    joined = residual.select(*spec.key, "split", "actual", "predicted", "residual").join(
        inputs.select(*spec.key, *features), spec.key, "left")
    rows = fitted_rows(joined, "hybrid-input")
    learner = GBTRegressor(
        labelCol="residual", featuresCol="x", predictionCol="residual_hat", maxIter=trees,
        maxDepth=depth, stepSize=rate, seed=SEED)
    model = learner.fit(assemble(rows.where(F.col("split") == "train"), features).select("x", "residual"))
    complete = rows.where(F.col("split") != "train")
    keep = VectorAssembler(inputCols=list(features), outputCol="x", handleInvalid="keep").transform(complete)
    usable = F.lit(True)
    for c in features:
        usable = usable & F.col(c).isNotNull()
    scored = model.transform(keep).withColumn(
        "residual_hat", F.when(usable, F.col("residual_hat")).otherwise(0.0))
    return scored.select(
        F.lit("hybrid").alias("model"), "split", *spec.key, "actual",
        hybrid_column(F.col("predicted"), F.col("residual_hat")).alias("predicted"),
        at_least_zero(F.col("predicted")).alias("base_predicted"),
        F.col("residual_hat").alias("residual"))


def bootstrap_ensemble(
    inputs: DataFrame, features: Sequence[str], members: int = 20, trees: int = 20, depth: int = 4,
    split: str = "test", spec: SeriesSpec = DEFAULT,
) -> DataFrame:
    """Members from refits on hash-seeded Poisson resamples of the train rows.

    The forecasts of all refits are columns of one scan, folded into an array.
    """
    rows = fitted_rows(
        assemble(inputs, features).select(*spec.key, "split", spec.target, "log_rainfall", "x"),
        "bootstrap-input")
    train = rows.where(F.col("split") == "train")
    scored = rows.where(F.col("split") == split)
    for k in range(members):
        u = (F.shiftrightunsigned(F.xxhash64(*spec.key, F.lit(SEED + k)), 11) + 0.5) / float(2**53)
        draws = train.withColumn("draws", _poisson(u)).where(F.col("draws") > 0)
        model = GBTRegressor(
            labelCol="log_rainfall", featuresCol="x", weightCol="draws", predictionCol=f"_m{k}",
            maxIter=trees, maxDepth=depth, seed=SEED + k).fit(draws.select("x", "log_rainfall", "draws"))
        scored = model.transform(scored)
    return scored.select(
        *spec.key, F.col(spec.target).alias("actual"),
        F.array(*[F.greatest(F.lit(0.0), F.col(f"_m{k}")) for k in range(members)]).alias("members"))


def _poisson(u):
    """Poisson(1) count of a uniform number by its cumulative distribution, as far as a
    double can tell the tail from nothing."""
    total, count, k = 0.0, F.lit(0.0), 0
    while total < 1.0 and (share := math.exp(-1) / math.factorial(k)) > 2.0**-54:
        total += share
        count = count + (u > total).cast("double")
        k += 1
    return count


def store_predictions(
    spark: SparkSession, model: TwoStage, inputs: DataFrame, model_path: str, store_path: str,
    name: str = "two_stage",
) -> DataFrame:
    """Persist a model, reload it, predict val and test and write the store."""
    from pluvia.sources.tables import load_predictions, write_predictions

    model.save(model_path)
    again = TwoStage.load(model_path, model.features)
    scored = again.predict(inputs.where(F.col("split") != "train"))
    write_predictions(scored.select(F.lit(name).alias("model"), "split", *DEFAULT.key, "actual", "predicted"),
                      store_path)
    return load_predictions(spark, store_path, [name])
