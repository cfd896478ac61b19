"""Attributions, partial dependence and individual curves."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pluvia.functions.quantiles import exact_quantiles, quantile_columns
from pluvia.operators.correlation import comoments
from pluvia.session import materialise
from pluvia.spec import DEFAULT, EXTREME_EVENT, SeriesSpec

# Grid points, curves, shown features; about so many background rows a bucket.
GRID_POINTS, GRID_POINTS_2D, ICE_ROWS, TOP_FEATURES, LOCAL_FEATURES = 50, 30, 100, 20, 12
BUCKET_ROWS = 16
SEED = 42
# A feature of which the ones before it leave less than this share is not fitted.
TOLERANCE = 0.01

# Adds a "prediction" column to rows that carry the feature array "x".
Predictor = Callable[[DataFrame], DataFrame]


def feature_array(features: Sequence[str]) -> Column:
    return F.array(*[F.col(c).cast("double") for c in features])


def model_predictor(model) -> Predictor:
    """An MLlib regressor as a predictor over the array column."""
    vector, out = model.getFeaturesCol(), model.getPredictionCol()

    def predict(df: DataFrame) -> DataFrame:
        named = df.withColumnRenamed("x", "_array").withColumn(vector, array_to_vector("_array"))
        scored = model.transform(named).drop(vector).withColumnRenamed("_array", "x")
        return scored.withColumnRenamed(out, "prediction")

    return predict


def linear_predictor(intercept: Column, coefficients: Column) -> Predictor:
    """intercept + coefficients . x, all in the row."""
    def predict(df: DataFrame) -> DataFrame:
        held = df.withColumns({"_b0": intercept, "_beta": coefficients})
        dot = F.aggregate(
            F.zip_with("x", "_beta", lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
        return held.withColumn("prediction", F.col("_b0") + dot).drop("_b0", "_beta")

    return predict


@dataclass(frozen=True)
class LinearFit:
    """Least squares of a target on all features at once: means, coefficients, base value.

    The base is the prediction at the means, which is the mean target of the fitted rows.
    """

    features: tuple[str, ...]
    means: tuple[float, ...]
    betas: tuple[float, ...]
    base: float

    def parameters(self) -> Column:
        """Map feature -> struct(beta, mean), a constant."""
        return F.map_from_entries(F.array(*[
            F.struct(F.lit(f), F.struct(F.lit(b).alias("beta"), F.lit(m).alias("mean")))
            for f, b, m in zip(self.features, self.betas, self.means, strict=True)]))

    def predictor(self) -> Predictor:
        offset = self.base - sum(b * m for b, m in zip(self.betas, self.means, strict=True))
        return linear_predictor(F.lit(offset), F.array(*[F.lit(b) for b in self.betas]))


def fit_linear(df: DataFrame, features: Sequence[str], target: str, tolerance: float = TOLERANCE) -> LinearFit:
    """Normal equations from one comoment table, solved once.

    Spark sums the moments of complete rows; the solve sees p (p + 3) / 2 numbers, fixed by
    the columns. Features are taken up in order; one that those before it explain but for
    ``tolerance`` of its variance (also a constant one) gets the coefficient 0.
    """
    names = [*features, target]
    at = {c: i for i, c in enumerate(names)}
    moments, means, p = np.zeros((len(names),) * 2), np.zeros(len(names)), len(features)
    for r in comoments(df.select(*names).dropna(), names).collect():
        i, j = at[r["a"]], at[r["b"]]
        moments[i, j] = moments[j, i] = r["cab"]
        means[i], means[j] = r["mean_a"], r["mean_b"]
    scale = np.sqrt(np.maximum(np.diag(moments), 0.0))
    scale[scale == 0] = 1.0
    left = moments / scale[:, None] / scale[None, :]
    used = []
    for k in range(p):
        if left[k, k] < tolerance:
            continue
        used.append(k)
        row = left[k] / left[k, k]
        left -= left[:, k:k + 1] * row
        left[k] = row
    betas = np.zeros(p)
    betas[used] = left[used, p] * scale[p] / scale[used]
    return LinearFit(tuple(features), tuple(means[:p].tolist()), tuple(betas.tolist()), float(means[p]))


def shapley_values(
    rows: DataFrame, background: DataFrame, model, features: Sequence[str], permutations: int = 8,
    spec: SeriesSpec = DEFAULT, max_error: float | None = None, max_permutations: int = 256,
) -> DataFrame:
    """Permutation-sampled Shapley values of every row, with their error:
    (key, feature, value, phi, error, base, prediction).

    Permutations come in antithetic pairs: a row walks from a background row to itself, one
    feature at a time in a hash-drawn order, and once more in the reverse order, so that a
    feature met early in one walk is met late in the other. ``error`` is the standard error
    of phi from the spread of the pairs (null for one pair). With ``max_error`` the number
    of pairs doubles until the root mean square error of every feature is at most that, or
    ``max_permutations`` are drawn; earlier pairs are kept as written sums. The phis add up
    to prediction - base exactly.
    """
    pairs, drawn = -(-permutations // 2), 0
    total = None
    while True:
        sums = _pair_sums(rows, background, model, features, drawn, pairs, spec)
        total = sums if total is None else _summed(sums.unionByName(total), spec)
        drawn += pairs
        result = _with_errors(total, features, spec)
        if max_error is None:
            return result
        total = materialise(total, "shapley-sums")
        result = _with_errors(total, features, spec)
        worst = result.groupBy("feature").agg(F.sqrt(F.avg(F.col("error") * F.col("error"))).alias("e")).agg(F.max("e")).head()[0]
        if (worst is not None and worst <= max_error) or 2 * drawn >= max_permutations:
            return result
        pairs = min(drawn, -(-max_permutations // 2) - drawn)


SUMS = ("pairs", "delta", "square", "f0", "n0", "f1", "n1")


def _summed(sums: DataFrame, spec: SeriesSpec) -> DataFrame:
    return sums.groupBy(*spec.key, "i").agg(F.first("value").alias("value"), *[F.sum(c).alias(c) for c in SUMS])


# A tree as (feature, threshold, at most, above), a leaf as its value.
Tree = tuple | float


def boosted_trees(model) -> list[tuple[float, Tree]] | None:
    """(weight, tree) of a boosted regressor that splits at thresholds only; None for other models."""
    if not isinstance(model, GBTRegressionModel) or " in {" in model.toDebugString:
        return None
    lines = iter(line.strip() for line in model.toDebugString.splitlines()[1:])

    def node() -> Tree:
        line = next(lines)
        if leaf := re.fullmatch(r"Predict: (.*)", line):
            return float(leaf[1])
        feature, cut = re.fullmatch(r"If \(feature (\d+) <= (.*)\)", line).groups()
        low = node()
        next(lines)  # Else
        return int(feature), float(cut), low, node()

    return [(float(re.fullmatch(r"Tree \d+ \(weight (.*)\):", line)[1]), node()) for line in lines if line]


def tree_sum(trees: Sequence[tuple[float, Tree]], x: np.ndarray) -> np.ndarray:
    """The weighted sum of the trees for the columns of ``x`` (features, rows)."""
    def value(tree: Tree):
        if isinstance(tree, float):
            return tree
        feature, cut, low, high = tree
        return np.where(x[feature] <= cut, value(low), value(high))

    out = np.zeros(x.shape[1])
    for weight, tree in trees:
        out += weight * value(tree)
    return out


def _walked(trees: Sequence[tuple[float, Tree]], keys: Sequence[str], p: int):
    """Walks (keys, m, target_x, z, hashes) to their differences and ends, both orders of a pair at once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, z, h = (batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(-1, p) for c in ("target_x", "z", "hashes"))
            x, z = np.ascontiguousarray(x.T), np.ascontiguousarray(z.T)
            place = np.argsort(np.argsort(h, axis=1, kind="stable"), axis=1).T  # of each feature in the walk
            delta = np.zeros((p, batch.num_rows))
            ends = np.zeros((2, batch.num_rows))
            for at in (place, p - 1 - place):
                before = tree_sum(trees, z)
                ends[0] += before
                for step in range(p):
                    after = tree_sum(trees, np.where(at <= step, x, z))
                    delta += np.where(at == step, after - before, 0.0)
                    before = after
                ends[1] += before
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in (*keys, "m")), *(pa.array(c) for c in (*delta, *ends, *x))],
                [*keys, "m", *(f"d{i}" for i in range(p)), "f0", "f1", *(f"v{i}" for i in range(p))])

    return run


def _walks(
    rows: DataFrame, background: DataFrame, features: Sequence[str], first: int, pairs: int, spec: SeriesSpec,
) -> DataFrame:
    """(key, m, target_x, z, hashes): row, drawn background row and the hashes that order a walk's features.

    The background row is drawn from all of them: a hash picks one of many small buckets,
    and a row in it.
    """
    buckets = max(1, background.count() // BUCKET_ROWS)
    placed = background.select(
        F.pmod(F.xxhash64(*spec.key, F.lit(SEED)), F.lit(buckets)).alias("_bucket"), feature_array(features).alias("_x"))
    pools = placed.groupBy("_bucket").agg(F.array_sort(F.collect_list("_x")).alias("_pool"))
    least = placed.agg(F.min("_bucket")).scalar()
    spare = pools.where(F.col("_bucket") == least).select("_pool").scalar()  # for the rare draw of an empty bucket
    base = rows.select(*spec.key, feature_array(features).alias("target_x"))
    walks = base.withColumn("m", F.explode(F.sequence(F.lit(first), F.lit(first + pairs - 1))))
    walks = walks.withColumn("_bucket", F.pmod(F.xxhash64(*spec.key, "m", F.lit("z")), F.lit(buckets)))
    walks = walks.join(pools, "_bucket", "left").withColumn("_pool", F.coalesce("_pool", spare))
    draw = F.pmod(F.xxhash64("m", *spec.key, F.lit("row")), F.size("_pool").cast("bigint")).cast("int")
    hashes = F.array(*[F.xxhash64(*spec.key, F.col("m"), F.lit(i)) for i in range(len(features))])
    return walks.select(*spec.key, "m", "target_x", F.get("_pool", draw).alias("z"), hashes.alias("hashes"))


def _pair_sums(
    rows: DataFrame, background: DataFrame, model, features: Sequence[str], first: int, pairs: int, spec: SeriesSpec,
) -> DataFrame:
    """Per row and feature: number, sum and sum of squares of the pairs' differences.

    Boosted trees score all steps of a walk in its row, so that only the sums are exchanged;
    other models score a row a step by one distributed transform.
    """
    walks = _walks(rows, background, features, first, pairs, spec)
    if (trees := boosted_trees(model)) is None:
        return _step_sums(walks, model, len(features), spec)
    p = len(features)
    numbers = [*(f"d{i}" for i in range(p)), "f0", "f1", *(f"v{i}" for i in range(p))]
    schema = walks.select(*spec.key, "m").schema
    for c in numbers:
        schema = schema.add(c, "double")
    scored = walks.mapInArrow(_walked(trees, spec.key, p), schema).repartition(*spec.key)
    each = scored.groupBy(*spec.key, "m").agg(
        *[(F.sum(f"d{i}") / 2).alias(f"d{i}") for i in range(p)], *[F.first(f"v{i}").alias(f"v{i}") for i in range(p)],
        F.sum("f0").alias("f0"), F.sum("f1").alias("f1"), (2 * F.count(F.lit(1))).alias("n"))
    total = each.groupBy(*spec.key).agg(
        F.count(F.lit(1)).alias("pairs"), *[F.sum(f"d{i}").alias(f"d{i}") for i in range(p)],
        *[F.sum(F.col(f"d{i}") * F.col(f"d{i}")).alias(f"s{i}") for i in range(p)],
        *[F.first(f"v{i}").alias(f"v{i}") for i in range(p)], F.sum("f0").alias("f0"), F.sum("f1").alias("f1"), F.sum("n").alias("n"))
    long = F.array(*[
        F.struct(F.lit(i).alias("i"), F.col(f"v{i}").alias("value"), F.col(f"d{i}").alias("delta"), F.col(f"s{i}").alias("square"))
        for i in range(p)])
    ends = [F.col("f0"), F.col("n").alias("n0"), F.col("f1"), F.col("n").alias("n1")]
    return total.select(*spec.key, "pairs", *ends, F.inline(long)).select(*spec.key, "i", "value", *SUMS)


def _step_sums(walks: DataFrame, model, p: int, spec: SeriesSpec) -> DataFrame:
    """``_pair_sums`` with a row a step. A step's prediction counts for the feature before it
    and against the one after it, so no row needs its neighbour. Walks are dealt by row, so a
    row's steps meet without another exchange.
    """
    order = F.transform(F.array_sort(F.arrays_zip("hashes", F.sequence(F.lit(0), F.lit(p - 1)).alias("i"))), lambda e: e["i"])
    walks = walks.withColumn("order", order).drop("hashes").repartition(*spec.key)
    walks = walks.withColumn("order", F.explode(F.array("order", F.reverse("order"))))
    steps = walks.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(p))))
    mixed = F.transform("target_x", lambda v, i: F.when(
        F.array_position("order", i) <= F.col("step"), v).otherwise(F.get("z", i)))
    scored = model_predictor(model)(steps.withColumn("x", mixed))
    f, step = F.col("prediction"), F.col("step")
    signed = F.filter(F.array(
        F.struct(F.get("order", step - 1).alias("i"), f.alias("d")),
        F.struct(F.get("order", step).alias("i"), (-f).alias("d"))), lambda e: e["i"].isNotNull())
    parts = scored.select(
        *spec.key, "m", "target_x", F.when(step == 0, f).alias("f0"), F.when(step == p, f).alias("f1"), F.inline(signed))
    each = parts.withColumn("value", F.get("target_x", F.col("i"))).groupBy(*spec.key, "i", "m").agg(
        (F.sum("d") / 2).alias("delta"), F.first("value").alias("value"),
        F.sum("f0").alias("f0"), F.count("f0").alias("n0"), F.sum("f1").alias("f1"), F.count("f1").alias("n1"))
    whole = Window.partitionBy(*spec.key, "m")  # a row a feature
    return _summed(each.select(
        *spec.key, "i", "value", F.lit(1).alias("pairs"), "delta", (F.col("delta") * F.col("delta")).alias("square"),
        *[F.sum(c).over(whole).alias(c) for c in ("f0", "n0", "f1", "n1")]), spec)


def _with_errors(total: DataFrame, features: Sequence[str], spec: SeriesSpec) -> DataFrame:
    names, n = F.array(*[F.lit(c) for c in features]), F.col("pairs")
    phi = F.col("delta") / n
    spread = F.greatest(F.col("square") - n * phi * phi, F.lit(0.0))
    return total.select(
        *spec.key, F.get(names, F.col("i")).alias("feature"), "value", phi.alias("phi"),
        F.when(n > 1, F.sqrt(spread / F.greatest(n - 1, F.lit(1)) / n)).alias("error"),
        (F.col("f0") / F.col("n0")).alias("base"), (F.col("f1") / F.col("n1")).alias("prediction"))


def linear_attributions(
    df: DataFrame, features: Sequence[str], parameters: Column, spec: SeriesSpec = DEFAULT
) -> DataFrame:
    """Exact attributions beta (x - mean) of a linear model, one row per feature.

    ``parameters`` is a map feature -> struct(beta, mean).
    """
    df = df.withColumn("_p", parameters)
    rows = F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"),
                 (F.col("_p")[c]["beta"] * (F.col(c) - F.col("_p")[c]["mean"])).alias("phi"))
        for c in features])
    return df.select(*spec.key, F.col(spec.target).alias("actual"), F.inline(rows))


def global_summary(phi: DataFrame) -> DataFrame:
    """Mean absolute and signed attribution per feature, fraction and rank."""
    table = phi.groupBy("feature").agg(F.avg(F.abs("phi")).alias("mean_abs"), F.avg("phi").alias("mean_signed"))
    every = Window.partitionBy(F.lit(1))  # one row per feature
    total = F.sum("mean_abs").over(every)
    return table.select(
        "feature", "mean_abs", "mean_signed",
        F.when(total > 0, F.col("mean_abs") / total).otherwise(0.0).alias("fraction"),
        F.row_number().over(every.orderBy(F.col("mean_abs").desc(), "feature")).alias("rank"))


def normalised_values(phi: DataFrame, top: int = TOP_FEATURES) -> DataFrame:
    """Rows of the top features with their min-max-normalised value.

    Ranks and limits are one row per feature and travel as a scalar map, so the
    attribution rows are neither shuffled nor windowed.
    """
    ranks = global_summary(phi).where(F.col("rank") <= top).select("feature", "rank")
    limits = phi.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    lookup = ranks.join(limits, "feature").agg(F.map_from_entries(
        F.collect_list(F.struct("feature", F.struct("rank", "lo", "hi"))))).scalar()
    marked = phi.withColumn("_l", lookup).withColumn("_l", F.try_element_at("_l", F.col("feature")))
    lo, hi = F.col("_l.lo"), F.col("_l.hi")
    return marked.where(F.col("_l").isNotNull()).withColumns({
        "rank": F.col("_l.rank"), "normalised": (F.col("value") - lo) / (hi - lo + F.lit(1e-10))}).drop("_l")


def dependence(
    phi: DataFrame, features: Sequence[str], colour: str, spec: SeriesSpec = DEFAULT
) -> DataFrame:
    """Value and attribution of the listed features with the row's colour value."""
    row = Window.partitionBy(*spec.key)  # one row per feature
    tint = F.max(F.when(F.col("feature") == colour, F.col("value"))).over(row)
    return phi.withColumn("colour", tint).where(F.col("feature").isin(*features)).select(
        *spec.key, "feature", "value", "phi", "colour")


def local_cases(
    phi: DataFrame, base: float | Column, n_show: int = LOCAL_FEATURES,
    threshold: float = EXTREME_EVENT, spec: SeriesSpec = DEFAULT,
) -> DataFrame:
    """Two explained days: a hash-picked 5..15 day and the largest extreme day.

    ``phi`` carries ``actual``. Each case lists its strongest attributions, the
    log prediction base + sum and its value on the measured scale.
    """
    base = F.lit(base) if isinstance(base, (int, float)) else base
    normal = phi.where(F.col("actual").between(5, 15)).agg(
        F.min(F.struct(F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in spec.key])), *spec.key)).alias("k"))
    extreme = phi.where(F.col("actual") >= threshold).agg(
        F.min(F.struct((-F.col("actual")).alias("neg"), *spec.key)).alias("k"))
    cases = None
    for label, pick in (("normal", normal), ("extreme", extreme)):
        chosen = pick.where(F.col("k").isNotNull()).select(
            F.lit(label).alias("case"), *[F.col(f"k.{c}").alias(c) for c in spec.key])
        cases = chosen if cases is None else cases.unionByName(chosen)
    rows = phi.join(F.broadcast(cases), spec.key)  # two rows
    case = Window.partitionBy("case")
    strength = case.orderBy(F.abs("phi").desc(), "feature")
    log_pred = base + F.sum("phi").over(case)
    return rows.select(
        "case", *spec.key, "actual", "feature", "value", "phi",
        F.row_number().over(strength).alias("rank"), log_pred.alias("log_prediction"),
        F.expm1(log_pred).alias("prediction")).where(F.col("rank") <= n_show)


def grid_limits(rows: DataFrame, features: Sequence[str]) -> Column:
    """Map feature -> (1 %, 99 %) exact quantiles over all rows, as a scalar."""
    pairs = F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in features])
    q = exact_quantiles(rows.select(F.inline(pairs)), "v", [0.01, 0.99], ["feature"], len(features))
    limits = q.groupBy("feature").agg(F.min("q").alias("lo"), F.max("q").alias("hi"))
    return limits.agg(
        F.map_from_entries(F.collect_list(F.struct("feature", F.struct("lo", "hi"))))).scalar()


# --- cells between the thresholds of trees

Cuts = Mapping[str, Sequence[float]]


def split_cuts(model, features: Sequence[str]) -> dict[str, list[float]]:
    """The thresholds at which a tree model over numeric features splits each of them.

    Values of a feature between two thresholds (the upper one included) are one cell: rows
    that agree in all cells take the same way through every tree. A tree model has fewer
    thresholds a feature than its ``maxBins``.
    """
    found: dict[str, set[float]] = {c: set() for c in features}
    for index, cut in re.findall(r"If \(feature (\d+) <= ([^)]+)\)", model.toDebugString):
        found[features[int(index)]].add(float(cut))
    return {c: sorted(v) for c, v in found.items()}


def _cut_array(cuts: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in cuts]).cast("array<double>")


def cell_of(value: Column, cuts: Sequence[float]) -> Column:
    """Number of thresholds below the value."""
    return F.size(F.filter(_cut_array(cuts), lambda t: value > t))


def _stand_in(cell: Column, cuts: Sequence[float]) -> Column:
    """A value of the cell: its upper threshold, or one more than the last."""
    return F.coalesce(F.get(_cut_array(cuts), cell), F.lit(float(cuts[-1] + 1) if cuts else 0.0))


def _cells(features: Sequence[str], cuts: Cuts) -> Column:
    return F.array(*[cell_of(F.col(c).cast("double"), cuts[c]) for c in features])


def _scored_cells(predict: Predictor, df: DataFrame, features: Sequence[str], cuts: Cuts) -> DataFrame:
    """``df``, whose ``cells`` has one number a feature, with the prediction there."""
    values = F.array(*[_stand_in(F.get("cells", F.lit(i)), cuts[c]) for i, c in enumerate(features)])
    return predict(df.withColumn("x", values))


def _grid(rows: DataFrame, limits: Column, swept: Sequence[str], cuts: Cuts, points: int) -> DataFrame:
    """(feature, grid_idx, grid_value, cell): ``points`` rows a swept feature."""
    lines = None
    for c in swept:
        at = limits[c]["lo"] + (limits[c]["hi"] - limits[c]["lo"]) * F.col("grid_idx") / (points - 1)
        line = rows.sparkSession.range(points).select(F.lit(c).alias("feature"), F.col("id").cast("int").alias("grid_idx")).withColumn(
            "grid_value", at).withColumn("cell", cell_of(F.col("grid_value"), cuts[c]))
        lines = line if lines is None else lines.unionByName(line)
    return materialise(lines, "grid")


def _masked(cells: Column, places: Column) -> Column:
    """``cells`` without what stands at ``places``, which the sweep replaces."""
    return F.transform(cells, lambda v, i: F.when(F.array_contains(places, i), F.lit(-1)).otherwise(v))


def _replaced(places: Column, values: Column) -> Column:
    return F.transform("cells", lambda v, i: F.coalesce(
        F.get(values, (F.array_position(places, i) - 1).cast("int")), v))


def _counted(rows: DataFrame, features: Sequence[str], cuts: Cuts) -> DataFrame:
    return materialise(rows.groupBy(_cells(features, cuts).alias("cells")).agg(F.count("*").alias("n")), "cells")


def cell_dependence(
    rows: DataFrame, features: Sequence[str], swept: Sequence[str], predict: Predictor, cuts: Cuts, points: int = GRID_POINTS,
) -> DataFrame:
    """``partial_dependence`` of a tree model with the thresholds ``cuts``: rows are counted
    by cell, and every different cell is scored once for each cell that the grid reaches."""
    grid = _grid(rows, grid_limits(rows, swept), swept, cuts, points)
    order = {c: i for i, c in enumerate(features)}
    sweep = F.array(*[F.struct(F.lit(c).alias("feature"), F.array(F.lit(order[c])).alias("places")) for c in swept])
    rest = _counted(rows, features, cuts).select("cells", "n", F.inline(sweep)).groupBy(
        "feature", "places", _masked(F.col("cells"), F.col("places")).alias("cells")).agg(F.sum("n").alias("n"))
    reached = grid.select("feature", "cell").distinct()
    steps = rest.join(reached, "feature").withColumn("cells", _replaced(F.col("places"), F.array("cell")))
    mean = _scored_cells(predict, steps, features, cuts).groupBy("feature", "cell").agg(
        (F.sum(F.col("n") * F.col("prediction")) / F.sum("n")).alias("pdp"))
    return grid.join(mean, ["feature", "cell"]).select("feature", "grid_idx", "grid_value", "pdp")


def cell_dependence_2d(
    rows: DataFrame, features: Sequence[str], first: str, second: str, predict: Predictor, cuts: Cuts,
    points: int = GRID_POINTS_2D,
) -> DataFrame:
    """``partial_dependence_2d`` in the same way: pairs of reached cells, not of grid points."""
    grid = _grid(rows, grid_limits(rows, [first, second]), [first, second], cuts, points)
    order = {c: i for i, c in enumerate(features)}
    places = F.array(F.lit(order[first]), F.lit(order[second]))
    rest = _counted(rows, features, cuts).groupBy(_masked(F.col("cells"), places).alias("cells")).agg(F.sum("n").alias("n"))
    axis = lambda c, name: grid.where(F.col("feature") == c).select(F.col("grid_idx").alias(name), F.col("grid_value").alias(f"value_{name}"), F.col("cell").alias(f"cell_{name}"))
    reached = lambda c: F.array_sort(F.array_distinct(F.collect_list(F.when(F.col("feature") == c, F.col("cell")))))
    cells = grid.agg(reached(first).alias("a"), reached(second).alias("b"))
    steps = rest.withColumn("cell_i", F.explode(cells.select("a").scalar())).withColumn("cell_j", F.explode(cells.select("b").scalar()))
    steps = steps.withColumn("cells", _replaced(places, F.array("cell_i", "cell_j")))
    mean = _scored_cells(predict, steps, features, cuts).groupBy("cell_i", "cell_j").agg(
        (F.sum(F.col("n") * F.col("prediction")) / F.sum("n")).alias("pdp"))
    return mean.join(axis(first, "i"), "cell_i").join(axis(second, "j"), "cell_j").select("i", "j", "value_i", "value_j", "pdp")


def cell_curves(
    rows: DataFrame, features: Sequence[str], swept: Sequence[str], predict: Predictor, cuts: Cuts, grid: DataFrame, *keep: str,
) -> DataFrame:
    """(keep, feature, cell, prediction): every row in each cell that ``grid`` reaches."""
    order = {c: i for i, c in enumerate(features)}
    sweep = F.array(*[F.struct(F.lit(c).alias("feature"), F.array(F.lit(order[c])).alias("places")) for c in swept])
    steps = rows.select(*keep, _cells(features, cuts).alias("cells"), F.inline(sweep)).join(
        grid.select("feature", "cell").distinct(), "feature").withColumn("cells", _replaced(F.col("places"), F.array("cell")))
    return _scored_cells(predict, steps, features, cuts).select(*keep, "feature", "cell", "prediction")


def cell_band(
    rows: DataFrame, features: Sequence[str], swept: Sequence[str], predict: Predictor, cuts: Cuts, points: int = GRID_POINTS,
) -> DataFrame:
    """``curve_band`` of the curves of all rows: the quantiles of a cell hold for all its grid points."""
    grid = _grid(rows, grid_limits(rows, swept), swept, cuts, points)
    curves = cell_curves(rows, features, swept, predict, cuts, grid)
    point = ["feature", "cell"]
    held = materialise(curves, "curves")
    q = exact_quantiles(held, "prediction", [0.05, 0.95], point, points * TOP_FEATURES)
    counts = held.groupBy(*point).agg(F.count("*").alias("n"))
    return grid.join(counts, point).join(quantile_columns(q, point, {0.05: "low", 0.95: "high"}), point).select(
        "feature", "grid_idx", "grid_value", "n", "low", "high")


def _swept(
    rows: DataFrame, features: Sequence[str], swept: Sequence[str], limits: Column, points: int, *keep: str
) -> DataFrame:
    """Every row at every grid point of every swept feature; a row-local expansion."""
    order = {c: i for i, c in enumerate(features)}
    sweep = F.array(*[
        F.struct(F.lit(c).alias("feature"), F.lit(order[c]).alias("at")) for c in swept])
    out = rows.select(*keep, feature_array(features).alias("_row"), limits.alias("_l"))
    out = out.select(*keep, "_row", "_l", F.inline(sweep)).select(
        *keep, "_row", "feature", "at", F.col("_l")[F.col("feature")].alias("_l"),
        F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("grid_idx"))
    value = F.col("_l.lo") + (F.col("_l.hi") - F.col("_l.lo")) * F.col("grid_idx") / (points - 1)
    out = out.withColumn("grid_value", value)
    return out.withColumn("x", F.transform("_row", lambda v, i: F.when(
        i == F.col("at"), F.col("grid_value")).otherwise(v))).drop("_row", "_l", "at")


def partial_dependence(
    rows: DataFrame, features: Sequence[str], swept: Sequence[str], predict: Predictor,
    points: int = GRID_POINTS,
) -> DataFrame:
    """Mean prediction over all rows with one feature set to each grid value."""
    grid = _swept(rows, features, swept, grid_limits(rows, swept), points)
    return predict(grid).groupBy("feature", "grid_idx").agg(
        F.max("grid_value").alias("grid_value"), F.avg("prediction").alias("pdp"))


def linear_dependence(
    rows: DataFrame, fit: LinearFit, swept: Sequence[str], points: int = GRID_POINTS,
) -> DataFrame:
    """``partial_dependence`` of a linear model: its mean prediction is that of the mean row,
    so one row is swept instead of all."""
    mean = rows.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in fit.features])
    grid = _swept(mean, fit.features, swept, grid_limits(rows, swept), points)
    return fit.predictor()(grid).select("feature", "grid_idx", "grid_value", F.col("prediction").alias("pdp"))


def individual_curves(
    rows: DataFrame, features: Sequence[str], swept: Sequence[str], predict: Predictor,
    n_rows: int | None = ICE_ROWS, points: int = GRID_POINTS, spec: SeriesSpec = DEFAULT, cuts: Cuts | None = None,
) -> DataFrame:
    """The curves of ``n_rows`` hash-sampled rows, or of all (None), over the grid of all rows.

    With the thresholds of a tree model as ``cuts``, a row is scored once a cell."""
    limits = grid_limits(rows, swept)
    some = rows if n_rows is None else rows.orderBy(F.xxhash64(*spec.key, F.lit(SEED)), *spec.key).limit(n_rows)
    if cuts is not None:
        grid = _grid(rows, limits, swept, cuts, points)
        return cell_curves(some, features, swept, predict, cuts, grid, *spec.key).join(grid, ["feature", "cell"]).select(
            *spec.key, "feature", "grid_idx", "grid_value", "prediction")
    grid = _swept(some, features, swept, limits, points, *spec.key)
    return predict(grid).select(*spec.key, "feature", "grid_idx", "grid_value", "prediction")


def curve_band(curves: DataFrame) -> DataFrame:
    """Exact 5 % and 95 % quantile of the curves at each grid point, whatever their number."""
    point = ["feature", "grid_idx"]
    held = materialise(curves.select(*point, "grid_value", "prediction"), "curves")
    q = exact_quantiles(held, "prediction", [0.05, 0.95], point, GRID_POINTS * TOP_FEATURES)
    counts = held.groupBy(*point).agg(F.max("grid_value").alias("grid_value"), F.count("*").alias("n"))
    return counts.join(quantile_columns(q, point, {0.05: "low", 0.95: "high"}), point).select(
        *point, "grid_value", "n", "low", "high")


def partial_dependence_2d(
    rows: DataFrame, features: Sequence[str], first: str, second: str, predict: Predictor,
    points: int = GRID_POINTS_2D,
) -> DataFrame:
    """Mean prediction over all rows on a grid of two features."""
    order = {c: i for i, c in enumerate(features)}
    limits = grid_limits(rows, [first, second])
    steps = F.sequence(F.lit(0), F.lit(points - 1))
    grid = rows.select(feature_array(features).alias("_row"), limits.alias("_l")).select(
        "_row", "_l", F.explode(steps).alias("i")).select("_row", "_l", "i", F.explode(steps).alias("j"))
    at = lambda c, k: F.col("_l")[c]["lo"] + (F.col("_l")[c]["hi"] - F.col("_l")[c]["lo"]) * F.col(k) / (points - 1)
    grid = grid.withColumns({"value_i": at(first, "i"), "value_j": at(second, "j")})
    x = F.transform("_row", lambda v, k: F.when(k == order[first], F.col("value_i")).when(
        k == order[second], F.col("value_j")).otherwise(v))
    return predict(grid.withColumn("x", x).drop("_row", "_l")).groupBy("i", "j").agg(
        F.max("value_i").alias("value_i"), F.max("value_j").alias("value_j"), F.avg("prediction").alias("pdp"))
