"""MLlib models, attributions and selection on small synthetic panels."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import functions as F

from pluvia.operators import correlation as co
from pluvia.operators import explain as ex
from pluvia.operators import models as mo
from pluvia.operators import selection as se
from pluvia.plans import queries_models as qm
from pluvia.sources import tables as tb

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(0)
    n = 600
    x = rng.normal(size=(n, 3))
    wet = (x[:, 0] + 0.3 * rng.normal(size=n)) > 0.3
    log = np.where(wet, np.maximum(0.2, 1.5 + x[:, 1]), 0.0)
    pdf = pd.DataFrame(x, columns=FEATURES)
    pdf["series_id"] = np.arange(n) % 3
    pdf["date"] = [dt.date(2001, 1, 1) + dt.timedelta(days=int(i) // 3) for i in range(n)]
    pdf["log_rainfall"], pdf["rainfall"], pdf["rain_occurrence"] = log, np.expm1(log), (log > 0.1).astype(int)
    pdf["split"] = np.where(np.arange(n) < 420, "train", np.where(np.arange(n) < 510, "val", "test"))
    return spark.createDataFrame(pdf).withColumn("date", F.col("date").cast("date")).cache()


def test_two_stage_beats_the_mean_and_survives_storage(spark, rows, tmp_path):
    model = mo.fit_two_stage(rows, FEATURES, trees=10, depth=3, rate=0.2)
    stored = mo.store_predictions(spark, model, rows, str(tmp_path / "model"), str(tmp_path / "store"))
    direct = model.predict(rows.where("split <> 'train'"))
    assert stored.count() == direct.count() == 180
    s = direct.where("split = 'test'").toPandas()
    assert ((s.predicted - s.actual) ** 2).mean() < 0.6 * s.actual.var()
    assert s.p_rain.between(0, 1).all() and (s.predicted >= 0).all()
    again = stored.agg(F.sum("predicted")).head()[0]
    assert again == pytest.approx(direct.agg(F.sum("predicted")).head()[0])
    assert tb.load_predictions(spark, str(tmp_path / "store"), ["absent"]).count() == 0


def test_grid_covers_every_point(rows):
    grid = {"trees": (3,), "depth": (1, 3), "rate": (0.3,), "min_rows": (3,)}
    _, scores = mo.tune_two_stage(rows, FEATURES, grid)
    assert [s[0] for s in scores] == ["classifier"] * 2 + ["regressor"] * 2


def test_shapley_adds_up_and_matches_a_linear_model(rows):
    test = rows.where("split = 'test'")
    background = rows.where("split = 'train'")
    model = LinearRegression(labelCol="log_rainfall", featuresCol="x").fit(
        mo.assemble(background, FEATURES).select("x", "log_rainfall"))
    phi = ex.shapley_values(test, background, model, FEATURES, permutations=64).toPandas()
    sums = phi.groupby(["series_id", "date"]).agg(s=("phi", "sum"), b=("base", "first"), p=("prediction", "first"))
    np.testing.assert_allclose(sums.s, sums.p - sums.b, atol=1e-9)
    assert len(phi) == 90 * 3
    # For a linear model the value is beta (x - background mean), up to sampling.
    beta = dict(zip(FEATURES, model.coefficients))
    mean = background.agg(*[F.avg(c).alias(c) for c in FEATURES]).head().asDict()
    exact = np.array([beta[f] * (v - mean[f]) for f, v in zip(phi.feature, phi.value)])
    assert np.abs(phi.phi - exact).mean() < 0.15
    tree = GBTRegressor(labelCol="log_rainfall", featuresCol="x", maxIter=5, maxDepth=3).fit(
        mo.assemble(background, FEATURES).select("x", "log_rainfall"))
    phi = ex.shapley_values(test, background, tree, FEATURES, permutations=4).toPandas()
    sums = phi.groupby(["series_id", "date"]).agg(s=("phi", "sum"), b=("base", "first"), p=("prediction", "first"))
    np.testing.assert_allclose(sums.s, sums.p - sums.b, atol=1e-9)
    summary = ex.global_summary(ex.shapley_values(test, background, tree, FEATURES, permutations=4)).collect()
    assert sum(r.fraction for r in summary) == pytest.approx(1.0)


def test_grid_fits_the_largest_number_of_trees_once(rows, monkeypatch):
    built = []
    for name in ("_classifier", "_regressor"):
        plain = getattr(mo, name)
        monkeypatch.setattr(mo, name, lambda plain=plain, name=name, **p: built.append((name, *p.values())) or plain(**p))
    grid = {"trees": (2, 90, 60), "depth": (2,), "rate": (0.5,), "min_rows": (3,)}
    _, scores = mo.tune_two_stage(rows, FEATURES, grid)
    by = {(s[0], s[1]): s for s in scores}
    for stage in ("classifier", "regressor"):
        used = by[(stage, 90)][5]
        assert 2 < used < 60  # stopped early, so 60 trees are the same fit; 2 are not
        assert by[(stage, 60)][5:] == by[(stage, 90)][5:] and by[(stage, 2)][5] <= 2
        assert sorted(b[1] for b in built if b[0] == f"_{stage}") == [2, 90]
    alone = mo.tune_two_stage(rows, FEATURES, {**grid, "trees": (60,)})[1]
    assert [s[5:] for s in alone] == [by[("classifier", 60)][5:], by[("regressor", 60)][5:]]


def test_shapley_error_is_stated_and_bounded(rows):
    test = rows.where("split = 'test'").limit(20)
    background = rows.where("split = 'train'")
    model = GBTRegressor(labelCol="log_rainfall", featuresCol="x", maxIter=5, maxDepth=3).fit(
        mo.assemble(background, FEATURES).select("x", "log_rainfall"))
    few = ex.shapley_values(test, background, model, FEATURES, permutations=8).toPandas()
    more = ex.shapley_values(test, background, model, FEATURES, permutations=8, max_error=0.05, max_permutations=512).toPandas()
    rms = lambda t: np.sqrt((t["error"] ** 2).groupby(t["feature"]).mean()).max()
    assert rms(more) <= 0.05 < rms(few)
    for t in (few, more):
        sums = t.groupby(["series_id", "date"]).agg(s=("phi", "sum"), b=("base", "first"), p=("prediction", "first"))
        np.testing.assert_allclose(sums.s, sums.p - sums.b, atol=1e-9)
    exact = ex.shapley_values(test, background, model, FEATURES, permutations=512).toPandas()
    # with 32 pairs the stated error is one of a nearly normal mean; four pairs would say little of the tails
    some = ex.shapley_values(test, background, model, FEATURES, permutations=64).toPandas()
    both = some.merge(exact, on=["series_id", "date", "feature"])
    apart = np.abs(both.phi_x - both.phi_y) / np.maximum(np.hypot(both.error_x, both.error_y), 1e-3)
    assert (apart <= 3).mean() > 0.95 and (apart > 0.1).mean() > 0.5
    one = ex.shapley_values(test, background, model, FEATURES, permutations=2)
    assert one.where("error is not null").count() == 0


def test_boosted_walks_are_scored_in_their_rows(rows, monkeypatch):
    test = rows.where("split = 'test'").limit(30)
    background = rows.where("split = 'train'")
    model = GBTRegressor(labelCol="log_rainfall", featuresCol="x", maxIter=6, maxDepth=3, stepSize=0.2).fit(
        mo.assemble(background, FEATURES).select("x", "log_rainfall"))
    x = background.select(*FEATURES).toPandas().to_numpy(float).T
    scored = model.transform(mo.assemble(background, FEATURES)).select("prediction").toPandas()["prediction"]
    np.testing.assert_allclose(ex.tree_sum(ex.boosted_trees(model), x), scored, rtol=1e-12)
    order = ["series_id", "date", "feature"]
    phi = ex.shapley_values(test, background, model, FEATURES, permutations=6)
    assert "SortAggregate" not in phi._jdf.queryExecution().toString()  # of rows a step, with arrays
    got = phi.toPandas().sort_values(order)
    monkeypatch.setattr(ex, "boosted_trees", lambda model: None)
    want = ex.shapley_values(test, background, model, FEATURES, permutations=6).toPandas().sort_values(order)
    assert (got[order].values == want[order].values).all()
    for c in ("value", "phi", "error", "base", "prediction"):
        np.testing.assert_allclose(got[c], want[c], atol=1e-9)


def test_scaled_inputs_read_written_features(spark, monkeypatch):
    written = []
    plain = qm.mo.fitted_rows
    monkeypatch.setattr(qm.mo, "fitted_rows", lambda df, name: written.append(name) or plain(df, name))
    rows = qm.inputs(spark, "/root/testdata/sf0.001")
    assert written == ["narrow-features", "inputs"]
    means = rows.where("split = 'train'").agg(F.avg("rh"), F.stddev_pop("rh")).head()
    assert means[0] == pytest.approx(0, abs=1e-9) and means[1] == pytest.approx(1)


def test_scaling_looks_up_parameters_once(spark):
    df = spark.createDataFrame([(1.0, 2.0, 7)], "rh double, cloud double, is_weekend int")
    parameters = spark.createDataFrame([("rh", 0.5, 2.0), ("other", 0.0, 1.0)], "feature string, mean double, std double")
    out = qm.ft.standardise(df, parameters, ["rh", "cloud", "is_weekend"])
    assert "[rh]" not in out._jdf.queryExecution().analyzed().toString().split("\n")[1]  # no map a row
    assert [tuple(r) for r in out.collect()] == [(0.25, None, 7)]


def test_linear_fit_equals_least_squares(rows):
    train = rows.where("split = 'train'").withColumns({
        "copy": F.col("a") * 2 + 1, "flat": F.lit(3.0), "blend": F.col("a") - F.col("b"), "gap": F.when(F.col("c") < 2, F.col("c"))})
    names = ["a", "copy", "flat", "b", "blend", "gap"]
    fit = ex.fit_linear(train, names, "log_rainfall")
    pdf = train.select(*names, "log_rainfall").dropna().toPandas()
    own = pdf[["a", "b", "gap"]].to_numpy()
    coef, *_ = np.linalg.lstsq(np.column_stack([np.ones(len(own)), own]), pdf["log_rainfall"], rcond=None)
    np.testing.assert_allclose([fit.betas[i] for i in (0, 3, 5)], coef[1:], rtol=1e-9)
    assert [fit.betas[i] for i in (1, 2, 4)] == [0.0] * 3  # explained by those before, or constant
    assert fit.base == pytest.approx(pdf["log_rainfall"].mean())
    scored = fit.predictor()(train.dropna().withColumn("x", ex.feature_array(names)))
    phi = ex.linear_attributions(scored, names, fit.parameters()).groupBy("series_id", "date").agg(F.sum("phi").alias("s"))
    own, all_rows = (t.toPandas().sort_values(["feature", "grid_idx"])["pdp"].to_numpy() for t in (
        ex.linear_dependence(train.dropna(), fit, ["a", "gap"], 5),
        ex.partial_dependence(train.dropna(), names, ["a", "gap"], fit.predictor(), 5)))
    np.testing.assert_allclose(own, all_rows)
    gaps = scored.join(phi, ["series_id", "date"]).select(F.max(F.abs(F.col("prediction") - F.col("s") - fit.base)))
    assert gaps.head()[0] < 1e-9


def test_dependence_of_a_tree_matches_brute_force(rows):
    test = rows.where("split = 'test'").select("series_id", "date", *FEATURES)
    model = GBTRegressor(labelCol="log_rainfall", featuresCol="x", maxIter=3, maxDepth=2).fit(
        mo.assemble(rows, FEATURES).select("x", "log_rainfall"))
    pdp = ex.partial_dependence(test, FEATURES, ["a"], ex.model_predictor(model), points=5).orderBy("grid_idx").collect()
    limits = np.quantile([r.a for r in test.collect()], [0.01, 0.99])
    for r, g in zip(pdp, np.linspace(*limits, 5)):
        assert r.grid_value == pytest.approx(g)
        moved = mo.assemble(test.withColumn("a", F.lit(float(g))), FEATURES)
        assert r.pdp == pytest.approx(model.transform(moved).agg(F.avg("prediction")).head()[0])
    curves = ex.individual_curves(test, FEATURES, ["a"], ex.model_predictor(model), n_rows=7, points=5)
    assert curves.count() == 35 and ex.curve_band(curves).where("low > high").count() == 0
    grid = ex.partial_dependence_2d(test, FEATURES, "a", "b", ex.model_predictor(model), points=3)
    assert grid.count() == 9


def test_cells_give_the_values_of_all_grid_points(rows):
    test = rows.where("split = 'test'").select("series_id", "date", *FEATURES)
    model = GBTRegressor(labelCol="log_rainfall", featuresCol="x", maxIter=6, maxDepth=3).fit(
        mo.assemble(rows, FEATURES).select("x", "log_rainfall"))
    cuts, predict = ex.split_cuts(model, FEATURES), ex.model_predictor(model)
    assert sum(map(len, cuts.values())) > 5
    key = ["feature", "grid_idx"]
    same = lambda got, want, by: pd.testing.assert_frame_equal(
        got.toPandas().sort_values(by).reset_index(drop=True), want.toPandas()[got.columns].sort_values(by).reset_index(drop=True),
        check_dtype=False, rtol=1e-12)
    same(ex.cell_dependence(test, FEATURES, ["a", "c"], predict, cuts), ex.partial_dependence(test, FEATURES, ["a", "c"], predict), key)
    same(ex.cell_dependence_2d(test, FEATURES, "b", "a", predict, cuts, 12),
         ex.partial_dependence_2d(test, FEATURES, "b", "a", predict, 12), ["i", "j"])
    every = ex.individual_curves(test, FEATURES, FEATURES, predict, None)
    same(ex.individual_curves(test, FEATURES, FEATURES, predict, None, cuts=cuts), every, ["series_id", "date", *key])
    same(ex.cell_band(test, FEATURES, FEATURES, predict, cuts), ex.curve_band(every), key)
    uncut = {c: [] for c in FEATURES}
    flat = GBTRegressor(labelCol="zero", featuresCol="x", maxIter=1, maxDepth=1).fit(
        mo.assemble(rows.withColumn("zero", F.lit(0.5)), FEATURES).select("x", "zero"))
    assert ex.split_cuts(flat, FEATURES) == uncut
    same(ex.cell_dependence(test, FEATURES, ["a"], ex.model_predictor(flat), uncut, 4),
         ex.partial_dependence(test, FEATURES, ["a"], ex.model_predictor(flat), 4), key)


def test_correlation_filter_matches_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(300, 3))
    pdf = pd.DataFrame({"a": base[:, 0], "b": base[:, 0] + 0.1 * base[:, 1], "c": base[:, 0] + 0.05 * base[:, 2],
                        "d": base[:, 1], "log_rainfall": base[:, 0] + 0.1 * base[:, 1]})
    got = se.correlation_filter(spark.createDataFrame(pdf), list("abcd"), limit=0.9)
    corr = pdf.corr().abs()
    pairs = sorted(((corr.loc[x, y], x, y) for i, x in enumerate("abcd") for y in "abcd"[i + 1:] if corr.loc[x, y] > 0.9),
                   key=lambda e: -e[0])
    dropped = set()
    for _, x, y in pairs:
        if dropped & {x, y}:
            continue
        dropped.add(y if corr.loc[x, "log_rainfall"] >= corr.loc[y, "log_rainfall"] else x)
    assert got == sorted(dropped) and got
    assert se.correlation_filter(spark.createDataFrame(pdf), list("abcd"), limit=0.9, protected="abcd") == []


def test_seasonal_linear_prefers_the_true_order(spark, panel):
    rng = np.random.default_rng(3)
    y = np.zeros(900)
    for t in range(2, 900):
        y[t] = max(0.0, 0.5 + 0.3 * y[t - 1] + 0.4 * y[t - 2] + 0.3 * rng.normal())
    from pluvia.operators.calendar import split_by_position
    df = split_by_position(panel({1: np.expm1(y)}))
    scored, table = mo.fit_seasonal_linear(df, exogenous=())
    with pytest.raises(ValueError, match="absent"):
        mo.fit_seasonal_linear(df)
    assert min(table, key=lambda e: e[1])[0] == 2
    hybrid = mo.hybrid_forecast(scored, df.withColumn("f", F.lag("rainfall").over(mo.DEFAULT.ordered())), ["f"], trees=2, depth=2)
    assert hybrid.where("predicted < 0").count() == 0 and hybrid.where("split = 'train'").count() == 0


def test_bootstrap_members(rows):
    ensemble = mo.bootstrap_ensemble(rows, FEATURES, members=3, trees=2, depth=2)
    assert ensemble.count() == 90
    assert ensemble.where(F.size("members") != 3).count() == 0
    assert ensemble.where(F.col("members")[0] != F.col("members")[1]).count() > 0


def test_selection_of_all_candidates(spark):
    folder = "/root/testdata/sf0.001"
    rows, names = qm.candidate_rows(spark, folder)
    dropped = {r.feature for r in qm.Q["j2_correlation_filter"](spark, folder).collect()}
    assert len(names) > 50 and dropped < set(names) and not dropped & se.PROTECTED
    left = [c for c in names if c not in dropped and c not in se.PROTECTED]
    pairs = co.correlation_pairs(rows, left).where("r is not null").collect()
    assert max(abs(p.r) for p in pairs) <= se.CORR_LIMIT
    linear = {r.feature for r in qm.Q["j5_selected_linear"](spark, folder).collect()}
    vif = {r.feature: r.vif for r in co.variance_inflation(rows, names).collect()}
    gain = {r.feature: r.gain_frac for r in se.gain_importance(rows, names, **qm.SMALL).collect()}
    for c in set(names) - se.PROTECTED:
        assert (c in linear) == (c not in dropped and vif.get(c, 0) <= 10 and gain[c] >= se.MIN_GAIN_FRAC), c
    inputs = qm.Q["d15_linear_inputs"](spark, folder).toPandas()
    assert set(inputs["feature"]) == linear and set(inputs["split"]) == {"train", "val", "test"}
    scaled = inputs[(inputs["split"] == "train") & inputs["feature"].isin(qm.ft.scalable(sorted(linear)))]
    np.testing.assert_allclose(scaled["mean"], 0, atol=1e-5)


def test_vif_of_dependent_columns(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 3))
    pdf = pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "sum": x[:, 0] + x[:, 1], "c": x[:, 2], "d": x[:, 2] + 0.5 * rng.normal(size=500), "flat": 1.0})
    got = {r.feature: r.vif for r in co.variance_inflation(spark.createDataFrame(pdf), list(pdf.columns)).collect()}
    plain = np.diag(np.linalg.inv(np.corrcoef(pdf[["a", "b", "c", "d"]].to_numpy().T)))
    assert [got[k] for k in ("a", "b", "sum")] == [np.inf] * 3 and "flat" not in got
    assert got["c"] == pytest.approx(plain[2], abs=0.02) and got["d"] == pytest.approx(plain[3], abs=0.02)


def test_order_selection_scores_every_order(spark):
    rows = qm.Q["k5_order_selection"](spark, "/root/testdata/sf0.001").collect()
    assert sorted(r.ar_order for r in rows) == [0, 1, 2] and all(np.isfinite(r.aic) for r in rows)


def test_shapley_values_add_up(spark):
    got = qm.Q["n1_shapley_values"](spark, "/root/testdata/sf0.001").groupBy("series_id", "date").agg(
        F.sum("phi").alias("phi"), F.max("prediction").alias("f"), F.max("base").alias("base"), F.count("*").alias("n"))
    assert got.count() > 0
    assert got.where(F.abs(F.col("phi") - (F.col("f") - F.col("base"))) > 1e-5).count() == 0  # rounded parts
    assert got.where(F.col("n") != len(qm.EXPLAINED)).count() == 0


def test_registered_band_covers_all_wet_test_rows(spark):
    from pluvia.plans import queries_models as qm

    folder = "/root/testdata/sf0.01"
    model, _, rows = qm.wet_model(spark, folder)
    n = rows.count()
    got = qm.band(spark, folder).toPandas()
    assert n > ex.ICE_ROWS and (got["n"] == n).all()
    every = ex.individual_curves(rows, qm.EXPLAINED, ["rh"], ex.model_predictor(model), None).where("grid_idx = 7").toPandas()["prediction"]
    one = got[(got["feature"] == "rh") & (got["grid_idx"] == 7)].iloc[0]
    assert np.allclose([one["low"], one["high"]], np.quantile(every, [0.05, 0.95]))
