"""Hand-written frames: boundaries, gaps, duplicates, missing values, leap days."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
import unit_roots
from pyspark.sql import functions as F

from pluvia.functions.exprs import category
from pluvia.functions.frames import add_trailing
from pluvia.functions.quantiles import exact_quantiles
from pluvia.functions.special import _beta_ratio, _digamma, _gamma_ppf, _solve_shape
from pluvia.operators import calendar as cal
from pluvia.operators import correlation as co
from pluvia.operators import evaluate as ev
from pluvia.operators import features as ft
from pluvia.operators import forecast as fc
from pluvia.operators import seasonal as se
from pluvia.operators import structure as st
from pluvia.operators import uncertainty as un
from pluvia.operators import validate as va
from pluvia.sources import panel as pn
from pluvia.spec import DEFAULT



def column(df, name, *order):
    return [r[name] for r in df.orderBy(*(order or ("series_id", "date"))).collect()]


def test_category_boundaries(spark):
    values = [0.0, 0.1, 2.5, 15.6, 64.5, 115.6, None, float("nan")]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert [r[0] for r in df.select(category("x")).collect()] == [
        "No rain", "Light", "Moderate", "Heavy", "Very Heavy", "Extremely Heavy", "Unknown", "Unknown"]


def test_dates_duplicates_and_bounds(spark):
    raw = spark.createDataFrame(
        [(1, "2000-01-01", "5", 1), (1, "2000-01-01", "7", 0), (1, "bad", "1", 2), (1, "2000-02-30", "1", 3),
         (1, "2000-01-03", "n/a", 4), (1, "2000-01-07", "900", 5)],
        "series_id bigint, date string, rainfall string, seq int")
    report = {(r.check_name, r.item): (r.n_found, r.passed) for r in va.validation_report(
        raw, ["seq"], ["rainfall"], {"rainfall": (0.0, 500.0)}).collect()}
    assert report["unparseable_dates", "date"] == (2, False)
    assert report["duplicate_dates", "date"] == (1, False)
    assert report["missing_days", "date"] == (4, True)
    assert report["not_numeric", "rainfall"] == (1, True)
    assert report["bound_violations", "rainfall"] == (1, True)
    assert report["rows_kept", "*"] == (3, True)
    with pytest.raises(va.ValidationError):
        va.raise_on_failure(va.validation_report(raw, ["seq"], ["rainfall"], {"rainfall": (0.0, 500.0)}))
    first = va.keep_first(va.drop_undated(raw), ["seq"])
    assert column(first, "rainfall") == ["7", "n/a", "900"]
    with pytest.raises(va.ValidationError):
        va.require_columns(raw, ["date", "absent"])


def test_gaps_and_densify(spark):
    d = lambda i: dt.date(2000, 2, i)
    df = spark.createDataFrame([(1, d(27), 1.0), (1, d(29), 2.0), (2, d(28), 3.0)],
                               "series_id bigint, date date, rainfall double")
    gap = va.temporal_gaps(df).collect()
    assert [(g.gap_start, g.gap_end, g.n_days) for g in gap] == [(d(28), d(28), 1)]
    own = cal.densify(df)
    assert column(own, "rainfall") == [1.0, 0.0, 2.0, 3.0]
    wide = cal.densify(df, first=F.lit(d(26)), last=F.lit(dt.date(2000, 3, 1)), fill=None)
    assert column(wide, "rainfall") == [None, 1.0, None, 2.0, None, None, None, 3.0, None, None]


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "x double")
    assert va.missing_values(df, ["x"]).head().n_missing == 2
    assert va.bound_violations(va.coerce_numeric(df, ["x"]), {"x": (2.0, 3.0)}).head().n_violations == 1


def test_reference_row_counts(panel):
    rng = np.random.default_rng(0)
    df = cal.split_by_position(cal.add_calendar(panel({1: rng.integers(0, 3, 9497)})))
    assert {r.split: r.n_rows for r in cal.split_summary(df).collect()} == {"train": 6647, "val": 1424, "test": 1426}
    warm = ft.drop_warmup(ft.add_lags(df))
    counts = {r.split: r.n_rows for r in cal.split_summary(warm).collect()}
    assert sum(counts.values()) == 9467 and counts["train"] == 6617
    windows = ft.sliding_windows(df, ["rainfall"], 60).where(F.col("split") == "test")
    assert windows.count() == 1366


def test_feature_count(spark):
    df = ft.feature_table(pn.split_panel(spark, "/root/testdata/sf0.001"))
    assert len(ft.feature_names(df)) == 58
    assert len(set(df.columns)) == len(df.columns) == 58 + 4


def test_trailing_matches_pandas(panel):
    rng = np.random.default_rng(1)
    y = [*rng.gamma(0.3, 20, 60), *[0.1] * 40, *(1e6 + rng.normal(0, 1, 40))]
    y[20] = None
    widths = (2, 7, 14, 30)
    df = add_trailing(panel({1: y}), {f"m{n}": ("rainfall", n) for n in widths},
                      {f"s{n}": ("rainfall", n) for n in widths}, DEFAULT.ordered())
    got = df.orderBy("date").toPandas()
    ref = pd.Series(y, dtype=float)
    for n in widths:
        # Recomputed window by window: pandas' running update drifts on the jump to 1e6.
        direct = [np.nan if t < n - 1 or ref[t - n + 1:t + 1].isna().any() else ref[t - n + 1:t + 1] for t in range(len(y))]
        mean = np.array([np.nan if isinstance(x, float) else x.mean() for x in direct])
        std = np.array([np.nan if isinstance(x, float) else x.std(ddof=1) for x in direct])
        np.testing.assert_allclose(got[f"m{n}"].astype(float), mean, rtol=1e-12)
        np.testing.assert_allclose(got[f"s{n}"].astype(float), std, rtol=1e-6, atol=1e-9)
    assert got.loc[95, "s14"] == pytest.approx(0.0, abs=1e-12)


@pytest.mark.parametrize("values", [[0] * 12, [5] * 12, [0, 0, 3, 0, 0, 0, 0, 2, 0, 0, 0, 0], [0]])
def test_dry_spells(panel, values):
    df = panel({1: values})
    runs, lengths, run = [], [], 0
    for v in [*values, 9]:
        if v < 0.1:
            run += 1
        else:
            runs += [run] if run >= 3 else []
            run = 0
        lengths.append(run)
    assert sorted(column(se.dry_spells(df), "n_days", "start_date")) == sorted(runs)
    assert column(ft.add_dry_spell_length(df), "dry_spell_length") == lengths[:-1]
    assert column(ft.add_dry_spell_length(df, causal=True), "dry_spell_length") == [0, *lengths[:-2]]


def test_spell_start_months_keep_series_without_spells(panel):
    df = se.spell_start_months(panel({1: [5] * 10, 2: [0] * 10}))
    assert df.where("series_id = 1").agg(F.sum("n_starts")).head()[0] == 0
    assert df.where("series_id = 2 and month = 1").head().n_starts == 1


def test_leap_day_and_iso_week(spark):
    days = [dt.date(2000, 12, 31), dt.date(2000, 2, 29), dt.date(2021, 1, 3), dt.date(2001, 12, 31)]
    df = spark.createDataFrame([(1, d, 0.0) for d in days], "series_id bigint, date date, rainfall double")
    rows = ft.add_calendar_features(cal.add_calendar(df)).collect()
    for r in rows:
        assert r.day_of_year == r.date.timetuple().tm_yday
        assert r.week_of_year == r.date.isocalendar().week
        assert r.day_of_week == r.date.weekday()


@pytest.mark.parametrize("accuracy", [20, 20_000])
@pytest.mark.parametrize("kind", ["smooth", "ties", "constant", "outlier"])
def test_exact_quantiles(spark, accuracy, kind):
    rng = np.random.default_rng(3)
    x = {"smooth": rng.normal(size=3001), "ties": rng.integers(0, 4, 3000).astype(float),
         "constant": np.full(500, 2.0), "outlier": np.r_[rng.normal(size=2000), 1e9]}[kind]
    df = spark.createDataFrame([(float(v), i % 2) for i, v in enumerate(x)], "x double, g int")
    p = [0.0, 0.01, 0.5, 0.9, 0.99, 1.0]
    got = {r.p: r.q for r in exact_quantiles(df, "x", p, accuracy=accuracy).collect()}
    np.testing.assert_allclose([got[v] for v in p], np.quantile(x, p), rtol=1e-12)
    got = {(r.g, r.p): r.q for r in exact_quantiles(df, "x", p, ["g"], 2, accuracy).collect()}
    for g in (0, 1):
        np.testing.assert_allclose([got[g, v] for v in p], np.quantile(x[g::2], p), rtol=1e-12)


def test_comoments_pairwise_complete(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 3)) + [0, 1e5, 3]
    x[:, 2] += 0.5 * x[:, 0]
    x[rng.random(x.shape) < 0.1] = np.nan
    pdf = pd.DataFrame(x, columns=list("abc"))
    df = spark.createDataFrame(pdf).repartition(7)
    ref = pdf.corr()
    for r in co.correlation_pairs(df, list("abc")).collect():
        assert r.r == pytest.approx(ref.loc[r.feature_a, r.feature_b], abs=1e-9)
        assert r.n == pdf[[r.feature_a, r.feature_b]].dropna().shape[0]


def test_vif_and_constant_column(spark):
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=400), rng.normal(size=400)
    pdf = pd.DataFrame({"a": a, "b": b, "c": a + b + 0.1 * rng.normal(size=400), "k": 1.0})
    got = {r.feature: r.vif for r in co.variance_inflation(spark.createDataFrame(pdf), list("abck")).collect()}
    want = np.diag(np.linalg.inv(np.corrcoef(pdf[["a", "b", "c"]].T)))
    assert set(got) == {"a", "b", "c"}
    np.testing.assert_allclose([got[c] for c in "abc"], want, atol=0.006)


def test_partial_autocorrelation(panel):
    rng = np.random.default_rng(6)
    y = np.zeros(600)
    for t in range(1, 600):
        y[t] = 0.6 * y[t - 1] + rng.normal()
    df = st.partial_autocorrelation(panel({1: y}), "rainfall", 6)
    e = y - y.mean()
    r = np.array([e[k:] @ e[:600 - k] / (e @ e) for k in range(7)])
    for k in range(1, 7):
        toeplitz = r[np.abs(np.subtract.outer(range(k), range(k)))]
        want = np.linalg.solve(toeplitz, r[1:k + 1])[-1]
        assert df.where(f"lag = {k}").head().pacf == pytest.approx(want, abs=1e-9)


def test_unit_root_tests():
    rng = np.random.default_rng(7)
    noise = rng.normal(size=800)
    walk = noise.cumsum()
    stat, p, lags, n = unit_roots.adf(noise)
    assert p < 0.01 and n == 799 - lags
    assert unit_roots.adf(walk)[1] > 0.05
    assert unit_roots.kpss(noise, "c")[1] > 0.05 and unit_roots.kpss(walk, "c")[1] < 0.05
    # Tabulated 5 % point of the Dickey-Fuller distribution.
    assert st.mackinnon_p(-2.86) == pytest.approx(0.05, abs=0.002)
    # Without lags the closed form and the regression agree.
    x = np.column_stack([np.ones(799), noise[:-1]])
    coef, res, *_ = np.linalg.lstsq(x, np.diff(noise), rcond=None)
    se = math.sqrt(res[0] / 797 * np.linalg.inv(x.T @ x)[1, 1])
    assert lags > 0 or stat == pytest.approx(coef[1] / se)


def series_of_many_kinds():
    rng = np.random.default_rng(17)
    drops = lambda n: np.where(rng.random(n) < 0.7, 0.0, rng.gamma(0.7, 9.0, n))
    walk = rng.normal(size=900).cumsum()
    slow = np.zeros(700)
    for t in range(2, 700):
        slow[t] = 1.2 * slow[t - 1] - 0.25 * slow[t - 2] + rng.normal()
    out = {"noise": rng.normal(size=800), "walk": walk + 1e3, "slow": slow, "rain": drops(1500),
           "trend": drops(600) + 0.02 * np.arange(600), "short": rng.normal(size=10), "season": 5 + np.sin(np.arange(1200) / 58) * 3 + drops(1200)}
    out["gaps"] = [None if i % 11 == 3 else v for i, v in enumerate(drops(500))]
    return {k: list(v) for k, v in out.items()}


def keyed_panel(spark, series):
    """A panel whose series have text keys."""
    days = [dt.date(2000, 1, 1) + dt.timedelta(days=i) for i in range(1500)]
    rows = [(k, days[i], None if v is None else float(v)) for k, values in series.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "series_id string, date date, rainfall double")


def test_unit_roots_from_sums_equal_single_series(spark):
    series = series_of_many_kinds()
    df = keyed_panel(spark, {**series, "flat": [2.0] * 50, "one": [1.0], "none": [None] * 5})
    plain = {k: np.array([x for x in v if x is not None]) for k, v in series.items()}
    got = {r["series_id"]: r for r in st.adf_test(df, "rainfall", "raw").collect()}
    assert dict(st.adf_test(df, "rainfall", "raw").dtypes)["series_id"] == "string"
    for k, y in plain.items():
        stat, p, lags, n = unit_roots.adf(y)
        assert (got[k]["n_lags"], got[k]["n_obs"]) == (lags, n), k
        assert got[k]["statistic"] == pytest.approx(stat, rel=1e-8) and got[k]["p_value"] == pytest.approx(p, abs=1e-8)
        assert got[k]["crit_5"] == pytest.approx(sum(c / n**i for i, c in enumerate(st.TAU_CRITICAL["5%"])))
        assert got[k]["is_stationary"] == (p < 0.05)
    assert all(got[k]["statistic"] is None and got[k]["is_stationary"] is None for k in ("flat", "one"))
    for regression in ("c", "ct"):
        got = {r["series_id"]: r for r in st.kpss_test(df, "rainfall", "raw", regression).collect()}
        for k, y in plain.items():
            stat, p, lags = unit_roots.kpss(y, regression)
            assert got[k]["n_lags"] == lags, k
            assert got[k]["statistic"] == pytest.approx(stat, rel=1e-8) and got[k]["p_value"] == pytest.approx(p, abs=1e-8)
            assert got[k]["is_stationary"] == (p > 0.05)
        assert "flat" not in got or got["flat"]["statistic"] is None


def test_unit_roots_on_an_empty_panel(spark):
    empty = spark.createDataFrame([], "series_id string, date date, rainfall double")
    assert st.adf_test(empty, "rainfall", "raw").count() == st.kpss_test(empty, "rainfall", "raw").count() == 0


def test_kpss_neither_joins_nor_writes_the_panel(spark, monkeypatch):
    written = []
    monkeypatch.setattr("pyspark.sql.DataFrameWriter.parquet", lambda *a, **k: written.append(a))
    df = keyed_panel(spark, {"a": [1.0, 2.0, 4.0] * 20})
    text = st.kpss_test(df, "rainfall", "raw")._jdf.queryExecution().executedPlan().toString()
    assert not written and "Join" not in text and text.count("Exchange hashpartitioning") == 1


def test_kpss_lags_beyond_a_short_series(spark):
    y = np.array([3.0, -1.0, 2.0, 0.5, 1.0])
    s = (y - y.mean()).cumsum()
    got = st.kpss_test(keyed_panel(spark, {"a": list(y)}), "rainfall", "raw", n_lags=7).head()
    tail = s[:4] @ s[:4]  # as many sums after the end as there are present values before the last
    assert got.statistic == pytest.approx((s @ s / 5) / ((s @ s + tail) / 8), rel=1e-9)


def test_regression_on_a_constant_column_has_no_line(spark):
    df = spark.createDataFrame([(5.0, float(i), 2.0 * i) for i in range(6)], "a double, b double, c double")
    rows = {(r.x, r.y): r for r in co.pair_regressions(df, [("a", "b"), ("b", "c")]).collect()}
    assert rows["a", "b"].slope is None and rows["a", "b"].intercept is None and rows["a", "b"].r is None
    assert rows["b", "c"].slope == pytest.approx(2.0) and rows["b", "c"].intercept == pytest.approx(0.0)


def test_features_of_days_equal_the_feature_table(spark):
    folder = "/root/testdata/sf0.001"
    want = ft.drop_warmup(ft.feature_table(pn.split_panel(spark, folder)))
    panel = cal.split_by_position(pn.dense_panel(spark, folder))
    got = ft.feature_table_of_days(panel, cal.add_calendar(pn.daily_covariates(spark, folder)))
    assert got.dtypes == want.dtypes
    a, b = (df.orderBy("series_id", "date").toPandas() for df in (got, want))
    pd.testing.assert_frame_equal(a, b, check_exact=False, rtol=1e-12)
    # the windows pass over the target alone, the covariates' lags are of one row a day
    text = got._jdf.queryExecution().optimizedPlan().toString()
    assert "SortMergeJoin" not in text and text.count("Repartition") == 1


def test_panel_tasks_grow_with_the_stretched_rows(spark):
    from pyspark.sql import Row
    assert pn.panel_tasks(spark, Row(days=2500, series=60_000)) == 500
    assert pn.panel_tasks(spark, Row(days=2500, series=360_000)) == 3000
    assert 1 <= pn.panel_tasks(spark, Row(days=None, series=0)) <= 8


def test_no_series_is_a_pandas_group(spark):
    df = keyed_panel(spark, {"a": [1.0, 2.0, 4.0] * 20})
    for plan in (st.adf_test(df, "rainfall", "raw"), st.kpss_test(df, "rainfall", "raw")):
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapGroups" not in text and "MapInPandas" not in text


def test_special_functions():
    assert _beta_ratio(5, 0.5, 10 / (10 + 2.2281388519649385 ** 2)) == pytest.approx(0.05, abs=1e-9)
    assert _digamma(1.0) == pytest.approx(-0.5772156649015329, abs=1e-9)
    np.testing.assert_allclose(_gamma_ppf(np.array([0.5, 0.9]), np.array([2.0, 1.0])), [1.6783469900166605, -math.log(0.1)])
    x = np.random.default_rng(8).gamma(1.7, 3.0, 200_000)
    assert _solve_shape(math.log(x.mean()) - np.log(x).mean()) == pytest.approx(1.7, rel=0.02)


def predictions(spark, actual, predicted, model="m"):
    day = dt.date(2001, 6, 1)
    return spark.createDataFrame(
        [(model, "test", 1, day + dt.timedelta(days=i), float(a), float(p))
         for i, (a, p) in enumerate(zip(actual, predicted))],
        "model string, split string, series_id bigint, date date, actual double, predicted double")


def test_perfect_and_constant_scores(spark):
    perfect = ev.metrics(predictions(spark, [0, 5, 60], [0, 5, 60])).head()
    assert (perfect.rmse, perfect.nse, perfect.hit_rate) == (0.0, 1.0, 1.0)
    constant = ev.metrics(predictions(spark, [0, 0, 0], [1, -1, 0])).head()
    assert constant.nse is None and constant.hit_rate is None and constant.mape_wet is None
    assert constant.mae == pytest.approx(1 / 3)  # negative forecasts are clipped


def test_climatology_falls_back(panel):
    rng = np.random.default_rng(9)
    y = rng.integers(0, 9, 1100).astype(float)
    df = cal.split_by_position(cal.add_calendar(panel({1: y}, start=dt.date(2001, 1, 1))))
    got = fc.climatology_forecast(df).orderBy("date").toPandas()
    base = pd.Series(y, index=pd.date_range("2001-01-01", periods=1100))
    train = base[:770]
    means = train.groupby(train.index.dayofyear).mean()
    padded = np.r_[means.to_numpy()[-15:], means, means.to_numpy()[:15]]
    smooth = pd.Series([padded[i + 15 - 7:i + 15 + 8].mean() for i in range(len(means))], index=means.index)
    assert 366 not in smooth.index
    days = pd.to_datetime(got["date"]).dt.dayofyear
    np.testing.assert_allclose(got["predicted"], [smooth[min(d, 365)] for d in days])


def test_crps_and_intervals(spark):
    rng = np.random.default_rng(10)
    x = np.log1p(rng.gamma(0.5, 10, (30, 12)))
    rows = [(1, dt.date(2001, 1, 1) + dt.timedelta(days=i), float(rng.gamma(0.5, 10)), [float(v) for v in m])
            for i, m in enumerate(x)]
    df = spark.createDataFrame(rows, "series_id bigint, date date, actual double, members array<double>")
    got = un.crps(un.intervals(df)).orderBy("date").collect()
    for r, (_, _, y, m) in zip(got, rows):
        mm = np.expm1(m)
        want = np.abs(mm - y).mean() - 0.5 * np.abs(np.subtract.outer(mm, mm)).mean()
        assert r.crps == pytest.approx(want) and r.crps >= 0
        assert r.lower_80 == pytest.approx(np.expm1(np.quantile(m, 0.1)))
        assert r.upper_80 == pytest.approx(np.expm1(np.quantile(m, 0.9)))
    curve = un.calibration_curve(df).orderBy("nominal_coverage").toPandas()
    assert curve["empirical_coverage"].is_monotonic_increasing


def test_conformal_level_of_small_samples(spark):
    val = predictions(spark, range(20), [0.0] * 20).withColumn("split", F.lit("val"))
    test = predictions(spark, [1.0], [3.0])
    row = un.conformal_intervals(val.unionByName(test)).head()
    assert row.q == pytest.approx(np.quantile(np.arange(20.0), min(1, 0.9 * (1 + 1 / 20))))
    assert (row.lower, row.upper) == (pytest.approx(3 - row.q), pytest.approx(3 + row.q))


def test_scaled_train_rows_have_unit_spread(panel):
    rng = np.random.default_rng(11)
    df = cal.split_by_position(panel({1: rng.normal(5, 3, 300), 2: rng.normal(-5, 2, 300)}))
    df = df.withColumns({"x": F.col("rainfall"), "k": F.lit(4.0)})
    scaled = ft.standardise(df, ft.scaler_parameters(df, ["x", "k"]), ["x", "k"]).where("split = 'train'")
    r = scaled.agg(F.avg("x"), F.stddev_pop("x"), F.max("k")).head()
    assert r[0] == pytest.approx(0, abs=1e-12) and r[1] == pytest.approx(1) and r[2] == 0.0


def test_short_series_lose_all_rows_to_warmup(spark):
    df = cal.split_by_position(cal.add_calendar(cal.densify(pn.event_panel(spark, "/root/testdata/sf0.001"))))
    assert df.count() > 0
    assert ft.drop_warmup(ft.add_lags(df)).count() == 0


def test_mann_kendall_direction(panel):
    up = [0.1 * i for i in range(365 * 8)]
    rows = {r.series_id: r for r in se.mann_kendall(panel({1: up, 2: up[::-1]})).collect()}
    assert (rows[1].verdict, rows[2].verdict) == ("increasing", "decreasing")
    assert rows[1].s == -rows[2].s


def test_no_value_is_too_large_to_count(spark, panel):
    from pluvia.operators import distribution, uncertainty
    df = panel({1: [0.0, 1.0, 200.0, 300.0, 1500.0]})
    assert distribution.histogram(df).agg(F.sum("n")).first()[0] == 5
    ensemble = df.select("series_id", "date", F.col("rainfall").alias("actual"),
                         F.array(F.lit(0.1), F.lit(0.5)).alias("members"))
    assert uncertainty.crps_by_intensity(ensemble).agg(F.sum("n")).first()[0] == 5
    assert uncertainty.width_histogram(uncertainty.interval_table(ensemble)).agg(F.sum("n")).first()[0] == 5


def test_lags_reach_back_over_the_split(spark, panel):
    from pluvia.operators import calendar, forecast, uncertainty
    split = calendar.split_by_position(panel({1: [float(i % 9) for i in range(1000)], 2: [1.0] * 1000}))
    days = split.where("split = 'test'").count()
    assert uncertainty.analog_ensemble(split).count() == days
    scored = forecast.long_predictions(
        forecast.carried_residual(forecast.with_baselines(calendar.add_calendar(split))), ["climatology", "hybrid"])
    assert {r["n"] for r in scored.where("split = 'test'").groupBy("model").agg(F.count("*").alias("n")).collect()} == {days}


def test_centred_means_of_every_width(spark, panel):
    from pluvia.functions.frames import add_centred_means
    from pluvia.spec import DEFAULT
    values = [None if i % 7 == 3 else float(i * i % 23) for i in range(60)]
    plan = {f"m{n}": ("rainfall", n, max(1, n // 2)) for n in (1, 2, 3, 8, 31, 90)}
    got = add_centred_means(panel({1: values}), plan, DEFAULT.ordered()).toPandas().sort_values("date")
    for name, (_, n, least) in plan.items():
        for i, mine in enumerate(got[name]):
            frame = [v for v in values[max(0, i - n // 2): i + (n - 1) // 2 + 1] if v is not None]
            want = sum(frame) / len(frame) if len(frame) >= least else None
            assert (want is None and mine != mine) or mine == pytest.approx(want), (name, i)
