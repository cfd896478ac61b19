"""Expected results: baseline forecasts, scores and reports."""

from __future__ import annotations

from pluvia.plans.sqlkit import define, q

S: dict[str, str] = {}

define("persist", """
  SELECT *, greatest(coalesce(lag(rainfall) OVER (PARTITION BY series_id ORDER BY date),
      last_train), 0) AS persistence FROM (
    SELECT s.*, t.last_train FROM splitdense s JOIN (
      SELECT series_id, arg_max(rainfall, date) AS last_train FROM splitdense WHERE split = 'train' GROUP BY 1) t
    ON t.series_id = s.series_id)""", "splitdense")
define("doymeans", """
  SELECT series_id, dayofyear(date) AS doy, avg(rainfall) AS m,
    row_number() OVER (PARTITION BY series_id ORDER BY dayofyear(date)) AS pos,
    count(*) OVER (PARTITION BY series_id) AS n
  FROM splitdense WHERE split = 'train' GROUP BY 1, 2""", "splitdense")
define("curve", """
  SELECT series_id, doy, greatest(v, 0) AS v FROM (
    SELECT *, avg(m) OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING) AS v FROM (
      SELECT series_id, doy, m, pos, true AS own FROM doymeans
      UNION ALL SELECT series_id, doy, m, pos - n, false FROM doymeans WHERE pos > n - 15
      UNION ALL SELECT series_id, doy, m, pos + n, false FROM doymeans WHERE pos <= 15)) WHERE own""", "doymeans")
define("curve366", """
  SELECT * FROM curve UNION ALL
  SELECT series_id, 366, v FROM curve c WHERE doy = 365
    AND NOT EXISTS (SELECT 1 FROM curve x WHERE x.series_id = c.series_id AND x.doy = 366)""", "curve")
define("based", """
  SELECT p.*, coalesce(c.v, o.v) AS climatology FROM persist p
  LEFT JOIN curve366 c ON c.series_id = p.series_id AND c.doy = p.day_of_year
  JOIN (SELECT series_id, avg(v) AS v FROM curve366 GROUP BY 1) o ON o.series_id = p.series_id""", "persist", "curve366")
define("hybrids", """
  SELECT *, greatest(exp(ln(1 + climatology) + CASE WHEN seen > 60 THEN coalesce(hat, 0) ELSE 0 END) - 1, 0) AS hybrid FROM (
    SELECT *, 0.5 * lag(ln(1 + rainfall) - ln(1 + climatology)) OVER (PARTITION BY series_id ORDER BY date) AS hat,
      row_number() OVER (PARTITION BY series_id, split ORDER BY date) AS seen FROM based)""", "based")
define("preds", """
  SELECT 'persistence' AS model, split, series_id, date, rainfall AS actual, persistence AS predicted
    FROM hybrids WHERE split <> 'train'
  UNION ALL SELECT 'climatology', split, series_id, date, rainfall, climatology FROM hybrids WHERE split <> 'train'
  UNION ALL SELECT 'hybrid', split, series_id, date, rainfall, hybrid FROM hybrids WHERE split <> 'train'""", "hybrids")
PRED = "model:s split:s series_id:i date:d actual:f predicted:f"
S["k1_persistence"] = q(PRED, "SELECT * FROM preds WHERE model = 'persistence'", "preds")
S["k2_climatology"] = q(PRED, "SELECT * FROM preds WHERE model = 'climatology'", "preds")
S["k6_hybrid_combine"] = q(
    PRED + " base_predicted:f residual:f",
    """SELECT 'hybrid' AS model, split, series_id, date, rainfall AS actual, climatology AS base_predicted,
         CASE WHEN seen > 60 THEN hat ELSE 0 END AS residual,
         greatest(exp(ln(1 + climatology) + CASE WHEN seen > 60 THEN hat ELSE 0 END) - 1, 0) AS predicted
       FROM hybrids WHERE split <> 'train'""", "hybrids", digits=5)
S["a6_prediction_store"] = q(
    PRED, "SELECT * FROM preds WHERE model IN ('persistence', 'hybrid') AND split = 'test'", "preds", digits=5)
define("scored", "SELECT *, predicted - actual AS e, month(date) IN (6,7,8,9) AS mon FROM preds", "preds")


def _metrics(where: str = "true") -> dict[str, str]:
    f = f"FILTER ({where})"
    return {
        "n": f"count(*) {f}",
        "rmse": f"sqrt(avg(e*e) {f})",
        "mae": f"avg(abs(e)) {f}",
        "nse": f"1 - sum(e*e) {f} / nullif(var_pop(actual) {f} * count(*) {f}, 0)",
        "r2": f"1 - sum(e*e) {f} / nullif(var_pop(actual) {f} * count(*) {f}, 0)",
        "mape_wet": f"avg(abs(e/actual)) FILTER (actual > 0.1 AND ({where})) * 100",
        "bias": f"avg(e) {f}",
        "hit_rate": f"count(*) FILTER (actual > 0.1 AND predicted > 0.1 AND ({where})) * CAST(1 AS DOUBLE)"
                    f" / nullif(count(*) FILTER (actual > 0.1 AND ({where})), 0)",
    }


def _list(where: str, names, suffix: str = "") -> str:
    m = _metrics(where)
    return ", ".join(f"{m[n]} AS {n}{suffix}" for n in names)


ALL = ("n", "rmse", "mae", "r2", "nse", "mape_wet", "bias", "hit_rate")
SEASON = ("rmse", "mae", "nse", "hit_rate")
EXTREME = ("rmse", "mae", "bias")
_ALL = _list("true", ALL)
_SEASON = _list("mon", SEASON, "_monsoon") + ", " + _list("NOT mon", SEASON, "_nonmonsoon")
_EXTREME = "count(*) FILTER (actual >= 50) AS n_extreme, " + _list("actual >= 50", EXTREME, "_extreme")
T_ALL = "n:i rmse:f mae:f r2:f nse:f mape_wet:f bias:f hit_rate:f"
T_SEASON = " ".join(f"{m}_{s}:f" for s in ("monsoon", "nonmonsoon") for m in SEASON)
T_EXTREME = "n_extreme:i rmse_extreme:f mae_extreme:f bias_extreme:f"
S["l1_metrics"] = q("model:s split:s " + T_ALL, f"SELECT model, split, {_ALL} FROM scored GROUP BY 1, 2", "scored")
S["l2_season_metrics"] = q("model:s split:s " + T_SEASON,
                           f"SELECT model, split, {_SEASON} FROM scored GROUP BY 1, 2", "scored")
S["l3_extreme_metrics"] = q("model:s split:s " + T_EXTREME,
                            f"SELECT model, split, {_EXTREME} FROM scored GROUP BY 1, 2", "scored")
define("comparison", f"""
  SELECT *, row_number() OVER (ORDER BY rmse, model) AS rank FROM (
    SELECT model, {_ALL}, {_SEASON}, {_EXTREME} FROM scored WHERE split = 'test' GROUP BY 1)""", "scored")
S["l4_comparison_table"] = q(f"model:s rank:i {T_ALL} {T_SEASON} {T_EXTREME}", "SELECT * FROM comparison", "comparison")
S["a4_comparison_csv"] = q("model:s rmse:f mae:f nse:f rank:i", "SELECT * FROM comparison", "comparison")
S["l5_align_models"] = q(
    "model:s split:s n_rows:i first_date:d rmse:f",
    """SELECT model, split, count(*) AS n_rows, min(date) AS first_date, sqrt(avg(e*e)) AS rmse FROM scored
       WHERE (series_id, date) IN (SELECT (series_id, date) FROM scored GROUP BY series_id, date
                                   HAVING count(DISTINCT model) = 3) GROUP BY 1, 2""", "scored")
S["l6_merge_comparisons"] = q(
    "model:s rank:i rmse:f mae:f nse:f",
    """SELECT model, rmse, mae, nse, row_number() OVER (ORDER BY rmse, model) AS rank FROM (
         SELECT * FROM comparison WHERE model <> 'hybrid'
         UNION ALL SELECT * FROM comparison WHERE model <> 'persistence'
           AND model NOT IN (SELECT model FROM comparison WHERE model <> 'hybrid'))""", "comparison")
S["l7_leaderboard"] = q(
    "model:s rank:i rmse:f nse:f improvement_pct:f best_vs_worst_pct:f",
    """SELECT model, rank, rmse, nse, greatest(0, (b - rmse)/b*100) AS improvement_pct,
         (max(rmse) OVER () - min(rmse) OVER ())/max(rmse) OVER ()*100 AS best_vs_worst_pct
       FROM comparison CROSS JOIN (SELECT max(rmse) AS b FROM comparison WHERE model = 'climatology')""", "comparison")
S["l8_verdicts"] = q(
    "model:s harder_season:s skill:s bias_direction:s",
    """SELECT model, CASE WHEN rmse_monsoon > rmse_nonmonsoon THEN 'monsoon' ELSE 'non-monsoon' END AS harder_season,
         CASE WHEN nse > 0.5 THEN 'good' WHEN nse > 0 THEN 'some' ELSE 'none' END AS skill,
         CASE WHEN bias > 0 THEN 'over' WHEN bias < 0 THEN 'under' ELSE 'none' END AS bias_direction
       FROM comparison""", "comparison")
S["l9_regime_metrics"] = q(
    "model:s regime:s rmse:f mae:f nse:f bias:f n:i",
    " UNION ALL ".join(
        f"SELECT model, '{r}' AS regime, {_list('true', ('rmse', 'mae', 'nse', 'bias', 'n'))} "
        f"FROM scored WHERE split = 'test' AND ({w}) GROUP BY 1"
        for r, w in (("all", "true"), ("monsoon", "mon"), ("non_monsoon", "NOT mon"), ("extremes", "actual >= 50"))),
    "scored")
S["l10_residual_stats"] = q(
    "model:s split:s bias:f std:f min:f max:f",
    """SELECT model, split, avg(e) AS bias, stddev_pop(e) AS std, min(e) AS min, max(e) AS max
       FROM scored GROUP BY 1, 2""", "scored")
S["l10_residual_histogram"] = q(
    "model:s bin:i n:i left_edge:f",
    """SELECT model, bin, count(*) AS n, max(lo + (hi-lo)/50*bin) AS left_edge FROM (
         SELECT model, lo, hi, least(floor((e-lo)/(hi-lo)*50), 49) AS bin FROM (
           SELECT model, e, min(e) OVER (PARTITION BY model) AS lo, max(e) OVER (PARTITION BY model) AS hi
           FROM scored WHERE split = 'test')) GROUP BY 1, 2""", "scored")
S["l11_taylor_statistics"] = q(
    "model:s r:f sigma_ratio:f theta:f",
    """SELECT model, corr(actual, predicted) AS r, stddev_pop(predicted)/stddev_pop(actual) AS sigma_ratio,
         acos(least(1, greatest(-1, corr(actual, predicted)))) AS theta
       FROM scored WHERE split = 'test' GROUP BY 1""", "scored")
S["l12_largest_miss"] = q(
    "model:s series_id:i date:d actual:f predicted:f abs_error:f",
    """SELECT model, series_id, date, actual, predicted, abs(e) AS abs_error FROM (
         SELECT *, row_number() OVER (PARTITION BY model ORDER BY abs(e) DESC, series_id, date) AS rk
         FROM scored WHERE split = 'test') WHERE rk = 1""", "scored")
S["l12_rain_hit_rate"] = q(
    "model:s split:s hit_rate:f",
    """SELECT model, split, count(*) FILTER (actual >= 0.1 AND predicted >= 0.1) * CAST(1 AS DOUBLE)
         / greatest(count(*) FILTER (actual >= 0.1), 1) AS hit_rate FROM scored GROUP BY 1, 2""", "scored")
S["l13_best_per_metric"] = q("metric:s model:s value:f", " UNION ALL ".join(
    f"""SELECT '{m}' AS metric, model, {m} AS value FROM (
        SELECT *, row_number() OVER (ORDER BY {m} {d}, model) AS rk FROM comparison WHERE {m} IS NOT NULL) WHERE rk = 1"""
    for ms, d in ((("rmse", "mae", "mape_wet"), "ASC"), (("nse", "r2", "hit_rate"), "DESC")) for m in ms), "comparison")
S["l14_season_zoom"] = q(
    PRED,
    """SELECT * FROM (SELECT *, min(CASE WHEN month(date) = 6 THEN date END) OVER (PARTITION BY model, series_id) AS st
         FROM preds WHERE split = 'test') WHERE date BETWEEN st AND st + INTERVAL 5 MONTH""", "preds", digits=5)
S["l15_extreme_errors"] = q(
    "model:s mae_extreme:f n:i",
    "SELECT model, avg(abs(e)) AS mae_extreme, count(*) AS n FROM scored WHERE split = 'test' AND actual >= 50 GROUP BY 1",
    "scored")
S["l15_extreme_days"] = q(
    PRED + " residual:f", "SELECT *, e AS residual FROM scored WHERE split = 'test' AND actual >= 50", "scored", digits=5)
