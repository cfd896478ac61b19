"""Expected results: ensemble, intervals, calibration, CRPS, conformal bounds."""

from __future__ import annotations

from pluvia.operators.uncertainty import ANALOG_MEMBERS, CALIBRATION_LEVELS, INTERVAL_LEVELS
from pluvia.plans.sqlkit import define, q

S: dict[str, str] = {}

define("members", """
  SELECT series_id, date, rainfall AS actual, k - 1 AS member, value, count(value) OVER (PARTITION BY series_id, date) AS n
  FROM (""" + " UNION ALL ".join(
    f"""SELECT series_id, date, rainfall, split, {k} AS k, ln(1 + lag(rainfall, {7 * k}) OVER
        (PARTITION BY series_id ORDER BY date)) AS value FROM splitdense"""
    for k in range(1, ANALOG_MEMBERS + 1)) + ") WHERE split = 'test'", "splitdense")
define("full_members", f"SELECT * FROM members WHERE n = {ANALOG_MEMBERS}", "members")
KEY = "series_id:i date:d actual:f "
S["o1_analog_ensemble"] = q(KEY + "member:i value:f", "SELECT * FROM full_members", "full_members")


def _pair(level: int) -> tuple[str, str]:
    tail = (100 - level) / 200
    return f"quantile_cont(value, {tail})", f"quantile_cont(value, {1 - tail})"


_BOUNDS = ", ".join(
    f"greatest(exp({lo}) - 1, 0) AS lower_{v}, greatest(exp({hi}) - 1, 0) AS upper_{v}"
    for v in INTERVAL_LEVELS for lo, hi in [_pair(v)])
define("bands", f"""
  SELECT *, greatest(exp(mean_log) - 1, 0) AS mean_mm,
    greatest(exp(mean_log + std_log) - exp(mean_log), 0) AS std_mm, month(date) AS month, month(date) IN (6,7,8,9) AS mon,
    CASE WHEN actual >= 0 AND actual < 0.1 THEN 'Dry' WHEN actual >= 0.1 AND actual < 5 THEN 'Light'
         WHEN actual >= 5 AND actual < 20 THEN 'Moderate' WHEN actual >= 20 THEN 'Heavy+' END AS intensity
  FROM (SELECT series_id, date, max(actual) AS actual, avg(value) AS mean_log, stddev_pop(value) AS std_log, {_BOUNDS}
        FROM full_members GROUP BY 1, 2)""", "full_members")
S["o2_ensemble_summary"] = q(KEY + "mean_log:f std_log:f mean_mm:f std_mm:f", "SELECT * FROM bands", "bands", digits=5)
S["o3_central_intervals"] = q(
    KEY + " ".join(f"lower_{v}:f upper_{v}:f" for v in INTERVAL_LEVELS), "SELECT * FROM bands", "bands", digits=5)
S["o4_interval_stats"] = q(
    "level:i coverage:f mean_width:f normalised_width:f mean_std_mm:f max_std_mm:f std_monsoon:f std_nonmonsoon:f",
    " UNION ALL ".join(
        f"""SELECT {v} AS level, count(*) FILTER (actual BETWEEN lower_{v} AND upper_{v}) * CAST(1 AS DOUBLE)/count(*) AS coverage,
            avg(upper_{v} - lower_{v}) AS mean_width, avg(upper_{v} - lower_{v})/(stddev_pop(actual) + 1e-8) AS normalised_width,
            avg(std_mm) AS mean_std_mm, max(std_mm) AS max_std_mm, avg(std_mm) FILTER (mon) AS std_monsoon,
            avg(std_mm) FILTER (NOT mon) AS std_nonmonsoon FROM bands""" for v in INTERVAL_LEVELS), "bands")
_CAL = ", ".join(f"{lo} AS lo_{v}, {hi} AS hi_{v}" for v in CALIBRATION_LEVELS for lo, hi in [_pair(v)])
define("logbands", f"SELECT series_id, date, ln(1 + max(actual)) AS y, {_CAL} FROM full_members GROUP BY 1, 2", "full_members")
define("curves", " UNION ALL ".join(
    f"""SELECT nominal_coverage, empirical_coverage, abs(empirical_coverage - nominal_coverage) AS calibration_error,
        mean_interval_width FROM (SELECT CAST({v / 100} AS DOUBLE) AS nominal_coverage,
          count(*) FILTER (y BETWEEN lo_{v} AND hi_{v}) * CAST(1 AS DOUBLE)/count(*) AS empirical_coverage,
          avg(greatest(exp(hi_{v}) - 1, 0) - greatest(exp(lo_{v}) - 1, 0)) AS mean_interval_width FROM logbands)"""
    for v in CALIBRATION_LEVELS), "logbands")
S["o5_calibration_curve"] = q(
    "nominal_coverage:f empirical_coverage:f calibration_error:f mean_interval_width:f", "SELECT * FROM curves", "curves")
define("mm", "SELECT *, greatest(exp(value) - 1, 0) AS x FROM full_members", "full_members")
define("crps", f"""
  SELECT a.series_id, a.date, a.actual, a.term1 - 0.5 * b.term2 AS crps, month(a.date) AS month
  FROM (SELECT series_id, date, max(actual) AS actual, avg(abs(x - actual)) AS term1 FROM mm GROUP BY 1, 2) a
  JOIN (SELECT p.series_id, p.date, sum(abs(p.x - r.x)) / {ANALOG_MEMBERS ** 2} AS term2 FROM mm p
        JOIN mm r ON r.series_id = p.series_id AND r.date = p.date GROUP BY 1, 2) b
    ON a.series_id = b.series_id AND a.date = b.date""", "mm")
S["o5_calibration_summary"] = q(
    "ece:f mean_width_90:f crps_mm:f",
    """SELECT avg(calibration_error) AS ece, max(mean_interval_width) FILTER (nominal_coverage = 0.9) AS mean_width_90,
         (SELECT avg(crps) FROM crps) AS crps_mm FROM curves""", "curves", "crps")
S["o6_crps"] = q(KEY + "crps:f", "SELECT * FROM crps", "crps")
S["o7_crps_by_month"] = q(
    "month:i crps:f n:i", "SELECT month, avg(crps) AS crps, count(*) AS n FROM crps GROUP BY 1", "crps")
S["o7_crps_by_intensity"] = q(
    "intensity:s crps:f n:i",
    """SELECT b.intensity, avg(c.crps) AS crps, count(*) AS n FROM crps c JOIN bands b
       ON b.series_id = c.series_id AND b.date = c.date WHERE b.intensity IS NOT NULL GROUP BY 1""", "crps", "bands")
S["o8_width_histogram"] = q(
    "intensity:s bin:i n:i left_edge:f mean_width:f",
    """SELECT intensity, bin, count(*) AS n, max(lo + (hi-lo)/30*bin) AS left_edge, avg(w) AS mean_width FROM (
         SELECT *, CASE WHEN hi = lo THEN 0 ELSE least(floor((w-lo)/(hi-lo)*30), 29) END AS bin FROM (
           SELECT intensity, upper_90 - lower_90 AS w, min(upper_90 - lower_90) OVER (PARTITION BY intensity) AS lo,
             max(upper_90 - lower_90) OVER (PARTITION BY intensity) AS hi FROM bands WHERE intensity IS NOT NULL))
       GROUP BY 1, 2""", "bands")
S["o8_monthly_spread"] = q(
    "month:i mean_std_mm:f mean_width:f",
    "SELECT month, avg(std_mm) AS mean_std_mm, avg(upper_90 - lower_90) AS mean_width FROM bands GROUP BY 1", "bands")
S["o9_exceedances"] = q(KEY + "mean_mm:f upper_90:f", "SELECT * FROM bands WHERE actual > upper_90", "bands", digits=5)
S["o9_exceedance_counts"] = q(
    "series_id:i n_days:i n_exceed:i",
    "SELECT series_id, count(*) AS n_days, count(*) FILTER (actual > upper_90) AS n_exceed FROM bands GROUP BY 1", "bands")
S["o10_calibration_labels"] = q(
    "nominal_coverage:f calibration_error:f assessment:s ece:f overall:s",
    """SELECT nominal_coverage, calibration_error, CASE WHEN calibration_error < 0.03 THEN 'well-calibrated'
         WHEN calibration_error < 0.07 THEN 'slight bias' ELSE 'miscalibrated' END AS assessment,
         avg(calibration_error) OVER () AS ece, CASE WHEN avg(calibration_error) OVER () < 0.05 THEN 'well-calibrated'
         WHEN avg(calibration_error) OVER () < 0.10 THEN 'moderately calibrated' ELSE 'poorly calibrated' END AS overall
       FROM curves""", "curves")
S["o10_season_ratio"] = q(
    "std_monsoon:f std_nonmonsoon:f ratio:f",
    """SELECT avg(std_mm) FILTER (mon) AS std_monsoon, avg(std_mm) FILTER (NOT mon) AS std_nonmonsoon,
         avg(std_mm) FILTER (mon)/avg(std_mm) FILTER (NOT mon) AS ratio FROM bands""", "bands")
S["o11_conformal_intervals"] = q(
    "model:s q:f n:i coverage:f mean_width:f",
    """SELECT p.model, max(c.q) AS q, count(*) AS n,
         count(*) FILTER (actual BETWEEN predicted - c.q AND predicted + c.q) * CAST(1 AS DOUBLE)/count(*) AS coverage,
         2*max(c.q) AS mean_width FROM preds p
       JOIN (SELECT model, a + (b - a) * (pos - floor(pos)) AS q FROM (
               SELECT model, pos, max(s) FILTER (rk = floor(pos) + 1) AS a,
                 max(s) FILTER (rk = least(floor(pos) + 2, n)) AS b FROM (
                 SELECT model, s, rk, n, (n - 1) * least(1, CAST(0.9 AS DOUBLE) * (1 + CAST(1 AS DOUBLE)/n)) AS pos FROM (
                   SELECT model, abs(actual - predicted) AS s, row_number() OVER (PARTITION BY model ORDER BY abs(actual - predicted)) AS rk,
                     count(*) OVER (PARTITION BY model) AS n FROM preds WHERE split = 'val')) GROUP BY 1, 2)) c
         ON c.model = p.model WHERE p.split = 'test' GROUP BY 1""", "preds", digits=5)
