"""Expected results: distribution and seasonal profile."""

from __future__ import annotations

from pluvia.operators.distribution import HISTOGRAM_EDGES
from pluvia.plans.queries_profile import RANGE, SHARES
from pluvia.plans.sqlkit import define, q
from pluvia.spec import CATEGORIES, SEASONS

S: dict[str, str] = {}
PER = "PARTITION BY series_id"

define("categorised", """
  SELECT *, CASE WHEN rainfall < 0.1 THEN 'No rain' WHEN rainfall < 2.5 THEN 'Light'
    WHEN rainfall < 15.6 THEN 'Moderate' WHEN rainfall < 64.5 THEN 'Heavy'
    WHEN rainfall < 115.6 THEN 'Very Heavy' WHEN rainfall IS NULL THEN 'Unknown'
    ELSE 'Extremely Heavy' END AS category FROM dense""", "dense")
S["e1_category_counts"] = q("series_id:i category:s n:i pct:f", " UNION ALL ".join(
    f"""SELECT series_id, '{c}' AS category, count(*) FILTER (category = '{c}') AS n,
        count(*) FILTER (category = '{c}') * 100.0 / count(*) AS pct FROM categorised GROUP BY 1"""
    for c in CATEGORIES), "categorised")


def _skew(x: str, m: str) -> str:
    return f"avg(pow({x} - {m}, 3)) / pow(avg(pow({x} - {m}, 2)), 1.5)"


S["e2_distribution_stats"] = q(
    "series_id:i n_total:i n_dry:i n_rainy:i pct_dry:f pct_rainy:f n_heavy:i n_extreme:i mean:f median:f std:f "
    "max:f p95:f p99:f skewness:f kurtosis_excess:f skewness_wet:f log_skewness:f",
    f"""SELECT series_id, count(*) AS n_total, count(*) FILTER (y < 0.1) AS n_dry,
      count(*) - count(*) FILTER (y < 0.1) AS n_rainy, count(*) FILTER (y < 0.1)*100.0/count(*) AS pct_dry,
      (count(*) - count(*) FILTER (y < 0.1))*100.0/count(*) AS pct_rainy,
      count(*) FILTER (y >= 64.5) AS n_heavy, count(*) FILTER (y >= 204.4) AS n_extreme,
      avg(y) AS mean, quantile_cont(y, 0.5) AS median, stddev_samp(y) AS std, max(y) AS max,
      quantile_cont(y, 0.95) AS p95, quantile_cont(y, 0.99) AS p99,
      {_skew('y', 'm')} AS skewness, avg(pow(y - m, 4)) / pow(avg(pow(y - m, 2)), 2) - 3 AS kurtosis_excess,
      avg(pow(y - mw, 3)) FILTER (y > 0.1) / pow(avg(pow(y - mw, 2)) FILTER (y > 0.1), 1.5) AS skewness_wet,
      {_skew('ln(1 + y)', 'ml')} AS log_skewness
    FROM (SELECT series_id, rainfall AS y, avg(rainfall) OVER w AS m,
            avg(CASE WHEN rainfall > 0.1 THEN rainfall END) OVER w AS mw, avg(ln(1 + rainfall)) OVER w AS ml
          FROM dense WINDOW w AS ({PER})) GROUP BY 1""", "dense")
define("yearly", """
  SELECT series_id, year(date) AS year, sum(rainfall) AS total, max(rainfall) AS annual_max
  FROM dense GROUP BY 1, 2""", "dense")
S["e3_annual_stats"] = q(
    "series_id:i annual_mean:f annual_std:f annual_cv_pct:f annual_min:f annual_max:f",
    """SELECT series_id, avg(total) AS annual_mean, stddev_samp(total) AS annual_std,
         stddev_samp(total)/avg(total)*100 AS annual_cv_pct, min(total) AS annual_min, max(total) AS annual_max
       FROM yearly GROUP BY 1""", "yearly")
_E = HISTOGRAM_EDGES
define("edges", "SELECT * FROM (VALUES " + ", ".join(
    f"({i}, CAST('{a}' AS DOUBLE), CAST('{b}' AS DOUBLE))" for i, (a, b) in enumerate(zip(_E, _E[1:]))
) + ") t(bin, left_edge, right_edge)")
S["e4_histogram"] = q(
    "series_id:i bin:i left_edge:f right_edge:f n:i",
    f"""SELECT i.series_id, e.bin, e.left_edge, e.right_edge, count(d.rainfall) AS n
        FROM (SELECT DISTINCT series_id FROM dense) i CROSS JOIN edges e
        LEFT JOIN dense d ON d.series_id = i.series_id AND d.rainfall >= e.left_edge
          AND (d.rainfall < e.right_edge OR (e.bin = {len(_E) - 2} AND d.rainfall = e.right_edge))
        GROUP BY ALL""", "dense", "edges")
S["e4_log_histogram"] = q(
    "series_id:i bin:i left_edge:f count:i expected:f",
    """SELECT s.series_id, b.bin, lo + b.bin*(hi-lo)/60 AS left_edge, coalesce(c.n, 0) AS count,
         s.n*(hi-lo)/60*exp(-0.5*pow((lo + (b.bin+0.5)*(hi-lo)/60 - mu)/sigma, 2))/(sigma*sqrt(2*pi())) AS expected
       FROM (SELECT series_id, count(*) AS n, min(ln(1+rainfall)) AS lo, max(ln(1+rainfall)) AS hi,
               avg(ln(1+rainfall)) AS mu, stddev_samp(ln(1+rainfall)) AS sigma FROM dense GROUP BY 1) s
       CROSS JOIN (SELECT unnest(range(60)) AS bin) b
       LEFT JOIN (SELECT series_id, least(floor((x-lo)/(hi-lo)*60), 59) AS bin, count(*) AS n
                  FROM (SELECT series_id, ln(1+rainfall) AS x, min(ln(1+rainfall)) OVER w AS lo,
                          max(ln(1+rainfall)) OVER w AS hi FROM dense WINDOW w AS (PARTITION BY series_id))
                  GROUP BY 1, 2) c ON c.series_id = s.series_id AND c.bin = b.bin""", "dense", digits=5)
S["e5_wet_density"] = q(
    "series_id:i grid_idx:i x:f density:f exponential:f",
    """SELECT series_id, grid_idx, x, sum(c*exp(-0.5*pow((x-v)/h, 2)))/(max(n)*max(h)*sqrt(2*pi())) AS density,
         max(exp(-x/mean)/mean) AS exponential
       FROM (SELECT s.*, g.grid_idx, top*g.grid_idx/399 AS x, d.v, d.c FROM (
           SELECT series_id, count(*) AS n, avg(rainfall) AS mean, quantile_cont(rainfall, 0.995) AS top,
             stddev_samp(rainfall)*pow(count(*), -0.2) AS h FROM dense WHERE rainfall > 0.1 GROUP BY 1) s
         CROSS JOIN (SELECT unnest(range(400)) AS grid_idx) g
         JOIN (SELECT series_id, rainfall AS v, count(*) AS c FROM dense WHERE rainfall > 0.1 GROUP BY 1, 2) d
           ON d.series_id = s.series_id)
       GROUP BY series_id, grid_idx, x""", "dense")


def _boxes(group: str, name: str) -> str:
    return f"""SELECT d.series_id, d.{name}, max(q1) AS q1, max(median) AS median, max(q3) AS q3,
        min(y) FILTER (y >= q1 - 1.5*(q3-q1)) AS whisker_low, max(y) FILTER (y <= q3 + 1.5*(q3-q1)) AS whisker_high,
        count(*) FILTER (y < q1 - 1.5*(q3-q1) OR y > q3 + 1.5*(q3-q1)) AS n_outliers
      FROM (SELECT series_id, {group} AS {name}, rainfall AS y FROM densecal) d
      JOIN (SELECT series_id, {group} AS {name}, quantile_cont(rainfall, 0.25) AS q1,
              quantile_cont(rainfall, 0.5) AS median, quantile_cont(rainfall, 0.75) AS q3
            FROM densecal GROUP BY 1, 2) b ON b.series_id = d.series_id AND b.{name} = d.{name}
      GROUP BY 1, 2"""


_BOX = " q1:f median:f q3:f whisker_low:f whisker_high:f n_outliers:i"
S["e6_monthly_boxes"] = q("series_id:i month:i" + _BOX, _boxes("month(date)", "month"), "densecal")
S["e6_seasonal_boxes"] = q("series_id:i season:s" + _BOX, _boxes("season", "season"), "densecal")
S["e7_annual_maxima"] = q(
    "series_id:i year:i annual_max:f slope:f trend:f",
    """SELECT y.series_id, y.year, y.annual_max, t.slope, t.b0 + t.slope*y.year AS trend FROM yearly y
       JOIN (SELECT series_id, regr_slope(annual_max, year) AS slope, regr_intercept(annual_max, year) AS b0
             FROM yearly GROUP BY 1) t ON t.series_id = y.series_id""", "yearly", digits=5)
S["e8_exceedance_curve"] = q(
    "series_id:i date:d rainfall:f rank:i probability:f",
    """SELECT series_id, date, rainfall, rank, CAST(rank AS DOUBLE)/(n+1) AS probability FROM (
         SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY rainfall DESC, date) AS rank,
           count(*) OVER (PARTITION BY series_id) AS n FROM dense WHERE rainfall > 0)""", "dense")
S["e8_threshold_shares"] = q(
    "series_id:i " + " ".join(f"{n}:f" for n in SHARES),
    "SELECT series_id, " + ", ".join(
        f"count(*) FILTER (rainfall >= {v}) * CAST(1 AS DOUBLE) / count(*) AS {n}" for n, v in SHARES.items())
    + " FROM dense GROUP BY 1", "dense")
S["e9_top_events"] = q(
    "series_id:i date:d rainfall:f rank:i is_monsoon:i",
    """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY rainfall DESC, date) AS rank
       FROM densecal) WHERE rank <= 20""", "densecal")
S["e9_top_events_overall"] = q(
    "series_id:i date:d rainfall:f is_monsoon:i",
    "SELECT * FROM densecal ORDER BY rainfall DESC, date, series_id LIMIT 20", "densecal")
S["e10_qq_exponential"] = q(
    "series_id:i distribution:s slope:f intercept:f r2:f",
    """SELECT series_id, 'exponential' AS distribution, regr_slope(v, t) AS slope, regr_intercept(v, t) AS intercept,
         regr_r2(v, t) AS r2
       FROM (SELECT series_id, v, -ln(1 - CASE WHEN i = n THEN pow(0.5, CAST(1 AS DOUBLE)/n)
               WHEN i = 1 THEN 1 - pow(0.5, CAST(1 AS DOUBLE)/n) ELSE (i - 0.3175)/(n + 0.365) END) AS t
             FROM (SELECT series_id, rainfall AS v, row_number() OVER (PARTITION BY series_id ORDER BY rainfall, date) AS i,
                     count(*) OVER (PARTITION BY series_id) AS n FROM dense WHERE rainfall > 0.1)) GROUP BY 1""", "dense")
S["f1_monthly_climatology"] = q(
    "series_id:i month:i mean:f std:f total:f p25:f median:f p75:f p95:f",
    """SELECT series_id, month(date) AS month, avg(rainfall) AS mean, stddev_samp(rainfall) AS std,
         sum(rainfall) AS total, quantile_cont(rainfall, 0.25) AS p25, quantile_cont(rainfall, 0.5) AS median,
         quantile_cont(rainfall, 0.75) AS p75, quantile_cont(rainfall, 0.95) AS p95 FROM dense GROUP BY 1, 2""", "dense")
S["f2_monthly_share"] = q(
    "series_id:i month:i total:f p_wet_pct:f share_pct:f",
    """SELECT *, total / sum(total) OVER (PARTITION BY series_id) * 100 AS share_pct FROM (
         SELECT series_id, month(date) AS month, sum(rainfall) AS total,
           count(*) FILTER (rainfall >= 0.1)*100.0/count(*) AS p_wet_pct FROM dense GROUP BY 1, 2)""", "dense")
S["f3_season_share"] = q("series_id:i season:s total:f share_pct:f", " UNION ALL ".join(
    f"""SELECT series_id, '{s}' AS season, coalesce(sum(rainfall) FILTER (season = '{s}'), 0) AS total,
        coalesce(sum(rainfall) FILTER (season = '{s}'), 0)/sum(rainfall)*100 AS share_pct FROM densecal GROUP BY 1"""
    for s in SEASONS), "densecal")
S["f3_yearly_season_share"] = q(
    "series_id:i year:i monsoon_total:f annual_total:f monsoon_pct:f",
    """SELECT series_id, year, coalesce(sum(rainfall) FILTER (is_monsoon = 1), 0) AS monsoon_total,
         sum(rainfall) AS annual_total, CASE WHEN sum(rainfall) <> 0 THEN
         coalesce(sum(rainfall) FILTER (is_monsoon = 1), 0)/sum(rainfall)*100 END AS monsoon_pct
       FROM densecal GROUP BY 1, 2""", "densecal")
S["f4_annual_anomalies"] = q(
    "series_id:i year:i total:f anomaly:f unusual:i",
    """SELECT series_id, year, total, total - m AS anomaly, abs(total - m) > s AS unusual FROM (
         SELECT *, avg(total) OVER (PARTITION BY series_id) AS m, stddev_samp(total) OVER (PARTITION BY series_id) AS s
         FROM yearly)""", "yearly")
define("trend", """SELECT series_id, count(*) AS n_years, regr_slope(total, year) AS slope, regr_intercept(total, year) AS intercept,
         regr_r2(total, year) AS r2, max(year) FILTER (lo = 1) AS driest_year, max(year) FILTER (hi = 1) AS wettest_year
       FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY total, year) AS lo,
               row_number() OVER (PARTITION BY series_id ORDER BY total DESC, year) AS hi FROM yearly)
       GROUP BY 1""", "yearly")
S["f4_annual_trend"] = q("series_id:i n_years:i slope:f intercept:f r2:f driest_year:i wettest_year:i", "SELECT * FROM trend", "trend", digits=4)
# Student's two-sided p for whole degrees of freedom: a finite sum in the angle atan(t / sqrt(dof))
_ODD = "c*list_sum([exp(k*2*ln(c) + k*2*ln(2) + 2*lgamma(k + 1) - lgamma(2*k + 2)) FOR k IN range(0, (dof - 1)//2)])"
_EVEN = "list_sum([exp(k*2*ln(c) + lgamma(2*k + 1) - k*2*ln(2) - 2*lgamma(k + 1)) FOR k IN range(0, dof//2)])"
S["f4_trend_significance"] = q(
    "series_id:i n_years:i slope:f intercept:f r2:f driest_year:i wettest_year:i t_stat:f p_value:f significant:i",
    f"""SELECT *, p_value < 0.05 AS significant FROM (
          SELECT *, 1 - CASE WHEN dof % 2 = 0 THEN sin(a)*{_EVEN} WHEN dof = 1 THEN 2/pi()*a
                             ELSE 2/pi()*(a + sin(a)*{_ODD}) END AS p_value FROM (
            SELECT *, atan(abs(t_stat)/sqrt(dof)) AS a, cos(atan(abs(t_stat)/sqrt(dof))) AS c FROM (
              SELECT *, n_years - 2 AS dof, sign(slope)*sqrt(least(r2, 1 - 1e-15)*(n_years - 2)/(1 - least(r2, 1 - 1e-15))) AS t_stat
              FROM trend)))""", "trend", digits=4)

define("mann_kendall", """
    SELECT *, CASE WHEN abs(z) <= 1.959963984540054 THEN 'no trend' WHEN z > 0 THEN 'increasing'
         ELSE 'decreasing' END AS verdict FROM (
       SELECT *, CASE WHEN var_s <= 0 THEN 0 ELSE (s - sign(s))/sqrt(var_s) END AS z FROM (
         SELECT p.series_id, p.n, p.s, (p.n*(p.n-1)*(2*p.n+5) - t.ties)/CAST(18 AS DOUBLE) AS var_s FROM (
           SELECT a.series_id, count(DISTINCT a.year) AS n,
             coalesce(sum(sign(b.total - a.total)) FILTER (b.year > a.year), 0) AS s
           FROM yearly a JOIN yearly b ON a.series_id = b.series_id GROUP BY 1) p
         JOIN (SELECT series_id, sum(k*(k-1)*(2*k+5)) AS ties FROM (
                 SELECT series_id, total, count(*) AS k FROM yearly GROUP BY 1, 2) GROUP BY 1) t
           ON t.series_id = p.series_id))""", "yearly")
S["f5_mann_kendall"] = q("series_id:i n:i s:i var_s:f z:f verdict:s", "SELECT * FROM mann_kendall", "mann_kendall")
# 1 - erf(x) with x = |z| / sqrt(2), by the series of positive terms
_TERMS = "[exp(k*ln(2) + (2*k + 1)*ln(x) - (lgamma(2*k + 2) - k*ln(2) - lgamma(k + 1))) FOR k IN range(200)]"
S["f5_mann_kendall_significance"] = q(
    "series_id:i n:i s:i var_s:f z:f verdict:s p_value:f",
    f"""SELECT *, CASE WHEN x < 1e-12 THEN 1 ELSE 1 - 2/sqrt(pi())*exp(-x*x)*list_sum({_TERMS}) END AS p_value
        FROM (SELECT *, abs(z)/sqrt(2) AS x FROM mann_kendall)""", "mann_kendall")
define("runs", """
  SELECT series_id, min(date) AS start_date, max(date) AS end_date, count(*) AS n_days FROM (
    SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY date)
      - row_number() OVER (PARTITION BY series_id, rainfall < 0.1 ORDER BY date) AS island FROM dense)
  WHERE rainfall < 0.1 GROUP BY series_id, island""", "dense")
S["f6_dry_spells"] = q("series_id:i start_date:d end_date:d n_days:i", "SELECT * FROM runs WHERE n_days >= 3", "runs")
S["f6_dry_spell_stats"] = q(
    "series_id:i n_spells:i max_days:i mean_days:f n_long:i",
    """SELECT series_id, count(*) AS n_spells, max(n_days) AS max_days, avg(n_days) AS mean_days,
         count(*) FILTER (n_days > 30) AS n_long FROM runs WHERE n_days >= 3 GROUP BY 1""", "runs")
S["f7_spell_start_months"] = q(
    "series_id:i month:i n_starts:i",
    """SELECT i.series_id, m.month, count(r.n_days) AS n_starts FROM (SELECT DISTINCT series_id FROM dense) i
       CROSS JOIN (SELECT unnest(range(1, 13)) AS month) m
       LEFT JOIN runs r ON r.series_id = i.series_id AND month(r.start_date) = m.month GROUP BY 1, 2""", "dense", "runs")
S["f8_spell_length_ecdf"] = q(
    "series_id:i n_days:i n:i ecdf:f",
    """SELECT DISTINCT series_id, n_days, count(*) OVER (PARTITION BY series_id, n_days) AS n,
         cume_dist() OVER (PARTITION BY series_id ORDER BY n_days) AS ecdf FROM runs WHERE n_days >= 3""", "runs")
S["f8_spell_length_quantiles"] = q(
    "series_id:i median:f p90:f",
    """SELECT series_id, quantile_cont(n_days, 0.5) AS median, quantile_cont(n_days, 0.9) AS p90
       FROM runs WHERE n_days >= 3 GROUP BY 1""", "runs")
S["f9_day_of_year_climatology"] = q(
    "series_id:i doy:i mean:f smooth:f",
    """SELECT *, CASE WHEN count(mean) OVER f >= 5 THEN avg(mean) OVER f END AS smooth FROM (
         SELECT series_id, dayofyear(date) AS doy, avg(rainfall) AS mean FROM dense GROUP BY 1, 2)
       WINDOW f AS (PARTITION BY series_id ORDER BY doy ROWS BETWEEN 7 PRECEDING AND 6 FOLLOWING)""", "dense")
S["f10_year_day_matrix"] = q(
    "series_id:i year:i " + " ".join(f"d{i}:f" for i in range(1, 366)),
    "SELECT series_id, year, " + ", ".join(
        f"max(ln(1 + rainfall)) FILTER (day_of_year = {i}) AS d{i}" for i in range(1, 366))
    + " FROM densecal GROUP BY 1, 2", "densecal")
S["f10_colour_cap"] = q(
    "series_id:i cap:f",
    "SELECT series_id, quantile_cont(ln(1 + rainfall), 0.99) AS cap FROM densecal WHERE day_of_year <= 365 GROUP BY 1",
    "densecal")
S["f11_filtered_profile"] = q(
    "series_id:i n_days:i mean:f max:f pct_dry:f annual_mean:f",
    f"""SELECT series_id, sum(n) AS n_days, sum(total)/sum(n) AS mean, max(mx) AS max, sum(dry)*100.0/sum(n) AS pct_dry,
          avg(total) AS annual_mean FROM (
          SELECT series_id, year(date) AS year, count(*) AS n, sum(rainfall) AS total, max(rainfall) AS mx,
            count(*) FILTER (rainfall < 0.1) AS dry FROM dense
          WHERE date BETWEEN DATE '{RANGE[0]}' AND DATE '{RANGE[1]}' GROUP BY 1, 2) GROUP BY 1""", "dense")
S["f12_column_histogram"] = q(
    "season:s bin:i n:i left_edge:f",
    """SELECT season, bin, count(*) AS n, max(lo + (hi-lo)/50*bin) AS left_edge FROM (
         SELECT CASE WHEN is_monsoon = 1 THEN 'Monsoon' ELSE 'Non-Monsoon' END AS season, lo, hi,
           least(floor((wind-lo)/(hi-lo)*50), 49) AS bin
         FROM panelcal CROSS JOIN (SELECT min(wind) AS lo, max(wind) AS hi FROM panel) WHERE wind IS NOT NULL)
       GROUP BY 1, 2""", "panelcal")
define("monthly", """
  SELECT series_id, last_day(date) AS month_end, sum(rainfall) AS total FROM dense GROUP BY 1, 2""", "dense")
S["f13_monthly_totals"] = q("series_id:i month_end:d total:f", "SELECT * FROM monthly", "monthly")
S["f14_monthly_rolling"] = q(
    "series_id:i month_end:d total:f roll_mean:f roll_std:f diff:f",
    """SELECT *, CASE WHEN count(*) OVER f = 12 THEN avg(total) OVER f END AS roll_mean,
         CASE WHEN count(*) OVER f = 12 THEN stddev_samp(total) OVER f END AS roll_std,
         total - lag(total) OVER (PARTITION BY series_id ORDER BY month_end) AS diff FROM monthly
       WINDOW f AS (PARTITION BY series_id ORDER BY month_end ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)""",
    "monthly", digits=5)
S["f15_deseasonalised"] = q(
    "series_id:i date:d anomaly:f smooth:f",
    """SELECT series_id, date, anomaly, CASE WHEN count(anomaly) OVER f >= 15 THEN avg(anomaly) OVER f END AS smooth
       FROM (SELECT *, rainfall - avg(rainfall) OVER (PARTITION BY series_id, month(date)) AS anomaly FROM dense)
       WINDOW f AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN 15 PRECEDING AND 14 FOLLOWING)""", "dense", digits=5)
