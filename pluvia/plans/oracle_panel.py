"""Expected results: sources, validation, calendar, features."""

from __future__ import annotations

from pluvia.operators.features import LEAKAGE, NEVER_SCALED, SHOWN
from pluvia.plans.sqlkit import define, q
from pluvia.spec import COVARIATE_LAGS, COVARIATE_ROLLS, COVARIATES, TARGET_LAGS, TARGET_ROLLS

S: dict[str, str] = {}

BOUNDS = {"rainfall": (0, 45), "rh": (0, 70), "cloud": (10, 100)}

# --- sources
S["a1_read_csv"] = q("series_id:i date:d rainfall:f", "SELECT * FROM sparse", "sparse")
S["a2_read_parquet"] = q("series_id:i date:d rainfall:f", "SELECT * FROM sparse", "sparse")
S["a3_write_parquet_by_split"] = q(
    "split:s n_rows:i total:f",
    "SELECT split, count(*) AS n_rows, sum(rainfall) AS total FROM splitdense GROUP BY 1", "splitdense")
S["a7_dataset_kpis"] = q(
    "series_id:i n_records:i date_start:d date_end:d n_years:i n_features:i pct_dry:f max_rainfall:f "
    "annual_mean:f monsoon_pct:f",
    """SELECT series_id, sum(n) AS n_records, min(a) AS date_start, max(b) AS date_end,
         count(*) AS n_years, 10 AS n_features, sum(dry)*100.0/sum(n) AS pct_dry,
         max(mx) AS max_rainfall, avg(total) AS annual_mean, sum(mon)/sum(total)*100 AS monsoon_pct
       FROM (SELECT series_id, year, count(*) AS n, min(date) AS a, max(date) AS b,
               sum(CASE WHEN rainfall < 0.1 THEN 1 ELSE 0 END) AS dry, max(rainfall) AS mx,
               sum(rainfall) AS total, sum(CASE WHEN is_monsoon = 1 THEN rainfall ELSE 0 END) AS mon
             FROM densecal GROUP BY 1, 2) GROUP BY 1""", "densecal")

# --- validation
S["b1_unparseable_dates"] = q(
    "series_id:i n_records:i n_unparseable:i passed:i",
    """SELECT series_id, count(*) AS n_records, count(*) FILTER (date IS NULL) AS n_unparseable,
         (count(*) FILTER (date IS NULL) = 0) AS passed FROM parsed GROUP BY 1""", "parsed")
S["b2_duplicate_dates"] = q(
    "series_id:i n_duplicates:i passed:i",
    """SELECT series_id, sum(n_records - 1) AS n_duplicates, sum(n_records - 1) = 0 AS passed
       FROM firsts GROUP BY 1""", "firsts")
S["b2_keep_first"] = q(
    "series_id:i date:d l_orderkey:i l_linenumber:i rainfall:s rh:f cloud:f n_records:i",
    "SELECT * FROM firsts", "firsts")
S["b3_temporal_gaps"] = q(
    "series_id:i gap_start:d gap_end:d n_days:i",
    """SELECT series_id, date + 1 AS gap_start, nxt - 1 AS gap_end, nxt - date - 1 AS n_days
       FROM (SELECT *, lead(date) OVER (PARTITION BY series_id ORDER BY date) AS nxt FROM sparse)
       WHERE nxt - date > 1""", "sparse")
S["b4_missing_values"] = q(
    "column_name:s n_missing:i",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS n_missing FROM firsts"
        for c in ("rainfall", "rh", "cloud")), "firsts")
S["b5_numeric_coercion"] = q(
    "series_id:i date:d rainfall:f rh:f cloud:f",
    "SELECT series_id, date, TRY_CAST(rainfall AS DOUBLE) AS rainfall, rh, cloud FROM firsts", "firsts")
S["b5_dtype_report"] = q(
    "column_name:s n_lost:i source_type:s",
    """SELECT 'rainfall' AS column_name, 'string' AS source_type,
         count(*) FILTER (rainfall IS NOT NULL AND TRY_CAST(rainfall AS DOUBLE) IS NULL) AS n_lost
       FROM firsts""", "firsts")
S["b6_bound_violations"] = q(
    "column_name:s n_violations:i lower_bound:f upper_bound:f",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, {lo} AS lower_bound, {hi} AS upper_bound,
            count(*) FILTER (TRY_CAST({c} AS DOUBLE) < {lo} OR TRY_CAST({c} AS DOUBLE) > {hi}) AS n_violations
            FROM firsts""" for c, (lo, hi) in BOUNDS.items()), "firsts")
S["b7_validation_report"] = q(
    "check_name:s item:s n_found:i passed:i",
    """SELECT 'unparseable_dates' AS check_name, 'date' AS item, count(*) FILTER (date IS NULL) AS n_found,
         count(*) FILTER (date IS NULL) = 0 AS passed FROM parsed
       UNION ALL SELECT 'duplicate_dates', 'date', sum(n_records-1), sum(n_records-1) = 0 FROM firsts
       UNION ALL SELECT 'missing_days', 'date', sum(nxt - date - 1), true
         FROM (SELECT date, lead(date) OVER (PARTITION BY series_id ORDER BY date) AS nxt FROM firsts)
       UNION ALL SELECT 'rows_kept', '*', count(*), true FROM firsts
       UNION ALL SELECT 'not_numeric', 'rainfall',
         count(*) FILTER (rainfall IS NOT NULL AND TRY_CAST(rainfall AS DOUBLE) IS NULL), true FROM firsts"""
    + "".join(f" UNION ALL SELECT 'missing_values', '{c}', count(*) FILTER ({c} IS NULL), true FROM firsts"
              for c in ("rainfall", "rh", "cloud"))
    + "".join(f""" UNION ALL SELECT 'bound_violations', '{c}', count(*) FILTER
              (TRY_CAST({c} AS DOUBLE) < {lo} OR TRY_CAST({c} AS DOUBLE) > {hi}), true FROM firsts"""
              for c, (lo, hi) in BOUNDS.items()), "parsed", "firsts")
define("steps", """
  SELECT *, lag(date) OVER w AS prev, lag(rainfall, 30) OVER w AS l30 FROM splitdense
  WINDOW w AS (PARTITION BY series_id ORDER BY date)""", "splitdense")
S["b8_invariants"] = q(
    "check_name:s n_violations:i",
    """SELECT 'dates_not_increasing' AS check_name, count(*) FILTER (date <= prev) AS n_violations FROM steps
       UNION ALL SELECT 'calendar_gaps', count(*) FILTER (date - prev > 1) FROM steps
       UNION ALL SELECT 'warmup_rows_left', count(*) FILTER (l30 IS NULL) FROM steps
       UNION ALL SELECT 'splits_overlapping', count(*) FILTER (a >= b OR c >= d) FROM (
         SELECT series_id, max(date) FILTER (split='train') AS a, min(date) FILTER (split='val') AS b,
           max(date) FILTER (split='val') AS c, min(date) FILTER (split='test') AS d
         FROM steps GROUP BY 1)""", "steps")

# --- calendar and split
S["c1_calendar_columns"] = q(
    "series_id:i date:d year:i month:i day_of_year:i day_of_week:i season:s is_monsoon:i",
    "SELECT * FROM densecal", "densecal")
S["c2_chronological_split"] = q("series_id:i date:d split:s", "SELECT * FROM splitdense", "splitdense")
S["c3_densify"] = q("series_id:i date:d rainfall:f", "SELECT * FROM dense", "dense")
S["c3_densify_events"] = q("series_id:s date:d rainfall:f", "SELECT * FROM denseevents", "denseevents")
define("warm", """
  SELECT * EXCLUDE (l30) FROM (SELECT *, lag(rainfall, 30) OVER (PARTITION BY series_id ORDER BY date) AS l30
  FROM splitdense) WHERE l30 IS NOT NULL""", "splitdense")
S["c4_reapply_split"] = q(
    "series_id:i date:d split:s",
    """SELECT w.series_id, w.date, b.split FROM warm w
       JOIN (SELECT series_id, split, min(date) AS a, max(date) AS z FROM splitdense GROUP BY 1, 2) b
       ON b.series_id = w.series_id AND w.date BETWEEN b.a AND b.z""", "warm", "splitdense")
S["c5_split_summary"] = q(
    "split:s n_rows:i date_from:d date_to:d fraction_pct:f",
    """SELECT split, count(*) AS n_rows, min(date) AS date_from, max(date) AS date_to,
         count(*)*100.0/sum(count(*)) OVER () AS fraction_pct FROM splitdense GROUP BY 1""", "splitdense")
S["c6_column_summary"] = q(
    "column_name:s min:f max:f mean:f std:f missing:f",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, min({c}) AS min, max({c}) AS max, avg({c}) AS mean,
            stddev_samp({c}) AS std, count(*) FILTER ({c} IS NULL) AS missing FROM panel"""
        for c in ("rainfall", *COVARIATES)), "panel")

# --- features
_LAGS = {f"{c}_lag{n}": f"lag({c}, {n}) OVER w"
         for c, lags in {"rainfall": TARGET_LAGS, **COVARIATE_LAGS}.items() for n in lags}


def _roll(c: str, n: int, fn: str) -> str:
    frame = f"(PARTITION BY series_id ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({c}) OVER {frame} = {n} THEN {fn}({c}) OVER {frame} END"


_ROLLS = {}
for _n in TARGET_ROLLS:
    _ROLLS[f"rainfall_roll_mean_{_n}"] = _roll("rainfall", _n, "avg")
    _ROLLS[f"rainfall_roll_std_{_n}"] = _roll("rainfall", _n, "stddev_samp")
for _c, _ws in COVARIATE_ROLLS.items():
    for _n in _ws:
        _ROLLS[f"{_c}_roll_mean_{_n}"] = _roll(_c, _n, "avg")
_W = "WINDOW w AS (PARTITION BY series_id ORDER BY date)"
_CALENDAR = {
    "quarter": "quarter(date)", "week_of_year": "weekofyear(date)",
    "is_weekend": "CASE WHEN isodow(date) >= 6 THEN 1 ELSE 0 END",
    "year_frac": "dayofyear(date) / CAST(365.25 AS DOUBLE)",
}
_CYCLICAL = {
    "month_sin": "sin(2*pi()*month(date)/12)", "month_cos": "cos(2*pi()*month(date)/12)",
    "doy_sin": "sin(2*pi()*dayofyear(date)/365.25)", "doy_cos": "cos(2*pi()*dayofyear(date)/365.25)",
}
_SEASON = {"season_code": "CASE season WHEN 'Winter' THEN 0 WHEN 'Pre-Monsoon' THEN 1 "
                          "WHEN 'Post-Monsoon' THEN 2 WHEN 'Monsoon' THEN 3 ELSE 0 END"}
_DISTANCE = {"days_from_monsoon_onset": "dayofyear(date) - 152",
             "days_from_monsoon_withdrawal": "dayofyear(date) - 273"}
_PHYSICAL = {
    "soil_moisture_gradient": "soil_wet_surf - soil_wet_root",
    "dewpoint_approx": "tmin - (100 - rh)/5", "temp_range": "tmax - tmin",
    "pressure_rh_interaction": "pressure * (rh / 100)",
}
_OCCURRENCE = {"rain_occurrence": "CASE WHEN rainfall > 0.1 THEN 1 ELSE 0 END"}
_TARGETS = {"monsoon_flag": "is_monsoon", "log_rainfall": "ln(1 + rainfall)",
            "rainfall_wet_only": "CASE WHEN rainfall > 0.1 THEN rainfall END"}


def _cols(d: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {n}" for n, e in d.items())


def _types(d, kind="f") -> str:
    return " ".join(f"{n}:{kind}" for n in d)


KEY = "series_id:i date:d "
S["d1_lag_features"] = q(KEY + _types(_LAGS), f"SELECT series_id, date, {_cols(_LAGS)} FROM panel {_W}", "panel")
S["d2_rolling_features"] = q(KEY + _types(_ROLLS),
                             f"SELECT series_id, date, {_cols(_ROLLS)} FROM panel", "panel", digits=5)


def _centre(n: int, fn: str) -> str:
    f = f"(PARTITION BY series_id ORDER BY date ROWS BETWEEN {n // 2} PRECEDING AND {(n - 1) // 2} FOLLOWING)"
    return f"CASE WHEN count(rainfall) OVER {f} >= {n // 2} THEN {fn}(rainfall) OVER {f} END"


_CENTRED = {f"rainfall_centred_mean_{n}": _centre(n, "avg") for n in (7, 30, 90)}
_CENTRED["rainfall_centred_std_30"] = _centre(30, "stddev_samp")
S["d3_centred_smoothing"] = q(KEY + _types(_CENTRED),
                              f"SELECT series_id, date, {_cols(_CENTRED)} FROM dense", "dense", digits=5)
S["d4_calendar_features"] = q(KEY + "quarter:i week_of_year:i is_weekend:i year_frac:f",
                              f"SELECT series_id, date, {_cols(_CALENDAR)} FROM dense", "dense")
S["d5_cyclical_encodings"] = q(KEY + _types(_CYCLICAL),
                               f"SELECT series_id, date, {_cols(_CYCLICAL)} FROM dense", "dense")
S["d6_season_code"] = q(KEY + "season_code:i", f"SELECT series_id, date, {_cols(_SEASON)} FROM densecal", "densecal")
S["d7_monsoon_distance"] = q(KEY + _types(_DISTANCE, "i"),
                             f"SELECT series_id, date, {_cols(_DISTANCE)} FROM dense", "dense")
S["d8_physical_features"] = q(KEY + _types(_PHYSICAL),
                              f"SELECT series_id, date, {_cols(_PHYSICAL)} FROM panel", "panel")
S["d9_rain_occurrence"] = q(KEY + "rain_occurrence:i",
                            f"SELECT series_id, date, {_cols(_OCCURRENCE)} FROM dense", "dense")
define("spells", """
  SELECT *, sum(dry) OVER (PARTITION BY series_id, island ORDER BY date) AS dry_spell_length FROM (
    SELECT *, CASE WHEN rainfall < 0.1 THEN 1 ELSE 0 END AS dry,
      sum(CASE WHEN rainfall < 0.1 THEN 0 ELSE 1 END) OVER (PARTITION BY series_id ORDER BY date) AS island
    FROM dense)""", "dense")
S["d10_dry_spell_length"] = q(
    KEY + "dry_spell_length:i causal_length:i",
    f"SELECT series_id, date, dry_spell_length, coalesce(lag(dry_spell_length) OVER w, 0) AS causal_length FROM spells {_W}",
    "spells")
S["d11_target_transforms"] = q(KEY + "monsoon_flag:i log_rainfall:f rainfall_wet_only:f",
                               f"SELECT series_id, date, {_cols(_TARGETS)} FROM densecal", "densecal")
define("features_all", f"""
  SELECT p.*, s.dry_spell_length FROM (
    SELECT *, {_cols(_LAGS)}, {_cols(_ROLLS)}, {_cols(_CALENDAR)}, {_cols(_CYCLICAL)}, {_cols(_SEASON)},
      {_cols(_DISTANCE)}, {_cols(_PHYSICAL)}, {_cols(_OCCURRENCE)}, {_cols(_TARGETS)}
    FROM splitpanel {_W}) p JOIN spells s ON s.series_id = p.series_id AND s.date = p.date""",
       "splitpanel", "spells")
define("features", "SELECT * FROM features_all WHERE "
       + " AND ".join(f"{c} IS NOT NULL" for c in [*_LAGS, *_ROLLS]), "features_all")
S["d12_warmup_drop"] = q("series_id:i n_rows:i first_date:d last_date:d",
                         "SELECT series_id, count(*) AS n_rows, min(date) AS first_date, max(date) AS last_date "
                         "FROM features GROUP BY 1", "features")
FEATURES = [*COVARIATES, *_LAGS, *_ROLLS, *_CALENDAR, *_CYCLICAL, *_SEASON, *_DISTANCE, *_PHYSICAL,
            *_OCCURRENCE, "dry_spell_length", *_TARGETS]
_INT = {"quarter", "week_of_year", "is_weekend", "season_code", "days_from_monsoon_onset",
        "days_from_monsoon_withdrawal", "rain_occurrence", "dry_spell_length", "monsoon_flag"}
S["d13_feature_table"] = q(
    KEY + "split:s rainfall:f " + " ".join(f"{c}:{'i' if c in _INT else 'f'}" for c in FEATURES),
    "SELECT * FROM features", "features", digits=4)
# every column of the table but targets, flags and calendar numbers
SCALED = tuple(c for c in FEATURES if c not in NEVER_SCALED)
define("scaler", " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, avg({c}) AS mean,
        CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END AS std
        FROM features WHERE split = 'train'""" for c in SCALED), "features")
S["d14_scaler_parameters"] = q("feature:s mean:f std:f", "SELECT * FROM scaler", "scaler")
S["a5_scaler_json"] = S["d14_scaler_parameters"]
# every scaled column's parameters in one row, from one scan
define("scaler_row", "SELECT " + ", ".join(
    f"avg({c}) AS {c}_m, CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END AS {c}_s" for c in SCALED)
    + " FROM features WHERE split = 'train'", "features")
S["d14_standardised"] = q(
    KEY + "split:s " + _types(SCALED),
    "SELECT f.series_id, f.date, f.split, " + ", ".join(f"(f.{c} - s.{c}_m) / s.{c}_s AS {c}" for c in SCALED)
    + " FROM features f CROSS JOIN scaler_row s", "features", "scaler_row", digits=4)
S["d15_model_input_sets"] = q(
    "split:s n_rows:i n_columns:i sum_target:f sum_log_target:f n_wet:i sum_scaled:f",
    f"""SELECT split, count(*) AS n_rows, {len([c for c in FEATURES if c not in LEAKAGE]) + 6} AS n_columns, sum(rainfall) AS sum_target,
         sum(log_rainfall) AS sum_log_target, sum(rain_occurrence) AS n_wet,
         sum(abs((rainfall_lag1 - m) / s)) AS sum_scaled
       FROM features CROSS JOIN (SELECT mean AS m, std AS s FROM scaler WHERE feature = 'rainfall_lag1')
       GROUP BY 1""", "features", "scaler", digits=3)


def _category(c: str) -> str:
    if "_lag" in c:
        return "Lag"
    if "_roll_" in c:
        return "Rolling"
    if c in _CYCLICAL:
        return "Cyclical"
    if c in _CALENDAR or c in _SEASON or c in _DISTANCE:
        return "Temporal"
    return "Original Meteorological" if c in COVARIATES else "Domain"


S["d16_feature_catalogue"] = q(
    "category:s n_features:i n_values:i",
    "SELECT category, count(*) AS n_features, sum(n) AS n_values FROM (" + " UNION ALL ".join(
        f"SELECT '{_category(c)}' AS category, count({c}) AS n FROM features" for c in FEATURES)
    + ") GROUP BY 1", "features")
S["d17_feature_statistics"] = q(
    "feature:s category:s non_null:i mean:f std:f min:f max:f",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, '{_category(c)}' AS category, count({c}) AS non_null, avg({c}) AS mean,
            stddev_samp({c}) AS std, min({c}) AS min, max({c}) AS max FROM features""" for c in FEATURES),
    "features", digits=5)
S["d19_sliding_windows"] = q(
    KEY + "split:s window_text:s y:f weight:f",
    """SELECT * FROM (
         SELECT series_id, date, split, rainfall AS y, CASE WHEN rainfall > 20 THEN 5 ELSE 1 END AS weight,
           count(*) OVER f AS n, string_agg(CAST(CAST(rainfall AS BIGINT) AS VARCHAR) || ':' || is_monsoon, ',') OVER f AS window_text
         FROM splitdense
         WINDOW f AS (PARTITION BY series_id, split ORDER BY date ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING))
       WHERE n = 30""", "splitdense")
S["d20_sample_weights"] = q(KEY + "weight:f",
                            "SELECT series_id, date, CASE WHEN rainfall > 20 THEN 5 ELSE 1 END AS weight FROM dense", "dense")
S["d21_histogram_by_season"] = q(
    "feature:s monsoon:i bin:i left_edge:f n:i density:f",
    """SELECT feature, monsoon, bin, count(*) AS n, max(lo + (hi-lo)/nb*bin) AS left_edge,
         count(*) / sum(count(*)) OVER (PARTITION BY feature, monsoon) / max((hi-lo)/nb) AS density
       FROM (SELECT *, least(CAST(floor((greatest(lo, least(hi, x)) - lo)/(hi-lo)*nb) AS INT), nb-1) AS bin FROM ("""
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS x, monsoon_flag = 1 AS monsoon, lo, hi, nb FROM features CROSS JOIN (
          SELECT quantile_cont(CAST({c} AS DOUBLE), 0.01) AS lo, quantile_cont(CAST({c} AS DOUBLE), 0.99) AS hi,
            CAST(least(50, greatest(20, floor(count({c}) / 100))) AS INT) AS nb FROM features) WHERE {c} IS NOT NULL""" for c in SHOWN)
    + ")) GROUP BY feature, monsoon, bin", "features")
S["d22_counter_calibration"] = q(
    "bin_left:i p_rain:f n:i p_low:f p_high:f",
    """SELECT *, p_rain - 1.96*sqrt(p_rain*(1-p_rain)/n) AS p_low, p_rain + 1.96*sqrt(p_rain*(1-p_rain)/n) AS p_high
       FROM (SELECT least(CAST(floor(dry_spell_length/2) AS INT)*2, 30) AS bin_left, avg(rain_occurrence) AS p_rain,
               count(*) AS n FROM features GROUP BY 1)""", "features")
