"""Builds the ANSI SQL that states what each registered query must return."""

from __future__ import annotations

import re

# Shared derivations, each with the ones it builds on.
CTES: dict[str, tuple[tuple[str, ...], str]] = {}
HELD = {"features", "wettrain", "wettest", "params", "phis", "closeness", "close_pairs"}


def define(name: str, sql: str, *needs: str) -> None:
    CTES[name] = (needs, sql)


def _collect(names: tuple[str, ...], seen: dict[str, str]) -> None:
    for name in names:
        if name not in seen:
            needs, sql = CTES[name]
            _collect(needs, seen)
            seen[name] = sql


def q(columns: str, body: str, *needs: str, digits: int = 6) -> str:
    """``columns`` is 'name:type ...' with i integer, f double, d date, s text."""
    seen: dict[str, str] = {}
    _collect(needs, seen)
    parts = []
    for item in columns.split():
        name, kind = item.split(":")
        parts.append({
            "i": f"CAST({name} AS BIGINT) AS {name}",
            "f": f"round(CAST({name} AS DOUBLE), {digits}) + 0.0 AS {name}",
            "d": f"CAST({name} AS VARCHAR) AS {name}",
            "s": f"CAST({name} AS VARCHAR) AS {name}",
        }[kind])
    # tables that several parts of a query read are computed once
    ctes = ",\n".join(f"{n} AS {'MATERIALIZED ' if n in HELD else ''}({s})" for n, s in seen.items())
    recursive = any(re.search(rf"\b{n}\b", s) for n, s in seen.items())
    prefix = f"WITH {'RECURSIVE ' if recursive else ''}{ctes}\n" if ctes else ""
    return f"{prefix}SELECT {', '.join(parts)}\nFROM ({body}) AS result"


define("sparse", """
  SELECT l_suppkey AS series_id, CAST(l_shipdate AS DATE) AS date, SUM(l_quantity) AS rainfall
  FROM lineitem GROUP BY 1, 2""")
define("cal", """
  SELECT CAST(unnest(generate_series(MIN(CAST(l_shipdate AS DATE)), MAX(CAST(l_shipdate AS DATE)),
         INTERVAL 1 DAY)) AS DATE) AS date FROM lineitem""")
define("dense", """
  SELECT i.series_id, c.date, COALESCE(s.rainfall, CAST(0 AS DOUBLE)) AS rainfall
  FROM (SELECT DISTINCT l_suppkey AS series_id FROM lineitem) i CROSS JOIN cal c
  LEFT JOIN sparse s ON s.series_id = i.series_id AND s.date = c.date""", "sparse", "cal")
define("eventdays", """
  SELECT event_type AS series_id, CAST(ts AS DATE) AS date, sum(value) AS rainfall FROM events GROUP BY 1, 2""")
define("denseevents", """
  SELECT c.series_id, c.date, coalesce(e.rainfall, CAST(0 AS DOUBLE)) AS rainfall FROM (
    SELECT series_id, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM eventdays GROUP BY 1) c
  LEFT JOIN eventdays e ON e.series_id = c.series_id AND e.date = c.date""", "eventdays")
define("cov", """
  SELECT CAST(l_shipdate AS DATE) AS date,
    MAX(l_quantity) AS tmax, MIN(l_quantity) AS tmin, AVG(l_quantity) AS tavg,
    1000*AVG(l_discount) AS rh, 500*AVG(l_tax) AS wind,
    95+AVG(l_extendedprice)/11000 AS pressure,
    100*AVG(CASE WHEN l_returnflag='R' THEN CAST(1 AS DOUBLE) ELSE 0 END) AS cloud,
    40*AVG(CASE WHEN l_linestatus='F' THEN CAST(1 AS DOUBLE) ELSE 0 END) AS solar_rad,
    AVG(CASE WHEN l_quantity>25 THEN CAST(1 AS DOUBLE) ELSE 0 END) AS soil_wet_surf,
    AVG(CASE WHEN l_quantity>20 THEN CAST(1 AS DOUBLE) ELSE 0 END) AS soil_wet_root
  FROM lineitem GROUP BY 1""")
define("panel", """
  SELECT d.*, c.tmax, c.tmin, c.tavg, c.rh, c.wind, c.pressure, c.cloud, c.solar_rad,
         c.soil_wet_surf, c.soil_wet_root
  FROM dense d LEFT JOIN cov c ON c.date = d.date""", "dense", "cov")


def calendar_of(source: str) -> str:
    return f"""
  SELECT *, year(date) AS year, month(date) AS month, dayofyear(date) AS day_of_year,
    isodow(date) - 1 AS day_of_week,
    CASE WHEN month(date) IN (6,7,8,9) THEN 'Monsoon' WHEN month(date) IN (3,4,5) THEN 'Pre-Monsoon'
         WHEN month(date) IN (10,11) THEN 'Post-Monsoon' WHEN month(date) IN (12,1,2) THEN 'Winter'
         ELSE 'Unknown' END AS season,
    CASE WHEN month(date) IN (6,7,8,9) THEN 1 ELSE 0 END AS is_monsoon
  FROM {source}"""


def split_of(source: str) -> str:
    return f"""
  SELECT * EXCLUDE (rk, n),
    CASE WHEN rk <= floor(n*CAST(0.7 AS DOUBLE)) THEN 'train'
         WHEN rk <= floor(n*CAST(0.7 AS DOUBLE)) + floor(n*CAST(0.15 AS DOUBLE)) THEN 'val'
         ELSE 'test' END AS split
  FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY date) AS rk,
               count(*) OVER (PARTITION BY series_id) AS n FROM {source})"""


define("densecal", calendar_of("dense"), "dense")
define("panelcal", calendar_of("panel"), "panel")
define("splitdense", split_of("densecal"), "densecal")
define("splitpanel", split_of("panelcal"), "panelcal")
define("raw", """
  SELECT l_suppkey AS series_id,
    CASE WHEN l_linenumber = 7 THEN 'unknown' WHEN l_linenumber = 6 THEN '1999-02-30'
         ELSE CAST(CAST(l_shipdate AS DATE) AS VARCHAR) END AS date_text,
    CASE WHEN l_linenumber = 5 THEN 'n/a' ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END AS rainfall,
    CASE WHEN l_linenumber <> 3 THEN l_tax * 1000 END AS rh,
    CASE WHEN l_linenumber <> 2 THEN l_discount * 1000 END AS cloud,
    l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice
  FROM lineitem""")
define("parsed", "SELECT *, TRY_CAST(date_text AS DATE) AS date FROM raw", "raw")
define("firsts", """
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY series_id, date
        ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS rn,
      count(*) OVER (PARTITION BY series_id, date) AS n_records
    FROM parsed WHERE date IS NOT NULL) WHERE rn = 1""", "parsed")
