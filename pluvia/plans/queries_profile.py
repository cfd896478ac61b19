"""Registered queries: distribution and seasonal profile of the dense panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from pluvia.operators import distribution as di
from pluvia.operators import seasonal as se
from pluvia.plans.settle import settle
from pluvia.sources import panel as pn

RANGE = ("1997-03-01", "1999-10-31")
SHARES = {"p_heavy": 64.5, "p_very_heavy": 115.6}

# name -> (operator on the dense panel, digits)
_ON_DENSE = {
    "e1_category_counts": (di.category_counts, 6),
    "e2_distribution_stats": (di.distribution_stats, 6),
    "e3_annual_stats": (di.annual_stats, 6),
    "e4_histogram": (di.histogram, 6),
    "e4_log_histogram": (di.log_histogram, 5),
    "e5_wet_density": (di.wet_density, 6),
    "e6_monthly_boxes": (di.monthly_boxes, 6),
    "e6_seasonal_boxes": (di.seasonal_boxes, 6),
    "e7_annual_maxima": (di.annual_maxima, 5),
    "e8_exceedance_curve": (di.exceedance_curve, 6),
    "e8_threshold_shares": (lambda df: di.threshold_shares(df, SHARES), 6),
    "e9_top_events": (di.top_events, 6),
    "e9_top_events_overall": (di.top_events_overall, 6),
    "e10_qq_exponential": (di.qq_exponential, 6),
    "e10_qq_fits": (di.qq_fits, 6),
    "f1_monthly_climatology": (se.monthly_climatology, 6),
    "f2_monthly_share": (se.monthly_share, 6),
    "f3_season_share": (se.season_share, 6),
    "f3_yearly_season_share": (se.yearly_season_share, 6),
    "f4_annual_anomalies": (se.annual_anomalies, 6),
    "f4_annual_trend": (se.annual_trend, 4),
    "f4_trend_significance": (se.trend_significance, 4),
    "f5_mann_kendall": (se.mann_kendall, 6),
    "f5_mann_kendall_significance": (se.mann_kendall_significance, 6),
    "f6_dry_spells": (se.dry_spells, 6),
    "f6_dry_spell_stats": (se.dry_spell_stats, 6),
    "f7_spell_start_months": (se.spell_start_months, 6),
    "f8_spell_length_ecdf": (se.spell_length_ecdf, 6),
    "f8_spell_length_quantiles": (se.spell_length_quantiles, 6),
    "f9_day_of_year_climatology": (se.day_of_year_climatology, 6),
    "f10_year_day_matrix": (se.year_day_matrix, 6),
    "f10_colour_cap": (se.colour_cap, 6),
    "f11_filtered_profile": (lambda df: se.filtered_profile(df, *RANGE), 6),
    "f13_monthly_totals": (se.monthly_totals, 6),
    "f14_monthly_rolling": (se.monthly_rolling, 5),
    "f15_deseasonalised": (se.deseasonalised, 5),
}

Q = {
    name: (lambda op, digits: lambda spark, folder: settle(op(pn.dense_panel(spark, folder)), digits))(op, digits)
    for name, (op, digits) in _ON_DENSE.items()
}
Q["f12_column_histogram"] = lambda spark, folder: settle(
    se.column_histogram(pn.full_panel(spark, folder), "wind"))
