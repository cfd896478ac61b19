"""Column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from pluvia.spec import CATEGORIES, SEASONS


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def season(month: Column) -> Column:
    label = F.lit("Unknown")
    for name, months in reversed(SEASONS.items()):
        label = F.when(month.isin(*months), name).otherwise(label)
    return label


def is_monsoon(date: Column | str, months: Sequence[int] = SEASONS["Monsoon"]) -> Column:
    return F.month(col(date)).isin(*months)


def category(value: Column | str, limits: Mapping[str, float] = CATEGORIES) -> Column:
    """Label of the first category whose upper limit lies above the value."""
    value = col(value)
    *lower, last = limits.items()
    label = F.lit(last[0])
    for name, limit in reversed(lower):
        label = F.when(value < limit, name).otherwise(label)
    return F.when(value.isNull() | F.isnan(value), "Unknown").otherwise(label)


def not_nan(value: Column | str) -> Column:
    """NaN and NULL are both a missing value."""
    value = col(value)
    return F.when(~F.isnan(value), value)


def at_least_zero(value: Column) -> Column:
    return F.greatest(value, F.lit(0.0))


def safe_divide(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def bin_index(value: Column, lo: Column, hi: Column, n: Column | int) -> Column:
    """0-based index of one of ``n`` equal bins; the last bin is closed on both sides."""
    n = F.lit(n) if isinstance(n, int) else n
    raw = F.floor((value - lo) / (hi - lo) * n).cast("int")
    return F.when(
        (value >= lo) & (value <= hi),
        F.when(hi == lo, 0).otherwise(F.least(raw, (n - 1).cast("int"))),
    )


def sorted_quantile(values: Column, p: float) -> Column:
    """Linear-interpolated quantile of an already sorted array column."""
    pos = (F.size(values) - 1) * F.lit(float(p))
    low = F.floor(pos).cast("int")
    a = F.get(values, low)
    b = F.get(values, F.least(low + 1, F.size(values) - 1))
    return a + (b - a) * (pos - low)


def array_mean(values: Column) -> Column:
    return array_sum(values) / F.size(values)


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def melt(df, keys: Sequence[str], columns: Sequence[str], name: str, value: str):
    """Wide measures to (name, value) rows without a second scan."""
    pairs = F.array(
        *[F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value)) for c in columns]
    )
    return df.select(*keys, F.inline(pairs))
