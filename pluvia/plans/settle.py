"""One output convention for results that are compared across engines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pluvia.session import split_wide_code

DIGITS = 6


def settle(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Doubles rounded (and -0.0 folded), integers and flags as BIGINT, dates as text."""
    split_wide_code(df.sparkSession)
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("double", "float") or kind.startswith("decimal"):
            c = _rounded(c.cast("double"), 10.0 ** digits)
        elif kind in ("int", "smallint", "tinyint", "bigint", "boolean"):
            c = c.cast("bigint")
        elif kind.startswith(("date", "timestamp")):
            c = c.cast("string")
        out.append(c.alias(name))
    return df.select(*out)


def _rounded(c: Column, scale: float) -> Column:
    """Half away from zero in plain double arithmetic; ``round`` would go through
    a decimal per value, which costs more than most of the queries."""
    near = F.signum(c) * F.floor(F.abs(c) * scale + 0.5) / scale + F.lit(0.0)
    return F.when(F.abs(c) < 1e12, near).otherwise(c)
