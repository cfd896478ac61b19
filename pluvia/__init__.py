"""Panel time-series analytics on Spark: daily, zero-inflated measurement series."""

from pluvia.spec import DEFAULT, SeriesSpec

__all__ = ["DEFAULT", "SeriesSpec"]
