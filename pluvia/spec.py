"""Column roles, thresholds and calendars of a panel of daily series."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from types import MappingProxyType

from pyspark.sql import Window
from pyspark.sql.window import WindowSpec

# Input columns and their physical bounds.
COVARIATES = (
    "tmax", "tmin", "tavg", "rh", "wind", "pressure", "cloud",
    "solar_rad", "soil_wet_surf", "soil_wet_root",
)
PHYSICAL_BOUNDS = {
    "rainfall": (0.0, 500.0),
    "tmax": (10.0, 55.0),
    "tmin": (-5.0, 40.0),
    "tavg": (0.0, 50.0),
    "rh": (0.0, 100.0),
    "wind": (0.0, 50.0),
    "pressure": (95.0, 105.0),
    "cloud": (0.0, 100.0),
    "solar_rad": (0.0, 40.0),
    "soil_wet_surf": (0.0, 1.0),
    "soil_wet_root": (0.0, 1.0),
}
# Season label -> months.
SEASONS = {
    "Monsoon": (6, 7, 8, 9),
    "Pre-Monsoon": (3, 4, 5),
    "Post-Monsoon": (10, 11),
    "Winter": (12, 1, 2),
}
# Category label -> exclusive upper limit (mm/day).
CATEGORIES = {
    "No rain": 0.1,
    "Light": 2.5,
    "Moderate": 15.6,
    "Heavy": 64.5,
    "Very Heavy": 115.6,
    "Extremely Heavy": float("inf"),
}
# Lag days and rolling windows per column.
TARGET_LAGS = (1, 2, 3, 7, 14, 30)
COVARIATE_LAGS = {
    "rh": (1, 3, 7),
    "pressure": (1, 3, 7),
    "cloud": (1, 3, 7),
    "soil_wet_surf": (1, 3, 7),
}
TARGET_ROLLS = (7, 14, 30)
COVARIATE_ROLLS = {"rh": (7, 30), "soil_wet_surf": (7, 30)}

DRY_LIMIT = 0.1
HEAVY_LIMIT = 64.5
EXTREME_LIMIT = 204.4
EXTREME_EVENT = 50.0

# The DATE type spans years 1..9999, so nothing keyed by date alone can have
# more rows than this, and no series can either once its dates are unique.
MAX_CALENDAR_DAYS = 3_652_059


@dataclass(frozen=True)
class SeriesSpec:
    """Names the columns of a panel; every operator takes one."""

    series: str = "series_id"
    date: str = "date"
    target: str = "rainfall"
    features: tuple[str, ...] = COVARIATES
    bounds: Mapping[str, tuple[float, float]] = field(
        default_factory=lambda: MappingProxyType(PHYSICAL_BOUNDS)
    )
    train_frac: float = 0.70
    val_frac: float = 0.15
    monsoon: tuple[int, ...] = SEASONS["Monsoon"]

    @property
    def key(self) -> list[str]:
        return [self.series, self.date]

    @property
    def measures(self) -> list[str]:
        return [self.target, *self.features]

    def ordered(self, *extra_keys: str) -> WindowSpec:
        """Rows of one series in date order (at most one row per calendar day)."""
        return Window.partitionBy(self.series, *extra_keys).orderBy(self.date)

    def whole(self, *extra_keys: str) -> WindowSpec:
        return Window.partitionBy(self.series, *extra_keys)


DEFAULT = SeriesSpec()
