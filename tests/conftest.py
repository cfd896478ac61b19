import datetime as dt
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]


@pytest.fixture(scope="session")
def spark():
    from compare import session

    yield session(partitions=4)


@pytest.fixture(scope="session")
def panel(spark):
    """Builds a one- or many-series daily panel from {series: values}."""
    def build(series, start=dt.date(2000, 1, 1), **columns):
        rows = []
        for sid, values in series.items():
            for i, v in enumerate(values):
                extra = [col[sid][i] for col in columns.values()]
                rows.append((sid, start + dt.timedelta(days=i), None if v is None else float(v), *extra))
        schema = "series_id bigint, date date, rainfall double" + "".join(f", {c} double" for c in columns)
        return spark.createDataFrame(rows, schema)

    return build
