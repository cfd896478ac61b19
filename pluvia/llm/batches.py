"""Size of the Arrow batches in which texts reach Python."""

from __future__ import annotations

from pyspark.sql import DataFrame

ROWS = 1000
SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, with the session's Arrow batches held to ``ROWS`` rows at most.

    Whole texts are long rows: the default of ten thousand would put tens of megabytes
    into each batch, in the JVM and in Python. A smaller setting of the user's stays.
    """
    conf = df.sparkSession.conf
    now = int(conf.get(SETTING))
    if now <= 0 or now > ROWS:
        conf.set(SETTING, str(ROWS))
    return df
