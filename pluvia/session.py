"""Session helpers: scratch space on the cluster's shared folder, the package on workers."""

from __future__ import annotations

import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession

# Session settings the plans were measured with. Wide projections are split once
# a generated method outgrows what the JVM compiles, and small shuffles keep their
# partitions: a window costs far more than the bytes of its input suggest.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.session.timeZone": "UTC",
}
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def split_wide_code(spark: SparkSession) -> None:
    """Sets the limit of ``RECOMMENDED`` beyond which generated code is split.

    The JVM never compiles a longer method, so projections of dozens of columns would run
    many times slower in sessions that leave Spark's default.
    """
    name = "spark.sql.codegen.hugeMethodLimit"
    spark.conf.set(name, RECOMMENDED[name])


def shared_folder(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where it is unset, a session inside one process (``local[n]``, as in tests) gets a
    fresh folder; on a cluster that would be a disk of its own for each machine, so it
    is an error there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="pluvia-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries begun in here delete their shuffle files when they end.

    Spark keeps them else until the driver collects its garbage, which a large driver may
    not do for a whole job. Sessions of a Spark without the setting keep them.
    """
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used before iterative fits: the passes re-read a table that survives the
    loss of executors instead of recomputing the windows behind it. What the write
    shuffled is deleted once it is written.
    """
    path = scratch_path(df.sparkSession, name)
    with freed_shuffles(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free(*tables: DataFrame) -> None:
    """Delete tables of ``materialise`` that no lazy result reads any more."""
    for table in tables:
        for folder in {file.rpartition("/")[0] for file in table.inputFiles()}:
            files, path = FileSystem.from_uri(folder)
            files.delete_dir(path)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, for sessions started outside its folder.

    Needed where Python functions of the package run on workers that cannot import it;
    harmless where they can.
    """
    folder = Path(__file__).resolve().parent
    archive = shutil.make_archive(f"{tempfile.mkdtemp()}/{folder.name}", "zip", folder.parent, folder.name)
    spark.sparkContext.addPyFile(archive)
