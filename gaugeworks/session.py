"""What a session needs to run this package's functions on its workers."""

from __future__ import annotations

import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)
#: Arrow batches sent to Python workers: at most so many bytes and rows.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 4000


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import the package from where the driver has it, whatever
    folder they start in.  On a cluster the package is installed on the workers, or sent
    with --py-files, and this adds nothing."""
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if ROOT not in known.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{ROOT}:{known}".rstrip(":")
    return spark


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the folder that driver and executors share
    (``spark.checkpoint.dir``).  Where none is configured a session with a local master,
    whose workers are on this machine, gets a temporary one; a cluster's raises."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[[^,]*(,\s*\d+)?\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.gettempdir() + "/gaugeworks-checkpoints"
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def persist(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage: write to the shared folder and read back.  Unlike a cache the
    rows survive the loss of any executor."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tune(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python workers receive, so that a run of very
    long texts cannot exhaust a worker's memory.  The settings are read when a lazy plan
    runs, so they stay; smaller bounds that the caller has set are left alone."""
    for name, most in (("maxBytesPerBatch", BATCH_BYTES), ("maxRecordsPerBatch", BATCH_ROWS)):
        name = f"spark.sql.execution.arrow.{name}"
        try:
            own = int(spark.conf.get(name))
        except (TypeError, ValueError):  # unset, or with a unit
            own = 0
        if not 0 < own <= most:
            spark.conf.set(name, str(most))
