"""Intermediate tables that cut lineage and survive the loss of an executor."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
RUNS = "tillview-run-"
_local_root: str | None = None


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own; on a
    cluster a machine-local folder would be invisible to the other machines.
    """
    global _local_root
    configured = spark.conf.get(_KEY, None)
    if configured:
        return configured.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError(f"set {_KEY} to a folder that all executors share")
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="tillview-")
        atexit.register(shutil.rmtree, _local_root, ignore_errors=True)
    return _local_root


def run_folder(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables."""
    return f"{scratch_root(spark)}/{RUNS}{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{run_folder(spark)}/{label}-{uuid.uuid4().hex}"


def expire_runs(spark: SparkSession, hours: float = 0.0, own: bool = True) -> int:
    """Delete run folders untouched for ``hours``, this application's only if ``own``; how many went.

    A long-lived application calls it between its jobs, once their results are written; a
    scheduler calls it with a few days to clear what failed applications left.
    """
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch_root(spark)}/{RUNS}*")
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    latest, mine, gone = (time.time() - hours * 3600) * 1000, f"{RUNS}{spark.sparkContext.applicationId}", 0
    for status in store.globStatus(place) or []:
        is_mine = status.getPath().getName() == mine
        if is_mine and own or not is_mine and status.getModificationTime() <= latest and hours > 0:
            gone += bool(store.delete(status.getPath(), True))
    return gone


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write once, read many: the frame as a columnar table in the shared folder."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
