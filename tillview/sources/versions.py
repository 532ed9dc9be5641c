"""Derived tables that are replaced as a whole without disturbing readers."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession

from tillview.sources.readers import write_observed

_READY = "_READY"


class EmptyTableError(RuntimeError):
    """A refresh produced fewer rows than the gate asks for."""


class VersionedTable:
    """A folder of versions. A version counts once its marker file exists, and
    that is written last: readers see the old version or the whole new one."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    def versions(self) -> list[str]:
        """Complete versions, oldest first."""
        found = self._fs().globStatus(self._hadoop_path(f"{self.path}/v=*/{_READY}"))
        return sorted(status.getPath().getParent().toString() for status in (found or []))

    def read(self) -> DataFrame:
        versions = self.versions()
        if not versions:
            raise FileNotFoundError(f"no complete version under {self.path}")
        return self.spark.read.parquet(versions[-1])

    def stage(self, df: DataFrame, min_rows: int = 1) -> tuple[str, int]:
        """Write a new version that nobody sees yet: its folder and rows."""
        folder, told = self.stage_observed(df, {}, min_rows)
        return folder, told["rows"]

    def stage_observed(self, df: DataFrame, measures: dict[str, Column], min_rows: int = 1) -> tuple[str, dict[str, int]]:
        """As :meth:`stage`, with the rows and the measures that were taken while it was written."""
        folder = f"{self.path}/v={time.time_ns():020d}"
        told = write_observed(df, folder, measures, mode="errorifexists")
        if told["rows"] < min_rows:
            raise EmptyTableError(f"{self.path}: {told['rows']} rows, expected at least {min_rows}")
        return folder, told

    def publish(self, folder: str) -> None:
        """Switch readers to a staged version."""
        self._fs().createNewFile(self._hadoop_path(f"{folder}/{_READY}"))

    def replace(self, df: DataFrame, min_rows: int = 1) -> int:
        """Stage and publish."""
        folder, rows = self.stage(df, min_rows)
        self.publish(folder)
        return rows

    def expire(self, keep: int = 2) -> None:
        """Delete all but the newest versions."""
        for folder in self.versions()[:-keep]:
            self._fs().delete(self._hadoop_path(folder), True)

    def _hadoop_path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self):
        return self._hadoop_path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
