"""Tables in monthly parts that change part by part.

A fact stands in folders ``txn_month=...``. Which months changed shows in their file lists, so
appends, rewrites and deletions are all seen without reading a row. What is derived from a month
is kept beside the list it was derived from; a manifest, published as a whole, names the folder
of each month, so readers see the old parts or all the new ones, and a failed run leaves nothing
to clean in what they read.
"""

from __future__ import annotations

import hashlib
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillview.sources.versions import VersionedTable

MONTH = "txn_month"


def month_lists(spark: SparkSession, path: str) -> dict[str, str]:
    """Month and digest of its files' names, lengths and times; metadata only."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    store = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found: dict[str, list[str]] = {}
    for part in store.globStatus(hadoop.Path(f"{path.rstrip('/')}/{MONTH}=*")) or []:
        name = part.getPath().getName().split("=", 1)[1]
        files = [
            f"{s.getPath().getName()} {s.getLen()} {s.getModificationTime()}"
            for s in store.listStatus(part.getPath())
            if not s.getPath().getName().startswith(("_", "."))
        ]
        if files:
            found[name] = hashlib.sha256("\n".join(sorted(files)).encode()).hexdigest()
    return found


class MonthlyParts:
    """Derived tables in monthly parts, all of one run."""

    def __init__(self, spark: SparkSession, path: str, names: list[str]):
        self.spark, self.path, self.names = spark, path.rstrip("/"), names
        self.manifest = VersionedTable(spark, f"{self.path}/manifest")

    def _known(self) -> dict[str, tuple[str, str]]:
        """Month: the file list it was derived from and the folder of its parts."""
        if not self.manifest.versions():
            return {}
        return {r["month"]: (r["files"], r["folder"]) for r in self.manifest.read().collect()}

    def months(self) -> list[str]:
        """The months there are parts of."""
        return sorted(self._known())

    def changed(self, current: dict[str, str]) -> list[str]:
        """Months whose files differ from those of the last run."""
        known = self._known()
        return sorted(m for m, files in current.items() if known.get(m, ("", ""))[0] != files)

    def update(self, current: dict[str, str], parts: dict[str, DataFrame]) -> None:
        """Write the parts of the changed months, then publish the manifest; months that are gone leave it."""
        changed, known = set(self.changed(current)), self._known()
        folder = f"{self.path}/run-{uuid.uuid4().hex}"
        for name, df in parts.items():
            df.hint("rebalance", MONTH).write.partitionBy(MONTH).parquet(f"{folder}/{name}")
        rows = [(m, files, folder if m in changed else known[m][1]) for m, files in sorted(current.items())]
        frame = self.spark.createDataFrame(rows, "month string, files string, folder string").coalesce(1)
        self.manifest.replace(frame, min_rows=0)

    def read(self, name: str, schema) -> DataFrame:
        """All months of a table, each from the run that derived it last: one scan for each such run."""
        folders: dict[str, list[str]] = {}
        for month, (_, folder) in self._known().items():
            folders.setdefault(folder, []).append(month)
        scans = [
            self.spark.read.schema(schema).parquet(f"{folder}/{name}").where(F.col(MONTH).isin(months))
            for folder, months in sorted(folders.items())
        ]
        return reduce(DataFrame.unionByName, scans) if scans else self.spark.createDataFrame([], schema)

    def expire(self) -> int:
        """Delete the folders of runs that no month refers to; how many went."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        store = hadoop.Path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        used = {folder.rsplit("/", 1)[1] for _, folder in self._known().values()}
        gone = 0
        for status in store.globStatus(hadoop.Path(f"{self.path}/run-*")) or []:
            if status.getPath().getName() not in used:
                gone += bool(store.delete(status.getPath(), True))
        return gone
