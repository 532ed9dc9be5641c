"""Keyed tables that are updated in place of a few files: copy on write with a manifest.

Data files are never changed. A manifest, a small table published as a whole, lists the files
of the current state. A merge finds the files that hold a key of the batch by reading the key
columns only, writes those files anew and publishes a manifest with the new files for the old
ones. Readers see the state before or after; a failed merge leaves files that no manifest lists.
Rows lie in files by ranges of the key, so a batch of neighbouring keys touches few of them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tillview.operators.tables import one_per_key, upsert_by_key
from tillview.sources.scratch import materialize
from tillview.sources.versions import VersionedTable


@dataclass
class MergeReport:
    """Files of the table before, those written anew, and rows they hold now."""

    files: int
    rewritten: int
    rows: int


class FileTable:
    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: StructType, rows_per_file: int = 1_000_000):
        self.spark, self.path, self.keys, self.schema = spark, path.rstrip("/"), keys, schema
        self.rows_per_file = rows_per_file
        self.manifest = VersionedTable(spark, f"{self.path}/manifest")

    def files(self) -> list[tuple[str, int]]:
        """The current files with their rows."""
        if not self.manifest.versions():
            return []
        return sorted((r["file"], r["rows"]) for r in self.manifest.read().collect())

    def read(self) -> DataFrame:
        return self._read([f for f, _ in self.files()])

    def replace(self, df: DataFrame) -> MergeReport:
        """The table as a whole."""
        before = self.files()
        return self._publish(before, before, self._write(df, df.count()))

    def merge(self, batch: DataFrame, rewrite: Callable[[DataFrame], DataFrame]) -> MergeReport:
        """Write the files that hold a key of ``batch`` anew, as ``rewrite`` makes of their rows.

        Keys of the batch that no file holds are up to ``rewrite``. Rows of other files must not
        depend on it. An empty batch changes nothing.
        """
        before = self.files()
        keys = materialize(batch.select(*self.keys).distinct(), "keys")
        if keys.isEmpty():
            return MergeReport(len(before), 0, 0)
        touched = set()
        if before:
            # the key columns of all files, and of each file only whether it is hit
            hit = self._read([f for f, _ in before]).select(*self.keys, F.col("_metadata.file_path").alias("file"))
            touched = {r["file"] for r in hit.join(keys, self.keys, "left_semi").select("file").distinct().collect()}
        old = [(f, n) for f, n in before if f in touched]
        rows = sum(n for _, n in old) + (0 if old else keys.count())
        return self._publish(before, old, self._write(rewrite(self._read([f for f, _ in old])), rows))

    def upsert(self, batch: DataFrame, order_by: str | None = None) -> MergeReport:
        """Rows of the batch replace those with their key, or are added."""
        latest = materialize(one_per_key(batch, self.keys, order_by, newest=True), "batch")
        return self.merge(latest, lambda rows: upsert_by_key(rows, latest, self.keys))

    def update(self, batch: DataFrame, columns: list[str]) -> MergeReport:
        """Rows with a key of the batch get its ``columns`` where these are not null and differ; no row is added."""
        given = materialize(one_per_key(batch.select(*self.keys, *columns), self.keys, None, newest=True), "batch")
        new = given.select(*self.keys, *[F.col(c).alias(f"new_{c}") for c in columns])
        changes = [F.col(f"new_{c}").isNotNull() & ~F.col(c).eqNullSafe(F.col(f"new_{c}")) for c in columns]
        different = changes[0]
        for change in changes[1:]:
            different = different | change
        # an unchanged row is no reason to write its file
        moved = self.read().join(new, self.keys).where(different).select(*self.keys)

        def rewrite(rows: DataFrame) -> DataFrame:
            joined = rows.join(new, self.keys, "left").withColumns({c: F.coalesce(f"new_{c}", c) for c in columns})
            return joined.select(*self.schema.names)

        return self.merge(moved, rewrite)

    def _read(self, files: list[str]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*files)

    def _write(self, df: DataFrame, rows: int) -> list[tuple[str, int]]:
        folder = f"{self.path}/data-{uuid.uuid4().hex}"
        parts = max(1, -(-rows // self.rows_per_file))
        df.select(*self.schema.names).repartitionByRange(parts, *self.keys).sortWithinPartitions(*self.keys).write.parquet(folder)
        written = self.spark.read.schema(self.schema).parquet(folder)
        by_file = written.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("rows"))
        return [(r["file"], r["rows"]) for r in by_file.collect()]

    def _publish(self, before: list[tuple[str, int]], old: list[tuple[str, int]], new: list[tuple[str, int]]) -> MergeReport:
        gone = {f for f, _ in old}
        rows = self.spark.createDataFrame([*((f, n) for f, n in before if f not in gone), *new], "file string, rows bigint").coalesce(1)
        self.manifest.replace(rows, min_rows=0)
        return MergeReport(len(before), len(old), sum(n for _, n in new))
