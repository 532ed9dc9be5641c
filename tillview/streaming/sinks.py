"""Streaming sinks. Each query gets its own checkpoint folder from the caller."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

BATCH = "batch_id"


def start_keyed(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    available_now: bool = False,
    interval: str = "5 seconds",
    keys: list[str] | None = None,
    compact_every: int = 100,
) -> StreamingQuery:
    """Write every micro-batch of updates to a folder of its own.

    A batch that runs again after a failure overwrites its folder, so nothing
    is counted twice. :func:`read_keyed` shows the newest row of each key. With
    ``keys`` the folders are folded into a base table after every
    ``compact_every`` batches, so that a read opens a bounded number of them.
    """

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{BATCH}={batch_id}")
        if keys and batch_id % compact_every == compact_every - 1:
            compact_keyed(batch.sparkSession, path, keys)

    writer = stream.writeStream.outputMode("update").foreachBatch(write_batch)
    return _start(writer, checkpoint, available_now, interval)


def read_keyed(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The newest row per key: the base table and the batches after its high-water mark."""
    return _newest(_updates(spark, path), keys)


def _updates(spark: SparkSession, path: str) -> DataFrame:
    """Rows with the batch they come from; those of the base carry its high-water mark."""
    mark = _high_water(spark, path)
    newer = [f for f, batch in _batches(spark, path) if batch > mark]
    parts = [spark.read.option("basePath", path).parquet(*newer)] if newer else []
    if mark >= 0:
        parts.append(spark.read.parquet(_base(path, mark)).withColumn(BATCH, F.lit(mark)))
    if not parts:
        raise FileNotFoundError(f"no update under {path}")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _base(path: str, mark: int) -> str:
    return f"{path}/_base/upto={mark}"


def _listed(spark: SparkSession, pattern: str) -> list[tuple[str, int]]:
    """(folder, number) of the folders ``name=number`` that hold a finished write."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{pattern}=*/_SUCCESS")
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place) or []
    folders = [f.getPath().getParent().toString() for f in found]
    return sorted(((f, int(f.rpartition("=")[2])) for f in folders), key=lambda x: x[1])


def _batches(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    return _listed(spark, f"{path}/{BATCH}")


def _high_water(spark: SparkSession, path: str) -> int:
    return max((mark for _, mark in _listed(spark, f"{path}/_base/upto")), default=-1)


def _newest(updates: DataFrame, keys: list[str]) -> DataFrame:
    """Updates of one batch hold a key at most once."""
    values = F.struct(*[c for c in updates.columns if c not in (*keys, BATCH)])
    return updates.groupBy(*keys).agg(F.max_by(values, BATCH).alias("newest")).select(*keys, "newest.*")


def compact_keyed(spark: SparkSession, path: str, keys: list[str]) -> int:
    """Fold all batches written so far into a new base table and expire what it replaces.

    The base counts once it is complete; readers see the old state or the new one. What
    the base before it was made of goes only now, so a read that began with that base
    still finds its files while this one is written. Returns the high-water mark.
    """
    batches, before = _batches(spark, path), _listed(spark, f"{path}/_base/upto")
    mark = max([b for _, b in batches] + [m for _, m in before], default=-1)
    if mark < 0 or any(m == mark for _, m in before):
        return mark
    _newest(_updates(spark, path), keys).write.mode("overwrite").parquet(_base(path, mark))
    reached = max((m for _, m in before), default=-1)
    for folder, number in [x for x in batches if x[1] <= reached] + before[:-1]:
        place = spark._jvm.org.apache.hadoop.fs.Path(folder)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return mark


def start_append(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    partition_by: list[str] | None = None,
    available_now: bool = False,
    interval: str = "5 seconds",
) -> StreamingQuery:
    """Append to Parquet; Spark's file sink commits each batch exactly once."""
    writer = stream.writeStream.outputMode("append").format("parquet").option("path", path)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return _start(writer, checkpoint, available_now, interval)


def start_jdbc(
    stream: DataFrame, url: str, table: str, checkpoint: str, interval: str = "5 seconds", **properties: str
) -> StreamingQuery:
    """Append each micro-batch to a JDBC table, from one evaluation of the batch.

    Needs the database's driver jar. JDBC appends are at least once: rows carry
    their batch id, so that readers can keep the newest of a key.
    """

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn(BATCH, F.lit(batch_id)).write.jdbc(url, table, mode="append", properties=properties)

    return _start(stream.writeStream.outputMode("update").foreachBatch(write_batch), checkpoint, False, interval)


def start_console(stream: DataFrame, checkpoint: str, interval: str = "5 seconds") -> StreamingQuery:
    writer = stream.writeStream.outputMode("update").format("console").option("truncate", False)
    return _start(writer, checkpoint, False, interval)


def _start(writer: DataStreamWriter, checkpoint: str, available_now: bool, interval: str) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    trigger = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    return trigger.start()
