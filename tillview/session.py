"""Session settings the operators are tuned for."""

from __future__ import annotations

from pyspark.sql import SparkSession

# AQE picks reduce-side parallelism, splits skewed join partitions and turns a
# shuffled join into a broadcast one only after it has seen the real size.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # per-user and per-window state outgrows the heap long before local disks
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def build_session(app_name: str = "tillview", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


# Parquet expands about twentyfold in sort and hash buffers
TABLE_BYTES_PER_PARTITION = 4 << 20
SHUFFLE_BYTES_PER_TASK = "16m"
# partial aggregates sort or hash what a task scans
SCAN_BYTES_PER_TASK = "32m"


def shuffles_by_size(spark: SparkSession, paths: list[str]) -> None:
    """Let the shuffles and scans of queries over these tables have partitions in proportion to their bytes.

    AQE joins small shuffle partitions, but none is smaller than the initial number allows: with a
    fixed number the memory of a task grows with the tables. Where the session's own number is
    enough, its settings stay.
    """
    size = 0
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        store = place.getFileSystem(spark._jsc.hadoopConfiguration())
        size += store.getContentSummary(place).getLength() if store.exists(place) else 0
    wanted = size // TABLE_BYTES_PER_PARTITION + 1
    if wanted > int(spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(wanted))
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", SHUFFLE_BYTES_PER_TASK)
        spark.conf.set("spark.sql.files.maxPartitionBytes", SCAN_BYTES_PER_TASK)
