"""Batch and streaming readers and the Parquet export sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_table(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """Parquet straight from the store path; a declared schema spares the footer read."""
    reader = spark.read
    return (reader.schema(schema) if schema is not None else reader).parquet(path)


def kafka_stream(
    spark: SparkSession, servers: str, topic: str, starting_offsets: str = "latest", **options: str
) -> DataFrame:
    """Kafka topic as a stream with a ``value`` column; needs the Kafka connector jar."""
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", starting_offsets)
    )
    for key, value in options.items():
        reader = reader.option(key, value)
    return reader.load()


def parquet_stream(spark: SparkSession, folder: str, file_glob: str, schema: StructType, **options) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", file_glob)
    for key, value in options.items():
        reader = reader.option(key, value)
    return reader.parquet(folder)


def write_observed(
    df: DataFrame,
    path: str,
    measures: dict[str, Column] | None = None,
    mode: str = "overwrite",
    partition_by: list[str] | None = None,
) -> dict[str, int]:
    """Write Parquet and return the number of ``rows`` and the measures, all observed while rows are written.

    Measures are aggregates without distinct. Nothing is read again.
    """
    told = Observation()
    df = df.observe(told, F.count(F.lit(1)).alias("rows"), *[c.alias(name) for name, c in (measures or {}).items()])
    if partition_by:
        # rows of a partition meet in few tasks; AQE splits a large one and joins small ones
        df = df.hint("rebalance", *partition_by)
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return {"rows": 0, **told.get}


def write_counted(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None) -> int:
    """Write Parquet and return the row count, which the write job itself tells."""
    return write_observed(df, path, None, mode, partition_by)["rows"]


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", **properties: str) -> None:
    """Append to a JDBC table from the executors; needs the database's driver jar."""
    df.write.jdbc(url=url, table=table, mode=mode, properties=properties)
