"""Facts that lie by month and, within a month, by user.

Files are partitioned by month and bucketed by user, and rows are sorted by user and time within
a file. A look-up of one user reads one bucket of the months it asks for; counts per user and
joins of tables with as many buckets need no shuffle; a join with a filtered table of months
reads these months only.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillview.functions.dates import TS
from tillview.sources.months import MONTH


def write_bucketed(df: DataFrame, path: str, buckets: int, key: str = "user_id", order: str | None = TS, month: bool = True) -> DataFrame:
    """Write ``df`` and return it as a bucketed table.

    Each (month, bucket) is dealt to few tasks; AQE splits a large one, so a user with a large
    share of the rows becomes several files of one bucket and no single task's work.
    """
    name = f"bucketed_{uuid.uuid4().hex}"
    # the bucket as Spark numbers it
    dealt = df.withColumn("dealt_by", F.pmod(F.hash(key), F.lit(buckets)))
    dealt = dealt.hint("rebalance", *([MONTH] if month else []), "dealt_by").drop("dealt_by")
    writer = dealt.write.format("parquet").option("path", path).bucketBy(buckets, key).sortBy(key, *([order] if order else []))
    if month:
        writer = writer.partitionBy(MONTH)
    writer.saveAsTable(name)
    return df.sparkSession.table(name)


def bucketed_table(spark: SparkSession, path: str, schema: str, buckets: int, key: str = "user_id", order: str | None = TS, month: bool = True) -> DataFrame:
    """What an earlier session wrote to ``path``; ``schema`` is its columns as DDL, the month among them."""
    name = f"bucketed_{uuid.uuid4().hex}"
    partitioned = f"PARTITIONED BY ({MONTH})" if month else ""
    sorted_by = f"SORTED BY ({key}{f', {order}' if order else ''})"
    spark.sql(
        f"CREATE TABLE {name} ({schema}) USING parquet {partitioned} CLUSTERED BY ({key}) {sorted_by} INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    if month:
        spark.sql(f"MSCK REPAIR TABLE {name}")
    return spark.table(name)
