"""Purchase events into the transactions table, and running totals per user."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from tillview.functions.numeric import MONEY
from tillview.sources.schemas import TRANSACTION_EVENT
from tillview.streaming.events import parse_events

REQUIRED = ["event_id", "user_id", "product_id", "quantity", "unit_price", "total_amount", "timestamp"]
CORRUPT, ACCOUNT = "_corrupt_record", "account"


def ingest_transactions(messages: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Transactions from purchase events, with the time of the event.

    Records that lack a field are skipped, and a message that is delivered
    again within ``lateness`` is dropped by its event id.
    """
    events = parse_events(messages, TRANSACTION_EVENT).filter(F.col("event_type") == "purchase")
    whole = events.dropna(subset=REQUIRED)
    once = whole.withWatermark("timestamp", lateness).dropDuplicatesWithinWatermark(["event_id"])
    return once.select(
        F.col("event_id").alias("transaction_id"),
        "user_id",
        "product_id",
        "session_id",
        F.col("timestamp").alias("transaction_date"),
        "quantity",
        F.col("unit_price").cast(MONEY).alias("unit_price"),
        F.col("total_amount").cast(MONEY).alias("total_amount"),
        F.coalesce("payment_method", F.lit("unknown")).alias("payment_method"),
        F.lit("completed").alias("order_status"),
        F.date_format("timestamp", "yyyy-MM").alias("txn_month"),
    )


def _judged(messages: DataFrame) -> DataFrame:
    """The event's fields, the message as ``value``, and ``reason`` where it cannot be a transaction.

    The reason is null for what is whole and for events of other types.
    """
    schema = StructType([*TRANSACTION_EVENT.fields, StructField(CORRUPT, StringType())])
    value = F.col("value").cast("string")
    event = F.from_json(value, schema, {"columnNameOfCorruptRecord": CORRUPT})
    told = messages.select(value.alias("value"), event.alias("event")).select("value", "event.*")
    told = told.withColumn("timestamp", F.try_to_timestamp("timestamp"))
    missing = F.concat_ws(", ", *[F.when(F.col(c).isNull(), F.lit(c)) for c in REQUIRED])
    reason = (
        F.when(F.col(CORRUPT).isNotNull() | F.col("event_type").isNull(), F.lit("not an event"))
        .when((F.col("event_type") == "purchase") & (missing != ""), F.concat(F.lit("without "), missing))
    )
    return told.withColumn("reason", reason).drop(CORRUPT)


def quarantined_messages(messages: DataFrame) -> DataFrame:
    """(value, reason): the messages that :func:`ingest_transactions` skips because they are not whole."""
    return _judged(messages).filter(F.col("reason").isNotNull()).select("value", "reason")


def accounted_messages(messages: DataFrame) -> DataFrame:
    """The messages as they are, counted on their way: all, those to be quarantined, and events of other types."""
    judged = _judged(messages)
    bad = F.col("reason").isNotNull()
    counted = judged.observe(
        ACCOUNT,
        F.count(F.lit(1)).alias("input"),
        F.count_if(bad).alias("quarantined"),
        F.count_if(~bad & (F.col("event_type") != "purchase")).alias("other"),
    )
    return counted.filter(~bad).select("value")


def account_of(queries: list[StreamingQuery]) -> dict[str, int]:
    """What became of the messages of finished passes of the ingestion over :func:`accounted_messages`.

    Input, quarantined and other events are observed in the stream, late and repeated ones told by
    the state operator; input = kept + quarantined + other + late + repeated, with ``kept`` the
    rows that the sink got. Raises if progress reports were lost.
    """
    total = dict.fromkeys(("input", "quarantined", "other", "late", "repeated"), 0)
    for query in queries:
        reports = query.recentProgress
        limit = int(SparkSession.getActiveSession().conf.get("spark.sql.streaming.numRecentProgressUpdates"))
        if len(reports) >= limit:
            raise RuntimeError(f"{limit} progress reports are kept; raise spark.sql.streaming.numRecentProgressUpdates")
        for report in (json.loads(r.json) for r in reports):
            for name, n in report.get("observedMetrics", {}).get(ACCOUNT, {}).items():
                total[name] += n or 0
            for operator in report.get("stateOperators", []):
                total["late"] += operator.get("numRowsDroppedByWatermark", 0)
                total["repeated"] += operator.get("customMetrics", {}).get("numDroppedDuplicateRows", 0)
    return total


def running_user_totals(transactions: DataFrame) -> DataFrame:
    """Lifetime value, last purchase and purchases per user, as an updating stream.

    The last purchase is a maximum, so events that arrive out of order do not
    move it back.
    """
    return transactions.groupBy("user_id").agg(
        F.sum("total_amount").alias("lifetime_value"),
        F.max("transaction_date").alias("last_purchase_date"),
        F.count("*").alias("total_purchases"),
    )
