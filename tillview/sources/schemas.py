"""Declared schemas of the streams and of the tables the jobs maintain."""

from __future__ import annotations

from pyspark.sql.types import (
    BooleanType,
    DateType,
    DecimalType,
    DoubleType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)


def _struct(*fields: tuple) -> StructType:
    return StructType([StructField(name, kind, True) for name, kind in fields])


USER_EVENT = _struct(
    ("event_id", StringType()),
    ("event_type", StringType()),
    ("user_id", LongType()),
    ("session_id", StringType()),
    ("timestamp", StringType()),
    ("page", StringType()),
    ("product_id", LongType()),
    ("device_type", StringType()),
    ("browser", StringType()),
    ("referrer", StringType()),
    ("position", LongType()),
    ("source", StringType()),
    ("quantity", LongType()),
)

TRANSACTION_EVENT = _struct(
    ("event_id", StringType()),
    ("event_type", StringType()),
    ("user_id", LongType()),
    ("session_id", StringType()),
    ("product_id", LongType()),
    ("quantity", LongType()),
    ("unit_price", DoubleType()),
    ("total_amount", DoubleType()),
    ("payment_method", StringType()),
    ("timestamp", StringType()),
)

DAILY_REPORT_LOG = _struct(
    ("report_date", DateType()),
    ("total_users", LongType()),
    ("total_transactions", LongType()),
    ("total_revenue", DecimalType(12, 2)),
    ("avg_order_value", DecimalType(12, 2)),
)

MODEL_REGISTRY = _struct(
    ("model_name", StringType()),
    ("version", StringType()),
    ("trained_at", TimestampType()),
    ("metrics", StringType()),
    ("is_active", BooleanType()),
)

AB_METRICS = _struct(
    ("metric_date", DateType()),
    ("experiment_key", StringType()),
    ("variant", StringType()),
    ("assigned_users", LongType()),
    ("converted_users", LongType()),
    ("conversion_rate", DecimalType(6, 4)),
)
