"""Mergeable states of a month: what the views need of it, so that no other month is read again.

Distinct users are kept as bitmaps of 32,768 ids a bucket: states of any days merge by a bitwise
or, and the count is exact. That suits serial ids; a bucket takes 4 KB before compression. Sums,
counts, first and last times merge as they are. An order's lines share their time, so the orders
of a user and of a day are counted within a month.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillview.functions.dates import TS, Anchor
from tillview.functions.numeric import mean_of_sums
from tillview.operators.customers import NEVER_BOUGHT_DAYS
from tillview.sources.months import MONTH

DAY_USERS = "metric_date date, bucket bigint, users binary, txn_month string"


def day_users(transactions: DataFrame, month: Column | None = None) -> DataFrame:
    """(metric_date, bucket, users, txn_month): the users of each day as bitmaps.

    One aggregate with map-side combine; rows without user or time count for nobody.
    """
    day = F.to_date(TS)
    known = transactions.where(F.col("user_id").isNotNull() & F.col(TS).isNotNull())
    return known.groupBy(day.alias("metric_date"), F.bitmap_bucket_number("user_id").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("user_id")).alias("users")
    ).withColumn(MONTH, F.date_format("metric_date", "yyyy-MM") if month is None else month)


def distinct_users(states: DataFrame, period: Column) -> DataFrame:
    """(period, users): exact distinct users of each period from the days' bitmaps."""
    merged = states.groupBy(period.alias("period"), "bucket").agg(F.bitmap_or_agg("users").alias("users"))
    return merged.groupBy("period").agg(F.sum(F.bitmap_count("users")).alias("users"))


def active_users(states: DataFrame, window: int = 30) -> DataFrame:
    """(grain, period, users) for days, ISO weeks and the ``window`` days up to each day with a purchase.

    Reads the days' bitmaps only; weeks and windows merge days, the fact is not touched.
    """
    days = states.select("metric_date").distinct().withColumnRenamed("metric_date", "period")
    # a day counts for itself and the days after it that lie within the window
    spread = states.select(
        F.explode(F.sequence("metric_date", F.date_add("metric_date", window - 1))).alias("period"), "bucket", "users"
    ).join(days, "period", "left_semi")
    grains = {
        "day": distinct_users(states, F.col("metric_date")),
        "week": distinct_users(states, F.to_date(F.date_trunc("week", "metric_date"))),
        f"{window} days": distinct_users(spread, F.col("period")),
    }
    first, *rest = (df.select(F.lit(grain).alias("grain"), "period", "users") for grain, df in grains.items())
    for df in rest:
        first = first.unionByName(df)
    return first


def day_totals(transactions: DataFrame) -> DataFrame:
    """One row a day: sums and counts, orders and sessions; the users are in :func:`day_users`."""
    orders = transactions.groupBy(F.to_date(TS).alias("metric_date"), "transaction_id", "session_id").agg(
        F.sum("total_amount").alias("revenue"),
        F.count("total_amount").alias("amounts"),
        F.sum("quantity").alias("items"),
        F.sum("discount_amount").alias("discounts"),
    )
    return orders.groupBy("metric_date").agg(
        F.countDistinct("transaction_id").alias("total_transactions"),
        F.countDistinct("session_id").alias("total_sessions"),
        F.sum("revenue").alias("revenue"),
        F.sum("amounts").alias("amounts"),
        F.sum("items").alias("items"),
        F.sum("discounts").alias("discounts"),
    ).withColumn(MONTH, F.date_format("metric_date", "yyyy-MM"))


def user_months(transactions: DataFrame) -> DataFrame:
    """One row for each user and month: sums and counts, first and last times, orders and days."""
    month = F.date_format(TS, "yyyy-MM")
    orders = transactions.groupBy("user_id", "transaction_id", F.to_date(TS).alias("day"), month.alias(MONTH)).agg(
        F.max(TS).alias("last"),
        F.min(TS).alias("first"),
        F.sum("total_amount").alias("spent"),
        F.count("total_amount").alias("amounts"),
        F.sum("quantity").alias("items"),
    )
    return orders.groupBy("user_id", MONTH).agg(
        F.max("last").alias("last"),
        F.min("first").alias("first"),
        F.countDistinct("transaction_id").alias("orders"),
        F.countDistinct("day").alias("days"),
        F.sum("spent").alias("spent"),
        F.sum("amounts").alias("amounts"),
        F.sum("items").alias("items"),
    )


def daily_view(totals: DataFrame, users: DataFrame, months: DataFrame) -> DataFrame:
    """The view :func:`kpi.daily_metrics` from the states of all months."""
    active = distinct_users(users, F.col("metric_date")).select(F.col("period").alias("metric_date"), F.col("users").alias("active"))
    first_days = (
        months.where(F.col("user_id").isNotNull())
        .groupBy("user_id")
        .agg(F.to_date(F.min("first")).alias("metric_date"))
        .groupBy("metric_date")
        .agg(F.count("*").alias("first_time"))
    )
    zero = F.lit(0).cast("bigint")
    return (
        totals.join(active, "metric_date", "left")
        .join(first_days, "metric_date", "left")
        .select(
            "metric_date",
            F.coalesce("active", zero).alias("daily_active_users"),
            "total_transactions",
            F.col("revenue").alias("total_revenue"),
            F.try_divide(F.col("revenue").cast("double"), F.col("amounts")).alias("avg_order_value"),
            F.col("items").alias("total_items_sold"),
            "total_sessions",
            F.col("discounts").alias("total_discounts"),
            F.coalesce("active", zero).alias("new_customers"),
            F.coalesce("first_time", zero).alias("first_time_customers"),
        )
    )


def user_view(users: DataFrame, months: DataFrame, as_of) -> DataFrame:
    """The view :func:`customers.user_metrics` from the states of all months."""
    merged = months.groupBy("user_id").agg(
        F.max("last").alias("last_purchase_date"),
        F.min("first").alias("first_purchase_date"),
        F.sum("orders").alias("frequency"),
        F.sum("spent").alias("monetary"),
        mean_of_sums("spent", "amounts").alias("avg_order_value"),
        F.sum("days").alias("purchase_days"),
        F.sum("items").alias("total_items_purchased"),
    )
    counted = ["frequency", "monetary", "avg_order_value", "purchase_days", "total_items_purchased"]
    anchor = Anchor(merged, as_of, "last_purchase_date")
    return (
        users.select("user_id", "email")
        .join(merged, "user_id", "left")
        .withColumn(
            "recency_days", F.coalesce(anchor.days_since(F.col("last_purchase_date")), F.lit(NEVER_BOUGHT_DAYS))
        )
        .withColumns({c: F.coalesce(c, F.lit(0)) for c in counted})
    )
