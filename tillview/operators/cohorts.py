"""Cohorts by first purchase and by registration."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillview.functions.dates import TS, calendar_months, elapsed_months, month_of
from tillview.functions.numeric import ratio



def cohort_retention(transactions: DataFrame) -> DataFrame:
    """Users per first-purchase month that bought again N calendar months later.

    The fact is reduced to distinct (user, month) first. After that a user has
    one row per month at most, so the window over the user stays narrow, and
    counting users is counting rows.
    """
    months = transactions.select("user_id", month_of(TS).alias("purchase_month")).distinct()
    cohorts = months.withColumn("cohort_month", F.min("purchase_month").over(Window.partitionBy("user_id")))
    retained = (
        cohorts.withColumn(
            "months_since_first", calendar_months(F.col("cohort_month"), F.col("purchase_month"))
        )
        .groupBy("cohort_month", "months_since_first")
        .agg(F.count("*").alias("retained_users"))
    )
    # month 0 holds the whole cohort; a cohort has one row per month here
    size = F.max(F.when(F.col("months_since_first") == 0, F.col("retained_users"))).over(
        Window.partitionBy("cohort_month")
    )
    return (
        retained.withColumn("cohort_size", size)
        .withColumn("retention_rate", ratio("retained_users", "cohort_size", 4))
        .select("cohort_month", "months_since_first", "cohort_size", "retained_users", "retention_rate")
    )


def cohort_registration(users: DataFrame, transactions: DataFrame) -> DataFrame:
    """Activity per registration month; the cohort size counts users without purchases."""
    registered = users.select("user_id", month_of("registration_date").alias("cohort_month"))
    per_month = transactions.groupBy("user_id", month_of(TS).alias("transaction_month")).agg(
        F.sum("total_amount").alias("revenue")
    )
    sizes = registered.groupBy("cohort_month").agg(F.count("*").alias("cohort_size"))
    active = (
        registered.join(per_month, "user_id")
        .groupBy("cohort_month", "transaction_month")
        .agg(F.count("*").alias("active_users"), F.sum("revenue").alias("cohort_revenue"))
    )
    return active.join(sizes, "cohort_month").select(
        "cohort_month",
        "cohort_size",
        "transaction_month",
        "active_users",
        "cohort_revenue",
        ratio("active_users", "cohort_size", 2, times=100).alias("retention_rate"),
        elapsed_months(F.col("cohort_month"), F.col("transaction_month")).alias("months_since_registration"),
        ratio("cohort_revenue", "active_users", 2).alias("revenue_per_active_user"),
    )


def cohort_ltv(users: DataFrame, transactions: DataFrame) -> DataFrame:
    """Revenue per registration cohort and elapsed month.

    ``cumulative_ltv`` divides the running revenue by the users active in that
    month; ``cumulative_ltv_per_cohort_user`` divides it by the cohort size.
    Sales are summed per user and day before they meet the users.
    """
    registered = users.select("user_id", "registration_date", month_of("registration_date").alias("cohort_month"))
    per_day = transactions.groupBy("user_id", F.to_date(TS).alias("day")).agg(F.sum("total_amount").alias("revenue"))
    monthly = (
        per_day.join(registered, "user_id")
        .groupBy(
            "cohort_month",
            "user_id",
            elapsed_months(F.col("registration_date"), F.col("day")).alias("month_number"),
        )
        .agg(F.sum("revenue").alias("revenue"))
    )
    sizes = registered.groupBy("cohort_month").agg(F.count("*").alias("cohort_size"))
    running = Window.partitionBy("cohort_month").orderBy("month_number").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return (
        monthly.groupBy("cohort_month", "month_number")
        .agg(F.count("*").alias("active_users"), F.sum("revenue").alias("total_revenue"))
        .join(sizes, "cohort_month")
        .withColumn("running_revenue", F.sum("total_revenue").over(running))
        .select(
            "cohort_month",
            "month_number",
            "active_users",
            "total_revenue",
            ratio("total_revenue", "active_users", 2).alias("avg_revenue_per_user"),
            ratio("running_revenue", "active_users", 2).alias("cumulative_ltv"),
            ratio("running_revenue", "cohort_size", 2).alias("cumulative_ltv_per_cohort_user"),
        )
    )
