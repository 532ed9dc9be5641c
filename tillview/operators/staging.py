"""Cleaned views of the raw tables and simple fact look-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillview.functions.dates import TS, Anchor

STAGED = (
    "transaction_id", "user_id", "product_id", TS, "quantity", "unit_price", "total_amount", "discount_amount",
    "payment_method", "order_status",
)
STAGED_USER = (
    "user_id", "email", "persona", "customer_segment", "registration_date", "country", "age_group",
    "churn_risk_score",
)
EXPORTED = (
    "transaction_id", "user_id", "product_id", TS, "quantity", "unit_price", "total_amount", "payment_method",
)


def stg_transactions(transactions: DataFrame) -> DataFrame:
    """Typed rows with a user and a non-negative amount; a NULL amount fails the test too."""
    kept = transactions.filter(F.col("user_id").isNotNull() & (F.col("total_amount") >= 0))
    columns = [
        F.to_date(c).alias(c) if c == TS else F.col(c)
        for c in STAGED
        if c in transactions.columns
    ]
    return kept.select(*columns)


def stg_users(users: DataFrame) -> DataFrame:
    columns = [c for c in STAGED_USER if c in users.columns]
    return users.filter(F.col("user_id").isNotNull()).select(*columns)


def user_history(transactions: DataFrame, user_id: int, since) -> DataFrame:
    """One user's transactions from a date on, newest first."""
    return transactions.filter(
        (F.col("user_id") == user_id) & (F.col(TS) >= F.lit(str(since)).cast(transactions.schema[TS].dataType))
    ).orderBy(F.col(TS).desc(), F.col("transaction_id").desc())


def recent_star_rows(
    transactions: DataFrame, users: DataFrame, products: DataFrame, as_of=None, days: int = 7, limit: int = 1000
) -> DataFrame:
    """The newest rows of the last days with their user and product."""
    anchor = Anchor(transactions, as_of)
    order = [F.col(TS).desc(), F.col("transaction_id"), F.col("product_id"), F.col("total_amount")]
    known_users = users.select("user_id", "email")
    known_products = products.select("product_id", "product_name")
    return (
        transactions.filter(anchor.since(f"{days} DAYS"))
        .select("transaction_id", "user_id", "product_id", TS, "total_amount")
        .join(known_users, "user_id")
        .join(known_products, "product_id")
        .orderBy(*order)
        .limit(limit)
        .select("transaction_id", "email", "product_name", "total_amount")
    )


def export_transactions(transactions: DataFrame) -> DataFrame:
    """The eight exported columns with a month to partition the files by."""
    return transactions.select(*[F.to_date(c).alias(c) if c == TS else F.col(c) for c in EXPORTED]).withColumn(
        "txn_month", F.date_format(TS, "yyyy-MM")
    )
