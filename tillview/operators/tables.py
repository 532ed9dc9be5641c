"""Keyed maintenance of derived tables: upsert, first write wins, write-backs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillview.functions.dates import TS, Anchor
from tillview.operators.churn import risk_score


def one_per_key(batch: DataFrame, keys: list[str], order_by: str | None, newest: bool) -> DataFrame:
    """One row per key, by a map-side combined aggregate and not by a sort of the group."""
    rest = [c for c in batch.columns if c not in keys]
    row = F.struct(*rest)
    # the row itself breaks ties, so the choice does not depend on the order of arrival
    rank = F.struct(*([order_by] if order_by else []), *rest)
    pick = F.max_by(row, rank) if newest else F.min_by(row, rank)
    return batch.groupBy(*keys).agg(pick.alias("picked")).select(*keys, "picked.*").select(*batch.columns)


def upsert_by_key(target: DataFrame, batch: DataFrame, keys: list[str], order_by: str | None = None) -> DataFrame:
    """Rows of the batch replace those with the same key. Among several in the
    batch the newest by ``order_by`` counts."""
    latest = one_per_key(batch, keys, order_by, newest=True)
    return target.join(latest.select(*keys), keys, "left_anti").unionByName(latest.select(*target.columns))


def insert_if_absent(target: DataFrame, batch: DataFrame, keys: list[str], order_by: str | None = None) -> DataFrame:
    """Rows of the batch with a new key are added; the first by ``order_by`` counts."""
    first = one_per_key(batch, keys, order_by, newest=False)
    return target.unionByName(first.join(target.select(*keys), keys, "left_anti").select(*target.columns))


def apply_rfm_to_users(users: DataFrame, segments: DataFrame) -> DataFrame:
    """Users with the segment of the mart; who is not in the mart keeps the old one."""
    fresh = segments.select("user_id", F.col("customer_segment").alias("new_segment"))
    return (
        users.join(fresh, "user_id", "left")
        .withColumn("customer_segment", F.coalesce("new_segment", "customer_segment"))
        .drop("new_segment")
    )


def apply_churn_to_users(users: DataFrame, features: DataFrame) -> DataFrame:
    """Users with the risk score of their features; others keep the old one."""
    fresh = features.select("user_id", risk_score().alias("new_risk"))
    return (
        users.join(fresh, "user_id", "left")
        .withColumn("churn_risk_score", F.coalesce("new_risk", "churn_risk_score"))
        .drop("new_risk")
    )


def apply_snapshot_to_log(log: DataFrame, snapshot: DataFrame, as_of=None) -> DataFrame:
    """Upsert yesterday's row of the daily snapshot."""
    anchor = Anchor(snapshot, as_of, "report_date")
    yesterday = snapshot.filter(F.col("report_date") == F.date_sub(anchor.date, 1))
    return upsert_by_key(log, yesterday, ["report_date"])


def user_totals(transactions: DataFrame) -> DataFrame:
    """Lifetime value, last purchase date and purchase count per user."""
    return transactions.filter(F.col("user_id").isNotNull()).groupBy("user_id").agg(
        F.coalesce(F.sum("total_amount"), F.lit(0)).alias("lifetime_value"),
        F.to_date(F.max(TS)).alias("last_purchase_date"),
        F.count("*").alias("total_purchases"),
    )
