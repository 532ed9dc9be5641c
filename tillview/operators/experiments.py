"""Eligibility, assignment and read-out of the churn discount experiment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillview.functions.dates import TS, Anchor
from tillview.functions.hashing import fnv1a32
from tillview.functions.numeric import ratio
from tillview.operators.tables import insert_if_absent

# Fixed values of the experiment.
EXPERIMENT_KEY = "churn-discount-v1"
ELIGIBLE_RISK = 0.6
CONTROL, DISCOUNT = "control", "discount_10pct"
DISCOUNT_PCT = 10
BUCKETS, CONTROL_BUCKETS = 1000, 500
CONVERSION_DAYS = 7
KEYS = ["user_id", "experiment_key"]


def ab_eligibility(users: DataFrame, threshold: float = ELIGIBLE_RISK) -> DataFrame:
    """A user without a risk score has risk 0."""
    risk = F.coalesce(F.col("churn_risk_score"), F.lit(0).cast("decimal(3,2)"))
    return users.select(
        "user_id", risk.alias("churn_risk"), (risk >= F.lit(threshold).cast("decimal(3,2)")).alias("eligible")
    )


def ab_assign(eligibility: DataFrame, experiment_key: str = EXPERIMENT_KEY) -> DataFrame:
    """Variant and offer per user. The variant follows from the id and the
    experiment alone, so it is the same on every run; the ineligible get none."""
    bucket = fnv1a32(F.concat(F.col("user_id").cast("string"), F.lit(experiment_key))) % BUCKETS
    variant = F.when(F.col("eligible"), F.when(bucket < CONTROL_BUCKETS, CONTROL).otherwise(DISCOUNT))
    shown = F.coalesce(F.col("variant") == DISCOUNT, F.lit(False))
    return eligibility.withColumns({"experiment_key": F.lit(experiment_key), "variant": variant}).withColumns(
        {"show_discount": shown, "discount_pct": F.when(shown, DISCOUNT_PCT).otherwise(0).cast("bigint")}
    )


def ab_assignments(offers: DataFrame, assigned_at) -> DataFrame:
    """Log rows for the users that are in the experiment."""
    return offers.filter(F.col("variant").isNotNull()).select(
        "user_id", "experiment_key", "variant", assigned_at.alias("assigned_at")
    )


def ab_log_sticky(log: DataFrame, new: DataFrame) -> DataFrame:
    """The log with new users added; whoever is in it keeps the first assignment."""
    return insert_if_absent(log, new, KEYS, order_by="assigned_at")


def ab_conversion(
    assignments: DataFrame, transactions: DataFrame, as_of=None, experiment_key: str = EXPERIMENT_KEY
) -> DataFrame:
    """Assigned and converted users per variant.

    Converted means a purchase from the assignment to 7 days after it, both
    ends included. The fact is first cut to the time span of the assignments.
    """
    kind = transactions.schema[TS].dataType
    assigned = assignments.filter(F.col("experiment_key") == experiment_key).select(
        "user_id", "variant", F.col("assigned_at").cast(kind).alias("assigned_at")
    )
    week = F.expr(f"INTERVAL {CONVERSION_DAYS} DAYS")
    span = assigned.agg(F.min("assigned_at").alias("first"), (F.max("assigned_at") + week).cast(kind).alias("last")).first()
    # as literals the bounds reach the scan of the fact
    first, last = (F.lit(None if x is None else str(x)).cast(kind) for x in span)
    sales = transactions.filter((F.col(TS) >= first) & (F.col(TS) <= last)).select(
        F.col("user_id").alias("buyer"), F.col(TS).alias("bought_at")
    )
    # the few assignments can be broadcast to the sales; if they are shuffled instead,
    # AQE can split a busy buyer's side of an inner join
    converted = (
        sales.join(assigned, F.col("buyer") == F.col("user_id"))
        .filter((F.col("bought_at") >= F.col("assigned_at")) & (F.col("bought_at") <= F.col("assigned_at") + week))
        .select("variant", "user_id")
    )
    counts = lambda df, name: df.groupBy("variant").agg(F.countDistinct("user_id").alias(name))
    return (
        counts(assigned, "assigned_users")
        .join(counts(converted, "converted_users"), "variant", "left")
        .fillna(0, ["converted_users"])
        .select(
            Anchor(transactions, as_of).date.alias("metric_date"),
            F.lit(experiment_key).alias("experiment_key"),
            "variant",
            "assigned_users",
            "converted_users",
            ratio("converted_users", "assigned_users", 4).alias("conversion_rate"),
        )
    )


def ab_summary(metrics: DataFrame, assignments: DataFrame, as_of, experiment_key: str = EXPERIMENT_KEY) -> DataFrame:
    """The day's metrics per variant with the total of assignments; empty without any."""
    day = F.to_date(as_of if hasattr(as_of, "cast") else F.lit(str(as_of)))
    total = assignments.filter(F.col("experiment_key") == experiment_key).agg(F.count("*")).scalar()
    return (
        metrics.filter((F.col("experiment_key") == experiment_key) & (F.col("metric_date") == day))
        .withColumn("total_assignments", total)
        .filter(F.col("total_assignments") > 0)
        .select(
            "variant",
            "assigned_users",
            "converted_users",
            (F.coalesce("conversion_rate", F.lit(0)) * 100).alias("rate_pct"),
            "total_assignments",
        )
    )


def ab_results(assignments: DataFrame, metrics: DataFrame, experiment_key: str = EXPERIMENT_KEY) -> DataFrame:
    """Assignment counts per variant, followed by the four latest metric rows."""
    ours = F.col("experiment_key") == experiment_key
    counts = assignments.filter(ours).groupBy("variant").agg(F.count("*").alias("assigned_users"))
    latest = (
        metrics.filter(ours)
        .orderBy(F.col("metric_date").desc(), "variant")
        .limit(4)
        .select(
            F.lit("metric").alias("kind"),
            "metric_date",
            "variant",
            "assigned_users",
            "converted_users",
            "conversion_rate",
        )
    )
    return counts.withColumn("kind", F.lit("assignment")).unionByName(latest, allowMissingColumns=True)
