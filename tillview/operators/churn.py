"""Churn features, rule-based scores and the training set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillview.functions.dates import TS, Anchor
from tillview.functions.numeric import mean, ratio
from tillview.operators.customers import equal_width_histogram

# The model's features, in the order of its input vector.
FEATURES = [
    "recency_days",
    "frequency",
    "monetary",
    "avg_order_value",
    "tenure_days",
    "purchase_velocity",
    "recency_ratio",
]
FULL_RISK_DAYS = 365
SAFE_ORDERS = 20
LABEL_WINDOW_DAYS = 30
HIGH_RISK, MEDIUM_RISK = 0.7, 0.4
NO_FACTOR = "Insufficient purchase history"


def mart_churn_features(staged: DataFrame, as_of=None) -> DataFrame:
    """Seven features per buyer; without tenure the velocity is 0 and the ratio 1."""
    anchor = Anchor(staged, as_of)
    tenured = F.col("tenure_days") > 0
    return (
        staged.groupBy("user_id")
        .agg(
            anchor.days_since(F.max(TS)).alias("recency_days"),
            F.countDistinct("transaction_id").alias("frequency"),
            F.sum("total_amount").cast("decimal(14,2)").alias("monetary"),
            ratio(F.sum("total_amount"), F.count("total_amount"), 2).alias("avg_order_value"),
            anchor.days_since(F.min(TS)).alias("tenure_days"),
            F.max(TS).alias("last_purchase_date"),
            F.min(TS).alias("first_purchase_date"),
        )
        .withColumn("purchase_velocity", F.when(tenured, ratio("frequency", "tenure_days", 6)).otherwise(F.lit(0)))
        .withColumn("recency_ratio", F.when(tenured, ratio("recency_days", "tenure_days", 4)).otherwise(F.lit(1)))
    )


def risk_score() -> Column:
    """``recency / 365 * (1 - min(1, frequency / 20))``, rounded and at most 1.

    Written over the common denominator, so the rounding sees the exact value.
    """
    missing_orders = F.lit(SAFE_ORDERS) - F.least(F.col("frequency"), F.lit(SAFE_ORDERS))
    exact = ratio(F.col("recency_days") * missing_orders, F.lit(FULL_RISK_DAYS * SAFE_ORDERS), 2)
    return F.least(exact, F.lit(1).cast("decimal(3,2)")).cast("decimal(3,2)")


def churn_risk_score(features: DataFrame) -> DataFrame:
    return features.select("user_id", "recency_days", "frequency", risk_score().alias("churn_risk_score"))


def risk_label(probability: Column) -> Column:
    return F.when(probability >= HIGH_RISK, "High").when(probability >= MEDIUM_RISK, "Medium").otherwise("Low")


def heuristic_probability() -> Column:
    """60 % silence of up to a year, 40 % orders missing to twenty."""
    silence = F.least(F.col("recency_days"), F.lit(FULL_RISK_DAYS))
    missing_orders = F.lit(SAFE_ORDERS) - F.least(F.col("frequency"), F.lit(SAFE_ORDERS))
    # 0.6 * silence / 365 + 0.4 * missing / 20 over the denominator 10 * 365 * 20
    weighted = 6 * SAFE_ORDERS * silence + 4 * FULL_RISK_DAYS * missing_orders
    return ratio(weighted, F.lit(10 * FULL_RISK_DAYS * SAFE_ORDERS), 4)


def churn_heuristic(features: DataFrame) -> DataFrame:
    return features.select("user_id", heuristic_probability().alias("churn_probability")).withColumn(
        "churn_risk_label", risk_label(F.col("churn_probability"))
    )


def rule_factors() -> Column:
    spend = F.round("monetary", 0).cast("bigint")
    # fixed values: the explanation texts
    reasons = F.array(
        F.when(
            F.col("recency_days") > 90,
            F.concat(F.lit("High recency — "), F.col("recency_days").cast("bigint"), F.lit(" days since last purchase")),
        ),
        F.when(
            F.col("frequency") < 3,
            F.concat(F.lit("Low frequency — only "), F.col("frequency").cast("bigint"), F.lit(" orders")),
        ),
        F.when(F.col("monetary") < 100, F.concat(F.lit("Low total spend — $"), spend)),
    )
    present = F.slice(F.array_compact(reasons), 1, 2)
    return F.when(F.size(present) > 0, present).otherwise(F.array(F.lit(NO_FACTOR)))


def churn_rule_factors(features: DataFrame) -> DataFrame:
    """Up to two reasons per user."""
    return features.select("user_id", rule_factors().alias("top_risk_factors"))


def churn_feature_prep(metrics: DataFrame) -> DataFrame:
    """The model's features from user totals.

    Tenure is the given one, else the span from first to last purchase, else a
    guess of 30 days per order; it is at least 1. Missing totals get defaults.
    """
    given = lambda c, default: F.coalesce(F.col(c).cast("double"), F.lit(float(default))).alias(c)
    tenures = []
    if "tenure_days" in metrics.columns:
        tenures.append(F.greatest(F.col("tenure_days").cast("double"), F.lit(1.0)))
    if {"first_purchase_date", "last_purchase_date"} <= set(metrics.columns):
        span = F.datediff(F.to_date("last_purchase_date"), F.to_date("first_purchase_date")).cast("double")
        tenures.append(F.when(span.isNotNull(), F.greatest(span, F.lit(1.0))))
    guess = F.greatest(F.col("frequency") * 30, F.col("recency_days"), F.lit(1.0))
    carried = [c for c in ("tenure_days", "first_purchase_date", "last_purchase_date", "churned") if c in metrics.columns]
    return (
        metrics.select(
            "user_id",
            given("recency_days", 365),
            given("frequency", 1),
            given("monetary", 0),
            given("avg_order_value", 0),
            *carried,
        )
        .withColumn("tenure_days", F.coalesce(*tenures, guess))
        .withColumn("purchase_velocity", F.col("frequency") / F.col("tenure_days"))
        .withColumn("recency_ratio", F.col("recency_days") / F.col("tenure_days"))
        .select("user_id", *FEATURES, *[c for c in carried if c == "churned"])
    )


def churn_features_at(transactions: DataFrame, snapshot, *extra) -> DataFrame:
    """The model's features of every buyer as known at the end of a day.

    Training and scoring both read their features here, from the same kind of fact, so
    they mean the same. ``extra`` aggregates ride along in the one pass over the fact.
    """
    day = F.to_date(TS)
    before = day <= snapshot
    per_user = transactions.groupBy("user_id").agg(
        F.max(F.when(before, day)).alias("last_day"),
        F.min(F.when(before, day)).alias("first_day"),
        F.countDistinct(F.when(before, F.col("transaction_id"))).alias("frequency"),
        F.sum(F.when(before, F.col("total_amount"))).cast("double").alias("monetary"),
        mean(F.when(before, F.col("total_amount"))).alias("avg_order_value"),
        *extra,
    )
    return (
        per_user.filter(F.col("frequency") >= 1)
        .withColumn("recency_days", F.datediff(snapshot, F.col("last_day")).cast("bigint"))
        .withColumn("tenure_days", F.greatest(F.datediff(snapshot, F.col("first_day")), F.lit(1)).cast("bigint"))
        .withColumn("purchase_velocity", F.col("frequency").cast("double") / F.col("tenure_days"))
        .withColumn("recency_ratio", F.col("recency_days").cast("double") / F.col("tenure_days"))
        .drop("last_day", "first_day")
    )


def churn_scoring_set(transactions: DataFrame, as_of=None) -> DataFrame:
    """The features of every buyer as of the newest day."""
    return churn_features_at(transactions, Anchor(transactions, as_of).date).select("user_id", *FEATURES)


def churn_training_set(
    transactions: DataFrame, as_of=None, window_days: int = LABEL_WINDOW_DAYS
) -> DataFrame:
    """Features up to a snapshot and a label from the days after it.

    The snapshot lies ``window_days`` before the newest transaction; a user
    churned when nothing follows within the window. Features and label come
    out of one aggregate, so the fact is shuffled once.
    """
    snapshot = F.date_sub(Anchor(transactions, as_of).date, window_days)
    day = F.to_date(TS)
    after = (day > snapshot) & (day <= F.date_add(snapshot, window_days))
    return (
        churn_features_at(transactions, snapshot, F.max(F.when(after, 1)).alias("returned"))
        .withColumn("churned", F.when(F.col("returned").isNull(), 1).otherwise(0).cast("bigint"))
        .select("user_id", *FEATURES, "churned")
    )


def at_risk_scores(scores: DataFrame, metrics: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The scores of all known users above the threshold."""
    return (
        scores.filter(F.col("churn_risk_score") > F.lit(threshold).cast("decimal(3,2)"))
        .select("user_id", "churn_risk_score")
        .join(metrics.select("user_id"), "user_id", "left_semi")
    )


def at_risk_customers(
    scores: DataFrame, metrics: DataFrame, page: int = 1, page_size: int = 20, threshold: float = 0.7
) -> DataFrame:
    """One page of users above the threshold, riskiest first.

    The page is cut on the scores alone; only its rows are looked up.
    """
    ranked = (
        at_risk_scores(scores, metrics, threshold)
        .orderBy(F.col("churn_risk_score").desc(), "user_id")
        .offset((page - 1) * page_size)
        .limit(page_size)
    )
    return ranked.join(
        metrics.select("user_id", "email", "recency_days", "frequency", "monetary"), "user_id"
    )


def churn_histogram(at_risk: DataFrame, bins: int = 20) -> DataFrame:
    return equal_width_histogram(at_risk, "churn_risk_score", bins)
