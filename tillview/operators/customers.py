"""RFM scores and segments, lifetime value and customer rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillview.functions.dates import TS, Anchor
from tillview.functions.hashing import fnv1a32
from tillview.functions.numeric import mean, mean_of_sums, ratio
from tillview.functions.ranks import Target, exact_percentiles, find_ranks, with_ntiles
from tillview.sources.scratch import materialize

NEVER_BOUGHT_DAYS = 9999

# The reports' action texts per segment.
SEGMENT_ACTIONS = {
    "Champions": "Reward, Upsell premium products",
    "Loyal Customers": "Upsell, Ask for reviews",
    "Potential Loyalists": "Offer membership, Recommend products",
    "New Customers": "Provide onboarding support",
    "Promising": "Offer loyalty programs",
    "Need Attention": "Limited time offers",
    "About to Sleep": "Engagement campaigns",
    "At Risk": "Win-back campaigns, Special discounts",
    "Cannot Lose Them": "Personalized reactivation offers",
    "Hibernating": "Re-engagement emails",
    "Lost": "Aggressive win-back or ignore",
}
DEFAULT_ACTION = "Monitor"
NEXT_ACTIONS = {
    "Champions": "Send exclusive VIP offer",
    "At Risk": "Send 20% win-back coupon",
    "New Customers": "Send welcome series email",
    "Lost": "Final win-back attempt or suppress",
}
DEFAULT_NEXT_ACTION = "Standard marketing"

# Fixed values: (segment, lowest r, highest r, lowest f, highest f, lowest m), first match wins.
MART_RULES = [
    ("Champions", 4, 5, 4, 5, 4),
    ("Loyal Customers", 3, 5, 4, 5, 1),
    ("Potential Loyalists", 4, 5, 3, 5, 1),
    ("New Customers", 4, 5, 1, 2, 1),
    ("Promising", 3, 5, 1, 5, 4),
    ("Need Attention", 3, 5, 3, 5, 1),
    ("At Risk", 1, 2, 4, 5, 4),
    ("Cannot Lose Them", 1, 1, 4, 5, 4),
    ("About to Sleep", 1, 2, 3, 5, 1),
    ("Hibernating", 1, 2, 1, 2, 1),
    ("Lost", 1, 1, 1, 5, 1),
]
# The older report's order, which asks for About to Sleep before At Risk.
CLASSIC_RULES = [
    ("Champions", 4, 5, 4, 5, 4),
    ("Loyal Customers", 3, 5, 4, 5, 1),
    ("Potential Loyalists", 4, 5, 3, 5, 1),
    ("New Customers", 4, 5, 1, 2, 1),
    ("Promising", 3, 5, 1, 5, 4),
    ("Need Attention", 3, 5, 3, 5, 1),
    ("About to Sleep", 1, 2, 3, 5, 1),
    ("At Risk", 1, 2, 4, 5, 4),
    ("Cannot Lose Them", 1, 1, 4, 5, 4),
    ("Hibernating", 1, 2, 1, 2, 1),
    ("Lost", 1, 1, 1, 5, 1),
]
FALLBACK_SEGMENT = "Other"


def user_metrics(users: DataFrame, transactions: DataFrame, as_of=None) -> DataFrame:
    """Purchase totals of every user, buyer or not.

    The fact is reduced to one row per user before it meets the users.
    """
    anchor = Anchor(transactions, as_of)
    items = [F.sum("quantity").alias("items")] if "quantity" in transactions.columns else []
    # one row per order first: the distinct counts then see no order lines
    orders = transactions.groupBy("user_id", "transaction_id", F.to_date(TS).alias("day")).agg(
        F.max(TS).alias("last"),
        F.min(TS).alias("first"),
        F.sum("total_amount").alias("spent"),
        F.count("total_amount").alias("amounts"),
        *items,
    )
    counted = ["frequency", "monetary", "avg_order_value", "purchase_days", "total_items_purchased"]
    bought = orders.groupBy("user_id").agg(
        F.max("last").alias("last_purchase_date"),
        F.min("first").alias("first_purchase_date"),
        F.countDistinct("transaction_id").alias("frequency"),
        F.sum("spent").alias("monetary"),
        mean_of_sums("spent", "amounts").alias("avg_order_value"),
        F.countDistinct("day").alias("purchase_days"),
        *([F.sum("items").alias("total_items_purchased")] if items else []),
    )
    labels = [c for c in ("customer_segment",) if c in users.columns]
    return (
        users.select("user_id", "email", *labels)
        .join(bought, "user_id", "left")
        .withColumn(
            "recency_days", F.coalesce(anchor.days_since(F.col("last_purchase_date")), F.lit(NEVER_BOUGHT_DAYS))
        )
        .withColumns({c: F.coalesce(c, F.lit(0)) for c in counted if c in bought.columns})
    )


def rfm_base(users: DataFrame, transactions: DataFrame, as_of=None) -> DataFrame:
    """Recency, frequency and spend of every user."""
    anchor = Anchor(transactions, as_of)
    bought = transactions.groupBy("user_id").agg(
        F.max(TS).alias("last_purchase"),
        F.countDistinct("transaction_id").alias("frequency"),
        F.sum("total_amount").alias("monetary"),
    )
    return (
        users.join(bought, "user_id", "left")
        .withColumn("recency_days", F.coalesce(anchor.days_since(F.col("last_purchase")), F.lit(NEVER_BOUGHT_DAYS)))
        .withColumn("frequency", F.coalesce("frequency", F.lit(0)))
        .withColumn("monetary", F.coalesce("monetary", F.lit(0)))
        .drop("last_purchase")
    )


def score_rfm(base: DataFrame) -> DataFrame:
    """Quintile scores, 5 is best; ties are cut by user_id."""
    return with_ntiles(
        base,
        {"r_score": -F.col("recency_days"), "f_score": F.col("frequency"), "m_score": F.col("monetary")},
        id_column="user_id",
    )


def segment_of(rules: list[tuple] = MART_RULES) -> Column:
    r, f, m = F.col("r_score"), F.col("f_score"), F.col("m_score")
    label = F.lit(FALLBACK_SEGMENT)
    for name, r_low, r_high, f_low, f_high, m_low in reversed(rules):
        label = F.when(r.between(r_low, r_high) & f.between(f_low, f_high) & (m >= m_low), name).otherwise(label)
    return label


def look_up(key: Column, choices: dict[str, str], default: str) -> Column:
    label = F.lit(default)
    for name, text in choices.items():
        label = F.when(key == name, text).otherwise(label)
    return label


def int_rfm_scores(staged: DataFrame, as_of=None) -> DataFrame:
    """RFM values and scores of buyers, from staged transactions."""
    anchor = Anchor(staged, as_of)
    base = staged.groupBy("user_id").agg(
        anchor.days_since(F.max(TS)).alias("recency_days"),
        F.countDistinct("transaction_id").alias("frequency"),
        F.sum("total_amount").alias("monetary"),
        mean("total_amount").alias("avg_order_value"),
        ratio(F.sum("total_amount"), F.count("total_amount"), 2).alias("rounded_order_value"),
        F.min(TS).alias("first_purchase_date"),
        F.max(TS).alias("last_purchase_date"),
    )
    return score_rfm(base)


def mart_rfm_segments(scores: DataFrame) -> DataFrame:
    return scores.select(
        "user_id",
        "recency_days",
        "frequency",
        F.col("monetary").cast("decimal(14,2)").alias("monetary"),
        F.col("rounded_order_value").alias("avg_order_value"),
        "r_score",
        "f_score",
        "m_score",
        segment_of().alias("customer_segment"),
    )


def rfm_segment_summary(base: DataFrame, rules: list[tuple] = MART_RULES) -> DataFrame:
    """Size, averages, revenue and action per segment, over all users of :func:`rfm_base`."""
    segments = score_rfm(base.select("user_id", "recency_days", "frequency", "monetary")).withColumn(
        "customer_segment", segment_of(rules)
    )
    counted = F.count("*")
    return (
        segments.groupBy("customer_segment")
        .agg(
            counted.alias("customer_count"),
            ratio(F.sum("recency_days"), counted, 0).cast("bigint").alias("avg_recency_days"),
            ratio(F.sum("frequency"), counted, 2).alias("avg_frequency"),
            ratio(F.sum("monetary"), counted, 2).alias("avg_monetary"),
            F.sum("monetary").alias("total_revenue"),
        )
        # the window sees one row per segment
        .withColumn(
            "segment_percentage",
            ratio("customer_count", F.sum("customer_count").over(Window.partitionBy()), 2, times=100),
        )
        .withColumn("recommended_action", look_up(F.col("customer_segment"), SEGMENT_ACTIONS, DEFAULT_ACTION))
        .orderBy(F.col("total_revenue").desc(), "customer_segment")
    )


def rfm_segment_summary_classic(base: DataFrame) -> DataFrame:
    return rfm_segment_summary(base, CLASSIC_RULES)


def rfm_user_details(base: DataFrame, limit: int = 100) -> DataFrame:
    """Top spenders with scores, profile and next action.

    Scores need every user; the profile columns are carried along only for the
    rows that make the list.
    """
    scored = score_rfm(base.select("user_id", "recency_days", "frequency", "monetary"))
    top = scored.orderBy(F.col("monetary").desc(), "user_id").limit(limit)
    profile = base.select("user_id", "email", "registration_date", "country", "age_group")
    return (
        top.join(profile, "user_id")
        .withColumn("rfm_score", F.concat("r_score", "f_score", "m_score"))
        .withColumn("customer_segment", segment_of(CLASSIC_RULES))
        .withColumn("next_action", look_up(F.col("customer_segment"), NEXT_ACTIONS, DEFAULT_NEXT_ACTION))
    )


def rfm_percentile_scores(metrics: DataFrame) -> DataFrame:
    """Scores from the 20/40/60/80 % edges of buyers; recency is reversed."""
    names = {"recency_days": "r_score", "frequency": "f_score", "monetary": "m_score"}
    buyers = metrics.filter(F.col("frequency") > 0)
    edges = exact_percentiles(buyers, list(names), [0.2, 0.4, 0.6, 0.8])

    def score(column: str) -> Column:
        above = F.lit(1)
        for edge in edges[column]:
            above = above + (F.col(column).cast("double") > F.lit(edge)).cast("int")
        return (6 - above if column == "recency_days" else above).cast("bigint")

    return metrics.select("user_id", *names, *[score(c).alias(n) for c, n in names.items()])


def rfm_breakpoints(metrics: DataFrame, bins: int = 5) -> DataFrame:
    """Quantile bin edges of the buyers' recency, frequency and spend, one row per edge."""
    features = ["recency_days", "frequency", "monetary"]
    edges = exact_percentiles(metrics.filter(F.col("frequency") > 0), features, [i / bins for i in range(bins + 1)])
    rows = [(f, i, round(e, 4)) for f in features for i, e in enumerate(edges[f]) if e is not None]
    return metrics.sparkSession.createDataFrame(rows, "feature string, edge bigint, value double")


def top_customers(metrics: DataFrame, limit: int = 50) -> DataFrame:
    """Highest lifetime value with its place and recency; the segment is shown if the users carry one."""
    place = Window.orderBy(F.col("monetary").desc(), "user_id")
    segment = [c for c in ("customer_segment",) if c in metrics.columns]
    return (
        metrics.orderBy(F.col("monetary").desc(), "user_id")
        .limit(limit)
        # the window sees the rows of the list only
        .withColumn("place", F.row_number().over(place).cast("bigint"))
        .select(
            "place",
            "user_id",
            *segment,
            "email",
            F.col("monetary").alias("lifetime_value"),
            F.col("frequency").alias("total_purchases"),
            "recency_days",
            F.to_date("last_purchase_date").alias("last_purchase_date"),
        )
    )


def ltv_leaderboard(transactions: DataFrame, users: DataFrame, as_of=None, limit: int = 100) -> DataFrame:
    """Top buyers; only the rows that make the list are joined to the users."""
    anchor = Anchor(transactions, as_of)
    known = users.select("user_id")
    top = (
        transactions.groupBy("user_id")
        .agg(
            F.count("transaction_id").alias("total_purchases"),
            F.sum("total_amount").alias("lifetime_value"),
            F.max(TS).alias("last_purchase_date"),
        )
        .join(known, "user_id", "left_semi")
        .orderBy(F.col("lifetime_value").desc(), "user_id")
        .limit(limit)
    )
    return top.join(users.select("user_id", "email", "registration_date"), "user_id").withColumn(
        "days_since_last_purchase", anchor.days_since(F.col("last_purchase_date"))
    )


def lifetime_values(metrics: DataFrame) -> DataFrame:
    """The lifetime value of every buyer."""
    return metrics.filter(F.col("frequency") > 0).select("user_id", F.col("monetary").alias("lifetime_value"))


def ltv_quartiles(buyers: DataFrame) -> DataFrame:
    """Quartiles of the non-zero lifetime values."""
    values = buyers.filter(F.col("lifetime_value") != 0)
    q1, median, q3 = exact_percentiles(values, ["lifetime_value"], [0.25, 0.5, 0.75])["lifetime_value"]
    return buyers.sparkSession.createDataFrame([(q1, median, q3)], "q1 double, median double, q3 double")


def equal_width_histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Rows per equal-width bin between the smallest and largest value."""
    value = F.col(column).cast("double")
    df = materialize(df.select(column), "histogram")
    bounds = df.agg(F.min(value).alias("low"), F.max(value).alias("high")).first()
    low, high = F.lit(bounds["low"]).cast("double"), F.lit(bounds["high"]).cast("double")
    # the largest value belongs to the last bin
    position = F.when(high == low, F.lit(0.0)).otherwise((value - low) / F.nullif(high - low, F.lit(0.0)))
    bin_index = F.least(F.floor(position * bins), F.lit(bins - 1)).cast("bigint")
    return (
        df.filter(value.isNotNull())
        .groupBy(bin_index.alias("bin"))
        .agg(F.count("*").alias("customers"))
        .withColumn("bin_start", low + F.col("bin") * ((high - low) / bins))
    )


def ltv_histogram(buyers: DataFrame, bins: int = 30) -> DataFrame:
    return equal_width_histogram(buyers.filter(F.col("lifetime_value") != 0), "lifetime_value", bins)


def ltv_concentration(buyers: DataFrame) -> DataFrame:
    """Share of lifetime value held by the best fifth of the buyers.

    The value at the cut comes from the rank search: what lies above it counts whole,
    and the rows that share it fill up the fifth.
    """
    table = materialize(buyers.filter(F.col("lifetime_value").isNotNull()).select("lifetime_value"), "values")
    size = table.count()
    kept = max(1, size // 5)
    value = F.col("lifetime_value")
    cut = find_ranks(table, [Target("cut", value, size - kept, size)], "decimal(18,2)")["cut"] if size else None
    edge = F.lit(str(cut.value if cut else 0)).cast("decimal(18,2)")
    above = size - cut.before - cut.ties if cut else 0
    held = F.coalesce(F.sum(F.when(value > edge, value)), F.lit(0)) + edge * F.lit(kept - above)
    total = F.sum(value).cast("double")
    return table.agg(F.coalesce(F.try_divide(held.cast("double"), total) * 100, F.lit(0.0)).alias("top20_pct"))


def segment_radar(summary: DataFrame, limit: int = 6) -> DataFrame:
    """Top segments by revenue on three axes scaled to 0..1; low recency is good."""
    shown = Window.partitionBy()

    def scaled(column: str) -> Column:
        value = F.col(column).cast("double")
        low, high = F.min(value).over(shown), F.max(value).over(shown)
        return (value - low) / (high - low + F.lit(1e-9))

    return (
        summary.orderBy(F.col("total_revenue").desc(), "customer_segment")
        .limit(limit)
        .select(
            "customer_segment",
            (1 - scaled("avg_recency_days")).alias("recency"),
            scaled("avg_frequency").alias("frequency"),
            scaled("avg_monetary").alias("spend"),
        )
    )


def top_segment(summary: DataFrame) -> DataFrame:
    return (
        summary.orderBy(F.col("total_revenue").desc(), "customer_segment")
        .limit(1)
        .select("customer_segment", "total_revenue", "customer_count", "recommended_action")
    )


def rfm_scatter(metrics: DataFrame, limit: int = 500, seed: int = 42) -> DataFrame:
    """Reproducible random sample of buyers with a bubble size of 6 to 40."""
    shown = Window.partitionBy()
    value = F.col("monetary").cast("double")
    low, high = F.min(value).over(shown), F.max(value).over(shown)
    bubble = F.when(high > low, 6 + 34 * (value - low) / F.nullif(high - low, F.lit(0.0))).otherwise(12.0)
    draw = fnv1a32(F.concat_ws("-", F.col("user_id"), F.lit(seed)))
    labels = [c for c in ("customer_segment",) if c in metrics.columns]
    return (
        metrics.filter(F.col("frequency") > 0)
        .orderBy(draw, "user_id")
        .limit(limit)
        .select(
            "user_id", *labels, "recency_days", "frequency", "monetary", F.col("monetary").alias("lifetime_value"), bubble.alias("bubble")
        )
    )
