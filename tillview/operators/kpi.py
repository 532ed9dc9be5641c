"""Live and daily KPIs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillview.functions.dates import TS, Anchor
from tillview.functions.numeric import distinct_if, mean, mean_of_sums, money_ratio, ratio, sum_if



def realtime_kpi(transactions: DataFrame, as_of=None) -> DataFrame:
    """The last hour in one row; zeros when nothing happened."""
    zero = F.lit(0)
    return transactions.filter(Anchor(transactions, as_of).since("1 HOUR")).agg(
        F.countDistinct("user_id").alias("active_users"),
        F.countDistinct("transaction_id").alias("transactions"),
        F.coalesce(F.sum("total_amount"), zero).alias("revenue"),
        F.coalesce(mean("total_amount"), zero).alias("avg_order_value"),
        F.countDistinct("session_id").alias("sessions"),
        F.coalesce(F.sum("quantity"), zero).alias("items_sold"),
    )


def today_vs_yesterday(transactions: DataFrame, as_of=None) -> DataFrame:
    """Users, transactions and revenue of both days and the change in percent.

    One conditional aggregate over two days of the fact. A change against an
    empty day is 0.
    """
    anchor = Anchor(transactions, as_of)
    days = {"today": anchor.on_day(0), "yesterday": anchor.on_day(1)}
    both = transactions.filter(anchor.since_day(1) & (F.col(TS) < anchor.midnight(-1)))
    aggregates = []
    for day, condition in days.items():
        aggregates += [
            distinct_if(condition, "user_id").alias(f"{day}_users"),
            F.count_if(condition).alias(f"{day}_transactions"),
            F.coalesce(sum_if(condition, "total_amount"), F.lit(0)).alias(f"{day}_revenue"),
        ]
    changes = {
        "user_change_pct": ratio(F.col("today_users") - F.col("yesterday_users"), "yesterday_users", 2, times=100),
        "transaction_change_pct": ratio(
            F.col("today_transactions") - F.col("yesterday_transactions"), "yesterday_transactions", 2, times=100
        ),
        "revenue_change_pct": money_ratio(
            F.col("today_revenue") - F.col("yesterday_revenue"), "yesterday_revenue", 2, times=100
        ),
    }
    return both.agg(*aggregates).withColumns({n: F.coalesce(c, F.lit(0)) for n, c in changes.items()})


def revenue_momentum(comparison: DataFrame, threshold_pct: float = 5.0) -> DataFrame:
    """Label of the revenue change: up, down or flat."""
    change = F.col("revenue_change_pct")
    label = F.when(change > threshold_pct, "up").when(change < -threshold_pct, "down").otherwise("flat")
    return comparison.select("revenue_change_pct", label.alias("momentum"))


def hourly_trend(transactions: DataFrame, as_of=None, hours: int = 24) -> DataFrame:
    return (
        transactions.filter(Anchor(transactions, as_of).since(f"{hours} HOURS"))
        .groupBy(F.date_trunc("hour", TS).alias("hour"))
        .agg(
            F.countDistinct("user_id").alias("active_users"),
            F.count("*").alias("transactions"),
            F.sum("total_amount").alias("revenue"),
            mean("total_amount").alias("avg_order_value"),
        )
        .orderBy(F.col("hour").desc())
    )


def daily_metrics(transactions: DataFrame) -> DataFrame:
    """Daily pre-aggregate.

    ``new_customers`` counts every buyer of the day, which is what the original
    view computes; ``first_time_customers`` counts those who never bought before.
    """
    # one row per order first: the distinct counts then see no order lines
    orders = transactions.groupBy(F.to_date(TS).alias("metric_date"), "user_id", "transaction_id", "session_id").agg(
        F.sum("total_amount").alias("revenue"),
        F.count("total_amount").alias("amounts"),
        F.sum("quantity").alias("items"),
        F.sum("discount_amount").alias("discounts"),
    )
    by_day = (
        orders.groupBy("metric_date")
        .agg(
            F.countDistinct("user_id").alias("daily_active_users"),
            F.countDistinct("transaction_id").alias("total_transactions"),
            F.sum("revenue").alias("total_revenue"),
            mean_of_sums("revenue", "amounts").alias("avg_order_value"),
            F.sum("items").alias("total_items_sold"),
            F.countDistinct("session_id").alias("total_sessions"),
            F.sum("discounts").alias("total_discounts"),
        )
        .withColumn("new_customers", F.col("daily_active_users"))
    )
    first_days = (
        transactions.groupBy("user_id")
        .agg(F.to_date(F.min(TS)).alias("metric_date"))
        .filter(F.col("user_id").isNotNull())
        .groupBy("metric_date")
        .agg(F.count("*").alias("first_time_customers"))
    )
    return by_day.join(first_days, "metric_date", "left").fillna(0, ["first_time_customers"])


def daily_kpis(daily: DataFrame, as_of=None, days: int = 30) -> DataFrame:
    """The last days of :func:`daily_metrics`, newest first."""
    anchor = Anchor(daily, as_of, "metric_date")
    return (
        daily.filter(anchor.since_day(days))
        .select(
            F.col("metric_date").alias("date"),
            F.col("total_revenue").alias("revenue"),
            F.col("total_transactions").alias("transactions"),
            F.col("daily_active_users").alias("active_users"),
            "avg_order_value",
            F.col("total_items_sold").alias("items_sold"),
        )
        .orderBy(F.col("date").desc())
    )


def mart_daily_snapshot(staged: DataFrame) -> DataFrame:
    orders = staged.groupBy(F.col(TS).alias("report_date"), "user_id", "transaction_id").agg(
        F.sum("total_amount").alias("revenue"), F.count("total_amount").alias("amounts")
    )
    return orders.groupBy("report_date").agg(
        F.countDistinct("user_id").alias("total_users"),
        F.countDistinct("transaction_id").alias("total_transactions"),
        F.round(F.sum("revenue"), 2).cast(_sum_type(staged)).alias("total_revenue"),
        ratio(F.sum("revenue"), F.sum("amounts"), 2).alias("avg_order_value"),
    )


def _sum_type(staged: DataFrame):
    """The type that one sum of the amounts has."""
    return staged.select(F.round(F.sum("total_amount"), 2)).schema[0].dataType


def daily_volume(transactions: DataFrame, as_of=None, days: int = 90) -> DataFrame:
    return (
        transactions.filter(Anchor(transactions, as_of).since_day(days))
        .groupBy(F.to_date(TS).alias("date"))
        .agg(F.count("*").alias("transactions"), F.sum("total_amount").alias("revenue"))
    )


def today_summary(transactions: DataFrame, as_of=None) -> DataFrame:
    return transactions.filter(Anchor(transactions, as_of).on_day(0)).agg(
        F.count("*").alias("transactions"),
        F.coalesce(F.sum("total_amount"), F.lit(0)).alias("revenue"),
        F.coalesce(mean("total_amount"), F.lit(0)).alias("avg_order_value"),
    )


def notify_summary(transactions: DataFrame, report_log: DataFrame, as_of=None) -> DataFrame:
    """Yesterday's transaction count with revenue and AOV as logged; 0 without a log row."""
    anchor = Anchor(transactions, as_of)
    logged = report_log.filter(F.col("report_date") == F.date_sub(anchor.date, 1))
    # at most one log row per day, so max() only fetches it
    money_of = lambda c: F.coalesce(logged.agg(F.max(c)).scalar(), F.lit(0)).alias(c)
    return transactions.filter(anchor.on_day(1)).agg(F.count("*").alias("transactions")).select(
        F.date_sub(anchor.date, 1).alias("report_date"),
        "transactions",
        money_of("total_revenue"),
        money_of("avg_order_value"),
    )


def revenue_by_country(transactions: DataFrame, users: DataFrame, as_of=None, days: int = 30) -> DataFrame:
    recent = transactions.filter(Anchor(transactions, as_of).since_day(days))
    return (
        _per_user(recent)
        .join(users.select("user_id", "country"), "user_id")
        .groupBy("country")
        .agg(
            F.count("*").alias("unique_buyers"),
            F.sum("transactions").alias("orders"),
            F.sum("revenue").alias("revenue"),
        )
        .orderBy(F.col("revenue").desc(), "country")
    )


def top_markets(by_country: DataFrame, limit: int = 3) -> DataFrame:
    return by_country.orderBy(F.col("revenue").desc(), "country").limit(limit).select("country", "revenue")


def geo_performance(transactions: DataFrame, users: DataFrame, as_of=None, limit: int = 20) -> DataFrame:
    """Country and city in the last hour."""
    recent = transactions.filter(Anchor(transactions, as_of).since("1 HOUR"))
    return (
        _per_user(recent)
        .join(users.select("user_id", "country", "city"), "user_id")
        .groupBy("country", "city")
        .agg(
            F.count("*").alias("active_users"),
            F.sum("transactions").alias("transactions"),
            F.sum("revenue").alias("revenue"),
        )
        .orderBy(F.col("revenue").desc(), "country", "city")
        .limit(limit)
    )


def revenue_by_age_group(transactions: DataFrame, users: DataFrame, as_of=None, days: int = 30) -> DataFrame:
    recent = transactions.filter(Anchor(transactions, as_of).since_day(days))
    return (
        _per_user(recent)
        .join(users.select("user_id", "age_group"), "user_id")
        .groupBy(F.coalesce("age_group", F.lit("Unknown")).alias("age_group"))
        .agg(
            F.count("*").alias("customers"),
            F.sum("transactions").alias("transactions"),
            F.sum("revenue").alias("revenue"),
            ratio(F.sum("revenue"), F.sum("amounts"), 2).alias("avg_order_value"),
        )
        .orderBy(F.col("revenue").desc(), "age_group")
    )


def payment_breakdown(transactions: DataFrame, as_of=None, hours: int = 24) -> DataFrame:
    """Share of each payment method; the total window runs over the few methods."""
    everything = Window.partitionBy()
    return (
        transactions.filter(Anchor(transactions, as_of).since(f"{hours} HOURS"))
        .groupBy("payment_method")
        .agg(F.count("*").alias("transaction_count"), F.sum("total_amount").alias("revenue"))
        .withColumn(
            "pct_of_transactions",
            ratio("transaction_count", F.sum("transaction_count").over(everything), 2, times=100),
        )
        .withColumn("pct_of_revenue", money_ratio("revenue", F.sum("revenue").over(everything), 2, times=100))
        .orderBy(F.col("revenue").desc(), "payment_method")
    )


def new_vs_returning_by_day(transactions: DataFrame) -> DataFrame:
    """Every day's buyers split by whether it is the day of their first purchase.

    The fact is reduced to one row per user and day, once; the first day of a user is
    a minimum over those rows.
    """
    daily = (
        transactions.filter(F.col("user_id").isNotNull())
        .groupBy("user_id", F.to_date(TS).alias("metric_date"))
        .agg(
            F.count("*").alias("transactions"),
            F.sum("total_amount").alias("revenue"),
            F.count("total_amount").alias("amounts"),
        )
    )
    first = daily.groupBy("user_id").agg(F.min("metric_date").alias("first_day"))
    kind = F.when(F.col("metric_date") == F.col("first_day"), "New").otherwise("Returning")
    return (
        daily.join(first, "user_id")
        .groupBy("metric_date", kind.alias("customer_type"))
        .agg(
            F.count("*").alias("customers"),
            F.sum("transactions").alias("transactions"),
            F.sum("revenue").alias("revenue"),
            ratio(F.sum("revenue"), F.sum("amounts"), 2).alias("avg_order_value"),
        )
    )


def new_vs_returning(transactions: DataFrame, as_of=None) -> DataFrame:
    """The day's buyers split by whether this is the day of their first purchase.

    Both sides are aggregated to one row per user before they meet, so a user
    with a large share of the fact weighs no more than any other.
    """
    anchor = Anchor(transactions, as_of)
    day = _per_user(transactions.filter(anchor.on_day(0)))
    # only the history of the day's buyers matters; their ids are few enough to be
    # broadcast in practice, and then the history is filtered before any shuffle
    earlier = (
        transactions.filter(F.col(TS) < anchor.midnight())
        .join(day.select("user_id"), "user_id", "left_semi")
        .groupBy("user_id")
        .agg(F.min(TS).alias("first_seen"))
    )
    kind = F.when(F.col("first_seen").isNull(), "New").otherwise("Returning")
    return (
        day.join(earlier, "user_id", "left")
        .groupBy(kind.alias("customer_type"))
        .agg(
            F.count("*").alias("customers"),
            F.sum("transactions").alias("transactions"),
            F.sum("revenue").alias("revenue"),
            ratio(F.sum("revenue"), F.sum("amounts"), 2).alias("avg_order_value"),
        )
    )


def breakdown_leaders(by_age: DataFrame, by_payment: DataFrame, daily: DataFrame) -> DataFrame:
    """Top age group, payment method and weekday, one row each."""

    def leader(df: DataFrame, breakdown: str, name: str, metric: str) -> DataFrame:
        return (
            df.orderBy(F.col(metric).desc(), name)
            .limit(1)
            .select(F.lit(breakdown).alias("breakdown"), F.col(name).alias("leader"), F.col(metric).cast("double").alias("value"))
        )

    weekday = best_weekday(daily).select(
        F.lit("weekday").alias("breakdown"), F.col("weekday").alias("leader"), F.col("mean_revenue").alias("value")
    )
    return (
        leader(by_age, "age_group", "age_group", "revenue")
        .unionByName(leader(by_payment, "payment_method", "payment_method", "pct_of_revenue"))
        .unionByName(weekday)
    )


def weekday_revenue(daily: DataFrame) -> DataFrame:
    return daily.groupBy(F.date_format("date", "EEEE").alias("weekday")).agg(
        mean("revenue").alias("mean_revenue")
    )


def best_weekday(daily: DataFrame) -> DataFrame:
    """Weekday with the highest mean daily revenue."""
    return weekday_revenue(daily).orderBy(F.col("mean_revenue").desc(), "weekday").limit(1)


def persona_profile(transactions: DataFrame, users: DataFrame, as_of=None, churn_days: int = 90) -> DataFrame:
    """Users, transactions, recency, AOV and churned share per persona; non-buyers count as users."""
    anchor = Anchor(transactions, as_of)
    per_user = transactions.groupBy("user_id").agg(
        F.max(TS).alias("last_purchase"),
        F.count("transaction_id").alias("purchases"),
        mean("total_amount").alias("user_aov"),
    )
    recency = anchor.days_since(F.col("last_purchase"))
    return (
        users.select("user_id", "persona")
        .join(per_user, "user_id", "left")
        .withColumn("recency", recency)
        .groupBy("persona")
        .agg(
            F.countDistinct("user_id").alias("users"),
            F.coalesce(F.sum("purchases"), F.lit(0)).alias("transactions"),
            ratio(F.sum("recency"), F.count("recency"), 0).alias("avg_recency_days"),
            F.round(F.avg("user_aov").cast("decimal(24,8)"), 2).alias("avg_order_value"),
            ratio(F.count_if(F.col("recency") > churn_days), F.countDistinct("user_id"), 1, times=100).alias("churn_pct"),
        )
        .orderBy("avg_recency_days", "persona")
    )


def _per_user(transactions: DataFrame) -> DataFrame:
    """Counts and revenue per user, before any join on the user.

    A distinct count of users over it becomes a plain row count.
    """
    return transactions.filter(F.col("user_id").isNotNull()).groupBy("user_id").agg(
        F.count("*").alias("transactions"),
        F.count("total_amount").alias("amounts"),
        F.sum("total_amount").alias("revenue"),
    )


def quarter_revenue(transactions: DataFrame, months: DataFrame, year: int, quarter: int) -> DataFrame:
    """Orders, buyers' purchases and revenue of a quarter's months, by a join with the table of months.

    ``months`` has txn_month, year and quarter; over a fact in monthly parts the join prunes the
    parts of other months when it runs.
    """
    wanted = months.filter((F.col("year") == year) & (F.col("quarter") == quarter)).select("txn_month")
    return transactions.join(wanted, "txn_month").groupBy("txn_month").agg(
        F.count("*").alias("transactions"), F.sum("total_amount").alias("revenue")
    )
