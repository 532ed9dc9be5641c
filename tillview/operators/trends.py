"""Trend shapes over the daily and weekly tables, a few rows per calendar day."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillview.functions.dates import Anchor

WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


def weekly_revenue(daily: DataFrame, as_of=None, weeks: int = 12) -> DataFrame:
    """Weeks from Monday. Users are summed over days and AOV is the mean of the
    daily values, unweighted, as in the original report."""
    anchor = Anchor(daily, as_of, "metric_date")
    return (
        daily.filter(anchor.since_day(weeks * 7))
        .groupBy(F.to_date(F.date_trunc("week", "metric_date")).alias("week_start"))
        .agg(
            F.sum("total_revenue").alias("revenue"),
            F.sum("total_transactions").alias("transactions"),
            F.round(F.avg("avg_order_value").cast("decimal(24,8)"), 2).alias("avg_order_value"),
            F.sum("daily_active_users").alias("active_users"),
        )
        .orderBy(F.col("week_start").desc())
        .limit(weeks)
    )


def revenue_ma7(daily: DataFrame) -> DataFrame:
    """Daily revenue with the moving average of up to seven rows."""
    last_seven = Window.partitionBy().orderBy("date").rowsBetween(-6, Window.currentRow)
    average = F.sum("revenue").over(last_seven).cast("double") / F.count("revenue").over(last_seven)
    return daily.select("date", "revenue", "avg_order_value", average.alias("ma7"))


def weekly_growth(weekly: DataFrame) -> DataFrame:
    """Change of revenue against the week before, in percent."""
    before = F.lag("revenue").over(Window.partitionBy().orderBy("week_start")).cast("double")
    growth = (F.try_divide(F.col("revenue").cast("double"), before) - 1) * 100
    return weekly.select("week_start", "revenue", growth.alias("wow_pct"))


def dow_heatmap(daily: DataFrame) -> DataFrame:
    """Revenue by ISO week and weekday."""
    return (
        daily.select(
            F.weekofyear("date").cast("string").alias("week"),
            F.date_format("date", "EEEE").alias("weekday"),
            "revenue",
        )
        .groupBy("week")
        .pivot("weekday", WEEKDAYS)
        .agg(F.sum("revenue"))
    )
