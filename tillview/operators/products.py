"""Product sales, inventory alerts and product detail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillview.functions.dates import Anchor
from tillview.functions.numeric import mean, ratio



def _sales_by_product(transactions: DataFrame) -> DataFrame:
    """One row per product, so that the join to the products is one to one."""
    return transactions.groupBy("product_id").agg(
        F.count("*").alias("purchase_count"),
        F.sum("quantity").alias("units_sold"),
        F.sum("total_amount").alias("revenue"),
        mean("total_amount").alias("avg_sale_price"),
    )


def _top_products(transactions: DataFrame, products: DataFrame, limit: int, columns: list[str]) -> DataFrame:
    return (
        _sales_by_product(transactions)
        .join(products, "product_id")
        .orderBy(F.col("revenue").desc(), "product_id")
        .limit(limit)
        .select(*columns)
    )


def top_products_hour(transactions: DataFrame, products: DataFrame, as_of=None, limit: int = 10) -> DataFrame:
    recent = transactions.filter(Anchor(transactions, as_of).since("1 HOUR"))
    named = ["product_id", "product_name", "category", "purchase_count", "units_sold", "revenue", "avg_sale_price"]
    return _top_products(recent, products, limit, named)


def top_products_today(transactions: DataFrame, products: DataFrame, as_of=None, limit: int = 10) -> DataFrame:
    today = transactions.filter(Anchor(transactions, as_of).since_day(0))
    return _top_products(
        today, products, limit, ["product_id", "product_name", "category", "units_sold", "revenue"]
    )


def rec_trending(transactions: DataFrame, products: DataFrame, as_of=None, limit: int = 20) -> DataFrame:
    """Best sellers by revenue over the last 24 hours."""
    recent = transactions.filter(Anchor(transactions, as_of).since("24 HOURS"))
    return _top_products(
        recent, products, limit, ["product_id", "product_name", "category", "current_price", "units_sold", "revenue"]
    )


def _by_category(transactions: DataFrame, products: DataFrame) -> DataFrame:
    """Sales per category. The fact is reduced to (product, user) before the join."""
    per_buyer = transactions.groupBy("product_id", "user_id").agg(
        F.count("*").alias("transactions"),
        F.count("total_amount").alias("amounts"),
        F.sum("total_amount").alias("revenue"),
        F.sum("quantity").alias("units_sold"),
    )
    return (
        per_buyer.join(products.select("product_id", "category"), "product_id")
        .groupBy("category")
        .agg(
            F.countDistinct("user_id").alias("unique_buyers"),
            F.sum("transactions").alias("transactions"),
            F.sum("revenue").alias("revenue"),
            F.sum("units_sold").alias("units_sold"),
            F.try_divide(F.sum("revenue").cast("double"), F.sum("amounts")).alias("avg_order_value"),
        )
        .orderBy(F.col("revenue").desc(), "category")
    )


def top_categories_hour(transactions: DataFrame, products: DataFrame, as_of=None) -> DataFrame:
    return _by_category(transactions.filter(Anchor(transactions, as_of).since("1 HOUR")), products)


def top_categories_today(transactions: DataFrame, products: DataFrame, as_of=None) -> DataFrame:
    """Today's categories, best first: the first row is the leading category."""
    today = transactions.filter(Anchor(transactions, as_of).since_day(0))
    return _by_category(today, products).select("category", "unique_buyers", "units_sold", "revenue")


def _with_last_day(transactions: DataFrame, products: DataFrame, as_of) -> DataFrame:
    """Every product with its sales of the last 24 hours, which may be none."""
    recent = transactions.filter(Anchor(transactions, as_of).since("24 HOURS"))
    sold = recent.groupBy("product_id").agg(
        F.count("transaction_id").alias("sales_last_24h"),
        F.sum("quantity").alias("units"),
        F.sum("total_amount").alias("revenue"),
    )
    return products.join(sold, "product_id", "left")


def inventory_alerts(
    transactions: DataFrame,
    products: DataFrame,
    as_of=None,
    low_stock: int = 50,
    low_days: int = 7,
    limit: int | None = 20,
) -> DataFrame:
    """Products short of stock, or out of it within days at the current rate."""
    stock, units = F.col("stock_quantity"), F.col("units")
    days_left: Column = F.when(units > 0, ratio(stock, units, 1))
    alerts = (
        _with_last_day(transactions, products, as_of)
        # stock / units < low_days without a division
        .filter((stock < low_stock) | ((units != 0) & (stock < units * low_days)))
        .select(
            "product_id",
            "product_name",
            "category",
            stock.alias("current_stock"),
            F.coalesce("sales_last_24h", F.lit(0)).alias("sales_last_24h"),
            F.coalesce(units, F.lit(0)).alias("units_sold_last_24h"),
            days_left.alias("days_until_stockout"),
        )
        .orderBy(F.col("days_until_stockout").asc_nulls_last(), "product_id")
    )
    return alerts if limit is None else alerts.limit(limit)


def inventory_severity(alerts: DataFrame) -> DataFrame:
    """Alerts that run out within 3 days, within 7 days, and without recent sales."""
    days = F.col("days_until_stockout")
    return alerts.agg(
        F.count_if(days < 3).alias("critical"),
        F.count_if((days >= 3) & (days < 7)).alias("warning"),
        F.count_if(days.isNull()).alias("no_recent_sales"),
    )


def product_detail(transactions: DataFrame, products: DataFrame, product_id: int, as_of=None) -> DataFrame:
    """One product with its last 24 hours; the id prunes both scans."""
    wanted = F.col("product_id") == product_id
    recent = transactions.filter(wanted & Anchor(transactions, as_of).since("24 HOURS"))
    sold = recent.groupBy("product_id").agg(
        F.sum("quantity").alias("units_sold_24h"), F.sum("total_amount").alias("revenue_24h")
    )
    return (
        products.filter(wanted)
        .join(sold, "product_id", "left")
        .withColumn("units_sold_24h", F.coalesce("units_sold_24h", F.lit(0)))
        .withColumn("revenue_24h", F.coalesce("revenue_24h", F.lit(0)))
    )
