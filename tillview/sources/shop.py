"""The star schema over the shared TPC-H-like tables.

Three facts, all with the column names of ``transactions``:

* ``orders``    one row per order, for everything centred on the customer,
* ``lines``     one row per order line, for everything centred on the product,
* ``purchases`` the purchase events, for windows shorter than a day.

Columns without a counterpart in the shared tables are stand-ins derived by a
fixed rule (FIXTURES.md); they carry no meaning beyond giving the query work.
"""

from __future__ import annotations

from datetime import datetime
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillview.functions.numeric import MONEY, money
from tillview.session import shuffles_by_size
from tillview.sources.readers import read_table

# Fixed values of the stand-in columns.
REGISTRATION_SPREAD_DAYS = 60
STOCK_FACTOR, STOCK_RANGE = 7919, 1000
SESSION_SECONDS = 1800


def session_id() -> Column:
    """User and half hour of an event, whatever the session's time zone."""
    epoch = F.lit("1970-01-01").cast("timestamp_ntz")
    slot = F.floor(F.timestamp_diff("SECOND", epoch, F.col("ts")) / F.lit(SESSION_SECONDS))
    return F.concat_ws("-", F.col("user_id"), slot)


class Shop:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        shuffles_by_size(spark, [f"{folder}/{name}.parquet" for name in ("orders", "lineitem", "events")])

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, f"{self.folder}/{name}.parquet")

    @cached_property
    def last_order(self) -> datetime:
        """The clock of the order and line facts."""
        return self.table("orders").agg(F.max("o_orderdate")).first()[0]

    @cached_property
    def last_purchase(self) -> datetime:
        """The clock of the purchase events."""
        events = self.table("events").filter(F.col("event_type") == "purchase")
        return events.agg(F.max("ts")).first()[0]

    def users(self) -> DataFrame:
        geography = self.table("nation").join(
            self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left"
        )
        return (
            self.table("customer")
            .join(geography, F.col("c_nationkey") == F.col("n_nationkey"), "left")
            .select(
                F.col("c_custkey").alias("user_id"),
                F.col("c_name").alias("email"),
                F.col("n_name").alias("country"),
                F.col("r_name").alias("city"),
                F.col("c_mktsegment").alias("age_group"),
                F.col("c_mktsegment").alias("persona"),
            )
        )

    def registered_users(self) -> DataFrame:
        """Users with a registration date: the first order minus 0 to 59 days."""
        first = self.orders().groupBy("user_id").agg(F.min("transaction_date").alias("first_order"))
        lead = F.pmod(F.col("user_id"), F.lit(REGISTRATION_SPREAD_DAYS)).cast("int")
        return (
            self.users()
            .join(first, "user_id", "left")
            .withColumn("registration_date", F.date_sub(F.to_date("first_order"), lead))
            .drop("first_order")
        )

    def products(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_partkey").alias("product_id"),
            F.col("p_name").alias("product_name"),
            F.col("p_type").alias("category"),
            F.concat(F.lit("size "), F.col("p_size")).alias("subcategory"),
            F.col("p_brand").alias("brand"),
            money("p_retailprice").alias("current_price"),
            F.pmod(F.col("p_partkey") * STOCK_FACTOR, F.lit(STOCK_RANGE)).alias("stock_quantity"),
        )

    def orders(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_orderkey").alias("transaction_id"),
            F.col("o_custkey").alias("user_id"),
            F.col("o_orderdate").alias("transaction_date"),
            money("o_totalprice").alias("total_amount"),
            F.col("o_orderpriority").alias("payment_method"),
            F.col("o_orderstatus").alias("order_status"),
        )

    def lines(self) -> DataFrame:
        header = self.orders().drop("total_amount")
        lines = self.table("lineitem").select(
            F.col("l_orderkey").alias("transaction_id"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_quantity").cast("bigint").alias("quantity"),
            F.try_divide(money("l_extendedprice"), F.col("l_quantity").cast("decimal(10,0)"))
            .cast(MONEY)
            .alias("unit_price"),
            money("l_extendedprice").alias("total_amount"),
            (money("l_extendedprice") * F.col("l_discount").cast("decimal(4,2)")).alias("discount_amount"),
        )
        return lines.join(header, "transaction_id").withColumn(
            "session_id", F.concat(F.lit("s"), F.col("transaction_id"))
        )

    def events(self) -> DataFrame:
        """All events; the session is the user's half hour, the product the JSON key ``k``."""
        return self.table("events").select(
            "event_id",
            "event_type",
            "user_id",
            F.col("ts").alias("timestamp"),
            session_id().alias("session_id"),
            F.from_json("props", "k BIGINT")["k"].alias("product_id"),
            money("value").alias("amount"),
            (F.pmod(F.col("event_id"), F.lit(4)) + 1).alias("quantity"),
        )

    def purchases(self) -> DataFrame:
        return (
            self.events()
            .filter(F.col("event_type") == "purchase")
            .select(
                F.col("event_id").alias("transaction_id"),
                "user_id",
                "product_id",
                "session_id",
                F.col("timestamp").alias("transaction_date"),
                "quantity",
                F.col("amount").alias("total_amount"),
            )
        )
