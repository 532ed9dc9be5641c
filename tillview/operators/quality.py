"""Data quality checks. A check is a row: check_name, status, value."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillview.functions.dates import TS, Anchor
from tillview.functions.numeric import sum_if

# Fixed values of the checks.
RATIO_LOW, RATIO_HIGH = 0.1, 3.0
STALE_HOURS = 2
NOT_NULL = ["transaction_id", "user_id", TS]
# Reason and lowest allowed amount per constrained column.
LOWER_BOUNDS = [("quantity", 1), ("unit_price", 0), ("total_amount", 0), ("discount_amount", 0)]


def _check(df: DataFrame, name: str, failed: Column, value: Column) -> DataFrame:
    """``df`` holds the one row the check is about."""
    return df.select(
        F.lit(name).alias("check_name"),
        F.when(failed, "fail").otherwise("pass").alias("status"),
        value.cast("double").alias("value"),
    )


def _count_check(df: DataFrame, name: str, counted: Column) -> DataFrame:
    return _check(df.agg(counted.alias("n")), name, F.col("n") > 0, F.col("n"))


def dq_null_user_ids(transactions: DataFrame) -> DataFrame:
    return _count_check(transactions, "null_user_ids", F.count_if(F.col("user_id").isNull()))


def dq_null_amounts(transactions: DataFrame) -> DataFrame:
    amount = F.col("total_amount")
    return _count_check(transactions, "null_amounts", F.count_if(amount.isNull() | (amount < 0)))


def row_checks(transactions: DataFrame) -> DataFrame:
    """Both row-level checks from one scan."""
    amount = F.col("total_amount")
    counts = transactions.agg(
        F.count_if(F.col("user_id").isNull()).alias("null_user_ids"),
        F.count_if(amount.isNull() | (amount < 0)).alias("null_amounts"),
    )
    names = counts.columns
    return counts.unpivot([], names, "check_name", "n").select(
        "check_name",
        F.when(F.col("n") > 0, "fail").otherwise("pass").alias("status"),
        F.col("n").cast("double").alias("value"),
    )


def _orphan_rows(transactions: DataFrame, users: DataFrame) -> Column:
    """Rows whose user does not exist or is NULL; ids are counted before the join."""
    per_user = transactions.groupBy("user_id").agg(F.count("*").alias("rows"))
    unknown = per_user.join(users.select("user_id"), "user_id", "left_anti")
    return unknown.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n"))


def dq_orphans(transactions: DataFrame, users: DataFrame) -> DataFrame:
    return _check(_orphan_rows(transactions, users), "orphan_transactions", F.col("n") > 0, F.col("n"))


def dq_duplicates(transactions: DataFrame, key: list[str] | str = "transaction_id") -> DataFrame:
    """Number of key values that occur more than once."""
    keys = [key] if isinstance(key, str) else key
    repeated = transactions.groupBy(*keys).agg(F.count("*").alias("rows")).filter(F.col("rows") > 1)
    return _count_check(repeated, "duplicate_transactions", F.count("*"))


def _anomaly(transactions: DataFrame, name: str, measure: Column, as_of) -> DataFrame:
    """Yesterday against the mean of the days with sales in the week before it."""
    anchor = Anchor(transactions, as_of)
    yesterday = F.date_sub(anchor.date, 1)
    daily = (
        transactions.filter(anchor.since_day(8) & (F.col(TS) < anchor.midnight()))
        .groupBy(F.to_date(TS).alias("day"))
        .agg(measure.alias("measure"))
    )
    ratio = F.try_divide(F.col("yesterday"), F.nullif(F.col("mean"), F.lit(0.0)))
    return _check(
        daily.agg(
            F.coalesce(sum_if(F.col("day") == yesterday, "measure"), F.lit(0)).cast("double").alias("yesterday"),
            F.try_divide(
                sum_if(F.col("day") < yesterday, "measure").cast("double"), F.count_if(F.col("day") < yesterday)
            ).alias("mean"),
        ),
        name,
        F.coalesce((ratio > RATIO_HIGH) | (ratio < RATIO_LOW), F.lit(False)),
        ratio,
    )


def dq_revenue_anomaly(transactions: DataFrame, as_of=None) -> DataFrame:
    return _anomaly(transactions, "revenue_anomaly", F.sum("total_amount"), as_of)


def dq_volume_anomaly(transactions: DataFrame, as_of=None) -> DataFrame:
    return _anomaly(transactions, "transaction_volume", F.count("*"), as_of)


def dq_stale_tables(refresh_log: DataFrame, as_of, max_hours: float = STALE_HOURS) -> DataFrame:
    """One row per table of the log (table_name, computed_at); the value is its age in hours."""
    now = (as_of if isinstance(as_of, Column) else F.lit(str(as_of))).cast(refresh_log.schema["computed_at"].dataType)
    age = refresh_log.groupBy("table_name").agg(F.max("computed_at").alias("computed_at")).withColumn(
        "hours", F.timestamp_diff("SECOND", F.col("computed_at"), now) / F.lit(3600.0)
    )
    return age.select(
        F.concat(F.lit("stale_"), "table_name").alias("check_name"),
        F.when(F.col("hours") > max_hours, "fail").otherwise("pass").alias("status"),
        F.col("hours").alias("value"),
    )


def dq_summary(checks: list[DataFrame]) -> DataFrame:
    """Totals over all checks, whether they passed or not."""
    rows = reduce(DataFrame.unionByName, checks)
    failed = F.count_if(F.col("status") == "fail")
    return rows.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("status") == "pass").alias("passed"),
        failed.alias("failed"),
        F.when(failed == 0, "pass").otherwise("fail").alias("status"),
    )


def dq_daily_gate(transactions: DataFrame, users: DataFrame, as_of=None) -> DataFrame:
    """Decision of the nightly run in one row.

    ``skip`` when yesterday has no rows, else ``pass`` or ``fail_alert``; the
    run goes on after an alert.
    """
    anchor = Anchor(transactions, as_of)
    yesterday = anchor.on_day(1)
    counts = transactions.agg(
        F.count_if(yesterday).alias("yesterday_rows"),
        F.count_if(F.col("user_id").isNull()).alias("null_user_ids"),
        F.count_if(F.col("total_amount") < 0).alias("negative_amounts"),
    )
    orphans = _orphan_rows(transactions.filter(yesterday), users).scalar()
    bad = F.col("null_user_ids") + F.col("negative_amounts") + F.col("orphan_transactions")
    decision = F.when(F.col("yesterday_rows") == 0, "skip").when(bad == 0, "pass").otherwise("fail_alert")
    return counts.withColumn("orphan_transactions", orphans).withColumn("decision", decision)


def dq_row_minimum(df: DataFrame, minimum: int) -> DataFrame:
    return _check(df.agg(F.count("*").alias("n")), "row_minimum", F.col("n") < minimum, F.col("n"))


def dq_not_null(df: DataFrame, columns: list[str]) -> DataFrame:
    """NULLs per column, all columns in one scan."""
    nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"not_null_{c}") for c in columns])
    return nulls.unpivot([], nulls.columns, "check_name", "n").select(
        "check_name",
        F.when(F.col("n") > 0, "fail").otherwise("pass").alias("status"),
        F.col("n").cast("double").alias("value"),
    )


def null_measures(columns: list[str]) -> dict[str, Column]:
    """The counts of :func:`dq_not_null` as aggregates, to be taken while a table is written."""
    return {f"not_null_{c}": F.count_if(F.col(c).isNull()) for c in columns}


def value_measures(column: str, values: list[str]) -> dict[str, Column]:
    """Rows outside the list of :func:`dq_accepted_values`, to be taken while a table is written."""
    return {f"accepted_values_{column}": F.count_if(F.col(column).isNotNull() & ~F.col(column).isin(values))}


def dq_unique(df: DataFrame, column: str) -> DataFrame:
    """Non-null values that occur more than once."""
    repeated = (
        df.filter(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count("*").alias("rows"))
        .filter(F.col("rows") > 1)
    )
    return _count_check(repeated, f"unique_{column}", F.count("*"))


def dq_accepted_values(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Distinct non-null values outside the list."""
    odd = df.filter(F.col(column).isNotNull() & ~F.col(column).isin(values)).select(column).distinct()
    return _count_check(odd, f"accepted_values_{column}", F.count("*"))


def dq_no_negative_revenue(staged: DataFrame) -> DataFrame:
    """The offending rows themselves; none is a pass."""
    return staged.filter(F.col("total_amount") < 0)


def violations(transactions: DataFrame) -> Column:
    """Names of the row constraints a transaction breaks. As with a CHECK
    constraint, a NULL breaks only NOT NULL."""
    reasons = [F.when(F.col(c).isNull(), f"{c} is null") for c in NOT_NULL]
    reasons += [
        F.when(F.col(c) < low, f"{c} below {low}") for c, low in LOWER_BOUNDS if c in transactions.columns
    ]
    return F.array_compact(F.array(*reasons))


def valid_transactions(transactions: DataFrame) -> DataFrame:
    return transactions.filter(F.size(violations(transactions)) == 0)


def quarantined_transactions(transactions: DataFrame) -> DataFrame:
    return transactions.withColumn("reasons", violations(transactions)).filter(F.size("reasons") > 0)
