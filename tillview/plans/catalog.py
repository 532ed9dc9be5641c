"""The named queries, each bound to the facts of a :class:`Shop`."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime, time, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tillview.functions.dates import TS, Anchor
from tillview.functions.numeric import money
from tillview.operators import (
    churn,
    cohorts,
    customers,
    experiments,
    kpi,
    ml,
    products,
    quality,
    recs,
    shapley,
    staging,
    states,
    tables,
    trends,
)
from tillview.plans import jobs
from tillview.plans.filetable import FileTable
from tillview.sources.buckets import write_bucketed
from tillview.sources.months import MONTH
from tillview.sources.readers import parquet_stream, write_observed
from tillview.sources.schemas import AB_METRICS, DAILY_REPORT_LOG, MODEL_REGISTRY
from tillview.sources.scratch import materialize, scratch_path
from tillview.sources.shop import Shop, session_id
from tillview.sources.versions import VersionedTable
from tillview.streaming import events, sinks
from tillview.streaming import transactions as purchase_stream


def portable(df: DataFrame) -> DataFrame:
    """Result columns as plain text, BIGINT, DOUBLE and BOOLEAN, as a client gets them."""

    def plain(field: T.StructField):
        col, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, T.DateType):
            col = F.date_format(col, "yyyy-MM-dd")
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            col = F.date_format(col, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif isinstance(kind, (T.DecimalType, T.FloatType)):
            col = col.cast("double")
        elif isinstance(kind, (T.IntegerType, T.ShortType, T.ByteType)):
            col = col.cast("bigint")
        elif isinstance(kind, T.ArrayType):
            col = F.concat_ws(" | ", col)
        return col.alias(field.name)

    return df.select(*[plain(f) for f in df.schema])


def _daily(shop: Shop) -> DataFrame:
    return kpi.daily_metrics(shop.lines())


def _daily90(shop: Shop) -> DataFrame:
    return kpi.daily_kpis(_daily(shop), shop.last_order, days=90)


def _metrics(shop: Shop) -> DataFrame:
    return customers.user_metrics(shop.users(), shop.lines(), shop.last_order)


def _values(shop: Shop) -> DataFrame:
    return customers.lifetime_values(_metrics(shop))


def _segmented(shop: Shop) -> DataFrame:
    """User totals with the segment of the mart."""
    segments = customers.mart_rfm_segments(customers.int_rfm_scores(_staged(shop), shop.last_order))
    return _metrics(shop).join(segments.select("user_id", "customer_segment"), "user_id", "left")


def _staged(shop: Shop) -> DataFrame:
    return staging.stg_transactions(shop.orders())


def _rfm(shop: Shop) -> DataFrame:
    return customers.rfm_base(shop.users(), shop.orders(), shop.last_order)


def _summary(shop: Shop) -> DataFrame:
    return customers.rfm_segment_summary(_rfm(shop))


BUCKETS = 8


def _bucketed_orders(shop: Shop) -> DataFrame:
    """The orders by month and user, written anew."""
    orders = shop.orders().withColumn(MONTH, F.date_format(TS, "yyyy-MM"))
    return write_bucketed(orders, scratch_path(shop.spark, "orders-by-user"), BUCKETS)


def _bucketed_users(shop: Shop) -> DataFrame:
    """Purchases of every user: two tables with the same buckets, joined and counted without a shuffle."""
    users = write_bucketed(
        shop.users().select("user_id", "email"), scratch_path(shop.spark, "users-by-id"), BUCKETS, order=None, month=False
    )
    orders = _bucketed_orders(shop)
    totals = orders.groupBy("user_id").agg(F.count("*").alias("purchases"), F.sum("total_amount").alias("spent"))
    return users.hint("merge").join(totals, "user_id", "left")


def _months(shop: Shop) -> DataFrame:
    """The table of months of the orders."""
    return shop.orders().select(
        F.date_format(TS, "yyyy-MM").alias(MONTH), F.year(TS).alias("year"), F.quarter(TS).alias("quarter")
    ).distinct()


STAGING = {
    "user_history_bucketed": lambda s: staging.user_history(_bucketed_orders(s), user_id=100, since="1996-01-01").drop(MONTH),
    "user_purchases_bucketed": _bucketed_users,
    "quarter_revenue": lambda s: kpi.quarter_revenue(
        _bucketed_orders(s), _months(s), s.last_order.year - 1, (s.last_order.month + 2) // 3
    ),
    "stg_transactions": lambda s: staging.stg_transactions(s.lines()),
    "stg_users": lambda s: staging.stg_users(s.registered_users()),
    "user_history": lambda s: staging.user_history(s.orders(), user_id=100, since="1996-01-01"),
    "recent_star_rows": lambda s: staging.recent_star_rows(s.lines(), s.users(), s.products(), s.last_order),
    "export_transactions": lambda s: staging.export_transactions(s.lines()),
}

KPI = {
    "realtime_kpi": lambda s: kpi.realtime_kpi(s.purchases(), s.last_purchase),
    "today_vs_yesterday": lambda s: kpi.today_vs_yesterday(s.purchases(), s.last_purchase),
    "revenue_momentum": lambda s: kpi.revenue_momentum(kpi.today_vs_yesterday(s.purchases(), s.last_purchase)),
    "hourly_trend": lambda s: kpi.hourly_trend(s.purchases(), s.last_purchase),
    "daily_metrics": _daily,
    "daily_kpis": lambda s: kpi.daily_kpis(_daily(s), s.last_order),
    "mart_daily_snapshot": lambda s: kpi.mart_daily_snapshot(_staged(s)),
    "daily_volume_90d": lambda s: kpi.daily_volume(s.orders(), s.last_order),
    "today_summary": lambda s: kpi.today_summary(s.purchases(), s.last_purchase),
    "notify_summary": lambda s: kpi.notify_summary(
        s.orders(), kpi.mart_daily_snapshot(_staged(s)), s.last_order
    ),
    "weekly_revenue": lambda s: trends.weekly_revenue(_daily(s), s.last_order),
    "revenue_ma7": lambda s: trends.revenue_ma7(kpi.daily_kpis(_daily(s), s.last_order)),
    "weekly_growth": lambda s: trends.weekly_growth(trends.weekly_revenue(_daily(s), s.last_order)),
    "dow_heatmap": lambda s: trends.dow_heatmap(_daily90(s)),
    "best_weekday": lambda s: kpi.best_weekday(_daily90(s)),
    "revenue_by_country": lambda s: kpi.revenue_by_country(s.orders(), s.users(), s.last_order),
    "top_markets": lambda s: kpi.top_markets(kpi.revenue_by_country(s.orders(), s.users(), s.last_order)),
    "geo_performance": lambda s: kpi.geo_performance(s.purchases(), s.users(), s.last_purchase),
    "revenue_by_age_group": lambda s: kpi.revenue_by_age_group(s.orders(), s.users(), s.last_order),
    "payment_breakdown": lambda s: kpi.payment_breakdown(s.lines(), s.last_order),
    "new_vs_returning": lambda s: kpi.new_vs_returning_by_day(s.purchases()),
    "breakdown_leaders": lambda s: kpi.breakdown_leaders(
        kpi.revenue_by_age_group(s.orders(), s.users(), s.last_order), kpi.payment_breakdown(s.lines(), s.last_order), _daily90(s)
    ),
    "persona_profile": lambda s: kpi.persona_profile(s.orders(), s.users(), s.last_order),
}

CUSTOMERS = {
    "user_metrics": _metrics,
    "int_rfm_scores": lambda s: customers.int_rfm_scores(_staged(s), s.last_order).drop("rounded_order_value"),
    "mart_rfm_segments": lambda s: customers.mart_rfm_segments(customers.int_rfm_scores(_staged(s), s.last_order)),
    "rfm_segment_summary": _summary,
    "rfm_segment_summary_classic": lambda s: customers.rfm_segment_summary_classic(_rfm(s)),
    "rfm_user_details": lambda s: customers.rfm_user_details(
        customers.rfm_base(s.registered_users(), s.orders(), s.last_order)
    ),
    "rfm_percentile_scores": lambda s: customers.rfm_percentile_scores(_metrics(s)),
    "rfm_breakpoints": lambda s: customers.rfm_breakpoints(_metrics(s)),
    "top_customers": lambda s: customers.top_customers(_segmented(s)),
    "ltv_leaderboard": lambda s: customers.ltv_leaderboard(s.orders(), s.registered_users(), s.last_order),
    "ltv_quartiles": lambda s: customers.ltv_quartiles(_values(s)),
    "ltv_histogram": lambda s: customers.ltv_histogram(_values(s)),
    "ltv_concentration": lambda s: customers.ltv_concentration(_values(s)),
    "segment_radar": lambda s: customers.segment_radar(_summary(s)),
    "top_segment": lambda s: customers.top_segment(_summary(s)),
    "rfm_scatter": lambda s: customers.rfm_scatter(_segmented(s)),
    "cohort_retention": lambda s: cohorts.cohort_retention(s.orders()),
    "cohort_registration": lambda s: cohorts.cohort_registration(s.registered_users(), s.orders()),
    "cohort_ltv": lambda s: cohorts.cohort_ltv(s.registered_users(), s.orders()),
}


def _features(shop: Shop) -> DataFrame:
    return churn.mart_churn_features(_staged(shop), shop.last_order)


def _at_risk(shop: Shop, page_size: int) -> DataFrame:
    return churn.at_risk_customers(churn.churn_risk_score(_features(shop)), _metrics(shop), page_size=page_size)


def _scored_users(shop: Shop) -> DataFrame:
    unscored = shop.users().select("user_id", "email", F.lit(None).cast("decimal(3,2)").alias("churn_risk_score"))
    return tables.apply_churn_to_users(unscored, _features(shop))


CHURN = {
    "mart_churn_features": _features,
    "churn_risk_score": lambda s: churn.churn_risk_score(_features(s)),
    "churn_heuristic": lambda s: churn.churn_heuristic(_metrics(s)),
    "churn_rule_factors": lambda s: churn.churn_rule_factors(_metrics(s)),
    "churn_feature_prep": lambda s: churn.churn_feature_prep(_metrics(s)),
    "churn_training_set": lambda s: churn.churn_training_set(s.orders(), s.last_order),
    "at_risk_customers": lambda s: _at_risk(s, 20),
    "churn_histogram": lambda s: churn.churn_histogram(
        churn.at_risk_scores(churn.churn_risk_score(_features(s)), _metrics(s))
    ),
}

PRODUCTS = {
    "top_products_hour": lambda s: products.top_products_hour(s.lines(), s.products(), s.last_order),
    "top_products_today": lambda s: products.top_products_today(s.lines(), s.products(), s.last_order),
    "top_categories_hour": lambda s: products.top_categories_hour(s.lines(), s.products(), s.last_order),
    "top_categories_today": lambda s: products.top_categories_today(s.lines(), s.products(), s.last_order),
    "inventory_alerts": lambda s: products.inventory_alerts(s.lines(), s.products(), s.last_order),
    "inventory_severity": lambda s: products.inventory_severity(
        products.inventory_alerts(s.lines(), s.products(), s.last_order, limit=None)
    ),
    "product_detail": lambda s: products.product_detail(
        s.lines(), s.products(), product_id=1, as_of=s.last_order
    ),
}

RECOMMENDATIONS = {
    "rec_user_jaccard": lambda s: recs.rec_user_jaccard(s.lines(), s.products(), user_id=1),
    "rec_user_jaccard_batch": lambda s: recs.rec_user_jaccard_batch(s.lines(), s.products(), s.users()),
    "rec_user_overlap": lambda s: recs.rec_user_overlap(s.lines(), s.products(), user_id=1),
    "rec_item_lift": lambda s: recs.rec_item_lift(s.lines(), s.products(), s.users()),
    "rec_similar_products": lambda s: recs.rec_similar_products(s.lines(), s.products(), s.users(), product_id=1),
    "rec_trending": lambda s: products.rec_trending(s.lines(), s.products(), s.last_order),
}


def _offers(shop: Shop) -> DataFrame:
    return experiments.ab_assign(experiments.ab_eligibility(_scored_users(shop)))


def _assignments(shop: Shop, days_back: int = 30) -> DataFrame:
    moment = Anchor(shop.orders(), shop.last_order).midnight(days_back)
    # the log is read several times below; deriving it scans the whole fact
    return materialize(experiments.ab_assignments(_offers(shop), moment), "assignments")


def _conversion(shop: Shop, assignments: DataFrame | None = None) -> DataFrame:
    return experiments.ab_conversion(
        _assignments(shop) if assignments is None else assignments, shop.orders(), shop.last_order
    )


def _ab_summary(shop: Shop) -> DataFrame:
    assignments = _assignments(shop)
    return experiments.ab_summary(
        _conversion(shop, assignments), assignments, Anchor(shop.orders(), shop.last_order).date
    )


def _ab_results(shop: Shop) -> DataFrame:
    assignments = _assignments(shop)
    return experiments.ab_results(assignments, _conversion(shop, assignments))


def _sticky_log(shop: Shop) -> DataFrame:
    """Riskiest users were all put into the control group a month earlier."""
    risky = _offers(shop).filter(F.col("churn_risk") > 0.7).withColumn("variant", F.lit(experiments.CONTROL))
    log = experiments.ab_assignments(risky, Anchor(shop.orders(), shop.last_order).midnight(60))
    return experiments.ab_log_sticky(log, _assignments(shop))


EXPERIMENTS = {
    "ab_eligibility": lambda s: experiments.ab_eligibility(_scored_users(s)),
    "ab_assign": _offers,
    "ab_log_sticky": _sticky_log,
    "ab_conversion": _conversion,
    "ab_summary": _ab_summary,
    "ab_results": _ab_results,
}


def _line_snapshot(shop: Shop) -> DataFrame:
    """Sixty days of snapshots, this time from the order lines."""
    lines = shop.lines()
    return kpi.mart_daily_snapshot(staging.stg_transactions(lines.filter(Anchor(lines, shop.last_order).since_day(60))))


def _snapshot(shop: Shop) -> DataFrame:
    return kpi.mart_daily_snapshot(_staged(shop))


def _old_snapshot(shop: Shop) -> DataFrame:
    """Without the last two weeks."""
    return _snapshot(shop).filter(F.col("report_date") < Anchor(shop.orders(), shop.last_order).midnight(14).cast("date"))


def _written_back(shop: Shop) -> DataFrame:
    """The users' table in eight files after both write-backs, run twice: the second finds nothing to change."""
    columns = "customer_segment string, churn_risk_score decimal(3,2)"
    empty = [F.lit(None).cast(kind).alias(name) for name, kind in (c.split() for c in columns.split(", "))]
    users = shop.users().select("user_id", "email", *empty)
    table = FileTable(shop.spark, scratch_path(shop.spark, "users"), ["user_id"], users.schema, max(1, users.count() // 8))
    table.replace(users)
    segments = customers.mart_rfm_segments(customers.int_rfm_scores(_staged(shop), shop.last_order))
    for _ in range(2):
        jobs.write_back(table, segments, _features(shop))
    return table.read()


def _merged_snapshot(shop: Shop) -> DataFrame:
    """The daily snapshot in files of 200 days after a merge of the last sixty."""
    whole = _snapshot(shop)
    table = FileTable(shop.spark, scratch_path(shop.spark, "snapshot"), ["report_date"], whole.schema, 200)
    table.replace(whole)
    table.upsert(_line_snapshot(shop))
    return table.read()


TABLES = {
    "merge_write_back": _written_back,
    "merge_upsert": _merged_snapshot,
    "upsert_by_key": lambda s: tables.upsert_by_key(_snapshot(s), _line_snapshot(s), ["report_date"]),
    "insert_if_absent": lambda s: tables.insert_if_absent(_old_snapshot(s), _line_snapshot(s), ["report_date"]),
    "apply_rfm_to_users": lambda s: tables.apply_rfm_to_users(
        s.users().select("user_id", "email", F.lit(None).cast("string").alias("customer_segment")),
        customers.mart_rfm_segments(customers.int_rfm_scores(_staged(s), s.last_order)),
    ),
    "apply_churn_to_users": _scored_users,
    "apply_snapshot_to_log": lambda s: tables.apply_snapshot_to_log(
        _snapshot(s).withColumn("total_users", F.lit(0).cast("bigint")), _snapshot(s), s.last_order
    ),
    "user_totals": lambda s: tables.user_totals(s.orders()),
}

ROW = ["transaction_id", "user_id", TS, "quantity", "total_amount"]


def _charged_lines(shop: Shop, fee: int = 1000) -> DataFrame:
    """Order lines after a flat fee, which turns the smallest amounts negative."""
    return shop.lines().select(*ROW).withColumn("total_amount", F.col("total_amount") - fee)


def _refresh_log(shop: Shop) -> DataFrame:
    """Purchases and signups stand for the refreshes of the two views."""
    name = F.when(F.col("event_type") == "purchase", "daily_metrics").otherwise("user_metrics")
    moment = F.date_trunc("second", F.col("timestamp")).cast("timestamp_ntz")
    return (
        shop.events()
        .filter(F.col("event_type").isin("purchase", "signup"))
        .select(name.alias("table_name"), moment.alias("computed_at"))
    )


def _stale(shop: Shop) -> DataFrame:
    """An hour after the end of the last purchase's day."""
    end = datetime.combine(shop.last_purchase, time()) + timedelta(days=1, hours=1)
    return quality.dq_stale_tables(_refresh_log(shop), end)


QUALITY = {
    "dq_null_user_ids": lambda s: quality.dq_null_user_ids(s.orders()),
    "dq_null_amounts": lambda s: quality.dq_null_amounts(s.orders()),
    "dq_orphans": lambda s: quality.dq_orphans(s.orders(), s.users()),
    "dq_duplicates": lambda s: quality.dq_duplicates(s.lines()),
    "dq_revenue_anomaly": lambda s: quality.dq_revenue_anomaly(s.orders(), s.last_order),
    "dq_volume_anomaly": lambda s: quality.dq_volume_anomaly(s.orders(), s.last_order),
    "dq_stale_tables": _stale,
    "dq_summary": lambda s: quality.dq_summary(
        [
            quality.row_checks(s.orders()),
            quality.dq_orphans(s.orders(), s.users()),
            quality.dq_duplicates(s.lines()),
            quality.dq_revenue_anomaly(s.orders(), s.last_order),
            quality.dq_volume_anomaly(s.orders(), s.last_order),
            _stale(s),
        ]
    ),
    "dq_daily_gate": lambda s: quality.dq_daily_gate(s.orders(), s.users(), s.last_order),
    "dq_row_minimum": lambda s: quality.dq_row_minimum(churn.churn_training_set(s.orders(), s.last_order), 200),
    "dq_not_null": lambda s: quality.dq_not_null(_features(s), ["user_id", *churn.FEATURES]),
    "dq_unique": lambda s: quality.dq_unique(s.lines(), "transaction_id"),
    "dq_accepted_values": lambda s: quality.dq_accepted_values(
        s.users(), "persona", ["AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY"]
    ),
    "dq_no_negative_revenue": lambda s: quality.dq_no_negative_revenue(
        s.orders().select("transaction_id", "user_id", (F.col("total_amount") - 2000).alias("total_amount"))
    ),
    "valid_transactions": lambda s: quality.valid_transactions(_charged_lines(s)),
    "quarantined_transactions": lambda s: quality.quarantined_transactions(_charged_lines(s)),
}

def _exported(shop: Shop) -> DataFrame:
    """The month-partitioned export, written and read back."""
    path = scratch_path(shop.spark, "export")
    jobs.run_export(shop.lines(), {}, path)
    return shop.spark.read.parquet(f"{path}/transactions")


def _cohort_table(shop: Shop) -> DataFrame:
    """The cohort job end to end: export, computation from the files, table."""
    path = scratch_path(shop.spark, "cohorts")
    jobs.run_export(shop.lines(), {}, path)
    table = VersionedTable(shop.spark, f"{path}/cohort_retention")
    jobs.run_cohort_job(f"{path}/transactions", table)
    return table.read()


def _refreshed(shop: Shop) -> DataFrame:
    report = jobs.refresh_views(
        shop.users(), shop.lines(), scratch_path(shop.spark, "views"), shop.last_order
    )
    return shop.spark.createDataFrame(list(report.rows.items()), "view string, rows bigint")


RECENT_MONTHS = 3


def _refreshed_by_delta(shop: Shop) -> tuple[str, list[jobs.JobReport]]:
    """The views after a first load and after the last months' rows were appended: their folder and the reports."""
    root = scratch_path(shop.spark, "delta")
    lines = shop.lines().withColumn(MONTH, F.date_format(TS, "yyyy-MM"))
    # half of the last months' orders come later, so that old and new months change
    late = (F.col(TS) >= Anchor(lines, shop.last_order).midnight(30 * RECENT_MONTHS)) & (F.col("transaction_id") % 2 == 0)
    reports = []
    for part in (lines.where(~late), lines.where(late)):
        part.hint("rebalance", MONTH).write.mode("append").partitionBy(MONTH).parquet(f"{root}/fact")
        reports.append(jobs.refresh_views_by_delta(shop.users(), f"{root}/fact", f"{root}/views", shop.last_order))
    return f"{root}/views", reports


def _delta_view(shop: Shop, name: str) -> DataFrame:
    return VersionedTable(shop.spark, f"{_refreshed_by_delta(shop)[0]}/{name}").read()


def _delta_report(shop: Shop) -> DataFrame:
    rows = [(i, name, n) for i, report in enumerate(_refreshed_by_delta(shop)[1]) for name, n in report.rows.items()]
    return shop.spark.createDataFrame(rows, "refresh bigint, name string, rows bigint")


def _active_users(shop: Shop) -> DataFrame:
    """Daily, weekly and 30-day users from a stored table of the days' bitmaps."""
    return states.active_users(materialize(states.day_users(shop.orders()), "day-users"))


def _report(shop: Shop, report: jobs.JobReport) -> DataFrame:
    rows = [(name, n, report.decision) for name, n in report.rows.items()]
    return shop.spark.createDataFrame(rows, "table_name string, rows bigint, decision string")


def _nightly(shop: Shop) -> DataFrame:
    """The nightly run: what it wrote, table by table."""
    users = shop.users().select(
        "user_id",
        "email",
        F.lit(None).cast("string").alias("customer_segment"),
        F.lit(None).cast("decimal(3,2)").alias("churn_risk_score"),
    )
    log = shop.spark.createDataFrame([], DAILY_REPORT_LOG)
    return _report(shop, jobs.run_nightly(users, shop.orders(), log, scratch_path(shop.spark, "nightly"), shop.last_order))


def _exported_marts(shop: Shop) -> DataFrame:
    """The export with its marts: rows of each table."""
    marts = {
        "mart_rfm_segments": customers.mart_rfm_segments(customers.int_rfm_scores(_staged(shop), shop.last_order)),
        "mart_churn_features": _features(shop),
        "mart_daily_snapshot": _snapshot(shop),
    }
    rows = jobs.run_export(shop.lines(), marts, scratch_path(shop.spark, "export"))
    return shop.spark.createDataFrame(list(rows.items()), "table_name string, rows bigint")


def _observed_marts(shop: Shop) -> DataFrame:
    """Rows and row checks of two marts, as the jobs told them that wrote the marts."""
    marts = {
        "mart_rfm_segments": customers.mart_rfm_segments(customers.int_rfm_scores(_staged(shop), shop.last_order)),
        "mart_churn_features": _features(shop),
    }
    told = {name: write_observed(df, scratch_path(shop.spark, name), jobs.mart_measures(name)) for name, df in marts.items()}
    rows = [(name, measure, n) for name, counts in told.items() for measure, n in counts.items()]
    return shop.spark.createDataFrame(rows, "table_name string, measure string, rows bigint")


def _experiment_metrics(shop: Shop) -> DataFrame:
    """Two days of experiment metrics, upserted one after the other."""
    table = VersionedTable(shop.spark, scratch_path(shop.spark, "ab-metrics"))
    metrics = shop.spark.createDataFrame([], AB_METRICS)
    orders, assignments = shop.orders(), _assignments(shop)
    for days_back in (1, 0, 0):  # the last day is run twice and stays one
        moment = Anchor(orders, shop.last_order).midnight(days_back)
        jobs.run_experiment_metrics(assignments, orders.filter(F.col(TS) <= moment), metrics, table, moment)
        metrics = table.read()
    return metrics


JOBS = {
    "nightly_run": _nightly,
    "export_marts": _exported_marts,
    "mart_checks_observed": _observed_marts,
    "ab_metrics_upsert": _experiment_metrics,
    "refresh_views": _refreshed,
    "refresh_delta_daily": lambda s: _delta_view(s, "daily_metrics"),
    "refresh_delta_users": lambda s: _delta_view(s, "user_metrics"),
    "refresh_delta_report": _delta_report,
    "active_users": _active_users,
    "export_then_read": lambda s: _exported(s).groupBy("txn_month").agg(
        F.count("*").alias("rows"), F.sum("total_amount").alias("revenue")
    ),
    "cohort_job": _cohort_table,
}


DELIVERIES = 4


def _micros(column: str) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp"))


def _cuts(shop: Shop) -> list[int]:
    """Where the deliveries begin and the last one ends, in microseconds."""
    bounds = shop.table("events").agg(F.min("ts").alias("low"), F.max("ts").alias("high"))
    low, high = (x or 0 for x in bounds.select(_micros("low"), _micros("high")).first())
    return [low + (high - low) * i // DELIVERIES for i in range(DELIVERIES)] + [high + 1]


def _deliver(shop: Shop, inbox: str) -> Iterator[None]:
    """The event table split by time into a few deliveries; the next is written when the last was taken.

    Rows without a time come with the last delivery. A delivery has a file for each core: a stream
    reads a small file in one task, and a few large ones would keep all messages in a few tasks.
    """
    fact, cuts, at = shop.table("events"), _cuts(shop), _micros("ts")
    files = shop.spark.sparkContext.defaultParallelism
    for i, (begin, end) in enumerate(zip(cuts, cuts[1:])):
        inside = (at >= begin) & (at < end)
        due = fact.filter(inside | at.isNull() if i == DELIVERIES - 1 else inside)
        due.repartition(files).write.mode("append").parquet(inbox)
        yield


def _messages(shop: Shop, inbox: str, *columns) -> DataFrame:
    """The event table as a stream of JSON messages, as a broker would deliver them."""
    return _as_messages(parquet_stream(shop.spark, inbox, "*.parquet", shop.table("events").schema), *columns).select("value")


def _as_messages(stream: DataFrame, *columns) -> DataFrame:
    """Rows of the event table with the message of each as ``value``."""
    quantity = (F.pmod(F.col("event_id"), F.lit(4)) + 1).cast("int")
    fields = [
        F.col("event_id").cast("string").alias("event_id"),
        "event_type",
        "user_id",
        session_id().alias("session_id"),
        F.from_json("props", "k BIGINT")["k"].alias("product_id"),
        quantity.alias("quantity"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
    ]
    return stream.withColumn("value", F.to_json(F.struct(*fields, *columns)))


def _run_deliveries(shop: Shop, start: Callable[[str], StreamingQuery]) -> None:
    """A pass over each delivery with the same checkpoint, so that each is one micro-batch.

    A batch that ended inside a delivery would move the watermark past the rest of it.
    """
    inbox = scratch_path(shop.spark, "deliveries")
    for _ in _deliver(shop, inbox):
        start(inbox).awaitTermination()


def _keyed_result(shop: Shop, stream: Callable[[str], DataFrame], label: str, keys: list[str]) -> DataFrame:
    """Run a stream over everything there is and return the newest row per key."""
    path = scratch_path(shop.spark, label)
    _run_deliveries(
        shop,
        lambda inbox: sinks.start_keyed(
            stream(inbox), f"{path}/updates", f"{path}/checkpoint", available_now=True, keys=keys, compact_every=3
        ),
    )
    return sinks.read_keyed(shop.spark, f"{path}/updates", keys)


def _stream_event_counts(shop: Shop) -> DataFrame:
    counts = lambda inbox: events.event_counts(events.parse_events(_messages(shop, inbox)))
    return _keyed_result(shop, counts, "event-counts", ["window_start", "event_type"])


def _purchase_messages(shop: Shop, inbox: str) -> DataFrame:
    return _purchase_fields(parquet_stream(shop.spark, inbox, "*.parquet", shop.table("events").schema)).select("value")


def _purchase_fields(stream: DataFrame) -> DataFrame:
    price = F.try_divide(money("value"), F.pmod(F.col("event_id"), F.lit(4)) + 1).cast("decimal(12,2)")
    return _as_messages(stream, price.alias("unit_price"), money("value").alias("total_amount"))


def _stream_ingest(shop: Shop) -> DataFrame:
    path = scratch_path(shop.spark, "ingest")
    rows = lambda inbox: purchase_stream.ingest_transactions(_purchase_messages(shop, inbox))
    _run_deliveries(
        shop,
        lambda inbox: sinks.start_append(
            rows(inbox), f"{path}/table", f"{path}/checkpoint", ["txn_month"], available_now=True
        ),
    )
    return shop.spark.read.parquet(f"{path}/table").withColumn("txn_month", F.col("txn_month").cast("string"))


def _stream_user_totals(shop: Shop) -> DataFrame:
    totals = lambda inbox: purchase_stream.running_user_totals(
        purchase_stream.ingest_transactions(_purchase_messages(shop, inbox))
    )
    return _keyed_result(shop, totals, "user-totals", ["user_id"])


def _stream_sessions(shop: Shop) -> DataFrame:
    days = lambda inbox: events.session_rollup(events.parse_events(_messages(shop, inbox)), lateness="1 hour")
    return events.merge_sessions(_keyed_result(shop, days, "sessions", ["day", "session_id"])).drop("device")


def _stream_closed_sessions(shop: Shop) -> DataFrame:
    """Sessions of users by inactivity that the watermark has closed when all deliveries were taken."""
    path = scratch_path(shop.spark, "closed-sessions")
    closed = lambda inbox: events.inactivity_sessions(events.parse_events(_messages(shop, inbox)), lateness="1 hour")
    _run_deliveries(
        shop, lambda inbox: sinks.start_append(closed(inbox), f"{path}/table", f"{path}/checkpoint", available_now=True)
    )
    return shop.spark.read.parquet(f"{path}/table")


def _spoiled_messages(shop: Shop, inbox: str) -> DataFrame:
    """Purchase messages of which some are cut off, lack their amount, come twice or far too late."""
    last = _cuts(shop)[-2]
    events_ = parquet_stream(shop.spark, inbox, "*.parquet", shop.table("events").schema)
    every = lambda n: F.col("event_id") % n == 0
    late = every(79) & (_micros("ts") >= last)
    moved = events_.withColumn("ts", F.when(late, F.col("ts") - F.expr("INTERVAL 20 DAYS")).otherwise(F.col("ts")))
    lacking = moved.withColumn("value", F.when(~every(89), F.col("value")))
    whole = _purchase_fields(lacking).withColumn("copies", F.when(every(83), 2).otherwise(1))
    cut = F.when(every(97), F.expr("left(value, length(value) - 10)")).otherwise(F.col("value"))
    return whole.select(cut.alias("value"), F.explode(F.expr("sequence(1, copies)"))).select("value")


def _ingest_account(shop: Shop) -> DataFrame:
    """What became of the spoiled messages: one row per outcome, the rows of table and quarantine counted."""
    path, passes = scratch_path(shop.spark, "account"), []

    def take(inbox: str) -> StreamingQuery:
        messages = _spoiled_messages(shop, inbox)
        bad = purchase_stream.quarantined_messages(messages)
        sinks.start_append(bad, f"{path}/quarantine", f"{path}/checkpoint-bad", available_now=True).awaitTermination()
        good = purchase_stream.ingest_transactions(purchase_stream.accounted_messages(messages))
        passes.append(sinks.start_append(good, f"{path}/table", f"{path}/checkpoint", ["txn_month"], available_now=True))
        return passes[-1]

    _run_deliveries(shop, take)
    told = purchase_stream.account_of(passes)
    counted = {name: shop.spark.read.parquet(f"{path}/{name}").count() for name in ("table", "quarantine")}
    rows = [(name, n) for name, n in {**told, "kept": counted["table"], "quarantine_rows": counted["quarantine"]}.items()]
    return shop.spark.createDataFrame(rows, "outcome string, rows bigint")


STREAMS = {
    "stream_sessions_closed": _stream_closed_sessions,
    "stream_ingest_account": _ingest_account,
    "stream_event_counts": _stream_event_counts,
    "stream_ingest_transactions": _stream_ingest,
    "stream_user_totals": _stream_user_totals,
    "stream_session_rollup": _stream_sessions,
    "event_funnel": lambda s: events.event_funnel(s.events(), ["view", "click", "purchase"]),
}

def _training(shop: Shop) -> DataFrame:
    return churn.churn_training_set(shop.orders(), shop.last_order)


def _scoring(shop: Shop) -> DataFrame:
    return churn.churn_scoring_set(shop.orders(), shop.last_order)


def _training_report(shop: Shop) -> DataFrame:
    """The candidates' AUC and what the gates decide; few rows are a decision, too.

    What the gates promote is fitted on all rows and stored, and told as it was stored.
    """
    try:
        prepared = ml.prepare_training(_training(shop))
        report, decision = ml.churn_candidates(prepared)
    except ml.GateError:
        report, decision = {}, "too few rows"
    chosen = ml.choose(report) if report else None
    if decision == "promote":
        model = ml.churn_store(prepared, ml.churn_refit(prepared, report), scratch_path(shop.spark, "churn-model"))
        report, chosen = model.report, model.name
    rows = [(name, auc, name == chosen, decision) for name, auc in report.items()] or [(None, None, None, decision)]
    return shop.spark.createDataFrame(rows, "candidate string, cv_auc double, chosen boolean, decision string")


def _fitted(shop: Shop) -> ml.ChurnModel:
    """The boosted trees on all rows, to explain and describe them; scoring asks the gates."""
    return ml.churn_fit(_training(shop))


def _scored(shop: Shop) -> DataFrame:
    """Scores of the model that passes the gates, else of the heuristic."""
    try:
        model = ml.churn_train(_training(shop))
    except ml.GateError:
        model = None
    return ml.churn_score_batch(_scoring(shop), model)


def _holdout(shop: Shop) -> DataFrame:
    try:
        return ml.churn_holdout_eval(_training(shop))
    except ml.GateError:
        return shop.spark.createDataFrame([(None, "too few rows")], "churn_auc double, decision string")


def _promoted(shop: Shop) -> DataFrame:
    """The registry after the segment edges of two days were promoted one after the other."""
    registry = shop.spark.createDataFrame([], MODEL_REGISTRY)
    for days_back in (30, 0):
        orders = shop.orders()
        until = orders.filter(F.col(TS) < Anchor(orders, shop.last_order).midnight(days_back - 1))
        edges = customers.rfm_breakpoints(customers.user_metrics(shop.users(), until))
        registry = ml.register_rfm(registry, edges, f"minus-{days_back}", shop.last_order)
    return registry


# A small ensemble over the four features below, to check the explanation in SQL.
EXPLAINED = ["recency_days", "frequency", "monetary", "tenure_days"]
SMALL_ENSEMBLE = [
    (0, 0, 0, 120.0, 1, 2, None, 1000.0, 1.0),
    (0, 1, 1, 10.0, 3, 4, None, 600.0, 1.0),
    (0, 2, 2, 1500000.0, 5, 6, None, 400.0, 1.0),
    (0, 3, None, None, -1, -1, -0.2, 350.0, 1.0),
    (0, 4, None, None, -1, -1, -0.8, 250.0, 1.0),
    (0, 5, 0, 400.0, 7, 8, None, 150.0, 1.0),
    (0, 6, None, None, -1, -1, 0.9, 250.0, 1.0),
    (0, 7, None, None, -1, -1, 0.3, 120.0, 1.0),
    (0, 8, None, None, -1, -1, 0.7, 30.0, 1.0),
    (1, 0, 1, 15.0, 1, 2, None, 1000.0, 0.1),
    (1, 1, 3, 1500.0, 3, 4, None, 700.0, 0.1),
    (1, 2, None, None, -1, -1, -0.6, 300.0, 0.1),
    (1, 3, None, None, -1, -1, 0.4, 300.0, 0.1),
    (1, 4, 0, 60.0, 5, 6, None, 400.0, 0.1),
    (1, 5, None, None, -1, -1, -0.5, 250.0, 0.1),
    (1, 6, None, None, -1, -1, 0.2, 150.0, 0.1),
]


def _explained(shop: Shop) -> DataFrame:
    """Shapley values of every buyer under the small ensemble, and the margin they add up to."""
    nodes = shop.spark.createDataFrame(SMALL_ENSEMBLE, shapley.NODES)
    found = shapley.tree_contributions(_scoring(shop), nodes, EXPLAINED)
    margin = sum((F.col(f) for f in EXPLAINED), F.col("bias"))
    # a zero without a sign
    return found.select("user_id", *[(F.round(c, 9) + 0.0).alias(n) for n, c in [*((f, F.col(f)) for f in EXPLAINED), ("margin", margin)]])


def _heuristic_report(shop: Shop) -> DataFrame:
    """The heuristic's scores of the training rows, stored and judged against their labels."""
    rows = _training(shop)
    scores = rows.select("churned", churn.heuristic_probability().cast("double").alias("churn_probability"))
    return ml.score_report(materialize(scores, "scores"))


MODEL = {
    "churn_train": _training_report,
    "churn_score_batch": _scored,
    "churn_score_heuristic": lambda s: ml.churn_score_batch(churn.churn_feature_prep(_metrics(s)), None),
    "churn_model_factors": lambda s: ml.churn_model_factors(_scoring(s), _fitted(s)),
    "churn_model_report": lambda s: ml.churn_model_report(_training(s), _fitted(s)),
    "churn_holdout_eval": _holdout,
    "churn_tree_contributions": _explained,
    "churn_heuristic_report": _heuristic_report,
    "rfm_silhouette": lambda s: ml.rfm_silhouette(_metrics(s)),
    "model_registry_promote": _promoted,
}

GROUPS = (STAGING, KPI, CUSTOMERS, CHURN, PRODUCTS, RECOMMENDATIONS, EXPERIMENTS, TABLES, QUALITY, JOBS, STREAMS, MODEL)


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    bound = {}
    for group in GROUPS:
        for name, build in group.items():
            bound[name] = lambda spark, folder, build=build: portable(build(Shop(spark, folder)))
    return bound
