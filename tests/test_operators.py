"""Boundary rows of the batch operators."""

import datetime as dt
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tillview.functions.dates import elapsed_months
from tillview.functions.hashing import fnv1a32
from tillview.functions.numeric import ratio
from tillview.operators import churn, cohorts, customers, experiments, kpi, products, quality, tables, trends
from tillview.sources.shop import Shop


def one(df):
    return df.first().asDict()


# --- arithmetic ---------------------------------------------------------------


def test_ratio_rounds_ties_away_from_zero(spark):
    df = spark.createDataFrame([(201, 200), (-201, 200), (1, 0)], "a bigint, b bigint")
    assert [r.x for r in df.select(ratio("a", "b", 2).alias("x")).collect()] == [Decimal("1.01"), Decimal("-1.01"), None]


@pytest.mark.parametrize(
    "start,end,months",
    [("2024-01-31", "2024-02-29", 0), ("2024-01-31", "2024-03-31", 2), ("2023-12-15", "2024-01-14", 0), ("2023-12-15", "2024-01-15", 1)],
)
def test_elapsed_months_at_month_ends(spark, start, end, months):
    df = spark.range(1).select(elapsed_months(F.lit(start).cast("date"), F.lit(end).cast("date")).alias("m"))
    assert df.first().m == months


@pytest.mark.parametrize("text,value", [("", 0x811C9DC5), ("a", 0xE40C292C), ("foobar", 0xBF9CF968)])
def test_fnv_published_vectors(spark, text, value):
    assert spark.createDataFrame([(text,)], "t string").select(fnv1a32(F.col("t")).alias("h")).first().h == value


# --- KPIs ---------------------------------------------------------------------


def test_realtime_kpi_is_zero_when_nothing_happened(sales):
    fact = sales([(1, 1, 1, "2024-01-01 10:00:00", 2, 5)])
    row = one(kpi.realtime_kpi(fact, "2024-01-05 00:00:00"))
    assert {k: float(v) for k, v in row.items()} == dict.fromkeys(row, 0.0)


def test_last_hour_includes_its_first_instant(sales):
    fact = sales([(1, 1, 1, "2024-01-01 09:00:00", 2, 5), (2, 1, 1, "2024-01-01 08:59:59", 2, 7)])
    assert one(kpi.realtime_kpi(fact, "2024-01-01 10:00:00"))["revenue"] == 5


def test_change_against_an_empty_day_is_zero(sales):
    fact = sales([(1, 1, 1, "2024-01-02 10:00:00", 1, 5), (2, 2, 1, "2024-01-02 11:00:00", 1, 5)])
    row = one(kpi.today_vs_yesterday(fact))
    assert (row["today_users"], row["yesterday_users"], row["today_revenue"]) == (2, 0, 10)
    assert row["user_change_pct"] == row["revenue_change_pct"] == 0


@pytest.mark.parametrize("change,label", [(5.0, "flat"), (5.01, "up"), (-5.0, "flat"), (-5.01, "down")])
def test_momentum_edges(spark, change, label):
    assert one(kpi.revenue_momentum(spark.createDataFrame([(change,)], "revenue_change_pct double")))["momentum"] == label


def test_new_and_returning(sales):
    fact = sales(
        [
            (1, 1, 1, "2024-01-01 10:00:00", 1, 5),
            (2, 1, 1, "2024-01-02 10:00:00", 1, 7),
            (3, 2, 1, "2024-01-02 10:00:00", 1, 1),
            (4, 2, 1, "2024-01-02 23:00:00", 1, 2),
            (5, 2, 1, "2024-01-03 00:00:00", 1, 100),
        ]
    )
    rows = {r.customer_type: (r.customers, r.transactions, float(r.revenue)) for r in kpi.new_vs_returning(fact, "2024-01-02 12:00:00").collect()}
    assert rows == {"New": (1, 2, 3.0), "Returning": (1, 1, 7.0)}


def test_daily_metrics_tells_first_time_from_all_buyers(sales):
    fact = sales([(1, 1, 1, "2024-01-01", 1, 5), (2, 1, 1, "2024-01-02", 1, 5), (3, 2, 1, "2024-01-02", 1, 5)])
    rows = {str(r.metric_date): (r.new_customers, r.first_time_customers) for r in kpi.daily_metrics(fact).collect()}
    assert rows == {"2024-01-01": (1, 1), "2024-01-02": (2, 1)}


def test_persona_profile_keeps_non_buyers(spark, sales):
    users = spark.createDataFrame([(1, "A"), (2, "A"), (3, "B")], "user_id bigint, persona string")
    fact = sales([(1, 1, 1, "2024-01-01", 1, 5), (2, 1, 1, "2024-06-01", 1, 6)])
    rows = {r.persona: r for r in kpi.persona_profile(fact, users, "2024-09-01").collect()}
    assert (rows["A"].users, rows["A"].transactions, rows["A"].churn_pct) == (2, 2, Decimal("50.0"))
    assert (rows["B"].transactions, rows["B"].avg_recency_days, rows["B"].churn_pct) == (0, None, 0)


def test_weekly_growth_has_no_first_value(spark):
    weekly = spark.createDataFrame([("2024-01-01", 100.0), ("2024-01-08", 150.0), ("2024-01-15", 0.0), ("2024-01-22", 5.0)], "week_start string, revenue double")
    assert [r.wow_pct for r in trends.weekly_growth(weekly).orderBy("week_start").collect()] == [None, 50.0, -100.0, None]


# --- customers ------------------------------------------------------------------


def test_non_buyers_have_recency_9999(spark, sales):
    users = spark.createDataFrame([(1, "a"), (2, "b")], "user_id bigint, email string")
    rows = {r.user_id: r for r in customers.user_metrics(users, sales([(1, 1, 1, "2024-01-01", 3, 5)]), "2024-01-11").collect()}
    assert (rows[1].recency_days, rows[1].frequency, rows[1].total_items_purchased) == (10, 1, 3)
    assert (rows[2].recency_days, rows[2].frequency, rows[2].monetary, rows[2].avg_order_value) == (9999, 0, 0, 0)


def test_segment_rules_over_all_scores(spark):
    grid = spark.range(125).selectExpr("id div 25 + 1 AS r_score", "(id div 5) % 5 + 1 AS f_score", "id % 5 + 1 AS m_score")
    mart = {r.s: r.n for r in grid.groupBy(customers.segment_of().alias("s")).agg(F.count("*").alias("n")).collect()}
    classic = {r.s for r in grid.select(customers.segment_of(customers.CLASSIC_RULES).alias("s")).distinct().collect()}
    assert sum(mart.values()) == 125
    assert "At Risk" in mart and not {"Cannot Lose Them", "Lost"} & set(mart)
    assert "At Risk" not in classic
    only_other = grid.filter(customers.segment_of() == "Other")
    assert only_other.filter("NOT (r_score = 3 AND f_score <= 2 AND m_score <= 3)").count() == 0


def test_segment_shares_sum_to_100(spark):
    base = spark.range(1, 501).selectExpr("id AS user_id", "id * 7 % 91 AS recency_days", "id % 9 AS frequency", "CAST(id * 13 % 977 AS DECIMAL(12,2)) AS monetary")
    rows = customers.rfm_segment_summary(base).collect()
    assert sum(r.customer_count for r in rows) == 500
    assert abs(sum(r.segment_percentage for r in rows) - 100) <= Decimal("0.05")


def test_histogram_of_equal_values_is_one_bin(spark):
    df = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    assert [(r.bin, r.customers) for r in customers.equal_width_histogram(df, "x", 5).collect()] == [(0, 2)]


# --- churn ----------------------------------------------------------------------


def test_tenure_zero(sales):
    fact = sales([(1, 1, 1, "2024-01-01", 1, 5)]).withColumn("transaction_date", F.to_date("transaction_date"))
    row = one(churn.mart_churn_features(fact))
    assert (row["tenure_days"], row["purchase_velocity"], row["recency_ratio"]) == (0, 0, 1)


def test_training_label_window(sales):
    fact = sales(
        [
            (1, 1, 1, "2024-01-01", 1, 5),
            (2, 2, 1, "2024-01-01", 1, 5),
            (3, 2, 1, "2024-01-02", 1, 5),
            (4, 3, 1, "2024-01-20", 1, 5),
            (5, 1, 1, "2024-01-31", 1, 5),
        ]
    )
    rows = {r.user_id: (r.churned, r.frequency, r.tenure_days) for r in churn.churn_training_set(fact).collect()}
    # snapshot 2024-01-01: user 1 and 2 return later, user 3 is unknown then
    assert rows == {1: (0, 1, 1), 2: (0, 1, 1)}


def test_heuristic_and_reasons(spark):
    df = spark.createDataFrame([(1, 365, 0, 50.4), (2, 0, 20, 500.0), (3, 91, 2, 99.0)], "user_id bigint, recency_days bigint, frequency bigint, monetary double")
    scored = {r.user_id: (float(r.churn_probability), r.churn_risk_label) for r in churn.churn_heuristic(df).collect()}
    assert scored[1] == (1.0, "High") and scored[2] == (0.0, "Low")
    reasons = {r.user_id: r.top_risk_factors for r in churn.churn_rule_factors(df).collect()}
    assert reasons[2] == ["Insufficient purchase history"]
    assert reasons[3] == ["High recency — 91 days since last purchase", "Low frequency — only 2 orders"]


def test_feature_prep_guesses_tenure(spark):
    df = spark.createDataFrame([(1, 10, 2, 5.0, 2.5)], "user_id bigint, recency_days bigint, frequency bigint, monetary double, avg_order_value double")
    assert one(churn.churn_feature_prep(df))["tenure_days"] == 60.0


def test_pages_do_not_overlap(spark):
    scores = spark.range(50).selectExpr("id AS user_id", "CAST(0.9 AS DECIMAL(3,2)) AS churn_risk_score")
    metrics = spark.range(50).selectExpr("id AS user_id", "'e' AS email", "1 AS recency_days", "1 AS frequency", "1 AS monetary")
    pages = [{r.user_id for r in churn.at_risk_customers(scores, metrics, page=p).collect()} for p in (1, 2, 3)]
    assert [len(p) for p in pages] == [20, 20, 10] and len(set.union(*pages)) == 50


# --- cohorts and products --------------------------------------------------------


def test_cohort_offset_zero_is_whole(sales):
    fact = sales([(i, i % 4, 1, f"2024-0{1 + i % 5}-10", 1, 5) for i in range(40)])
    rows = cohorts.cohort_retention(fact).collect()
    assert all(r.retention_rate == 1 for r in rows if r.months_since_first == 0)
    assert all(r.retained_users <= r.cohort_size for r in rows)


def test_registration_cohort_counts_non_buyers(spark, sales):
    users = spark.createDataFrame([(1, dt.date(2024, 1, 5)), (2, dt.date(2024, 1, 9))], "user_id bigint, registration_date date")
    row = one(cohorts.cohort_registration(users, sales([(1, 1, 1, "2024-03-10", 1, 8)])))
    assert (row["cohort_size"], row["active_users"], row["retention_rate"], row["months_since_registration"]) == (2, 1, 50, 2)


def test_inventory_alerts_and_products_without_sales(spark, sales):
    catalogue = spark.createDataFrame(
        [(1, 10), (2, 100), (3, 70), (4, 69), (5, 20)], "product_id bigint, stock_quantity bigint"
    ).selectExpr("product_id", "'p' AS product_name", "'c' AS category", "stock_quantity")
    fact = sales([(1, 1, 1, "2024-01-02 10:00:00", 5, 1), (2, 1, 3, "2024-01-02 10:00:00", 10, 1), (3, 1, 4, "2024-01-02 10:00:00", 10, 1), (4, 1, 2, "2023-12-01", 90, 1)])
    alerts = products.inventory_alerts(fact, catalogue)
    assert [(r.product_id, r.days_until_stockout) for r in alerts.collect()] == [(1, Decimal("2.0")), (4, Decimal("6.9")), (5, None)]
    assert one(products.inventory_severity(alerts)) == {"critical": 1, "warning": 1, "no_recent_sales": 1}


# --- experiments ------------------------------------------------------------------


def test_conversion_window_has_both_ends(spark, sales):
    moment = F.lit("2024-01-01 12:00:00").cast("timestamp_ntz")
    assigned = spark.createDataFrame([(u, "control") for u in range(1, 6)], "user_id bigint, variant string").withColumns(
        {"experiment_key": F.lit(experiments.EXPERIMENT_KEY), "assigned_at": moment}
    )
    fact = sales(
        [
            (1, 1, 1, "2024-01-01 12:00:00", 1, 1),
            (2, 2, 1, "2024-01-08 12:00:00", 1, 1),
            (3, 3, 1, "2024-01-08 12:00:00.000001", 1, 1),
            (4, 4, 1, "2024-01-01 11:59:59.999999", 1, 1),
            (5, 1, 1, "2024-01-02 12:00:00", 1, 1),
        ]
    )
    row = one(experiments.ab_conversion(assigned, fact))
    assert (row["assigned_users"], row["converted_users"], row["conversion_rate"]) == (5, 2, Decimal("0.4"))


def test_assignment_is_sticky_and_even(spark):
    users = spark.range(4000).selectExpr("id AS user_id", "CAST(IF(id % 4 = 0, NULL, 0.8) AS DECIMAL(3,2)) AS churn_risk_score")
    offers = experiments.ab_assign(experiments.ab_eligibility(users))
    first = experiments.ab_assignments(offers, F.lit("2024-01-01").cast("timestamp"))
    again = experiments.ab_log_sticky(first, experiments.ab_assignments(offers, F.lit("2024-02-01").cast("timestamp")))
    assert again.exceptAll(first).count() == 0 and again.count() == 3000
    share = first.filter("variant = 'control'").count() / 3000
    assert 0.45 < share < 0.55


# --- tables -----------------------------------------------------------------------


def test_upsert_and_insert_if_absent(spark):
    target = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, t int")
    batch = spark.createDataFrame([(2, "c", 3), (2, "d", 2), (3, "e", 5), (3, "f", 4)], "k int, v string, t int")
    upserted = {r.k: r.v for r in tables.upsert_by_key(target, batch, ["k"], "t").collect()}
    assert upserted == {1: "a", 2: "c", 3: "e"}
    inserted = {r.k: r.v for r in tables.insert_if_absent(target, batch, ["k"], "t").collect()}
    assert inserted == {1: "a", 2: "b", 3: "f"}
    twice = tables.insert_if_absent(tables.insert_if_absent(target, batch, ["k"], "t"), batch, ["k"], "t")
    assert twice.count() == 3


def test_write_backs_keep_users_outside_the_mart(spark):
    users = spark.createDataFrame([(1, "Old", 0.5), (2, "Old", 0.5)], "user_id int, customer_segment string, s double").select(
        "user_id", "customer_segment", F.col("s").cast("decimal(3,2)").alias("churn_risk_score")
    )
    segments = spark.createDataFrame([(1, "Lost")], "user_id int, customer_segment string")
    features = spark.createDataFrame([(1, 800, 2)], "user_id int, recency_days bigint, frequency bigint")
    done = tables.apply_churn_to_users(tables.apply_rfm_to_users(users, segments), features)
    rows = {r.user_id: (r.customer_segment, float(r.churn_risk_score)) for r in done.collect()}
    assert rows == {1: ("Lost", 1.0), 2: ("Old", 0.5)}


# --- data quality -------------------------------------------------------------------


@pytest.fixture
def bad_rows(sales):
    return sales(
        [
            (1, None, 1, "2024-01-01", 1, 5),
            (2, 1, 1, "2024-01-01", 0, 5),
            (3, 1, 1, "2024-01-01", 1, -1),
            (3, 1, 1, "2024-01-01", 1, None),
            (4, 77, 1, "2024-01-02", 1, 5),
            (5, 1, 1, "2024-01-02", 1, 5),
        ]
    )


def test_planted_defects_are_found(spark, bad_rows):
    users = spark.createDataFrame([(1,)], "user_id bigint")
    value = lambda df: (one(df)["status"], one(df)["value"])
    assert value(quality.dq_null_user_ids(bad_rows)) == ("fail", 1)
    assert value(quality.dq_null_amounts(bad_rows)) == ("fail", 2)
    assert value(quality.dq_orphans(bad_rows, users)) == ("fail", 2)
    assert value(quality.dq_duplicates(bad_rows)) == ("fail", 1)
    assert value(quality.dq_unique(bad_rows, "transaction_id")) == ("fail", 1)
    assert value(quality.dq_row_minimum(bad_rows, 7)) == ("fail", 6)
    assert value(quality.dq_row_minimum(bad_rows, 6)) == ("pass", 6)
    assert value(quality.dq_not_null(bad_rows, ["user_id"])) == ("fail", 1)
    summary = one(quality.dq_summary([quality.row_checks(bad_rows), quality.dq_row_minimum(bad_rows, 6)]))
    assert summary == {"total": 3, "passed": 1, "failed": 2, "status": "fail"}
    reasons = {(r.transaction_id, tuple(r.reasons)) for r in quality.quarantined_transactions(bad_rows).collect()}
    assert reasons == {(1, ("user_id is null",)), (2, ("quantity below 1",)), (3, ("total_amount below 0",))}
    # like a CHECK, the bound lets a NULL amount through
    assert quality.valid_transactions(bad_rows).count() == 3


@pytest.mark.parametrize("amount,status", [(9, "fail"), (10, "pass"), (300, "pass"), (301, "fail")])
def test_revenue_ratio_edges(sales, amount, status):
    week = [(i, 1, 1, f"2024-01-0{i}", 1, 100) for i in range(1, 8)]
    fact = sales(week + [(8, 1, 1, "2024-01-08", 1, amount), (9, 1, 1, "2024-01-09", 1, 1)])
    assert one(quality.dq_revenue_anomaly(fact))["status"] == status


def test_anomaly_passes_without_a_mean(sales):
    fact = sales([(8, 1, 1, "2024-01-08", 1, 5), (9, 1, 1, "2024-01-09", 1, 1)])
    assert one(quality.dq_revenue_anomaly(fact)) == {"check_name": "revenue_anomaly", "status": "pass", "value": None}


def test_daily_gate(spark, sales, bad_rows):
    users = spark.createDataFrame([(1,)], "user_id bigint")
    fine = sales([(1, 1, 1, "2024-01-01", 1, 5), (2, 1, 1, "2024-01-02", 1, 5)])
    assert one(quality.dq_daily_gate(fine, users))["decision"] == "pass"
    assert one(quality.dq_daily_gate(fine, users, "2024-03-01"))["decision"] == "skip"
    assert one(quality.dq_daily_gate(bad_rows, users))["decision"] == "fail_alert"


def test_stale_tables(spark):
    log = spark.createDataFrame([("a", "2024-01-01 10:00:00"), ("a", "2024-01-01 07:00:00"), ("b", "2024-01-01 09:59:00")], "table_name string, t string")
    log = log.select("table_name", F.col("t").cast("timestamp").alias("computed_at"))
    rows = {r.check_name: r.status for r in quality.dq_stale_tables(log, "2024-01-01 12:00:00").collect()}
    assert rows == {"stale_a": "pass", "stale_b": "fail"}


def test_shuffles_grow_with_the_tables(spark, monkeypatch):
    from tillview import session

    settings = ["spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes"]
    folder = "/root/testdata/sf0.01"
    planned = lambda: Shop(spark, folder).orders().groupBy("user_id").count()._jdf.queryExecution().executedPlan().toString()
    for name in settings:
        spark.conf.unset(name)
    try:
        assert re.search(r"hashpartitioning\(user_id#\d+L, 8\b", planned())  # the session's own number is enough
        monkeypatch.setattr(session, "TABLE_BYTES_PER_PARTITION", 5_000, raising=False)
        assert int(re.search(r"hashpartitioning\(user_id#\d+L, (\d+)", planned())[1]) > 50
    finally:
        for name in settings:
            spark.conf.unset(name)


def test_scans_of_large_tables_have_small_tasks(spark, monkeypatch):
    from tillview import session

    settings = {
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes",
        "spark.sql.files.maxPartitionBytes",
    }
    try:
        monkeypatch.setattr(session, "TABLE_BYTES_PER_PARTITION", 5_000)
        monkeypatch.setattr(session, "SCAN_BYTES_PER_TASK", "16k", raising=False)
        assert Shop(spark, "/root/testdata/sf0.01").table("lineitem").rdd.getNumPartitions() > 20
    finally:
        for name in settings:
            spark.conf.unset(name)
