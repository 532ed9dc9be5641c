"""Scheduled jobs, versioned tables and the declared storage folder."""

import pytest
from pyspark.sql import functions as F

from tillview.operators import churn, customers, experiments, kpi, quality, staging, states, tables
from tillview.plans import jobs
from tillview.plans.filetable import FileTable
from tillview.sources import buckets, scratch
from tillview.sources.months import MonthlyParts, month_lists
from tillview.sources.readers import write_observed
from tillview.sources.schemas import AB_METRICS, DAILY_REPORT_LOG
from tillview.sources.versions import EmptyTableError, VersionedTable


@pytest.fixture
def shop(spark, sales):
    users = spark.range(1, 31).selectExpr(
        "id AS user_id", "concat('u', id) AS email", "CAST(NULL AS STRING) AS customer_segment",
        "CAST(NULL AS DECIMAL(3,2)) AS churn_risk_score",
    )
    fact = sales([(i, 1 + i % 29, i % 7, f"2024-01-{1 + i % 28:02d} 10:00:00", 1 + i % 3, 10 + i) for i in range(200)])
    fact = fact.withColumns(
        {"unit_price": F.col("total_amount"), "payment_method": F.lit("card"), "order_status": F.lit("completed")}
    )
    return users, fact


def test_versions_switch_only_when_complete(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    with pytest.raises(FileNotFoundError):
        table.read()
    assert table.replace(spark.range(5)) == 5
    old = table.read()
    with pytest.raises(EmptyTableError):
        table.replace(spark.range(0))
    assert table.read().count() == 5
    table.replace(spark.range(7))
    assert (old.count(), table.read().count()) == (5, 7)
    table.expire(keep=1)
    assert len(table.versions()) == 1 and table.read().count() == 7


def test_nightly_run(spark, shop, tmp_path):
    users, fact = shop
    log = spark.createDataFrame([], DAILY_REPORT_LOG)
    report = jobs.run_nightly(users, fact, log, str(tmp_path))
    assert report.decision == "pass" and not report.warnings
    assert report.rows["users"] == 30 and report.rows["mart_rfm_segments"] == 29
    updated = VersionedTable(spark, str(tmp_path / "users")).read()
    assert updated.filter("customer_segment IS NULL").count() == 1
    logged = VersionedTable(spark, str(tmp_path / "daily_report_log")).read()
    summary = kpi.notify_summary(fact, logged).first()
    assert logged.count() == 1 and summary.total_revenue > 0 and summary.transactions > 0


def test_nightly_run_stops_at_duplicates_and_skips_empty_days(spark, shop, tmp_path):
    users, fact = shop
    log = spark.createDataFrame([], DAILY_REPORT_LOG)
    assert jobs.run_nightly(users, fact, log, str(tmp_path), as_of="2024-06-01").decision == "skip"
    with pytest.raises(jobs.QualityError, match="unique_transaction_id"):
        jobs.run_nightly(users, fact.unionByName(fact), log, str(tmp_path))
    assert not list(tmp_path.iterdir())


def test_refresh_and_export(spark, shop, tmp_path):
    users, fact = shop
    assert jobs.refresh_views(users, fact, str(tmp_path / "views")).rows == {"daily_metrics": 28, "user_metrics": 30}
    with pytest.raises(EmptyTableError):
        jobs.refresh_views(users, fact.limit(0), str(tmp_path / "views"))
    snapshot = kpi.mart_daily_snapshot(staging.stg_transactions(fact))
    rows = jobs.run_export(fact, {"mart_daily_snapshot": snapshot}, str(tmp_path / "export"))
    assert rows == {"transactions": 200, "mart_daily_snapshot": 28}
    back = spark.read.parquet(str(tmp_path / "export" / "transactions"))
    plan = back.filter("txn_month = '2024-01'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(txn_month" in plan and back.count() == 200


def test_experiment_metrics_are_upserted(spark, shop, tmp_path):
    users, fact = shop
    table = VersionedTable(spark, str(tmp_path / "metrics"))
    metrics = spark.createDataFrame([], AB_METRICS)
    nobody = spark.createDataFrame([], "user_id bigint, experiment_key string, variant string, assigned_at timestamp")
    assert jobs.run_experiment_metrics(nobody, fact, metrics, table).decision == "skip"
    risky = users.withColumn("churn_risk_score", F.lit(0.9).cast("decimal(3,2)"))
    offers = experiments.ab_assign(experiments.ab_eligibility(risky))
    assigned = experiments.ab_assignments(offers, F.lit("2024-01-10").cast("timestamp_ntz"))
    for _ in range(2):
        jobs.run_experiment_metrics(assigned, fact, metrics, table)
        metrics = table.read()
    assert metrics.count() == 2 and metrics.agg(F.sum("assigned_users")).first()[0] == 30


def test_nothing_is_shown_before_its_test(spark, shop, tmp_path, monkeypatch):
    users, fact = shop
    monkeypatch.setattr(jobs.quality, "value_measures", lambda *a: {"x": F.count(F.lit(1))})
    with pytest.raises(jobs.QualityError):
        jobs.run_nightly(users, fact, spark.createDataFrame([], DAILY_REPORT_LOG), str(tmp_path))
    assert VersionedTable(spark, str(tmp_path / "mart_rfm_segments")).versions() == []


def test_runs_are_expired(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scratch, "scratch_root", lambda _: str(tmp_path))
    scratch.materialize(spark.range(3), "x")
    (tmp_path / "tillview-run-other").mkdir()
    (tmp_path / "kept").mkdir()
    assert scratch.expire_runs(spark, hours=100) == 1  # this application's own
    assert sorted(p.name for p in tmp_path.iterdir()) == ["kept", "tillview-run-other"]


def test_scratch_follows_the_session(spark):
    assert scratch.scratch_root(spark) == spark.conf.get("spark.checkpoint.dir")
    stored = scratch.materialize(spark.range(3), "x")
    assert stored.inputFiles()[0].startswith("file:" + scratch.scratch_root(spark)) or scratch.scratch_root(spark) in stored.inputFiles()[0]


def test_delta_refresh_equals_the_rebuild_and_reads_changed_months_only(spark, shop, tmp_path):
    users, fact = shop
    root, path = str(tmp_path / "views"), str(tmp_path / "fact")
    later = fact.selectExpr(
        "transaction_id + 1000 AS transaction_id", "user_id % 5 + 27 AS user_id", "product_id", "session_id",
        "CAST(transaction_date + INTERVAL 40 DAYS AS TIMESTAMP_NTZ) AS transaction_date", "quantity", "total_amount", "discount_amount",
    )
    fact = fact.select(*later.columns)
    correction = later.where("transaction_id < 1010").selectExpr("* EXCEPT (transaction_id)", "transaction_id + 5000 AS transaction_id")

    def append(df):
        df.withColumn("txn_month", F.date_format("transaction_date", "yyyy-MM")).write.mode("append").partitionBy("txn_month").parquet(path)
        return jobs.refresh_views_by_delta(users, path, root, "2024-03-20")

    def check(whole):
        for name, wanted in (("daily_metrics", kpi.daily_metrics(whole)), ("user_metrics", customers.user_metrics(users.drop("customer_segment"), whole, "2024-03-20"))):
            got = VersionedTable(spark, f"{root}/{name}").read().select(*wanted.columns).collect()
            assert sorted(got, key=str) == sorted(wanted.collect(), key=str), name

    assert append(fact).rows["months_read"] == 1
    check(fact)
    assert jobs.refresh_views_by_delta(users, path, root, "2024-03-20").decision == "unchanged"
    whole = fact.unionByName(later)
    assert append(later).rows["months_read"] == 2  # February and March; January is not read
    check(whole)
    assert append(correction).rows["months_read"] == 1
    check(whole.unionByName(correction))
    parts = MonthlyParts(spark, f"{root}/states", jobs.STATES)
    assert parts.months() == ["2024-01", "2024-02", "2024-03"]
    assert parts.expire() == 0 and len(parts.manifest.versions()) == 3


def test_changed_months_are_all_that_the_scan_reads(spark, tmp_path):
    path = str(tmp_path / "fact")
    spark.range(9).selectExpr("id", "concat('2024-0', id % 3 + 1) AS txn_month").write.partitionBy("txn_month").parquet(path)
    plan = spark.read.parquet(path).where(F.col("txn_month").cast("string").isin(["2024-02"]))
    assert {f.split("txn_month=")[1][:7] for f in plan.inputFiles()} >= {"2024-02"}
    assert "PartitionFilters: [" in plan._jdf.queryExecution().toString() and plan.count() == 3
    lists = month_lists(spark, path)
    assert sorted(lists) == ["2024-01", "2024-02", "2024-03"] and len(set(lists.values())) == 3


def test_distinct_users_by_bitmaps(spark, sales):
    rows = [(i, u, 1, f"2024-01-{d:02d} 10:00:00", 1, 5) for i, (u, d) in enumerate([(1, 1), (1, 2), (40_000, 2), (-3, 2), (2**40, 9), (1, 31)])]
    rows.append((99, None, 1, "2024-01-02 10:00:00", 1, 5))
    got = {(r.grain, str(r.period)): r.users for r in states.active_users(states.day_users(sales(rows)), window=8).collect()}
    assert got["day", "2024-01-02"] == 3 and got["week", "2024-01-01"] == 3
    assert got["8 days", "2024-01-02"] == 3 and got["8 days", "2024-01-09"] == 4 and got["8 days", "2024-01-31"] == 1
    assert states.active_users(states.day_users(sales(rows).limit(0))).count() == 0


def test_merge_rewrites_touched_files_only(spark, tmp_path):
    rows = spark.range(1000).selectExpr("id AS k", "id * 2 AS v", "CAST(NULL AS STRING) AS note")
    table = FileTable(spark, str(tmp_path / "t"), ["k"], rows.schema, rows_per_file=100)
    table.replace(rows)
    files = dict(table.files())
    assert len(files) == 10 and sum(files.values()) == 1000
    old = table.read()

    batch = spark.createDataFrame([(5, 1, "a"), (6, 2, "b"), (6, 3, "c"), (2000, 4, "d")], "k bigint, v bigint, note string")
    report = table.upsert(batch, order_by="v")
    assert (report.files, report.rewritten) == (10, 1) and len(set(files) - {f for f, _ in table.files()}) == 1
    wanted = tables.upsert_by_key(rows, batch, ["k"], "v")
    assert set(map(tuple, table.read().collect())) == set(map(tuple, wanted.collect()))
    assert table.read().count() == 1001 and old.count() == 1000  # readers of the old state are not disturbed

    changes = spark.createDataFrame([(100, None, "x"), (101, 202, None), (102, 7, None), (5000, 1, "no such key")], "k bigint, v bigint, note string")
    assert table.update(changes, ["v", "note"]).rewritten == 1
    got = {r.k: (r.v, r.note) for r in table.read().where("k BETWEEN 100 AND 102 OR k = 5000").collect()}
    assert got == {100: (200, "x"), 101: (202, None), 102: (7, None)}
    assert table.update(changes, ["v", "note"]).rewritten == 0  # nothing differs any more
    assert table.upsert(batch.limit(0)).rewritten == 0
    assert table.upsert(spark.createDataFrame([(9000, 1, "new")], "k bigint, v bigint, note string")).rewritten == 0 and table.read().count() == 1002


def test_merge_into_an_empty_table(spark, tmp_path):
    batch = spark.createDataFrame([(1, "a"), (None, "b"), (1, "c")], "k bigint, v string")
    table = FileTable(spark, str(tmp_path / "t"), ["k"], batch.schema)
    assert table.read().count() == 0
    table.upsert(batch.where("k IS NOT NULL"))
    assert [tuple(r) for r in table.read().collect()] == [(1, "c")]


def test_write_back_equals_the_full_rewrite(spark, shop, tmp_path):
    users, fact = shop
    staged = staging.stg_transactions(fact)
    segments, features = customers.mart_rfm_segments(customers.int_rfm_scores(staged)), churn.mart_churn_features(staged)
    table = FileTable(spark, str(tmp_path / "users"), ["user_id"], users.schema, rows_per_file=5)
    table.replace(users)
    assert jobs.write_back(table, segments, features).rewritten == 6
    wanted = tables.apply_churn_to_users(tables.apply_rfm_to_users(users, segments), features)
    assert set(map(tuple, table.read().collect())) == set(map(tuple, wanted.select(*users.columns).collect()))
    assert jobs.write_back(table, segments, features).rewritten == 0
    one = segments.where("user_id = 3").withColumn("customer_segment", F.lit("Lost"))
    assert jobs.write_back(table, one, features.limit(0)).rewritten == 1


def test_counts_are_told_by_the_write(spark, tmp_path):
    rows = spark.range(100).selectExpr("id", "IF(id % 10 = 0, NULL, id) AS a", "IF(id < 3, 'odd', 'Lost') AS s")
    measures = {**quality.null_measures(["id", "a"]), **quality.value_measures("s", ["Lost"])}
    told = write_observed(rows, str(tmp_path / "t"), measures, partition_by=["s"])
    assert told == {"rows": 100, "not_null_id": 0, "not_null_a": 10, "accepted_values_s": 3}
    assert write_observed(rows.limit(0), str(tmp_path / "e"), measures) == dict.fromkeys(told, 0)


def test_a_bad_mart_is_not_shown(spark, shop, tmp_path, monkeypatch):
    users, fact = shop
    monkeypatch.setattr(jobs.customers, "SEGMENT_ACTIONS", {"Lost": "none"})
    monkeypatch.setattr(jobs.customers, "FALLBACK_SEGMENT", "Other")
    log = spark.createDataFrame([], DAILY_REPORT_LOG)
    with pytest.raises(jobs.QualityError, match="accepted_values_customer_segment"):
        jobs.run_nightly(users, fact, log, str(tmp_path))
    assert VersionedTable(spark, str(tmp_path / "mart_rfm_segments")).versions() == []


def _plan(df):
    """The plan, with the buckets of each scan spelled out."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    try:
        return df.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")


def test_bucketed_tables_spare_scans_and_shuffles(spark, tmp_path):
    fact = spark.range(2000).selectExpr(
        "id AS transaction_id", "IF(id % 3 = 0, 7, id % 50) AS user_id", "CAST(id AS DECIMAL(12,2)) AS total_amount",
        "CAST(timestamp_seconds(1704067200 + id * 7200) AS TIMESTAMP_NTZ) AS transaction_date",
    ).withColumn("txn_month", F.date_format("transaction_date", "yyyy-MM"))
    table = buckets.write_bucketed(fact, str(tmp_path / "fact"), 8)
    users = buckets.write_bucketed(fact.select("user_id").distinct(), str(tmp_path / "users"), 8, order=None, month=False)

    one = staging.user_history(table, 7, "2024-01-01")
    assert "SelectedBucketsCount: 1 out of 8" in _plan(one) and one.count() == fact.where("user_id = 7").count()
    counts = table.groupBy("user_id").count()
    assert "Exchange" not in _plan(counts)
    both = users.hint("merge").join(counts, "user_id")
    assert "SortMergeJoin" in _plan(both) and "Exchange" not in _plan(both)
    assert {tuple(r) for r in both.collect()} == {tuple(r) for r in fact.groupBy("user_id").count().collect()}

    months = spark.createDataFrame([(f"2024-{m:02d}", 2024, (m + 2) // 3) for m in range(1, 13)], "txn_month string, year int, quarter int")
    pruned = kpi.quarter_revenue(table, months, 2024, 2)
    assert "dynamicpruning" in _plan(pruned)
    wanted = fact.where("quarter(transaction_date) = 2").groupBy("txn_month").agg(F.count("*"), F.sum("total_amount"))
    assert {tuple(r) for r in pruned.collect()} == {tuple(r) for r in wanted.collect()}

    again = buckets.bucketed_table(
        spark, str(tmp_path / "fact"), "transaction_id BIGINT, user_id BIGINT, total_amount DECIMAL(12,2), transaction_date TIMESTAMP_NTZ, txn_month STRING", 8
    )
    assert again.count() == 2000 and "SelectedBucketsCount: 1 out of 8" in _plan(again.where("user_id = 7"))
