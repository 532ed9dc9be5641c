"""The scheduled jobs: hourly refresh, nightly marts, export, experiment read-out.

Each is one driver program over the operators; a step that fails a gate raises,
so nothing after it is written.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillview.operators import churn, cohorts, customers, experiments, kpi, quality, staging, states, tables
from tillview.operators.churn import risk_score
from tillview.plans.filetable import FileTable, MergeReport
from tillview.sources.months import MONTH, MonthlyParts, month_lists
from tillview.sources.readers import write_counted
from tillview.sources.scratch import materialize
from tillview.sources.versions import VersionedTable


@dataclass
class JobReport:
    """What a job did: its gate decision, rows written per table and warnings."""

    decision: str = "pass"
    rows: dict[str, int] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)


def refresh_views(users: DataFrame, transactions: DataFrame, root: str, as_of=None) -> JobReport:
    """Rebuild daily_metrics and user_metrics; an empty result is an error and is never shown."""
    spark = transactions.sparkSession
    views = {
        "daily_metrics": kpi.daily_metrics(transactions),
        "user_metrics": customers.user_metrics(users, transactions, as_of),
    }
    staged = {name: VersionedTable(spark, f"{root}/{name}").stage(df) for name, df in views.items()}
    # both are complete before either is shown
    for name, (folder, _) in staged.items():
        VersionedTable(spark, f"{root}/{name}").publish(folder)
    return JobReport(rows={name: rows for name, (_, rows) in staged.items()})


def mart_measures(name: str) -> dict[str, Column]:
    """What is counted of a mart while it is written; each count must be 0."""
    segments = [*customers.SEGMENT_ACTIONS, customers.FALLBACK_SEGMENT]
    return {
        "mart_rfm_segments": quality.value_measures("customer_segment", segments),
        "mart_churn_features": quality.null_measures(["user_id", *churn.FEATURES]),
    }.get(name, {})


STATES = ["day_totals", "day_users", "user_months"]


def refresh_views_by_delta(users: DataFrame, fact_path: str, root: str, as_of=None) -> JobReport:
    """The views of :func:`refresh_views` after a change of some months of a month-partitioned fact.

    Only months whose files changed are read; their states replace the old ones, and the views
    are put together from the states of all months. ``rows`` also tells how many months were
    read. Without a change the views stay as they are.
    """
    spark = users.sparkSession
    parts, current = MonthlyParts(spark, f"{root}/states", STATES), month_lists(spark, fact_path)
    changed, gone = parts.changed(current), set(parts.months()) - set(current)
    if not changed and not gone:
        return JobReport(decision="unchanged", rows={"months_read": 0})
    fact = spark.read.parquet(fact_path)
    # the type of a partition's name is guessed; months are text
    changes = fact.withColumn(MONTH, F.col(MONTH).cast("string")).where(F.col(MONTH).isin(changed)).drop(MONTH)
    made = {"day_totals": states.day_totals(changes), "day_users": states.day_users(changes), "user_months": states.user_months(changes)}
    parts.update(current, made)
    totals, bitmaps, months = (parts.read(name, made[name].schema) for name in STATES)
    views = {"daily_metrics": states.daily_view(totals, bitmaps, months), "user_metrics": states.user_view(users, months, as_of)}
    staged = {name: VersionedTable(spark, f"{root}/{name}").stage(df) for name, df in views.items()}
    for name, (folder, _) in staged.items():
        VersionedTable(spark, f"{root}/{name}").publish(folder)
    return JobReport(rows={**{name: rows for name, (_, rows) in staged.items()}, "months_read": len(changed)})


def run_nightly(users: DataFrame, transactions: DataFrame, report_log: DataFrame, root: str, as_of=None) -> JobReport:
    """Gate, marts with their column tests, write-backs and the daily log.

    Bad rows of the day only raise a warning; a failed test of a mart stops the run.
    """
    spark = transactions.sparkSession
    gate = quality.dq_daily_gate(transactions, users, as_of).first()
    report = JobReport(decision=gate["decision"])
    if report.decision == "skip":
        return report
    if report.decision == "fail_alert":
        report.warnings.append(
            f"null_user_ids={gate['null_user_ids']} negative_amounts={gate['negative_amounts']} "
            f"orphan_transactions={gate['orphan_transactions']}"
        )

    staged = staging.stg_transactions(transactions)
    _require(
        quality.dq_not_null(staged, ["transaction_id", "user_id", "total_amount", "transaction_date"]),
        quality.dq_unique(staged, "transaction_id"),
    )
    marts = {
        "mart_rfm_segments": customers.mart_rfm_segments(customers.int_rfm_scores(staged, as_of)),
        "mart_churn_features": churn.mart_churn_features(staged, as_of),
        "mart_daily_snapshot": kpi.mart_daily_snapshot(staged),
    }
    built, folders = {}, {}
    for name, df in marts.items():
        # checks of single rows are taken by the job that writes the rows
        folders[name], told = VersionedTable(spark, f"{root}/{name}").stage_observed(df, mart_measures(name), min_rows=0)
        report.rows[name] = told.pop("rows")
        _require_none(told)
        built[name] = spark.read.schema(df.schema).parquet(folders[name])
    _require(
        quality.dq_unique(built["mart_rfm_segments"], "user_id"),
        quality.dq_unique(built["mart_daily_snapshot"], "report_date"),
    )
    # shown only after the tests
    for name, folder in folders.items():
        VersionedTable(spark, f"{root}/{name}").publish(folder)

    # both write-backs in one pass over the users
    updated = tables.apply_churn_to_users(
        tables.apply_rfm_to_users(users, built["mart_rfm_segments"]), built["mart_churn_features"]
    )
    report.rows["users"] = VersionedTable(spark, f"{root}/users").replace(updated)
    log = tables.apply_snapshot_to_log(report_log, built["mart_daily_snapshot"], as_of)
    report.rows["daily_report_log"] = VersionedTable(spark, f"{root}/daily_report_log").replace(log, min_rows=0)
    return report


def write_back(users: FileTable, segments: DataFrame, features: DataFrame) -> MergeReport:
    """Segments and risk scores into the users' table; only files with a changed user are written."""
    risk = features.select("user_id", risk_score().alias("churn_risk_score"))
    batch = segments.select("user_id", "customer_segment").join(risk, "user_id", "full")
    return users.update(batch, ["customer_segment", "churn_risk_score"])


def run_export(transactions: DataFrame, marts: dict[str, DataFrame], root: str) -> dict[str, int]:
    """Transactions by month and the marts as Parquet; returns the rows of each."""
    exported = staging.export_transactions(transactions)
    rows = {"transactions": write_counted(exported, f"{root}/transactions", partition_by=["txn_month"])}
    for name, df in marts.items():
        rows[name] = write_counted(df, f"{root}/marts/{name}")
    return rows


def run_cohort_job(export_path: str, table: VersionedTable) -> int:
    """Cohort retention from the exported files into its table, from executor to store."""
    transactions = table.spark.read.parquet(export_path)
    return table.replace(cohorts.cohort_retention(transactions), min_rows=0)


def run_experiment_metrics(
    assignments: DataFrame, transactions: DataFrame, metrics: DataFrame, table: VersionedTable, as_of=None
) -> JobReport:
    """The day's conversion upserted into the metrics; skipped without assignments."""
    if assignments.filter(F.col("experiment_key") == experiments.EXPERIMENT_KEY).isEmpty():
        return JobReport(decision="skip")
    fresh = materialize(experiments.ab_conversion(assignments, transactions, as_of), "conversion")
    merged = tables.upsert_by_key(metrics, fresh, ["metric_date", "experiment_key", "variant"])
    return JobReport(rows={"ab_experiment_metrics": table.replace(merged)})


class QualityError(RuntimeError):
    """A mart or staging test failed."""


def _require_none(counts: dict[str, int]) -> None:
    failed = [f"{name}={n}" for name, n in counts.items() if n]
    if failed:
        raise QualityError(", ".join(failed))


def _require(*checks: DataFrame) -> None:
    failed = [f"{r['check_name']}={r['value']:.0f}" for check in checks for r in check.filter("status = 'fail'").collect()]
    if failed:
        raise QualityError(", ".join(failed))
