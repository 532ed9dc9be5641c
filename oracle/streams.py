"""Statements for the jobs and the streams."""

from oracle.base import big, day, dbl, query, rnd, sec
from oracle.churn import CHURN_FEATURES, NULLABLE
from oracle.customers import SQL as CUSTOMER_SQL
from oracle.kpi import SQL as KPI_SQL

TS = "timestamp"

SQL = {
    "refresh_views": query(
        "daily metrics",
        """SELECT 'daily_metrics' AS view, COUNT(*) AS rows FROM daily
           UNION ALL SELECT 'user_metrics', COUNT(*) FROM metrics""",
    ),
    "refresh_delta_daily": KPI_SQL["daily_metrics"],
    "refresh_delta_users": CUSTOMER_SQL["user_metrics"],
    "refresh_delta_report": query(
        "lines daily metrics",
        """SELECT r.refresh, x.name, x.rows FROM (SELECT UNNEST([0, 1])::BIGINT AS refresh) r,
           LATERAL (
             SELECT 'daily_metrics' AS name, COUNT(DISTINCT CAST(transaction_date AS DATE)) AS rows FROM tagged WHERE late <= r.refresh
             UNION ALL SELECT 'user_metrics', COUNT(*) FROM metrics
             UNION ALL SELECT 'months_read', COUNT(DISTINCT strftime(transaction_date, '%Y-%m')) FROM tagged WHERE late = r.refresh
           ) x""",
        (
            "tagged",
            """SELECT *, CASE WHEN transaction_id % 2 = 0 AND transaction_date >= (SELECT CAST(MAX(transaction_date) AS DATE)
                      FROM orders_fact) - 90 THEN 1 ELSE 0 END AS late FROM lines""",
        ),
    ),
    "active_users": query(
        "orders_fact",
        f"""SELECT 'day' AS grain, {day('d')} AS period, COUNT(DISTINCT user_id) AS users FROM o GROUP BY d
            UNION ALL SELECT 'week', {day("date_trunc('week', d)")}, COUNT(DISTINCT user_id) FROM o GROUP BY date_trunc('week', d)
            UNION ALL SELECT '30 days', {day('p.d')}, COUNT(DISTINCT o.user_id)
            FROM (SELECT DISTINCT d FROM o) p JOIN o ON o.d BETWEEN p.d - 29 AND p.d GROUP BY p.d""",
        ("o", "SELECT user_id, CAST(transaction_date AS DATE) AS d FROM orders_fact"),
    ),
    "export_then_read": query(
        "lines",
        f"""SELECT strftime(transaction_date, '%Y-%m') AS txn_month, COUNT(*) AS rows,
                   {dbl('SUM(total_amount)')} AS revenue FROM lines GROUP BY 1""",
    ),
    # every order has lines, so cohorts by line and by order are the same
    "cohort_job": CUSTOMER_SQL["cohort_retention"].replace("FROM orders_fact)", "FROM lines)").replace(
        "WITH orders_fact AS (",
        "WITH lines AS (SELECT o_custkey AS user_id, o_orderdate AS transaction_date "
        "FROM lineitem JOIN orders ON l_orderkey = o_orderkey),\norders_fact AS (",
    ).replace("FROM orders_fact\n)", "FROM lines\n)"),
    "stream_event_counts": query(
        "all_events",
        f"""SELECT {sec('w')} AS window_start, {sec('w + INTERVAL 5 SECOND')} AS window_end, event_type,
                   COUNT(*) AS event_count, COUNT(DISTINCT user_id) AS unique_users,
                   COUNT(DISTINCT session_id) AS unique_sessions
            FROM (SELECT *, time_bucket(INTERVAL 5 SECOND, {TS}) AS w FROM all_events) GROUP BY w, event_type""",
    ),
    "stream_ingest_transactions": query(
        "purchases",
        f"""SELECT CAST(transaction_id AS VARCHAR) AS transaction_id, user_id, product_id, session_id,
                   {sec('transaction_date')} AS transaction_date, quantity,
                   {dbl("CAST(CAST(CAST(total_amount AS DOUBLE) / quantity AS DECIMAL(28,8)) AS DECIMAL(12,2))")} AS unit_price,
                   {dbl('total_amount')} AS total_amount, 'unknown' AS payment_method, 'completed' AS order_status,
                   strftime(transaction_date, '%Y-%m') AS txn_month FROM purchases""",
    ),
    "stream_user_totals": query(
        "purchases",
        f"""SELECT user_id, {dbl('SUM(total_amount)')} AS lifetime_value,
                   {sec('MAX(transaction_date)')} AS last_purchase_date, COUNT(*) AS total_purchases
            FROM purchases GROUP BY user_id""",
    ),
    "stream_session_rollup": query(
        "all_events",
        f"""SELECT session_id, MAX(user_id) AS user_id, {sec(f'MIN({TS})')} AS session_start,
                   {sec(f'MAX({TS})')} AS session_end, COUNT(*) FILTER (event_type = 'view') AS pages_viewed,
                   {big(f'FLOOR(epoch(MAX({TS}) - MIN({TS})))')} AS duration_seconds
            FROM all_events GROUP BY session_id""",
    ),
    # a session is closed when the watermark, an hour behind the newest event, has passed its last event by 30 minutes
    "stream_sessions_closed": query(
        "all_events",
        f"""SELECT user_id, {sec(f'MIN({TS})')} AS session_start, {sec(f'MAX({TS})')} AS session_end, COUNT(*) AS events,
                   COUNT(*) FILTER (event_type = 'view') AS pages_viewed,
                   {big(f'FLOOR(epoch(MAX({TS}) - MIN({TS})))')} AS duration_seconds
            FROM (SELECT *, SUM(fresh) OVER (PARTITION BY user_id ORDER BY {TS} ROWS UNBOUNDED PRECEDING) AS run
                  FROM (SELECT *, CASE WHEN {TS} - LAG({TS}) OVER (PARTITION BY user_id ORDER BY {TS}) <= INTERVAL 30 MINUTE
                                  THEN 0 ELSE 1 END AS fresh FROM all_events WHERE user_id IS NOT NULL))
            GROUP BY user_id, run
            HAVING MAX({TS}) + INTERVAL 30 MINUTE <= (SELECT MAX({TS}) FROM all_events) - INTERVAL 1 HOUR""",
    ),
    "stream_ingest_account": query(
        "all_events",
        """SELECT UNNEST(['input', 'quarantined', 'other', 'late', 'repeated', 'kept', 'quarantine_rows']) AS outcome,
                  UNNEST([COALESCE(SUM(copies), 0), COALESCE(SUM(copies) FILTER (bad), 0), COALESCE(SUM(copies) FILTER (NOT bad AND NOT sold), 0),
                          COALESCE(SUM(copies) FILTER (NOT bad AND sold AND late), 0),
                          COALESCE(SUM(copies - 1) FILTER (NOT bad AND sold AND NOT late), 0), COUNT(*) FILTER (NOT bad AND sold AND NOT late),
                          COALESCE(SUM(copies) FILTER (bad), 0)])::BIGINT AS rows
           FROM (SELECT CASE WHEN event_id % 83 = 0 THEN 2 ELSE 1 END AS copies, event_type = 'purchase' AS sold,
                        event_id % 97 = 0 OR (event_type = 'purchase' AND (event_id % 89 = 0 OR amount IS NULL OR user_id IS NULL
                                                                           OR product_id IS NULL)) AS bad,
                        event_id % 79 = 0 AND epoch_us(timestamp) >= low + (high - low) * 3 // 4 AS late
                 FROM all_events, (SELECT epoch_us(MIN(timestamp)) AS low, epoch_us(MAX(timestamp)) AS high FROM all_events))""",
    ),
    "event_funnel": query(
        "all_events",
        """SELECT step, stage, reached, CAST(ROUND(CAST(100.0 * reached / NULLIF(previous, 0) AS DECIMAL(30,7)), 2) AS DOUBLE)
                  AS conversion_pct
           FROM (SELECT UNNEST([1, 2, 3])::BIGINT AS step, UNNEST(['view', 'click', 'purchase']) AS stage,
                        UNNEST([a, b, c]) AS reached, UNNEST([a, a, b]) AS previous
                 FROM (SELECT COUNT(*) AS a, COUNT(k) AS b, COUNT(p) AS c FROM purchased))""",
        ("viewed", "SELECT session_id, MIN(timestamp) AS v FROM all_events WHERE event_type = 'view' GROUP BY 1"),
        (
            "clicked",
            """SELECT v.session_id, MIN(e.timestamp) AS k FROM viewed v LEFT JOIN all_events e
                 ON e.session_id = v.session_id AND e.event_type = 'click' AND e.timestamp >= v.v GROUP BY 1""",
        ),
        (
            "purchased",
            """SELECT c.session_id, MIN(c.k) AS k, MIN(e.timestamp) AS p FROM clicked c LEFT JOIN all_events e
                 ON e.session_id = c.session_id AND e.event_type = 'purchase' AND e.timestamp >= c.k GROUP BY 1""",
        ),
    ),
    "nightly_run": query(
        "buyers snapshot users",
        """SELECT table_name, rows, 'pass' AS decision FROM (
             SELECT 'mart_rfm_segments' AS table_name, COUNT(*) AS rows FROM buyers
             UNION ALL SELECT 'mart_churn_features', COUNT(*) FROM buyers
             UNION ALL SELECT 'mart_daily_snapshot', COUNT(*) FROM snapshot
             UNION ALL SELECT 'users', COUNT(*) FROM users
             UNION ALL SELECT 'daily_report_log', COUNT(*) FROM snapshot
                       WHERE report_date = (SELECT MAX(report_date) FROM snapshot) - 1)
           WHERE EXISTS (SELECT 1 FROM snapshot WHERE report_date = (SELECT MAX(report_date) FROM snapshot) - 1)""",
    ),
    "export_marts": query(
        "lines buyers snapshot",
        """SELECT 'transactions' AS table_name, COUNT(*) AS rows FROM lines
           UNION ALL SELECT 'mart_rfm_segments', COUNT(*) FROM buyers
           UNION ALL SELECT 'mart_churn_features', COUNT(*) FROM buyers
           UNION ALL SELECT 'mart_daily_snapshot', COUNT(*) FROM snapshot""",
    ),
    "mart_checks_observed": query(
        "buyers",
        f"""SELECT 'mart_rfm_segments' AS table_name, 'rows' AS measure, COUNT(*) AS rows FROM buyers
            UNION ALL SELECT 'mart_rfm_segments', 'accepted_values_customer_segment', 0
            UNION ALL SELECT 'mart_churn_features', 'rows', COUNT(*) FROM buyers
            {" ".join(f"UNION ALL SELECT 'mart_churn_features', 'not_null_{c}', COUNT(*) FROM f WHERE {c} IS NULL" for c in NULLABLE)}""",
        ("f", CHURN_FEATURES),
    ),
    "ab_metrics_upsert": query(
        "assigned orders_fact",
        f"""SELECT strftime(day, '%Y-%m-%d') AS metric_date, 'churn-discount-v1' AS experiment_key, variant, assigned_users,
                   converted_users, {rnd('converted_users / CAST(assigned_users AS DOUBLE)', 4)} AS conversion_rate
            FROM (SELECT d.day, a.variant, COUNT(DISTINCT a.user_id) AS assigned_users, COUNT(DISTINCT t.user_id) AS converted_users
                  FROM d CROSS JOIN assigned a LEFT JOIN orders_fact t
                    ON a.user_id = t.user_id AND t.transaction_date >= a.assigned_at
                   AND t.transaction_date <= a.assigned_at + INTERVAL 7 DAY AND t.transaction_date <= d.day
                  GROUP BY d.day, a.variant)""",
        ("d", "SELECT CAST(MAX(transaction_date) AS DATE) - UNNEST([0, 1]) AS day FROM orders_fact"),
    ),
}
