"""Statements for churn, table maintenance and data quality."""

from oracle.base import MART_SEGMENT, avg, big, dbl, day, query, rnd, sec
from oracle.customers import histogram
from oracle.kpi import now, today

PREP = f"""
    SELECT user_id, {dbl('recency_days')} AS recency_days, {dbl('frequency')} AS frequency,
           {dbl('monetary')} AS monetary, avg_order_value,
           {dbl("""CASE WHEN last_purchase_date IS NOT NULL
                    THEN GREATEST(CAST(last_purchase_date AS DATE) - CAST(first_purchase_date AS DATE), 1)
                    ELSE GREATEST(frequency * 30, recency_days, 1) END""")} AS tenure_days
    FROM metrics"""

AT_RISK = """
    SELECT m.user_id, m.email, r.score, m.recency_days, m.frequency, m.monetary
    FROM risk r JOIN metrics m ON m.user_id = r.user_id WHERE r.score > 0.7
    ORDER BY r.score DESC, m.user_id"""

# fixed values: the explanation texts
FACTORS = """list_filter([
    CASE WHEN recency_days > 90 THEN 'High recency — ' || recency_days || ' days since last purchase' END,
    CASE WHEN frequency < 3 THEN 'Low frequency — only ' || frequency || ' orders' END,
    CASE WHEN monetary < 100 THEN 'Low total spend — $' || CAST(ROUND(monetary, 0) AS BIGINT) END],
    lambda x: x IS NOT NULL)[1:2]"""

LINE_SNAPSHOT = f"""
    SELECT CAST(transaction_date AS DATE) AS report_date, COUNT(DISTINCT user_id) AS total_users,
           COUNT(DISTINCT transaction_id) AS total_transactions, SUM(total_amount) AS total_revenue,
           {avg('total_amount')} AS aov
    FROM lines WHERE transaction_date >= {today('orders_fact')} - 60 GROUP BY 1"""

SNAPSHOT_ROW = (
    f"SELECT {day('report_date')} AS report_date, total_users, total_transactions, "
    f"{dbl('total_revenue')} AS total_revenue, {rnd('aov', 2)} AS avg_order_value"
)


def check(name: str, table: str, tables: str, condition: str) -> str:
    return query(
        tables,
        f"""SELECT '{name}' AS check_name, CASE WHEN n > 0 THEN 'fail' ELSE 'pass' END AS status,
                   {dbl('n')} AS value FROM (SELECT COUNT(*) AS n FROM {table} WHERE {condition})""",
    )


def anomaly(name: str, measure: str) -> str:
    return f"""
    SELECT '{name}' AS check_name, CASE WHEN r > 3.0 OR r < 0.1 THEN 'fail' ELSE 'pass' END AS status, r AS value
    FROM (SELECT {dbl('COALESCE((SELECT m FROM d WHERE day = t - 1), 0)')}
                 / NULLIF((SELECT CAST(SUM(m) AS DOUBLE) / COUNT(*) FROM d WHERE day >= t - 8 AND day < t - 1), 0) AS r
          FROM (SELECT {today('orders_fact')} AS t),
          (SELECT 1) one) x""".replace(
        "FROM d ", f"FROM (SELECT CAST(transaction_date AS DATE) AS day, {measure} AS m FROM orders_fact GROUP BY 1) "
    )


REVENUE = anomaly("revenue_anomaly", "SUM(total_amount)")
VOLUME = anomaly("transaction_volume", "COUNT(*)")

STALE = """
    SELECT 'stale_' || table_name AS check_name, CASE WHEN hours > 2 THEN 'fail' ELSE 'pass' END AS status,
           hours AS value
    FROM (SELECT table_name, date_diff('second', date_trunc('second', MAX(timestamp)), (
                   SELECT date_trunc('day', MAX(timestamp)) + INTERVAL 25 HOUR FROM all_events WHERE event_type = 'purchase'))
                 / 3600.0 AS hours
          FROM (SELECT CASE event_type WHEN 'purchase' THEN 'daily_metrics' ELSE 'user_metrics' END AS table_name,
                       timestamp FROM all_events WHERE event_type IN ('purchase', 'signup'))
          GROUP BY table_name)"""

ORPHANS = "user_id IS NULL OR user_id NOT IN (SELECT c_custkey FROM customer)"
DUPLICATES = "(SELECT transaction_id FROM lines GROUP BY 1 HAVING COUNT(*) > 1)"

NULLABLE = [
    "user_id", "recency_days", "frequency", "monetary", "avg_order_value", "tenure_days", "purchase_velocity",
    "recency_ratio",
]

CHURN_FEATURES = f"""
    SELECT user_id, recency_days, frequency, {dbl('monetary')} AS monetary,
           {rnd('avg_order_value', 2)} AS avg_order_value, tenure_days,
           CASE WHEN tenure_days > 0 THEN {rnd('frequency / CAST(tenure_days AS DOUBLE)', 6)} ELSE 0 END
               AS purchase_velocity,
           CASE WHEN tenure_days > 0 THEN {rnd('recency_days / CAST(tenure_days AS DOUBLE)', 4)} ELSE 1 END
               AS recency_ratio,
           {day('last_purchase_date')} AS last_purchase_date, {day('first_purchase_date')} AS first_purchase_date
    FROM buyers"""

TRAINING = f"""
    SELECT pre.*, frequency / CAST(tenure_days AS DOUBLE) AS purchase_velocity,
           recency_days / CAST(tenure_days AS DOUBLE) AS recency_ratio,
           {big('CASE WHEN post.user_id IS NULL THEN 1 ELSE 0 END')} AS churned
    FROM (SELECT user_id, snap - CAST(MAX(transaction_date) AS DATE) AS recency_days,
                 COUNT(DISTINCT transaction_id) AS frequency, {dbl('SUM(total_amount)')} AS monetary,
                 {avg('total_amount')} AS avg_order_value,
                 GREATEST(snap - CAST(MIN(transaction_date) AS DATE), 1) AS tenure_days
          FROM orders_fact, snapshot_day WHERE CAST(transaction_date AS DATE) <= snap GROUP BY user_id, snap) pre
    LEFT JOIN (SELECT DISTINCT user_id FROM orders_fact, snapshot_day
               WHERE CAST(transaction_date AS DATE) > snap AND CAST(transaction_date AS DATE) <= snap + 30) post
      ON post.user_id = pre.user_id"""

SCORING = f"""
    SELECT user_id, CAST(o.newest AS DATE) - CAST(MAX(transaction_date) AS DATE) AS recency_days,
           COUNT(DISTINCT transaction_id) AS frequency, {dbl('SUM(total_amount)')} AS monetary,
           GREATEST(CAST(o.newest AS DATE) - CAST(MIN(transaction_date) AS DATE), 1) AS tenure_days
    FROM orders_fact, (SELECT MAX(transaction_date) AS newest FROM orders_fact) o GROUP BY user_id, o.newest"""

# a leaf's value, and for each feature: lowest (not included), highest, share of rows that take the path's turns
LEAVES = """
    SELECT * FROM (VALUES
      (-0.2, -1, 120, 0.6, -1, 10, 350 / 600.0::DOUBLE, -1, 1e18, 1.0, -1, 1e18, 1.0),
      (-0.8, -1, 120, 0.6, 10, 1e18, 250 / 600.0::DOUBLE, -1, 1e18, 1.0, -1, 1e18, 1.0),
      (0.3, 120, 400, 0.4 * (120 / 150.0::DOUBLE), -1, 1e18, 1.0, -1, 1500000, 150 / 400.0::DOUBLE, -1, 1e18, 1.0),
      (0.7, 400, 1e18, 0.4 * (30 / 150.0::DOUBLE), -1, 1e18, 1.0, -1, 1500000, 150 / 400.0::DOUBLE, -1, 1e18, 1.0),
      (0.9, 120, 1e18, 0.4, -1, 1e18, 1.0, 1500000, 1e18, 250 / 400.0::DOUBLE, -1, 1e18, 1.0),
      (0.04, -1, 1e18, 1.0, -1, 15, 0.7, -1, 1e18, 1.0, -1, 1500, 300 / 700.0::DOUBLE),
      (-0.05, -1, 60, 250 / 400.0::DOUBLE, -1, 15, 0.7, -1, 1e18, 1.0, 1500, 1e18, 400 / 700.0::DOUBLE),
      (0.02, 60, 1e18, 150 / 400.0::DOUBLE, -1, 15, 0.7, -1, 1e18, 1.0, 1500, 1e18, 400 / 700.0::DOUBLE),
      (-0.06, -1, 1e18, 1.0, 15, 1e18, 0.3, -1, 1e18, 1.0, -1, 1e18, 1.0)
    ) AS t(value, rl, rh, rs, fl, fh, fs, ml, mh, ms, tl, th, ts)"""


def _held(bit: int, feature: str, short: str) -> str:
    """With the feature in the coalition its conditions count, without it their share."""
    return (
        f"CASE WHEN (s.mask >> {bit}) % 2 = 1 THEN CASE WHEN {feature} > {short}l AND {feature} <= {short}h THEN 1.0 ELSE 0.0 END "
        f"ELSE {short}s END"
    )


# the worth of each of the 16 coalitions of four features
WORTH = f"""
    SELECT user_id, s.mask, SUM({dbl('value')} * {_held(0, 'recency_days', 'r')} * {_held(1, 'frequency', 'f')}
           * {_held(2, 'monetary', 'm')} * {_held(3, 'tenure_days', 't')}) AS v
    FROM scoring, leaves, (SELECT UNNEST(range(16)) AS mask) s GROUP BY user_id, s.mask"""


def _shapley(bit: int) -> str:
    """Over all coalitions without the feature: size! (3 - size)! / 4! times what it adds."""
    return f"""(SELECT SUM((b.v - a.v) * CASE bit_count(a.mask) WHEN 0 THEN 1 / 4.0 WHEN 1 THEN 1 / 12.0::DOUBLE
                           WHEN 2 THEN 1 / 12.0::DOUBLE ELSE 1 / 4.0 END)
                FROM worth a JOIN worth b ON a.user_id = b.user_id AND b.mask = a.mask + {1 << bit}
                WHERE (a.mask >> {bit}) % 2 = 0 AND a.user_id = u.user_id)"""


SNAPSHOT_DAY = ("snapshot_day", "SELECT CAST(MAX(transaction_date) AS DATE) - 30 AS snap FROM orders_fact")

SQL = {
    "churn_tree_contributions": query(
        "orders_fact",
        "SELECT u.user_id, "
        + ", ".join(
            f"ROUND({_shapley(bit)}, 9) + 0.0 AS {name}"
            for bit, name in enumerate(["recency_days", "frequency", "monetary", "tenure_days"])
        )
        + ", ROUND(u.v, 9) + 0.0 AS margin FROM worth u WHERE u.mask = 15",
        ("scoring", SCORING),
        ("leaves", LEAVES),
        ("worth", WORTH),
    ),
    "churn_heuristic_report": query(
        "orders_fact",
        """SELECT class, hit / CAST(NULLIF(predicted, 0) AS DOUBLE) AS precision, hit / CAST(NULLIF(support, 0) AS DOUBLE) AS recall,
                  2.0::DOUBLE * hit / NULLIF(predicted + support, 0) AS f1, support,
                  (SELECT AVG(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0.0 END::DOUBLE)
                   FROM scored a JOIN scored b ON a.churned = 1 AND b.churned = 0) AS train_auc
           FROM (SELECT c.class, COUNT(*) FILTER (churned = c.k AND (p >= 0.5) = (c.k = 1)) AS hit,
                        COUNT(*) FILTER ((p >= 0.5) = (c.k = 1)) AS predicted, COUNT(*) FILTER (churned = c.k) AS support
                 FROM scored, (VALUES ('Retained', 0), ('Churned', 1)) AS c(class, k) GROUP BY c.class)""",
        SNAPSHOT_DAY,
        ("training", TRAINING),
        (
            "scored",
            f"""SELECT churned, {rnd('LEAST(1, recency_days / 365.0::DOUBLE) * 0.6 + (1 - LEAST(1, frequency / 20.0::DOUBLE)) * 0.4', 4)} AS p
                FROM training""",
        ),
    ),
    "mart_churn_features": query("buyers", CHURN_FEATURES),
    "churn_risk_score": query(
        "risk", f"SELECT user_id, recency_days, frequency, {dbl('score')} AS churn_risk_score FROM risk"
    ),
    "churn_heuristic": query(
        "metrics",
        f"""SELECT user_id, p AS churn_probability,
                   CASE WHEN p >= 0.7 THEN 'High' WHEN p >= 0.4 THEN 'Medium' ELSE 'Low' END AS churn_risk_label
            FROM (SELECT user_id, {rnd('LEAST(1, recency_days / 365.0::DOUBLE) * 0.6 + (1 - LEAST(1, frequency / 20.0::DOUBLE)) * 0.4', 4)}
                         AS p FROM metrics)""",
    ),
    "churn_rule_factors": query(
        "metrics",
        f"""SELECT user_id, CASE WHEN len(f) > 0 THEN array_to_string(f, ' | ')
                            ELSE 'Insufficient purchase history' END AS top_risk_factors
            FROM (SELECT user_id, {FACTORS} AS f FROM metrics)""",
    ),
    "churn_feature_prep": query(
        "metrics",
        """SELECT *, frequency / tenure_days AS purchase_velocity, recency_days / tenure_days AS recency_ratio
           FROM prep""",
        ("prep", PREP),
    ),
    "churn_training_set": query("orders_fact", TRAINING, SNAPSHOT_DAY),
    "at_risk_customers": query(
        "risk metrics",
        f"""SELECT user_id, email, {dbl('score')} AS churn_risk_score, {big('recency_days')} AS recency_days, frequency,
                   {dbl('monetary')} AS monetary FROM (SELECT * FROM at_risk LIMIT 20)""",
        ("at_risk", AT_RISK),
    ),
    "churn_histogram": query(
        "risk metrics", "SELECT * FROM h", ("at_risk", AT_RISK), ("h", histogram("at_risk", "score", 20))
    ),
    "upsert_by_key": query(
        "snapshot lines",
        f"""{SNAPSHOT_ROW} FROM fresh UNION ALL
            {SNAPSHOT_ROW} FROM snapshot WHERE report_date NOT IN (SELECT report_date FROM fresh)""",
        ("fresh", LINE_SNAPSHOT),
    ),
    "merge_write_back": query(
        "users buyers_scored risk",
        f"""SELECT u.user_id, u.email, CASE WHEN s.user_id IS NOT NULL THEN {MART_SEGMENT} END AS customer_segment,
                   {dbl('r.score')} AS churn_risk_score
            FROM users u LEFT JOIN buyers_scored s ON s.user_id = u.user_id LEFT JOIN risk r ON r.user_id = u.user_id""",
    ),
    "insert_if_absent": query(
        "snapshot lines",
        f"""{SNAPSHOT_ROW} FROM old UNION ALL
            {SNAPSHOT_ROW} FROM fresh WHERE report_date NOT IN (SELECT report_date FROM old)""",
        ("fresh", LINE_SNAPSHOT),
        ("old", f"SELECT * FROM snapshot WHERE report_date < {today('orders_fact')} - 14"),
    ),
    "apply_rfm_to_users": query(
        "users buyers_scored",
        f"""SELECT u.user_id, u.email,
                   CASE WHEN s.user_id IS NOT NULL THEN {MART_SEGMENT} END AS customer_segment
            FROM users u LEFT JOIN buyers_scored s ON s.user_id = u.user_id""",
    ),
    "apply_churn_to_users": query(
        "users risk",
        f"""SELECT u.user_id, u.email, {dbl('score')} AS churn_risk_score
            FROM users u LEFT JOIN risk r ON r.user_id = u.user_id""",
    ),
    "apply_snapshot_to_log": query(
        "snapshot",
        f"""SELECT {day('report_date')} AS report_date,
                   CASE WHEN report_date = (SELECT CAST(MAX(transaction_date) AS DATE) FROM orders_fact) - 1 THEN total_users ELSE 0 END
                       AS total_users,
                   total_transactions, {dbl('total_revenue')} AS total_revenue, {rnd('aov', 2)} AS avg_order_value
            FROM snapshot""",
    ),
    "user_totals": query(
        "orders_fact",
        f"""SELECT user_id, {dbl('SUM(total_amount)')} AS lifetime_value,
                   {day('MAX(transaction_date)')} AS last_purchase_date, COUNT(*) AS total_purchases
            FROM orders_fact GROUP BY user_id""",
    ),
    "dq_null_user_ids": check("null_user_ids", "orders_fact", "orders_fact", "user_id IS NULL"),
    "dq_null_amounts": check("null_amounts", "orders_fact", "orders_fact", "total_amount IS NULL OR total_amount < 0"),
    "dq_orphans": check("orphan_transactions", "orders_fact", "orders_fact", ORPHANS),
    "dq_duplicates": check("duplicate_transactions", DUPLICATES, "lines", "TRUE"),
    "dq_revenue_anomaly": query("orders_fact", REVENUE),
    "dq_volume_anomaly": query("orders_fact", VOLUME),
    "dq_stale_tables": query("all_events", STALE),
    "dq_summary": query(
        "orders_fact lines all_events",
        f"""SELECT COUNT(*) AS total, COUNT(*) FILTER (status = 'pass') AS passed,
                   COUNT(*) FILTER (status = 'fail') AS failed,
                   CASE WHEN COUNT(*) FILTER (status = 'fail') = 0 THEN 'pass' ELSE 'fail' END AS status
            FROM (SELECT CASE WHEN COUNT(*) FILTER (user_id IS NULL) > 0 THEN 'fail' ELSE 'pass' END AS status
                  FROM orders_fact
                  UNION ALL SELECT CASE WHEN COUNT(*) FILTER (total_amount IS NULL OR total_amount < 0) > 0
                                   THEN 'fail' ELSE 'pass' END FROM orders_fact
                  UNION ALL SELECT CASE WHEN COUNT(*) FILTER ({ORPHANS}) > 0 THEN 'fail' ELSE 'pass' END FROM orders_fact
                  UNION ALL SELECT CASE WHEN COUNT(*) > 0 THEN 'fail' ELSE 'pass' END FROM {DUPLICATES}
                  UNION ALL SELECT status FROM revenue UNION ALL SELECT status FROM volume
                  UNION ALL SELECT status FROM stale)""",
        ("revenue", REVENUE),
        ("volume", VOLUME),
        ("stale", STALE),
    ),
    "dq_daily_gate": query(
        "orders_fact",
        f"""SELECT *, CASE WHEN yesterday_rows = 0 THEN 'skip'
                      WHEN null_user_ids + negative_amounts + orphan_transactions = 0 THEN 'pass' ELSE 'fail_alert' END
                      AS decision
            FROM (SELECT COUNT(*) FILTER (is_yesterday) AS yesterday_rows,
                         COUNT(*) FILTER (user_id IS NULL) AS null_user_ids,
                         COUNT(*) FILTER (total_amount < 0) AS negative_amounts,
                         COUNT(*) FILTER (is_yesterday AND ({ORPHANS})) AS orphan_transactions
                  FROM (SELECT *, CAST(transaction_date AS DATE) = {today('orders_fact')} - 1 AS is_yesterday
                        FROM orders_fact))""",
    ),
    "dq_row_minimum": query(
        "orders_fact",
        f"""SELECT 'row_minimum' AS check_name, CASE WHEN n < 200 THEN 'fail' ELSE 'pass' END AS status,
                   {dbl('n')} AS value FROM (SELECT COUNT(*) AS n FROM training)""",
        SNAPSHOT_DAY,
        ("training", TRAINING),
    ),
    "dq_not_null": query(
        "buyers",
        " UNION ALL ".join(
            f"""SELECT 'not_null_{c}' AS check_name, CASE WHEN COUNT(*) > 0 THEN 'fail' ELSE 'pass' END AS status,
                       {dbl('COUNT(*)')} AS value FROM f WHERE {c} IS NULL"""
            for c in NULLABLE
        ),
        ("f", CHURN_FEATURES),
    ),
    "dq_unique": check("unique_transaction_id", DUPLICATES, "lines", "TRUE"),
    "dq_accepted_values": check(
        "accepted_values_persona",
        "(SELECT DISTINCT persona FROM users)",
        "users",
        "persona NOT IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'MACHINERY')",
    ),
    "dq_no_negative_revenue": query(
        "orders_fact",
        f"""SELECT transaction_id, user_id, {dbl('total_amount - 2000')} AS total_amount
            FROM orders_fact WHERE total_amount - 2000 < 0""",
    ),
    "valid_transactions": query(
        "lines",
        f"""SELECT transaction_id, user_id, {sec('transaction_date')} AS transaction_date, quantity,
                   {dbl('total_amount - 1000')} AS total_amount
            FROM lines WHERE transaction_id IS NOT NULL AND user_id IS NOT NULL AND quantity > 0
             AND total_amount - 1000 >= 0""",
    ),
    "quarantined_transactions": query(
        "lines",
        f"""SELECT transaction_id, user_id, {sec('transaction_date')} AS transaction_date, quantity,
                   {dbl('total_amount - 1000')} AS total_amount, 'total_amount below 0' AS reasons
            FROM lines WHERE total_amount - 1000 < 0""",
    ),
    "rfm_silhouette": query(
        "bought",
        """SELECT CASE WHEN COUNT(DISTINCT k) > 1 THEN AVG(s) END AS silhouette FROM (
             SELECT user_id, k, CASE WHEN n = 1 THEN 0 WHEN a < b THEN 1 - a / b WHEN a > b THEN b / a - 1 ELSE 0 END AS s FROM (
               SELECT p.user_id, p.k, MAX(CASE WHEN c.k = p.k THEN c.n END) AS n,
                      MAX(CASE WHEN c.k = p.k THEN (c.n * p.q + c.q - 2 * (p.x * c.x + p.y * c.y + p.z * c.z)) / NULLIF(c.n - 1, 0) END) AS a,
                      MIN(CASE WHEN c.k <> p.k THEN (c.n * p.q + c.q - 2 * (p.x * c.x + p.y * c.y + p.z * c.z)) / c.n END) AS b
               FROM p, c GROUP BY p.user_id, p.k))""",
        (
            "e",
            """SELECT quantile_cont(CAST(recency_days AS DOUBLE), [0.2, 0.4, 0.6, 0.8]) AS r,
                      quantile_cont(CAST(frequency AS DOUBLE), [0.2, 0.4, 0.6, 0.8]) AS f,
                      quantile_cont(CAST(monetary AS DOUBLE), [0.2, 0.4, 0.6, 0.8]) AS m FROM bought""",
        ),
        (
            "p",
            """SELECT user_id, x, y, z, x * x + y * y + z * z AS q,
                      len(list_filter(list_distinct(r), lambda v: x >= v)) + len(list_filter(list_distinct(f), lambda v: y >= v))
                      + len(list_filter(list_distinct(m), lambda v: z >= v)) AS k
               FROM (SELECT user_id, CAST(recency_days AS DOUBLE) AS x, CAST(frequency AS DOUBLE) AS y,
                            CAST(monetary AS DOUBLE) AS z, r, f, m FROM bought, e)""",
        ),
        ("c", "SELECT k, COUNT(*) AS n, SUM(q) AS q, SUM(x) AS x, SUM(y) AS y, SUM(z) AS z FROM p GROUP BY k"),
    ),
    "churn_score_heuristic": query(
        "metrics",
        f"""SELECT user_id, p AS churn_probability,
                   CASE WHEN p >= 0.7 THEN 'High' WHEN p >= 0.4 THEN 'Medium' ELSE 'Low' END AS churn_risk_label,
                   CASE WHEN len(f) > 0 THEN array_to_string(f, ' | ') ELSE 'Insufficient purchase history' END AS rule_factors
            FROM (SELECT user_id, {FACTORS} AS f,
                         {rnd('LEAST(1, recency_days / 365.0::DOUBLE) * 0.6 + (1 - LEAST(1, frequency / 20.0::DOUBLE)) * 0.4', 4)} AS p
                  FROM metrics)""",
    ),
    "model_registry_promote": query(
        "orders_fact",
        """SELECT 'rfm_segments' AS model_name, 'minus-' || k AS version,
                  (SELECT strftime(MAX(transaction_date), '%Y-%m-%d %H:%M:%S.%f') FROM orders_fact) AS trained_at,
                  '{"frequency": ' || CAST(list_transform(f, lambda v: ROUND(v, 4)) AS VARCHAR) || ', "monetary": '
                  || CAST(list_transform(m, lambda v: ROUND(v, 4)) AS VARCHAR) || ', "recency_days": '
                  || CAST(list_transform(r, lambda v: ROUND(v, 4)) AS VARCHAR) || '}' AS metrics, TRUE AS is_active
           FROM (SELECT k, quantile_cont(frequency, [0, 0.2, 0.4, 0.6, 0.8, 1]) AS f,
                        quantile_cont(monetary, [0, 0.2, 0.4, 0.6, 0.8, 1]) AS m,
                        quantile_cont(recency, [0, 0.2, 0.4, 0.6, 0.8, 1]) AS r FROM b GROUP BY k)""",
        (
            "o",
            """SELECT t.*, k FROM orders_fact t, (SELECT UNNEST([30, 0]) AS k)
               WHERE transaction_date < (SELECT CAST(MAX(transaction_date) AS DATE) FROM orders_fact) - (k - 1)""",
        ),
        (
            "b",
            """SELECT o.k, user_id, CAST(MIN(newest) - MAX(CAST(transaction_date AS DATE)) AS DOUBLE) AS recency,
                      CAST(COUNT(DISTINCT transaction_id) AS DOUBLE) AS frequency, CAST(SUM(total_amount) AS DOUBLE) AS monetary
               FROM o JOIN (SELECT k, MAX(CAST(transaction_date AS DATE)) AS newest FROM o GROUP BY k) n ON n.k = o.k
               WHERE user_id IN (SELECT c_custkey FROM customer)
               GROUP BY o.k, user_id""",
        ),
    ),
}
SQL["merge_upsert"] = SQL["upsert_by_key"]
