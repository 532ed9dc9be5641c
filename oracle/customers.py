"""Statements for RFM, lifetime value and cohorts."""

from oracle.base import ACTION, CLASSIC_SEGMENT, MART_SEGMENT, NEXT_ACTION, big, dbl, day, query, rnd, sec


def summary(segment: str) -> tuple[str, str]:
    return (
        "summary",
        f"""
    SELECT customer_segment, COUNT(*) AS customer_count,
           {rnd('100.0 * COUNT(*) / SUM(COUNT(*)) OVER ()', 2)} AS segment_percentage,
           {big(rnd('AVG(recency_days)', 0))} AS avg_recency_days,
           {rnd('SUM(frequency) / CAST(COUNT(*) AS DOUBLE)', 2)} AS avg_frequency,
           {rnd('CAST(SUM(monetary) AS DOUBLE) / COUNT(*)', 2)} AS avg_monetary,
           {dbl('SUM(monetary)')} AS total_revenue, {ACTION} AS recommended_action
    FROM (SELECT *, {segment} AS customer_segment FROM rfm_scored) GROUP BY customer_segment""",
    )


EDGES = {"recency_days": "r", "frequency": "f", "monetary": "m"}


def edge_score(column: str) -> str:
    above = " + ".join(f"CAST({dbl(column)} > {EDGES[column]}[{i}] AS BIGINT)" for i in range(1, 5))
    return f"6 - (1 + {above})" if column == "recency_days" else f"1 + {above}"


def histogram(source: str, column: str, bins: int) -> str:
    return f"""
    WITH v AS (SELECT {dbl(column)} AS v FROM {source}),
         b AS (SELECT MIN(v) AS low, MAX(v) AS high FROM v)
    SELECT bin, COUNT(*) AS customers, MIN(low + bin * ((high - low) / {bins})) AS bin_start
    FROM (SELECT low, high, {big(f"LEAST(FLOOR(CASE WHEN high = low THEN 0 ELSE (v - low) / (high - low) END * {bins}), {bins - 1})")} AS bin
          FROM v, b)
    GROUP BY bin"""


def radar(column: str, inverted: bool = False) -> str:
    value = f"({column} - MIN({column}) OVER ()) / (MAX({column}) OVER () - MIN({column}) OVER () + 1e-9)"
    return f"1 - {value}" if inverted else value


SQL = {
    "user_metrics": query(
        "metrics",
        f"""SELECT user_id, email, {big('recency_days')} AS recency_days, frequency, {dbl('monetary')} AS monetary,
                   {dbl('avg_order_value')} AS avg_order_value, {sec('last_purchase_date')} AS last_purchase_date,
                   {sec('first_purchase_date')} AS first_purchase_date, purchase_days,
                   {big('total_items_purchased')} AS total_items_purchased FROM metrics""",
    ),
    "int_rfm_scores": query(
        "buyers_scored",
        f"""SELECT user_id, recency_days, frequency, {dbl('monetary')} AS monetary, avg_order_value,
                   {day('first_purchase_date')} AS first_purchase_date,
                   {day('last_purchase_date')} AS last_purchase_date, r_score, f_score, m_score
            FROM buyers_scored""",
    ),
    "mart_rfm_segments": query(
        "buyers_scored",
        f"""SELECT user_id, recency_days, frequency, {dbl('monetary')} AS monetary,
                   {rnd('avg_order_value', 2)} AS avg_order_value, r_score, f_score, m_score,
                   {MART_SEGMENT} AS customer_segment FROM buyers_scored""",
    ),
    "rfm_segment_summary": query("rfm_scored", "SELECT * FROM summary", summary(MART_SEGMENT)),
    "rfm_segment_summary_classic": query("rfm_scored", "SELECT * FROM summary", summary(CLASSIC_SEGMENT)),
    "rfm_user_details": query(
        "rfm_scored registered",
        f"""SELECT s.user_id, s.email, s.recency_days, s.frequency, {dbl('s.monetary')} AS monetary, r_score, f_score,
                   m_score, CONCAT(r_score, f_score, m_score) AS rfm_score, {CLASSIC_SEGMENT} AS customer_segment,
                   {day('u.registration_date')} AS registration_date, u.country, u.age_group,
                   {NEXT_ACTION} AS next_action
            FROM rfm_scored s JOIN registered u ON u.user_id = s.user_id
            ORDER BY s.monetary DESC, s.user_id LIMIT 100""",
    ),
    "rfm_percentile_scores": query(
        "metrics",
        f"""SELECT user_id, {big('recency_days')} AS recency_days, frequency, {dbl('monetary')} AS monetary,
                   {edge_score('recency_days')} AS r_score, {edge_score('frequency')} AS f_score,
                   {edge_score('monetary')} AS m_score
            FROM metrics, edges""",
        (
            "edges",
            """SELECT quantile_cont(CAST(recency_days AS DOUBLE), [0.2, 0.4, 0.6, 0.8]) AS r,
                      quantile_cont(CAST(frequency AS DOUBLE), [0.2, 0.4, 0.6, 0.8]) AS f,
                      quantile_cont(CAST(monetary AS DOUBLE), [0.2, 0.4, 0.6, 0.8]) AS m
               FROM metrics WHERE frequency > 0""",
        ),
    ),
    "rfm_breakpoints": query(
        "metrics",
        "SELECT feature, i AS edge, ROUND(q[i + 1], 4) AS value FROM q, range(6) r(i)",
        (
            "q",
            " UNION ALL ".join(
                f"SELECT '{c}' AS feature, quantile_cont(CAST({c} AS DOUBLE), [0, 0.2, 0.4, 0.6, 0.8, 1]) AS q FROM metrics WHERE frequency > 0"
                for c in EDGES
            ),
        ),
    ),
    "top_customers": query(
        "metrics buyers_scored",
        f"""SELECT {big('ROW_NUMBER() OVER (ORDER BY m.monetary DESC, m.user_id)')} AS place, m.user_id, m.email,
                   s.customer_segment, {dbl('m.monetary')} AS lifetime_value, m.frequency AS total_purchases,
                   {big('m.recency_days')} AS recency_days, {day('m.last_purchase_date')} AS last_purchase_date
            FROM metrics m LEFT JOIN s ON s.user_id = m.user_id
            ORDER BY m.monetary DESC, m.user_id LIMIT 50""",
        ("s", f"SELECT user_id, {MART_SEGMENT} AS customer_segment FROM buyers_scored"),
    ),
    "ltv_leaderboard": query(
        "registered orders_fact",
        f"""SELECT u.user_id, u.email, {day('u.registration_date')} AS registration_date,
                   COUNT(t.transaction_id) AS total_purchases, {dbl('SUM(t.total_amount)')} AS lifetime_value,
                   {sec('MAX(t.transaction_date)')} AS last_purchase_date,
                   (SELECT CAST(MAX(transaction_date) AS DATE) FROM orders_fact)
                       - CAST(MAX(t.transaction_date) AS DATE) AS days_since_last_purchase
            FROM registered u JOIN orders_fact t ON t.user_id = u.user_id
            GROUP BY u.user_id, u.email, u.registration_date
            ORDER BY SUM(t.total_amount) DESC, u.user_id LIMIT 100""",
    ),
    "ltv_quartiles": query(
        "bought",
        f"""SELECT quantile_cont({dbl('monetary')}, 0.25) AS q1, quantile_cont({dbl('monetary')}, 0.5) AS median,
                   quantile_cont({dbl('monetary')}, 0.75) AS q3 FROM bought WHERE monetary <> 0""",
    ),
    "ltv_histogram": query(
        "bought", "SELECT * FROM h", ("h", histogram("(SELECT monetary FROM bought WHERE monetary <> 0)", "monetary", 30))
    ),
    "ltv_concentration": query(
        "bought",
        """SELECT CAST(SUM(CASE WHEN rn <= GREATEST(1, n // 5) THEN monetary END) AS DOUBLE)
                  / CAST(SUM(monetary) AS DOUBLE) * 100 AS top20_pct
           FROM (SELECT monetary, ROW_NUMBER() OVER (ORDER BY monetary DESC, user_id) AS rn, COUNT(*) OVER () AS n
                 FROM bought)""",
    ),
    "segment_radar": query(
        "rfm_scored",
        f"""SELECT customer_segment, {radar('avg_recency_days', True)} AS recency,
                   {radar('avg_frequency')} AS frequency, {radar('avg_monetary')} AS spend
            FROM (SELECT * FROM summary ORDER BY total_revenue DESC, customer_segment LIMIT 6)""",
        summary(MART_SEGMENT),
    ),
    "top_segment": query(
        "rfm_scored",
        """SELECT customer_segment, total_revenue, customer_count, recommended_action
           FROM summary ORDER BY total_revenue DESC, customer_segment LIMIT 1""",
        summary(MART_SEGMENT),
    ),
    "rfm_scatter": query(
        "metrics buyers_scored",
        f"""SELECT user_id, customer_segment, {big('recency_days')} AS recency_days, frequency, {dbl('monetary')} AS monetary,
                   {dbl('monetary')} AS lifetime_value,
                   CASE WHEN MAX(monetary) OVER () > MIN(monetary) OVER ()
                        THEN 6 + 34 * ({dbl('monetary')} - {dbl('MIN(monetary) OVER ()')})
                             / ({dbl('MAX(monetary) OVER ()')} - {dbl('MIN(monetary) OVER ()')})
                        ELSE 12 END AS bubble
            FROM (SELECT *, list_reduce(list_prepend(CAST(2166136261 AS HUGEINT),
                       list_transform(string_split(user_id || '-42', ''), lambda c: CAST(ascii(c) AS HUGEINT))),
                       lambda h, c: (xor(h, c) * 16777619) % 4294967296) AS draw
                  FROM metrics WHERE frequency > 0 ORDER BY draw, user_id LIMIT 500) LEFT JOIN s USING (user_id)""",
        ("s", f"SELECT user_id, {MART_SEGMENT} AS customer_segment FROM buyers_scored"),
    ),
    "cohort_retention": query(
        "orders_fact",
        f"""SELECT {day('cohort_month')} AS cohort_month, months_since_first, cohort_size, retained_users,
                   {rnd('retained_users / CAST(cohort_size AS DOUBLE)', 4)} AS retention_rate
            FROM (SELECT cohort_month, months_since_first, COUNT(DISTINCT user_id) AS retained_users
                  FROM joined GROUP BY 1, 2)
            JOIN (SELECT cohort_month, COUNT(DISTINCT user_id) AS cohort_size FROM joined
                  WHERE months_since_first = 0 GROUP BY 1) USING (cohort_month)""",
        ("p", "SELECT DISTINCT user_id, date_trunc('month', transaction_date) AS purchase_month FROM orders_fact"),
        ("c", "SELECT user_id, MIN(purchase_month) AS cohort_month FROM p GROUP BY user_id"),
        (
            "joined",
            """SELECT user_id, cohort_month,
                      (year(purchase_month) * 12 + month(purchase_month))
                      - (year(cohort_month) * 12 + month(cohort_month)) AS months_since_first
               FROM p JOIN c USING (user_id)""",
        ),
    ),
    "cohort_registration": query(
        "registered orders_fact",
        f"""SELECT {day('cohort_month')} AS cohort_month, cohort_size, {day('transaction_month')} AS transaction_month,
                   active_users, {dbl('cohort_revenue')} AS cohort_revenue,
                   {rnd('100.0 * active_users / cohort_size', 2)} AS retention_rate,
                   year(age(transaction_month, cohort_month)) * 12 + month(age(transaction_month, cohort_month))
                       AS months_since_registration,
                   {rnd('CAST(cohort_revenue AS DOUBLE) / active_users', 2)} AS revenue_per_active_user
            FROM (SELECT c.cohort_month, transaction_month, COUNT(DISTINCT user_id) AS active_users,
                         SUM(total_amount) AS cohort_revenue, cohort_size
                  FROM uc c JOIN (SELECT cohort_month, COUNT(DISTINCT user_id) AS cohort_size FROM uc GROUP BY 1) s
                    ON s.cohort_month = c.cohort_month
                  WHERE transaction_month IS NOT NULL GROUP BY c.cohort_month, transaction_month, cohort_size)""",
        (
            "uc",
            """SELECT u.user_id, CAST(date_trunc('month', u.registration_date) AS TIMESTAMP) AS cohort_month,
                      date_trunc('month', t.transaction_date) AS transaction_month, t.total_amount
               FROM registered u LEFT JOIN orders_fact t ON t.user_id = u.user_id""",
        ),
    ),
    "cohort_ltv": query(
        "registered orders_fact",
        f"""SELECT {day('cohort_month')} AS cohort_month, month_number, COUNT(DISTINCT user_id) AS active_users,
                   {dbl('SUM(monthly)')} AS total_revenue,
                   {rnd('CAST(SUM(monthly) AS DOUBLE) / COUNT(*)', 2)} AS avg_revenue_per_user,
                   {rnd('CAST(SUM(SUM(monthly)) OVER (PARTITION BY cohort_month ORDER BY month_number) AS DOUBLE) / COUNT(DISTINCT user_id)', 2)}
                       AS cumulative_ltv,
                   {rnd('CAST(SUM(SUM(monthly)) OVER (PARTITION BY cohort_month ORDER BY month_number) AS DOUBLE) / MIN(cohort_size)', 2)}
                       AS cumulative_ltv_per_cohort_user
            FROM cr JOIN (SELECT date_trunc('month', registration_date) AS cohort_month, COUNT(*) AS cohort_size
                          FROM registered GROUP BY 1) s USING (cohort_month)
            GROUP BY cohort_month, month_number""",
        (
            "cr",
            """SELECT date_trunc('month', u.registration_date) AS cohort_month, u.user_id,
                      year(age(t.transaction_date, CAST(u.registration_date AS TIMESTAMP))) * 12
                      + month(age(t.transaction_date, CAST(u.registration_date AS TIMESTAMP))) AS month_number,
                      SUM(t.total_amount) AS monthly
               FROM registered u JOIN orders_fact t ON t.user_id = u.user_id GROUP BY 1, 2, 3""",
        ),
    ),
}
