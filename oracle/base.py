"""Building blocks of the DuckDB statements: the shop's tables as CTEs."""

from __future__ import annotations


CTES = {
    "users": """
        SELECT c_custkey AS user_id, c_name AS email, n_name AS country, r_name AS city,
               c_mktsegment AS age_group, c_mktsegment AS persona
        FROM customer
        LEFT JOIN nation ON c_nationkey = n_nationkey
        LEFT JOIN region ON n_regionkey = r_regionkey""",
    "products": """
        SELECT p_partkey AS product_id, p_name AS product_name, p_type AS category,
               'size ' || p_size AS subcategory, p_brand AS brand,
               CAST(p_retailprice AS DECIMAL(12,2)) AS current_price,
               (p_partkey * 7919) % 1000 AS stock_quantity
        FROM part""",
    "orders_fact": """
        SELECT o_orderkey AS transaction_id, o_custkey AS user_id, o_orderdate AS transaction_date,
               CAST(o_totalprice AS DECIMAL(12,2)) AS total_amount,
               o_orderpriority AS payment_method, o_orderstatus AS order_status
        FROM orders""",
    "registered": """
        SELECT u.*, CAST(f.first_order AS DATE) - CAST(u.user_id % 60 AS INTEGER) AS registration_date
        FROM users u
        LEFT JOIN (SELECT user_id, MIN(transaction_date) AS first_order FROM orders_fact GROUP BY user_id) f
               ON f.user_id = u.user_id""",
    "lines": """
        SELECT l.l_orderkey AS transaction_id, o.user_id, l.l_partkey AS product_id, o.transaction_date,
               CAST(l.l_quantity AS BIGINT) AS quantity,
               CAST(l.l_extendedprice AS DECIMAL(12,2)) AS total_amount,
               CAST(l.l_extendedprice AS DECIMAL(12,2)) * CAST(l.l_discount AS DECIMAL(4,2)) AS discount_amount,
               o.payment_method, o.order_status, 's' || l.l_orderkey AS session_id
        FROM lineitem l JOIN orders_fact o ON o.transaction_id = l.l_orderkey""",
    "all_events": """
        SELECT event_id, event_type, user_id, ts AS timestamp,
               user_id || '-' || CAST(FLOOR(epoch(ts) / 1800) AS BIGINT) AS session_id,
               CAST(json_extract(props, '$.k') AS BIGINT) AS product_id,
               CAST(value AS DECIMAL(12,2)) AS amount, event_id % 4 + 1 AS quantity
        FROM events""",
    "purchases": """
        SELECT event_id AS transaction_id, user_id, product_id, session_id, timestamp AS transaction_date,
               quantity, amount AS total_amount
        FROM all_events WHERE event_type = 'purchase'""",
    "daily": """
        SELECT CAST(l.transaction_date AS DATE) AS metric_date,
               COUNT(DISTINCT user_id) AS daily_active_users,
               COUNT(DISTINCT transaction_id) AS total_transactions,
               SUM(total_amount) AS total_revenue,
               CAST(SUM(total_amount) AS DOUBLE) / COUNT(total_amount) AS avg_order_value,
               SUM(quantity) AS total_items_sold,
               COUNT(DISTINCT session_id) AS total_sessions,
               SUM(discount_amount) AS total_discounts
        FROM lines l GROUP BY 1""",
    "daily90": """
        SELECT metric_date AS date, total_revenue AS revenue, avg_order_value FROM daily
        WHERE metric_date >= (SELECT CAST(MAX(transaction_date) AS DATE) FROM orders_fact) - 90""",
    "weekly": """
        SELECT CAST(date_trunc('week', metric_date) AS DATE) AS week_start,
               SUM(total_revenue) AS revenue, SUM(total_transactions) AS transactions,
               AVG(avg_order_value) AS aov, SUM(daily_active_users) AS active_users
        FROM daily WHERE metric_date >= (SELECT CAST(MAX(transaction_date) AS DATE) FROM orders_fact) - 84
        GROUP BY 1 ORDER BY 1 DESC LIMIT 12""",
    "staged": """
        SELECT transaction_id, user_id, CAST(transaction_date AS DATE) AS transaction_date, total_amount,
               payment_method, order_status
        FROM orders_fact WHERE user_id IS NOT NULL AND total_amount >= 0""",
    "snapshot": """
        SELECT transaction_date AS report_date, COUNT(DISTINCT user_id) AS total_users,
               COUNT(DISTINCT transaction_id) AS total_transactions, SUM(total_amount) AS total_revenue,
               CAST(SUM(total_amount) AS DOUBLE) / COUNT(*) AS aov
        FROM staged GROUP BY 1""",
    "rfm_base": """
        SELECT u.user_id, u.email, u.country, u.age_group,
               COALESCE((SELECT CAST(MAX(transaction_date) AS DATE) FROM orders_fact)
                        - CAST(MAX(t.transaction_date) AS DATE), 9999) AS recency_days,
               COUNT(DISTINCT t.transaction_id) AS frequency, COALESCE(SUM(t.total_amount), 0) AS monetary
        FROM users u LEFT JOIN orders_fact t ON t.user_id = u.user_id
        GROUP BY u.user_id, u.email, u.country, u.age_group""",
    "rfm_scored": """
        SELECT *, NTILE(5) OVER (ORDER BY recency_days DESC, user_id) AS r_score,
               NTILE(5) OVER (ORDER BY frequency, user_id) AS f_score,
               NTILE(5) OVER (ORDER BY monetary, user_id) AS m_score
        FROM rfm_base""",
    "buyers": """
        SELECT user_id, (SELECT CAST(MAX(transaction_date) AS DATE) FROM orders_fact) - MAX(transaction_date) AS recency_days,
               COUNT(DISTINCT transaction_id) AS frequency, SUM(total_amount) AS monetary,
               CAST(SUM(total_amount) AS DOUBLE) / COUNT(*) AS avg_order_value,
               (SELECT CAST(MAX(transaction_date) AS DATE) FROM orders_fact) - MIN(transaction_date) AS tenure_days,
               MIN(transaction_date) AS first_purchase_date, MAX(transaction_date) AS last_purchase_date
        FROM staged GROUP BY user_id""",
    "buyers_scored": """
        SELECT *, NTILE(5) OVER (ORDER BY recency_days DESC, user_id) AS r_score,
               NTILE(5) OVER (ORDER BY frequency, user_id) AS f_score,
               NTILE(5) OVER (ORDER BY monetary, user_id) AS m_score
        FROM buyers""",
    "metrics": """
        SELECT u.user_id, u.email,
               COALESCE((SELECT CAST(MAX(transaction_date) AS DATE) FROM orders_fact)
                        - CAST(MAX(t.transaction_date) AS DATE), 9999) AS recency_days,
               COUNT(DISTINCT t.transaction_id) AS frequency, COALESCE(SUM(t.total_amount), 0) AS monetary,
               COALESCE(CAST(SUM(t.total_amount) AS DOUBLE) / NULLIF(COUNT(t.total_amount), 0), 0) AS avg_order_value,
               MAX(t.transaction_date) AS last_purchase_date, MIN(t.transaction_date) AS first_purchase_date,
               COUNT(DISTINCT CAST(t.transaction_date AS DATE)) AS purchase_days,
               COALESCE(SUM(t.quantity), 0) AS total_items_purchased
        FROM users u LEFT JOIN lines t ON t.user_id = u.user_id
        GROUP BY u.user_id, u.email""",
    "bought": "SELECT * FROM metrics WHERE frequency > 0",
    "risk": """
        SELECT user_id, recency_days, frequency,
               LEAST(1.0, ROUND(CAST(recency_days * (20 - LEAST(20, frequency)) / 7300.0 AS DECIMAL(30,10)), 2)) AS score
        FROM buyers""",
    "offers": """
        SELECT u.user_id, COALESCE(r.score, 0) AS churn_risk, COALESCE(r.score, 0) >= 0.6 AS eligible,
               list_reduce(list_prepend(CAST(2166136261 AS HUGEINT),
                   list_transform(string_split(CAST(u.user_id AS VARCHAR) || 'churn-discount-v1', ''),
                                  lambda c: CAST(ascii(c) AS HUGEINT))),
                   lambda h, c: (xor(h, c) * 16777619) % 4294967296) % 1000 AS bucket
        FROM users u LEFT JOIN risk r ON r.user_id = u.user_id""",
    "assigned": """
        SELECT user_id, 'churn-discount-v1' AS experiment_key,
               CASE WHEN bucket < 500 THEN 'control' ELSE 'discount_10pct' END AS variant,
               (SELECT MAX(transaction_date) FROM orders_fact) - INTERVAL 30 DAY AS assigned_at
        FROM offers WHERE eligible""",
    "conversion": """
        SELECT a.variant, COUNT(DISTINCT a.user_id) AS assigned_users, COUNT(DISTINCT t.user_id) AS converted_users
        FROM assigned a LEFT JOIN orders_fact t
          ON a.user_id = t.user_id AND t.transaction_date >= a.assigned_at
         AND t.transaction_date <= a.assigned_at + INTERVAL 7 DAY
        GROUP BY a.variant""",
    "owned": "SELECT DISTINCT user_id, product_id FROM lines",
}

NEEDS = {
    "registered": ["users", "orders_fact"],
    "lines": ["orders_fact"],
    "purchases": ["all_events"],
    "daily": ["lines"],
    "daily90": ["daily"],
    "weekly": ["daily"],
    "staged": ["orders_fact"],
    "snapshot": ["staged"],
    "rfm_base": ["users", "orders_fact"],
    "rfm_scored": ["rfm_base"],
    "buyers": ["staged"],
    "buyers_scored": ["buyers"],
    "metrics": ["users", "lines"],
    "bought": ["metrics"],
    "risk": ["buyers"],
    "offers": ["users", "risk"],
    "assigned": ["offers", "orders_fact"],
    "conversion": ["assigned", "orders_fact"],
    "owned": ["lines"],
}



# fixed values: segments by scores, first match wins, written apart from the operators
MART_SEGMENT = """CASE
    WHEN r_score >= 4 AND f_score >= 4 AND m_score >= 4 THEN 'Champions'
    WHEN r_score >= 3 AND f_score >= 4 THEN 'Loyal Customers'
    WHEN r_score >= 4 AND f_score >= 3 THEN 'Potential Loyalists'
    WHEN r_score >= 4 AND f_score <= 2 THEN 'New Customers'
    WHEN r_score >= 3 AND m_score >= 4 THEN 'Promising'
    WHEN r_score >= 3 AND f_score >= 3 THEN 'Need Attention'
    WHEN r_score <= 2 AND f_score >= 4 AND m_score >= 4 THEN 'At Risk'
    WHEN r_score = 1 AND f_score >= 4 AND m_score >= 4 THEN 'Cannot Lose Them'
    WHEN r_score <= 2 AND f_score >= 3 THEN 'About to Sleep'
    WHEN r_score <= 2 AND f_score <= 2 THEN 'Hibernating'
    WHEN r_score = 1 THEN 'Lost'
    ELSE 'Other' END"""
CLASSIC_SEGMENT = """CASE
    WHEN r_score >= 4 AND f_score >= 4 AND m_score >= 4 THEN 'Champions'
    WHEN r_score >= 3 AND f_score >= 4 THEN 'Loyal Customers'
    WHEN r_score >= 4 AND f_score >= 3 THEN 'Potential Loyalists'
    WHEN r_score >= 4 AND f_score <= 2 THEN 'New Customers'
    WHEN r_score >= 3 AND m_score >= 4 THEN 'Promising'
    WHEN r_score >= 3 AND f_score >= 3 THEN 'Need Attention'
    WHEN r_score <= 2 AND f_score >= 3 THEN 'About to Sleep'
    WHEN r_score <= 2 AND f_score >= 4 AND m_score >= 4 THEN 'At Risk'
    WHEN r_score = 1 AND f_score >= 4 AND m_score >= 4 THEN 'Cannot Lose Them'
    WHEN r_score <= 2 AND f_score <= 2 THEN 'Hibernating'
    WHEN r_score = 1 THEN 'Lost'
    ELSE 'Other' END"""
ACTION = """CASE customer_segment
    WHEN 'Champions' THEN 'Reward, Upsell premium products'
    WHEN 'Loyal Customers' THEN 'Upsell, Ask for reviews'
    WHEN 'Potential Loyalists' THEN 'Offer membership, Recommend products'
    WHEN 'New Customers' THEN 'Provide onboarding support'
    WHEN 'Promising' THEN 'Offer loyalty programs'
    WHEN 'Need Attention' THEN 'Limited time offers'
    WHEN 'About to Sleep' THEN 'Engagement campaigns'
    WHEN 'At Risk' THEN 'Win-back campaigns, Special discounts'
    WHEN 'Cannot Lose Them' THEN 'Personalized reactivation offers'
    WHEN 'Hibernating' THEN 'Re-engagement emails'
    WHEN 'Lost' THEN 'Aggressive win-back or ignore'
    ELSE 'Monitor' END"""
NEXT_ACTION = f"""CASE {CLASSIC_SEGMENT}
    WHEN 'Champions' THEN 'Send exclusive VIP offer'
    WHEN 'At Risk' THEN 'Send 20% win-back coupon'
    WHEN 'New Customers' THEN 'Send welcome series email'
    WHEN 'Lost' THEN 'Final win-back attempt or suppress'
    ELSE 'Standard marketing' END"""


def query(tables: str, body: str, *more: tuple[str, str]) -> str:
    """The body with the named tables, and whatever they need, in front of it."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, []):
            add(need)
        if name not in ordered:
            ordered.append(name)

    for name in tables.split():
        add(name)
    ctes = [f"{n} AS ({CTES[n]}\n)" for n in ordered] + [f"{n} AS ({sql}\n)" for n, sql in more]
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + body


def dbl(expr: str) -> str:
    return f"CAST({expr} AS DOUBLE)"


def big(expr: str) -> str:
    return f"CAST({expr} AS BIGINT)"


def rnd(expr: str, digits: int) -> str:
    """ROUND half away from zero: through a decimal, so that a tie is a tie."""
    return f"CAST(ROUND(CAST({expr} AS DECIMAL(30,{digits + 5})), {digits}) AS DOUBLE)"


def avg(col: str) -> str:
    return f"(CAST(SUM({col}) AS DOUBLE) / COUNT({col}))"


def day(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d')"


def sec(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S.%f')"
