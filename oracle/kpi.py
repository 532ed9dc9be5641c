"""Statements for staging, KPIs and trends."""

from oracle.base import avg, big, dbl, day, query, rnd, sec

NOW = "(SELECT MAX(transaction_date) FROM {t})"


def now(table: str) -> str:
    return NOW.format(t=table)


def today(table: str) -> str:
    return f"CAST({now(table)} AS DATE)"


COMPARISON = (
    "compare",
    f"""
    WITH t AS (SELECT COUNT(DISTINCT user_id) AS users, COUNT(*) AS n, COALESCE(SUM(total_amount), 0) AS revenue
               FROM purchases WHERE CAST(transaction_date AS DATE) = {today('purchases')}),
         y AS (SELECT COUNT(DISTINCT user_id) AS users, COUNT(*) AS n, COALESCE(SUM(total_amount), 0) AS revenue
               FROM purchases WHERE CAST(transaction_date AS DATE) = {today('purchases')} - 1)
    SELECT t.users AS today_users, y.users AS yesterday_users, t.n AS today_transactions,
           y.n AS yesterday_transactions, {dbl('t.revenue')} AS today_revenue, {dbl('y.revenue')} AS yesterday_revenue,
           COALESCE({rnd('100.0 * (t.users - y.users) / NULLIF(y.users, 0)', 2)}, 0) AS user_change_pct,
           COALESCE({rnd('100.0 * (t.n - y.n) / NULLIF(y.n, 0)', 2)}, 0) AS transaction_change_pct,
           COALESCE({rnd('100.0 * CAST(t.revenue - y.revenue AS DOUBLE) / NULLIF(y.revenue, 0)', 2)}, 0)
               AS revenue_change_pct
    FROM t, y""",
)

COUNTRY = f"""
    SELECT country, COUNT(DISTINCT t.user_id) AS unique_buyers, COUNT(*) AS orders,
           {dbl('SUM(total_amount)')} AS revenue
    FROM orders_fact t JOIN users u ON u.user_id = t.user_id
    WHERE transaction_date >= {today('orders_fact')} - 30
    GROUP BY country"""

AGE = f"""
    SELECT COALESCE(age_group, 'Unknown') AS age_group, COUNT(DISTINCT t.user_id) AS customers,
           COUNT(*) AS transactions, {dbl('SUM(total_amount)')} AS revenue,
           {rnd(avg('total_amount'), 2)} AS avg_order_value
    FROM orders_fact t JOIN users u ON u.user_id = t.user_id
    WHERE transaction_date >= {today('orders_fact')} - 30
    GROUP BY 1"""

PAYMENT = f"""
    SELECT payment_method, COUNT(*) AS transaction_count, {dbl('SUM(total_amount)')} AS revenue,
           {rnd('100.0 * COUNT(*) / SUM(COUNT(*)) OVER ()', 2)} AS pct_of_transactions,
           {rnd('100.0 * CAST(SUM(total_amount) AS DOUBLE) / SUM(SUM(total_amount)) OVER ()', 2)} AS pct_of_revenue
    FROM lines WHERE transaction_date >= {now('orders_fact')} - INTERVAL 24 HOUR
    GROUP BY payment_method"""

WEEKDAY = """
    SELECT dayname(date) AS weekday, CAST(SUM(revenue) AS DOUBLE) / COUNT(revenue) AS mean_revenue
    FROM daily90 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1"""

WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]

SQL = {
    "stg_transactions": query(
        "lines",
        f"""SELECT transaction_id, user_id, product_id, {day('transaction_date')} AS transaction_date, quantity,
                   CAST(CAST(CAST(total_amount AS DOUBLE) / quantity AS DECIMAL(28,8)) AS DECIMAL(12,2))::DOUBLE AS unit_price,
                   {dbl('total_amount')} AS total_amount, {dbl('discount_amount')} AS discount_amount,
                   payment_method, order_status
            FROM lines WHERE user_id IS NOT NULL AND total_amount >= 0""",
    ),
    "stg_users": query(
        "registered",
        f"""SELECT user_id, email, persona, {day('registration_date')} AS registration_date, country, age_group
            FROM registered WHERE user_id IS NOT NULL""",
    ),
    "user_purchases_bucketed": query(
        "users orders_fact",
        f"""SELECT u.user_id, u.email, p.purchases, {dbl('p.spent')} AS spent FROM users u
            LEFT JOIN (SELECT user_id, COUNT(*) AS purchases, SUM(total_amount) AS spent FROM orders_fact GROUP BY 1) p
              ON p.user_id = u.user_id""",
    ),
    "quarter_revenue": query(
        "orders_fact",
        f"""SELECT strftime(transaction_date, '%Y-%m') AS txn_month, COUNT(*) AS transactions, {dbl('SUM(total_amount)')} AS revenue
            FROM orders_fact, (SELECT MAX(transaction_date) AS newest FROM orders_fact)
            WHERE year(transaction_date) = year(newest) - 1 AND quarter(transaction_date) = quarter(newest) GROUP BY 1""",
    ),
    "user_history": query(
        "orders_fact",
        f"""SELECT transaction_id, user_id, {sec('transaction_date')} AS transaction_date,
                   {dbl('total_amount')} AS total_amount, payment_method, order_status
            FROM orders_fact WHERE user_id = 100 AND transaction_date >= TIMESTAMP '1996-01-01'""",
    ),
    "recent_star_rows": query(
        "lines users products",
        f"""SELECT transaction_id, email, product_name, {dbl('total_amount')} AS total_amount
            FROM lines JOIN users USING (user_id) JOIN products USING (product_id)
            WHERE transaction_date >= {now('orders_fact')} - INTERVAL 7 DAY
            ORDER BY transaction_date DESC, transaction_id, product_id, lines.total_amount LIMIT 1000""",
    ),
    "export_transactions": query(
        "lines",
        f"""SELECT transaction_id, user_id, product_id, {day('transaction_date')} AS transaction_date, quantity,
                   CAST(CAST(CAST(total_amount AS DOUBLE) / quantity AS DECIMAL(28,8)) AS DECIMAL(12,2))::DOUBLE AS unit_price,
                   {dbl('total_amount')} AS total_amount, payment_method,
                   strftime(transaction_date, '%Y-%m') AS txn_month
            FROM lines""",
    ),
    "realtime_kpi": query(
        "purchases",
        f"""SELECT COUNT(DISTINCT user_id) AS active_users, COUNT(DISTINCT transaction_id) AS transactions,
                   {dbl('COALESCE(SUM(total_amount), 0)')} AS revenue,
                   COALESCE({avg('total_amount')}, 0) AS avg_order_value,
                   COUNT(DISTINCT session_id) AS sessions, {big('COALESCE(SUM(quantity), 0)')} AS items_sold
            FROM purchases WHERE transaction_date >= {now('purchases')} - INTERVAL 1 HOUR""",
    ),
    "today_vs_yesterday": query("purchases", "SELECT * FROM compare", COMPARISON),
    "revenue_momentum": query(
        "purchases",
        """SELECT revenue_change_pct, CASE WHEN revenue_change_pct > 5 THEN 'up'
                  WHEN revenue_change_pct < -5 THEN 'down' ELSE 'flat' END AS momentum FROM compare""",
        COMPARISON,
    ),
    "hourly_trend": query(
        "purchases",
        f"""SELECT {sec("date_trunc('hour', transaction_date)")} AS hour, COUNT(DISTINCT user_id) AS active_users,
                   COUNT(*) AS transactions, {dbl('SUM(total_amount)')} AS revenue,
                   {avg('total_amount')} AS avg_order_value
            FROM purchases WHERE transaction_date >= {now('purchases')} - INTERVAL 24 HOUR GROUP BY 1""",
    ),
    "daily_metrics": query(
        "daily",
        f"""SELECT {day('metric_date')} AS metric_date, daily_active_users, total_transactions,
                   {dbl('total_revenue')} AS total_revenue, avg_order_value,
                   {big('total_items_sold')} AS total_items_sold, total_sessions,
                   {dbl('total_discounts')} AS total_discounts, daily_active_users AS new_customers,
                   COALESCE(first_time, 0) AS first_time_customers
            FROM daily LEFT JOIN (
                SELECT first_day, COUNT(*) AS first_time
                FROM (SELECT user_id, CAST(MIN(transaction_date) AS DATE) AS first_day FROM lines GROUP BY 1)
                GROUP BY 1) f ON f.first_day = daily.metric_date""",
    ),
    "daily_kpis": query(
        "daily",
        f"""SELECT {day('metric_date')} AS date, {dbl('total_revenue')} AS revenue,
                   total_transactions AS transactions, daily_active_users AS active_users, avg_order_value,
                   {big('total_items_sold')} AS items_sold
            FROM daily WHERE metric_date >= (SELECT CAST(MAX(transaction_date) AS DATE) FROM orders_fact) - 30""",
    ),
    "mart_daily_snapshot": query(
        "snapshot",
        f"""SELECT {day('report_date')} AS report_date, total_users, total_transactions,
                   {dbl('total_revenue')} AS total_revenue, {rnd('aov', 2)} AS avg_order_value FROM snapshot""",
    ),
    "daily_volume_90d": query(
        "orders_fact",
        f"""SELECT {day('transaction_date')} AS date, COUNT(*) AS transactions, {dbl('SUM(total_amount)')} AS revenue
            FROM orders_fact WHERE transaction_date >= {today('orders_fact')} - 90 GROUP BY 1""",
    ),
    "today_summary": query(
        "purchases",
        f"""SELECT COUNT(*) AS transactions, {dbl('COALESCE(SUM(total_amount), 0)')} AS revenue,
                   COALESCE({avg('total_amount')}, 0) AS avg_order_value
            FROM purchases WHERE CAST(transaction_date AS DATE) = {today('purchases')}""",
    ),
    "notify_summary": query(
        "snapshot",
        f"""SELECT {day(today('orders_fact') + ' - 1')} AS report_date,
                   (SELECT COUNT(*) FROM orders_fact WHERE CAST(transaction_date AS DATE) = {today('orders_fact')} - 1)
                       AS transactions,
                   {dbl(f"COALESCE((SELECT total_revenue FROM snapshot WHERE report_date = {today('orders_fact')} - 1), 0)")}
                       AS total_revenue,
                   COALESCE((SELECT {rnd('aov', 2)} FROM snapshot WHERE report_date = {today('orders_fact')} - 1), 0)
                       AS avg_order_value""",
    ),
    "weekly_revenue": query(
        "weekly",
        f"""SELECT {day('week_start')} AS week_start, {dbl('revenue')} AS revenue,
                   {big('transactions')} AS transactions, {rnd('aov', 2)} AS avg_order_value,
                   {big('active_users')} AS active_users FROM weekly""",
    ),
    "revenue_ma7": query(
        "daily90",
        f"""SELECT {day('date')} AS date, {dbl('revenue')} AS revenue, avg_order_value,
                   CAST(SUM(revenue) OVER w AS DOUBLE) / COUNT(revenue) OVER w AS ma7
            FROM daily90 WHERE date >= (SELECT CAST(MAX(transaction_date) AS DATE) FROM orders_fact) - 30
            WINDOW w AS (ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""",
    ),
    "weekly_growth": query(
        "weekly",
        f"""SELECT {day('week_start')} AS week_start, {dbl('revenue')} AS revenue,
                   ({dbl('revenue')} / {dbl('LAG(revenue) OVER (ORDER BY week_start)')} - 1) * 100 AS wow_pct
            FROM weekly""",
    ),
    "dow_heatmap": query(
        "daily90",
        "SELECT CAST(weekofyear(date) AS VARCHAR) AS week, "
        + ", ".join(f"CAST(SUM(revenue) FILTER (dayname(date) = '{d}') AS DOUBLE) AS {d}" for d in WEEKDAYS)
        + " FROM daily90 GROUP BY 1",
    ),
    "best_weekday": query("daily90", WEEKDAY),
    "revenue_by_country": query("orders_fact users", COUNTRY),
    "top_markets": query(
        "orders_fact users",
        "SELECT country, revenue FROM by_country ORDER BY revenue DESC, country LIMIT 3",
        ("by_country", COUNTRY),
    ),
    "geo_performance": query(
        "purchases users",
        f"""SELECT country, city, COUNT(DISTINCT t.user_id) AS active_users, COUNT(*) AS transactions,
                   {dbl('SUM(total_amount)')} AS revenue
            FROM purchases t JOIN users u ON u.user_id = t.user_id
            WHERE transaction_date >= {now('purchases')} - INTERVAL 1 HOUR
            GROUP BY country, city ORDER BY revenue DESC, country, city LIMIT 20""",
    ),
    "revenue_by_age_group": query("orders_fact users", AGE),
    "payment_breakdown": query("lines", PAYMENT),
    "new_vs_returning": query(
        "purchases",
        f"""SELECT strftime(CAST(t.transaction_date AS DATE), '%Y-%m-%d') AS metric_date,
                   CASE WHEN CAST(f.first_date AS DATE) = CAST(t.transaction_date AS DATE) THEN 'New' ELSE 'Returning' END
                       AS customer_type,
                   COUNT(DISTINCT t.user_id) AS customers, COUNT(*) AS transactions,
                   {dbl('SUM(total_amount)')} AS revenue, {rnd(avg('total_amount'), 2)} AS avg_order_value
            FROM purchases t
            JOIN (SELECT user_id, MIN(transaction_date) AS first_date FROM purchases GROUP BY 1) f
              ON f.user_id = t.user_id
            GROUP BY 1, 2""",
    ),
    "breakdown_leaders": query(
        "orders_fact users lines daily90",
        """SELECT * FROM (SELECT 'age_group' AS breakdown, age_group AS leader, revenue AS value FROM by_age
                          ORDER BY revenue DESC, age_group LIMIT 1)
           UNION ALL
           SELECT * FROM (SELECT 'payment_method', payment_method, pct_of_revenue FROM by_payment
                          ORDER BY pct_of_revenue DESC, payment_method LIMIT 1)
           UNION ALL
           SELECT 'weekday', weekday, mean_revenue FROM by_weekday""",
        ("by_age", AGE),
        ("by_payment", PAYMENT),
        ("by_weekday", WEEKDAY),
    ),
    "persona_profile": query(
        "orders_fact users",
        f"""SELECT persona, COUNT(DISTINCT u.user_id) AS users, {big('COALESCE(SUM(n), 0)')} AS transactions,
                   {rnd('AVG(d.today - lp.last_date)', 0)} AS avg_recency_days, {rnd('AVG(aov)', 2)} AS avg_order_value,
                   {rnd('SUM(CASE WHEN d.today - lp.last_date > 90 THEN 1 ELSE 0 END) * 100.0 / COUNT(DISTINCT u.user_id)', 1)}
                       AS churn_pct
            FROM users u
            CROSS JOIN (SELECT {today('orders_fact')} AS today) d
            LEFT JOIN (SELECT user_id, CAST(MAX(transaction_date) AS DATE) AS last_date, COUNT(*) AS n,
                              {avg('total_amount')} AS aov
                       FROM orders_fact GROUP BY 1) lp ON lp.user_id = u.user_id
            GROUP BY persona""",
    ),
}
SQL["user_history_bucketed"] = SQL["user_history"]
