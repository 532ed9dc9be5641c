"""Statements for products, recommendations and experiments."""

from oracle.base import avg, big, dbl, day, query, rnd, sec
from oracle.kpi import now, today

JACCARD = """
    SELECT a.user_id AS user_a, b.user_id AS user_b,
           (2000000000000 * COUNT(*) + MIN(sa.n) + MIN(sb.n) - COUNT(*))
               // (2 * (MIN(sa.n) + MIN(sb.n) - COUNT(*))) AS similarity
    FROM owned a JOIN owned b ON a.product_id = b.product_id AND a.user_id <> b.user_id
    JOIN sizes sa ON sa.user_id = a.user_id JOIN sizes sb ON sb.user_id = b.user_id
    GROUP BY a.user_id, b.user_id HAVING COUNT(*) >= 2"""

SIZES = "SELECT user_id, COUNT(*) AS n FROM owned GROUP BY user_id"

SCORES = """
    SELECT s.user_a AS target_user, t.product_id, SUM(s.similarity) AS score,
           COUNT(DISTINCT s.user_b) AS recommended_by_n_similar_users
    FROM alike s JOIN lines t ON t.user_id = s.user_b
    WHERE NOT EXISTS (SELECT 1 FROM owned o WHERE o.user_id = s.user_a AND o.product_id = t.product_id)
    GROUP BY s.user_a, t.product_id HAVING (SUM(s.similarity) + 500000) // 1000000 > 100000"""

RECOMMENDED = f"""
    SELECT target_user, product_id, product_name, category, {dbl('current_price')} AS current_price,
           ((score + 500000) // 1000000) / 1e6 AS recommendation_score, recommended_by_n_similar_users
    FROM scores JOIN products USING (product_id)
    QUALIFY ROW_NUMBER() OVER (PARTITION BY target_user ORDER BY (score + 500000) // 1000000 DESC, product_id) <= 20"""

ALERTS = f"""
    SELECT p.product_id, product_name, category, stock_quantity AS current_stock,
           COUNT(t.transaction_id) AS sales_last_24h, {big('COALESCE(SUM(t.quantity), 0)')} AS units_sold_last_24h,
           CASE WHEN SUM(t.quantity) > 0 THEN {rnd('stock_quantity / CAST(SUM(t.quantity) AS DOUBLE)', 1)} END
               AS days_until_stockout
    FROM products p LEFT JOIN lines t
      ON p.product_id = t.product_id AND t.transaction_date >= {now('orders_fact')} - INTERVAL 24 HOUR
    GROUP BY p.product_id, product_name, category, stock_quantity
    HAVING stock_quantity < 50 OR CAST(stock_quantity AS DOUBLE) / NULLIF(SUM(t.quantity), 0) < 7
    ORDER BY days_until_stockout NULLS LAST, p.product_id"""

PAIRS = """
    SELECT a.product_id AS product_a, b.product_id AS product_b, COUNT(*) AS common
    FROM owned a JOIN owned b ON a.user_id = b.user_id AND a.product_id < b.product_id
    GROUP BY 1, 2 HAVING COUNT(*) >= 5"""

POPULARITY = "SELECT product_id, COUNT(*) AS buyers FROM owned GROUP BY product_id"


def top(columns: str, since: str, limit: int) -> str:
    return query(
        "lines products",
        f"""SELECT {columns} FROM lines t JOIN products p ON p.product_id = t.product_id
            WHERE transaction_date >= {since}
            GROUP BY p.product_id, product_name, category, current_price
            ORDER BY SUM(total_amount) DESC, p.product_id LIMIT {limit}""",
    )


def category(columns: str, since: str) -> str:
    return query(
        "lines products",
        f"""SELECT category, COUNT(DISTINCT t.user_id) AS unique_buyers, {columns}
            FROM lines t JOIN products p ON p.product_id = t.product_id
            WHERE transaction_date >= {since} GROUP BY category""",
    )


UNITS, REVENUE = f"{big('SUM(quantity)')} AS units_sold", f"{dbl('SUM(total_amount)')} AS revenue"
NAMED = "p.product_id, product_name, category"

METRIC = f"""
    SELECT {day(today('orders_fact'))} AS metric_date, 'churn-discount-v1' AS experiment_key, variant,
           assigned_users, converted_users,
           {rnd('converted_users / CAST(NULLIF(assigned_users, 0) AS DOUBLE)', 4)} AS conversion_rate
    FROM conversion"""

SQL = {
    "top_products_hour": top(
        f"{NAMED}, COUNT(*) AS purchase_count, {UNITS}, {REVENUE}, {avg('total_amount')} AS avg_sale_price",
        f"{now('orders_fact')} - INTERVAL 1 HOUR", 10,
    ),
    "top_products_today": top(f"{NAMED}, {UNITS}, {REVENUE}", today("orders_fact"), 10),
    "rec_trending": top(
        f"{NAMED}, {dbl('current_price')} AS current_price, {UNITS}, {REVENUE}",
        f"{now('orders_fact')} - INTERVAL 24 HOUR", 20,
    ),
    "top_categories_hour": category(
        f"COUNT(*) AS transactions, {REVENUE}, {UNITS}, {avg('total_amount')} AS avg_order_value",
        f"{now('orders_fact')} - INTERVAL 1 HOUR",
    ),
    "top_categories_today": category(f"{UNITS}, {REVENUE}", today("orders_fact")),
    "inventory_alerts": query("lines products", "SELECT * FROM alerts", ("alerts", ALERTS + " LIMIT 20")),
    "inventory_severity": query(
        "lines products",
        """SELECT COUNT(*) FILTER (days_until_stockout < 3) AS critical,
                  COUNT(*) FILTER (days_until_stockout >= 3 AND days_until_stockout < 7) AS warning,
                  COUNT(*) FILTER (days_until_stockout IS NULL) AS no_recent_sales FROM alerts""",
        ("alerts", ALERTS),
    ),
    "product_detail": query(
        "lines products",
        f"""SELECT p.product_id, product_name, category, subcategory, brand, {dbl('current_price')} AS current_price,
                   stock_quantity, {big('COALESCE(SUM(t.quantity), 0)')} AS units_sold_24h,
                   {dbl('COALESCE(SUM(t.total_amount), 0)')} AS revenue_24h
            FROM products p LEFT JOIN lines t ON t.product_id = p.product_id
             AND t.transaction_date >= {now('orders_fact')} - INTERVAL 24 HOUR
            WHERE p.product_id = 1
            GROUP BY p.product_id, product_name, category, subcategory, brand, current_price, stock_quantity""",
    ),
    "rec_user_jaccard": query(
        "owned lines products",
        RECOMMENDED,
        ("sizes", SIZES),
        ("alike", JACCARD.replace("a.user_id <> b.user_id", "a.user_id = 1 AND b.user_id <> 1")),
        ("scores", SCORES),
    ),
    "rec_user_jaccard_batch": query(
        "owned lines products", RECOMMENDED, ("sizes", SIZES), ("alike", JACCARD), ("scores", SCORES)
    ),
    "rec_user_overlap": query(
        "owned products",
        f"""SELECT product_id, product_name, category, {dbl('current_price')} AS current_price, overlap AS
                   recommendation_score, 'customers like you also bought' AS reason
            FROM (SELECT product_id, COUNT(DISTINCT user_id) AS overlap FROM owned
                  WHERE user_id IN (SELECT user_id FROM owned WHERE user_id <> 1
                                    AND product_id IN (SELECT product_id FROM owned WHERE user_id = 1))
                    AND product_id NOT IN (SELECT product_id FROM owned WHERE user_id = 1)
                  GROUP BY product_id)
            JOIN products USING (product_id) ORDER BY overlap DESC, product_id LIMIT 10""",
    ),
    "rec_item_lift": query(
        "owned products users",
        f"""SELECT product_a, pa.product_name AS product_a_name, product_b, pb.product_name AS product_b_name,
                   common AS co_purchase_count, ka.buyers AS product_a_buyers, kb.buyers AS product_b_buyers,
                   {rnd('common * CAST(n AS DOUBLE) / (ka.buyers * kb.buyers)', 2)} AS lift,
                   {rnd('100.0 * common / ka.buyers', 2)} AS confidence_pct
            FROM pairs JOIN popularity ka ON ka.product_id = product_a
            JOIN popularity kb ON kb.product_id = product_b
            JOIN products pa ON pa.product_id = product_a JOIN products pb ON pb.product_id = product_b,
            (SELECT COUNT(*) AS n FROM users)
            WHERE lift > 1.5
            ORDER BY lift DESC, common DESC, product_a, product_b LIMIT 50""",
        ("pairs", PAIRS),
        ("popularity", POPULARITY),
    ),
    "rec_similar_products": query(
        "owned products users",
        f"""SELECT product_id, product_name, category, {dbl('current_price')} AS current_price,
                   common AS co_purchase_count, kb.buyers AS paired_buyers, ka.buyers AS base_buyers,
                   {rnd('common * CAST(n AS DOUBLE) / (ka.buyers * kb.buyers)', 2)} AS lift,
                   {rnd('100.0 * common / ka.buyers', 2)} AS confidence_pct
            FROM (SELECT b.product_id, COUNT(DISTINCT a.user_id) AS common
                  FROM owned a JOIN owned b ON a.user_id = b.user_id AND b.product_id <> a.product_id
                  WHERE a.product_id = 1 GROUP BY 1 HAVING COUNT(DISTINCT a.user_id) >= 2)
            JOIN products USING (product_id) JOIN popularity kb USING (product_id)
            JOIN (SELECT buyers FROM popularity WHERE product_id = 1) ka ON TRUE,
            (SELECT COUNT(*) AS n FROM users)
            ORDER BY lift DESC, common DESC, product_id LIMIT 10""",
        ("popularity", POPULARITY),
    ),
    "ab_eligibility": query("offers", f"SELECT user_id, {dbl('churn_risk')} AS churn_risk, eligible FROM offers"),
    "ab_assign": query(
        "offers",
        f"""SELECT user_id, {dbl('churn_risk')} AS churn_risk, eligible, 'churn-discount-v1' AS experiment_key,
                   variant, COALESCE(variant = 'discount_10pct', FALSE) AS show_discount,
                   {big("CASE WHEN variant = 'discount_10pct' THEN 10 ELSE 0 END")} AS discount_pct
            FROM (SELECT *, CASE WHEN eligible THEN CASE WHEN bucket < 500 THEN 'control' ELSE 'discount_10pct' END
                            END AS variant FROM offers)""",
    ),
    "ab_log_sticky": query(
        "assigned offers",
        f"""SELECT user_id, experiment_key, 'control' AS variant, {sec('assigned_at - INTERVAL 30 DAY')} AS assigned_at
            FROM assigned JOIN offers USING (user_id) WHERE churn_risk > 0.7
            UNION ALL
            SELECT user_id, experiment_key, variant, {sec('assigned_at')}
            FROM assigned JOIN offers USING (user_id) WHERE churn_risk <= 0.7""",
    ),
    "ab_conversion": query("conversion", METRIC),
    "ab_summary": query(
        "conversion assigned",
        """SELECT variant, assigned_users, converted_users, conversion_rate * 100 AS rate_pct,
                  (SELECT COUNT(*) FROM assigned) AS total_assignments FROM metric""",
        ("metric", METRIC),
    ),
    "ab_results": query(
        "conversion assigned",
        """SELECT 'assignment' AS kind, NULL AS metric_date, variant, COUNT(*) AS assigned_users,
                  CAST(NULL AS BIGINT) AS converted_users, CAST(NULL AS DOUBLE) AS conversion_rate
           FROM assigned GROUP BY variant
           UNION ALL
           SELECT * FROM (SELECT 'metric', metric_date, variant, assigned_users, converted_users, conversion_rate
                          FROM metric ORDER BY metric_date DESC, variant LIMIT 4)""",
        ("metric", METRIC),
    ),
}
