"""DuckDB statements the queries are checked against."""

from oracle import churn, customers, kpi, products, streams

STATEMENTS: dict[str, str] = {**kpi.SQL, **customers.SQL, **products.SQL, **churn.SQL, **streams.SQL}
