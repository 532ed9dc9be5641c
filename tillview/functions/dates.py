"""Time anchors and calendar arithmetic.

``as_of`` stands for "now" in every operator. A caller passes a datetime, a
string or a Column; without one it is the newest timestamp of the fact, which is
looked up once. As a literal it reaches the Parquet scan (and prunes monthly
partitions), which a value computed inside the query would not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TS = "transaction_date"


class Anchor:
    """The ``as_of`` instant in the type of the fact's time column.

    Range tests compare the bare column with the anchor: a cast around the
    column would keep the predicate out of the Parquet scan.
    """

    def __init__(self, fact: DataFrame, as_of=None, column: str = TS):
        self.column = column
        self.type = fact.schema[column].dataType
        if as_of is None:
            as_of = fact.agg(F.max(column)).first()[0]
        if not isinstance(as_of, Column):
            # through text, so that the Python process's own time zone plays no part
            as_of = F.lit(None if as_of is None else str(as_of))
        self.now = as_of.cast(self.type)
        self.date = F.to_date(self.now)

    def since(self, interval: str) -> Column:
        """Rows from ``as_of - interval`` on, like ``ts >= NOW() - INTERVAL``."""
        return F.col(self.column) >= (self.now - F.expr(f"INTERVAL {interval}")).cast(self.type)

    def midnight(self, days_back: int = 0) -> Column:
        return F.date_sub(self.date, days_back).cast(self.type)

    def since_day(self, days_back: int) -> Column:
        return F.col(self.column) >= self.midnight(days_back)

    def on_day(self, days_back: int = 0) -> Column:
        """``DATE(ts) = CURRENT_DATE - days_back`` as a half-open range."""
        ts = F.col(self.column)
        return (ts >= self.midnight(days_back)) & (ts < self.midnight(days_back - 1))

    def days_since(self, col: Column) -> Column:
        return F.datediff(self.date, F.to_date(col)).cast("bigint")


def month_of(col: Column | str) -> Column:
    return F.trunc(F.to_date(col), "month")


def calendar_months(start: Column, end: Column) -> Column:
    """Months between two calendar months, ignoring the day."""
    return (
        (F.year(end) * 12 + F.month(end)) - (F.year(start) * 12 + F.month(start))
    ).cast("bigint")


def elapsed_months(start: Column, end: Column) -> Column:
    """Whole months elapsed, like year * 12 + month of ``AGE(end, start)``."""
    return F.timestamp_diff("MONTH", start, end).cast("bigint")
