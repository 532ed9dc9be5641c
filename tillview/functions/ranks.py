"""Exact order statistics, percentiles and NTILE without a single-task sort.

``NTILE(b) OVER (ORDER BY x)`` and an exact global percentile both send every
row to one task in plain Spark. Both only depend on a handful of rows, the ones
at known ranks, so these are looked up instead:

1. an approximate quantile sketch (mergeable, bounded size) brackets each rank,
2. one pass counts the rows below each bracket, another builds the value histogram
   inside it; map-side combine makes a value shared by many rows one entry,
3. the running count over that narrow histogram names the value at the rank.

Ties are cut by a unique id, found the same way among the rows of that value.
Only these few values reach the driver, and scoring is a plain projection.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from decimal import Decimal
from typing import Any, Hashable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillview.sources.scratch import materialize

SKETCH_ACCURACY = 10_000


@dataclass(frozen=True)
class Target:
    """The row at 0-based ``rank`` among the ``size`` rows with a non-null key."""

    name: Hashable
    key: Column
    rank: int
    size: int


@dataclass(frozen=True)
class Found:
    value: Any
    before: int
    ties: int


def find_ranks(table: DataFrame, targets: list[Target], key_type: str) -> dict[Hashable, Found]:
    """Value at each target rank, the rows before it and the rows equal to it."""
    if not targets:
        return {}
    brackets = _brackets(table, targets, key_type)

    entries, below = [], []
    for position, target in enumerate(targets):
        key = target.key.cast(key_type)
        low, high = brackets[target.name]
        inside = key.isNotNull() if high is None else key <= _lit(high, key_type)
        if low is not None:
            inside = inside & (key >= _lit(low, key_type))
        below.append(F.lit(0) if low is None else F.count_if(key < _lit(low, key_type)))
        entries.append(F.when(inside, F.struct(F.lit(position).alias("target"), key.alias("value"))))

    # one row of plain counts; only the few rows inside a bracket are multiplied by targets
    first = table.agg(*[b.cast("bigint").alias(f"b{i}") for i, b in enumerate(below)]).first()
    histogram = (
        table.select(F.explode(F.array_compact(F.array(*entries))).alias("e"))
        .groupBy("e.target", "e.value")
        .agg(F.count("*").alias("ties"))
    )
    running = Window.partitionBy("target").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    of_target = lambda values: F.element_at(F.array(*[F.lit(v).cast("bigint") for v in values]), F.col("target") + 1)
    wanted = of_target([t.rank for t in targets])
    hits = (
        histogram.withColumn("upto", F.sum("ties").over(running) + of_target(first))
        .filter((F.col("upto") > wanted) & (F.col("upto") - F.col("ties") <= wanted))
        .collect()  # one row per target
    )
    found = {targets[h.target].name: Found(h.value, h.upto - h.ties, h.ties) for h in hits}
    for target in targets:
        if target.name not in found or found[target.name].value is None:
            raise RuntimeError(f"rank {target.rank} lies outside its bracket: {target.name}")
    return found


def _brackets(table: DataFrame, targets: list[Target], key_type: str) -> dict[Hashable, tuple[Any, Any]]:
    """Values that enclose each rank: three sketch errors away on both sides."""
    margin = 3.0 / SKETCH_ACCURACY
    sketches = []
    for target in targets:
        share = target.rank / target.size
        bounds = F.array(F.lit(max(share - margin, 0.0)), F.lit(min(share + margin, 1.0)))
        sketches.append(F.percentile_approx(target.key.cast(key_type), bounds, SKETCH_ACCURACY))
    row = table.agg(*[s.alias(f"s{i}") for i, s in enumerate(sketches)]).first()
    brackets = {}
    for i, target in enumerate(targets):
        low, high = row[i]
        share = target.rank / target.size
        # at the ends of the range the bracket stays open
        brackets[target.name] = (low if share > margin else None, high if share < 1 - margin else None)
    return brackets


def with_ntiles(
    df: DataFrame,
    orders: dict[str, Column],
    id_column: str,
    buckets: int = 5,
) -> DataFrame:
    """Add ``NTILE(buckets) OVER (ORDER BY key, id)`` for every ``name: key``.

    ``df`` is stored first, because it is read several times and recomputing it
    must not change it. Keys are not null; ``id_column`` is unique.
    """
    table = materialize(df, "ntile")
    key_type = _key_type(table, list(orders.values()))
    size = table.count()
    base, extra = divmod(size, buckets)
    starts = [i * base + min(i, extra) for i in range(1, buckets)]

    edges = [
        Target((name, i), key, start, size)
        for name, key in orders.items()
        for i, start in enumerate(starts)
        if start < size
    ]
    values = find_ranks(table, edges, key_type)
    tied = [
        Target(t.name, F.when(t.key.cast(key_type) == _lit(values[t.name].value, key_type), F.col(id_column)),
               t.rank - values[t.name].before, values[t.name].ties)
        for t in edges
        if t.rank > values[t.name].before
    ]
    id_type = table.schema[id_column].dataType.simpleString()
    ids = find_ranks(table, tied, id_type)

    scored = {}
    for name, key in orders.items():
        bucket = F.lit(1)
        for i in range(buckets - 1):
            if (name, i) not in values:
                continue
            edge = _lit(values[(name, i)].value, key_type)
            reached = key.cast(key_type) >= edge
            if (name, i) in ids:
                reached = (key.cast(key_type) > edge) | (
                    (key.cast(key_type) == edge) & (F.col(id_column) >= _lit(ids[(name, i)].value, id_type))
                )
            bucket = bucket + reached.cast("int")
        scored[name] = bucket.cast("bigint")
    return table.withColumns(scored)


def exact_percentiles(
    df: DataFrame,
    columns: list[str],
    fractions: list[float],
) -> dict[str, list[float | None]]:
    """``percentile_cont`` of each column at each fraction, as driver-side numbers."""
    table = materialize(df.select(*columns), "percentiles")
    key_type = _key_type(table, [F.col(c) for c in columns])
    sizes = table.agg(*[F.count(c).alias(c) for c in columns]).first()
    targets = {}
    for column in columns:
        for fraction in fractions:
            if sizes[column]:
                exact = fraction * (sizes[column] - 1)
                for rank in {math.floor(exact), math.ceil(exact)}:
                    targets[(column, rank)] = Target((column, rank), F.col(column), rank, sizes[column])
    found = find_ranks(table, list(targets.values()), key_type)

    def interpolate(column: str, fraction: float) -> float | None:
        if not sizes[column]:
            return None
        exact = fraction * (sizes[column] - 1)
        low = float(found[(column, math.floor(exact))].value)
        high = float(found[(column, math.ceil(exact))].value)
        return low + (exact - math.floor(exact)) * (high - low)

    return {c: [interpolate(c, f) for f in fractions] for c in columns}


def _key_type(table: DataFrame, keys: list[Column]) -> str:
    """Amounts and counts rank as long-backed decimals, anything else as double."""
    types = [f.dataType for f in table.select(*[k.alias(f"k{i}") for i, k in enumerate(keys)]).schema]
    whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    if all(isinstance(t, whole) or (isinstance(t, T.DecimalType) and t.scale <= 2) for t in types):
        return "decimal(18,2)"
    return "double"


def _lit(value: Any, key_type: str) -> Column:
    return F.lit(str(value) if isinstance(value, Decimal) else value).cast(key_type)
