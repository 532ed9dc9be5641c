"""What the leaves of an ensemble pay to the rows of a task; the functions travel to the executors by value."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# rows that are looked up at once: their columns stay in the processor's cache
ROWS = 4096


def leaf_table(leaf, features: list[str]) -> tuple[list[tuple[int, float, float]], np.ndarray]:
    """The conditions of a leaf, (feature, low, high) each, and its Shapley values for every outcome of them.

    Row ``n`` of the table has one value per condition; bit ``i`` of ``n`` tells that condition ``i`` holds.
    """
    names = list(leaf.share)
    inf = float("inf")
    conditions = [(features.index(f), leaf.low.get(f, -inf), leaf.high.get(f, inf)) for f in names]
    k, share = len(names), np.array([leaf.share[f] for f in names])
    gain = np.array([outcome[::-1] for outcome in product((0.0, 1.0), repeat=k)]) - share
    points, weights = np.polynomial.legendre.leggauss((k + 1) // 2)
    table = np.zeros((2**k, k))
    for point, weight in zip((points + 1) / 2, weights / 2):
        factors = share + point * gain
        for j in range(k):
            table[:, j] += weight * np.prod(np.delete(factors, j, axis=1), axis=1)
    return conditions, leaf.value * gain * table


def paid_by_leaves(
    batches: Iterator[pa.RecordBatch], tables: list[tuple[list[tuple[int, float, float]], np.ndarray]]
) -> Iterator[pa.RecordBatch]:
    """(key, by_0, by_1, ...): per row the sum over all leaves for each feature.

    Batches have the key and one DOUBLE per feature. A null fails every condition, NaN all but
    those without an upper bound.
    """
    inf = float("inf")
    for batch in batches:
        columns = [batch.column(i + 1) for i in range(batch.num_columns - 1)]
        values = [c.fill_null(0.0).to_numpy(zero_copy_only=False) for c in columns]
        known = [None if c.null_count == 0 else c.is_valid().to_numpy(zero_copy_only=False) for c in columns]
        sums = [np.zeros(batch.num_rows) for _ in columns]
        for start in range(0, batch.num_rows, ROWS):
            part = slice(start, start + ROWS)
            x, there, total = [v[part] for v in values], [k if k is None else k[part] for k in known], [s[part] for s in sums]
            tests: dict[tuple[int, float, float], np.ndarray] = {}
            for conditions, table in tables:
                outcome = np.zeros(len(x[0]), np.intp)
                for bit, condition in enumerate(conditions):
                    holds = tests.get(condition)
                    if holds is None:
                        i, low, high = condition
                        # written so that NaN counts as above every number
                        holds = ~(x[i] <= low) if high == inf else (x[i] <= high) if low == -inf else (x[i] > low) & (x[i] <= high)
                        if there[i] is not None:
                            holds = holds & there[i]
                        holds = tests[condition] = holds.astype(np.intp)
                    outcome += holds << bit
                for place, (i, _, _) in enumerate(conditions):
                    total[i] += table[:, place].take(outcome)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *map(pa.array, sums)], [batch.schema.names[0], *(f"by_{i}" for i in range(len(sums)))]
        )
