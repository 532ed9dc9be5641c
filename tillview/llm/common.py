"""Helpers that several operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def named(name: str) -> Column:
    """The column of that very name, dots included."""
    return F.col(f"`{name.replace('`', '``')}`")


#: Bytes of input texts that a task holds as Python objects at a time.
SLICE_BYTES = 4 << 20


def slices(batch: pa.RecordBatch, inputs: Sequence[int], most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts in the columns ``inputs`` have about ``most`` bytes, a longer row alone."""
    size = np.zeros(batch.num_rows, np.int64)
    for i in inputs:
        column = batch.column(i)
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            size += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    before, start = np.r_[0, np.cumsum(size)], 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(before, before[start] + most, "right")) - 1)
        yield batch.slice(start, end - start)
        start = end


def append_columns(
    df: DataFrame,
    inputs: Sequence[str],
    fields: Sequence[T.StructField],
    make: Callable[..., Sequence[pa.Array]],
    slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """``df`` with columns that ``make`` computes from a few MB of the ``inputs`` at a time.

    No shuffle; results of a slice leave before the next is read. A column of ``df`` named
    like a new one is replaced.
    """
    new = {f.name for f in fields}
    kept = [f for f in df.schema.fields if f.name not in new]
    places = {f.name: i for i, f in enumerate(kept)}
    hidden = [n for n in inputs if n not in places]
    source = df.select(*(named(f.name) for f in kept), *(named(n).alias(f"input_{i}_") for i, n in enumerate(hidden)))
    places |= {n: len(kept) + i for i, n in enumerate(hidden)}
    at, width, names = [places[n] for n in inputs], len(kept), [f.name for f in kept] + [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at, slice_bytes):
                made = make(*(part.column(i) for i in at))
                yield pa.RecordBatch.from_arrays([*part.columns[:width], *made], names=names)

    return source.mapInArrow(run, T.StructType([*kept, *fields]))


def bounded_sample(df: DataFrame, key: str, stratum: str, per_stratum: int) -> DataFrame:
    """At most ``per_stratum`` values of ``key`` (a BIGINT) for each value of ``stratum``, spread by hash.

    Each stratum is cut into ``per_stratum`` hash cells and each cell gives the key
    with the smallest hash: one aggregation with map-side combine over two narrow
    columns, no window over a stratum, the same sample however the rows are dealt.
    """
    mixed = F.xxhash64(named(key), F.lit("sample"))
    return (
        df.where(named(key).isNotNull() & named(stratum).isNotNull())
        .groupBy(named(stratum).alias(stratum), F.pmod(F.xxhash64(named(key), F.lit("cell")), F.lit(per_stratum)).alias("cell"))
        .agg(F.min_by(named(key), mixed).alias(key))
        .select(stratum, key)
    )
